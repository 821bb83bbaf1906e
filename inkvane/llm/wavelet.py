"""Token-ID output: one wavelet matrix per shard, a succinct index that is also the file of the ids.

A shard holds the ids of consecutive documents. Its ids are cut into bit-planes, the highest bit first; before each next
plane the ids are dealt stably, zeros first. With counts of ones every 512 bits, one compressed file then answers
``access`` (the id at a place), ``count`` (how often an id occurs before a place), ``select`` (the place of its k-th
occurrence) and ``occurrences`` (all of them), and decodes back to the ids.

Documents: null text counts as empty, and has the end id only; very long texts are never cut and may make a shard longer
than ``shard_tokens``; repeated doc_ids stay separate rows beside each other; a null doc_id comes first; an empty table
gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkvane.llm.common import arrow_bytes, new_path, read

MAGIC = b"IVWM2"
RANK_BITS = 512
END_ID = 1
SHARD_TOKENS = 1 << 21
CACHED_WORDS, CACHED_PARTS = 300_000, 450_000


class WaveletMatrix:
    """Rank, select and access over a sequence of unsigned ids. Planes hold the ids' places in ``symbols``."""

    def __init__(self, n: int, symbols: np.ndarray, planes: list[np.ndarray], ranks: list[np.ndarray], zeros: list[int]):
        self.n, self.symbols, self.planes, self.ranks, self.zeros = n, symbols, planes, ranks, zeros
        self.bits = len(planes)
        self._places: dict[int, int] | None = None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        """symbols: the ids that occur, the most frequent first, so upper planes are nearly empty and few."""
        n = len(ids)
        often = np.bincount(ids) if n else np.zeros(0, np.int64)
        symbols = np.flatnonzero(often)
        symbols = symbols[np.argsort(-often[symbols], kind="stable")].astype(np.uint32)
        bits = max(1, (len(symbols) - 1).bit_length())
        place = np.zeros(len(often), np.uint16 if bits <= 16 else np.uint32)
        place[symbols] = np.arange(len(symbols))
        a = place[ids] if n else place
        planes, ranks, zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            ones = (a & a.dtype.type(1 << level)) != 0
            plane = np.packbits(ones, bitorder="little")
            planes.append(plane)
            ranks.append(cls._directory(plane))
            low = np.flatnonzero(~ones)
            zeros.append(len(low))
            dealt = np.empty_like(a)
            a.take(low, out=dealt[: len(low)], mode="clip")
            a.take(np.flatnonzero(ones), out=dealt[len(low) :], mode="clip")
            a = dealt.astype(np.uint8) if level == 8 else dealt
        return cls(n, symbols, planes, ranks, zeros)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block of RANK_BITS bits."""
        step = RANK_BITS // 8
        padded = np.zeros(-(-len(plane) // step) * step, np.uint8)
        padded[: len(plane)] = plane
        per = np.bitwise_count(padded.reshape(-1, step)).sum(axis=1, dtype=np.uint64)
        return np.concatenate([[0], np.cumsum(per)]).astype(np.uint32)

    def _rank1(self, level: int, i: int) -> int:
        block = i // RANK_BITS
        part = self.planes[level][block * (RANK_BITS // 8) : (i + 7) // 8]
        ones = int(np.bitwise_count(part).sum())
        if i % 8 and len(part):
            ones -= int(part[-1] >> (i % 8)).bit_count()
        return int(self.ranks[level][block]) + ones

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8] >> (i % 8)) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | bit
        return int(self.symbols[value])

    def _place(self, value: int) -> int | None:
        if self._places is None:
            self._places = {int(v): i for i, v in enumerate(self.symbols)}
        return self._places.get(value)

    def _span(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of value among the first i ids lie after the last plane."""
        value = self._place(value)
        if value is None:
            return 0, 0
        start = 0
        for level in range(self.bits):
            ones_s, ones_i = self._rank1(level, start), self._rank1(level, i)
            if value >> (self.bits - 1 - level) & 1:
                start, i = self.zeros[level] + ones_s, self.zeros[level] + ones_i
            else:
                start, i = start - ones_s, i - ones_i
        return start, i

    def count(self, value: int, i: int | None = None) -> int:
        start, end = self._span(value, self.n if i is None else i)
        return end - start

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit: bisect the directory, then look into one block."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if bit else np.arange(len(ranks)) * RANK_BITS - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        step = RANK_BITS // 8
        inside = np.unpackbits(self.planes[level][block * step : (block + 1) * step], bitorder="little")
        return block * RANK_BITS + int(np.flatnonzero(inside == bit)[k - int(before[block])])

    def select(self, value: int, k: int) -> int:
        start, end = self._span(value, self.n)
        if not 0 <= k < end - start:
            raise IndexError(k)
        i, value = start + k, self._place(value)
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def decode(self) -> np.ndarray:
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            zeros = self.zeros[level]
            out[zeros:] |= out.dtype.type(1 << (self.bits - 1 - level))
            dealt = np.empty_like(out)
            dealt[np.flatnonzero(~ones)] = out[:zeros]
            dealt[np.flatnonzero(ones)] = out[zeros:]
            out = dealt
        return self.symbols[out] if self.n else out.astype(np.uint32)


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of one shard: header, then compressed sections, each with its length."""
    matrix = WaveletMatrix.build(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], np.int64)
    sections = [np.diff(docs, prepend=0).tobytes(), np.packbits(known).tobytes(), np.array(lengths, np.uint32).tobytes(), matrix.symbols.tobytes()]
    for plane, ranks in zip(matrix.planes, matrix.ranks, strict=True):
        sections += [plane.tobytes(), np.diff(ranks).astype(np.uint16).tobytes()]
    pressed = [zstandard.ZstdCompressor(level=1).compress(s) for s in sections]
    head = struct.pack("<IQB", len(doc_ids), len(ids), matrix.bits) + struct.pack(f"<{matrix.bits}Q", *matrix.zeros)
    return b"".join([MAGIC, head, *(struct.pack("<I", len(p)) + p for p in pressed)])


def open_shard(blob: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc_ids, their numbers of ids, and the matrix of a shard."""
    if blob[: len(MAGIC)] != MAGIC:
        raise ValueError("not a shard")
    at = len(MAGIC)
    n_docs, n, bits = struct.unpack_from("<IQB", blob, at)
    at += struct.calcsize("<IQB")
    zeros = list(struct.unpack_from(f"<{bits}Q", blob, at))
    at += 8 * bits
    parts = []
    for _ in range(4 + 2 * bits):
        (size,) = struct.unpack_from("<I", blob, at)
        parts.append(zstandard.ZstdDecompressor().decompress(blob[at + 4 : at + 4 + size]))
        at += 4 + size
    docs = np.cumsum(np.frombuffer(parts[0], np.int64))
    known = np.unpackbits(np.frombuffer(parts[1], np.uint8), count=n_docs)
    planes = [np.frombuffer(p, np.uint8) for p in parts[4::2]]
    ranks = [np.concatenate([[0], np.cumsum(np.frombuffer(p, np.uint16).astype(np.int64))]).astype(np.uint32) for p in parts[5::2]]
    return [int(d) if k else None for d, k in zip(docs, known, strict=True)], np.frombuffer(parts[2], np.uint32), WaveletMatrix(n, np.frombuffer(parts[3], np.uint32), planes, ranks, zeros)


#: Words of these characters need no normalising but lower case, and the tokenizer's rule splits them into these parts.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+").fullmatch
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall


def byte_letters() -> dict[int, str]:
    """The letter for each byte in a byte-level vocabulary: printable bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def little(ids: list[int]) -> bytes:
    """ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class PartIds(dict):
    """ids of a part of a word, by the library's BPE model alone; holds the first CACHED_PARTS it meets."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenize, self.letters = tokenizer.model.tokenize, byte_letters()

    def __missing__(self, part: str) -> bytes:
        ids = little([t.id for t in self.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.letters))])
        if len(self) < CACHED_PARTS:
            self[part] = ids
        return ids


#: The rules of a tokenizer's file under which a text's ids are those of its words. Fixed values.
WORD_RULES = {
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(tokenizer) -> bool:
    """Whether a tokenizer lower-cases, drops white space and splits words as ``WordIds`` does."""
    rules = json.loads(tokenizer.to_str())
    return all((rules[k] or {}).get(many) == WORD_RULES[many] for k, many in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))) and rules["model"]["type"] == "BPE"


class WordIds(dict):
    """ids of a word as little-endian 32-bit integers, for a byte-level BPE that lower-cases and drops white space: the
    ids of the words between ASCII white space, one after the other, are those of the text. Plain words go to the BPE
    model in parts, others through the whole tokenizer. Holds the first CACHED_WORDS words it meets. With a tokenizer of
    other rules, ``of`` encodes whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.parts, self.by_words = tokenizer.encode, PartIds(tokenizer), by_words(tokenizer)

    def of(self, text: bytes) -> bytes:
        """The ids of a text."""
        if self.by_words:
            return b"".join(map(self.__getitem__, text.split()))
        return little(self.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def __missing__(self, raw: bytes) -> bytes:
        word = raw.decode("utf-8", "replace")
        if raw.isalpha():
            ids = self.parts[word.lower()]
        elif raw[:-1].isalpha() and raw[-1] in b".,;:!?":
            ids = self.parts[word[:-1].lower()] + self.parts[word[-1]]
        elif _PLAIN(word) and "<|" not in word:
            ids = b"".join(map(self.parts.__getitem__, _PARTS(word.lower())))
        else:
            ids = little(self.encode(word, add_special_tokens=False).ids)
        if len(self) < CACHED_WORDS:
            self[raw] = ids
        return ids


_words: dict[str, WordIds] = {}


def shards_of(batches, path: str, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID):
    """Arrow batches (doc_id, text as bytes) in doc_id order -> shards (shard_id, n_docs, n_tokens, data)."""
    words = _words[path] = _words.get(path) or WordIds(path)
    end = struct.pack("<I", end_id)
    part, seq = TaskContext.get().partitionId(), 0
    docs, lengths, held, total = [], [], [], 0

    def shard():
        ids = np.frombuffer(b"".join(held), "<u4")
        return pa.RecordBatch.from_pydict(
            {"shard_id": [part << 32 | seq], "n_docs": [len(docs)], "n_tokens": [total], "data": [pack_shard(docs, lengths, ids)]},
            schema=pa.schema([("shard_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())]),
        )

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = words.of(text.as_py() or b"") + end
            docs.append(doc)
            lengths.append(len(ids) // 4)
            held.append(ids)
            total += len(ids) // 4
            if total >= shard_tokens:
                yield shard()
                seq += 1
                docs, lengths, held, total = [], [], [], 0
    if docs:
        yield shard()


def write_shards(docs: DataFrame, tokenizer: str, path: str, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> None:
    """Encode docs (doc_id, text) with the tokenizer's file and write shards in ascending doc_id order to path."""
    arrow_bytes(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # Rows of one doc_id are in the order of their texts, so a task that is run again writes the same shards.
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def encode(batches):
        yield from shards_of(batches, tokenizer, shard_tokens, end_id)

    shards = rows.mapInArrow(encode, "shard_id long, n_docs long, n_tokens long, data binary")
    shards.write.option("compression", "none").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard_id, n_docs, n_tokens, data) of a written folder."""
    return spark.read.schema("shard_id long, n_docs long, n_tokens long, data binary").parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(shard_id, first): ids in all shards before. Sums within each writer's partition, then over the partitions."""
    sizes = shards.select("shard_id", F.shiftright("shard_id", 32).alias("part"), "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("inside", inside).join(parts.select("part", before.alias("before")), "part").select("shard_id", (F.col("before") + F.col("inside")).alias("first"))


def documents_of(shards: DataFrame) -> DataFrame:
    """What the shards hold, a row per document: shard_id, doc_id, at (place in the shard), n_tokens, ids_crc32."""

    def decode(batches):
        for batch in batches:
            for shard_id, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, lengths, matrix = open_shard(blob.as_py())
                raw = memoryview(matrix.decode().astype("<u4").tobytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard_id] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())],
                    names=["shard_id", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    arrow_bytes(shards.sparkSession)
    return shards.select("shard_id", "data").mapInArrow(decode, "shard_id long, doc_id long, at long, n_tokens long, ids_crc32 long")


def counts_of(shards: DataFrame, ids: list[int]) -> DataFrame:
    """(id, n): how often ids occur in all shards, by rank over their planes; nothing is decoded."""

    def count(batches):
        for batch in batches:
            total = [0] * len(ids)
            for blob in batch.column(0):
                matrix = open_shard(blob.as_py())[2]
                total = [t + matrix.count(i) for t, i in zip(total, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total, pa.int64())], names=["id", "n"])

    arrow_bytes(shards.sparkSession)
    return shards.select("data").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def occurrences_of(shards: DataFrame, token: int) -> DataFrame:
    """(doc_id, at): every place of an id, within its document, by select over the shards' planes."""

    def find(batches):
        for batch in batches:
            for blob in batch.column(0):
                docs, lengths, matrix = open_shard(blob.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                places = np.array(matrix.occurrences(token), np.int64)
                doc = np.searchsorted(ends, places, side="right")
                yield pa.RecordBatch.from_arrays([pa.array([docs[i] for i in doc.tolist()], pa.int64()), pa.array(places - (ends - lengths)[doc])], names=["doc_id", "at"])

    arrow_bytes(shards.sparkSession)
    return shards.select("data").mapInArrow(find, "doc_id long, at long")


def token_table(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write docs as shards, read them back, and return doc_id, start, n_tokens, ids_crc32 per document."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_shards(docs, tokenizer, path)
    shards = read_shards(spark, path)
    return documents_of(shards).join(shard_starts(shards), "shard_id").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(read(spark, sf_dir, "documents"), tokenizer_path())
