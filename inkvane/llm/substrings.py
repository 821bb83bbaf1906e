"""Substring dedup: a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words of one document; words are runs of bytes other than ASCII white space. A word
goes if it lies in a window whose words also start in a document with a smaller doc_id.

``SubstringIndex`` holds what earlier batches had: immutable runs of fingerprints in ascending order, cut into buckets by
their leading bits, one level for each batch. ``feed`` takes a batch:

1. Its documents are dealt into chunks. A chunk writes one run of its windows: distinct 64-bit fingerprints, each with a
   second, independent fingerprint of ``CHECK_BITS`` bits and the chunk's smallest doc_id that has it, cut by bucket and
   packed (differences, byte planes, zstandard). A chunk has a row for each bucket that it meets, so there are never
   more rows than windows, and an exact copy or a very common passage is one entry a chunk: hot windows neither skew
   nor multiply rows.
2. Each bucket merge-joins the new runs with each other and with the levels. Equal fingerprints are verified by the
   second one. Levels are stored as a table bucketed by ``bucket``: a single level meets the batch without a shuffle.
3. Every new run gets back one bit for each of its entries: whether a smaller document elsewhere has that window. What
   the history lacks becomes the next level.
4. The chunk joins the bits with its own windows and removes words.

``compact`` merges all levels into one, splits buckets that have grown beyond ``MOST_WINDOWS``, and deletes the old
levels. A manifest in the folder names the levels, so an index is opened again from its folder.

``deduplicated`` feeds a table through an index in ``BATCHES`` batches in the order of doc_id: the result is that of one
batch. Batches in another order judge each document against what was fed before it.

Null text: no words. Null doc_ids count as larger than any other and, among themselves, as one document. Documents of
fewer than ``WINDOW`` words lose nothing. Rows with the same doc_id are one document for the rule: they do not
remove each other's words, and each is reported. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkvane.llm.common import arrow_bytes, delete, new_path, read, written
from inkvane.llm.hashing import BASES, rolled, word_hashes

WINDOW = 13
CHUNK_BYTES = 8 << 20
#: Windows that a new index expects of a bucket, and of a bucket's history before compaction splits it.
BUCKET_WINDOWS, MOST_WINDOWS = 1_500_000, 6_000_000
CHECK_BITS = 24
BATCHES = 2
LAST_DOC = np.iinfo(np.int64).max
RUN_SCHEMA = "bucket long, chunk long, n long, data binary"
OUT_SCHEMA = RUN_SCHEMA + ", level boolean"
_RUN = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
_OUT = _RUN.append(pa.field("level", pa.bool_()))


def fingerprints(words: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two independent fingerprints of each window, by place of its first word: 64 and CHECK_BITS bits."""
    return rolled(words[:, 0], window, BASES[0]), (rolled(words[:, 1], window, BASES[1]) >> np.uint64(64 - CHECK_BITS)).astype(np.uint32)


def _planes(values: np.ndarray, planes: int) -> bytes:
    """The lowest bytes of each value, plane by plane."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1)[:, :planes].T).tobytes()


def _from_planes(raw: bytes, kind, n: int) -> np.ndarray:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    planes = np.frombuffer(raw, np.uint8).reshape(-1, n)
    out[:, : len(planes)] = planes.T
    return out.view(kind).ravel()


def pack(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray) -> bytes:
    """A sorted run as bytes."""
    return zstandard.ZstdCompressor(level=1).compress(_planes(np.diff(keys, prepend=np.uint64(0)), 8) + _planes(checks, CHECK_BITS // 8) + _planes(docs, 8))


def unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw, at = memoryview(zstandard.ZstdDecompressor().decompress(data)), (8 + CHECK_BITS // 8) * n
    return np.cumsum(_from_planes(raw[: 8 * n], np.uint64, n)), _from_planes(raw[8 * n : at], np.uint32, n), _from_planes(raw[at:], np.int64, n)


def groups_of(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where groups of equal fingerprints begin in it)."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], checks[order]
    if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order, new


class ChunkWindows:
    """The windows of some documents: distinct (fingerprint, check) in ascending order, and where each occurs."""

    def __init__(self, docs: np.ndarray, texts: list[bytes], window: int):
        self.docs, self.window = docs, window
        both = [fingerprints(word_hashes(t), window) for t in texts]
        self.counts = np.array([len(k) for k, _ in both], np.int64)
        keys = np.concatenate([k for k, _ in both]) if both else np.zeros(0, np.uint64)
        checks = np.concatenate([c for _, c in both]) if both else np.zeros(0, np.uint32)
        self.owner = np.repeat(docs, self.counts)
        order, new = groups_of(keys, checks)
        first = np.flatnonzero(new)
        self.run_keys, self.run_checks = keys[order[first]], checks[order[first]]
        self.run_docs = np.minimum.reduceat(self.owner[order], first) if len(first) else np.zeros(0, np.int64)
        self.entry = np.empty(len(keys), np.int64)  # of each window, its entry in the run
        self.entry[order] = np.cumsum(new) - 1


def cuts(keys: np.ndarray, bits: int):
    """(bucket, begin, end) for each bucket that occurs in a sorted run."""
    if not len(keys):
        return []
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    return zip(bucket[first].tolist(), first.tolist(), np.append(first[1:], len(keys)).tolist(), strict=True)


def _chunk(table: pa.Table, window: int) -> tuple[ChunkWindows, list[bytes]]:
    docs = np.array([LAST_DOC if d is None else d for d in table.column("doc_id").to_pylist()], np.int64)
    texts = [t.as_py() or b"" for t in table.column("text")]
    return ChunkWindows(docs, texts, window), texts


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(schema.names)}, schema=schema)


def _runs(*tables: pa.Table | None) -> tuple[list[int], list[int], list[tuple]]:
    """Chunks, sizes and contents of the runs of some tables."""
    chunks, sizes, data = [], [], []
    for t in tables:
        if t is not None:
            chunks += t.column("chunk").to_pylist()
            sizes += t.column("n").to_pylist()
            data += [unpack(d.as_py(), n) for d, n in zip(t.column("data"), t.column("n").to_pylist(), strict=True)]
    return chunks, sizes, data


def merge_join(bucket: int, new: pa.Table, old: pa.Table | None, keep: bool) -> pa.Table:
    """Answers for the new runs of a bucket; with keep, also what the history lacks, as a run of the next level."""
    chunks, sizes, data = _runs(new, old)
    if not data:
        return _rows(_OUT, [])
    keys, checks, docs = (np.concatenate([d[i] for d in data]) for i in range(3))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    order, begins = groups_of(keys, checks)
    first = np.flatnonzero(begins)
    lengths = np.diff(np.append(first, len(order)))
    told = np.empty(len(docs), bool)
    told[order] = docs[order] > np.repeat(np.minimum.reduceat(docs[order], first), lengths)
    out = []
    for chunk, a, b in zip(chunks, starts.tolist(), ends.tolist(), strict=True):
        if chunk >= 0 and told[a:b].any():
            out.append((bucket, chunk, b - a, zstandard.compress(np.packbits(told[a:b]).tobytes(), 1), False))
    if keep:
        fresh = np.repeat(np.array(chunks) >= 0, sizes)[order]
        mine = np.minimum.reduceat(np.where(fresh, docs[order], LAST_DOC), first)
        theirs = np.minimum.reduceat(np.where(fresh, LAST_DOC, docs[order]), first)
        use = first[mine < theirs]
        if len(use):
            out.append((bucket, -1, len(use), pack(keys[order[use]], checks[order[use]], mine[mine < theirs]), True))
    return _rows(_OUT, out)


def covered(flags: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Words that lie in a flagged window."""
    edge = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(flags)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


def dealt(docs: DataFrame, size: int) -> DataFrame:
    """(chunk, doc_id, text as bytes) of documents with so many bytes of text. Rows of one doc_id, or of none, are dealt by their text."""
    text = F.col("text").cast("binary")
    chunk = F.pmod(F.xxhash64("doc_id", text), F.lit(max(1, -(-size // CHUNK_BYTES)))).cast("long")
    return docs.select(chunk.alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def runs_of(rows: DataFrame, bits: int, window: int) -> DataFrame:
    """Every chunk's sorted run, cut by bucket."""

    def build(key, table):
        chunk, (w, _) = key[0].as_py(), _chunk(table, window)
        return _rows(_RUN, [(b, chunk, hi - lo, pack(w.run_keys[lo:hi], w.run_checks[lo:hi], w.run_docs[lo:hi])) for b, lo, hi in cuts(w.run_keys, bits)])

    return rows.groupBy("chunk").applyInArrow(build, RUN_SCHEMA)


def applied(rows: DataFrame, told: DataFrame, bits: int, window: int, keep_text: bool) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept) of every row, by the answers to its chunk's run."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text

    def apply(left, right):
        w, texts = _chunk(left, window)
        place = {b: (lo, hi) for b, lo, hi in cuts(w.run_keys, bits)}
        told = np.zeros(len(w.run_keys), bool)
        for b, n, d in zip(right.column("bucket").to_pylist(), right.column("n").to_pylist(), right.column("data"), strict=True):
            lo, hi = place.get(b, (0, 0))
            if hi - lo != n:
                raise RuntimeError("a chunk changed between its two readings")
            told[lo:hi] = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(d.as_py()), np.uint8), count=n)
        flags = told[w.entry] | (w.owner > w.run_docs[w.entry]) if len(w.entry) else np.zeros(0, bool)
        n_words, n_removed, digests, texts_kept, at = [], [], [], [], 0
        for i, text in enumerate(texts):
            own = flags[at : at + w.counts[i]]
            at += w.counts[i]
            words = text.split()
            n = len(words)
            if own.any():
                gone = covered(own, n, window)
                words = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
            joined = b" ".join(words)
            n_words.append(n)
            n_removed.append(n - len(words))
            digests.append(hashlib.sha256(joined).hexdigest())
            if keep_text:
                texts_kept.append(joined.decode("utf-8", "replace"))
        cols = {"doc_id": left.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(cols | ({"kept": pa.array(texts_kept, pa.string())} if keep_text else {}))

    return rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(apply, schema)


class SubstringIndex:
    """The runs of earlier batches in a folder. ``bits``: of a fingerprint that name its bucket; ``parts``: files that
    buckets are dealt into, each read by one task."""

    def __init__(self, spark: SparkSession, path: str, bits: int = 0, parts: int = 1, window: int = WINDOW, levels: list[str] | None = None, version: int = 0):
        self.spark, self.path, self.bits, self.parts, self.window = spark, path.rstrip("/"), bits, parts, window
        self.levels, self.version, self.tables = list(levels or []), version, {}

    @classmethod
    def made(cls, spark: SparkSession, path: str, windows: int, window: int = WINDOW) -> SubstringIndex:
        """A new index for about so many windows; it takes more."""
        bits = max(0, (-(-windows // BUCKET_WINDOWS) - 1).bit_length())
        index = cls(spark, path, bits, int(spark.conf.get("spark.sql.shuffle.partitions")), window)
        index._noted()
        return index

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> SubstringIndex:
        """The index of a folder, as its newest manifest has it."""
        m = spark.read.parquet(f"{path.rstrip('/')}/manifest").orderBy(F.desc("version")).first()
        return cls(spark, path, m["bits"], m["parts"], m["window"], list(m["levels"]), m["version"])

    def _noted(self) -> None:
        """Writes a manifest; it counts once Spark has committed it."""
        self.version += 1
        row = [(self.version, self.bits, self.parts, self.window, self.levels)]
        self.spark.createDataFrame(row, "version int, bits int, parts int, window int, levels array<string>").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _added(self, out: DataFrame) -> str:
        """Writes rows of OUT_SCHEMA as a table bucketed by ``bucket``."""
        name = f"level-{uuid.uuid4().hex}"
        out.write.partitionBy("level").bucketBy(self.parts, "bucket").option("path", f"{self.path}/{name}").option("compression", "none").format("parquet").saveAsTable(self._table_name(name))
        self.tables[name] = True
        return name

    @staticmethod
    def _table_name(level: str) -> str:
        return "inkvane_" + level.replace("-", "_")

    def _table(self, level: str) -> DataFrame:
        name = self._table_name(level)
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (bucket BIGINT, chunk BIGINT, n BIGINT, data BINARY, level BOOLEAN) USING parquet PARTITIONED BY (level) CLUSTERED BY (bucket) INTO {self.parts} BUCKETS LOCATION '{self.path}/{level}'")
            self.spark.sql(f"MSCK REPAIR TABLE {name}")
        return self.spark.table(name)

    def history(self) -> DataFrame | None:
        """Runs (bucket, chunk, n, data) of all levels."""
        out = None
        for level in self.levels:
            runs = self._table(level).where("level").select("bucket", "chunk", "n", "data")
            out = runs if out is None else out.union(runs)
        return out

    def feed(self, docs: DataFrame, keep: bool = True, keep_text: bool = True, size: int | None = None) -> DataFrame:
        """The documents less the words that this batch or an earlier one has in smaller documents; with keep, the batch joins the index."""
        arrow_bytes(self.spark)
        bits, window = self.bits, self.window
        rows = dealt(docs, text_bytes(docs) if size is None else size)
        runs, old = runs_of(rows, bits, window).groupBy("bucket"), self.history()
        if old is None:
            out = runs.applyInArrow(lambda key, new: merge_join(key[0].as_py(), new, None, keep), OUT_SCHEMA)
        else:
            out = runs.cogroup(old.groupBy("bucket")).applyInArrow(lambda key, new, old: merge_join(key[0].as_py(), new, old, keep), OUT_SCHEMA)
        if keep:
            level = self._added(out)
            self.levels.append(level)
            self._noted()
            out = self._table(level).where("not level")
        return applied(rows, out.select("bucket", "chunk", "n", "data"), bits, window, keep_text)

    def compact(self, most: int = MOST_WINDOWS) -> None:
        """All levels become one; buckets are split so that none holds more than about ``most`` windows. Old levels are deleted."""
        if not self.levels:
            return
        runs, before = self.history(), self.levels
        largest = runs.groupBy("bucket").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        self.bits = bits = min(62, self.bits + max(0, (-(-largest // most) - 1).bit_length()))

        def merge(key, table):
            _, _, data = _runs(table)
            keys, checks, docs = (np.concatenate([d[i] for d in data]) for i in range(3))
            order, begins = groups_of(keys, checks)
            first = np.flatnonzero(begins)
            keys, checks, docs = keys[order[first]], checks[order[first]], np.minimum.reduceat(docs[order], first)
            return _rows(_OUT, [(b, -1, hi - lo, pack(keys[lo:hi], checks[lo:hi], docs[lo:hi]), True) for b, lo, hi in cuts(keys, bits)])

        self.levels = [self._added(runs.groupBy("bucket").applyInArrow(merge, OUT_SCHEMA))]
        self._noted()
        for level in before:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table_name(level)}")
            delete(self.spark, f"{self.path}/{level}")


def removed(docs: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the kept text of every document, judged in one batch without a history."""
    size = text_bytes(docs)
    return SubstringIndex.made(docs.sparkSession, new_path(docs.sparkSession, "substrings"), size // 6, window).feed(docs, False, keep_text, size)


def deduplicated(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, keep_text: bool = True, path: str | None = None) -> DataFrame:
    """As ``removed``, but through an index: batches in the order of doc_id, each merge-joined with the runs of those before."""
    spark = docs.sparkSession
    ends = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(1, batches)], 10000)).first()[0] if batches > 1 else None
    ends = sorted(set(ends or []))
    doc = F.col("doc_id").cast("long")
    parts = [*((doc <= b) if a is None else (doc > a) & (doc <= b) for a, b in zip([None, *ends], ends, strict=False)), (doc > ends[-1]) | doc.isNull() if ends else F.lit(True)]
    sizes = docs.agg(*[F.sum(F.when(p, F.octet_length(F.col("text").cast("string")))) for p in parts]).first()
    index = SubstringIndex.made(spark, path or new_path(spark, "substrings"), sum(n or 0 for n in sizes) // 6, window)
    out = None
    for k, (part, size) in enumerate(zip(parts, sizes, strict=True)):
        last = k == len(ends)
        got = index.feed(docs.where(part), not last, keep_text, size or 0)
        if not last:
            got = written(got, "deduplicated")
            gc.collect()
            spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop the finished batch's shuffle files
        out = got if out is None else out.union(got)
    return out


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents"), keep_text=False)
