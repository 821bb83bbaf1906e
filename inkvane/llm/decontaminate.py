"""Benchmark decontamination: pigeonhole edit matching.

Texts are compared as lower-cased words (letters, digits, underscore) joined by one space. A test item of m characters
may differ by k = floor(m * error_rate) edits. It is split into k + 1 pieces; k edits cannot touch them all, so any
passage within k edits holds one piece unchanged. An automaton finds every exact piece in the whole text of every
document, each hit proposes where the item would begin, and Myers' bit-parallel distance over that stretch decides.

No shuffle: documents stream past the automaton. Items go to the workers in slices of at most ``slice_chars``
characters, each a broadcast of its own: the driver and a worker hold one slice at a time, however large the benchmark
is. ``leaks`` reads the texts once for each slice, ``without_leaks`` once; a benchmark of up to ``SLICE_CHARS``
characters, some 20,000 items, is one slice.

Null or empty texts match nothing; items without a word are skipped, and items too short for an
edit must stand as whole words; equal items are reported each under its own id;
an item within a document many times is one row, with its least distance and the first place that has it; repeated
doc_ids give a row for each of their rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkvane.llm.common import arrow_bytes, read

ERROR_RATE = 0.06
SLICE_CHARS = 4 << 20
_WORDS = re.compile(r"\w+").findall
SCHEMA = "doc_id long, item_id long, distance long, at long, item_chars long"


def normal(text: str | None) -> str:
    return " ".join(_WORDS((text or "").lower()))


def budget(m: int, rate: float = ERROR_RATE) -> int:
    return int(m * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """The item cut into k + 1 pieces of nearly equal length: (offset, piece)."""
    m = len(item)
    cuts = [j * m // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(bits: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to any stretch of text, and where the first such stretch ends; None above most."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = most + 1, -1
    for i, c in enumerate(text):
        eq = bits.get(c, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        hp = minus | (full & ~(d0 | plus))
        hm = plus & d0
        if hp & high:
            score += 1
        elif hm & high:
            score -= 1
        if score < best:
            best, end = score, i + 1
        hp, hm = hp << 1 & full, hm << 1 & full
        plus = hm | (full & ~(d0 | hp))
        minus = hp & d0
    return (best, end) if best <= most else None


class Matcher:
    """Finds items (item_id, text) in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        import ahocorasick

        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.rate = rate
        self.bits: dict[int, dict[str, int]] = {}
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t) in enumerate(self.items):
            for at, piece in pieces(t, budget(len(t), rate)):
                found.setdefault(piece, []).append((n, at))
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(number of the item, distance, place) for each item in a normalised text."""
        if not self.items or not text:
            return []
        begins: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, at in places:
                begins.setdefault(n, set()).add(end + 1 - size - at)
        out = []
        for n, starts in begins.items():
            item = self.items[n][1]
            m, k = len(item), budget(len(item), self.rate)
            exact = text.find(item) if k else f" {text} ".find(f" {item} ")
            if exact >= 0:
                out.append((n, 0, exact))
            if exact >= 0 or not k:
                continue
            bits, best = self.bits.get(n) or self.bits.setdefault(n, masks(item)), None
            stretches: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - k), min(len(text), s + m + k)
                if stretches and a <= stretches[-1][1]:
                    stretches[-1][1] = max(b, stretches[-1][1])
                else:
                    stretches.append([a, b])
            for a, b in stretches:
                got = myers(bits, m, text[a:b], k)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], max(0, a + got[1] - m))
            if best:
                out.append((n, *best))
        return out


def slices(benchmark: DataFrame, slice_chars: int = SLICE_CHARS):
    """The items in lists of about slice_chars characters; one list at a time is on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // slice_chars)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(((r[0], r[1]) for r in part.collect()), key=lambda x: (x[0] is None, x))


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """A row for each document and each test item that it holds within the budget."""
    arrow_bytes(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") > 0)
    parts = []
    for items in slices(benchmark):

        sent = docs.sparkSession.sparkContext.broadcast(items)  # at most SLICE_CHARS characters; kept on disk, not by the driver's Python
        del items

        def find(batches, sent=sent):
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                found = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    found += [(doc, matcher.items[n][0], d, at, len(matcher.items[n][1])) for n, d, at in matcher.hits(normal(text.as_py()))]
                names = ["doc_id", "item_id", "distance", "at", "item_chars"]
                yield pa.RecordBatch.from_pydict({c: [x[i] for x in found] for i, c in enumerate(names)}, schema=pa.schema([(c, pa.int64()) for c in names]))

        parts.append(rows.mapInArrow(find, SCHEMA))
    out = docs.sparkSession.createDataFrame([], SCHEMA) if not parts else parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """docs less every row whose text holds a test item; all columns stay. One pass over the texts."""
    spark = docs.sparkSession
    arrow_bytes(spark)
    for items in slices(benchmark):
        sent = spark.sparkContext.broadcast(items)
        del items

        def keep(batches, sent=sent):
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array([not matcher.hits(normal(t.as_py())) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
