"""URL filter: explicit host rules, and logistic regression on hashed character n-grams of host and path.

``split_url`` gives host (A-Z lower-cased) and path; ``rule_for`` the longest rule that fits; ``UrlModel`` learns from a
small labelled table (``labelled`` is the query's, of invented URLs) and judges what no rule fits. The weights are a fixed table of ``2**BITS`` numbers, whatever the
size of the input, and rows are judged where they are: no shuffle, so a host that has a third of all rows costs nothing.

A null URL, or one without ``://``, has an empty host and path, fits no rule, and gets the model's verdict on empty
strings (allow: nothing speaks against it). Repeated rows stay; other columns are ignored by the query and kept by
``judged``; an empty table gives no rows; a very long URL is judged whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkvane.llm.common import arrow_bytes, read

#: Host, path and verdict. Fixed values of the query.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]

_PARTS = re.compile(r"(?s).*?://([^/?#]*)([^?#]*)").match
_LOWER = {i: i + 32 for i in range(65, 91)}

#: Words that the invented hosts and paths of the labelled table are made of.
BLOCK_WORDS = "casino poker slots betting jackpot lottery porn xxx adult cams escort nude sexy viagra cialis pills rx slim warez keygen crack torrent nulled serial hack phish payday loans forex replica".split()
ALLOW_WORDS = "news library museum university school garden recipe cooking travel history science nature music weather health sports city council journal review archive guide forum docs help research market books gallery maps".split()
BITS, SIZES = 14, (3, 4, 5)
#: The most rows of a labelled table; training holds them on the driver, some 200 numbers a row.
MOST_LABELLED = 100_000


def labelled() -> list[tuple[str, int]]:
    """The labelled table (url, label): 1 is a page to block. Words of one kind are paired by rule; names of plain
    syllables, which tell nothing, are allowed."""
    out = []
    for words, label in ((BLOCK_WORDS, 1), (ALLOW_WORDS, 0)):
        for i, word in enumerate(words):
            for k, step in enumerate((1, 4, 9, 13)):
                other, third = words[(i + step) % len(words)], words[(i + 2 * step + 3) % len(words)]
                host = (f"{word}-{other}.example", f"www.{word}{other}.example", f"{third}.{word}.example.org", f"{word}{i}.example.net")[k]
                out.append((f"https://{host}/" + (f"{third}/{i}", f"{other}-{third}.html", f"en/{17 * i + k}?page=2", f"{third}#top")[k], label))
    syllables = "ba ne ri to lu ka mi so de va".split()
    out += [(f"https://{'' if i % 2 else 'blog.'}{a}{b}{a}.example.{('com', 'net', 'org')[i % 3]}/{('en', 'de', 'fr', 'es')[j % 4]}/{31 * i + j}", 0) for i, a in enumerate(syllables) for j, b in enumerate(syllables[:6])]
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) after the first ``://``; empty where there is none."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.regexp_extract(F.coalesce(url, F.lit("")), pattern, 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), pattern, 2)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule is named by its host and path."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def grams(host: str, path: str) -> np.ndarray:
    """Places of the hashed n-grams; host and path have grams of their own."""
    out = set()
    for mark, text in ((b"h", host), (b"p", path)):
        raw = b"^" + text.encode() + b"$"
        out.update(zlib.crc32(mark + raw[i : i + n]) >> (32 - BITS) for n in SIZES for i in range(len(raw) - n + 1))
    return np.fromiter(out, np.int64, len(out))


def parts_of(url: str | None) -> tuple[str, str]:
    """``split_url`` of one value."""
    found = _PARTS((url or ""))
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class UrlModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def train(cls, table: list[tuple[str, int]], rounds: int = 400, rate: float = 2.0, ridge: float = 1e-3) -> UrlModel:
        """Gradient descent over the rows' grams, each row of length 1; grams are held sparsely."""
        rows = [grams(*parts_of(url)) for url, _ in table]
        sizes = np.array([len(g) for g in rows], np.int64)
        at, row = np.concatenate(rows) if rows else np.zeros(0, np.int64), np.repeat(np.arange(len(rows)), sizes)
        x = (1 / np.sqrt(np.maximum(1, sizes)))[row]
        y, w, b = np.array([label for _, label in table], float), np.zeros(1 << BITS), 0.0
        for _ in range(rounds if len(rows) else 0):
            off = 1 / (1 + np.exp(-(np.bincount(row, x * w[at], len(rows)) + b))) - y
            w -= rate * (np.bincount(at, x * off[row], 1 << BITS) / len(rows) + ridge * w)
            b -= rate * off.mean() * 0.1
        return cls(w.astype(np.float32), float(b))

    @classmethod
    def fitted(cls, table: DataFrame, most: int = MOST_LABELLED) -> UrlModel:
        """Trained on a labelled table (url, label) of at most ``most`` rows: of a larger one, those with the smallest hashes of the url."""
        known = table.select("url", F.col("label").cast("int").alias("label")).where(F.col("url").isNotNull() & F.col("label").isin(0, 1))
        rows = known.orderBy(F.xxhash64("url"), "url", "label").limit(most).collect()
        return cls.train([(r["url"], r["label"]) for r in rows])

    def score(self, host: str, path: str) -> float:
        """The probability that a page is to block; 0 for one without host and path."""
        if not host and not path:
            return 0.0
        g = grams(host, path)
        return float(1 / (1 + np.exp(-(self.weights[g].sum() / np.sqrt(max(1, len(g))) + self.bias))))


def judged(pages: DataFrame, model: UrlModel, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, url_score and verdict. Existing columns of these names are replaced."""
    arrow_bytes(pages.sparkSession)
    host, path = split_url(F.col("url"))
    new = ("host", "path", "rule", "verdict", "url_score")
    rows = pages.drop(*new).withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)

    def score(batches):
        for batch in batches:
            names = batch.schema.names
            given = batch.column(names.index("verdict")).to_pylist()
            both = list(zip(batch.column(names.index("host")).to_pylist(), batch.column(names.index("path")).to_pylist(), strict=True))
            scores = [model.score(*x) for x in both]
            final = [v or ("block" if s >= threshold else "allow") for v, s in zip(given, scores, strict=True)]
            batch = batch.set_column(names.index("verdict"), batch.schema.field("verdict"), pa.array(final, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "url_score"])

    return rows.mapInArrow(score, rows.withColumn("url_score", F.lit(0.0)).schema)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = UrlModel.fitted(spark.createDataFrame(labelled(), "url string, label int"))
    return judged(read(spark, sf_dir, "pages").select("page_id", "url"), model).select("page_id", "host", "path", "rule", "verdict")
