"""The corpus pipeline: five stages, each written as Parquet and read again as the documents of the next.

Low-quality documents go, then near copies (the document with the smallest doc_id of each group stays), then documents
that hold benchmark passages. Mixing repeats documents of small sources up to a repetition limit and drops none. The
last stage writes token shards and returns a row for each document read back from them.

``run`` has no SQL: the classifier, edit matching and the tokenizer are beyond it. It is tested against a brute-force
version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkvane.llm import decontaminate, jaccard, mixing, quality, wavelet
from inkvane.llm.common import delete, importable, new_path, read

MAX_REPEATS = 1.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return jaccard.without_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, max_repeats=MAX_REPEATS).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return wavelet.token_table(docs, wavelet.tokenizer_path())


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources", mix_sources),
    ("token output", write_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote goes once the next one is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for n, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{n}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
