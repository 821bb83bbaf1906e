"""Pairs of texts from the driver's tables (see FIXTURES.md), and the corpus that statistics are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, document, summary, label): labelled documents, the summary is the first line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("text").alias("document"), F.substring_index("text", "\n", 1).alias("summary"), F.col("quality").alias("label"))


def is_test() -> F.Column:
    return F.col("id") % 5 == 0


def train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = pairs(spark, sf_dir)
    return p.where(~is_test()), p.where(is_test())


def more_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, document) of documents without a label."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"))
    return docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")


def corpus(train: DataFrame, more: DataFrame | None) -> DataFrame:
    """What is fitted on: training documents and more documents; test documents never."""
    own = train.select("id", "document")
    return own if more is None else own.unionByName(more.select("id", "document"))


def fit_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the library's queries fit on: documents whose label is no test label, by one join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    rows = docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("text").alias("document"), "labelled")
    return rows.where(F.col("labelled").isNull() | ~is_test()).select("id", "document")


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, document, summary): a user's turn and the assistant's next."""
    after = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(after), "next_text": F.lead("text").over(after)})
    return rows.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("document"), F.col("next_text").alias("summary"))
