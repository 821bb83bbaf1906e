"""Readers and writers: columnar JSON, CSV with an index column, vector files, submissions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_CSV = {"header": True, "multiLine": True, "escape": '"', "quote": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "nullValue": "\\N"}


def read_columns_json(spark: SparkSession, path: str, label: bool = True, summary: bool = True) -> DataFrame:
    """JSON of the layout {column: {id: value}} as rows (id, document[, summary][, label]); the columns are joined by their keys.

    The layout is one value a file, read by one task: write records or Parquet where files are large.
    """
    columns = ["document", *(["summary"] if summary else [])]
    schema = ", ".join(f"{c} map<string,string>" for c in columns) + (", label map<string,int>" if label else "")
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = raw.select(F.explode("document").alias("key", "document"))
    for c, wanted in (("summary", summary), ("label", label)):
        if wanted:
            rows = rows.join(raw.select(F.explode(c).alias("key", c)), "key", "left")
    return rows.select(F.col("key").cast("long").alias("id"), *[c for c in rows.columns if c != "key"])


def read_records_json(spark: SparkSession, path: str, schema: str = "id long, document string, summary string, label int") -> DataFrame:
    """JSON lines, or an array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).options(**_CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).options(**_CSV).csv(path)


def features(spark: SparkSession, folder: str, suffix: str, schema: StructType | str, label: str = "label") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, labels, test) of a written feature table; the label is dropped from test if it is there."""
    train = read_csv(spark, f"{folder}/train_{suffix}.csv", schema)
    test_schema = StructType([f for f in train.schema.fields if f.name != label])
    test = read_csv(spark, f"{folder}/test_{suffix}.csv", test_schema)
    return train.drop(label), train.select("id", label), test


def read_vectors(spark: SparkSession, path: str, dims: int = 300) -> DataFrame:
    """(token, vec) of a text file with a token and its numbers on each line. Lines of other lengths or with bad numbers are left out."""
    parts = F.split("value", " ")
    vec = F.transform(F.slice(parts, F.size(parts) - dims + 1, dims), lambda x: x.try_cast("float"))
    rows = spark.read.text(path).where(F.size(parts) > dims)
    rows = rows.select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - dims), " ").alias("token"), vec.alias("vec"))
    return rows.where(F.forall("vec", lambda x: x.isNotNull()))


def read_binary_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(token, vec) of word2vec binary files; .gz is opened as it is read. A file is one value of Spark's reader: 2 GB at most."""
    import gzip
    import io

    import numpy as np
    import pandas as pd

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                data = io.BytesIO(content)
                data = gzip.open(data) if name.endswith(".gz") else data
                n, dims = map(int, data.readline().split())
                out: list[tuple[str, list[float]]] = []
                held, at = b"", 0
                for _ in range(n):
                    while (space := held.find(b" ", at)) < 0 or len(held) < space + 1 + 4 * dims:
                        more = data.read(1 << 20)
                        if not more:
                            raise ValueError(f"{name} ends before its {n} vectors")
                        held, at = held[at:] + more, 0
                    vec = np.frombuffer(held, "<f4", dims, space + 1).tolist()
                    out.append((held[at:space].lstrip(b"\n").decode("utf-8", "replace"), vec))
                    at = space + 1 + 4 * dims
                    if len(out) == 5000:
                        yield pd.DataFrame(out, columns=["token", "vec"])
                        out = []
                yield pd.DataFrame(out, columns=["token", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "token string, vec array<float>")


def submission_name(score: float, metric: str = "accuracy", when: datetime | None = None) -> str:
    """submission<day-month-year_time>_cv_<first two letters of the metric>_<score to 3 places>."""
    return f"submission{(when or datetime.now()).strftime('%d-%m-%y_%H-%M-%S')}_cv_{metric[:2]}_{round(score, 3)}"


def write_submission(predictions: DataFrame, folder: str, score: float, metric: str = "accuracy") -> str:
    """A CSV of id and prediction (named ``0``), a folder of as many files as there are tasks: with one file, one task would
    do all the work since the last exchange, such as reading every text."""
    path = f"{folder}/{submission_name(score, metric)}.csv"
    write_csv(predictions.select("id", F.col("prediction").cast("int").alias("0")), path)
    return path
