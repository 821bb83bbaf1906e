"""Row-local features over streams: the same columns as in batch, with nothing kept between rows.

What is fitted on a corpus comes in as frozen statistics (a Scaler), never refitted on the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkvane.operators.features import cleaned, regex_features, tag_features
from inkvane.operators.tabular import Scaler

SCHEMA = "id long, document string, summary string"


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def scored(pairs: DataFrame, regex: list[str] | None = None, tags: list[str] | None = None, scaler: Scaler | None = None) -> DataFrame:
    df = tag_features(regex_features(cleaned(pairs), regex), tags)
    return scaler.transform(df) if scaler else df


def write_stream(df: DataFrame, path: str, checkpoint: str, now: bool = True) -> StreamingQuery:
    """Append to Parquet; ``now`` handles what is there and ends."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if now else writer).start()
