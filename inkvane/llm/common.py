"""What the operators of this subpackage share: reading, the shared folder, and components of a graph."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package (on a cluster it is installed or sent with --py-files)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one only where that is unset
    and driver and executors are one machine's threads."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not where:
        where = sc.getCheckpointDir()
        if not where and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = where or tempfile.mkdtemp(prefix="inkvane-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a table of the shared folder and read again: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def arrow_bytes(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows (and where Spark knows the setting, the bytes) of one Arrow batch, so that long texts fit a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now > rows or now <= 0:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for edges (a, b) of longs; component: the smallest node that can be reached.

    Min-label propagation with pointer jumping; each round's labels are checkpointed. A node with very many edges
    (a hub) is aggregated map-side, and its join is left to adaptive skew handling. No edges: no rows.
    """
    both = edges.select("a", "b").where("a <> b")
    both = cut(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(rounds):
        seen = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(seen, "node").select("node", "component", F.least("component", "m").alias("near"))
        over = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        new = cut(step.join(over, "near").select("node", F.least("near", "far").alias("component"), (F.least("near", "far") < F.col("component")).alias("moved")))
        labels = new.select("node", "component")
        if new.where("moved").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("components did not settle")
    return labels
