"""Folds, metrics and hold-out splits as columns and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratified_folds(rows: DataFrame, folds: int = 5) -> DataFrame:
    """rows with fold (0 .. folds - 1): consecutive parts of each label in the order of id, the first ones longer by one.

    No label is gathered in one task: its ids are cut at approximate quantiles, rows are numbered within each part, and
    the counts of the parts before are added. Only these counts, a row for each part, meet by label. ids are numbers.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = rows.groupBy("label").agg(F.percentile_approx("id", [k / parts for k in range(1, parts)] or [1.0], 10000).alias("__ends"))
    cut = rows.join(F.broadcast(ends.withColumnRenamed("label", "__label")), F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
    cut = cut.withColumn("__part", F.size(F.filter("__ends", lambda e: e < F.col("id")))).drop("__ends")
    own = Window.partitionBy("label")
    sizes = cut.groupBy("label", "__part").agg(F.count("*").alias("__m"))
    before = F.coalesce(F.sum("__m").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("label").alias("__label"), F.col("__part").alias("__of"), before.alias("__before"), F.sum("__m").over(own).alias("__n"))
    place = F.row_number().over(Window.partitionBy("label", "__part").orderBy("id")) - 1
    numbered = cut.withColumn("__place", place).join(F.broadcast(sizes), F.col("label").eqNullSafe(F.col("__label")) & (F.col("__part") == F.col("__of")))
    at, small, longer = F.col("__before") + F.col("__place"), F.floor(F.col("__n") / folds), F.col("__n") % folds
    in_longer = at < longer * (small + 1)
    fold = F.when(in_longer, F.floor(at / (small + 1))).otherwise(longer + F.floor((at - longer * (small + 1)) / F.greatest(small, F.lit(1))))
    return numbered.withColumn("fold", fold.cast("int")).drop("__label", "__of", "__part", "__before", "__n", "__place")


def compact(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """Cached rows in a partition for each core, or more where these would hold more than ``most`` rows.

    Models are fitted by hundreds of jobs over the rows. Each task sends its figures to the driver and costs more than few
    rows do: the number of tasks is not to be that of an exchange.
    """
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most)))


def hold_out(rows: DataFrame, share: float = 0.2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, held out) by a hash of id, so the split does not depend on partitions."""
    part = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < int(share * 1_000_000)
    return rows.where(~part), rows.where(part)


def accuracy(label: Column, prediction: Column) -> Column:
    return F.avg((label == prediction).cast("double"))


def confusion(rows: DataFrame) -> DataFrame:
    """(label, prediction, n)."""
    return rows.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def f1_weighted(rows: DataFrame) -> DataFrame:
    """One row, f1: the mean of F1 over the labels that occur, weighted by how often they do; 0 where F1 is undefined."""
    table = confusion(rows)
    ends = table.select(F.col("label").alias("c"), "n", F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("predicted"))
    ends = ends.union(table.select(F.col("prediction").alias("c"), F.lit(0).cast("long"), F.lit(0).cast("long"), "n"))
    per = ends.groupBy("c").agg(F.sum("n").alias("support"), F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return per.agg(F.coalesce(F.try_divide(F.sum(f1 * F.col("support")), F.sum("support")), F.lit(0.0)).alias("f1"))


def evaluated(rows: DataFrame, metric: str = "accuracy") -> float:
    """A metric of (label, prediction)."""
    if metric == "accuracy":
        return rows.agg(accuracy(F.col("label"), F.col("prediction"))).first()[0] or 0.0
    if metric == "f1_weighted":
        return f1_weighted(rows).first()[0]
    raise ValueError(f"no metric {metric!r}")
