"""Density of a feature by label, for a chart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def densities(df: DataFrame, feature: str, points: int = 100, label: str = "label") -> DataFrame:
    """(label, x, density): Gaussian kernel estimates over a grid, bandwidth by Silverman's rule.

    Values are first counted in 20 bins per point of the grid, so the work does not grow with rows times points.
    """
    rows = df.select(F.col(label).alias("label"), F.col(f"`{feature}`").cast("double").alias("v")).where("v is not null")
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return rows.select("label", F.col("v").alias("x"), F.col("v").alias("density"))
    step = (high - low) / (20 * points) or 1.0
    per = rows.groupBy("label").agg(F.count("*").alias("n"), F.stddev_pop("v").alias("sd")).withColumn("h", F.greatest(1.06 * F.col("sd") * F.pow("n", F.lit(-0.2)), F.lit(step)))
    bins = rows.groupBy("label", F.floor((F.col("v") - low) / step).alias("bin")).agg(F.count("*").alias("c")).join(F.broadcast(per), "label")
    grid = F.explode(F.array(*[F.lit(low + (high - low) * i / max(1, points - 1)) for i in range(points)]))
    z = (F.col("x") - (low + (F.col("bin") + 0.5) * step)) / F.col("h")
    return bins.withColumn("x", grid).groupBy("label", "x").agg(F.sum(F.col("c") * F.exp(-z * z / 2) / (F.col("n") * F.col("h") * 2.5066282746310002)).alias("density"))


def plot(df: DataFrame, feature: str, folder: str | None = None):
    """The chart of ``densities``; needs matplotlib. Saved as <folder>/<feature>_repart.png if a folder is given."""
    import matplotlib.pyplot as plt

    table = densities(df, feature).toPandas().sort_values("x")
    figure, axes = plt.subplots()
    for value, part in table.groupby("label"):
        axes.plot(part["x"], part["density"], label=str(value))
    axes.set(xlabel=feature, ylabel="density")
    axes.legend()
    if folder:
        figure.savefig(f"{folder}/{feature}_repart.png")
    return figure
