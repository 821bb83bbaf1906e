"""Numbers in a global order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, name: str, *order: str | Column, first: int = 0) -> DataFrame:
    """df with a column of consecutive numbers in the order given.

    Rows are range-partitioned and sorted; only a count for each partition meets in one place. Both uses of the sorted
    rows share one cached exchange: the cache goes with the session, or by ``spark.catalog.clearCache()``.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumns({"__part": F.spark_partition_id(), "__place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}).persist()
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("__part", before.alias("__before")))  # a row for each partition
    return rows.join(starts, "__part").withColumn(name, (F.col("__before") + F.col("__place") + first).cast("long")).drop("__part", "__place", "__before")
