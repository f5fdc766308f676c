"""Budgeted prefixes by a digest, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_within(rows: DataFrame, priority: str, size: str, budget: int) -> DataFrame:
    """Rows in the order of a hexadecimal digest, before the first whose running ``size`` exceeds ``budget``.

    Digests are cut into 4096 slices by their first three digits; slice totals fit one task, and
    rows are totalled within their slice.
    """
    cut = rows.withColumn("_slice", F.substring(priority, 1, 3))
    totals = cut.groupBy("_slice").agg(F.sum(size).alias("_n"))
    ahead = totals.select("_slice", F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    upto = F.sum(size).over(Window.partitionBy("_slice").orderBy(priority)) + F.col("_ahead")
    return cut.join(F.broadcast(ahead.where(F.col("_ahead") <= budget)), "_slice").withColumn("_upto", upto).where(F.col("_upto") <= budget).drop("_slice", "_ahead", "_upto")
