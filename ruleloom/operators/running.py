"""Running totals and orders in two levels, so that no task sorts all rows of a hot key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleloom.session import stored

#: Slices into which the distinct values of a key are dealt for an order over them.
SLICES = 64


def before(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """``rows`` (with ts and impression) and the sum of each value over the earlier rows of the same keys.

    Days are summed first; only the rows of one key and day are sorted together.
    """
    rows = rows.select("*", F.to_date("ts").alias("_day"), *(c.alias(f"_{n}") for n, c in values.items()))
    days = rows.groupBy(*keys, "_day").agg(*(F.sum(f"_{n}").alias(f"_{n}_day") for n in values))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    by_day, in_day = earlier(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_day")), earlier(Window.partitionBy(*keys, "_day").orderBy("ts", "impression"))
    days = days.select(*keys, "_day", *(F.coalesce(F.sum(f"_{n}_day").over(by_day), F.lit(0)).alias(f"_{n}_ahead") for n in values))
    rows = rows.withColumns({f"_{n}_within": F.coalesce(F.sum(f"_{n}").over(in_day), F.lit(0)) for n in values})
    kept = [c for c in rows.columns if not c.startswith("_")]
    return rows.join(days, [*keys, "_day"]).select(*kept, *((F.col(f"_{n}_ahead") + F.col(f"_{n}_within")).alias(n) for n in values))


def ordered(d: DataFrame, keys: list[str], slices: int = SLICES) -> DataFrame:
    """Distinct values of each key (keys, value, weight) with cum (the weight up to the value), next (value), i (place) and total.

    Approximate quantiles deal the values into slices, one task sorts a slice, and the slices' totals are summed.
    The quantiles depend on the order in which their sketches are merged, so they are stored: rows and totals are dealt by the same ones.
    """
    same = lambda other, on: reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(other[f"_{k}"]) for k in on), F.lit(True))
    shares = F.array(*(F.lit(k / slices) for k in range(1, slices)))
    marked = [F.col(k).alias(f"_{k}") for k in keys]
    borders = stored(d.groupBy(*marked).agg(F.percentile_approx("value", shares, F.lit(1000)).alias("_borders"), F.sum("weight").alias("total")))
    rows = d.join(F.broadcast(borders), same(borders, keys)).drop(*(f"_{k}" for k in keys))
    rows = rows.withColumn("_slice", F.size(F.filter("_borders", lambda b: b < F.col("value")))).drop("_borders")
    per = rows.groupBy(*keys, "_slice").agg(F.sum("weight").alias("_w"), F.count("*").alias("_n"), F.min("value").alias("_lo"))
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_slice")
    ahead = lambda c: F.coalesce(F.sum(c).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*marked, F.col("_slice").alias("__slice"), ahead("_w").alias("_ahead"), ahead("_n").alias("_before"), F.lead("_lo").over(over).alias("_following"))
    within = Window.partitionBy(*keys, "_slice").orderBy("value")
    rows = rows.select("*", F.sum("weight").over(within.rowsBetween(Window.unboundedPreceding, 0)).alias("_cum"), F.lead("value").over(within).alias("_next"), F.row_number().over(within).alias("_i"))
    rows = rows.join(per, same(per, [*keys, "_slice"]))
    return rows.select(*keys, "value", "weight", "total", (F.col("_ahead") + F.col("_cum")).alias("cum"), F.coalesce("_next", "_following").alias("next"), (F.col("_before") + F.col("_i")).alias("i"))
