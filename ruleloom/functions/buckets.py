"""Symbolic buckets of counts, shares, lags and times.

Each bucket is a list of (symbol, condition on x) with a last symbol for the rest.  The lists are fixed
values of the data model; ``column`` and ``sql`` render one list for either engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols and limits.
BUCKETS: dict[str, tuple[list[tuple[str, str]], str]] = {
    "format": ([("short", "{x} <= 7"), ("medium", "{x} <= 14")], "long"),
    "share": ([("none", "{x} <= 0"), ("low", "{x} < 0.10"), ("medium", "{x} < 0.30")], "high"),
    "history_size": ([("cold", "{x} = 0"), ("light", "{x} <= 5"), ("regular", "{x} <= 20")], "heavy"),
    "count_zero": ([("zero", "{x} <= 0"), ("one", "{x} = 1"), ("two", "{x} = 2")], "three_plus"),
    "count_few": ([("none", "{x} <= 0"), ("one", "{x} = 1"), ("few", "{x} <= 3")], "many"),
    "count_none": ([("none", "{x} <= 0"), ("one", "{x} = 1"), ("two", "{x} = 2")], "three_plus"),
    "lag_latest": ([("none", "{x} IS NULL"), ("latest", "{x} = 0"), ("recent", "{x} <= 4")], "old"),
    "lag_immediate": ([("none", "{x} IS NULL"), ("immediate", "{x} = 0"), ("recent", "{x} < 5")], "older"),
    "similarity": ([("unknown", "{x} IS NULL"), ("low", "{x} < 0.40"), ("medium", "{x} < 0.70")], "high"),
    "hour": ([("unknown", "{x} IS NULL OR {x} < 0 OR {x} > 23"), ("night", "{x} < 6"), ("morning", "{x} < 12"), ("afternoon", "{x} < 18")], "evening"),
    "position": ([("unknown", "{x} IS NULL OR {x} < 0"), ("top", "{x} < 2"), ("early", "{x} < 5"), ("middle", "{x} < 10")], "late"),
    "smoothed_ctr": ([("cold", "{x} IS NULL"), ("low", "{x} < 0.05"), ("medium", "{x} < 0.20")], "high"),
    "age": ([("new", "{x} IS NULL"), ("recent", "{x} <= 1000")], "established"),
    "overlap": ([("none", "{x} <= 0"), ("low", "{x} = 1")], "high"),
}


def sql(bucket: str, x: str) -> str:
    cases, rest = BUCKETS[bucket]
    return "CASE " + " ".join(f"WHEN {when.format(x=f'({x})')} THEN '{symbol}'" for symbol, when in cases) + f" ELSE '{rest}' END"


def column(bucket: str, x: str) -> Column:
    """The bucket of a Spark SQL expression."""
    return F.expr(sql(bucket, x))
