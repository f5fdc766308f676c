"""The table of queries and their SQL, and the decorator that fills it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ruleloom.plans.views import Views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of Views as a query, with the SQL that must give the same rows."""

    def add(fn: Callable[[Views], DataFrame]) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return add
