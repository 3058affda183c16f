"""The catalogue of runnable queries: key -> (query on the given tables, check SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(key: str, check: str | None = None):
    def add(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if check is not None:
            CHECKS[key] = check
        return fn
    return add


def r6(c, digits: int = 6) -> Column:
    """Comparable double: both engines round to the same number of places."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({x: r6(x, digits).alias(x) for x in columns})
