"""Lookups by a key that a large share of the rows may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def heavy_keys(df: DataFrame, keys: list[str], most: int = 1024) -> DataFrame:
    """Keys held by at least 1/most of the rows, so at most ``most`` of them, by a partial aggregate."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    share = counts.agg(F.sum("_rows") / float(most)).scalar()
    return counts.where(F.col("_rows") >= share).select(*keys)


def lookup(left: DataFrame, right: DataFrame, keys: list[str], most: int = 1024) -> DataFrame:
    """left with the columns of right, which holds at most one row per key: a left join that no key of left can skew.

    Rows of heavy keys meet at most ``most`` broadcast rows and are never shuffled; the others are joined by shuffle.
    Rows with a null in a key match nothing. ``left`` is read three times: pass a stored table.
    """
    known = left.dropna(subset=keys)
    heavy = F.broadcast(heavy_keys(known, keys, most))
    hot = F.broadcast(right.join(heavy, keys, "left_semi"))
    none = F.lit(False)
    for k in keys:
        none = none | F.col(k).isNull()
    found = left.join(heavy, keys, "left_semi").join(hot, keys, "left")
    rest = known.join(heavy, keys, "left_anti").join(right, keys, "left")
    blank = left.where(none).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name not in keys])
    order = [*left.columns, *[c for c in right.columns if c not in keys]]
    return found.select(*order).unionByName(rest.select(*order)).unionByName(blank.select(*order))
