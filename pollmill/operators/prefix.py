"""Row numbers and running sums over any number of rows, in two phases and without a window over all of them.

Rows are cut into sorted ranges (`repartitionByRange`), a range adds up its own rows, and one row per range gives the
offset of the ranges after it. Range sizes come from Spark's sampling, so there is no size from which another plan runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.scratch import cut


def unused(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _offsets(totals: DataFrame, by: list[str], part: str, names: dict[str, str]) -> DataFrame:
    """The sums of the ranges before each: a row per range and group that it touches."""
    before = W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(*by, part, *[F.coalesce(F.sum(t).over(before), F.lit(0)).alias(out) for t, out in names.items()])


def row_numbers(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Adds out = 1, 2, 3 ... in the given order. Rows that are equal in all order columns stay in one range: end the
    order with a column that sets repeated rows apart when a share of all rows may be equal."""
    at, part, before = unused(df, "_at"), unused(df, "_part"), unused(df, "_before")
    # the id counts the rows of its task, which is one sorted range
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
               .withColumn(part, F.shiftright(at, 33)))
    totals = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(totals, [], part, {"_n": before})
    number = F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    # a row per task of one shuffle
    return rows.join(F.broadcast(offsets), part).select(*df.columns, number.cast("long").alias(out))


def running_sums(df: DataFrame, order: list[str], totals: list[str], by=(), descending: bool = False) -> DataFrame:
    """Adds ``<total>_before``: each total summed over the rows before, within the group.

    Rows of one group that are equal in ``order`` stay in one range and take any order among themselves.
    """
    by = list(by)
    part = unused(df, "_part")
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    placed = cut(df.repartitionByRange(*by, *keys).withColumn(part, F.spark_partition_id()))
    sums = placed.groupBy(*by, part).agg(*[F.sum(t).alias(t) for t in totals])
    earlier = {t: unused(df, f"_{t}_earlier") for t in totals}
    # only the first group of a range can have begun in a range before: at most one row per range is left
    offsets = _offsets(sums, by, part, earlier).where(" OR ".join(f"`{e}` <> 0" for e in earlier.values()))
    # a range is one group's rows of one task, so this window is never larger than a sorted range
    inside = W.partitionBy(part, *by).orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    own = placed.withColumns({f"{t}_before": F.coalesce(F.sum(t).over(inside), F.lit(0)) for t in totals})
    names = {c: unused(own, f"_{c}_of") for c in [part, *by]}
    same = F.lit(True)
    for c, name in names.items():
        same = same & F.col(c).eqNullSafe(F.col(name))
    both = own.join(F.broadcast(offsets.withColumnsRenamed(names)), same, "left")
    return both.select(*df.columns, *[(F.col(f"{t}_before") + F.coalesce(F.col(earlier[t]), F.lit(0))).alias(f"{t}_before") for t in totals])


def numbered(df: DataFrame, by: list[str], order: list[str], out: str = "row_no", descending: bool = False) -> DataFrame:
    """Exact row number within the group, whatever share of the rows a group holds."""
    one = unused(df, "_one")
    rows = running_sums(df.withColumn(one, F.lit(1).cast("long")), order, [one], by, descending)
    return rows.select(*df.columns, (F.col(f"{one}_before") + 1).cast("bigint").alias(out))
