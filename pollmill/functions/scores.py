"""Row-wise scores over answer columns.  All are plain Column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

# Shift and odd multiplier of each mixing round; products stay below 2^63.
_HASH_ROUNDS = [(16, 2146121005), (15, 830770091)]
_HIGH = 2246822519


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(cols) -> Column:
    """Array of the non-missing values, in column order."""
    return F.filter(F.array(*[_col(c).cast("double") for c in cols]), lambda v: v.isNotNull())


def flag(cond: Column) -> Column:
    """0/1 flag; an unknown condition counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def row_nansum(cols) -> Column:
    """Row sum ignoring missing values; all missing gives 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(_col(c).cast("double"), F.lit(0.0)) for c in cols])


def row_nanmean(cols) -> Column:
    """Row mean ignoring missing values; all missing gives missing."""
    n = reduce(lambda a, b: a + b, [_col(c).isNotNull().cast("int") for c in cols])
    return F.when(n > 0, row_nansum(cols) / n)


def max_same_run(cols) -> Column:
    """Longest run of equal neighbours; missing answers are dropped first, so runs bridge gaps."""
    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("cur"), F.lit(None).cast("double").alias("prev"))

    def step(acc, v):
        cur = F.when(v == acc["prev"], acc["cur"] + 1).otherwise(F.lit(1))
        return F.struct(F.greatest(acc["best"], cur).alias("best"), cur.alias("cur"), v.alias("prev"))

    return F.aggregate(present(cols), start, step, lambda acc: acc["best"])


def answer_runs(df: DataFrame, cols: list[str], id_col: str) -> DataFrame:
    """(id, v, first_pos, len): runs of equal neighbours in a row's answers, numbered by the digits of their column; missing answers are
    dropped first, so runs bridge gaps. A row is read as an array where it lies: no shuffle and no sort."""
    held = F.filter(F.array(*[F.struct(F.col(c).cast("double").alias("v"), F.lit(int(c[1:])).alias("pos")) for c in cols]), lambda x: x["v"].isNotNull())

    def starts(a):
        return F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i)["v"] != F.get(a, i - 1)["v"]))

    def run(s, i):
        first = F.get(F.col("_a"), s)
        return F.struct(first["v"].alias("v"), first["pos"].alias("first_pos"), (F.coalesce(F.get(F.col("_s"), i + 1), F.size("_a")) - s).cast("bigint").alias("len"))

    rows = df.select(id_col, held.alias("_a")).where(F.size("_a") > 0).withColumn("_s", starts(F.col("_a")))
    return rows.select(id_col, F.inline(F.transform("_s", run)))


def distinct_count(cols) -> Column:
    return F.size(F.array_distinct(present(cols)))


def extreme_share(cols, extremes=(1, 5)) -> Column:
    """Share of answers at the scale ends; 0 when nothing was answered."""
    n = reduce(lambda a, b: a + b, [_col(c).isNotNull().cast("int") for c in cols])
    hits = reduce(lambda a, b: a + b, [flag(_col(c).isin([float(e) for e in extremes])) for c in cols])
    return F.when(n > 0, hits / n).otherwise(F.lit(0.0))


def recode_binary_high(c, high=(1, 2), low=(3, 4, 5)) -> Column:
    v = _col(c)
    return F.when(v.isin([float(x) for x in high]), 1.0).when(v.isin([float(x) for x in low]), 0.0)


def reverse_score(c, top: int = 5) -> Column:
    return F.lit(float(top + 1)) - _col(c)


def codes_to_null(c, codes=(-3,)) -> Column:
    """Listed codes become missing."""
    v = _col(c)
    return F.when(~v.isin([float(x) for x in codes]), v)


def negatives_to_null(c) -> Column:
    v = _col(c)
    return F.when(v >= 0, v)


def visit_depth(stay, spend, cut: float = 3) -> Column:
    """1 when both codes reach the cut; a missing code gives 0."""
    return flag((_col(stay) >= cut) & (_col(spend) >= cut))


def at_least(c, cut: float = 3) -> Column:
    """Single-outcome variant of ``visit_depth``."""
    return flag(_col(c) >= cut)


def quadrant_label(x, y, x_cut, y_cut, labels: dict) -> Column:
    """Two cut-offs -> four labels, keyed by (x high, y high); missing input gives missing."""
    hx, hy = _col(x) >= x_cut, _col(y) >= y_cut
    return (F.when(hx & hy, labels[(True, True)]).when(~hx & hy, labels[(False, True)])
            .when(~hx & ~hy, labels[(False, False)]).when(hx & ~hy, labels[(True, False)]))


def sign_label(c, positive: str = "正向", negative: str = "负向", zero: str = "零") -> Column:
    v = _col(c)
    return F.when(v > 0, positive).when(v < 0, negative).otherwise(zero)


def portable_hash(id_col, seed) -> Column:
    """Seeded integer hash in [0, 2^32): the same in any engine and for any partitioning.

    The low 31 bits of the id enter with the seed, the others after the first round, so ids that agree in one seed don't agree in all.
    """
    mod = F.lit(4294967296)
    i = _col(id_col).cast("bigint")
    x = (i.bitwiseAND(F.lit(2147483647)) * F.lit(2654435761) + _as_col(seed) * F.lit(40503)) % mod
    high = (F.shiftrightunsigned(i, 31).bitwiseAND(F.lit(2147483647)) * F.lit(_HIGH) + F.shiftrightunsigned(i, 62)) % mod
    for (shift, factor), more in zip(_HASH_ROUNDS, (high, None)):
        x = (x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(factor)) % mod
        x = x if more is None else x.bitwiseXOR(more)
    return x.bitwiseXOR(F.shiftright(x, 16))


def _as_col(x) -> Column:
    return F.lit(x).cast("bigint") if isinstance(x, int) else _col(x).cast("bigint")


def portable_hash_array(ids: np.ndarray, seed: int) -> np.ndarray:
    """``portable_hash`` for a block of ids inside a task."""
    low = np.uint64(4294967295)
    i = ids.astype(np.int64).view(np.uint64)
    x = i & np.uint64(2147483647)
    x *= np.uint64(2654435761)
    x += np.uint64(seed * 40503)
    x &= low
    high = i >> np.uint64(31)
    for n, (shift, factor) in enumerate(_HASH_ROUNDS):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
        x &= low
        if n == 0 and high.any():
            x ^= ((high & np.uint64(2147483647)) * np.uint64(_HIGH) + (i >> np.uint64(62))) & low
    x ^= x >> np.uint64(16)
    return x


def pass_threshold(value, op, threshold) -> Column:
    """value < threshold for op 'lt', value > threshold otherwise."""
    return F.when(_col(op) == "lt", _col(value) < _col(threshold)).otherwise(_col(value) > _col(threshold))
