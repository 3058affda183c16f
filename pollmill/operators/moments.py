"""Cross-product moments and what follows from them: alpha, correlations, KMO, VIF.

Rows are reduced to p x p sums inside tasks; only those sums leave the executors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.pvalues import chi2_tail
from .partials import add_up, batches_of


def block_matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in columns])


def cronbach_alpha(df: DataFrame, blocks: dict[str, list[str]]) -> DataFrame:
    """(block, alpha, n_complete) for all blocks from one aggregate over the rows.

    Each block uses its own complete cases; NULL under 2 items, 3 rows or no variance.
    """
    aggs = []
    for b, (_, items) in enumerate(blocks.items()):
        total = sum((F.col(x).cast("double") for x in items[1:]), F.col(items[0]).cast("double"))
        aggs += [F.var_samp(F.when(total.isNotNull(), F.col(x).cast("double"))).alias(f"v{b}_{i}") for i, x in enumerate(items)]
        aggs += [F.var_samp(total).alias(f"t{b}"), F.count(total).alias(f"n{b}")]
    row = df.agg(*aggs)
    out = []
    for b, (name, items) in enumerate(blocks.items()):
        k = float(len(items))
        var_sum = sum((F.col(f"v{b}_{i}") for i in range(1, len(items))), F.col(f"v{b}_0"))
        alpha = F.when((F.col(f"n{b}") >= 3) & (F.col(f"t{b}") > 1e-12) & F.lit(k >= 2),
                       F.lit(k / max(k - 1.0, 1.0)) * (F.lit(1.0) - var_sum / F.col(f"t{b}")))
        out.append(F.struct(F.lit(name).alias("block"), alpha.alias("alpha"), F.col(f"n{b}").alias("n_complete")))
    return row.select(F.inline(F.array(*out)))


def _partials(columns: list[str], by: list[str]):
    """Per task and group: n, sums and cross products of the complete rows."""
    p = len(columns)
    iu = np.triu_indices(p)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple, list] = {}
        for batch in batches:
            x = block_matrix(batch, columns)
            keys = list(zip(*[batch.column(batch.schema.get_field_index(k)).to_pylist() for k in by])) if by else None
            ok = ~np.isnan(x).any(axis=1)
            groups: dict[tuple, np.ndarray] = {(): ok}
            if keys is not None:
                codes: dict[tuple, int] = {}
                idx = np.array([codes.setdefault(k, len(codes)) for k in keys])
                groups = {k: ok & (idx == g) for k, g in codes.items()}
            for k, m in groups.items():
                z = x[m]
                if len(z):
                    s = acc.setdefault(k, [0, np.zeros(p), np.zeros(len(iu[0]))])
                    s[0] += len(z)
                    s[1] += z.sum(axis=0)
                    s[2] += (z.T @ z)[iu]
        yield from batches_of(list(acc), [v[0] for v in acc.values()], [np.concatenate(v[1:]) for v in acc.values()], by, [pa.string()] * len(by))

    return reduce


def cross_moments(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """(by, n, s, q): count, sums and upper-triangle cross products of the complete rows.

    Meant for codes, scores and standardised features, whose products lose no precision.
    """
    by = list(by)
    p = len(columns)
    typed = df.select(*[F.col(k).cast("string").alias(k) for k in by], *[F.col(x).cast("double").alias(x) for x in columns])
    schema = ", ".join([f"`{k}` string" for k in by] + ["n bigint", "s array<double>"])
    return moment_rows(add_up(typed.mapInArrow(_partials(list(columns), by), schema), by), by, p)


def moment_rows(sums: DataFrame, by: list[str], p: int) -> DataFrame:
    """The summed array split into the p sums and the products."""
    return sums.select(*by, "n", F.slice("s", 1, p).alias("s"), F.slice("s", p + 1, p * (p + 1) // 2).alias("q"))


def covariance_of(n: int, s, q, ddof: int = 1) -> np.ndarray:
    """p x p covariance matrix from summed moments."""
    s = np.asarray(s, float)
    p = len(s)
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = q
    m = m + np.triu(m, 1).T
    return (m - np.outer(s, s) / n) / (n - ddof)


def correlation_of(cov: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.clip(np.diag(cov), 0, None))
    with np.errstate(all="ignore"):
        r = cov / np.outer(d, d)
    return np.where(np.isfinite(r), r, 0.0)


def _moment_row(df: DataFrame, columns: list[str]):
    return cross_moments(df, columns).first()


def covariance_table(df: DataFrame, columns: list[str], by: list[str] = (), ddof: int = 1) -> DataFrame:
    """(by, n, var1, var2, cov, corr) for every pair, computed from the moment rows in the engine."""
    rows, cols = (x.tolist() for x in np.triu_indices(len(columns)))
    m = cross_moments(df, columns, by)
    n = F.col("n").cast("double")
    # one expression over the positions: a term per pair would make the plan grow with the square of the columns
    first, second, names = F.lit(rows), F.lit(cols), F.lit(list(columns))
    diagonal = F.lit([k for k, (i, j) in enumerate(zip(rows, cols)) if i == j])

    def cov(k, i, j):
        return (F.get("q", k) - F.get("s", i) * F.get("s", j) / n) / (n - float(ddof))

    def cell(k):
        i, j = F.get(first, k), F.get(second, k)
        spread = F.sqrt(cov(F.get(diagonal, i), i, i) * cov(F.get(diagonal, j), j, j))
        return F.struct(F.get(names, i).alias("var1"), F.get(names, j).alias("var2"), cov(k, i, j).alias("cov"), F.nullif(spread, F.lit(0.0)).alias("_d"))

    cells = F.transform(F.sequence(F.lit(0), F.lit(len(rows) - 1)), cell)
    return m.select(*by, "n", F.inline(cells)).withColumn("corr", F.col("cov") / F.col("_d")).drop("_d")


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    return covariance_table(df, columns).select("var1", "var2", "n", "corr")


def safe_corr(df: DataFrame, a: str, b: str, min_n: int = 10) -> DataFrame:
    """(n, corr); NULL under ``min_n`` common rows or without spread."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    row = both.agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("c"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"))
    return row.select("n", F.when((F.col("n") >= min_n) & (F.col("sa") >= 1e-12) & (F.col("sb") >= 1e-12), F.col("c")).alias("corr"))


def kmo_bartlett(df: DataFrame, columns: list[str], ridge: float = 1e-8) -> DataFrame:
    """One row: n_complete, KMO, Bartlett's statistic, its df and p; NULL under 10 rows or 2 columns."""
    spark: SparkSession = df.sparkSession
    schema = "n_complete bigint, kmo double, bartlett_chi2 double, bartlett_df int, bartlett_p double"
    row = _moment_row(df, columns)
    n, p = int(row["n"] or 0), len(columns)
    if n < 10 or p < 2:
        return spark.createDataFrame([(n, None, None, None, None)], schema)
    r = correlation_of(covariance_of(n, row["s"], row["q"]))
    np.fill_diagonal(r, 1.0)
    r = r + np.eye(p) * ridge
    inv = np.linalg.pinv(r)
    d = np.sqrt(np.diag(inv))
    partial = inv / np.outer(d, d)
    off = ~np.eye(p, dtype=bool)
    r2, a2 = float((r[off] ** 2).sum()), float((partial[off] ** 2).sum())
    sign, logdet = np.linalg.slogdet(r)
    chi2 = -(n - 1 - (2 * p + 5) / 6.0) * logdet if sign > 0 else None
    dof = p * (p - 1) // 2
    return spark.createDataFrame([(n, r2 / (r2 + a2), chi2 if chi2 is None else float(chi2), dof,
                                   None if chi2 is None else chi2_tail(float(chi2), dof))], schema)


def vif(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(feature, r2, vif): each regressor on the others, from the correlation matrix."""
    spark: SparkSession = df.sparkSession
    names, cols = list(columns), list(columns.values())
    row = _moment_row(df, cols)
    r = correlation_of(covariance_of(int(row["n"]), row["s"], row["q"]))
    np.fill_diagonal(r, 1.0)
    out = []
    for i, name in enumerate(names):
        rest = [j for j in range(len(names)) if j != i]
        beta = np.linalg.lstsq(r[np.ix_(rest, rest)], r[rest, i], rcond=None)[0]
        r2 = float(r[rest, i] @ beta)
        out.append((name, r2, 1.0 / (1.0 - r2) if r2 < 0.999999 else math.inf))
    return spark.createDataFrame(out, "feature string, r2 double, vif double")
