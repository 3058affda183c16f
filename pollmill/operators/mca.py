"""Multiple correspondence analysis from the table of level pairs."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scores as S
from ..plans import profile as P
from .moments import safe_corr


def burt_counts(df: DataFrame, items: list[str]) -> DataFrame:
    """(item1, level1, item2, level2, count) over complete rows: pairs are made inside the row and counted map-side."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in items])
    pairs = F.array(*[F.struct(F.lit(a).alias("item1"), F.col(a).cast("int").alias("level1"), F.lit(b).alias("item2"), F.col(b).cast("int").alias("level2"))
                      for i, a in enumerate(items) for b in items[i:]])
    rows = df.select(F.inline(F.when(complete, pairs)))
    return rows.groupBy("item1", "level1", "item2", "level2").agg(F.count(F.lit(1)).alias("count"))


class Axes:
    """Categories, masses, eigenvalues and axes of one analysis (d x d objects only)."""

    def __init__(self, counts: DataFrame, q: int):
        rows = counts.collect()
        self.levels = sorted({(r["item1"], r["level1"]) for r in rows if r["item1"] == r["item2"]})
        at = {k: i for i, k in enumerate(self.levels)}
        b = np.zeros((len(at), len(at)))
        for r in rows:
            i, j = at[(r["item1"], r["level1"])], at[(r["item2"], r["level2"])]
            b[i, j] = b[j, i] = r["count"]
        self.n = int(round(np.trace(b) / q))
        self.mass = np.diag(b) / max(self.n * q, 1)
        if self.n:
            root = np.sqrt(self.mass)
            lam, vec = np.linalg.eigh((b / (self.n * q * q) - np.outer(self.mass, self.mass)) / np.outer(root, root))
            self.eigen, self.vec = np.clip(lam[::-1], 0, None), vec[:, ::-1]
            for k in range(self.vec.shape[1]):  # an axis has no sign of its own: its largest entry is positive
                self.vec[:, k] *= np.sign(self.vec[np.argmax(np.abs(self.vec[:, k])), k]) or 1.0


def mca_columns(df: DataFrame, items: list[str], min_n: int = 20):
    """(category rows, eigenvalue rows); no rows under ``min_n`` complete answers."""
    spark: SparkSession = df.sparkSession
    axes = Axes(burt_counts(df, items), len(items))
    cats, eigs = [], []
    if axes.n >= min_n:
        sg = np.sqrt(axes.eigen[:2])
        col = axes.vec[:, :2] / np.sqrt(axes.mass)[:, None] * sg
        contrib = np.where(axes.eigen[:2] > 1e-12, axes.mass[:, None] * col ** 2 / np.where(axes.eigen[:2] > 1e-12, axes.eigen[:2], 1.0), 0.0)
        cats = [(f"Q{int(i[1:])}={lv}", *map(float, col[r]), *map(float, contrib[r])) for r, (i, lv) in enumerate(axes.levels)]
        eigs = [(k + 1, float(v)) for k, v in enumerate(axes.eigen)]
    return (spark.createDataFrame(cats, "category string, dim1 double, dim2 double, dim1_contrib double, dim2_contrib double"),
            spark.createDataFrame(eigs, "dimension int, eigenvalue double"))


def top_loadings(categories: DataFrame, k: int = 8) -> DataFrame:
    """The k categories furthest out on each dimension."""
    parts = [categories.orderBy(F.abs(d).desc(), "category").limit(k).select(F.lit(d).alias("dimension"), "category", F.col(d).alias("coordinate"),
                                                                             F.col(f"{d}_contrib").alias("contribution")) for d in ("dim1", "dim2")]
    return parts[0].unionByName(parts[1])


def mca_rows(df: DataFrame, items: list[str], anchors: dict[str, list[str]], id_col: str = "respondent_id", min_n: int = 30, keep=()) -> DataFrame:
    """(id, keep, dim1, dim2, quadrant): row scores are averages of their categories' axis values, read from a literal map.

    Each axis is turned so that it correlates positively with the sum of its anchor items.
    """
    axes = Axes(burt_counts(df, items), len(items))
    if axes.n < min_n:
        none = F.lit(None).cast("double")
        return df.select(id_col, *keep, none.alias("dim1"), none.alias("dim2"), F.lit("NA").alias("quadrant"))
    scored = df.select(id_col, *keep, *items)
    for d in (0, 1):
        parts = []
        for item in items:
            value = {lv: float(axes.vec[r, d] / np.sqrt(axes.mass[r])) for r, (i, lv) in enumerate(axes.levels) if i == item}
            parts.append(F.try_element_at(F.create_map(*[F.lit(x) for kv in value.items() for x in kv]), F.col(item).cast("int")))
        scored = scored.withColumn(f"dim{d + 1}", reduce(lambda a, b: a + b, parts) / float(len(items)))
    for dim, cols in anchors.items():
        anchor = scored.withColumn("_a", reduce(lambda a, b: a + b, [F.col(c) for c in cols]))
        r = safe_corr(anchor, dim, "_a").first()["corr"]
        if r is not None and r < 0:
            scored = scored.withColumn(dim, -F.col(dim))
    quad = F.coalesce(S.quadrant_label("dim1", "dim2", 0, 0, P.MCA_QUADRANTS), F.lit("NA"))
    return scored.select(id_col, *keep, "dim1", "dim2", quad.alias("quadrant"))


def quadrant_shares(rows: DataFrame) -> DataFrame:
    counts = rows.filter("quadrant <> 'NA'").groupBy("quadrant").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share_pct", F.col("n") * 100.0 / counts.agg(F.sum("n")).scalar())
