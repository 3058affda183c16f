"""Mid-ranks, exact row numbers and rank-based metrics without a global window.

Ranks are taken over distinct values and their counts, added up over sorted ranges (``prefix``): one plan at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scores import portable_hash
from ..sources.scratch import cut
from .prefix import numbered, running_sums, unused
from .skew import lookup


def running_totals(values: DataFrame, value: str, totals: list[str], by=(), descending: bool = False) -> DataFrame:
    """Adds ``<total>_before``: the sum of each total over all smaller values of the group (larger if descending).

    ``values`` holds one row per (group, value).
    """
    return running_sums(values, [value], totals, by, descending)


def value_ranks(df: DataFrame, value: str, by=()) -> DataFrame:
    """(by, value, n, avg_rank): the mid-rank of each distinct value within its group."""
    values = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(values, value, ["n"], by).withColumn(
        "avg_rank", F.col("n_before") + (F.col("n") + 1) / 2.0).drop("n_before")


def avg_rank(df: DataFrame, value: str, by=(), out: str = "avg_rank") -> DataFrame:
    """Mid-rank of each row, looked up from the ranks of the distinct values (``skew.lookup``); missing values have none."""
    keys = [*by, value]
    rows = cut(df)
    return lookup(rows, value_ranks(rows, value, by).select(*keys, F.col("avg_rank").alias(out)), keys)


def stratified_folds(df: DataFrame, label: str, k: int, seed: int, id_col: str = "respondent_id") -> DataFrame:
    """Balanced fold number per row: rows of each class numbered by a seeded hash, modulo k."""
    h, no = unused(df, "_h"), unused(df, "_no")
    out = numbered(df.withColumn(h, portable_hash(id_col, seed)), [label], [h, id_col], no)
    return out.withColumn("fold", ((F.col(no) - 1) % k).cast("int")).drop(h, no)


def dup_rank(df: DataFrame, key: Column, id_col: str = "respondent_id") -> DataFrame:
    """Occurrence number and total per answer key, in id order."""
    keyed = cut(df.withColumn("_key", key))
    n = numbered(keyed.select(id_col, "_key"), ["_key"], [id_col], "occurrence").select(id_col, "occurrence")
    # Only repeated answers carry a total back; a hot answer is looked up by broadcast.
    repeated = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("total")).filter("total > 1")
    out = lookup(keyed, repeated, ["_key"]).drop("_key")
    return out.withColumn("total", F.coalesce("total", F.lit(1).cast("bigint"))).join(n, id_col)


def auc_rank(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """(by, n_pos, n_neg, auc) from mid-ranks of the scores."""
    ranks = _class_counts(df, label, score, by)
    ranks = running_totals(ranks.withColumn("n", F.col("pos") + F.col("neg")), score, ["n"], by)
    mid = F.col("n_before") + (F.col("n") + 1) / 2.0
    agg = ranks.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * mid).alias("_r"))
    p, q = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return agg.select(*by, "n_pos", "n_neg", F.when((p > 0) & (q > 0), (F.col("_r") - p * (p + 1.0) / 2.0) / (p * q)).alias("auc"))


def _class_counts(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    return cut(df.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))


def pr_auc(df: DataFrame, label: str, score: str, by=()) -> DataFrame:
    """Average precision: precision at each distinct score weighted by the recall it adds."""
    counts = running_totals(_class_counts(df, label, score, by), score, ["pos", "neg"], by, descending=True)
    tp = (F.col("pos_before") + F.col("pos")).cast("double")
    shown = tp + F.col("neg_before") + F.col("neg")
    return counts.groupBy(*by).agg((F.sum(F.col("pos") * tp / shown) / F.sum("pos")).alias("pr_auc"))


def brier_logloss(df: DataFrame, label: str, score: str, by=(), clip: float = 1e-6) -> DataFrame:
    p = F.greatest(F.lit(clip), F.least(F.lit(1.0 - clip), F.col(score)))
    y = F.col(label)
    loss = -(y * F.ln(p) + (1.0 - y) * F.ln(F.lit(1.0) - p))
    return df.groupBy(*by).agg(F.avg((p - y) * (p - y)).alias("brier"), F.avg(loss).alias("log_loss"))


def confusion_at(df: DataFrame, label: str, score: str, cuts=(0.4, 0.5, 0.6), by=()) -> DataFrame:
    """Cells and rates at every cut-off, in one pass: the row is tested, not copied, per cut."""
    aggs = []
    for i, t in enumerate(cuts):
        hit = F.col(score) >= t
        for name, cond in (("tp", hit & (F.col(label) == 1)), ("fp", hit & (F.col(label) == 0)),
                           ("tn", ~hit & (F.col(label) == 0)), ("fn", ~hit & (F.col(label) == 1))):
            aggs.append(F.count_if(cond).alias(f"{name}{i}"))
    rows = df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*[F.struct(
        F.lit(float(t)).alias("threshold"), *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "tn", "fn")]) for i, t in enumerate(cuts)])))
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    rows = rows.withColumns({"accuracy": F.when(total > 0, (tp + tn) / total), "precision": F.when(tp + fp > 0, tp / (tp + fp)),
                             "recall": F.when(tp + fn > 0, tp / (tp + fn))})
    pr, re = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", F.when(pr + re > 0, pr * re * 2.0 / (pr + re)))


def kruskal_wallis(df: DataFrame, value: str, group: str, by=(), min_group: int = 5) -> DataFrame:
    """(by, n, groups, h, df, epsilon2): H with tie correction; NULL for a group below ``min_group``."""
    cells = df.filter(F.col(value).isNotNull()).groupBy(*by, group, value).agg(F.count(F.lit(1)).alias("m"))
    cells = cut(cells)
    return kruskal_from_counts(cells, value, group, by, min_group)


def kruskal_from_counts(cells: DataFrame, value: str, group: str, by=(), min_group: int = 5) -> DataFrame:
    """The same from counts ``m`` per (by, group, value)."""
    values = cells.groupBy(*by, value).agg(F.sum("m").alias("n"))
    ranked = running_totals(values, value, ["n"], by).withColumn("mid", F.col("n_before") + (F.col("n") + 1) / 2.0)
    sums = cells.join(ranked.select(*by, value, "mid"), [*by, value]).groupBy(*by, group).agg(
        F.sum("m").alias("m"), F.sum(F.col("m") * F.col("mid")).alias("r"))
    # Without keys the two one-row tables are paired on a constant.
    keys = list(by) or ["_one"]
    ties = values.groupBy(*by).agg(F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("t")).withColumn("_one", F.lit(1))
    agg = sums.groupBy(*by).agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("groups"), F.min("m").alias("_least"),
                                F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s")).withColumn("_one", F.lit(1))
    n = F.col("n").cast("double")
    raw = F.lit(12.0) / (n * (n + 1.0)) * F.col("s") - (n + 1.0) * 3.0
    tie = F.lit(1.0) - F.col("t") / (n * n * n - n)
    k = F.col("groups")
    ok = (F.col("_least") >= min_group) & (k >= 2) & (tie > 0)
    out = agg.join(ties, keys).withColumn("h", F.when(ok, raw / tie))
    eps = F.when(n > k, F.greatest(F.lit(0.0), (F.col("h") - k + 1.0) / (n - k)))
    return out.select(*by, "n", "groups", "h", F.when(ok, k - 1).alias("df"), eps.alias("epsilon2"))


def cramers_v(chi2: DataFrame) -> DataFrame:
    """Adds Cramer's V to chi-square rows (n, chi2, rows, columns)."""
    small = F.greatest(F.lit(1), F.least(F.col("rows") - 1, F.col("columns") - 1))
    return chi2.withColumn("cramers_v", F.when(F.col("n") > 0, F.sqrt(F.greatest(F.col("chi2"), F.lit(0.0)) / (F.col("n") * small))))
