"""Counts, rates, sample flow, importance-performance analysis, sampling and segment tables.

Every table is one scan: columns are unpivoted in the row and reduced map-side, so the shuffle
carries (item, code) counts and never respondents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import scores as S
from ..functions.text import num_format
from ..plans import profile as P


def long_items(df: DataFrame, columns: list[str], ids=(), name="item", value="value") -> DataFrame:
    """(ids, item, value) with missing answers dropped."""
    typed = df.select(*ids, *[F.col(x).cast("double").alias(x) for x in columns])
    return typed.unpivot(list(ids), list(columns), name, value).filter(F.col(value).isNotNull())


def freq_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(item, code, count, pct) over the valid answers of each column."""
    counts = long_items(df, columns, value="code").groupBy("item", "code").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("pct", F.col("count") * 100.0 / F.sum("count").over(W.partitionBy("item")))


def freq_text(df: DataFrame, column: str) -> DataFrame:
    """The same for one text column."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("code")).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("pct", F.col("count") * 100.0 / counts.agg(F.sum("count")).scalar())


def multi_select_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """(item, selected_count, valid_n, selected_pct); options nobody could answer are left out."""
    aggs = []
    for x in columns:
        aggs += [F.count_if(F.col(x) == 1).alias(f"s_{x}"), F.count(x).alias(f"n_{x}")]
    row = df.agg(*aggs).select(F.inline(F.array(*[F.struct(
        F.lit(x).alias("item"), F.col(f"s_{x}").alias("selected_count"), F.col(f"n_{x}").alias("valid_n")) for x in columns])))
    return row.filter("valid_n > 0").withColumn("selected_pct", F.col("selected_count") * 100.0 / F.col("valid_n"))


def item_number(item="item") -> Column:
    return F.substring(item, 2, 3).cast("int")


def pair_counts(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(var1, var2, var1_code, var2_code, count) of the answer pairs that occur, all pairs in one scan."""
    cells = F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(a).cast("string").alias("var1_code"),
                               F.col(b).cast("string").alias("var2_code")) for a, b in pairs])
    rows = df.select(F.inline(cells)).filter("var1_code is not null and var2_code is not null")
    return rows.groupBy("var1", "var2", "var1_code", "var2_code").agg(F.count(F.lit(1)).alias("count"))


def crosstab_counts(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The full table of every pair: combinations that never occur are rows with count 0."""
    seen = pair_counts(df, pairs)
    # Levels are read off the small count table, one array per variable.
    grid = (seen.groupBy("var1", "var2").agg(F.collect_set("var1_code").alias("l1"), F.collect_set("var2_code").alias("l2"))
            .withColumn("var1_code", F.explode("l1")).withColumn("var2_code", F.explode("l2")).drop("l1", "l2"))
    return grid.join(seen, ["var1", "var2", "var1_code", "var2_code"], "left").na.fill(0, ["count"])


def margin_totals(counts: DataFrame, by=("var1", "var2")) -> DataFrame:
    """Row, column and grand totals beside each cell of the small count table."""
    return counts.withColumns({
        "row_total": F.sum("count").over(W.partitionBy(*by, "var1_code")),
        "col_total": F.sum("count").over(W.partitionBy(*by, "var2_code")),
        "grand_total": F.sum("count").over(W.partitionBy(*by)),
    })


def chi2_from_counts(counts: DataFrame, by=("var1", "var2")) -> DataFrame:
    """(by, n, chi2, dof, rows, columns) from cell counts; no continuity correction, NULL under two levels.

    Empty cells need no row: sum((o-e)^2/e) = n * (sum(o^2 / (row * col)) - 1).
    """
    cell = F.col("count").cast("double") ** 2 / (F.col("row_total").cast("double") * F.col("col_total"))
    out = margin_totals(counts, by).groupBy(*by).agg(
        F.sum("count").alias("n"), F.sum(cell).alias("_s"),
        F.count_distinct("var1_code").alias("rows"), F.count_distinct("var2_code").alias("columns"))
    ok = (F.col("rows") >= 2) & (F.col("columns") >= 2)
    return out.select(*by, "n", F.when(ok, F.greatest(F.lit(0.0), F.col("n") * (F.col("_s") - 1.0))).alias("chi2"),
                      F.when(ok, (F.col("rows") - 1) * (F.col("columns") - 1)).alias("dof"), "rows", "columns")


def two_by_two(df: DataFrame, a: str, b: str, eps: float = 1e-9) -> DataFrame:
    """(metric, value): cells, conditional rates, difference and odds ratio of two 0/1 columns."""
    valid = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = valid.agg(F.count(F.lit(1)).alias("n_total"), *[
        F.count_if((F.col(a) == x) & (F.col(b) == y)).cast("double").alias(f"c{x}{y}") for x in (1, 0) for y in (1, 0)])
    high = F.col("c11") / F.greatest(F.col("c11") + F.col("c10"), F.lit(1.0))
    low = F.col("c01") / F.greatest(F.col("c01") + F.col("c00"), F.lit(1.0))
    wide = cells.select(
        F.col("n_total").cast("double"), high.alias("p_b_high_given_a_high"), low.alias("p_b_high_given_a_low"),
        (high - low).alias("rate_diff"),
        ((F.col("c11") * F.col("c00") + eps) / (F.col("c10") * F.col("c01") + eps)).alias("odds_ratio_unadjusted"),
        F.col("c11").alias("cell_1_1"), F.col("c10").alias("cell_1_0"), F.col("c01").alias("cell_0_1"), F.col("c00").alias("cell_0_0"))
    return wide.unpivot([], wide.columns, "metric", "value")


def sample_flow(flagged: DataFrame, layout: str = "main", logic="logic_branch_flag") -> DataFrame:
    """(step_no, step, n): raw -> removed -> kept -> sensitivity; the revised layout stops at kept."""
    kept = F.col("invalid_union_flag") == 0
    names = (["raw_input", "invalid_removed", "main_analysis", "sensitivity"] if layout == "main"
             else ["raw_input", "invalid_revised", "remain_revised"])
    counts = [F.count(F.lit(1)), F.count_if(~kept), F.count_if(kept),
              F.count_if(kept & (F.col("attention_flag") == 0) & (F.col(logic) == 0))]
    row = flagged.agg(*[x.alias(n) for n, x in zip(names, counts)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(n).alias("step"), F.col(n).alias("n"))
                                         for i, n in enumerate(names, 1)])))


def flag_totals(flagged: DataFrame, flags: list[str]) -> DataFrame:
    row = flagged.agg(*[F.sum(f).cast("bigint").alias(f) for f in flags])
    return row.unpivot([], flags, "flag", "n")


def item_means(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(*[F.avg(x).alias(x) for x in columns])
    return row.unpivot([], columns, "item", "mean")


def ipa(df: DataFrame, importance=P.IMPORTANCE, performance=P.PERFORMANCE) -> DataFrame:
    """Mean importance and performance per item, gap, and quadrant against the mean respondent score."""
    cuts = [F.avg(S.row_nanmean(importance)).alias("_ic"), F.avg(S.row_nanmean(performance)).alias("_pc")]
    row = df.agg(*[F.avg(x).alias(x) for x in [*importance, *performance]], *cuts)
    pairs = F.array(*[F.struct(F.lit(i).alias("item_no"), F.lit(int(a[1:])).alias("importance_col"),
                               F.lit(int(b[1:])).alias("performance_col"), F.col(a).alias("importance_mean"),
                               F.col(b).alias("performance_mean")) for i, (a, b) in enumerate(zip(importance, performance), 1)])
    out = row.select("_ic", "_pc", F.inline(pairs))
    return out.select("item_no", "importance_col", "performance_col", "importance_mean", "performance_mean",
                      (F.col("performance_mean") - F.col("importance_mean")).alias("gap_perf_minus_imp"),
                      S.quadrant_label("importance_mean", "performance_mean", F.col("_ic"), F.col("_pc"),
                                       P.IPA_QUADRANTS).alias("quadrant"))


def ipa_sensitivity(df: DataFrame, importance=P.IMPORTANCE, performance=P.PERFORMANCE) -> DataFrame:
    """Quadrants under the mean and the median of the item means."""
    items = ipa(df, importance, performance).select("item_no", "importance_mean", "performance_mean", F.col("importance_col").alias("col_idx"))
    cuts = items.agg(*[f(x).alias(f"{n}_{x}") for n, f in (("mean", F.avg), ("median", F.median))
                       for x in ("importance_mean", "performance_mean")])
    one = cuts.select(F.struct(*cuts.columns)).scalar()
    rows = items.withColumn("_c", one).withColumn("_m", F.explode(F.array(
        F.struct(F.lit("均值阈值").alias("method"), F.col("_c.mean_importance_mean").alias("i"), F.col("_c.mean_performance_mean").alias("p")),
        F.struct(F.lit("中位数阈值").alias("method"), F.col("_c.median_importance_mean").alias("i"), F.col("_c.median_performance_mean").alias("p")))))
    label = S.quadrant_label("importance_mean", "performance_mean", F.col("_m.i"), F.col("_m.p"), P.IPA_QUADRANTS)
    return rows.select(F.col("_m.method").alias("method"), "item_no", "col_idx", "importance_mean", "performance_mean",
                       F.col("_m.i").alias("importance_threshold"), F.col("_m.p").alias("performance_threshold"),
                       label.alias("quadrant"), S.flag(label == P.IPA_PRIORITY).alias("is_priority"))


def ipa_priority(table: DataFrame, k: int | None = None) -> DataFrame:
    """Improvement-quadrant items, widest gap first; ties keep item order."""
    out = table.filter(F.col("quadrant") == P.IPA_PRIORITY).orderBy("gap_perf_minus_imp", "item_no")
    return out if k is None else out.limit(k)


def top_options(rates: DataFrame, blocks: dict[str, list[str]], k: int = 3) -> DataFrame:
    """The k most selected options of each block; ties keep column order."""
    rows = rates.withColumn("block", F.coalesce(*[F.when(F.col("item").isin(v), F.lit(n)) for n, v in blocks.items()]))
    order = W.partitionBy("block").orderBy(F.col("selected_pct").desc(), "item")
    return rows.filter("block is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# --- segments -------------------------------------------------------------------
PROFILE_FIELDS = [*P.COUNTS, "importance_mean", "performance_mean", "cognition_mean"]


def group_profile(df: DataFrame, fields=PROFILE_FIELDS, by: str = "cluster") -> DataFrame:
    """Size, share and mean scores per segment."""
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(x) for x in fields])
    return out.withColumn("share_pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()))


def cluster_sizes(sizes: DataFrame, by=(), label: str = "cluster", n: str = "n") -> DataFrame:
    """"n1|n2|..." in label order, from a table of segment sizes."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(label, n))), lambda s: s[n].cast("string"))
    return sizes.groupBy(*by).agg(F.array_join(ordered, "|").alias("cluster_size_distribution"))


def segment_counts(df: DataFrame, by: str = "cluster") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def stats_by_cluster(df: DataFrame, variables: dict[str, str], by: str = "cluster") -> DataFrame:
    """(variable, "C1=..|C2=.."): the share of 1 for binary variables, the mean for ordinal ones."""
    rows = long_items(df, list(variables), [by], "variable")
    binary = [v for v, kind in variables.items() if kind == "binary"]
    value = F.when(F.col("variable").isin(binary), (F.col("value") == 1).cast("double")).otherwise(F.col("value")) if binary else F.col("value")
    means = rows.groupBy("variable", by).agg(F.avg(value).alias("m"))
    text = F.transform(F.array_sort(F.collect_list(F.struct(by, "m"))), lambda s: F.format_string("C%d=%.3f", s[by].cast("int"), s["m"]))
    return means.groupBy("variable").agg(F.array_join(text, "|").alias("cluster_stats"))


def cluster_imbalance(shares: DataFrame) -> DataFrame:
    """(type, segment, n, share_pct, imbalance_risk, action_hint) from rows (type, segment, n, share_pct)."""
    hard = F.col("type") == "hard_cluster"
    high = F.col("share_pct") >= 70.0
    low = F.col("share_pct") <= F.when(hard, 20.0).otherwise(15.0)
    # Action texts.
    hint = (F.when(hard & high, "该簇执行分层触达上限，避免资源过度集中")
            .when(hard & low, "该簇增加探索预算与素材覆盖，防止样本稀疏")
            .when(hard, "按常规节奏执行")
            .when(high, "该软分层占比高，建议按渠道或人群再细分后投放")
            .when(low, "该软分层样本偏少，建议滚动累积样本并延长实验周期")
            .otherwise("可直接用于AB分层投放"))
    risk = F.when(high, "偏高").when(low, "偏低").otherwise("正常")
    return shares.select("type", "segment", "n", "share_pct", risk.alias("imbalance_risk"), hint.alias("action_hint"))


def weighted_metric(rows: DataFrame, metric: str, weight: str = "n", by=()) -> DataFrame:
    return rows.groupBy(*by).agg((F.sum(F.col(weight) * F.col(metric)) / F.sum(weight)).alias(metric))


# --- sampling ---------------------------------------------------------------------
def sampling_bias(df: DataFrame, spark: SparkSession, stratum: str = "C008", targets=P.STRATUM_TARGETS) -> DataFrame:
    """Target against actual share per stratum, bias in points, ratio, weight; plus the total row."""
    goal = spark.createDataFrame(targets, "code int, stratum string, target_n int")
    actual = df.groupBy(F.col(stratum).cast("int").alias("code")).agg(F.count(F.lit(1)).alias("actual_n"))
    both = F.broadcast(goal).join(actual, "code", "left").na.fill(0, ["actual_n"])
    total_t, total_a = float(sum(t for _, _, t in targets)), F.sum("actual_n").over(W.partitionBy())
    share_t, share_a = F.col("target_n") / total_t, F.when(total_a > 0, F.col("actual_n") / total_a)
    rows = both.select("stratum", F.col("target_n").cast("bigint").alias("target_n"), "actual_n",
                       (share_t * 100.0).alias("target_pct"), (share_a * 100.0).alias("actual_pct"),
                       ((share_a - share_t) * 100.0).alias("bias_points"), (F.col("actual_n") / F.col("target_n")).alias("actual_to_target"),
                       F.when(share_a > 0, share_t / share_a).alias("weight"))
    total = rows.agg(F.lit("合计").alias("stratum"), F.sum("target_n").alias("target_n"), F.sum("actual_n").alias("actual_n"),
                     F.lit(100.0).alias("target_pct"), F.lit(100.0).alias("actual_pct"), F.lit(0.0).alias("bias_points"),
                     (F.sum("actual_n") / F.sum("target_n")).alias("actual_to_target"), F.lit(None).cast("double").alias("weight"))
    return rows.unionByName(total)


def sample_size_plan(df: DataFrame, answered: str = "C001", design=P.SAMPLE_DESIGN) -> DataFrame:
    """(step, value): first size, finite correction, design effect, copies to hand out, actual sample."""
    d = {k: F.lit(float(v)) for k, v in design.items()}
    n0 = d["z"] * d["z"] * d["p"] * (F.lit(1.0) - d["p"]) / (d["d"] * d["d"])
    fpc = n0 / (F.lit(1.0) + (n0 - 1.0) / d["population"])
    row = df.agg(n0.alias("n0"), fpc.alias("n_fpc"), (fpc * d["deff"]).alias("n_deff"),
                 (fpc * d["deff"] / d["response_rate"]).alias("n_issue"), F.count(answered).cast("double").alias("n_final"))
    return row.unpivot([], row.columns, "step", "value")


# --- evidence and actions -----------------------------------------------------------
def evidence_rows(kind: str, ranked: DataFrame, source_no: int, rank: str = "rank") -> DataFrame:
    """(source_no, rank, problem, evidence, suggestion) for one source with columns item_text plus its figures."""
    head, advice = P.SUGGESTIONS[kind]
    if kind == "ipa":
        evidence = F.format_string("重要度均值%.3f，满意度均值%.3f，差值%.3f", "importance_mean", "performance_mean", "gap_perf_minus_imp")
        problem = F.concat(F.lit(head), "item_text")
    elif kind == "logit":
        way = F.when(F.col("coef") > 0, "正向").otherwise("负向")
        problem = F.concat(F.lit(head), F.col("item_text"), F.lit("（"), way, F.lit("）"))
        evidence = F.format_string("coef=%.3f, OR=%.3f, p=%.4f", "coef", "odds_ratio", "p_value")
    else:
        problem = F.concat(F.lit(head), "item_text")
        evidence = F.format_string("选择率%.2f%%（%d/%d）", F.col("selected_pct"), F.col("selected_count"), F.col("valid_n"))
    return ranked.select(F.lit(source_no).alias("source_no"), F.col(rank).alias("rank"), problem.alias("problem"),
                         evidence.alias("evidence"), F.lit(advice).alias("suggestion"))


def priority_number(rows: DataFrame, order=("source_no", "rank")) -> DataFrame:
    """Running priority over the concatenated suggestions: a table of at most a dozen rows."""
    return rows.withColumn("priority", F.row_number().over(W.partitionBy().orderBy(*order)))


def evidence_table(sources: list[DataFrame]) -> DataFrame:
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    return priority_number(rows).select("priority", "problem", "evidence", "suggestion")


def action_matrix(evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """Owner, time window and KPI per problem; the lowest matching rule number wins."""
    hit = evidence.join(F.broadcast(rules), F.col("problem").contains(F.col("keyword")), "left")
    best = hit.groupBy("priority", "problem", "evidence", F.col("suggestion").alias("action")).agg(
        F.min(F.struct("rule_no", "owner", "time_window", "kpi")).alias("r"))
    owner, window, kpi = P.ACTION_DEFAULT
    return best.select("priority", "problem", "evidence", "action", F.coalesce("r.owner", F.lit(owner)).alias("owner"),
                       F.coalesce("r.time_window", F.lit(window)).alias("time_window"),
                       F.coalesce("r.kpi", F.lit(kpi)).alias("kpi"), F.lit(P.ACTION_DEPENDS).alias("depends_on"))


def hypothesis_evidence(spark: SparkSession, terms: DataFrame, priority_items: DataFrame) -> DataFrame:
    """Hypotheses with the fitted coefficient of their terms as evidence text."""
    rows = [(h, text, var, n, t, model, way, end) for h, text, var, ts, model, way, end in P.HYPOTHESES
            for n, t in enumerate(ts or [None])]
    base = spark.createDataFrame(rows, "id string, hypothesis string, variable string, pos int, term string, model string, "
                                       "expected string, conclusion string")
    shown = terms.select("term", F.format_string("coef=%.3f, p=%.4f, OR=%.3f", "coef", "p_value", "odds_ratio").alias("txt"))
    fixed = F.create_map(*[F.lit(x) for kv in P.HYPOTHESIS_TEXT_EVIDENCE.items() for x in kv])
    joined = base.join(shown, "term", "left").groupBy("id", "hypothesis", "variable", "model", "expected", "conclusion").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("txt", F.lit("无")).alias("t")))),
                                 lambda s: s["t"]), "；").alias("ev"))
    n = priority_items.agg(F.count(F.lit(1)).cast("string")).scalar()
    return joined.select("id", "hypothesis", "variable", "model", "expected",
                         F.coalesce(fixed[F.col("id")], "ev").alias("evidence"),
                         F.replace("conclusion", F.lit("{n}"), n).alias("conclusion"))


def formatted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Printed numbers for a text sink."""
    return df.withColumns({x: num_format(x) for x in columns})
