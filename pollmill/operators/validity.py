"""External validity of a segmentation: tests of answers against the segments, by layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.pvalues import chi2_p
from ..plans import profile as P
from ..sources.scratch import cut
from . import describe as D, ranks as K

_KEYS = ["layer_id", "variable"]


def layer_cells(df: DataFrame, by=(), cluster: str = "cluster", status: str = "C008", layers=P.VALIDITY_LAYERS) -> DataFrame:
    """(by, layer_id, variable, kind, score_included, cluster, value, m): every test reduces to these counts.

    Layers and variables are expanded inside the row and counted map-side.
    """
    seen: set[str] = set()
    entries = []
    for layer, _, code, variables in layers:
        cond = F.col(status).isNotNull() if code is None else F.col(status) == code
        for v, _, kind in variables:
            # Each variable scores once: in the first layer that tests it.
            entries.append(F.when(cond & F.col(v).isNotNull(), F.struct(
                F.lit(layer).alias("layer_id"), F.lit(v).alias("variable"), F.lit(kind).alias("kind"),
                F.lit(int(v not in seen)).alias("score_included"), F.col(v).cast("double").alias("value"))))
            seen.add(v)
    rows = df.select(*by, cluster, F.inline(F.array_compact(F.array(*entries))))
    return rows.groupBy(*by, *_KEYS, "kind", "score_included", cluster, "value").agg(F.count(F.lit(1)).alias("m"))


def external_validity(df: DataFrame, by=(), cluster: str = "cluster", status: str = "C008", layers=P.VALIDITY_LAYERS,
                      min_n: int = 30, alpha: float = 0.05, min_effect: float = 0.03) -> DataFrame:
    """One row per (by, layer, variable) with at least ``min_n`` answers: test, statistic, p, effect, significance."""
    by = list(by)
    keys = [*by, *_KEYS]
    # A few thousand counts from here on: the respondents are scanned once.
    cells = cut(layer_cells(df, by, cluster, status, layers))
    totals = cells.groupBy(*keys, "kind", "score_included").agg(F.sum("m").alias("n")).filter(F.col("n") >= min_n)
    kept = cells.join(totals.select(*keys), keys, "left_semi")
    binary = kept.filter("kind = 'binary'").select(*keys, F.col(cluster).cast("string").alias("var1_code"),
                                                   F.col("value").cast("string").alias("var2_code"), F.col("m").alias("count"))
    chi = K.cramers_v(D.chi2_from_counts(binary, keys)).select(
        *keys, F.lit("chi2_cramers_v").alias("test"), F.col("chi2").alias("statistic"), F.col("dof").cast("double").alias("df"), F.col("cramers_v").alias("effect_size"))
    kw = K.kruskal_from_counts(kept.filter("kind = 'ordinal'"), "value", cluster, keys).select(
        *keys, F.lit("kruskal_epsilon2").alias("test"), F.col("h").alias("statistic"), F.col("df").cast("double").alias("df"), F.col("epsilon2").alias("effect_size"))
    tests = chi.unionByName(kw).withColumn("p_value", chi2_p("statistic", "df"))
    out = totals.join(tests, keys).join(_stats(kept, keys, cluster), keys)
    sig = (F.col("p_value") < alpha) & (F.col("effect_size") >= min_effect)
    names = {layer: name for layer, name, _, _ in layers}
    labels = {v: label for _, _, _, variables in layers for v, label, _ in variables}
    return out.withColumns({"is_sig_with_effect": F.coalesce(sig, F.lit(False)).cast("int"), "layer_name": _named(names, "layer_id"),
                            "variable_label": _named(labels, "variable")}).drop("kind")


def _named(names: dict[str, str], key: str):
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col(key)]


def layer_sizes(df: DataFrame, by=(), status: str = "C008", layers=P.VALIDITY_LAYERS) -> DataFrame:
    """(by, layer_id, layer_name, layer_n): the rows of every layer, none left out."""
    inside = [F.col(status).isNotNull() if code is None else F.col(status) == code for _, _, code, _ in layers]
    counts = df.groupBy(*by).agg(*[F.count_if(cond).alias(f"_n{i}") for i, cond in enumerate(inside)])
    rows = [F.struct(F.lit(layer).alias("layer_id"), F.lit(name).alias("layer_name"), F.col(f"_n{i}").alias("layer_n")) for i, (layer, name, _, _) in enumerate(layers)]
    return counts.select(*by, F.inline(F.array(*rows)))


def _stats(cells: DataFrame, keys: list[str], cluster: str) -> DataFrame:
    share = F.when(F.col("kind") == "binary", (F.col("value") == 1).cast("double")).otherwise(F.col("value"))
    means = cells.groupBy(*keys, cluster).agg((F.sum(share * F.col("m")) / F.sum("m")).alias("_m"))
    text = F.transform(F.array_sort(F.collect_list(F.struct(cluster, "_m"))), lambda s: F.format_string("C%d=%.3f", s[cluster].cast("int"), s["_m"]))
    return means.groupBy(*keys).agg(F.array_join(text, "|").alias("cluster_stats"))


def layer_summary(detail: DataFrame, sizes: DataFrame, by=()) -> DataFrame:
    """Per layer of ``sizes``: its rows, variables tested, significant, mean effect and layer score; a layer without tests scores 0."""
    done = F.col("statistic").isNotNull()
    per_layer = detail.groupBy(*by, "layer_id").agg(
        F.count(F.lit(1)).alias("tested_vars_n"), F.sum("is_sig_with_effect").alias("sig_vars_n"),
        F.sum(F.col("is_sig_with_effect") * F.col("score_included")).alias("scored_sig_vars_n"),
        F.avg(F.when(done, F.col("effect_size"))).alias("mean_effect"))
    out = sizes.join(per_layer, [*by, "layer_id"], "left").fillna(0, ["tested_vars_n", "sig_vars_n", "scored_sig_vars_n"])
    return out.withColumn("layer_score", F.col("sig_vars_n") + F.coalesce("mean_effect", F.lit(0.0)) * 10.0)


def overall_score(detail: DataFrame, by=()) -> DataFrame:
    """Per labelling: significant variables and mean effect over the scored tests, and the total score."""
    scored = F.col("score_included") == 1
    n = F.coalesce(F.sum(F.when(scored, F.col("is_sig_with_effect"))), F.lit(0))
    effect = F.avg(F.when(scored, F.col("effect_size")))

    def in_layer(layer):
        return F.coalesce(F.sum(F.when(F.col("layer_id") == layer, F.col("is_sig_with_effect"))), F.lit(0))

    return detail.groupBy(*by).agg(
        n.alias("stratified_sig_n"), effect.alias("stratified_mean_effect"), F.avg("effect_size").alias("all_layers_mean_effect"),
        (n + F.coalesce(effect, F.lit(0.0)) * 10.0).alias("stratified_external_score"),
        *[in_layer(x).alias(f"{x}_sig_n") for x in ("all", "visited", "unvisited")])
