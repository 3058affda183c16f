"""Queries for features, scaling, segmentation, indices, stability and external validity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import cluster as C, describe as D, grid as G, quality as Q, stability as ST, validity as V
from ..sources import tables as T
from ..sources.scratch import new_path, once, spread
from . import profile as P
from .queries_quality import clean, clean_ctes, flagged, flags_ctes, scored, scored_ctes, scored_once
from .queries_recode import sql_list
from .queries_tables import _seg_ctes, _segmented, _PROFILE_SQL
from .registry import query, r6, rounded
from .views import load, oracle, view


def _embeddings(spark, sf):
    """(vec_id, z, labels): the given label stands in as a segmentation."""
    e = load(spark, sf, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("z"), F.array((F.col("label") + 1).cast("int")).alias("labels"))


def _long(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("j", "v"))


# Label centres in the check engine: (cluster, center list).
_CEN = """e AS (SELECT vec_id, cast(label + 1 AS int) AS cluster, [cast(x AS double) FOR x IN embedding] AS z FROM embeddings),
 lng AS (SELECT cluster, unnest(z) AS v, generate_subscripts(z, 1) AS j FROM e), cm AS (SELECT cluster, j, avg(v) AS v FROM lng GROUP BY 1, 2),
 cen AS (SELECT cluster, list(v ORDER BY j) AS c FROM cm GROUP BY 1)"""


def _centres(spark, sf):
    m = _long(spark, sf).groupBy((F.col("label") + 1).cast("int").alias("cluster"), "j").agg(F.avg("v").alias("v"))
    return m.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("center"))


# --- features ------------------------------------------------------------------------------
_IDX_SQL = (f"round(list_avg([C073, 6 - C083, 6 - C057, C038 * 5]), 6) AS price_sensitivity_index, round(list_avg([C086, C089, C016 * 5, C017 * 5, C027 * 5]), 6) AS culture_interest_index, "
            "round(list_avg([C092 * 5, C094 * 5, C097 * 5, C098 * 5, C099 * 5, C021 * 5, C026 * 5, C031 * 5]), 6) AS deep_experience_index")


@query("index_scores", oracle("survey", scored_ctes() + f" SELECT respondent_id, {_IDX_SQL} FROM scored"))
def _(spark, sf):
    return scored(spark, sf).select("respondent_id", *[r6(e).alias(n) for n, e in C.index_scores().items()])


@query("feature_matrix", oracle("survey", scored_ctes() + f" SELECT respondent_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in C.BINARIES)}, "
       f"{', '.join(c for c in C.ENHANCED if c not in C.BINARIES and not c.endswith('_mean') and c not in C.INDICES)}, "
       f"{', '.join(f'round({c}, 6) AS {c}' for c in C.ENHANCED if c.endswith('_mean'))}, {_IDX_SQL} FROM scored"))
def _(spark, sf):
    return rounded(C.feature_matrix(scored(spark, sf), "enhanced"), "importance_mean", "performance_mean", "cognition_mean", *C.INDICES)


_SF = ["C052", "C066", "importance_mean", "motive_count"]


def _scale_sql(method, c):
    # Spread of the mean-imputed column equals stddev_pop * sqrt(valid / rows).
    if method == "zscore":
        return f"(coalesce({c}, (SELECT avg({c}) FROM scored)) - (SELECT avg({c}) FROM scored)) / (SELECT stddev_pop(coalesce({c}, (SELECT avg({c}) FROM scored))) FROM scored)"
    if method == "robust":
        filled = f"coalesce({c}, (SELECT avg({c}) FROM scored))"
        return (f"({filled} - (SELECT quantile_cont({filled}, 0.5) FROM scored)) / (SELECT CASE WHEN quantile_cont({filled}, 0.75) - quantile_cont({filled}, 0.25) < 1e-10 THEN 1 "
                f"ELSE quantile_cont({filled}, 0.75) - quantile_cont({filled}, 0.25) END FROM scored)")
    if method == "winsor_z":
        w = f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, (SELECT quantile_cont({c}, 0.01) FROM scored)), (SELECT quantile_cont({c}, 0.99) FROM scored)) END"
    else:
        w = f"ln(1 + {c})"
    filled = f"coalesce({w}, (SELECT avg({w}) FROM scored))"
    return f"({filled} - (SELECT avg({w}) FROM scored)) / (SELECT stddev_pop({filled}) FROM scored)"


_METHODS = ("zscore", "robust", "winsor_z", "log1p_z")


@query("scale_features", oracle("survey", scored_ctes() + " " + " UNION ALL ".join(
    f"SELECT '{m}' AS method, respondent_id, " + ", ".join(f"round({_scale_sql(m, c)}, 6) AS {c}" for c in _SF) + " FROM scored" for m in _METHODS)))
def _(spark, sf):
    s = scored(spark, sf)
    out = None
    for m in _METHODS:
        part = rounded(C.scale_features(s, _SF, m), *_SF).withColumn("method", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out


@query("impute_mean", oracle("survey", scored_ctes() + " SELECT respondent_id, " + ", ".join(f"round(coalesce({c}, avg({c}) OVER ()), 6) AS {c}" for c in _SF) + " FROM scored"))
def _(spark, sf):
    return rounded(C.impute_mean(scored(spark, sf).select("respondent_id", *_SF), _SF), *_SF)


# --- distances and indices -------------------------------------------------------------------
@query("nearest_center", f"WITH {_CEN}, d AS (SELECT vec_id, cen.cluster, list_distance(z, c) AS dist FROM e CROSS JOIN cen) SELECT vec_id, arg_min(cluster, dist) AS cluster, round(min(dist), 6) AS distance FROM d GROUP BY 1")
def _(spark, sf):
    return rounded(C.nearest_center(_embeddings(spark, sf), _centres(spark, sf), "vec_id"), "distance")


_PAIR_SQL = f"""WITH {_CEN}, p AS (SELECT a.vec_id, a.cluster AS own, b.cluster AS other, sum(list_distance(a.z, b.z)) AS s, count(*) AS n FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
 ab AS (SELECT vec_id, max(s / n) FILTER (WHERE own = other) AS a, min(s / n) FILTER (WHERE own <> other) AS b FROM p GROUP BY 1)"""


@query("silhouette", _PAIR_SQL + " SELECT round(avg(CASE WHEN greatest(coalesce(a, 0), b) > 0 THEN (b - coalesce(a, 0)) / greatest(coalesce(a, 0), b) ELSE 0 END), 6) AS silhouette FROM ab")
def _(spark, sf):
    got = C.silhouette(spread(_embeddings(spark, sf), "vec_id"), 1, "exact")[0]
    return spark.createDataFrame([(round(got["silhouette"], 6),)], "silhouette double")


@query("silhouette_micro")
def _(spark, sf):
    got = C.silhouette(spread(_embeddings(spark, sf), "vec_id"), 1, "micro")[0]
    return spark.createDataFrame([(got["silhouette"], got["silhouette_method"])], "silhouette double, silhouette_method string")


@query("pairwise_distance", _PAIR_SQL + " SELECT own, other, round(avg(s / n), 5) AS mean_distance FROM p GROUP BY 1, 2")
def _(spark, sf):
    return rounded(C.pair_distances(spread(_embeddings(spark, sf), "vec_id")), "mean_distance", digits=5)


@query("ch_index", f"""WITH {_CEN}, o AS (SELECT j, avg(v) AS v FROM lng GROUP BY 1), ov AS (SELECT list(v ORDER BY j) AS c FROM o),
 k AS (SELECT count(*) AS k FROM cen), n AS (SELECT count(*) AS n FROM e), w AS (SELECT sum(power(list_distance(z, c), 2)) AS sw FROM e JOIN cen USING (cluster)),
 b AS (SELECT sum(m * power(list_distance(cen.c, ov.c), 2)) AS sb FROM cen JOIN (SELECT cluster, count(*) AS m FROM e GROUP BY 1) USING (cluster), ov)
 SELECT round((sb / (k - 1)) / (sw / (n - k)), 6) AS calinski_harabasz FROM w, b, k, n""")
def _(spark, sf):
    v = C.ch_db_indices(spread(_embeddings(spark, sf), "vec_id"))[0]
    return spark.createDataFrame([(round(v["calinski_harabasz"], 6),)], "calinski_harabasz double")


@query("db_index", f"""WITH {_CEN}, s AS (SELECT cluster, avg(list_distance(z, c)) AS s FROM e JOIN cen USING (cluster) GROUP BY 1),
 r AS (SELECT a.cluster, max((sa.s + sb.s) / list_distance(a.c, b.c)) AS r FROM cen a JOIN cen b ON a.cluster <> b.cluster JOIN s sa ON sa.cluster = a.cluster JOIN s sb ON sb.cluster = b.cluster GROUP BY 1)
 SELECT round(avg(r), 6) AS davies_bouldin FROM r""")
def _(spark, sf):
    v = C.ch_db_indices(spread(_embeddings(spark, sf), "vec_id"))[0]
    return spark.createDataFrame([(round(v["davies_bouldin"], 6),)], "davies_bouldin double")


_SOFT_SQL = f"""WITH {_CEN}, d AS (SELECT vec_id, cen.cluster, exp(-list_distance(z, c)) AS w FROM e CROSS JOIN cen),
 s AS (SELECT vec_id, cluster, w / sum(w) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC) AS r FROM d),
 a AS (SELECT vec_id, max(p) FILTER (WHERE cluster = 1) AS affinity, max(p) FILTER (WHERE r = 1) - max(p) FILTER (WHERE r = 2) AS certainty FROM s GROUP BY 1),
 q AS (SELECT quantile_cont(affinity, 0.3) AS lo, quantile_cont(affinity, 0.7) AS hi FROM a)"""


@query("soft_segment", _SOFT_SQL + """ SELECT vec_id, round(affinity, 6) AS affinity, round(certainty, 6) AS certainty,
 CASE WHEN affinity >= hi THEN '高亲和C2_文化深度型' WHEN affinity <= lo THEN '高亲和C1_价格权益型' ELSE '灰区_待探索' END AS soft_segment FROM a, q""")
def _(spark, sf):
    return rounded(C.soft_segment(_embeddings(spark, sf), _centres(spark, sf), F.lit(1), "vec_id"), "affinity", "certainty")


@query("cluster_names", oracle("survey", _seg_ctes() + f""", {_PROFILE_SQL}, a AS (SELECT cluster AS c1 FROM prof ORDER BY cognition_mean + motive_count DESC, cluster LIMIT 1),
 b AS (SELECT cluster AS c2 FROM prof, a WHERE cluster <> c1 ORDER BY promo_pref_count DESC, cluster LIMIT 1), d AS (SELECT cluster AS c3 FROM prof, a, b WHERE cluster NOT IN (c1, c2) ORDER BY performance_mean DESC, cluster LIMIT 1)
 SELECT cluster, CASE cluster WHEN c1 THEN '文化深度体验型' WHEN c2 THEN '价格优惠敏感型' WHEN c3 THEN '品质稳定复游型' ELSE '轻度打卡观光型' END AS cluster_name FROM prof, a, b, d"""))
def _(spark, sf):
    return C.cluster_names(D.group_profile(_segmented(spark, sf))).select("cluster", "cluster_name")


def _two_labelings(spark, sf):
    s = view(spark, sf, "survey").select("respondent_id", (F.col("C002") % 3 + 1).cast("int").alias("a"),
                                         (F.when(F.col("C001") == 1, F.col("C002") % 3 + 1).otherwise((F.col("C002") + 1) % 3 + 1)).cast("int").alias("b"))
    return s.select("respondent_id", F.col("a").alias("cluster")), s.select("respondent_id", F.col("b").alias("cluster"))


_WALK_SQL = """lab AS (SELECT cast(C002 % 3 + 1 AS int) AS ref_label, cast(CASE WHEN C001 = 1 THEN C002 % 3 + 1 ELSE (C002 + 1) % 3 + 1 END AS int) AS new_label FROM survey),
 walk AS (SELECT ref_label, new_label, count(*) AS n FROM lab GROUP BY 1, 2)"""


@query("label_crosswalk", oracle("survey", _WALK_SQL + " SELECT * FROM walk"))
def _(spark, sf):
    return C.label_crosswalk(*_two_labelings(spark, sf))


_ALIGN_SQL = _WALK_SQL + """, perms AS (SELECT * FROM (VALUES (1, [1, 2, 3]), (2, [1, 3, 2]), (3, [2, 1, 3]), (4, [2, 3, 1]), (5, [3, 1, 2]), (6, [3, 2, 1])) v(p, m)),
 sc AS (SELECT p, m, sum(CASE WHEN ref_label = m[new_label] THEN n ELSE 0 END) AS hit, sum(n) AS n FROM perms, walk GROUP BY 1, 2), best AS (SELECT m, hit, n FROM sc ORDER BY hit DESC, p LIMIT 1)"""


@query("align_labels", oracle("survey", _ALIGN_SQL + " SELECT k AS new_label, m[k] AS aligned_label, round(hit / n, 6) AS agreement FROM best, (SELECT unnest([1, 2, 3]) AS k)"))
def _(spark, sf):
    return rounded(C.align_labels(C.label_crosswalk(*_two_labelings(spark, sf))), "agreement")


# --- external validity ---------------------------------------------------------------------------
def _validity_sql():
    """Three segments keep every test at two degrees of freedom, whose tail is exp(-x / 2)."""
    parts, seen = [], set()
    for layer, _, code, variables in P.VALIDITY_LAYERS:
        where = "C008 IS NOT NULL" if code is None else f"C008 = {code}"
        for v, _, kind in variables:
            parts.append(f"SELECT '{layer}' AS layer_id, '{v}' AS variable, '{kind}' AS kind, {int(v not in seen)} AS score_included, cluster, {v} AS value FROM seg WHERE {where} AND {v} IS NOT NULL")
            seen.add(v)
    return scored_ctes() + ", seg AS (SELECT *, cast(C002 % 3 + 1 AS int) AS cluster FROM scored), x AS (" + " UNION ALL ".join(parts) + """),
 cells AS (SELECT layer_id, variable, kind, score_included, cluster, value, count(*) AS o FROM x GROUP BY ALL),
 m AS (SELECT *, sum(o) OVER (PARTITION BY layer_id, variable, cluster) AS rt, sum(o) OVER (PARTITION BY layer_id, variable, value) AS ct, sum(o) OVER (PARTITION BY layer_id, variable) AS n FROM cells),
 chi AS (SELECT layer_id, variable, score_included, max(n) AS n, 'chi2_cramers_v' AS test, max(n) * (sum(o::double * o / (rt::double * ct)) - 1) AS statistic, (count(DISTINCT cluster) - 1) * (count(DISTINCT value) - 1) AS df,
  least(count(DISTINCT cluster) - 1, count(DISTINCT value) - 1) AS mn FROM m WHERE kind = 'binary' GROUP BY ALL),
 rk AS (SELECT layer_id, variable, score_included, cluster, rank() OVER w + (count(*) OVER (PARTITION BY layer_id, variable, value) - 1) / 2.0::double AS r, value FROM x WHERE kind = 'ordinal' WINDOW w AS (PARTITION BY layer_id, variable ORDER BY value)),
 rs AS (SELECT layer_id, variable, score_included, cluster, count(*) AS mm, sum(r) AS rsum FROM rk GROUP BY ALL), tt AS (SELECT layer_id, variable, sum(c * c * c - c) AS t, sum(c) AS n FROM (SELECT layer_id, variable, value, count(*)::double AS c FROM rk GROUP BY ALL) GROUP BY ALL),
 kw AS (SELECT layer_id, variable, score_included, cast(max(n) AS bigint) AS n, 'kruskal_epsilon2' AS test, (12 / (max(n) * (max(n) + 1)) * sum(rsum * rsum / mm) - 3 * (max(n) + 1)) / (1 - max(t) / (max(n) * max(n) * max(n) - max(n))) AS statistic, count(*) - 1 AS df FROM rs JOIN tt USING (layer_id, variable) GROUP BY 1, 2, 3),
 te AS (SELECT layer_id, variable, score_included, cast(n AS bigint) AS n, test, statistic, df::double AS df, sqrt(greatest(statistic, 0) / (n * mn)) AS effect_size FROM chi UNION ALL
  SELECT layer_id, variable, score_included, n, test, statistic, df::double, greatest(0, (statistic - df) / (n - df - 1)) FROM kw),
 det AS (SELECT *, exp(-statistic / 2) AS p_value, cast(exp(-statistic / 2) < 0.05 AND effect_size >= 0.03 AS int) AS is_sig_with_effect FROM te)"""


def _three(spark, sf):
    return scored(spark, sf).withColumn("cluster", (F.col("C002") % 3 + 1).cast("int"))


_LABELS_SQL = ", lab AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{layer}', '{name}', '{v}', '{label}')" for layer, name, _, variables in P.VALIDITY_LAYERS for v, label, _ in variables) + ") v(layer_id, layer_name, variable, variable_label))"
_SIZES_SQL = ", sizes AS (" + " UNION ALL ".join(
    f"SELECT '{layer}' AS layer_id, '{name}' AS layer_name, count(*) AS layer_n FROM seg WHERE {'C008 IS NOT NULL' if code is None else f'C008 = {code}'}" for layer, name, code, _ in P.VALIDITY_LAYERS) + ")"


@query("external_validity", oracle("survey", _validity_sql() + _LABELS_SQL + " SELECT layer_id, layer_name, variable, variable_label, score_included, n, test, round(statistic, 5) AS statistic, df, round(effect_size, 6) AS effect_size, round(p_value, 6) AS p_value, is_sig_with_effect FROM det JOIN lab USING (layer_id, variable)"))
def _(spark, sf):
    d = V.external_validity(_three(spark, sf)).drop("cluster_stats")
    return rounded(d, "effect_size", "p_value").withColumn("statistic", r6("statistic", 5))


@query("external_validity_layers", oracle("survey", _validity_sql() + _SIZES_SQL + """ SELECT layer_id, layer_name, layer_n, count(det.variable) AS tested_vars_n, cast(coalesce(sum(is_sig_with_effect), 0) AS bigint) AS sig_vars_n,
 cast(coalesce(sum(is_sig_with_effect * score_included), 0) AS bigint) AS scored_sig_vars_n, round(avg(effect_size), 6) AS mean_effect,
 round(coalesce(sum(is_sig_with_effect), 0) + 10 * coalesce(avg(effect_size), 0), 6) AS layer_score FROM sizes LEFT JOIN det USING (layer_id) GROUP BY 1, 2, 3"""))
def _(spark, sf):
    rows = _three(spark, sf)
    return rounded(V.layer_summary(V.external_validity(rows), V.layer_sizes(rows)), "mean_effect", "layer_score")


# --- clustering ------------------------------------------------------------------------------------
@query("cluster_two_stage")
def _(spark, sf):
    out = None
    for name in C.FEATURE_SETS:
        _, labelled = C.cluster_two_stage(G.prepared(scored_once(spark, sf), name, "zscore"))
        sizes = labelled.select(F.posexplode("labels").alias("m", "cluster")).groupBy((F.col("m") + 2).alias("k"), "cluster").agg(F.count(F.lit(1)).alias("n"))
        part = sizes.withColumn("feature_set", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("cluster_two_stage_embeddings")
def _(spark, sf):
    frame = spread(_embeddings(spark, sf).select("vec_id", "z"), "vec_id")
    _, labelled = C.cluster_two_stage(frame, id_col="vec_id")
    return labelled.select("vec_id", F.col("labels")[0].alias("k2"), F.col("labels")[1].alias("k3"), F.col("labels")[2].alias("k4"))


@query("cluster_grid")
def _(spark, sf):
    metrics, _ = G.cluster_grid(scored_once(spark, sf))
    return metrics


@query("preprocess_compare")
def _(spark, sf):
    metrics, labels = G.cluster_grid(scored_once(spark, sf), ["enhanced"], ks=(2, 4))
    return G.preprocess_compare(metrics, labels, "enhanced")


def _main_model(spark, sf, k=2):
    """Raw imputed vectors, scaled labels and the scored rows of the enhanced + robust model."""
    s = scored_once(spark, sf)
    cols = C.ENHANCED
    features = C.feature_matrix(s, "enhanced")
    frame = C.vectors(C.scale_features(features, cols, "robust"), cols)
    centres, labelled = C.cluster_two_stage(frame, (k,))
    raw = C.vectors(C.impute_mean(features, cols), cols)
    return s, raw, frame, centres[k], labelled.select("respondent_id", F.col("labels")[0].alias("cluster"))


@query("stability_resample")
def _(spark, sf):
    _, raw, _, _, labels = _main_model(spark, sf)
    runs, _ = ST.stability_resample(raw, labels, 2)
    return runs


@query("stability_summary")
def _(spark, sf):
    _, raw, _, _, labels = _main_model(spark, sf)
    runs, _ = ST.stability_resample(raw, labels, 2)
    return ST.stability_summary(runs)


@query("person_consistency")
def _(spark, sf):
    _, raw, _, _, labels = _main_model(spark, sf)
    _, persons = ST.stability_resample(raw, labels, 2)
    return persons


@query("survey_model")
def _(spark, sf):
    c = clean(spark, sf)
    frame = C.vectors(C.scale_features(C.feature_matrix(c, "baseline"), C.BASELINE), C.BASELINE)
    _, labelled = C.cluster_two_stage(frame, (2,))
    return Q.survey_model(c, labelled.select("respondent_id", F.col("labels")[0].alias("cluster")))


def main_labels(spark, sf):
    """(respondent_id, cluster) of the main model: fitted and written once an application."""
    return once(spark, "main-labels", load(spark, sf, "orders"), lambda: _main_model(spark, sf)[4])


_GIVEN_MODEL = sorted({"attention_flag", "logic_flag", "invalid_union_flag"})


@query("survey_model_given", oracle("survey", clean_ctes() + " SELECT respondent_id, C008 AS visit_group, visit_depth_bin, " + ", ".join(_GIVEN_MODEL) + ", cast(C002 % 4 + 1 AS int) AS cluster_label, "
       + ", ".join(f"round({x}, 6) AS {x}" for x in [*P.SCORES, *P.COUNTS]) + " FROM clean"))
def _(spark, sf):
    labels = _segmented(spark, sf).select("respondent_id", "cluster")
    return rounded(Q.survey_model(clean(spark, sf), labels), *P.SCORES, *P.COUNTS)


_NAMES_SQL = """ a1 AS (SELECT cluster AS c1 FROM prof ORDER BY cognition_mean + motive_count DESC, cluster LIMIT 1),
 b1 AS (SELECT cluster AS c2 FROM prof, a1 WHERE cluster <> c1 ORDER BY promo_pref_count DESC, cluster LIMIT 1), d1 AS (SELECT cluster AS c3 FROM prof, a1, b1 WHERE cluster NOT IN (c1, c2) ORDER BY performance_mean DESC, cluster LIMIT 1),
 nm AS (SELECT cluster, CASE cluster WHEN c1 THEN '文化深度体验型' WHEN c2 THEN '价格优惠敏感型' WHEN c3 THEN '品质稳定复游型' ELSE '轻度打卡观光型' END AS cluster_name FROM prof, a1, b1, d1)"""


# Labels are given here, so that every column has a check; soft_segment_summary takes those of the fitted model.
@query("soft_segment_rows", oracle("survey", _seg_ctes() + f", {_PROFILE_SQL}, {_NAMES_SQL}, z AS (SELECT respondent_id, cluster, [{', '.join(_scale_sql('zscore', c) for c in _SF)}] AS z FROM seg)," + """
 zl AS (SELECT cluster, unnest(z) AS v, generate_subscripts(z, 1) AS j FROM z), zm AS (SELECT cluster, j, avg(v) AS v FROM zl GROUP BY 1, 2), zc AS (SELECT cluster AS k, list(v ORDER BY j) AS c FROM zm GROUP BY 1),
 zd AS (SELECT respondent_id, cluster, k, exp(-list_distance(z, c)) AS w FROM z CROSS JOIN zc), zs AS (SELECT *, w / sum(w) OVER (PARTITION BY respondent_id) AS p, row_number() OVER (PARTITION BY respondent_id ORDER BY w DESC) AS r FROM zd),
 za AS (SELECT respondent_id, cluster, max(p) FILTER (WHERE k = (SELECT c1 FROM a1)) AS affinity, max(p) FILTER (WHERE r = 1) - max(p) FILTER (WHERE r = 2) AS certainty FROM zs GROUP BY 1, 2),
 zq AS (SELECT quantile_cont(affinity, 0.3) AS lo, quantile_cont(affinity, 0.7) AS hi FROM za)
 SELECT respondent_id, cluster AS hard_cluster, cluster_name AS hard_cluster_name, round(affinity, 6) AS affinity, round(certainty, 6) AS certainty,
 CASE WHEN affinity >= hi THEN '高亲和C2_文化深度型' WHEN affinity <= lo THEN '高亲和C1_价格权益型' ELSE '灰区_待探索' END AS soft_segment FROM za JOIN nm USING (cluster), zq"""))
def _(spark, sf):
    s = _segmented(spark, sf)
    names = C.cluster_names(D.group_profile(s)).select("cluster", "cluster_name")
    z = F.array(*[F.col(c).cast("double") for c in _SF]).alias("z")
    frame = C.scale_features(s, _SF, "zscore", ("respondent_id", "cluster")).select("respondent_id", "cluster", z)
    means = frame.groupBy("cluster").agg(F.array(*[F.avg(F.col("z")[j]) for j in range(len(_SF))]).alias("center"))
    focus = names.filter(F.col("cluster_name") == P.CLUSTER_NAMES[0]).select("cluster").scalar()
    return rounded(C.soft_segment(frame, means, focus, hard="cluster", names=names), "affinity", "certainty")


@query("soft_segment_summary")
def _(spark, sf):
    s, _, frame, centres, labels = _main_model(spark, sf)
    names = C.cluster_names(D.group_profile(s.join(labels, "respondent_id"))).select("cluster", "cluster_name")
    focus = names.filter(F.col("cluster_name") == P.CLUSTER_NAMES[0]).select("cluster").scalar()
    return C.soft_summary(C.soft_segment(frame.join(labels, "respondent_id"), C.centre_table(spark, centres), focus, hard="cluster", names=names))


# --- the published result -----------------------------------------------------------------------------
_RESULT = ["raw", "clean", "model", "flow", "flagged", "rules", "metadata"]


@query("publish_snapshot", oracle("survey", flags_ctes() + f""" SELECT 'raw' AS tbl, count(*) AS n FROM flagged UNION ALL SELECT 'clean', count_if(invalid_union_flag = 0) FROM flagged UNION ALL SELECT 'model', count_if(invalid_union_flag = 0) FROM flagged
 UNION ALL SELECT 'flow', 3 UNION ALL SELECT 'flagged', count_if(invalid_union_flag = 1) FROM flagged UNION ALL SELECT 'rules', {len(P.FLAG_UNION)} UNION ALL SELECT 'metadata', 2 FROM (SELECT 1)"""))
def _(spark, sf):
    """The seven tables of a run under one version, counted as its readers see them."""
    f, c = flagged(spark, sf), clean(spark, sf)
    labels = C.cluster_two_stage(C.vectors(C.scale_features(C.feature_matrix(c, "baseline"), C.BASELINE), C.BASELINE), (2,))[1]
    counts = f.agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("invalid_union_flag") == 0).alias("n_samples_main"))
    rules = D.flag_totals(f, P.FLAG_UNION).withColumn("quality_profile", F.lit(Q.BALANCED))
    tables = {"raw": view(spark, sf, "survey"), "clean": c, "model": Q.survey_model(c, labels.select("respondent_id", F.col("labels")[0].alias("cluster"))), "flow": D.sample_flow(f, "revised"),
              "flagged": Q.dropped_rows(f), "rules": rules, "metadata": T.metrics_table(counts)}
    path = new_path(spark, "snapshot")
    T.publish_snapshot(tables, _RESULT, path, "v1")
    out = None
    for name, df in T.read_snapshot(spark, path).items():
        row = df.agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out
