"""Queries for counts, cross tables, reliability, importance-performance, sampling and evidence tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import scores as S
from ..functions.pvalues import chi2_p
from ..operators import describe as D, logit as L, moments as M, quality as Q, ranks as K, recode as R
from ..sources import tables as T
from ..sources.scratch import cut
from . import profile as P
from .newton_sql import newton, two_sided
from .queries_quality import clean, clean_ctes, flagged, flags_ctes, scored, scored_ctes, _PRED_SQL
from .queries_recode import sql_list, _sql_audit, _sql_log, _sql_values
from .registry import query, r6, rounded
from .views import load, oracle, view


def _long_sql(cols, src="scored", name="code"):
    return f"lng AS (SELECT unnest({[c for c in cols]}) AS item, unnest({sql_list(cols)}) AS {name} FROM {src})"


# --- the fitted base model ---------------------------------------------------------------------
def recursive(sql):
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


LOGIT_TERMS = ["Intercept", *P.LOGIT_FEATURES]


def _logit_rows(fit, y, where):
    cols = list(P.LOGIT_FEATURES.values())
    return f"SELECT '{fit}' AS fit, [1.0::double, {', '.join(f'{c}::double' for c in cols)}] AS x, {y}::double AS y FROM scored WHERE {where} AND " + " AND ".join(f"{c} IS NOT NULL" for c in cols)


_LOGIT_FITS = [("main", "visit_depth_bin", "true"), ("sens", "visit_depth_bin", "attention_flag = 0 AND logic_branch_flag = 0"), ("eq1", "visit_depth_bin", "C064 = 1 AND logic_branch_flag = 0"),
               ("eq5", "visit_depth_bin", "C064 = 5 AND logic_branch_flag = 0"), ("alt_stay", "cast(coalesce(C024 >= 3, false) AS int)", "true"), ("alt_spend", "cast(coalesce(C025 >= 3, false) AS int)", "true")]
_Q = len(LOGIT_TERMS)
# terms(fit, term, coef, std_err, z, p_value, odds_ratio, marginal_effect) of the base model on every sample and response, on features standardised over the fit's rows.
LOGIT_CTES = newton("fits", " UNION ALL ".join(_logit_rows(*f) for f in _LOGIT_FITS), _Q) + f""", unit AS (SELECT fit, [{', '.join(['1.0::double'] + [f'avg(x[{i}])' for i in range(2, _Q + 1)])}] AS mean,
  [{', '.join(['1.0::double'] + [f'CASE WHEN stddev_pop(x[{i}]) < 1e-10 THEN 1.0 ELSE stddev_pop(x[{i}]) END' for i in range(2, _Q + 1)])}] AS sd FROM fits_x GROUP BY fit),
 scaled AS (SELECT fit, list_transform(b, lambda v, i: CASE WHEN i = 1 THEN list_dot_product(b, mean) ELSE v * sd[i] END) AS b,
  list_transform(inv, lambda r, i: sqrt(greatest(1e-12, CASE WHEN i = 1 THEN list_dot_product(mean, list_transform(inv, lambda m: list_dot_product(m, mean))) ELSE r[i] * sd[i] * sd[i] END))) AS se FROM fits JOIN unit USING (fit)),
 raw_terms AS (SELECT fit, unnest({LOGIT_TERMS}) AS term, unnest(b) AS coef, unnest(se) AS std_err, 1 / (1 + exp(-b[1])) AS pb FROM scaled),
 terms AS (SELECT *, coef / std_err AS z, {two_sided('(coef / std_err)')} AS p_value, exp(coef) AS odds_ratio, CASE WHEN term <> 'Intercept' THEN coef * pb * (1 - pb) END AS marginal_effect FROM raw_terms)"""


def main_logit(spark, sf):
    """Terms of the base model fitted on the screened sample."""
    return L.logit_fit(scored(spark, sf), "visit_depth_bin", P.LOGIT_FEATURES, {"main": F.lit(True)})[0]


# --- counts -------------------------------------------------------------------------------
@query("freq_table", oracle("survey", scored_ctes() + ", " + _long_sql(P.SINGLES) + """,
 f AS (SELECT item, code, count(*) AS count FROM lng WHERE code IS NOT NULL GROUP BY 1, 2)
 SELECT item, code, count, round(count * 100.0::double / sum(count) OVER (PARTITION BY item), 6) AS pct FROM f"""))
def _(spark, sf):
    return rounded(D.freq_table(scored(spark, sf), P.SINGLES), "pct")


@query("freq_events", "SELECT event_type AS code, count(*) AS count, round(count(*) * 100.0::double / (SELECT count(*) FROM events), 6) AS pct FROM events GROUP BY 1")
def _(spark, sf):
    return rounded(D.freq_text(load(spark, sf, "events"), "event_type"), "pct")


_RATES_SQL = _long_sql(P.MULTIS) + """, rates AS (SELECT item, count_if(code = 1) AS selected_count, count(code) AS valid_n,
 count_if(code = 1) * 100.0::double / count(code) AS selected_pct FROM lng GROUP BY 1 HAVING count(code) > 0)"""


@query("multi_select_rate", oracle("survey", scored_ctes() + ", " + _RATES_SQL + " SELECT item, selected_count, valid_n, round(selected_pct, 6) AS selected_pct FROM rates"))
def _(spark, sf):
    return rounded(D.multi_select_rate(scored(spark, sf), P.MULTIS), "selected_pct")


_PAIRS = P.CROSS_PAIRS


def _pairs_sql(pairs=_PAIRS):
    return scored_ctes() + ", cells AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, {a} AS c1, {b} AS c2, count(*) AS o FROM scored WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b}" for a, b in pairs) + ")"


@query("crosstab_counts", oracle("survey", _pairs_sql() + """, g AS (SELECT DISTINCT a.var1, a.var2, a.c1, b.c2 FROM cells a JOIN cells b ON a.var1 = b.var1 AND a.var2 = b.var2)
 SELECT g.var1, g.var2, cast(g.c1 AS varchar) AS var1_code, cast(g.c2 AS varchar) AS var2_code, coalesce(o, 0) AS count FROM g LEFT JOIN cells USING (var1, var2, c1, c2)"""))
def _(spark, sf):
    return D.crosstab_counts(scored(spark, sf), _PAIRS)


_MARGIN_SQL = """m AS (SELECT *, sum(o) OVER (PARTITION BY var1, var2, c1) AS rt, sum(o) OVER (PARTITION BY var1, var2, c2) AS ct, sum(o) OVER (PARTITION BY var1, var2) AS n FROM cells)"""


@query("margin_totals", oracle("survey", _pairs_sql() + f", {_MARGIN_SQL}" + """ SELECT var1, var2, cast(c1 AS varchar) AS var1_code, cast(c2 AS varchar) AS var2_code, o AS count,
 cast(rt AS bigint) AS row_total, cast(ct AS bigint) AS col_total, cast(n AS bigint) AS grand_total FROM m"""))
def _(spark, sf):
    return D.margin_totals(D.pair_counts(scored(spark, sf), _PAIRS))


def _chi2_tables(spark, sf):
    a = D.pair_counts(scored(spark, sf), _PAIRS)
    return a.unionByName(D.pair_counts(load(spark, sf, "lineitem"), [("l_returnflag", "l_linestatus")]))


_CHI2_SQL = (_pairs_sql()[:-1] + " UNION ALL SELECT 'l_returnflag', 'l_linestatus', ascii(l_returnflag), ascii(l_linestatus), count(*) FROM lineitem GROUP BY 3, 4)" + f", {_MARGIN_SQL}" + """,
 full_grid AS (SELECT DISTINCT a.var1, a.var2, a.c1, b.c2, a.rt::double * b.ct / a.n AS e FROM m a JOIN m b ON a.var1 = b.var1 AND a.var2 = b.var2),
 x AS (SELECT var1, var2, sum((coalesce(o, 0) - e) * (coalesce(o, 0) - e) / e) AS chi2, sum(coalesce(o, 0)) AS n, count(DISTINCT c1) AS r, count(DISTINCT c2) AS c FROM full_grid LEFT JOIN cells USING (var1, var2, c1, c2) GROUP BY 1, 2),
 t AS (SELECT *, (r - 1) * (c - 1) AS dof FROM x)""")


@query("crosstab_chi2", oracle("survey", _CHI2_SQL + """ SELECT var1, var2, cast(n AS bigint) AS n, round(chi2, 6) AS chi2, dof,
 round(CASE WHEN chi2 <= 0 THEN 1.0::double ELSE 1 - least(1, list_sum(list_transform(range(400), lambda k: exp((dof / 2.0::double + k) * ln(chi2 / 2) - chi2 / 2 - lgamma(dof / 2.0::double + k + 1))))) END, 6) AS p_value FROM t"""))
def _(spark, sf):
    x = D.chi2_from_counts(_chi2_tables(spark, sf)).withColumn("p_value", chi2_p("chi2", F.col("dof").cast("double")))
    return rounded(x.drop("rows", "columns"), "chi2", "p_value")


@query("cramers_v", oracle("survey", _CHI2_SQL + " SELECT var1, var2, round(sqrt(greatest(chi2, 0) / (n * greatest(1, least(r - 1, c - 1)))), 6) AS cramers_v FROM t"))
def _(spark, sf):
    return rounded(K.cramers_v(D.chi2_from_counts(_chi2_tables(spark, sf))).select("var1", "var2", "cramers_v"), "cramers_v")


@query("two_by_two", oracle("survey", scored_ctes() + """, y AS (SELECT cast(C090 <= 2 AS int) AS a, cast(C091 <= 2 AS int) AS b FROM scored WHERE C090 IS NOT NULL AND C091 IS NOT NULL),
 t AS (SELECT count(*)::double AS n, count_if(a = 1 AND b = 1)::double AS p, count_if(a = 1 AND b = 0)::double AS q, count_if(a = 0 AND b = 1)::double AS r, count_if(a = 0 AND b = 0)::double AS s FROM y)
 SELECT 'n_total' AS metric, n AS value FROM t UNION ALL SELECT 'p_b_high_given_a_high', round(p / greatest(p + q, 1), 6) FROM t UNION ALL SELECT 'p_b_high_given_a_low', round(r / greatest(r + s, 1), 6) FROM t
 UNION ALL SELECT 'rate_diff', round(p / greatest(p + q, 1) - r / greatest(r + s, 1), 6) FROM t UNION ALL SELECT 'odds_ratio_unadjusted', round((p * s + 1e-9) / (q * r + 1e-9), 6) FROM t
 UNION ALL SELECT 'cell_1_1', p FROM t UNION ALL SELECT 'cell_1_0', q FROM t UNION ALL SELECT 'cell_0_1', r FROM t UNION ALL SELECT 'cell_0_0', s FROM t"""))
def _(spark, sf):
    s = scored(spark, sf).select(S.recode_binary_high("C090").alias("a"), S.recode_binary_high("C091").alias("b"))
    return rounded(D.two_by_two(s, "a", "b"), "value")


_BLOCK_CHECK = " UNION ALL ".join(
    f"SELECT '{name}' AS block, round({len(items)} / ({len(items)} - 1.0::double) * (1 - ({' + '.join(f'var_samp({x})' for x in items)}) / var_samp({' + '.join(items)})), 6) AS alpha, "
    f"count(*) AS n_complete FROM clean WHERE {' + '.join(items)} IS NOT NULL" for name, items in P.RELIABILITY_BLOCKS.items())


@query("cronbach_alpha", oracle("survey", clean_ctes() + " " + _BLOCK_CHECK))
def _(spark, sf):
    return rounded(M.cronbach_alpha(clean(spark, sf), P.RELIABILITY_BLOCKS), "alpha")


_CORR = P.SCALE_ITEMS


@query("corr_matrix", oracle("survey", scored_ctes() + f", z AS MATERIALIZED (SELECT {sql_list(_CORR)} AS v FROM scored WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _CORR) + f"""), k AS (SELECT {list(_CORR)} AS names)
 SELECT names[i] AS var1, names[j] AS var2, count(*) AS n, round(corr(v[i], v[j]), 6) AS corr FROM z, k, range(1, {len(_CORR) + 1}) a(i), range(1, {len(_CORR) + 1}) b(j) WHERE i <= j GROUP BY names, i, j"""))
def _(spark, sf):
    return rounded(M.corr_matrix(scored(spark, sf), _CORR), "corr")


@query("safe_corr", oracle("survey", "SELECT count(*) AS n, round(corr(C066, C076), 6) AS corr FROM survey WHERE C066 IS NOT NULL AND C076 IS NOT NULL"))
def _(spark, sf):
    return rounded(M.safe_corr(view(spark, sf, "survey"), "C066", "C076"), "corr")


# Two variables: R = [[1, r], [r, 1]] plus the ridge gives every figure in closed form; p has one degree of freedom.
@query("kmo_bartlett_pair", oracle("survey", """z AS (SELECT count(*) AS n, corr(C066, C076) AS r FROM survey WHERE C066 IS NOT NULL AND C076 IS NOT NULL)
 SELECT n AS n_complete, round(r * r / (r * r + (r / (1 + 1e-8)) * (r / (1 + 1e-8))), 6) AS kmo, round(-(n - 1 - 9 / 6.0::double) * ln((1 + 1e-8) * (1 + 1e-8) - r * r), 4) AS bartlett_chi2, 1 AS bartlett_df FROM z"""))
def _(spark, sf):
    k = M.kmo_bartlett(view(spark, sf, "survey"), ["C066", "C076"]).drop("bartlett_p")
    return k.withColumns({"kmo": r6("kmo"), "bartlett_chi2": r6("bartlett_chi2", 4)})


@query("kmo_bartlett")
def _(spark, sf):
    return M.kmo_bartlett(clean(spark, sf), P.SCALE_ITEMS)


@query("kmo_bartlett_items")
def _(spark, sf):
    return M.kmo_bartlett(view(spark, sf, "sem"), P.SEM_COLUMNS)


@query("vif", oracle("survey", """z AS (SELECT corr(C066, C076) AS r FROM survey WHERE C066 IS NOT NULL AND C076 IS NOT NULL)
 SELECT unnest(['C066', 'C076']) AS feature, round(r * r, 6) AS r2, round(1 / (1 - r * r), 6) AS vif FROM z"""))
def _(spark, sf):
    return rounded(M.vif(view(spark, sf, "survey"), {"C066": "C066", "C076": "C076"}), "r2", "vif")


@query("vif_logit_features")
def _(spark, sf):
    return M.vif(scored(spark, sf), P.LOGIT_FEATURES)


# --- flow and totals --------------------------------------------------------------------------
@query("sample_flow", oracle("survey", flags_ctes() + """ SELECT 'main' AS layout, 1 AS step_no, 'raw_input' AS step, count(*) AS n FROM flagged UNION ALL
 SELECT 'main', 2, 'invalid_removed', count_if(invalid_union_flag = 1) FROM flagged UNION ALL SELECT 'main', 3, 'main_analysis', count_if(invalid_union_flag = 0) FROM flagged UNION ALL
 SELECT 'main', 4, 'sensitivity', count_if(invalid_union_flag = 0 AND attention_flag = 0 AND logic_branch_flag = 0) FROM flagged UNION ALL
 SELECT 'revised', 1, 'raw_input', count(*) FROM flagged UNION ALL SELECT 'revised', 2, 'invalid_revised', count_if(invalid_union_flag = 1) FROM flagged UNION ALL
 SELECT 'revised', 3, 'remain_revised', count_if(invalid_union_flag = 0) FROM flagged"""))
def _(spark, sf):
    f = flagged(spark, sf)
    both = [D.sample_flow(f, x).select(F.lit(x).alias("layout"), "step_no", "step", "n") for x in ("main", "revised")]
    return both[0].unionByName(both[1])


_ALL_FLAGS = [*P.LEGACY_FLAGS, *P.FLAG_UNION, "invalid_union_flag"]


@query("flag_totals", oracle("survey", flags_ctes() + " " + " UNION ALL ".join(f"SELECT '{f}' AS flag, cast(sum({f}) AS bigint) AS n FROM flagged" for f in _ALL_FLAGS)))
def _(spark, sf):
    return D.flag_totals(flagged(spark, sf), _ALL_FLAGS)


_CONVERTED = ["n_rows", "unknown_value_count", "unknown_value_rate", "other_text_count", "branch_conflict_count", "branch_conflict_rate", "conversion_integrity"]
_SCREEN_METRICS = oracle("survey", flags_ctes() + " SELECT 'n_samples' AS metric, count(*)::double AS value FROM flagged UNION ALL SELECT 'n_samples_main', count_if(invalid_union_flag = 0)::double FROM flagged UNION ALL "
                         + " UNION ALL ".join(f"SELECT '{f}_n', sum({f})::double FROM flagged" for f in _ALL_FLAGS))
_MODEL_METRICS = "SELECT m.metric, m.value FROM (" + oracle("survey", clean_ctes() + " " + _BLOCK_CHECK) + """) c,
 LATERAL (SELECT 'alpha_' || block AS metric, alpha::double AS value UNION ALL SELECT 'alpha_n_' || block, n_complete::double) m"""
_CONVERSION_METRICS = "SELECT m.metric, m.value FROM (" + oracle("raw64", _sql_log() + _sql_audit()) + ") c, LATERAL (" + " UNION ALL ".join(
    f"SELECT 'conversion_{x}' AS metric, c.{x}::double AS value" for x in _CONVERTED) + ") m"


@query("run_metrics", f"""WITH steps AS (SELECT 'screen' AS step, * FROM ({_SCREEN_METRICS}) UNION ALL SELECT 'reliability', * FROM ({_MODEL_METRICS}) UNION ALL SELECT 'conversion', * FROM ({_CONVERSION_METRICS}))
 SELECT step, metric, value FROM steps UNION ALL SELECT step, 'step_done', cast(count(*) > 0 AS int)::double FROM steps GROUP BY 1""")
def _(spark, sf):
    row = flagged(spark, sf).agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("invalid_union_flag") == 0).alias("n_samples_main"),
                                 *[F.sum(f).alias(f"{f}_n") for f in _ALL_FLAGS])
    alpha = rounded(M.cronbach_alpha(clean(spark, sf), P.RELIABILITY_BLOCKS), "alpha")
    audit = rounded(R.conversion_audit(view(spark, sf, "raw64"), P), "unknown_value_rate", "branch_conflict_rate", "conversion_integrity", digits=8)
    return T.run_metrics({
        "screen": T.metrics_table(row),
        "reliability": T.metrics_table(alpha.select("block", F.col("alpha"), F.col("n_complete").alias("alpha_n")), ["block"]).select(
            F.concat_ws("_", "metric", "block").alias("metric"), "value"),
        "conversion": T.metrics_table(audit.select(*[F.col(x).alias(f"conversion_{x}") for x in _CONVERTED]))})


@query("item_means", oracle("survey", scored_ctes() + ", " + _long_sql(P.IMPORTANCE + P.PERFORMANCE) + " SELECT item, round(avg(code), 6) AS mean FROM lng GROUP BY 1"))
def _(spark, sf):
    return rounded(D.item_means(scored(spark, sf), P.IMPORTANCE + P.PERFORMANCE), "mean")


IPA_CTE = "pairs AS (" + " UNION ALL ".join(
    f"SELECT {i + 1} AS item_no, {66 + i} AS importance_col, {76 + i} AS performance_col, avg(C{66 + i:03d}) AS im, avg(C{76 + i:03d}) AS pm FROM scored" for i in range(10)) + """),
 cut AS (SELECT avg(importance_mean) AS ic, avg(performance_mean) AS pc FROM scored),
 ipa AS (SELECT item_no, importance_col, performance_col, im, pm, pm - im AS gap, CASE WHEN im >= ic AND pm >= pc THEN 'Q1_优势区' WHEN im < ic AND pm >= pc THEN 'Q2_维持区'
 WHEN im < ic AND pm < pc THEN 'Q3_机会区' ELSE 'Q4_改进区' END AS quadrant FROM pairs, cut)"""


@query("ipa", oracle("survey", scored_ctes() + f", {IPA_CTE} SELECT item_no, importance_col, performance_col, round(im, 6) AS importance_mean, round(pm, 6) AS performance_mean, round(gap, 6) AS gap_perf_minus_imp, quadrant FROM ipa"))
def _(spark, sf):
    return rounded(D.ipa(scored(spark, sf)), "importance_mean", "performance_mean", "gap_perf_minus_imp")


@query("ipa_sensitivity", oracle("survey", scored_ctes() + f""", {IPA_CTE}, th AS (SELECT '均值阈值' AS method, avg(im) AS i, avg(pm) AS p FROM pairs UNION ALL SELECT '中位数阈值', median(im), median(pm) FROM pairs),
 q AS (SELECT *, CASE WHEN im >= i AND pm >= p THEN 'Q1_优势区' WHEN im < i AND pm >= p THEN 'Q2_维持区' WHEN im < i AND pm < p THEN 'Q3_机会区' ELSE 'Q4_改进区' END AS quadrant FROM pairs, th)
 SELECT method, item_no, importance_col AS col_idx, round(im, 6) AS importance_mean, round(pm, 6) AS performance_mean, round(i, 6) AS importance_threshold, round(p, 6) AS performance_threshold, quadrant,
 cast(quadrant = 'Q4_改进区' AS int) AS is_priority FROM q"""))
def _(spark, sf):
    return rounded(D.ipa_sensitivity(scored(spark, sf)), "importance_mean", "performance_mean", "importance_threshold", "performance_threshold")


@query("ipa_priority", oracle("survey", scored_ctes() + f", {IPA_CTE} SELECT item_no, round(gap, 6) AS gap_perf_minus_imp FROM ipa WHERE quadrant = 'Q4_改进区' ORDER BY gap, item_no LIMIT 3"))
def _(spark, sf):
    return D.ipa_priority(D.ipa(scored(spark, sf)), 3).select("item_no", r6("gap_perf_minus_imp").alias("gap_perf_minus_imp"))


_OPT_BLOCKS = {"projects": P.PROJECTS, "promos": P.PROMOS}
_TOP_SQL = _RATES_SQL + """, top AS (SELECT CASE WHEN item <= 'C100' THEN 'projects' ELSE 'promos' END AS block, item, selected_count, valid_n, selected_pct,
 row_number() OVER (PARTITION BY item <= 'C100' ORDER BY selected_pct DESC, item) AS rank FROM rates WHERE item BETWEEN 'C092' AND 'C107' QUALIFY rank <= 3)"""


@query("top_options", oracle("survey", scored_ctes() + ", " + _TOP_SQL + " SELECT block, item, cast(rank AS int) AS rank, round(selected_pct, 6) AS selected_pct FROM top"))
def _(spark, sf):
    top = D.top_options(D.multi_select_rate(scored(spark, sf), P.PROJECTS + P.PROMOS), _OPT_BLOCKS)
    return top.select("block", "item", "rank", r6("selected_pct").alias("selected_pct"))


# --- segments (the embedding label and the visit answers stand in as given segment labels) ---------
def _segmented(spark, sf):
    return scored(spark, sf).withColumn("cluster", (F.col("C002") % 4 + 1).cast("int"))


def _seg_ctes():
    return scored_ctes() + ", seg AS (SELECT *, cast(C002 % 4 + 1 AS int) AS cluster FROM scored)"


_PROFILE_SQL = "prof AS (SELECT cluster, count(*) AS n, " + ", ".join(f"avg({x}) AS {x}" for x in D.PROFILE_FIELDS) + ", count(*) * 100.0::double / (SELECT count(*) FROM seg) AS share_pct FROM seg GROUP BY 1)"


@query("group_profile", oracle("survey", _seg_ctes() + f", {_PROFILE_SQL} SELECT cluster, n, " + ", ".join(f"round({x}, 6) AS {x}" for x in [*D.PROFILE_FIELDS, "share_pct"]) + " FROM prof"))
def _(spark, sf):
    return rounded(D.group_profile(_segmented(spark, sf)), *D.PROFILE_FIELDS, "share_pct")


@query("cluster_sizes", "SELECT string_agg(cast(n AS varchar), '|' ORDER BY label) AS cluster_size_distribution FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
def _(spark, sf):
    return D.cluster_sizes(D.segment_counts(load(spark, sf, "embeddings"), "label"), label="label")


_SV = {"C036": "binary", "C044": "binary", "C090": "ordinal"}


@query("stats_by_cluster", oracle("survey", _seg_ctes() + ", st AS (" + " UNION ALL ".join(
    f"SELECT '{v}' AS variable, cluster, avg({f'cast({v} = 1 AS int)' if k == 'binary' else v}) AS m FROM seg WHERE {v} IS NOT NULL GROUP BY cluster" for v, k in _SV.items())
    + ") SELECT variable, string_agg('C' || cluster || '=' || format('{:.3f}', m), '|' ORDER BY cluster) AS cluster_stats FROM st GROUP BY 1"))
def _(spark, sf):
    return D.stats_by_cluster(_segmented(spark, sf), _SV)


@query("sampling_bias", oracle("survey", """g AS (SELECT * FROM (VALUES (1, '到访层', 600), (2, '未到访层', 400)) v(code, stratum, target_n)),
 a AS (SELECT C008 AS code, count(*) AS actual_n FROM survey GROUP BY 1), b AS (SELECT stratum, target_n, actual_n, target_n / 1000.0::double AS t, actual_n::double / sum(actual_n) OVER () AS s FROM g JOIN a USING (code))
 SELECT stratum, cast(target_n AS bigint) AS target_n, actual_n, round(t * 100, 6) AS target_pct, round(s * 100, 6) AS actual_pct, round((s - t) * 100, 6) AS bias_points, round(actual_n / target_n, 6) AS actual_to_target, round(t / s, 6) AS weight FROM b
 UNION ALL SELECT '合计', cast(sum(target_n) AS bigint), cast(sum(actual_n) AS bigint), 100, 100, 0, round(sum(actual_n) / sum(target_n), 6), NULL FROM b"""))
def _(spark, sf):
    return rounded(D.sampling_bias(view(spark, sf, "survey"), spark), "target_pct", "actual_pct", "bias_points", "actual_to_target", "weight")


@query("sample_size_plan", oracle("survey", """t AS (SELECT 1.96::double * 1.96 * 0.25 / (0.045::double * 0.045) AS n0, count(C001)::double AS n FROM survey), u AS (SELECT n, n0, n0 / (1 + (n0 - 1) / 13000000) AS f FROM t)
 SELECT 'n0' AS step, round(n0, 6) AS value FROM u UNION ALL SELECT 'n_fpc', round(f, 6) FROM u UNION ALL SELECT 'n_deff', round(f * 1.5, 6) FROM u UNION ALL SELECT 'n_issue', round(f * 1.5 / 0.85, 6) FROM u UNION ALL SELECT 'n_final', n FROM u"""))
def _(spark, sf):
    return rounded(D.sample_size_plan(view(spark, sf, "survey")), "value")


@query("cluster_imbalance", """WITH s AS (SELECT 'hard_cluster' AS type, o_orderstatus AS segment, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'soft_segment', event_type, count(*) FROM events GROUP BY 2),
 t AS (SELECT *, n * 100.0::double / sum(n) OVER (PARTITION BY type) AS share_pct FROM s)
 SELECT type, segment, n, round(share_pct, 6) AS share_pct, CASE WHEN share_pct >= 70 THEN '偏高' WHEN share_pct <= CASE type WHEN 'hard_cluster' THEN 20 ELSE 15 END THEN '偏低' ELSE '正常' END AS imbalance_risk,
 CASE WHEN type = 'hard_cluster' THEN CASE WHEN share_pct >= 70 THEN '该簇执行分层触达上限，避免资源过度集中' WHEN share_pct <= 20 THEN '该簇增加探索预算与素材覆盖，防止样本稀疏' ELSE '按常规节奏执行' END
 ELSE CASE WHEN share_pct >= 70 THEN '该软分层占比高，建议按渠道或人群再细分后投放' WHEN share_pct <= 15 THEN '该软分层样本偏少，建议滚动累积样本并延长实验周期' ELSE '可直接用于AB分层投放' END END AS action_hint FROM t""")
def _(spark, sf):
    a = D.segment_counts(load(spark, sf, "orders"), "o_orderstatus").select(F.lit("hard_cluster").alias("type"), F.col("o_orderstatus").alias("segment"), "n")
    b = D.segment_counts(load(spark, sf, "events"), "event_type").select(F.lit("soft_segment").alias("type"), F.col("event_type").alias("segment"), "n")
    s = a.unionByName(b).withColumn("share_pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("type")))
    return rounded(D.cluster_imbalance(s), "share_pct")


@query("weighted_metric", "WITH g AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) SELECT p, round(sum(n * m) / sum(n), 4) AS m FROM g GROUP BY 1")
def _(spark, sf):
    g = load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m"))
    return rounded(D.weighted_metric(g, "m", by=["p"]), "m", digits=4)


# --- windows on samples --------------------------------------------------------------------------
def sql_hash(id_expr, seed):
    x = f"((({id_expr}) % 2147483648) * 2654435761 + ({seed}) * 40503) % 4294967296"
    x = f"(xor({x}, ({x}) >> 16) * 2146121005) % 4294967296"
    x = f"(xor({x}, ({x}) >> 15) * 830770091) % 4294967296"
    return f"xor({x}, ({x}) >> 16)"


@query("stratified_folds", oracle("survey", f"""h AS (SELECT respondent_id, cast(C090 <= 2 AS int) AS y, {sql_hash('respondent_id', 53)} AS h FROM survey WHERE C090 IS NOT NULL)
 SELECT respondent_id, y, cast((row_number() OVER (PARTITION BY y ORDER BY h, respondent_id) - 1) % 5 AS int) AS fold FROM h"""))
def _(spark, sf):
    s = view(spark, sf, "survey").select("respondent_id", S.recode_binary_high("C090").cast("int").alias("y")).filter("y is not null")
    return K.stratified_folds(s, "y", 5, 53)


# The sample size rounds halves to even, as the reference's round() does.
@query("resample_exact", oracle("survey", f"""r AS (SELECT respondent_id, run FROM survey, (SELECT unnest(range(1, 121)) AS run)),
 h AS (SELECT respondent_id, run, row_number() OVER (PARTITION BY run ORDER BY {sql_hash('respondent_id', 'run')}, respondent_id) AS k FROM r)
 SELECT run, count(*) AS n, cast(sum(respondent_id) AS bigint) AS id_sum, max(respondent_id) AS id_max FROM h WHERE k <= (SELECT round_even(0.7::double * count(*), 0) FROM survey) GROUP BY 1"""))
def _(spark, sf):
    from ..operators.stability import resample_cuts, resample_summary
    s = cut(view(spark, sf, "survey").select("respondent_id"))
    return resample_summary(s, resample_cuts(s, 120, 0.7, min_n=50)).withColumn("run", F.col("run").cast("bigint"))


# --- sorts, unions, evidence ------------------------------------------------------------------------
_METRICS_SQL = """mt AS (SELECT o_orderpriority AS model, 1 + cast(substr(o_orderpriority, 1, 1) AS int) AS k, avg(o_totalprice) AS silhouette, stddev_samp(o_totalprice) AS db, count(*) AS score FROM orders GROUP BY 1)"""


def _metrics(spark, sf):
    return load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(
        F.avg("o_totalprice").alias("silhouette"), F.stddev_samp("o_totalprice").alias("db"), F.count(F.lit(1)).alias("score")).withColumn(
        "k", F.substring("model", 1, 1).cast("int") + 1)


@query("best_k", f"""WITH {_METRICS_SQL} SELECT 'first' AS rule, (SELECT k FROM mt ORDER BY silhouette DESC, k LIMIT 1) AS k UNION ALL
 SELECT 'db_tiebreak', (SELECT k FROM mt ORDER BY silhouette DESC, db, k LIMIT 1)""")
def _(spark, sf):
    from ..operators.cluster import best_k
    m = _metrics(spark, sf)
    a, b = best_k(m, ["k"]), best_k(m, ["db", "k"])
    return a.select(F.lit("first").alias("rule"), "k").unionByName(b.select(F.lit("db_tiebreak").alias("rule"), "k"))


@query("preferred_model", f"WITH {_METRICS_SQL} SELECT model, k, score FROM mt WHERE k >= 4 ORDER BY score DESC, silhouette DESC, db LIMIT 1")
def _(spark, sf):
    from ..operators.cluster import preferred_model
    return preferred_model(_metrics(spark, sf).filter("k >= 4"), "score", "silhouette", "db").select("model", "k", "score")


@query("sorted_outputs", "SELECT o_orderpriority AS model, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY abs(o_totalprice - 200000) DESC, o_orderkey) AS pos FROM orders")
def _(spark, sf):
    # Positions of the sorted table, numbered without sorting a whole model in one task.
    o = load(spark, sf, "orders").withColumn("_a", F.abs(F.col("o_totalprice") - 200000))
    out = K.numbered(o.withColumn("_down", -F.col("_a")), ["o_orderpriority"], ["_down", "o_orderkey"], "pos")
    return out.select(F.col("o_orderpriority").alias("model"), "o_orderkey", "o_totalprice", "pos").orderBy("model", "pos")


@query("union_results", f"""WITH {_PRED_SQL} SELECT 'a' AS model_id, l_orderkey, l_linenumber, y, round(p, 6) AS p FROM pred WHERE l_linenumber <= 3
 UNION ALL SELECT 'b', l_orderkey, l_linenumber, 1 - y, round(1 - p, 6) FROM pred WHERE l_linenumber > 3""")
def _(spark, sf):
    from .queries_quality import _pred
    p = _pred(spark, sf)
    a = p.filter("l_linenumber <= 3").select(F.lit("a").alias("model_id"), "l_orderkey", "l_linenumber", "y", r6("p").alias("p"))
    b = p.filter("l_linenumber > 3").select(r6(1 - F.col("p")).alias("p"), (1 - F.col("y")).alias("y"), "l_linenumber", "l_orderkey", F.lit("b").alias("model_id"))
    return a.unionByName(b)


@query("distinct_levels", oracle("survey", scored_ctes() + ", " + _long_sql(P.MCA_ITEMS) + " SELECT DISTINCT item, code FROM lng WHERE code IS NOT NULL"))
def _(spark, sf):
    return D.long_items(scored(spark, sf), P.MCA_ITEMS, value="code").distinct()


def _evidence(spark, sf):
    s = scored(spark, sf)
    items = P.item_table(spark)
    pri = R.join_item_text(D.ipa_priority(D.ipa(s), 3).withColumn("col_idx", F.col("importance_col")), items)
    pri = pri.withColumn("rank", F.row_number().over(W.partitionBy().orderBy("gap_perf_minus_imp", "item_no")))
    top = R.join_item_text(D.top_options(D.multi_select_rate(s, P.PROJECTS + P.PROMOS), _OPT_BLOCKS).withColumn("col_idx", D.item_number()), items)
    names = spark.createDataFrame([(f[0], f[1]) for f in P.FIELD_MAP], "term string, label string")
    effects = L.top_effects(main_logit(spark, sf)).join(F.broadcast(names), "term", "left").withColumn("item_text", F.coalesce("label", "term"))
    effects = effects.withColumn("rank", F.row_number().over(W.partitionBy().orderBy(F.abs("coef").desc(), "term")))
    return D.evidence_table([D.evidence_rows("ipa", pri, 1), D.evidence_rows("project", top.filter("block = 'projects'"), 2),
                             D.evidence_rows("promo", top.filter("block = 'promos'"), 3), D.evidence_rows("logit", effects, 4)])


_TEXTS_SQL = f"texts AS (SELECT * FROM {_sql_values([(i, t) for i, t in enumerate(P.ITEM_TEXTS, 1)], 'col_idx, item_text')})"
_EVIDENCE_SQL = f""", {LOGIT_CTES}, fm AS (SELECT * FROM {_sql_values([(f[0], f[1]) for f in P.FIELD_MAP], 'term, label')}), {IPA_CTE}, {_TOP_SQL}, {_TEXTS_SQL},
 src AS (SELECT 1 AS source_no, row_number() OVER (ORDER BY gap, item_no) AS rank, '高重要度低满意：' || item_text AS problem,
  '重要度均值' || format('{{:.3f}}', im) || '，满意度均值' || format('{{:.3f}}', pm) || '，差值' || format('{{:.3f}}', gap) AS evidence, '纳入季度优先整改清单，配置专项预算和KPI跟踪。' AS suggestion
  FROM ipa JOIN texts ON importance_col = col_idx WHERE quadrant = 'Q4_改进区' QUALIFY rank <= 3 UNION ALL
 SELECT 4, row_number() OVER (ORDER BY abs(coef) DESC, term) AS rank, '深入游览关键影响因子：' || coalesce(label, term) || CASE WHEN coef > 0 THEN '（正向）' ELSE '（负向）' END,
  'coef=' || format('{{:.3f}}', coef) || ', OR=' || format('{{:.3f}}', odds_ratio) || ', p=' || format('{{:.4f}}', p_value), '围绕该因子制定分层触达与产品优化策略，作为转化抓手。'
  FROM terms LEFT JOIN fm USING (term) WHERE fit = 'main' AND term <> 'Intercept' AND p_value < 0.05 QUALIFY rank <= 3 UNION ALL
 SELECT CASE block WHEN 'projects' THEN 2 ELSE 3 END, rank, CASE block WHEN 'projects' THEN '新增项目需求集中于：' ELSE '优惠机制偏好集中于：' END || item_text,
  '选择率' || format('{{:.2f}}', selected_pct) || '%（' || selected_count || '/' || valid_n || '）',
  CASE block WHEN 'projects' THEN '优先开发该类中医药文旅产品，做小规模A/B试点后扩容。' ELSE '将高偏好优惠形式与核心产品绑定，提升转化和复游。' END FROM top JOIN texts ON cast(substr(item, 2) AS int) = col_idx),
 ev AS (SELECT cast(row_number() OVER (ORDER BY source_no, rank) AS int) AS priority, problem, evidence, suggestion FROM src)"""


@query("evidence_table", recursive(oracle("survey", scored_ctes() + _EVIDENCE_SQL + " SELECT * FROM ev")))
def _(spark, sf):
    return _evidence(spark, sf)


@query("priority_number", recursive(oracle("survey", scored_ctes() + _EVIDENCE_SQL + " SELECT priority, problem FROM ev")))
def _(spark, sf):
    return _evidence(spark, sf).select("priority", "problem")


@query("action_matrix", recursive(oracle("survey", scored_ctes() + _EVIDENCE_SQL + f""", rules AS (SELECT * FROM {_sql_values(P.ACTION_RULES, 'rule_no, keyword, owner, time_window, kpi')}),
 hit AS (SELECT priority, arg_min(owner, rule_no) AS owner, arg_min(time_window, rule_no) AS time_window, arg_min(kpi, rule_no) AS kpi FROM ev JOIN rules ON contains(problem, keyword) GROUP BY 1)
 SELECT priority, problem, evidence, suggestion AS action, coalesce(owner, '街区运营中心') AS owner, coalesce(time_window, '0-3个月') AS time_window, coalesce(kpi, '相关指标较基线提升>=10%') AS kpi,
 '预算审批+跨部门协同' AS depends_on FROM ev LEFT JOIN hit USING (priority)""")))
def _(spark, sf):
    return D.action_matrix(_evidence(spark, sf), P.action_rule_table(spark))


@query("soft_quantile_cut", "SELECT round(quantile_cont(o_totalprice, 0.3), 4) AS q_low, round(quantile_cont(o_totalprice, 0.7), 4) AS q_high FROM orders")
def _(spark, sf):
    from ..operators.cluster import soft_quantile_cut
    return soft_quantile_cut(load(spark, sf, "orders"), "o_totalprice").select(r6("q_low", 4).alias("q_low"), r6("q_high", 4).alias("q_high"))


@query("top2_margin", "WITH u AS (SELECT vec_id, unnest(embedding) AS v FROM embeddings), r AS (SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC) AS k FROM u) "
                      "SELECT vec_id, round(max(v) FILTER (WHERE k = 1)::double - max(v) FILTER (WHERE k = 2)::double, 6) AS margin FROM r GROUP BY 1")
def _(spark, sf):
    from ..operators.cluster import top2_margin
    return load(spark, sf, "embeddings").select("vec_id", r6(top2_margin(F.col("embedding").cast("array<double>"))).alias("margin"))
