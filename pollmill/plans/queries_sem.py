"""Queries for correspondence analysis and path models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mca as A, sem as E
from . import profile as P
from .queries_cluster import main_labels
from .queries_quality import scored, scored_ctes
from .queries_recode import SQL_ERF
from .registry import query, r6, rounded
from .views import load, oracle, view

_COLS = [*P.SEM_COLUMNS, "R_sum"]



def _sem(spark, sf):
    return view(spark, sf, "sem").withColumn("R_sum", (F.col("R_visit") + F.col("R_recommend")) / 2.0)


def _subsets():
    return {"main": F.lit(True), "eq1": F.col("C064") == 1, "not_eq1": F.col("C064") != 1, "eq5": F.col("C064") == 5}


def _fits(spark, sf, models=None, subsets=("main",)):
    every = _subsets()
    m = E.sem_moments(_sem(spark, sf), _COLS, {s: every[s] for s in subsets})
    return E.sem_fit(m, _COLS, {k: P.SEM_SPECS[k] for k in (models or P.SEM_SPECS)})


# --- correspondence analysis ---------------------------------------------------------------
@query("mca_burt", oracle("survey", "z AS (SELECT * FROM survey WHERE C007 IS NOT NULL AND C008 IS NOT NULL AND C090 IS NOT NULL) " + " UNION ALL ".join(
    f"SELECT '{a}' AS item1, cast({a} AS int) AS level1, '{b}' AS item2, cast({b} AS int) AS level2, count(*) AS count FROM z GROUP BY 2, 4"
    for i, a in enumerate(["C007", "C008", "C090"]) for b in ["C007", "C008", "C090"][i:])))
def _(spark, sf):
    return A.burt_counts(view(spark, sf, "survey"), ["C007", "C008", "C090"])


@query("mca_columns")
def _(spark, sf):
    return A.mca_columns(scored(spark, sf), P.MCA_ITEMS)[0]


# The total inertia of q items with J levels in all is (J - q) / q.
@query("mca_inertia", oracle("survey", scored_ctes() + " SELECT round((" + " + ".join(f"count(DISTINCT {c})" for c in P.MCA_ITEMS) + f" - {len(P.MCA_ITEMS)}) / {len(P.MCA_ITEMS)}.0::double, 6) AS total_inertia FROM scored WHERE "
       + " AND ".join(f"{c} IS NOT NULL" for c in P.MCA_ITEMS)))
def _(spark, sf):
    return A.mca_columns(scored(spark, sf), P.MCA_ITEMS)[1].agg(r6(F.sum("eigenvalue")).alias("total_inertia"))


@query("top_loadings")
def _(spark, sf):
    return A.top_loadings(A.mca_columns(scored(spark, sf), P.MCA_ITEMS)[0])


_ANCHORS = {"dim1": ["C007", "C006", "C008"], "dim2": ["C090", "C091"]}


@query("mca_rows")
def _(spark, sf):
    labels = main_labels(spark, sf).withColumnRenamed("cluster", "hard_cluster")
    return A.mca_rows(scored(spark, sf).join(labels, "respondent_id"), P.MCA_ITEMS, _ANCHORS, keep=("hard_cluster",))


@query("mca_quadrants")
def _(spark, sf):
    return A.quadrant_shares(A.mca_rows(scored(spark, sf), P.MCA_ITEMS, _ANCHORS))


# --- moments -----------------------------------------------------------------------------------
_MV = ["C052", "C055", "C086", "R_visit"]


@query("sem_moments", oracle("sem", "g AS (SELECT 'eq1' AS subset, * FROM sem WHERE C064 = 1 UNION ALL SELECT 'not_eq1', * FROM sem WHERE C064 <> 1) " + " UNION ALL ".join(
    f"SELECT subset, '{a}' AS var1, '{b}' AS var2, count(*) AS n, round(covar_samp({a}, {b}), 6) AS cov, round(corr({a}, {b}), 6) AS corr FROM g GROUP BY 1" for i, a in enumerate(_MV) for b in _MV[i:])))
def _(spark, sf):
    from ..operators.moments import covariance_table
    s = view(spark, sf, "sem").withColumn("subset", F.when(F.col("C064") == 1, "eq1").otherwise("not_eq1"))
    return rounded(covariance_table(s, _MV, ["subset"]), "cov", "corr")


# --- fits -------------------------------------------------------------------------------------
# A saturated path model is ordinary least squares: both slopes have a closed form.
@query("sem_fit_saturated", oracle("sem", """m AS (SELECT covar_pop(C052, C055) AS c12, var_pop(C052) AS v1, var_pop(C055) AS v2, covar_pop(C052, R_visit) AS c1y, covar_pop(C055, R_visit) AS c2y FROM sem)
 SELECT 'C052' AS rhs, round((v2 * c1y - c12 * c2y) / (v1 * v2 - c12 * c12), 5) AS estimate FROM m UNION ALL SELECT 'C055', round((v1 * c2y - c12 * c1y) / (v1 * v2 - c12 * c12), 5) FROM m"""))
def _(spark, sf):
    cols = ["C052", "C055", "R_visit"]
    spec = [("ols", "R_visit", "~", "C052", None), ("ols", "R_visit", "~", "C055", None), ("ols", "C052", "~~", "C055", None)]
    fits = E.sem_fit(E.sem_moments(view(spark, sf, "sem"), cols, {"main": F.lit(True)}), cols, {"ols": spec})
    return fits.filter("op = '~'").select("rhs", r6("estimate", 5).alias("estimate"))


@query("sem_fit")
def _(spark, sf):
    return _fits(spark, sf)


@query("sem_fit_indices")
def _(spark, sf):
    return E.sem_fit_indices(_fits(spark, sf), P.cutoff_table(spark))


@query("sem_paths")
def _(spark, sf):
    return E.sem_paths(_fits(spark, sf, ["legacy_compat_v2", "intent_partial_v1", "intent_obs_rsum_v1"]), P.DIRECT_PATHS)


@query("sem_indirect")
def _(spark, sf):
    return E.indirect_effects(_fits(spark, sf, ["legacy_compat_v2", "intent_partial_v1"]), P.INDIRECT_PATHS)


@query("sem_model_compare")
def _(spark, sf):
    idx = E.sem_fit_indices(_fits(spark, sf, ["baseline_current", "legacy_compat_v2", "intent_partial_v1", "cfa_intent_with_method", "cfa_intent_no_method"]), P.cutoff_table(spark))
    return E.sem_model_compare(idx, "cfa_intent_with_method")


@query("multigroup_cfa")
def _(spark, sf):
    g = _subsets()
    return E.multigroup_cfa(_sem(spark, sf), P.SEM_COLUMNS, P.SEM_SPECS["cfa_intent_with_method"], {"eq1": g["eq1"], "not_eq1": g["not_eq1"]})


@query("wald_group_diff", f"""WITH g AS (SELECT o_orderstatus AS s, o_orderpriority AS path, avg(o_totalprice) AS e, stddev_samp(o_totalprice) / sqrt(count(*)) AS se FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2),
 d AS (SELECT a.path, a.e - b.e AS diff, (a.e - b.e) / sqrt(a.se * a.se + b.se * b.se) AS z FROM g a JOIN g b USING (path) WHERE a.s = 'F' AND b.s = 'O'),
 zs AS (SELECT path AS k, abs(z) / sqrt(2) AS x FROM d), {SQL_ERF} SELECT path, round(diff, 4) AS diff, round(z, 6) AS z, round(erfc, 6) AS p FROM d JOIN erf_terms ON k = path""")
def _(spark, sf):
    g = load(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("subset"), F.col("o_orderpriority").alias("path")).agg(
        F.avg("o_totalprice").alias("estimate"), (F.stddev_samp("o_totalprice") / F.sqrt(F.count(F.lit(1)))).alias("std_err"))
    return rounded(E.wald_group_diff(g, "F", "O"), "z", "p").withColumn("diff", r6("diff", 4))


@query("wald_group_paths")
def _(spark, sf):
    p = E.sem_paths(_fits(spark, sf, ["intent_partial_v1"], ["eq1", "not_eq1"]), P.DIRECT_PATHS).withColumnRenamed("hypothesis", "path")
    return E.wald_group_diff(p, "eq1", "not_eq1")


@query("attention_sensitivity")
def _(spark, sf):
    subs = ["main", "eq1", "eq5"]
    paths = E.sem_paths(_fits(spark, sf, ["intent_partial_v1"], subs), P.DIRECT_PATHS)
    every = _subsets()
    return E.attention_sensitivity(view(spark, sf, "sem"), paths, {s: every[s] for s in subs}, "NH4")


@query("attention_subset_share", oracle("sem", """SELECT 'main' AS subset, count(*) AS n, 1.0::double AS share FROM sem UNION ALL SELECT 'eq1', count_if(C064 = 1), round(count_if(C064 = 1) / count(*), 6) FROM sem
 UNION ALL SELECT 'eq5', count_if(C064 = 5), round(count_if(C064 = 5) / count(*), 6) FROM sem"""))
def _(spark, sf):
    every = _subsets()
    empty = spark.createDataFrame([], "hypothesis string, subset string, beta double, p double")
    out = E.attention_sensitivity(view(spark, sf, "sem"), empty, {s: every[s] for s in ("main", "eq1", "eq5")}, "NH4")
    return rounded(out.select("subset", "n", "share"), "share")


@query("bootstrap_ci", """WITH d AS (SELECT l_returnflag AS flag, l_discount - 0.05::double + (l_partkey % 7) * 0.001::double AS v FROM lineitem)
 SELECT flag, count(*) AS draws, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high,
 round(least(1, 2 * least(avg(cast(v <= 0 AS int)), avg(cast(v >= 0 AS int)))), 6) AS p_boot, quantile_cont(v, 0.025) > 0 OR quantile_cont(v, 0.975) < 0 AS significant FROM d GROUP BY 1""")
def _(spark, sf):
    d = load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_discount") - 0.05 + (F.col("l_partkey") % 7) * F.lit(0.001)).alias("v"))
    return rounded(E.bootstrap_ci(d, ["flag"], "v"), "ci_low", "ci_high", "p_boot")


@query("bootstrap_indirect")
def _(spark, sf):
    return E.bootstrap_indirect(view(spark, sf, "sem"), P.SEM_COLUMNS, {m: P.SEM_SPECS[m] for m in dict.fromkeys(x[0] for x in P.INDIRECT_PATHS)}, P.INDIRECT_PATHS)
