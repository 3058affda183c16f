"""Queries for the logit family and for tables built from fitted terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S, text as X
from ..operators import describe as D, logit as L, quality as Q, ranks as K
from ..sources.scratch import cut
from . import profile as P
from .newton_sql import newton, two_sided
from .queries_quality import flagged, scored, scored_ctes, _pred, _PRED_SQL
from .queries_tables import IPA_CTE, LOGIT_CTES, main_logit, recursive, sql_hash
from .registry import query, r6, rounded
from .views import load, oracle, view


def _targets(spark, sf):
    return scored(spark, sf).withColumns({"y_q20_high": S.recode_binary_high("C090"), "y_q21_high": S.recode_binary_high("C091")})


def _screened(spark, sf):
    """All respondents with flags and scores, before any row is dropped."""
    return Q.with_scores(flagged(spark, sf).withColumns({x: S.codes_to_null(x) for x in P.VISITED_BLOCK + P.UNVISITED_BLOCK}))


def _sens():
    return (F.col("attention_flag") == 0) & (F.col("logic_branch_flag") == 0)


@query("logit_fit_binary", oracle("survey", """y AS (SELECT cast(coalesce(C024 >= 3 AND C025 >= 3, false) AS int) AS y, C008 AS x FROM survey),
 t AS (SELECT count_if(x = 2 AND y = 1)::double AS a, count_if(x = 2 AND y = 0)::double AS b, count_if(x = 1 AND y = 1)::double AS c, count_if(x = 1 AND y = 0)::double AS d, stddev_pop(x) AS sd, avg(x) AS m FROM y),
 f AS (SELECT ln(a * d / (b * c)) AS beta, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS se, sd, m, ln(c / d) AS b1 FROM t)
 SELECT 'x' AS term, round(beta * sd, 6) AS coef, round(se * sd, 6) AS std_err, round(exp(beta * sd), 6) AS odds_ratio FROM f
 UNION ALL SELECT 'Intercept', round(b1 + beta * (m - 1), 6), NULL, round(exp(b1 + beta * (m - 1)), 6) FROM f"""))
def _(spark, sf):
    coefs, _ = L.logit_fit(view(spark, sf, "survey"), S.visit_depth("C024", "C025"), {"x": "C008"}, {"main": F.lit(True)})
    return coefs.select("term", r6("coef").alias("coef"), F.when(F.col("term") == "x", r6("std_err")).alias("std_err"), r6("odds_ratio").alias("odds_ratio"))


_SHOWN = ("coef", "odds_ratio", "marginal_effect")


@query("logit_fit", recursive(oracle("survey", scored_ctes() + ", " + LOGIT_CTES + " SELECT 'main' AS sample, term, round(coef, 6) AS coef, round(std_err, 4) AS std_err, round(z, 3) AS z, round(p_value, 4) AS p_value, "
       "round(odds_ratio, 6) AS odds_ratio, round(marginal_effect, 6) AS marginal_effect FROM terms WHERE fit = 'main'")))
def _(spark, sf):
    # features close to collinear leave errors with fewer exact digits than estimates
    return rounded(rounded(main_logit(spark, sf), *_SHOWN), "std_err", "p_value", digits=4).withColumn("z", r6("z", 3))


_SIGNS_SQL = """sgn AS (SELECT a.fit, term, sign(m.coef)::double AS main_sign, sign(a.coef)::double AS sub_sign, cast(m.coef * a.coef < 0 AS int) AS reversed FROM terms a JOIN (SELECT * FROM terms WHERE fit = 'main') m USING (term) WHERE term <> 'Intercept')"""


def _main_and_sens(spark, sf):
    """Fitted terms of the screened sample and of its stricter part, in shared passes."""
    coefs, _ = L.logit_fit(scored(spark, sf), "visit_depth_bin", P.LOGIT_FEATURES, {"main": F.lit(True), "sens": _sens()})
    return coefs.filter("sample = 'main'"), coefs.filter("sample = 'sens'")


@query("logit_sensitivity", recursive(oracle("survey", scored_ctes() + ", " + LOGIT_CTES + ", " + _SIGNS_SQL + " SELECT term, main_sign, sub_sign, reversed FROM sgn WHERE fit = 'sens'")))
def _(spark, sf):
    main, sens = (t.filter("term <> 'Intercept'") for t in _main_and_sens(spark, sf))
    return L.compare_signs(main, sens)


# Accuracy, AUC and pseudo R2 of every fit on its own rows.
_METRICS_SQL = """pr AS (SELECT fit, y, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM fits_x JOIN fits USING (fit)),
 rk AS (SELECT *, rank() OVER (PARTITION BY fit ORDER BY p) + (count(*) OVER (PARTITION BY fit, p) - 1) / 2.0::double AS k FROM pr),
 me AS (SELECT fit, count(*) AS n, cast(sum(y) AS bigint) AS events, avg(cast((p >= 0.5) = (y = 1) AS int)) AS accuracy, sum(y * ln(p + 1e-12) + (1 - y) * ln(1 - p + 1e-12)) AS ll, avg(y) AS p0, sum(k) FILTER (WHERE y = 1) AS rp FROM rk GROUP BY fit),
 met AS (SELECT fit, n, events, round(accuracy, 6) AS accuracy, round((rp - events * (events + 1) / 2.0::double) / (events::double * (n - events)), 3) AS auc,
  round(1 - ll / (n * (p0 * ln(p0 + 1e-12) + (1 - p0) * ln(1 - p0 + 1e-12))), 6) AS pseudo_r2 FROM me)"""
_SIGN_COUNTS_SQL = """sc AS (SELECT fit, count_if(main_sign * sub_sign > 0) AS consistent_direction_n, count_if(main_sign * sub_sign < 0) AS reversed_direction_n,
 count_if(main_sign * sub_sign = 0 OR main_sign IS NULL OR sub_sign IS NULL) AS unknown_direction_n FROM sgn GROUP BY fit)"""


@query("attention_calibrations", recursive(oracle("survey", scored_ctes() + ", " + LOGIT_CTES + ", " + _SIGNS_SQL + ", " + _METRICS_SQL + ", " + _SIGN_COUNTS_SQL + """,
 c AS (SELECT * FROM (VALUES ('eq1', 1, '口径A_应选1'), ('eq5', 5, '口径B_应选5')) v(fit, code, name)), k AS (SELECT fit, code, name, cast(sum(cast(coalesce(C064 <> code, true) AS int)) AS bigint) AS bad,
 count_if(C064 = code AND logic_branch_flag = 0) AS kept FROM scored, c GROUP BY ALL)
 SELECT fit AS sample, name AS calibration, code AS expected_code, bad AS attention_abnormal_n, kept AS sensitivity_n, n AS model_n, events, accuracy, auc, pseudo_r2, consistent_direction_n, reversed_direction_n, unknown_direction_n
 FROM k LEFT JOIN met USING (fit) LEFT JOIN sc USING (fit)""")))
def _(spark, sf):
    return rounded(L.attention_calibrations(scored(spark, sf), "visit_depth_bin", P.LOGIT_FEATURES), "accuracy", "pseudo_r2").withColumn("auc", r6("auc", 3))


@query("attention_calibration_counts", oracle("survey", """c AS (SELECT * FROM (VALUES (1), (5)) v(code))
 SELECT code AS expected_code, cast(sum(cast(coalesce(C064 <> code, true) AS int)) AS bigint) AS attention_abnormal_n, count_if(C064 = code) AS sensitivity_n FROM survey CROSS JOIN c GROUP BY 1"""))
def _(spark, sf):
    s = view(spark, sf, "survey")
    rows = [s.agg(F.lit(c).alias("expected_code"), F.sum(Q.attention_flag("C064", c)).alias("attention_abnormal_n"), F.count_if(Q.attention_flag("C064", c) == 0).alias("sensitivity_n")) for c in (1, 5)]
    return rows[0].unionByName(rows[1])


@query("alt_outcome", recursive(oracle("survey", scored_ctes() + ", " + LOGIT_CTES + ", " + _SIGNS_SQL + ", " + _METRICS_SQL + ", " + _SIGN_COUNTS_SQL + """
 SELECT CASE fit WHEN 'main' THEN 'base' ELSE fit END AS sample, n, events, accuracy, auc, pseudo_r2, consistent_direction_n, reversed_direction_n, unknown_direction_n FROM met JOIN (SELECT * FROM sc WHERE fit <> 'main' UNION ALL
 SELECT 'main', count_if(coef <> 0), 0, count_if(coef = 0) FROM terms WHERE fit = 'main' AND term <> 'Intercept') USING (fit) WHERE fit IN ('main', 'alt_stay', 'alt_spend')""")))
def _(spark, sf):
    ys = {"base": F.col("visit_depth_bin"), "alt_stay": S.at_least("C024"), "alt_spend": S.at_least("C025")}
    coefs, metrics = L.logit_fits(scored(spark, sf), ys, P.LOGIT_FEATURES, {n: L.Model(n, tuple(P.LOGIT_FEATURES), F.lit(True)) for n in ys})
    terms = coefs.filter("term <> 'Intercept'").select("sample", "term", F.signum("coef").alias("sub_sign"))
    main = terms.filter("sample = 'base'").select("term", F.col("sub_sign").alias("main_sign"))
    return rounded(L.sign_counts(terms.join(main, "term"), ["sample"]).join(metrics, "sample"), "accuracy", "pseudo_r2").withColumn("auc", r6("auc", 3))


@query("logit_metrics", f"""WITH {_PRED_SQL}, q AS (SELECT y, greatest(1e-6, least(1 - 1e-6, p)) AS p FROM pred), r AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::double AS k FROM q),
 a AS (SELECT count(*) AS n, cast(sum(y) AS bigint) AS events, avg(cast(cast(p >= 0.5 AS int) = y AS int)) AS accuracy, sum(y * ln(p + 1e-12) + (1 - y) * ln(1 - p + 1e-12)) AS ll, avg(y) AS p0, sum(k) FILTER (WHERE y = 1) AS rp FROM r)
 SELECT n, events, round(accuracy, 6) AS accuracy, round((rp - events * (events + 1) / 2.0::double) / (events::double * (n - events)), 6) AS auc,
 round(1 - ll / (n * (p0 * ln(p0 + 1e-12) + (1 - p0) * ln(1 - p0 + 1e-12))), 6) AS pseudo_r2 FROM a""")
def _(spark, sf):
    p = _pred(spark, sf).withColumn("p", F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p"))))
    return rounded(L.logit_metrics(p, (), "y", "p"), "accuracy", "auc", "pseudo_r2")


@query("dummy_encode", oracle("survey", "SELECT respondent_id, " + ", ".join(
    f"cast({c} = {v} AS double) AS \"C({c})[T.{v}]\"" for c, n in (("C001", 2), ("C002", 5), ("C008", 2)) for v in range(2, n + 1)) + " FROM survey"))
def _(spark, sf):
    return L.dummy_encode(view(spark, sf, "survey"), ["C001", "C002", "C008"])


# The level numbers of line items' parts: as many levels as there are parts.
@query("dummy_rows", """WITH lv AS (SELECT DISTINCT l_partkey AS level FROM lineitem), n AS (SELECT level, row_number() OVER (ORDER BY level) - 2 AS idx FROM lv),
 f AS (SELECT DISTINCT l_returnflag, ascii(l_returnflag) AS level FROM lineitem), m AS (SELECT level, row_number() OVER (ORDER BY level) - 2 AS idx FROM f), c AS (SELECT count(*) - 1 AS c FROM lv)
 SELECT l_orderkey, l_linenumber, list_filter([n.idx, CASE WHEN m.idx >= 0 THEN c + m.idx ELSE -1 END], lambda i: i >= 0)::int[]::varchar AS levels FROM lineitem l JOIN n ON n.level = l_partkey JOIN m ON m.level = ascii(l_returnflag), c""")
def _(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.ascii("l_returnflag").alias("flag"))
    controls = ["l_partkey", "flag"]
    out = L.encode_rows(rows, controls, L.level_table(rows, controls), "on", ("l_orderkey", "l_linenumber"))
    return out.select("l_orderkey", "l_linenumber", F.concat(F.lit("["), F.array_join("on", ", "), F.lit("]")).alias("levels"))


def _models():
    return [(mid, y, [P.LOGIT_CORE, *([P.LOGIT_MEDIATOR] if med else [])]) for mid, _, y, med in P.LOGIT_MODELS]


def _formulas(spark, sf):
    return L.Formulas(_targets(spark, sf), _models(), P.LOGIT_CONTROLS)


_LEVELS = [(c, v) for c in P.LOGIT_CONTROLS for v in range(2, {"C001": 2, "C008": 2}.get(c, 5) + 1)]
_TERMS = [f"C({c})[T.{v}]" for c, v in _LEVELS]
_DUMMIES = ", ".join(f"cast({c} = {v} AS double)" for c, v in _LEVELS)
_TARGET_SQL = ("tg AS (SELECT *, CASE WHEN C090 IN (1, 2) THEN 1.0::double WHEN C090 IN (3, 4, 5) THEN 0.0::double END AS y_q20_high, CASE WHEN C091 IN (1, 2) THEN 1.0::double WHEN C091 IN (3, 4, 5) THEN 0.0::double END AS y_q21_high "
               "FROM scored WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in P.LOGIT_CONTROLS) + ")")


def _model_rows(models, more="", where="true", src="tg"):
    """(fit, x, y and more) of models with one number of terms."""
    return " UNION ALL ".join(f"SELECT '{m}' AS fit, [1.0::double, {', '.join(f'{x}::double' for x in xs)}, {_DUMMIES}] AS x, {y} AS y{more} FROM {src} WHERE {where} AND " + " AND ".join(f"{c} IS NOT NULL" for c in [y, *xs])
                              for m, y, xs in models)


def _formula_ctes():
    """Fits of the three models: ``fm``(fit, term numbers, b, inv, n) of both widths, and hc(fit, cov) with the robust diagonal."""
    parts = [_TARGET_SQL]
    for name, models in (("fa", _models()[:2]), ("fb", _models()[2:])):
        q = 1 + len(models[0][2]) + len(_LEVELS)
        parts.append(newton(name, _model_rows(models), q))
        pairs = [(i, j) for i in range(1, q + 1) for j in range(i, q + 1)]
        sums = ", ".join(f"sum(e * e * x[{i}] * x[{j}]) AS s{i}_{j}" for i, j in pairs)
        meat = "[" + ", ".join("[" + ", ".join(f"s{min(i, j)}_{max(i, j)}" for j in range(1, q + 1)) + "]" for i in range(1, q + 1)) + "]"
        terms = "[" + ", ".join(f"'{t}'" for t in ["Intercept", *models[0][2], *_TERMS]) + "]"
        parts.append(f"""{name}_p AS (SELECT fit, x, y, inv, 1 / (1 + exp(-list_dot_product(x, b))) AS p FROM {name}_x JOIN {name} USING (fit)),
 {name}_e AS (SELECT fit, x, y, p, (y - p) / (1 - p * (1 - p) * list_dot_product(x, list_transform(inv, lambda r: list_dot_product(r, x)))) AS e FROM {name}_p),
 {name}_s AS (SELECT fit, {sums}, avg(p * (1 - p)) AS slope, sum(y * ln(p + 1e-12) + (1 - y) * ln(1 - p + 1e-12)) AS llf, sum(y) AS events FROM {name}_e GROUP BY fit),
 {name}_r AS (SELECT fit, b, inv, n, slope, llf, events, {meat} AS meat, {terms} AS terms FROM {name} JOIN {name}_s USING (fit)),
 {name}_c AS (SELECT fit, 1 - llf / (n * (events / n * ln(events / n + 1e-12) + (1 - events / n) * ln(1 - events / n + 1e-12))) > 0.999 AS sep, unnest(terms) AS term, unnest(b) AS coef, unnest(list_transform(inv, lambda r, i: sqrt(r[i]))) AS std_err,
  unnest(list_transform(inv, lambda r: sqrt(list_dot_product(r, list_transform(meat, lambda m: list_dot_product(m, r)))))) AS robust_se, slope FROM {name}_r)""")
    return ", ".join(parts)


_FORMULA_SQL = scored_ctes() + ", " + _formula_ctes() + ", fc AS (SELECT fit, term, CASE WHEN NOT sep THEN coef END AS coef, CASE WHEN NOT sep THEN std_err END AS std_err, CASE WHEN NOT sep THEN robust_se END AS robust_se, slope FROM (SELECT * FROM fa_c UNION ALL SELECT * FROM fb_c)), fr AS (SELECT fit, b, inv, n, llf, events, terms FROM fa_r UNION ALL SELECT fit, b, inv, n, llf, events, terms FROM fb_r)"


@query("logit_formula", recursive(oracle("survey", _FORMULA_SQL + f""", z AS (SELECT *, coef / robust_se AS z, coef - 1.959963984540054 * robust_se AS lo, coef + 1.959963984540054 * robust_se AS hi FROM fc)
 SELECT fit AS model_id, term, round(coef, 6) AS coef, round(std_err, 4) AS std_err, round(robust_se, 4) AS robust_se, round(z, 3) AS z, round({two_sided('z')}, 4) AS p_value, round(lo, 4) AS ci_lower, round(hi, 4) AS ci_upper,
 round(exp(coef), 6) AS odds_ratio, round(exp(lo), 2) AS or_ci_lower, round(exp(hi), 2) AS or_ci_upper, CASE WHEN term <> 'Intercept' THEN round(slope * coef, 6) END AS marginal_effect, round(abs(coef), 6) AS abs_coef FROM z""")))
def _(spark, sf):
    out = _formulas(spark, sf).coefficients()
    fine, rough = ["coef", "odds_ratio", "marginal_effect", "abs_coef"], ["std_err", "robust_se", "p_value", "ci_lower", "ci_upper"]
    out = rounded(rounded(rounded(out, *fine), *rough, digits=4), "or_ci_lower", "or_ci_upper", digits=2)
    return out.withColumn("z", r6("z", 3)).orderBy("model_id", F.desc("abs_coef"))


@query("logit_formula_fit", recursive(oracle("survey", _FORMULA_SQL + """, g AS (SELECT *, events / n AS rate, len(b) AS k, n * (events / n * ln(events / n + 1e-12) + (1 - events / n) * ln(1 - events / n + 1e-12)) AS llnull FROM fr)
 SELECT fit AS model_id, n, cast(events AS bigint) AS events, round(rate, 6) AS event_rate, round(llnull, 4) AS llnull, CASE WHEN 1 - llf / llnull <= 0.999 THEN round(1 - llf / llnull, 6) END AS pseudo_r2_mcfadden,
 CASE WHEN 1 - llf / llnull <= 0.999 THEN round(llf, 4) END AS llf, CASE WHEN 1 - llf / llnull <= 0.999 THEN round(-2 * llf + 2 * k, 4) END AS aic,
 CASE WHEN 1 - llf / llnull <= 0.999 THEN round(-2 * llf + k * ln(n), 4) END AS bic, 1 - llf / llnull <= 0.999 AS converged FROM g""")))
def _(spark, sf):
    rows = rounded(rounded(_formulas(spark, sf).fit_rows(), "event_rate", "pseudo_r2_mcfadden"), "llf", "llnull", "aic", "bic", digits=4)
    # separated classes have no maximum: how close to 0 the likelihood came says when the steps ended
    return rows.withColumns({c: F.when(F.col("converged"), F.col(c)) for c in ("pseudo_r2_mcfadden", "llf", "aic", "bic")})


@query("robust_se", recursive(oracle("survey", _FORMULA_SQL + " SELECT fit AS model_id, term, round(std_err, 4) AS std_err, round(robust_se, 4) AS robust_se FROM fc")))
def _(spark, sf):
    return rounded(_formulas(spark, sf).coefficients().select("model_id", "term", "std_err", "robust_se"), "std_err", "robust_se", digits=4)


# Given coefficients, so that the averages over all rows have a check.
_COEF = {"Intercept": -1.5, "C088": 0.4, "C(C002)[T.2]": 0.3, "C(C002)[T.3]": -0.2}


def _given():
    return {"C088": F.col("C088"), "C(C002)[T.2]": (F.col("C002") == 2).cast("double"), "C(C002)[T.3]": (F.col("C002") == 3).cast("double")}


_LP = "-1.5::double + 0.4::double * {core} + 0.3::double * cast(C002 = 2 AS int) - 0.2::double * cast(C002 = 3 AS int)"


@query("gradient_table", oracle("survey", "SELECT level, round(avg(1 / (1 + exp(-(" + _LP.format(core="level") + ")))), 6) AS probability FROM survey, (SELECT unnest([1, 2, 3, 4, 5]) AS level) WHERE C088 IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    return rounded(L.gradient_table(view(spark, sf, "survey").filter("C088 is not null"), _COEF, _given(), "C088"), "probability")


@query("avg_marginal_effect", oracle("survey", "p AS (SELECT 1 / (1 + exp(-(" + _LP.format(core="C088") + "))) AS p FROM survey WHERE C088 IS NOT NULL), s AS (SELECT avg(p * (1 - p)) AS s FROM p) "
       "SELECT 'C088' AS term, round(s * 0.4, 6) AS marginal_effect FROM s UNION ALL SELECT 'C(C002)[T.2]', round(s * 0.3, 6) FROM s UNION ALL SELECT 'C(C002)[T.3]', round(s * -0.2, 6) FROM s"))
def _(spark, sf):
    return rounded(L.avg_marginal_effect(view(spark, sf, "survey").filter("C088 is not null"), _COEF, _given()), "marginal_effect")


_GRADIENT_SQL = " UNION ALL ".join(
    f"SELECT fit AS model_id, {'NULL::double' if m is None else f'{m}::double'} AS mediator, lv::int AS level, round(avg(CASE WHEN fit IN (SELECT fit FROM {n}_c WHERE NOT sep) THEN 1 END / (1 + exp(-list_dot_product(list_transform(x, lambda v, i: CASE WHEN i = 2 THEN lv::double "
    + (f"WHEN i = 3 THEN {m}::double " if m is not None else "") + f"ELSE v END), b)))), 6) AS probability FROM {n}_x JOIN {n} USING (fit), (SELECT unnest([1, 2, 3, 4, 5]) AS lv) GROUP BY fit, lv"
    for n, ms in (("fa", (None,)), ("fb", (0, 1))) for m in ms)


@query("gradient_table_fitted", recursive(oracle("survey", _FORMULA_SQL + " " + _GRADIENT_SQL)))
def _(spark, sf):
    return rounded(_formulas(spark, sf).gradients(P.LOGIT_CORE, mediator=P.LOGIT_MEDIATOR), "probability")


def _oof(spark, sf):
    return L.oof_models(_targets(spark, sf), _models(), P.LOGIT_CONTROLS, seed=53)


def _oof_ctes():
    """Every row of every model with the probability of the fit that left its fold out."""
    parts, out = [_TARGET_SQL], []
    for name, models in (("oa", _models()[:2]), ("ob", _models()[2:])):
        q = 1 + len(models[0][2]) + len(_LEVELS)
        rows = _model_rows(models, ", respondent_id AS id")
        parts.append(f"""{name}_all AS (SELECT *, cast((row_number() OVER (PARTITION BY fit, y ORDER BY {sql_hash('id', 53)}, id) - 1) % 5 AS int) AS fold FROM ({rows})),
 {newton(name, f"SELECT fit || ' ' || f AS fit, x, y FROM {name}_all, range(5) r(f) WHERE fold <> f", q, 30, 1e-6)}""")
        out.append(f"SELECT a.fit AS model_id, id, y::int AS y_true, greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-list_dot_product(x, b))))) AS p FROM {name}_all a JOIN {name} m ON m.fit = a.fit || ' ' || a.fold")
    return scored_ctes() + ", " + ", ".join(parts) + ", oof AS (" + " UNION ALL ".join(out) + ")"


@query("oof_predict", recursive(oracle("survey", _oof_ctes() + " SELECT model_id, id AS respondent_id, y_true, round(p, 6) AS prob_oof, cast(p >= 0.5 AS int) AS pred_0_5, 'stratified_5fold_oof' AS oof_method FROM oof")))
def _(spark, sf):
    return rounded(_oof(spark, sf), "prob_oof").orderBy("model_id", "respondent_id")


@query("oof_metrics", recursive(oracle("survey", _oof_ctes() + """, rk AS (SELECT *, rank() OVER (PARTITION BY model_id ORDER BY p) + (count(*) OVER (PARTITION BY model_id, p) - 1) / 2.0::double AS k FROM oof),
 m AS (SELECT model_id, count(*) AS n, cast(sum(y_true) AS bigint) AS events, avg(cast((p >= 0.5) = (y_true = 1) AS int)) AS accuracy, sum(y_true * ln(p + 1e-12) + (1 - y_true) * ln(1 - p + 1e-12)) AS ll, avg(y_true) AS p0, sum(k) FILTER (WHERE y_true = 1) AS rp,
  avg((p - y_true) * (p - y_true)) AS brier, avg(-(y_true * ln(p) + (1 - y_true) * ln(1 - p))) AS log_loss FROM rk GROUP BY 1),
 v AS (SELECT model_id, p, sum(y_true) AS pos, count(*) AS c FROM oof GROUP BY 1, 2), w AS (SELECT model_id, pos, sum(pos) OVER o::double / sum(c) OVER o AS prec FROM v WINDOW o AS (PARTITION BY model_id ORDER BY p DESC)),
 pr AS (SELECT model_id, sum(pos * prec) / sum(pos) AS pr_auc FROM w GROUP BY 1)
 SELECT model_id, n, events, round(accuracy, 6) AS accuracy, round((rp - events * (events + 1) / 2.0::double) / (events::double * (n - events)), 4) AS auc, round(1 - ll / (n * (p0 * ln(p0 + 1e-12) + (1 - p0) * ln(1 - p0 + 1e-12))), 6) AS pseudo_r2,
 round(pr_auc, 4) AS pr_auc, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss FROM m JOIN pr USING (model_id)""")))
def _(spark, sf):
    p = cut(_oof(spark, sf))
    by = ["model_id"]
    m = L.logit_metrics(p, by, "y_true", "prob_oof").join(K.pr_auc(p, "y_true", "prob_oof", by), by).join(K.brier_logloss(p, "y_true", "prob_oof", by), by)
    # ranks of probabilities that differ in the last digit only may differ between engines
    return rounded(rounded(m, "accuracy", "pseudo_r2", "brier", "log_loss"), "auc", "pr_auc", digits=4)


# --- tables built from terms -----------------------------------------------------------------
@query("compare_signs", recursive(oracle("survey", scored_ctes() + ", " + LOGIT_CTES + ", " + _SIGNS_SQL + " SELECT term, main_sign, sub_sign, reversed FROM sgn WHERE fit = 'sens' UNION ALL "
       "SELECT 'Intercept', sign(m.coef)::double, sign(a.coef)::double, cast(m.coef * a.coef < 0 AS int) FROM terms a JOIN terms m USING (term) WHERE term = 'Intercept' AND a.fit = 'sens' AND m.fit = 'main'")))
def _(spark, sf):
    return L.compare_signs(*_main_and_sens(spark, sf))


@query("robustness_compare", recursive(oracle("survey", scored_ctes() + ", " + LOGIT_CTES + """, j AS (SELECT term AS path, a.coef AS main_beta, a.p_value AS main_p, b.coef AS sub_beta, b.p_value AS sub_p FROM terms a JOIN terms b USING (term) WHERE a.fit = 'main' AND b.fit = 'sens'),
 d AS (SELECT *, CASE WHEN main_beta > 0 THEN '正向' WHEN main_beta < 0 THEN '负向' ELSE '零' END AS main_direction, CASE WHEN sub_beta > 0 THEN '正向' WHEN sub_beta < 0 THEN '负向' ELSE '零' END AS sub_direction FROM j)
 SELECT path, round(main_beta, 4) AS main_beta, round(main_p, 3) AS main_p, round(sub_beta, 4) AS sub_beta, round(sub_p, 3) AS sub_p, main_direction, sub_direction, main_direction = sub_direction AS same_direction FROM d""")))
def _(spark, sf):
    both = [t.select(F.col("term").alias("path"), F.col("coef").alias("beta"), F.col("p_value").alias("p")) for t in _main_and_sens(spark, sf)]
    return rounded(rounded(L.robustness_compare(*both), "main_beta", "sub_beta", digits=4), "main_p", "sub_p", digits=3)


@query("top_effects", recursive(oracle("survey", scored_ctes() + ", " + LOGIT_CTES + " SELECT term, round(coef, 6) AS coef FROM terms WHERE fit = 'main' AND term <> 'Intercept' AND p_value < 0.05 ORDER BY abs(coef) DESC, term LIMIT 3")))
def _(spark, sf):
    return L.top_effects(main_logit(spark, sf)).select("term", r6("coef").alias("coef"))


@query("hypothesis_evidence", recursive(oracle("survey", scored_ctes() + f", {IPA_CTE}, " + LOGIT_CTES + f""", t AS (SELECT term, 'coef=' || format('{{:.3f}}', coef) || ', p=' || format('{{:.4f}}', p_value) || ', OR=' || format('{{:.3f}}', odds_ratio) AS txt FROM terms WHERE fit = 'main'),
 n AS (SELECT count(*) AS n FROM ipa WHERE quadrant = 'Q4_改进区')
 SELECT 'H1' AS id, (SELECT txt FROM t WHERE term = 'Q2_age_code') AS evidence, '需结合分组解释' AS conclusion UNION ALL SELECT 'H2', (SELECT txt FROM t WHERE term = 'Q6_habit_code'), '以实证结果为准' UNION ALL
 SELECT 'H3', (SELECT txt FROM t WHERE term = 'Q7_knowledge_code') || '；' || (SELECT txt FROM t WHERE term = 'cognition_mean'), '认知变量需与其他因子联判' UNION ALL
 SELECT 'H4', (SELECT txt FROM t WHERE term = 'Q8_visit_status_code'), '方向与显著性按结果解释' UNION ALL SELECT 'H5', (SELECT txt FROM t WHERE term = 'perception_mean'), '需与表现度区分讨论' UNION ALL
 SELECT 'H6', '见聚类稳定性与画像卡', '成立（按当前K=2方案）' UNION ALL SELECT 'H7', '见IPA结果表与阈值敏感性表', '成立（当前识别' || n || '项优先改进）' FROM n""")))
def _(spark, sf):
    return D.hypothesis_evidence(spark, main_logit(spark, sf), D.ipa_priority(D.ipa(scored(spark, sf)))).select("id", "evidence", "conclusion")


@query("feature_texts")
def _(spark, sf):
    """Terms of a fitted model with the question text of their variable."""
    coefs = _formulas(spark, sf).coefficients().select("model_id", "term", X.term_parts("term").alias("p")).select("model_id", "term", "p.*")
    items = F.broadcast(P.item_table(spark).select(F.col("var_code").alias("variable"), "item_text"))
    return coefs.join(items, "variable", "left").withColumn("item_text", F.coalesce("item_text", "variable"))
