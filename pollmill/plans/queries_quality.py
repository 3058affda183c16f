"""Queries for flags, validation, samples, joins and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S, text as X
from ..operators import describe as D, quality as Q, ranks as K, recode as R
from ..sources import tables as T
from ..sources.scratch import once
from . import profile as P
from .queries_recode import runs_ctes, sql_gibberish, sql_list, sql_norm, sql_strip, _sql_values, WS
from .registry import query, r6, rounded
from .views import load, oracle, view


def _any(cols, test):
    return " OR ".join(f"coalesce({x} {test}, false)" for x in cols)


_SKIP_V, _SKIP_U = _any(P.VISITED_BLOCK, "= -3"), _any(P.UNVISITED_BLOCK, "= -3")
_ANS_V, _ANS_U = _any(P.VISITED_BLOCK, "<> -3"), _any(P.UNVISITED_BLOCK, "<> -3")
_LOGIC = f"cast((C008 = 1 AND ({_SKIP_V} OR {_ANS_U})) OR (C008 = 2 AND ({_ANS_V} OR {_SKIP_U})) AS int)"
_STRAIGHT = "cast(" + " AND ".join(
    f"len(list_filter({sql_list(b)}, lambda x: x IS NULL)) = 0 AND len(list_distinct({sql_list(b)})) = 1" for b in P.STRAIGHT_BLOCKS) + " AS int)"
_LOGIC_TEXT = (f"CASE WHEN trim(q8_text) <> '' THEN cast((q8_text = '否' AND q14_text <> '(跳过)') OR (q8_text = '是' AND q15_text <> '(跳过)') AS int) ELSE {_LOGIC} END")
_ATT_FAIL = "CASE WHEN attention_text <> '' THEN attention_text <> '完全不同意' ELSE coalesce(C064 <> 1, true) END"
_KEY_MISSING = "cast(" + " OR ".join(f"{x} IS NULL" for x in P.KEY_ITEMS) + " AS int)"


def flags_ctes():
    """All flags in plain SQL, ending in the CTE ``flagged``."""
    return runs_ctes() + f""",
run_prof AS (SELECT respondent_id, max(len) AS run FROM runs GROUP BY 1),
run_dist AS (SELECT respondent_id, count(DISTINCT v) AS u, count_if(v IN (1, 5)) / count(*) AS ext FROM present GROUP BY 1),
f1 AS (SELECT s.*, cast(coalesce(C064 <> 1, true) AS int) AS attention_flag, {_LOGIC} AS logic_flag,
 cast(row_number() OVER (PARTITION BY {', '.join(P.CODES)} ORDER BY respondent_id) > 1 AS int) AS duplicate_legacy_flag, {_STRAIGHT} AS straightline_flag,
 cast(coalesce(duration_sec < 90, false) AS int) AS duration_lt90_flag,
 cast(coalesce(u, 0) <= 1 OR coalesce(run, 0) >= 30 OR (coalesce(run, 0) >= 20 AND ext >= 0.8) AS int) AS severe_straightline_flag,
 {_LOGIC_TEXT} AS logic_branch_flag, {_KEY_MISSING} AS key_missing_flag, {sql_gibberish('C108')} AS open_gibberish_flag, {_ATT_FAIL} AS att_fail
 FROM survey s LEFT JOIN run_prof USING (respondent_id) LEFT JOIN run_dist USING (respondent_id)),
f2 AS (SELECT *, duplicate_legacy_flag AS duplicate_flag,
 cast(att_fail AND (coalesce(duration_sec < 120, false) OR severe_straightline_flag = 1) AS int) AS attention_conditional_flag FROM f1),
flagged AS (SELECT *, greatest({', '.join(P.FLAG_UNION)}) AS invalid_union_flag FROM f2)"""


def clean_ctes():
    """The valid sample with scores, ending in the CTE ``clean``."""
    nulled = ", ".join(f"nullif({x}, -3) AS {x}" for x in P.VISITED_BLOCK + P.UNVISITED_BLOCK)
    return flags_ctes() + f""", clean AS (SELECT * EXCLUDE ({', '.join(P.VISITED_BLOCK + P.UNVISITED_BLOCK)}), {nulled}, {score_columns()}
 FROM flagged WHERE invalid_union_flag = 0)"""


def score_columns():
    lists = {"perception_mean": P.PERCEPTION, "importance_mean": P.IMPORTANCE, "performance_mean": P.PERFORMANCE, "cognition_mean": P.COGNITION}
    counts = {"motive_count": P.MOTIVE, "new_project_pref_count": P.PROJECTS, "promo_pref_count": P.PROMOS}
    return ("cast(coalesce(C024 >= 3 AND C025 >= 3, false) AS int) AS visit_depth_bin, "
            + ", ".join(f"list_avg({sql_list(v)}) AS {k}" for k, v in lists.items()) + ", "
            + ", ".join(f"coalesce(list_sum({sql_list(v)}), 0) AS {k}" for k, v in counts.items()))


def flagged(spark, sf, profile=Q.BALANCED):
    """The survey with its flags: screened once an application, then read by every query that starts from it."""
    return once(spark, f"flagged-{profile}", load(spark, sf, "orders"), lambda: Q.quality_profile(view(spark, sf, "survey"), profile))


def clean(spark, sf, extra=()):
    return Q.survey_clean(flagged(spark, sf), extra)


def _with_scores(valid):
    return Q.with_scores(valid.withColumns({x: S.codes_to_null(x) for x in P.VISITED_BLOCK + P.UNVISITED_BLOCK}))


def scored(spark, sf):
    """The valid sample with structural missing codes nulled and scores added, every column kept."""
    return _with_scores(Q.valid_sample(flagged(spark, sf)))


def scored_once(spark, sf):
    """The rows of ``scored``, written once an application for queries that pass over them many times and need no dropped row.

    The survey is screened as in ``flagged``; its dropped rows are not written.
    """
    def make():
        return _with_scores(Q.valid_sample(Q.quality_profile(view(spark, sf, "survey"), Q.BALANCED)))

    return once(spark, f"scored-{Q.BALANCED}", load(spark, sf, "orders"), make)


def scored_ctes():
    return clean_ctes() + ", scored AS (SELECT * FROM clean)"


# --- flags ------------------------------------------------------------------------------
def _flag_query(key, column, sql_expr, spark_expr):
    @query(key, oracle("survey", f"SELECT respondent_id, {sql_expr} AS {column} FROM survey"))
    def _(spark, sf):
        return view(spark, sf, "survey").select("respondent_id", spark_expr().alias(column))


_flag_query("flag_attention", "flag", "cast(coalesce(C064 <> 1, true) AS int)", Q.attention_flag)
_flag_query("flag_logic", "flag", _LOGIC, Q.logic_flag)
_flag_query("flag_logic_text", "flag", _LOGIC_TEXT, Q.logic_text_flag)
_flag_query("flag_straightline", "flag", _STRAIGHT, Q.straightline_flag)
_flag_query("flag_duration", "flag", "cast(coalesce(duration_sec < 90, false) AS int)", Q.duration_flag)
_flag_query("flag_key_missing", "flag", _KEY_MISSING, Q.key_missing_flag)
_flag_query("flag_open_gibberish", "flag", sql_gibberish("C108"), Q.gibberish_flag)


@query("flag_duplicate", oracle("survey", f"""SELECT respondent_id AS id, cast(row_number() OVER (PARTITION BY {', '.join(P.CODES)} ORDER BY respondent_id) > 1 AS int) AS duplicate_flag FROM survey
UNION ALL SELECT -1 - doc_id, cast(row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) > 1 AS int) FROM documents"""))
def _(spark, sf):
    a = Q.flag_duplicate(view(spark, sf, "survey"), P.CODES).select(F.col("respondent_id").alias("id"), "duplicate_flag")
    b = Q.flag_duplicate(load(spark, sf, "documents"), ["text", "lang"], "doc_id").select((-1 - F.col("doc_id")).alias("id"), "duplicate_flag")
    return a.unionByName(b)


@query("flag_severe_straightline", oracle("survey", flags_ctes() + " SELECT respondent_id, severe_straightline_flag FROM flagged"))
def _(spark, sf):
    return view(spark, sf, "survey").select("respondent_id", Q.severe_straightline_flag().alias("severe_straightline_flag"))


@query("flag_attention_conditional", oracle("survey", flags_ctes() + " SELECT respondent_id, attention_conditional_flag FROM flagged"))
def _(spark, sf):
    s = view(spark, sf, "survey").withColumn("sev", Q.severe_straightline_flag())
    return s.select("respondent_id", Q.attention_conditional_flag(Q.attention_failed(), F.col("sev")).alias("attention_conditional_flag"))


@query("flag_invalid_union", oracle("survey", flags_ctes() + f" SELECT respondent_id, {', '.join(P.FLAG_UNION)}, invalid_union_flag FROM flagged"))
def _(spark, sf):
    return flagged(spark, sf).select("respondent_id", *P.FLAG_UNION, "invalid_union_flag")


@query("quality_profile", oracle("survey", flags_ctes() + """ SELECT 'balanced_v20260221' AS profile, count(*) AS n, cast(sum(invalid_union_flag) AS bigint) AS dropped, cast(sum(severe_straightline_flag) AS bigint) AS severe FROM flagged
 UNION ALL SELECT 'legacy_balanced', count(*), 0, cast(sum(straightline_flag) AS bigint) FROM flagged"""))
def _(spark, sf):
    parts = [flagged(spark, sf, p).agg(F.lit(p).alias("profile"), F.count(F.lit(1)).alias("n"), F.sum("invalid_union_flag").alias("dropped"),
                                       F.sum("severe_straightline_flag").alias("severe")) for p in (Q.BALANCED, Q.LEGACY)]
    return parts[0].unionByName(parts[1])


@query("flagged_rows", oracle("survey", flags_ctes() + f""" SELECT respondent_id, 'legacy' AS kind, attention_flag + logic_flag + duplicate_legacy_flag + straightline_flag AS hits, '' AS open_text, '' AS ip FROM flagged
 WHERE attention_flag + logic_flag + duplicate_legacy_flag + straightline_flag > 0
 UNION ALL SELECT respondent_id, 'dropped', {' + '.join(P.FLAG_UNION)}, {sql_strip('C108')}, ip FROM flagged WHERE invalid_union_flag = 1"""))
def _(spark, sf):
    f = flagged(spark, sf)
    a = Q.flagged_rows(f).select("respondent_id", F.lit("legacy").alias("kind"), sum((F.col(x) for x in P.LEGACY_FLAGS[1:]), F.col(P.LEGACY_FLAGS[0])).alias("hits"),
                                 F.lit("").alias("open_text"), F.lit("").alias("ip"))
    b = Q.dropped_rows(f).select("respondent_id", F.lit("dropped").alias("kind"), sum((F.col(x) for x in P.FLAG_UNION[1:]), F.col(P.FLAG_UNION[0])).alias("hits"), "open_text", "ip")
    return a.unionByName(b)


@query("valid_sample", oracle("survey", flags_ctes() + " SELECT respondent_id, C052 FROM flagged WHERE invalid_union_flag = 0"))
def _(spark, sf):
    return Q.valid_sample(flagged(spark, sf)).select("respondent_id", "C052")


@query("complete_cases", oracle("survey", f"SELECT respondent_id FROM survey WHERE {' AND '.join(x + ' IS NOT NULL' for x in P.SCALE_ITEMS)}"))
def _(spark, sf):
    return Q.complete_cases(view(spark, sf, "survey"), P.SCALE_ITEMS).select("respondent_id")


@query("sensitivity_sample", oracle("survey", flags_ctes() + " SELECT respondent_id FROM flagged WHERE invalid_union_flag = 0 AND attention_flag = 0 AND logic_branch_flag = 0"))
def _(spark, sf):
    return Q.sensitivity_sample(Q.valid_sample(flagged(spark, sf))).select("respondent_id")


@query("attention_subsets", oracle("survey", """SELECT 'main' AS subset, count(*) AS n FROM survey UNION ALL SELECT 'eq1', count(*) FROM survey WHERE C064 = 1
 UNION ALL SELECT 'not_eq1', count(*) FROM survey WHERE C064 <> 1 UNION ALL SELECT 'eq5', count(*) FROM survey WHERE C064 = 5"""))
def _(spark, sf):
    return Q.attention_subsets(view(spark, sf, "survey").select("respondent_id", "C064")).groupBy("subset").agg(F.count(F.lit(1)).alias("n"))


def _sql_violations(cols, bad):
    per = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", coalesce(cast({c} AS varchar), 'missing') AS value FROM survey WHERE {bad.format(c=c)}" for c in cols)
    return (f"v AS ({per}), d AS (SELECT \"column\", value, count(*) AS m, row_number() OVER (PARTITION BY \"column\" ORDER BY value) AS r FROM v GROUP BY 1, 2) "
            "SELECT \"column\", cast(sum(m) AS bigint) AS violations, string_agg(value, '|' ORDER BY value) FILTER (WHERE r <= 8) AS examples FROM d GROUP BY 1")


_VL = [*P.VISITED_BLOCK, *P.SINGLES, *P.LIKERT_ALL]


@query("validate_likert", oracle("survey", _sql_violations(_VL, "{c} IS NULL OR {c} < 1 OR {c} > 5 OR abs({c} - round({c})) > 1e-6")))
def _(spark, sf):
    return Q.likert_violations(view(spark, sf, "survey"), _VL)


_VB = [*P.MULTIS, "C052", "C001"]


@query("validate_binary", oracle("survey", _sql_violations(_VB, "{c} IS NULL OR {c} NOT IN (0, 1)")))
def _(spark, sf):
    return Q.binary_violations(view(spark, sf, "survey"), _VB)


@query("require_columns", oracle("survey", "SELECT respondent_id, C088, C090, C091 FROM survey"))
def _(spark, sf):
    need = ["respondent_id", "C088", "C090", "C091"]
    return T.require_columns(view(spark, sf, "survey"), need).select(*need)


# --- clean and model tables -----------------------------------------------------------------
_CLEAN_OUT = ["C033", "C043", "C052", *P.LEGACY_FLAGS, *P.FLAG_UNION, "visit_depth_bin"]


@query("survey_clean", oracle("survey", clean_ctes() + f" SELECT respondent_id, {', '.join(_CLEAN_OUT)}, " + ", ".join(
    f"round({x}, 6) AS {x}" for x in P.SCORES) + f", {', '.join(P.COUNTS)} FROM clean"))
def _(spark, sf):
    return rounded(clean(spark, sf).select("respondent_id", *_CLEAN_OUT, *P.SCORES, *P.COUNTS), *P.SCORES)


@query("composite_scores", oracle("survey", "SELECT respondent_id, " + ", ".join(f"round(list_avg({sql_list(v)}), 6) AS {k}" for k, v in (
    ("perception", P.PERCEPTION), ("importance", P.IMPORTANCE), ("performance", P.PERFORMANCE), ("cognition", P.COGNITION)))
    + f", coalesce(list_sum({sql_list(P.MOTIVE)}), 0) AS motives, coalesce(list_sum({sql_list(P.PROJECTS)}), 0) AS projects, coalesce(list_sum({sql_list(P.PROMOS)}), 0) AS promos, "
      "(6 - C090 + 6 - C091) / 2.0::double AS r_sum FROM survey"))
def _(spark, sf):
    return view(spark, sf, "survey").select(
        "respondent_id", r6(S.row_nanmean(P.PERCEPTION)).alias("perception"), r6(S.row_nanmean(P.IMPORTANCE)).alias("importance"),
        r6(S.row_nanmean(P.PERFORMANCE)).alias("performance"), r6(S.row_nanmean(P.COGNITION)).alias("cognition"),
        S.row_nansum(P.MOTIVE).alias("motives"), S.row_nansum(P.PROJECTS).alias("projects"), S.row_nansum(P.PROMOS).alias("promos"),
        ((S.reverse_score("C090") + S.reverse_score("C091")) / 2.0).alias("r_sum"))


# --- joins -------------------------------------------------------------------------------------
def _long_answers(spark, sf):
    raw = view(spark, sf, "raw64").select("respondent_id", *[F.col(f"R{s:02d}").alias(str(s)) for s in P.SINGLE_TARGETS])
    return raw.unpivot(["respondent_id"], [str(s) for s in P.SINGLE_TARGETS], "src_col", "value").withColumn("src_col", F.col("src_col").cast("int"))


def _sql_long():
    rows = [(s, "".join(label.split()), d, c) for s, d, label, c in P.codebook_rows() if s in P.SINGLE_TARGETS]
    return ("ans AS (" + " UNION ALL ".join(f"SELECT respondent_id, {s} AS src_col, R{s:02d} AS value FROM raw64" for s in P.SINGLE_TARGETS) + "), "
            f"book AS (SELECT * FROM {_sql_values(rows, 'src_col, label_key, dst_col, code')})")


@query("join_codebook", oracle("raw64", _sql_long() + f" SELECT respondent_id, ans.src_col, value, dst_col, code FROM ans LEFT JOIN book ON ans.src_col = book.src_col AND {sql_norm('value')} = label_key"))
def _(spark, sf):
    return R.join_codebook(_long_answers(spark, sf), P.codebook_table(spark)).select("respondent_id", "src_col", "value", "dst_col", "code")


@query("anti_unknown", oracle("raw64", _sql_long() + f" SELECT respondent_id, src_col, value FROM ans WHERE {sql_norm('value')} <> '' AND NOT EXISTS (SELECT 1 FROM book WHERE book.src_col = ans.src_col AND label_key = {sql_norm('value')})"))
def _(spark, sf):
    return R.anti_unknown(_long_answers(spark, sf), P.codebook_table(spark)).select("respondent_id", "src_col", "value")


def _items_sql():
    return f"it AS (SELECT * FROM {_sql_values([(i, t) for i, t in enumerate(P.ITEM_TEXTS, 1)], 'col_idx, item_text')})"


@query("join_item_text", oracle("survey", "m AS (" + " UNION ALL ".join(f"SELECT {i} AS col_idx, avg({P.c(i)}) AS mean FROM survey" for i in range(66, 90)) + f"), {_items_sql()}"
       " SELECT col_idx, round(mean, 6) AS mean, coalesce(item_text, 'Q' || col_idx) AS item_text FROM m LEFT JOIN it USING (col_idx)"))
def _(spark, sf):
    m = D.item_means(view(spark, sf, "survey"), P.cols((66, 89))).select(D.item_number().alias("col_idx"), r6("mean").alias("mean"))
    return R.join_item_text(m, P.item_table(spark)).select("col_idx", "mean", "item_text")


@query("join_blocks", oracle("survey", "m AS (" + " UNION ALL ".join(f"SELECT {i} AS col_idx, count({P.c(i)}) AS valid_n FROM survey" for i in range(1, 108))
       + f"), b AS (SELECT * FROM {_sql_values(P.BLOCKS, 'lo, hi, block')}) SELECT block, count(*) AS items, cast(sum(valid_n) AS bigint) AS valid_n FROM m JOIN b ON col_idx BETWEEN lo AND hi GROUP BY 1"))
def _(spark, sf):
    m = D.multi_select_rate(view(spark, sf, "survey"), P.NUMERIC).select(D.item_number().alias("col_idx"), "valid_n")
    return R.join_blocks(m, P.span_table(spark, P.BLOCKS, "block")).groupBy("block").agg(F.count(F.lit(1)).alias("items"), F.sum("valid_n").alias("valid_n"))


@query("keep_semi", oracle("survey", flags_ctes() + " SELECT s.respondent_id, s.C001 FROM survey s WHERE respondent_id IN (SELECT respondent_id FROM flagged WHERE invalid_union_flag = 0)"))
def _(spark, sf):
    s = view(spark, sf, "survey")
    return Q.keep_semi(s.select("respondent_id", "C001"), Q.valid_sample(flagged(spark, sf)))


_CUTS = (0.4, 0.5, 0.6)
# A score per line item: the discount scaled to 0..1, against the return flag.
_PRED_SQL = "pred AS (SELECT l_orderkey, l_linenumber, l_orderkey % 1000 AS grp, cast(l_returnflag = 'R' AS int) AS y, (l_discount * 10 + l_tax * 5) / 1.5::double AS p FROM lineitem)"


def _pred(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("y"),
                                              ((F.col("l_discount") * 10 + F.col("l_tax") * 5) / 1.5).alias("p"))


_CONF_SQL = f"""WITH {_PRED_SQL}, c AS (SELECT t AS threshold, count_if(p >= t AND y = 1) AS tp, count_if(p >= t AND y = 0) AS fp, count_if(p < t AND y = 0) AS tn, count_if(p < t AND y = 1) AS fn
 FROM pred CROSS JOIN (VALUES (0.4::double), (0.5::double), (0.6::double)) v(t) GROUP BY 1)
 SELECT threshold, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
 round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c"""


@query("confusion_at", _CONF_SQL)
def _(spark, sf):
    return rounded(K.confusion_at(_pred(spark, sf), "y", "p", _CUTS), "accuracy", "precision", "recall", "f1")


@query("threshold_cross", f"WITH {_PRED_SQL} SELECT t AS threshold, count_if(p >= t) AS n_above, count(*) AS n FROM pred CROSS JOIN (VALUES (0.4::double), (0.5::double), (0.6::double)) v(t) GROUP BY 1")
def _(spark, sf):
    c = K.confusion_at(_pred(spark, sf), "y", "p", _CUTS)
    return c.select("threshold", (F.col("tp") + F.col("fp")).alias("n_above"), (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n"))


# --- windows and ranks ------------------------------------------------------------------------------
@query("dup_rank", oracle("survey", """SELECT respondent_id, row_number() OVER w AS occurrence, count(*) OVER (PARTITION BY C001, C002, C008, C024, ip) AS total FROM survey
 WINDOW w AS (PARTITION BY C001, C002, C008, C024, ip ORDER BY respondent_id)"""))
def _(spark, sf):
    cols = ["C001", "C002", "C008", "C024", "ip"]
    s = view(spark, sf, "survey").select("respondent_id", *cols)
    return K.dup_rank(s, Q.answer_key(cols)).select("respondent_id", "occurrence", "total")


@query("run_islands", oracle("survey", runs_ctes() + " SELECT respondent_id, v, first_pos, len FROM runs"))
def _(spark, sf):
    return S.answer_runs(view(spark, sf, "survey"), P.LIKERT_ALL, "respondent_id")


@query("avg_rank", "SELECT o_orderkey, o_totalprice, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::double AS avg_rank FROM orders")
def _(spark, sf):
    return K.avg_rank(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", "o_totalprice", "avg_rank")


@query("auc_rank", f"""WITH {_PRED_SQL}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::double AS k FROM pred)
 SELECT count_if(y = 1) AS n_pos, count_if(y = 0) AS n_neg, round((sum(k) FILTER (WHERE y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0::double) / (count_if(y = 1)::double * count_if(y = 0)), 6) AS auc FROM r""")
def _(spark, sf):
    return rounded(K.auc_rank(_pred(spark, sf), "y", "p"), "auc")


@query("pr_auc", f"""WITH {_PRED_SQL}, s AS (SELECT p, count_if(y = 1) AS pos, count(*) AS n FROM pred GROUP BY 1),
 c AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC)::double / sum(n) OVER (ORDER BY p DESC) AS precision FROM s)
 SELECT round(sum(pos * precision) / sum(pos), 6) AS pr_auc FROM c""")
def _(spark, sf):
    return rounded(K.pr_auc(_pred(spark, sf), "y", "p"), "pr_auc")


@query("brier_logloss", f"""WITH {_PRED_SQL}, q AS (SELECT y, greatest(1e-6, least(1 - 1e-6, p)) AS p FROM pred)
 SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM q""")
def _(spark, sf):
    return rounded(K.brier_logloss(_pred(spark, sf), "y", "p"), "brier", "log_loss")


@query("kruskal_wallis", """WITH r AS (SELECT o_orderpriority AS g, o_totalprice AS v, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0::double AS k FROM orders),
 s AS (SELECT g, count(*) AS m, sum(k) AS r FROM r GROUP BY 1), t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*)::double AS c FROM orders GROUP BY o_totalprice)),
 a AS (SELECT cast(sum(m) AS bigint) AS n, count(*) AS groups, sum(r * r / m) AS s FROM s),
 h AS (SELECT n, groups, (12.0::double / (n * (n + 1.0::double)) * s - 3 * (n + 1)) / (1 - t / (n::double * n * n - n)) AS h FROM a, t)
 SELECT n, groups, round(h, 6) AS h, groups - 1 AS df, round(greatest(0, (h - groups + 1) / (n - groups)), 6) AS epsilon2, round(exp(-h / 2) * (1 + h / 2), 6) AS p_value FROM h""")
def _(spark, sf):
    from ..functions.pvalues import chi2_p
    k = K.kruskal_wallis(load(spark, sf, "orders"), "o_totalprice", "o_orderpriority")
    return rounded(k.withColumn("p_value", chi2_p("h", F.col("df").cast("double"))), "h", "epsilon2", "p_value")
