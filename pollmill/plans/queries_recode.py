"""Queries for sources, sinks, scalar functions, recoding and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pvalues as PV, scores as S, text as X
from ..operators import describe as D, quality as Q, recode as R
from ..sources import tables as T, workbooks as WB
from ..sources.scratch import new_path
from . import profile as P
from .registry import query, r6, rounded
from .views import load, oracle, view
from .workbook_data import workbooks

# Unicode white space for the check engine's regular expressions.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def sql_norm_ws(c):
    return f"trim(regexp_replace(coalesce({c}, ''), '{WS}', ' ', 'g'))"


def sql_norm(c):
    return f"regexp_replace(coalesce({c}, ''), '{WS}', '', 'g')"


def sql_strip(c):
    return f"regexp_replace(coalesce({c}, ''), '^{WS}|{WS}$', '', 'g')"


# --- sources and sinks ---------------------------------------------------------------
def _customer_books(spark, sf, widths=None):
    """Cells of the customers' workbooks, 200 rows a file, written to the shared folder and scanned there."""
    c = load(spark, sf, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment", F.floor(F.col("c_custkey") / 200).cast("int").alias("chunk"))
    folder = new_path(spark, "books")
    WB.write_workbooks(workbooks(c, "chunk", "c_custkey", widths), folder)
    return WB.scan_workbooks(spark, folder).withColumn("file", WB.file_name())


@query("scan_workbooks", """
WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_custkey // 200 ORDER BY c_custkey) AS row_no FROM customer)
SELECT lpad(cast(c_custkey // 200 AS varchar), 6, '0') || '.xlsx' AS file, row_no AS row_no, cast(c_custkey AS varchar) AS custkey,
 trim(regexp_replace(c_name, '\\s+', ' ', 'g')) AS name, cast(c_nationkey AS varchar) AS nation, c_mktsegment AS segment FROM c""")
def _(spark, sf):
    return WB.sheet_rows(_customer_books(spark, sf), 4, ["custkey", "name", "nation", "segment"])


@query("detect_layout", """
SELECT lpad(cast(c_custkey // 200 AS varchar), 6, '0') || '.xlsx' AS file,
 CASE (c_custkey // 200) % 3 WHEN 0 THEN 64 WHEN 1 THEN 108 ELSE 70 END AS n_columns,
 CASE (c_custkey // 200) % 3 WHEN 0 THEN 'new961_64' WHEN 1 THEN 'amethyst_108' END AS layout
FROM customer GROUP BY ALL""")
def _(spark, sf):
    return WB.detect_layout(_customer_books(spark, sf, [64, 108, 70]))


_CSV_COLS = P.CODES[:107]  # C108 is text


@query("scan_survey_csv", oracle("survey", f"SELECT respondent_id, {', '.join(f'cast({x} AS double) AS {x}' for x in _CSV_COLS)}, cast(NULL AS double) AS C109 FROM survey"))
def _(spark, sf):
    path = new_path(spark, "survey-csv")
    T.sink_table(view(spark, sf, "survey").select("respondent_id", *_CSV_COLS), path, "csv", "fail")
    return T.scan_survey_csv(spark, path, ["respondent_id", *_CSV_COLS], [*_CSV_COLS, "C109"])


@query("positional_rename", oracle("survey", "SELECT C001, C052, C107, duration_sec AS extra FROM survey"))
def _(spark, sf):
    s = view(spark, sf, "survey").select(*P.CODES, F.col("duration_sec").alias("extra"))
    return T.positional_rename(s.toDF(*[f"q{i}" for i in range(1, 109)], "extra"), P.CODES, ["extra"]).select(
        "C001", "C052", "C107", "extra")


@query("raw_export", oracle("coded_text", "SELECT * FROM coded_text"))
def _(spark, sf):
    path = new_path(spark, "raw")
    T.sink_table(view(spark, sf, "coded_text"), path)
    return spark.read.parquet(path)


@query("sink_table", "SELECT o_orderpriority AS code, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM orders), 6) AS pct "
                     "FROM orders GROUP BY 1")
def _(spark, sf):
    path = new_path(spark, "sink")
    T.sink_table(rounded(D.freq_text(load(spark, sf, "orders"), "o_orderpriority"), "pct"), path)
    return spark.read.parquet(path)


@query("write_modes", """
SELECT 'skip' AS mode, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL
SELECT 'fail', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'replace', count(*) FROM orders""")
def _(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    out = None
    for mode in T.WRITE_MODES:
        path = new_path(spark, mode)
        T.sink_table(o.filter("o_orderstatus = 'F'"), path)
        try:
            T.sink_table(o, path, mode=mode)
        except Exception as e:  # only "fail" may refuse an existing target
            if mode != "fail" or "ALREADY_EXISTS" not in str(e):
                raise
        row = spark.read.parquet(path).agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


# --- scalar functions ------------------------------------------------------------------
@query("norm_ws", f"SELECT doc_id, {sql_norm_ws('text')} AS text FROM documents")
def _(spark, sf):
    return load(spark, sf, "documents").select("doc_id", X.norm_ws("text").alias("text"))


@query("norm_label", oracle("raw64", f"SELECT respondent_id, {sql_norm('R10')} AS k10, {sql_norm('R11')} AS k11, {sql_norm('R15')} AS k15 FROM raw64"))
def _(spark, sf):
    return view(spark, sf, "raw64").select("respondent_id", *[X.norm_label(f"R{i}").alias(f"k{i}") for i in (10, 11, 15)])


@query("is_other", oracle("raw64", f"SELECT respondent_id, starts_with({sql_norm('R10')}, '其他') AS q4, starts_with({sql_norm('R07')}, '其他') AS q1 FROM raw64"))
def _(spark, sf):
    return view(spark, sf, "raw64").select("respondent_id", X.is_other("R10").alias("q4"), X.is_other("R07").alias("q1"))


@query("split_multi", oracle("raw64", f"""
t AS (SELECT respondent_id, unnest(string_split(R16, '┋')) AS tok, generate_subscripts(string_split(R16, '┋'), 1) AS pos FROM raw64),
u AS (SELECT respondent_id, pos, {sql_strip('tok')} AS tok FROM t)
SELECT respondent_id, tok AS token, row_number() OVER (PARTITION BY respondent_id ORDER BY pos) - 1 AS pos FROM u WHERE tok <> ''"""))
def _(spark, sf):
    return view(spark, sf, "raw64").select("respondent_id", F.posexplode(X.split_multi("R16")).alias("pos", "token")).select(
        "respondent_id", "token", F.col("pos").cast("bigint").alias("pos"))


_CT = ["C001", "C004", "C009"]


def _sql_code(c):
    w = sql_norm_ws(c)
    return f"trim(CASE WHEN contains({w}, '^') THEN split_part({w}, '^', 1) ELSE {w} END)"


@query("split_code_text", oracle("coded_text", "SELECT respondent_id, " + ", ".join(
    f"{_sql_code(c)} AS {c}_code, trim(CASE WHEN contains({c}, '^') THEN substr({sql_norm_ws(c)}, instr({sql_norm_ws(c)}, '^') + 1) ELSE '' END) AS {c}_text"
    for c in _CT) + " FROM coded_text"))
def _(spark, sf):
    out = []
    for c in _CT:
        parts = X.split_code_text(c)
        out += [parts["code"].alias(f"{c}_code"), parts["text"].alias(f"{c}_text")]
    return view(spark, sf, "coded_text").select("respondent_id", *out)


@query("safe_float", oracle("coded_text", "SELECT respondent_id, " + ", ".join(
    f"CASE WHEN regexp_full_match({sql_norm_ws(c)}, '[-+]?[0-9]+(\\.[0-9]+)?') THEN cast({sql_norm_ws(c)} AS double) END AS {c}" for c in _CT) + " FROM coded_text"))
def _(spark, sf):
    return view(spark, sf, "coded_text").select("respondent_id", *[X.safe_float(c).alias(c) for c in _CT])


@query("to_float", oracle("coded_text", "SELECT respondent_id, " + ", ".join(f"try_cast(trim({c}) AS double) AS {c}" for c in _CT) + " FROM coded_text"))
def _(spark, sf):
    return view(spark, sf, "coded_text").select("respondent_id", *[X.to_float(c).alias(c) for c in _CT])


@query("parse_duration", oracle("raw64", r"""SELECT r.respondent_id, try_cast(nullif(regexp_extract(r.R03, '([0-9]+(\.[0-9]+)?)', 1), '') AS double) AS seconds FROM raw64 r
UNION ALL SELECT -1 - event_id, try_cast(nullif(regexp_extract(props, '([0-9]+(\.[0-9]+)?)', 1), '') AS double) FROM events"""))
def _(spark, sf):
    a = view(spark, sf, "raw64").select("respondent_id", X.parse_duration("R03").alias("seconds"))
    return a.unionByName(load(spark, sf, "events").select((-1 - F.col("event_id")).alias("respondent_id"), X.parse_duration("props").alias("seconds")))


def sql_gibberish(c):
    n = sql_norm(c)
    punct = r"[/\\.|。\-_=+*~`!@#$%^&()\[\]{}<>?]+"
    return f"cast({n} IN ('好', '行', '嗯呢') OR regexp_full_match({n}, '{punct}') OR regexp_full_match({n}, '[0-9]{{1,3}}') AS int)"


@query("open_text_gibberish", oracle("raw64", f"""SELECT respondent_id AS id, {sql_gibberish('R64')} AS flag FROM raw64
UNION ALL SELECT -1 - doc_id, {sql_gibberish('text')} FROM documents"""))
def _(spark, sf):
    a = view(spark, sf, "raw64").select(F.col("respondent_id").alias("id"), X.open_text_gibberish("R64").alias("flag"))
    return a.unionByName(load(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("id"), X.open_text_gibberish("text").alias("flag")))


@query("recode_binary_high", oracle("survey", "SELECT respondent_id, CASE WHEN C090 IN (1, 2) THEN 1.0::double WHEN C090 IN (3, 4, 5) THEN 0.0::double END AS y FROM survey"))
def _(spark, sf):
    return view(spark, sf, "survey").select("respondent_id", S.recode_binary_high("C090").alias("y"))


@query("reverse_score", oracle("survey", "SELECT respondent_id, 6.0::double - C090 AS r90, 6.0::double - C083 AS r83 FROM survey"))
def _(spark, sf):
    return view(spark, sf, "survey").select("respondent_id", S.reverse_score("C090").alias("r90"), S.reverse_score("C083").alias("r83"))


@query("missing_codes_to_null", oracle("survey", "SELECT respondent_id, nullif(C033, -3) AS C033, nullif(C043, -3) AS C043, CASE WHEN C045 >= 0 THEN C045 END AS C045 FROM survey"))
def _(spark, sf):
    return view(spark, sf, "survey").select("respondent_id", S.codes_to_null("C033").alias("C033"), S.codes_to_null("C043").alias("C043"),
                                            S.negatives_to_null("C045").alias("C045"))


def sql_list(columns):
    return "[" + ", ".join(columns) + "]"


@query("row_nanmean", oracle("survey", f"SELECT respondent_id, round(list_avg({sql_list(P.PERCEPTION)}), 6) AS m, round(list_avg({sql_list(P.COGNITION)}), 6) AS c FROM survey"))
def _(spark, sf):
    return view(spark, sf, "survey").select("respondent_id", r6(S.row_nanmean(P.PERCEPTION)).alias("m"), r6(S.row_nanmean(P.COGNITION)).alias("c"))


@query("row_nansum", oracle("survey", f"SELECT respondent_id, coalesce(list_sum({sql_list(P.MOTIVE)}), 0) AS s, coalesce(list_sum({sql_list(P.COGNITION)}), 0) AS c FROM survey"))
def _(spark, sf):
    return view(spark, sf, "survey").select("respondent_id", S.row_nansum(P.MOTIVE).alias("s"), S.row_nansum(P.COGNITION).alias("c"))


def runs_ctes(view_name="survey"):
    """Runs of equal answers per respondent, missing answers dropped first."""
    return (f"items AS (SELECT respondent_id, unnest({list(range(52, 90))}) AS pos, unnest({sql_list(P.LIKERT_ALL)}) AS v FROM {view_name}), "
            "present AS (SELECT *, row_number() OVER (PARTITION BY respondent_id ORDER BY pos) AS rn FROM items WHERE v IS NOT NULL), "
            "isl AS (SELECT *, rn - row_number() OVER (PARTITION BY respondent_id, v ORDER BY rn) AS g FROM present), "
            "runs AS (SELECT respondent_id, v, g, min(pos) AS first_pos, count(*) AS len FROM isl GROUP BY 1, 2, 3)")


@query("max_same_run", oracle("survey", runs_ctes() + " SELECT respondent_id, cast(max(len) AS int) AS run FROM runs GROUP BY 1"))
def _(spark, sf):
    return view(spark, sf, "survey").select("respondent_id", S.max_same_run(P.LIKERT_ALL).alias("run"))


@query("scale_profile", oracle("survey", runs_ctes() + """ SELECT respondent_id, cast(count(DISTINCT v) AS int) AS distinct_n,
 round(count_if(v IN (1, 5)) / count(*), 6) AS extreme FROM present GROUP BY 1"""))
def _(spark, sf):
    return view(spark, sf, "survey").select("respondent_id", S.distinct_count(P.LIKERT_ALL).alias("distinct_n"),
                                            r6(S.extreme_share(P.LIKERT_ALL)).alias("extreme"))


@query("visit_depth", oracle("survey", "SELECT respondent_id, cast(coalesce(C024 >= 3 AND C025 >= 3, false) AS int) AS depth, cast(coalesce(C024 >= 3, false) AS int) AS stay, "
                                       "cast(coalesce(C070 >= 3, false) AS int) AS item FROM survey"))
def _(spark, sf):
    return view(spark, sf, "survey").select("respondent_id", S.visit_depth("C024", "C025").alias("depth"), S.at_least("C024").alias("stay"), S.at_least("C070").alias("item"))


@query("quadrant_label", oracle("survey", """SELECT respondent_id, CASE WHEN C066 >= 3 AND C076 >= 3 THEN 'Q1_优势区' WHEN C066 < 3 AND C076 >= 3 THEN 'Q2_维持区'
 WHEN C066 < 3 AND C076 < 3 THEN 'Q3_机会区' WHEN C066 >= 3 AND C076 < 3 THEN 'Q4_改进区' END AS quadrant FROM survey"""))
def _(spark, sf):
    return view(spark, sf, "survey").select("respondent_id", S.quadrant_label("C066", "C076", 3, 3, P.IPA_QUADRANTS).alias("quadrant"))


@query("sign_label", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN '正向' WHEN c_acctbal < 0 THEN '负向' ELSE '零' END AS sign FROM customer")
def _(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", S.sign_label("c_acctbal").alias("sign"))


# Series of the error function: erf(x) = 2/sqrt(pi) exp(-x^2) sum_n 2^n x^(2n+1) / (2n+1)!!
SQL_ERF = """erf_terms AS (
 WITH RECURSIVE s(k, x, n, term, total) AS (
  SELECT k, x, 0, x, x FROM zs UNION ALL
  SELECT k, x, n + 1, term * 2 * x * x / (2 * n + 3), total + term * 2 * x * x / (2 * n + 3) FROM s WHERE n < 150)
 SELECT k, 1 - 2 / sqrt(pi()) * exp(-x * x) * total AS erfc FROM s WHERE n = 150)"""


@query("normal_p", f"""WITH g AS (SELECT o_orderpriority AS k, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v, count(*) AS n FROM orders GROUP BY 1),
 a AS (SELECT avg(o_totalprice) AS m FROM orders), z AS (SELECT k, (g.m - a.m) / sqrt(v / n) AS z FROM g, a),
 zs AS (SELECT k, abs(z) / sqrt(2) AS x FROM z), {SQL_ERF}
 SELECT z.k AS grp, round(z.z, 6) AS z, round(e.erfc, 6) AS p FROM z JOIN erf_terms e USING (k)""")
def _(spark, sf):
    o = load(spark, sf, "orders")
    g = o.groupBy(F.col("o_orderpriority").alias("grp")).agg(F.avg("o_totalprice").alias("m"), F.var_samp("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))
    z = (F.col("m") - o.agg(F.avg("o_totalprice")).scalar()) / F.sqrt(F.col("v") / F.col("n"))
    return rounded(g.select("grp", z.alias("z")).withColumn("p", PV.normal_p("z")), "z", "p")


_THRESH = "(VALUES ('CMIN/DF', 'lt', 3.0), ('RMSEA', 'lt', 0.08), ('CFI', 'gt', 0.90), ('TLI', 'gt', 0.90), ('SRMR', 'lt', 0.08)) t(metric, op, threshold)"


@query("metric_threshold", f"""SELECT l.l_orderkey, l.l_linenumber, t.metric, CASE WHEN op = 'lt' THEN l_discount < threshold ELSE l_discount > threshold END AS pass
 FROM lineitem l JOIN {_THRESH} ON t.metric = ['RMSEA', 'CFI', 'TLI', 'SRMR', 'CMIN/DF'][cast(l_linenumber % 5 + 1 AS int)]""")
def _(spark, sf):
    names = F.array(*[F.lit(m) for m in ("RMSEA", "CFI", "TLI", "SRMR", "CMIN/DF")])
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", names[F.col("l_linenumber") % 5].alias("metric"))
    t = F.broadcast(P.cutoff_table(spark))
    return li.join(t, "metric").select("l_orderkey", "l_linenumber", "metric", S.pass_threshold("l_discount", "op", "threshold").alias("pass"))


@query("term_parse", oracle("survey", """t AS (SELECT DISTINCT 'C(C002)[T.' || cast(C002 AS varchar) || ']' AS term FROM survey UNION
 SELECT DISTINCT 'C(C004)[T.' || cast(C004 AS varchar) || ']' FROM survey UNION SELECT 'Intercept' UNION SELECT 'C088')
SELECT term, CASE WHEN term LIKE 'C(%' THEN substr(term, 3, 4) ELSE term END AS variable,
 CASE WHEN term LIKE 'C(%' THEN split_part(split_part(split_part(term, '[T.', 2), ']', 1), '.', 1) END AS level, cast(term LIKE 'C(%' AS int) AS is_dummy FROM t"""))
def _(spark, sf):
    s = view(spark, sf, "survey")
    made = [s.select(F.concat(F.lit(f"C({c})[T."), F.col(c).cast("string"), F.lit("]")).alias("term")) for c in ("C002", "C004")]
    terms = made[0].unionByName(made[1]).distinct().unionByName(spark.createDataFrame([("Intercept",), ("C088",)], "term string"))
    return terms.select("term", X.term_parts("term").alias("p")).select("term", "p.*")


@query("num_format", """SELECT l_orderkey, l_linenumber, CASE WHEN abs(v - round(v)) < 1e-12 THEN cast(cast(round(v) AS bigint) AS varchar) ELSE format('{:.6f}', v) END AS shown,
 format('{:.4f}', v) AS shown4 FROM (SELECT l_orderkey, l_linenumber, l_quantity / 7.0::double AS v FROM lineitem)""")
def _(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 7.0).alias("v"))
    return li.select("l_orderkey", "l_linenumber", X.num_format("v").alias("shown"), X.num_format("v", 4, False).alias("shown4"))


# --- recoding and reshaping ---------------------------------------------------------------
def sql_book(src):
    rows = {}
    for s, _, label, code in P.codebook_rows():
        if s == src:
            rows["".join(label.split())] = code
    return rows


def sql_map_single(src):
    book = sql_book(src)
    n = sql_norm(f"R{src:02d}")
    other = f" WHEN starts_with({n}, '其他') THEN {book['其他']}" if "其他" in book else ""
    return f"CASE {' '.join(f'WHEN {n} = {chr(39)}{k}{chr(39)} THEN {v}' for k, v in book.items())}{other} END"


@query("map_single", oracle("raw64", "SELECT respondent_id, " + ", ".join(f"{sql_map_single(s)} AS {P.c(d)}" for s, d in P.SINGLE_TARGETS.items()) + " FROM raw64"))
def _(spark, sf):
    return view(spark, sf, "raw64").select("respondent_id", *[
        R.map_single(F.col(f"R{s:02d}"), P.SINGLE_BOOKS[s]).alias(P.c(d)) for s, d in P.SINGLE_TARGETS.items()])


def _sql_multi(q, cte="raw64"):
    src, dst = P.MULTI_SOURCES[q]
    opts = P.OPTIONS[q]
    keys = ["".join(o.split()) for o in opts]
    toks = (f"{q}_t AS (SELECT respondent_id, unnest(string_split(R{src:02d}, '┋')) AS tok, generate_subscripts(string_split(R{src:02d}, '┋'), 1) AS pos FROM {cte}), "
            f"{q}_u AS (SELECT respondent_id, pos, {sql_strip('tok')} AS tok, {sql_norm('tok')} AS k FROM {q}_t), "
            f"{q}_v AS (SELECT * FROM {q}_u WHERE k <> '' AND k <> '(跳过)')")
    cols = ", ".join(f"CASE WHEN bool_or(v.k = '{k}') THEN '1' ELSE '0' END AS {P.c(dst + n)}" for n, k in enumerate(keys[:-1]))
    last = (f"coalesce('1' || nullif(arg_max(CASE WHEN v.k = '其他' THEN '' ELSE '^' || v.tok END, v.pos) FILTER (WHERE starts_with(v.k, '其他')), ''), "
            f"CASE WHEN bool_or(starts_with(v.k, '其他')) THEN '1' ELSE '0' END) AS {P.c(dst + len(opts) - 1)}")
    body = f"SELECT r.respondent_id, {cols}, {last} FROM {cte} r LEFT JOIN {q}_v v USING (respondent_id) GROUP BY 1"
    return toks, body


def _sql_multis():
    made = {q: _sql_multi(q) for q in P.MULTI_SOURCES}
    head = ", ".join(f"{toks}, {q}_m AS ({body})" for q, (toks, body) in made.items())
    return head + " SELECT * FROM " + " JOIN ".join(f"{q}_m" if n == 0 else f"{q}_m USING (respondent_id)" for n, q in enumerate(made))


@query("map_multi", oracle("raw64", _sql_multis()))
def _(spark, sf):
    cells = {P.c(dst + n): x for q, (src, dst) in P.MULTI_SOURCES.items() for n, x in enumerate(R.map_multi(F.col(f"R{src:02d}"), P.OPTIONS[q]))}
    return view(spark, sf, "raw64").select("respondent_id", *[x.alias(c) for c, x in cells.items()])


def _sql_recode():
    """Every coded column, as CTEs: singles in one projection, one grouped CTE per question."""
    head, parts = [], []
    for q in P.MULTI_SOURCES:
        toks, body = _sql_multi(q)
        head += [toks, f"{q}_m AS ({body})"]
    singles = {d: f"coalesce(cast({sql_map_single(s)} AS varchar), '')" for s, d in P.SINGLE_TARGETS.items()}
    for lo, hi, dst, _ in P.LIKERT_BOOKS:
        singles |= {dst + s - lo: f"coalesce(cast({sql_map_single(s)} AS varchar), '')" for s in range(lo, hi + 1)}
    status = sql_map_single(14)
    for i in range(1, 108):
        name = P.c(i)
        if i in singles:
            parts.append(f"{singles[i]} AS {name}")
        elif 33 <= i <= 42:
            parts.append(f"CASE {status} WHEN 1 THEN Q14_m.{name} WHEN 2 THEN '-3' ELSE '' END AS {name}")
        elif 43 <= i <= 51:
            parts.append(f"CASE {status} WHEN 2 THEN Q15_m.{name} WHEN 1 THEN '-3' ELSE '' END AS {name}")
        else:
            parts.append(name)
    parts.append(f"CASE WHEN {sql_strip('R64')} = '' THEN '无' ELSE {sql_strip('R64')} END AS C108")
    joins = " ".join(f"JOIN {q}_m USING (respondent_id)" for q in P.MULTI_SOURCES)
    return ", ".join(head), f"SELECT respondent_id, {', '.join(parts)} FROM raw64 {joins}"


@query("recode_wide", oracle("raw64", " ".join(_sql_recode())))
def _(spark, sf):
    return R.recode_wide(view(spark, sf, "raw64"), P)


@query("branch_skip", oracle("raw64", ", ".join([_sql_multi("Q14")[0], f"Q14_m AS ({_sql_multi('Q14')[1]})", _sql_multi("Q15")[0], f"Q15_m AS ({_sql_multi('Q15')[1]})"])
       + f""" SELECT respondent_id, {', '.join(f"CASE {sql_map_single(14)} WHEN 1 THEN {c} WHEN 2 THEN '-3' ELSE '' END AS {c}" for c in P.VISITED_BLOCK)},
 {', '.join(f"CASE {sql_map_single(14)} WHEN 2 THEN {c} WHEN 1 THEN '-3' ELSE '' END AS {c}" for c in P.UNVISITED_BLOCK)},
 cast(CASE {sql_map_single(14)} WHEN 1 THEN respondent_id IN (SELECT respondent_id FROM Q15_v) WHEN 2 THEN respondent_id IN (SELECT respondent_id FROM Q14_v)
  ELSE respondent_id IN (SELECT respondent_id FROM Q15_v) OR respondent_id IN (SELECT respondent_id FROM Q14_v) END AS int) AS conflict
 FROM raw64 JOIN Q14_m USING (respondent_id) JOIN Q15_m USING (respondent_id)"""))
def _(spark, sf):
    status = R.map_single(F.col("R14"), P.SINGLE_BOOKS[14])
    v, u = R.branch_skip(status, R.map_multi(F.col("R20"), P.OPTIONS["Q14"]), R.map_multi(F.col("R21"), P.OPTIONS["Q15"]))
    return view(spark, sf, "raw64").select("respondent_id", *[x.alias(c) for c, x in zip(P.VISITED_BLOCK + P.UNVISITED_BLOCK, [*v, *u])],
                                           R.branch_conflict(status, F.col("R20"), F.col("R21")).alias("conflict"))


def _sql_log():
    sources = [(s, str(P.SINGLE_TARGETS[s])) for s in P.SINGLE_TARGETS]
    for lo, hi, dst, _ in P.LIKERT_BOOKS:
        sources += [(s, str(dst + s - lo)) for s in range(lo, hi + 1)]
    rows = [f"SELECT respondent_id AS row_id, {s} AS source_col_idx, {sql_strip(f'R{s:02d}')} AS source_value, '{d}' AS target_col_idx, 'single_unmapped' AS reason "
            f"FROM raw64 WHERE {sql_strip(f'R{s:02d}')} <> '' AND {sql_map_single(s)} IS NULL" for s, d in sources]
    head = []
    for q, (src, dst) in P.MULTI_SOURCES.items():
        head.append(_sql_multi(q)[0])
        known = ", ".join("'" + "".join(o.split()) + "'" for o in P.OPTIONS[q])
        own = {"Q14": 1, "Q15": 2}.get(q)
        branch = f" AND respondent_id IN (SELECT respondent_id FROM raw64 WHERE {sql_map_single(14)} = {own})" if own else ""
        rows.append(f"SELECT respondent_id, {src}, tok, '{dst}-{dst + len(P.OPTIONS[q]) - 1}', 'multi_unmapped' FROM {q}_v "
                    f"WHERE NOT starts_with(k, '其他') AND k NOT IN ({known}){branch}")
    return ", ".join(head) + ", unknown_log AS (" + " UNION ALL ".join(rows) + ")"


@query("unknown_value_log", oracle("raw64", _sql_log() + " SELECT * FROM unknown_log"))
def _(spark, sf):
    return R.unknown_value_log(view(spark, sf, "raw64"), P)


def _sql_audit():
    other = " + ".join(f"(SELECT count(*) FROM {q}_v WHERE starts_with(k, '其他') AND k <> '其他'"
                       + (f" AND respondent_id IN (SELECT respondent_id FROM raw64 WHERE {sql_map_single(14)} = {own})" if (own := {"Q14": 1, "Q15": 2}.get(q)) else "") + ")"
                       for q in P.MULTI_SOURCES)
    conflict = (f"(SELECT count(*) FROM raw64 WHERE CASE {sql_map_single(14)} WHEN 1 THEN respondent_id IN (SELECT respondent_id FROM Q15_v) "
                "WHEN 2 THEN respondent_id IN (SELECT respondent_id FROM Q14_v) ELSE respondent_id IN (SELECT respondent_id FROM Q15_v) "
                "OR respondent_id IN (SELECT respondent_id FROM Q14_v) END)")
    return (f", tot AS (SELECT (SELECT count(*) FROM raw64) AS n, (SELECT count(*) FROM unknown_log) AS u, {other} AS o, {conflict} AS b) "
            "SELECT n AS n_rows, u AS unknown_value_count, round(u / (n * 108.0::double), 8) AS unknown_value_rate, o AS other_text_count, b AS branch_conflict_count, "
            "round(b / n::double, 8) AS branch_conflict_rate, round(greatest(0, least(1, 1 - u / (n * 108.0::double) - 0.5::double * b / n)), 8) AS conversion_integrity FROM tot")


@query("conversion_audit", oracle("raw64", _sql_log() + _sql_audit()))
def _(spark, sf):
    return rounded(R.conversion_audit(view(spark, sf, "raw64"), P), "unknown_value_rate", "branch_conflict_rate", "conversion_integrity", digits=8)


@query("conversion_audit_coded", oracle("coded_text", """SELECT count(*) AS n_rows, 0::bigint AS unknown_value_count, 0.0::double AS unknown_value_rate, 0::bigint AS other_text_count, 0::bigint AS branch_conflict_count,
 0.0::double AS branch_conflict_rate, 1.0::double AS conversion_integrity FROM coded_text"""))
def _(spark, sf):
    return R.coded_audit(view(spark, sf, "coded_text"))


_CELLS = P.CODES


@query("numeric_cells", oracle("coded_text", "SELECT respondent_id, " + ", ".join(
    f"CASE WHEN regexp_full_match({_sql_code(c)}, '[-+]?[0-9]+(\\.[0-9]+)?') THEN cast({_sql_code(c)} AS double) END AS {c}" for c in _CELLS) + " FROM coded_text"))
def _(spark, sf):
    return R.numeric_cells(view(spark, sf, "coded_text"), _CELLS)


@query("cell_markers", oracle("coded_text", f"""cell AS (SELECT respondent_id, unnest({list(range(1, 109))}) AS col_idx, unnest([{', '.join(_CELLS)}]) AS v FROM coded_text)
 SELECT respondent_id, col_idx, trim(split_part({sql_norm_ws('v')}, '^', 2)) AS marker_text FROM cell WHERE contains(v, '^')"""))
def _(spark, sf):
    return R.cell_markers(view(spark, sf, "coded_text"), _CELLS)


@query("quality_context", oracle("raw64", rf"""SELECT respondent_id, try_cast(nullif(regexp_extract(R03, '([0-9]+(\.[0-9]+)?)', 1), '') AS double) AS duration_sec,
 {sql_strip('R06')} AS ip, {sql_strip('R14')} AS q8_text, {sql_strip('R20')} AS q14_text, {sql_strip('R21')} AS q15_text, {sql_strip('R34')} AS attention_text, {sql_strip('R64')} AS open_text FROM raw64"""))
def _(spark, sf):
    return R.quality_context(view(spark, sf, "raw64"))


def _sql_values(rows, names):
    def lit(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") v({names})"


def _answered(spark, sf):
    """Valid answers per coded column, over the whole table."""
    counts = D.multi_select_rate(view(spark, sf, "survey"), P.NUMERIC).select("item", "valid_n")
    return counts.withColumn("col_idx", D.item_number())


def _sql_answered():
    return "ans AS (" + " UNION ALL ".join(f"SELECT {i} AS col_idx, count({P.c(i)}) AS valid_n FROM survey" for i in range(1, 108)) + ")"


@query("variable_dictionary", oracle("survey", _sql_answered() + f""",
 it AS (SELECT * FROM {_sql_values([(i, P.c(i), t) for i, t in enumerate(P.ITEM_TEXTS, 1)], 'col_idx, var_code, item_text')}),
 b AS (SELECT * FROM {_sql_values(P.BLOCKS, 'lo, hi, question_block')}), ty AS (SELECT * FROM {_sql_values(P.ITEM_TYPES, 'lo, hi, item_type')}),
 us AS (SELECT * FROM {_sql_values(P.MODEL_USES, 'rnk, lo, hi, use')}), mr AS (SELECT * FROM {_sql_values(P.MISSING_RULES, 'lo, hi, missing_rule')})
 SELECT ans.valid_n, it.col_idx, it.var_code, it.item_text, (SELECT question_block FROM b WHERE it.col_idx BETWEEN lo AND hi) AS question_block,
 coalesce((SELECT item_type FROM ty WHERE it.col_idx BETWEEN lo AND hi), '多选/二元') AS item_type,
 coalesce((SELECT string_agg(use, '；' ORDER BY rnk) FROM us WHERE it.col_idx BETWEEN lo AND hi), '描述统计') AS model_use,
 coalesce((SELECT missing_rule FROM mr WHERE it.col_idx BETWEEN lo AND hi), '空值/异常编码记缺失') AS missing_rule FROM it JOIN ans USING (col_idx)"""))
def _(spark, sf):
    return R.variable_dictionary(spark, P).join(_answered(spark, sf).select("col_idx", "valid_n"), "col_idx")


@query("field_mapping", oracle("survey", f"""m AS (SELECT 'perception_mean' AS f, avg(list_avg({sql_list(P.PERCEPTION)})) AS v FROM survey UNION ALL
 SELECT 'cognition_mean', avg(list_avg({sql_list(P.COGNITION)})) FROM survey UNION ALL SELECT 'unmapped', count(*)::double FROM survey),
 fm AS (SELECT * FROM {_sql_values(P.FIELD_MAP, 'english_field, chinese_label, business_meaning, model_scope')})
 SELECT f AS metric, round(v, 6) AS value, coalesce(chinese_label, f) AS label, model_scope FROM m LEFT JOIN fm ON f = english_field"""))
def _(spark, sf):
    s = view(spark, sf, "survey")
    row = s.agg(F.avg(S.row_nanmean(P.PERCEPTION)).alias("perception_mean"), F.avg(S.row_nanmean(P.COGNITION)).alias("cognition_mean"),
                F.count(F.lit(1)).alias("unmapped"))
    m = T.metrics_table(row)
    f = F.broadcast(P.field_table(spark).withColumnRenamed("english_field", "metric"))
    return m.join(f, "metric", "left").select("metric", r6("value").alias("value"), F.coalesce("chinese_label", "metric").alias("label"), "model_scope")
