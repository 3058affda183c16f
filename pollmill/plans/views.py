"""Survey-shaped views derived from the given tables.

The text is plain SQL that Spark and DuckDB both run, so a query and its check start from the
same rows.  Every view grows with its table; nothing here is fixed-size input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import profile as P

PRIMES = [3, 7, 11, 13, 17, 19, 23, 29, 31, 37]
CONTEXT = ["duration_sec", "ip", "q8_text", "q14_text", "q15_text", "attention_text"]
_LIKERT = range(52, 92)


def _pick(k: int) -> str:
    """Condition under which option column k is selected."""
    return f"(x{k % 9 + 2} % {3 + k % 4} = 0)"


def _likert(j: int, straight: bool) -> str:
    noisy = f"least(5, greatest(1, latent + (t{PRIMES[j % 10]} + {j}) % 3 - 1))"
    fixed = "WHEN ok % 89 = 0 THEN 3 " if straight else ""
    return f"CASE WHEN (t7 + {j}) % 211 = 0 THEN NULL {fixed}ELSE {noisy} END"


def _branch(k: int, own: int) -> str:
    here = f"CASE WHEN {_pick(k)} THEN 1 ELSE 0 END"
    return f"CASE WHEN (status = {own}) <> (ok % 97 = 0) THEN {here} ELSE -3 END"


def _codes(straight: bool) -> dict[int, str]:
    out = {1: "1 + ok % 2", 2: "1 + ck % 5", 8: "status", 24: "1 + (13 * ok + ck) % 4", 25: "1 + (17 * ok + ck) % 5"}
    out |= {i: f"1 + x{m} % 5" for i, m in zip(range(3, 8), (3, 5, 7, 9, 11))}
    plain = [*range(9, 24), *range(26, 33), *range(92, 108)]
    out |= {k: f"CASE WHEN {_pick(k)} THEN 1 ELSE 0 END" for k in plain}
    out |= {k: _branch(k, 1) for k in range(33, 43)} | {k: _branch(k, 2) for k in range(43, 52)}
    out |= {j: _likert(j, straight) for j in _LIKERT}
    return out


def base_cte() -> str:
    # Shared terms are columns of their own, so wide projections stay small when compiled.
    terms = [f"{p} * ok AS t{p}" for p in PRIMES] + [f"{m} * ck + ok AS x{m}" for m in range(2, 12)]
    terms += [f"ok % {m} AS m{m}" for m in (53, 59, 61)]
    return ("keys AS (SELECT o_orderkey AS ok, o_custkey AS ck, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS status, "
            "1 + cast(floor(o_totalprice) AS bigint) % 5 AS latent FROM {orders}), "
            f"base AS (SELECT ok, ck, status, latent, {', '.join(terms)} FROM keys)")


def coded_cte(straight: bool = True) -> str:
    codes = _codes(straight)
    numbers = ", ".join(f"cast({codes[i]} AS double) AS {P.c(i)}" for i in range(1, 108))
    own = "CASE WHEN status = {s} OR ok % 97 = 0 THEN '有作答' ELSE '(跳过)' END"
    return (
        f"coded AS (SELECT ok + 1 AS respondent_id, {numbers}, "
        "CASE ok % 83 WHEN 0 THEN '好' WHEN 1 THEN '111' WHEN 2 THEN '/' ELSE '无' END AS C108, "
        "cast(60 + ok % 400 AS double) AS duration_sec, concat('10.0.', cast(ck % 50 AS string)) AS ip, "
        "CASE WHEN ok % 13 = 0 THEN '' WHEN status = 1 THEN '是' ELSE '否' END AS q8_text, "
        f"{own.format(s=1)} AS q14_text, {own.format(s=2)} AS q15_text, "
        f"CASE WHEN ok % 17 = 0 THEN '' WHEN ({codes[64]}) = 1 THEN '完全不同意' ELSE '同意' END AS attention_text "
        "FROM base)")


def survey_cte() -> str:
    rest = ", ".join([*P.CODES, *CONTEXT])
    return (f"survey AS (SELECT 2 * respondent_id AS respondent_id, {rest} FROM coded UNION ALL "
            f"SELECT 2 * respondent_id + 1 AS respondent_id, {rest} FROM coded WHERE (respondent_id - 1) % 101 = 0)")


# --- the 64-column label sheet ------------------------------------------------------
def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _single(src: int, code: str, book: dict[str, int]) -> str:
    labels: dict[int, str] = {}
    for label, value in book.items():
        labels.setdefault(value, label)
    listed = "|".join(labels.get(k, "") for k in range(1, max(labels) + 1))
    label = f"coalesce(split_part('{listed}', '|', cast({code} AS int)), '')"
    if src in (11, 18):
        label = f"replace({label}, '元', ' 　元')"
    other = "WHEN ok % 47 = 0 THEN '其他（自填）' " if src == 10 else ""
    return (f"CASE WHEN m53 = {src % 53} THEN '未知选项' {other}WHEN m61 = {src % 61} THEN '' "
            f"ELSE concat(CASE WHEN m59 = {src % 59} THEN '　 ' ELSE '' END, {label}) END")


def _multi(q: str) -> str:
    src, dst = P.MULTI_SOURCES[q]
    parts = [f"CASE WHEN {_pick(dst + n)} THEN {_quoted(label if n % 2 else ' ' + label)} END"
             for n, label in enumerate(P.OPTIONS[q][:-1])]
    last = dst + len(P.OPTIONS[q]) - 1
    parts.append(f"CASE WHEN {_pick(last)} AND ok % 3 = 0 THEN '其他' "
                 f"WHEN {_pick(last)} THEN concat('其他: 填写', cast(ok % 7 AS string)) END")
    parts.append(f"CASE WHEN ok % 37 = {src % 37} THEN '不存在的选项' END")
    parts.append(f"CASE WHEN ok % 41 = {src % 41} THEN '(跳过)' END")
    text = f"concat_ws('┋', {', '.join(parts)})"
    own = {"Q14": 1, "Q15": 2}.get(q)
    return text if own is None else f"CASE WHEN status = {own} OR ok % 97 = 0 THEN {text} ELSE '(跳过)' END"


def raw64_cte() -> str:
    codes = _codes(True)
    r = {i: "''" for i in range(1, 65)}
    r[1] = "cast(ok + 1 AS string)"
    r[3] = ("CASE WHEN ok % 7 = 0 THEN 'n/a' WHEN ok % 11 = 0 THEN '' WHEN ok % 5 = 0 THEN concat(cast(60 + ok % 400 AS string), '.5s') "
            "ELSE concat(' ', cast(60 + ok % 400 AS string), '秒') END")
    r[6] = "concat(' 10.0.', cast(ck % 50 AS string))"
    for src, book in P.SINGLE_BOOKS.items():
        r[src] = _single(src, codes[P.SINGLE_TARGETS[src]], book)
    for lo, hi, dst, labels in P.LIKERT_BOOKS:
        for src in range(lo, hi + 1):
            r[src] = _single(src, codes[dst + src - lo], {v: k for k, v in enumerate(labels, 1)})
    for q, (src, _) in P.MULTI_SOURCES.items():
        r[src] = _multi(q)
    r[64] = "CASE ok % 83 WHEN 0 THEN ' 好 ' WHEN 1 THEN '111' WHEN 2 THEN '/' WHEN 3 THEN '口感 很好' ELSE '' END"
    return "raw64 AS (SELECT ok + 1 AS respondent_id, " + ", ".join(f"{v} AS R{i:02d}" for i, v in r.items()) + " FROM base)"


def coded_text_cte() -> str:
    """Coded cells as text: numbers, "1^text" cells, exponents and bare fractions that the strict parser rejects."""
    cells = [f"CASE WHEN (ok + {i}) % 67 = 0 THEN '1e3' WHEN (ok + {i}) % 71 = 0 THEN ' .5 ' "
             f"WHEN (ok + {i}) % 31 = 0 THEN concat('1^', '文本 ', cast(ok % 9 AS string)) "
             f"WHEN (ok + {i}) % 43 = 0 THEN '' ELSE cast((ok + {i}) % 6 - 3 AS string) END AS {P.c(i)}" for i in range(1, 109)]
    return f"coded_text AS (SELECT ok + 1 AS respondent_id, {', '.join(cells)} FROM base)"


# --- the 19-column path-model input ----------------------------------------------------
def _noise(slot: int, levels: int) -> str:
    """Spread-out pseudo noise 0..levels-1 from the order key; integer arithmetic only."""
    h = f"((ok % 1000003) * {7919 + 104729 * slot} + {slot * 613}) % 1000003"
    return f"cast(floor((({h}) * ({h}) + {slot}) % 1000003 / 97.0) AS bigint) % {levels}"


def sem_cte() -> str:
    """Four factors with a shared part; items are their factor plus noise, clamped to 1..5."""
    factors = {f: f"2 * (latent - 1) + {_noise(n, 9)}" for n, f in enumerate(["S_service", "S_environment", "S_activity"], 1)}
    inner = ", ".join(f"{e} AS f_{n}" for n, e in factors.items())
    cols = []
    slot = 10
    for f, items in P.FACTORS.items():
        src = f"f_{f}" if f in factors else "f_o"
        for i in items:
            slot += 1
            cols.append(f"cast(least(5, greatest(1, 1 + cast(floor(({src} + {_noise(slot, 7)}) / 5.0) AS bigint))) AS double) AS {i}")
    intent = [f"cast(least(5, greatest(1, 1 + cast(floor((f_o + {_noise(50 + n, 8)}) / 5.0) AS bigint))) AS double) AS {v}"
              for n, v in enumerate(P.INTENT["R_intent"])]
    return (f"latent_scores AS (SELECT ok, latent, {inner} FROM base), "
            f"sem_factors AS (SELECT *, cast(floor((f_S_service + f_S_environment + f_S_activity) / 4.0) AS bigint) + {_noise(5, 5)} AS f_o FROM latent_scores), "
            f"sem AS (SELECT ok + 1 AS respondent_id, {', '.join(cols + intent)}, "
            f"cast(1 + {_noise(60, 5)} AS double) AS C064 FROM sem_factors)")


_CTES = {
    "base": ([], base_cte), "coded": (["base"], coded_cte), "survey": (["base", "coded"], survey_cte),
    "raw64": (["base"], raw64_cte), "coded_text": (["base"], coded_text_cte), "sem": (["base"], sem_cte),
}


def ctes(*names: str) -> list[str]:
    order: list[str] = []
    for n in names:
        order += [d for d in [*_CTES[n][0], n] if d not in order]
    return [_CTES[n][1]() for n in order]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def use_all_cores(scan: DataFrame, key: str) -> DataFrame:
    """A table of one small file arrives in one partition; spread it before wide per-row work.

    Never triggers once a table has at least as many splits as the cluster has cores.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, key)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = f"WITH {', '.join(ctes(name))} SELECT * FROM {name}"
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return spark.sql(text, orders=use_all_cores(orders, "o_orderkey"))


def oracle(name: str | tuple, body: str) -> str:
    """Check text: the shared views as CTEs in front of an independent query."""
    names = (name,) if isinstance(name, str) else name
    head = [t.replace("{orders}", "orders") for t in ctes(*names)]
    return f"WITH {', '.join(head)}{', ' if not body.lstrip().upper().startswith('SELECT') else ' '}{body}"
