"""Closed forms, brute force on small inputs, skewed keys, minimum sizes and partitioning."""

import io
import math
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pollmill.functions import pvalues as PV, scores as S, text as X
from pollmill.operators import cluster as C, describe as D, logit as L, moments as M, quality as Q, ranks as K, recode as R, sem as E, stability as ST
from pollmill.plans import profile as P, views as V
from pollmill.operators.partials import add_up, collected
from pollmill.plans.workbook_data import workbook_bytes
from pollmill.sources import workbooks as WB
from pollmill.sources.ship import package_bytes

SF = "/root/testdata/sf0.001"


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_text_functions(spark):
    df = spark.createDataFrame([(" a　 b ",), ("3",), ("-3",), ("1^x y",), ("1e3",), (".5",), ("",), (None,), ("95秒",), ("...",), ("111",), ("好",)], "v string")
    r = {x[0]: x for x in df.select("v", X.norm_ws("v"), X.norm_label("v"), X.safe_float("v"), X.to_float("v"), X.parse_duration("v"),
                                    X.open_text_gibberish("v"), X.split_code_text("v")).collect()}
    assert r[" a　 b "][1:3] == ("a b", "ab")
    assert [r[k][3] for k in ("3", "-3", "1e3", ".5", "")] == [3.0, -3.0, None, None, None]
    assert [r[k][4] for k in ("1e3", ".5", "1^x y", "")] == [1000.0, 0.5, None, None]
    assert r["95秒"][5] == 95.0 and r["..."][5] is None
    assert [r[k][6] for k in ("...", "111", "好", "", "95秒")] == [1, 1, 1, 0, 0]
    assert tuple(r["1^x y"][7]) == ("1", "x y")


def test_multi_choice(spark):
    opts = ["A", "B 1", "其他"]
    df = spark.createDataFrame([(1, "A┋B1"), (2, "A┋其他: x"), (3, "(跳过)"), (4, "zz┋A"), (5, None), (6, "其他┋ 其他：y "), (7, "其他: x┋其他")], "i int, v string")
    got = {r[0]: tuple(r[1:]) for r in df.select("i", *R.map_multi(F.col("v"), opts), R.unknown_multi(F.col("v"), opts)).collect()}
    assert got[1][:3] == ("1", "1", "0") and got[2][:3] == ("1", "0", "1^其他: x") and got[3][:3] == ("0", "0", "0")
    assert got[4][3] == ["zz"] and got[5][:3] == ("0", "0", "0") and got[6][2] == "1^其他：y" and got[7][2] == "1"


def test_runs_bridge_gaps_and_empty_scale_is_severe(spark):
    df = spark.createDataFrame([(3.0, None, 3.0, 1.0), (None, None, None, None)], "a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    assert [tuple(r) for r in df.select(S.max_same_run(cols), S.distinct_count(cols), S.row_nansum(cols), S.row_nanmean(cols)).collect()] == [(2, 2, 7.0, 7.0 / 3), (0, 0, 0.0, None)]
    assert [r[0] for r in df.select(Q.severe_straightline_flag(cols)).collect()] == [0, 1]


def test_duplicates_with_a_hot_answer(spark):
    df = spark.range(3000).select(F.col("id").alias("respondent_id"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.floor(F.col("id") / 2)).cast("string").alias("a"))
    base = values(Q.flag_duplicate(df, ["a"]), "respondent_id", "duplicate_flag")
    seen, want = set(), []
    for i, a in sorted(values(df, "respondent_id", "a"), key=lambda r: r[0]):
        want.append((i, int(a in seen)))
        seen.add(a)
    assert base == want
    assert values(Q.flag_duplicate(df.repartition(7), ["a"]), "respondent_id", "duplicate_flag") == want


def test_occurrence_numbers_of_hot_groups(spark):
    df = spark.range(2000).select(F.col("id").alias("respondent_id"), (F.col("id") % 3 * F.when(F.col("id") % 2 == 0, 0).otherwise(1)).alias("k"))
    got = K.dup_rank(df, F.col("k").cast("string"))
    groups, want = {}, {}
    for i, k in values(df, "respondent_id", "k"):
        groups.setdefault(k, []).append(i)
    for members in groups.values():
        want.update({i: (n, len(members)) for n, i in enumerate(members, 1)})
    assert {r["respondent_id"]: (r["occurrence"], r["total"]) for r in got.collect()} == want


def test_mid_ranks_over_ranges(spark):
    df = spark.range(900).select(((F.col("id") * 37) % 251 / 7.0).alias("v"), (F.col("id") % 3).alias("g"))
    rows = values(df, "g", "v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges, small as they are
    try:
        got = values(K.value_ranks(df, "v", ["g"]), "g", "v", "n", "avg_rank")
        each = values(K.avg_rank(df, "v", ["g"]), "g", "v", "avg_rank")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rank = {}
    for g, v in set(rows):
        mine = [x for h, x in rows if h == g]
        rank[g, v] = (mine.count(v), sum(x < v for x in mine) + (mine.count(v) + 1) / 2)
    assert got == sorted((g, v, *r) for (g, v), r in rank.items())
    assert each == sorted((g, v, rank[g, v][1]) for g, v in rows)


def test_quantiles_match_numpy(spark):
    x = np.round(np.random.default_rng(1).normal(size=501), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "a double")
    got = C.exact_quantiles(df, ["a"], [0.01, 0.25, 0.5, 0.7, 0.99]).first()
    assert np.allclose(list(got[1:]), np.quantile(x, [0.01, 0.25, 0.5, 0.7, 0.99]))


def test_tail_probabilities():
    assert PV.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert PV.chi2_tail(10.0, 4) == pytest.approx(math.exp(-5) * 6, rel=1e-12)
    assert PV.chi2_tail(200.0, 3) < 1e-40 and PV.chi2_tail(0.0, 3) == 1.0
    assert PV.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


def test_hash_is_the_same_in_tasks_and_plans(spark):
    ids = np.arange(0, 500, dtype=np.int64) * 7919
    df = spark.createDataFrame([(int(i),) for i in ids], "i long")
    got = {r[0]: r[1] for r in df.select("i", S.portable_hash("i", 12)).collect()}
    assert [got[int(i)] for i in ids] == [int(v) for v in S.portable_hash_array(ids, 12)]


def test_resamples_are_exact(spark):
    df = spark.range(1000).withColumnRenamed("id", "respondent_id")
    cuts = ST.resample_cuts(df, 5, 0.7)
    n = {r["run"]: r["n"] for r in df.select(F.explode(ST.membership(cuts)).alias("run")).groupBy("run").agg(F.count("*").alias("n")).collect()}
    assert n == {r: 700 for r in range(1, 6)}
    ids = np.arange(1000)
    for run, h, i in cuts:
        order = sorted(zip(S.portable_hash_array(ids, run).tolist(), ids.tolist()))
        assert order[699] == (h, i)


def test_fixture_facts(spark):
    text = f"WITH {V.base_cte()}, {V.coded_cte(False)} SELECT * FROM coded"
    s = spark.sql(text, orders=V.load(spark, "/root/testdata/sf0.01", "orders"))
    items = P.cols((52, 63), 65)
    r = s.agg(F.count("*"), F.sum("C052"), F.sum("C064"), F.count("C070"), F.sum("C100"), F.count_if(F.col("C064") == 1), F.corr("C066", "C076")).first()
    assert tuple(r[:6]) == (15000, 44579.0, 44585.0, 14929, 5000.0, 3005) and r[6] == pytest.approx(0.6309140916)
    a = M.cronbach_alpha(s, {"b": items}).first()
    assert a["n_complete"] == 14077 and a["alpha"] == pytest.approx(0.9758214739580283)


def test_alpha_minimum_sizes(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0)], "a double, b double")
    assert M.cronbach_alpha(df, {"x": ["a", "b"]}).first()["alpha"] is None
    flat = spark.createDataFrame([(1.0, 2.0)] * 5, "a double, b double")
    assert M.cronbach_alpha(flat, {"x": ["a", "b"]}).first()["alpha"] is None


def test_kmo_of_two_items_and_small_samples(spark):
    rows = [(float(i % 5), float((i * 3) % 7)) for i in range(40)]
    got = M.kmo_bartlett(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).first()
    r = np.corrcoef(np.array(rows).T)[0, 1]
    assert got["kmo"] == pytest.approx(0.5, abs=1e-6)
    assert got["bartlett_chi2"] == pytest.approx(-(40 - 1 - 1.5) * math.log(1 - r * r), rel=1e-5)
    assert M.kmo_bartlett(spark.createDataFrame(rows[:9], "a double, b double"), ["a", "b"]).first()["kmo"] is None


def _blobs(spark, n=300, k=3, seed=3):
    rng = np.random.default_rng(seed)
    lab = np.arange(n) % k
    x = rng.normal(size=(n, 4)) * 0.3 + np.eye(4)[lab] * 6
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "respondent_id long, z array<double>")
    return df, x, lab


@pytest.mark.parametrize("limit", [1024, 64])
def test_two_stage_recovers_blobs(spark, limit):
    df, _, lab = _blobs(spark)
    _, got = C.cluster_two_stage(df, (2, 3), limit=limit)
    found = {r["respondent_id"]: r["labels"][1] for r in got.collect()}
    assert len({(int(lab[i]), c) for i, c in found.items()}) == 3


def _silhouette(x, lab, power=1):
    """Mean silhouette over all pairs."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) ** power
    out = []
    for i in range(len(x)):
        same = (lab == lab[i]) & (np.arange(len(x)) != i)
        a = d[i, same].mean() if same.any() else 0.0
        b = min(d[i, lab == c].mean() for c in set(lab.tolist()) - {lab[i]})
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_silhouettes_match_all_pairs(spark):
    df, x, lab = _blobs(spark, 90)
    lab = np.where(np.arange(90) < 5, (lab + 1) % 3, lab)
    lab[7] = 9  # a cluster of one row
    frame = C.cut(df.join(spark.createDataFrame([(i, [int(v) + 1]) for i, v in enumerate(lab)], "respondent_id long, labels array<int>"), "respondent_id"))
    assert C.silhouette(frame, 1, "squared")[0]["silhouette"] == pytest.approx(_silhouette(x, lab, 2), abs=1e-10)
    assert C.silhouette(frame, 1, "micro")[0]["silhouette"] == pytest.approx(_silhouette(x, lab), abs=0.02)
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    for own, other, got in C.cluster_distances(frame).collect():
        a, b = lab == own - 1, lab == other - 1
        assert got == pytest.approx(d2[np.ix_(a, b)].sum() / (a.sum() * (b.sum() - (own == other))), rel=1e-9)


def test_sums_of_arrays_in_two_levels(spark):
    df = spark.range(500, numPartitions=150).select((F.col("id") % 3).cast("int").alias("g"), F.lit(1).cast("long").alias("n"), F.array(F.col("id").cast("double"), F.lit(2.0)).alias("s"))
    got = collected(df, ["g"])
    assert {g: (n, s.tolist()) for g, (n, s) in got.items()} == {g: (len(range(g, 500, 3)), [float(sum(range(g, 500, 3))), 2.0 * len(range(g, 500, 3))]) for g in range(3)}
    assert [(r["n"], r["s"]) for r in add_up(df, []).collect()] == [(500, [124750.0, 1000.0])]
    assert collected(df.limit(0), ["g"]) == {}


def test_run_quantiles_of_discrete_and_continuous_columns(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(1, 6, 3000), rng.normal(size=3000), rng.exponential(size=3000)]).astype(float)
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, z array<double>").repartition(6)
    cuts = ST.resample_cuts(frame, 4, 0.7, id_col="id")
    probs = [0.25, 0.5, 0.75]
    got = ST.run_quantiles(ST.with_members(frame, cuts), 4, 3, probs)
    member = ST._mask(np.arange(3000), cuts)
    for r in range(4):
        mine = x[member[:, r]]
        assert len(mine) == 2100
        assert got[:, r, 0].tolist() == np.quantile(mine[:, 0], probs).tolist()  # five values: a bin each
        for j in (1, 2):
            rank = (mine[:, j][None, :] <= got[:, r, j][:, None]).mean(axis=1)
            assert np.abs(rank - probs).max() < 0.01


@pytest.mark.parametrize("method", ["robust", "zscore"])
def test_silhouette_of_every_run(spark, method):
    rng = np.random.default_rng(8)
    lab = np.arange(500) % 2
    x = rng.normal(size=(500, 6)) + lab[:, None] * 1.5  # overlapping segments, continuous values
    raw = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "respondent_id long, z array<double>")
    labels = spark.createDataFrame([(i, int(v) + 1) for i, v in enumerate(lab)], "respondent_id long, cluster int")
    runs, persons = ST.stability_resample(raw, labels, 2, method, runs=6)
    got = {r["run_id"]: r for r in runs.collect()}
    assert len(got) == 6 and {r["sample_n"] for r in got.values()} == {350} and persons.count() <= 500
    cuts = ST.resample_cuts(raw, 6, 0.7)
    member = ST._mask(np.arange(500), cuts)
    for j, (run, _, _) in enumerate(cuts):
        sub = x[member[:, j]]
        q = np.quantile(sub, [0.25, 0.5, 0.75], axis=0)
        z = (sub - q[1]) / (q[2] - q[0]) if method == "robust" else (sub - sub.mean(axis=0)) / sub.std(axis=0)
        c = np.array([z[lab[member[:, j]] == k].mean(axis=0) for k in (0, 1)])
        for _ in range(80):  # k-means from the true segments
            near = ((z[:, None] - c[None]) ** 2).sum(-1).argmin(axis=1)
            c = np.array([z[near == k].mean(axis=0) for k in (0, 1)])
        assert got[run]["silhouette"] == pytest.approx(_silhouette(z, near), abs=0.02)


def test_stability_of_clear_segments(spark):
    df, _, lab = _blobs(spark, 240, 2)
    labels = spark.createDataFrame([(i, int(v) + 1) for i, v in enumerate(lab)], "respondent_id long, cluster int")
    runs, persons = ST.stability_resample(df, labels, 2, "zscore", runs=4)
    assert [r["consistency_rate"] for r in runs.collect()] == [1.0] * 4 and {r["sample_n"] for r in runs.collect()} == {168}
    assert persons.agg(F.min("consistency_rate")).first()[0] == 1.0


def test_alignment_picks_the_best_permutation(spark):
    rows = [(1, 2, 50), (2, 3, 40), (3, 1, 30), (1, 1, 5)]
    got = {r["new_label"]: (r["aligned_label"], r["agreement"]) for r in C.align_labels(spark.createDataFrame(rows, "ref_label int, new_label int, n long")).collect()}
    assert {k: v[0] for k, v in got.items()} == {2: 1, 3: 2, 1: 3} and got[1][1] == pytest.approx(120 / 125)


def test_logit_matches_newton_and_needs_thirty_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.5])))).astype(float)
    df = spark.createDataFrame([(i, float(y[i]), float(x[i, 0]), float(x[i, 1]) if i else None) for i in range(400)], "respondent_id long, y double, a double, b double")
    coefs, metrics = L.logit_fit(df, "y", {"a": "a", "b": "b"}, {"all": F.lit(True), "few": F.col("respondent_id") < 29})
    z = (x[1:] - x[1:].mean(0)) / x[1:].std(0)
    d, b = np.column_stack([np.ones(399), z]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-d @ b))
        h = (d * (p * (1 - p))[:, None]).T @ d
        b = b + np.linalg.solve(h, d.T @ (y[1:] - p))
    got = {r["term"]: r for r in coefs.collect()}
    assert {r["sample"] for r in got.values()} == {"all"} and metrics.count() == 1
    assert [got[t]["coef"] for t in ("Intercept", "a", "b")] == pytest.approx(b.tolist(), abs=1e-7)
    assert [got[t]["std_err"] for t in ("Intercept", "a", "b")] == pytest.approx(np.sqrt(np.diag(np.linalg.inv(h))).tolist(), abs=1e-6)


def test_folds_are_balanced_and_held_out(spark):
    df = spark.range(600).select(F.col("id").alias("respondent_id"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 7).cast("double").alias("x"))
    n = [r["n"] for r in K.stratified_folds(df, "y", 5, 3).groupBy("y", "fold").agg(F.count("*").alias("n")).collect()]
    assert sorted(n) == [40] * 5 + [80] * 5
    p = L.oof_predict(df, "y", {"x": F.col("x")})
    assert p.count() == 600 and p.select("respondent_id").distinct().count() == 600


def test_path_model_fit_and_bootstrap(spark):
    df = V.view(spark, SF, "sem")
    cols = P.SEM_COLUMNS
    m = "cfa_intent_with_method"
    fits = E.sem_fit(E.sem_moments(df, cols, {"main": F.lit(True)}), cols, {m: P.SEM_SPECS[m]}).collect()
    idx = {r["lhs"]: r["estimate"] for r in fits if r["op"] == "fit"}
    assert idx["converged"] == 1.0 and idx["dof"] == 19 * 20 / 2 - (14 + 19 + 5 + 10 + 3) and idx["CFI"] > 0.95 and idx["SRMR"] < 0.05
    b = "intent_partial_v1"
    got = E.bootstrap_indirect(df, cols, {b: P.SEM_SPECS[b]}, [x for x in P.INDIRECT_PATHS if x[0] == b], reps=40).collect()
    assert len(got) == 3 and all(r["ci_low"] <= r["point"] <= r["ci_high"] and r["success"] == 40 for r in got)


def test_poisson_weights_have_unit_mean_and_variance(spark):
    df = spark.range(4000).select(F.col("id").alias("respondent_id"), F.lit(1.0).alias("a"))
    n = np.array([r["n"] for r in E.bootstrap_moments(df, ["a"], 60).collect()]) / 4000
    assert abs(n.mean() - 1) < 0.01 and 0.5 < n.var() * 4000 < 1.7


def test_workbooks_shared_inline_missing_header_and_ragged(spark):
    book = workbook_bytes([["a", None, "c"], ["x  y", 2], [None, "q", "z"]], shared=True)
    df = spark.createDataFrame([("f.xlsx", bytearray(book)), ("g.xlsx", bytearray(workbook_bytes([["h"], ["　v "]], False)))], "path string, content binary")
    cells = WB.parse_workbooks(df)
    assert values(WB.sheet_headers(cells), "file", "col", "header") == [("f.xlsx", 1, "a"), ("f.xlsx", 2, "C002"), ("f.xlsx", 3, "c"), ("g.xlsx", 1, "h")]
    assert values(WB.sheet_rows(cells.filter("file = 'f.xlsx'"), 3), "row_no", "R01", "R02", "R03") == [(1, "x y", "2", ""), (2, "", "q", "z")]
    assert values(WB.sheet_rows(cells.filter("file = 'g.xlsx'"), 1), "R01") == [("v",)]
    with pytest.raises(ValueError):
        WB.require_layout(65)


def test_workbooks_written_from_tasks_are_read_back_from_files(spark, tmp_path):
    books = [(f"{i}.xlsx", bytearray(workbook_bytes([["a", "b"], [f"v{i}", i]], shared=bool(i % 2)))) for i in range(7)]
    df = spark.createDataFrame(books, "path string, content binary").repartition(3)
    folder = tmp_path.as_uri() + "/books"
    WB.write_workbooks(df, folder)
    WB.write_workbooks(df, folder)  # a task that runs again
    (tmp_path / "books" / "notes.txt").write_text("no workbook")
    cells = WB.scan_workbooks(spark, folder).withColumn("file", WB.file_name())
    assert values(WB.sheet_rows(cells, 2), "file", "row_no", "R01", "R02") == [(f"{i}.xlsx", 1, f"v{i}", str(i)) for i in range(7)]
    empty = tmp_path.as_uri() + "/none"
    WB.write_workbooks(df.limit(0), empty)
    assert WB.scan_workbooks(spark, empty).count() == 0


def test_the_shipped_archive_holds_every_module():
    root = Path(WB.__file__).resolve().parents[1]
    names = zipfile.ZipFile(io.BytesIO(package_bytes(root))).namelist()
    assert len(names) == len(list(root.rglob("*.py"))) and "pollmill/__init__.py" in names and "pollmill/sources/ship.py" in names


def test_results_do_not_depend_on_partitioning(spark):
    s = V.view(spark, SF, "survey")
    for op in (lambda d: D.freq_table(d, ["C002", "C052"]), lambda d: K.kruskal_wallis(d, "C052", "C002").select("n", F.round("h", 8)),
               lambda d: Q.flag_duplicate(d, P.CODES).select("respondent_id", "duplicate_flag")):
        a, b = (sorted(map(tuple, op(d).collect())) for d in (s.repartition(1), s.orderBy(F.rand(3)).repartition(17)))
        assert a == b


def test_scans_prune_and_push_down(spark):
    text = spark.read.parquet(f"{SF}/orders.parquet").filter("o_orderstatus = 'F'").transform(lambda d: D.segment_counts(d, "o_orderpriority"))
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan


def test_seventy_labels_and_two_models_keep_their_sums_apart(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(280, 3)) * 0.01 + np.repeat(rng.normal(size=(70, 3)) * 50, 4, axis=0)
    rows = [(i, x[i].tolist(), [i // 4 + 1, i // 140 + 1]) for i in range(280)]
    frame = C.cut(spark.createDataFrame(rows, "respondent_id long, z array<double>, labels array<int>"))
    fine, coarse = C.silhouette(frame, 2)
    assert fine["silhouette"] > 0.9 > coarse["silhouette"]
    a, b = C.ch_db_indices(frame, 2)
    assert a["cluster_size_distribution"] == "|".join(["4"] * 70) and b["cluster_size_distribution"] == "140|140"


def _newton(x, y, ridge=0.0):
    d, b = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-d @ b))
        held = np.r_[0, b[1:]]
        h = (d * (p * (1 - p))[:, None]).T @ d + np.diag(np.r_[0, np.full(x.shape[1], ridge)])
        b = b + np.linalg.solve(h, d.T @ (y - p) - ridge * held)
    p = 1 / (1 + np.exp(-d @ b))
    return b, np.linalg.inv((d * (p * (1 - p))[:, None]).T @ d), d, p


def test_models_of_other_responses_features_and_rows_share_passes(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(400, 2))
    level = rng.integers(1, 4, 400)
    u, v = (rng.random(400) < 1 / (1 + np.exp(-x[:, 0]))).astype(float), (rng.random(400) < 1 / (1 + np.exp(x[:, 1] - level + 2))).astype(float)
    rows = [(i, *map(float, x[i]), float(level[i]) if i % 50 else None, float(u[i]), float(v[i]) if i % 40 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "respondent_id long, a double, b double, g double, u double, v double")
    got = L.Formulas(df, [("m1", "u", ["a"]), ("m2", "v", ["a", "b"])], ["g"])
    coefs = {(r["model_id"], r["term"]): r for r in got.coefficients().collect()}
    known = np.arange(400) % 50 != 0
    dummies = np.column_stack([level == 2, level == 3]).astype(float)
    for m, y, cols, ok in (("m1", u, x[:, :1], known), ("m2", v, x, known & (np.arange(400) % 40 != 0))):
        b, cov, d, p = _newton(np.column_stack([cols, dummies])[ok], y[ok])
        h = np.einsum("ij,jk,ik->i", d, cov, d) * p * (1 - p)
        e = (y[ok] - p) / (1 - h)
        hc3 = np.sqrt(np.diag(cov @ ((d * (e ** 2)[:, None]).T @ d) @ cov))
        terms = ["Intercept", *("ab"[:cols.shape[1]]), "C(g)[T.2]", "C(g)[T.3]"]
        assert [coefs[m, t]["coef"] for t in terms] == pytest.approx(b.tolist(), abs=1e-7)
        assert [coefs[m, t]["robust_se"] for t in terms] == pytest.approx(hc3.tolist(), rel=1e-6)
        assert coefs[m, "a"]["z"] == pytest.approx(b[1] / hc3[1], rel=1e-6)
        assert coefs[m, "a"]["marginal_effect"] == pytest.approx(b[1] * (p * (1 - p)).mean(), rel=1e-6)
    assert [r["converged"] for r in got.fit_rows().collect()] == [True, True]


def test_separated_classes_have_no_estimates_but_predictions(spark):
    df = spark.range(200).select(F.col("id").alias("respondent_id"), (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 >= 5).cast("int").alias("y"))
    fit = L.Formulas(df, [("m", "y", ["x"])], [])
    assert fit.fit_rows().first()["converged"] is False and {r["coef"] for r in fit.coefficients().collect()} == {None}
    p = L.oof_predict(df, "y", {"x": F.col("x")}).collect()
    assert len(p) == 200 and all(r["pred_0_5"] == r["y_true"] for r in p)


def test_many_levels_are_numbers_not_columns(spark):
    df = spark.range(3000).select(F.col("id").alias("respondent_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 1500).alias("g"), (F.col("id") % 3).alias("h"))
    levels = L.level_table(df, ["g", "h"])
    assert levels.count() == 1499 + 2 and levels.agg(F.max("idx")).first()[0] == 1500
    got = {r["respondent_id"]: r["on"] for r in L.encode_rows(df, ["g", "h"], levels).collect()}
    for i in range(3000):
        want = [i % 1500 - 1] if i % 7 and i % 1500 else []
        assert got[i] == want + ([1499 + i % 3 - 1] if i % 3 else [])


def _labelled_blobs(spark, n):
    df, x, lab = _blobs(spark, n)
    lab = np.where(np.arange(n) < 5, (lab + 1) % 3, lab)
    lab[7] = 9  # a cluster of one row
    return C.cut(df.join(spark.createDataFrame([(i, [int(v) + 1]) for i, v in enumerate(lab)], "respondent_id long, labels array<int>"), "respondent_id")), x, lab


@pytest.mark.parametrize("block", [16, 1 << 15])
def test_exact_silhouette_is_euclidean_over_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    frame, x, lab = _labelled_blobs(spark, 90)
    assert C.silhouette(frame, 1, "exact")[0]["silhouette"] == pytest.approx(_silhouette(x, lab), abs=1e-10)
    # far from zero distances keep their digits; several models share the tiles
    two = frame.select((F.transform("z", lambda v: v + 1e5)).alias("z"), F.array(F.col("labels")[0], F.lit(1), (F.col("respondent_id") % 2).cast("int")).alias("labels"))
    got = [r["silhouette"] for r in C.silhouette(C.cut(two), 3, "exact")]
    assert got[0] == pytest.approx(_silhouette(x, lab), abs=1e-6) and got[1] is None
    assert got[2] == pytest.approx(_silhouette(x, np.arange(90) % 2), abs=1e-6)


def test_distance_sums_in_steps():
    rng = np.random.default_rng(3)
    xa, xb = rng.normal(size=(1100, 3)), rng.normal(size=(700, 3))
    ha, hb = np.eye(2)[np.arange(1100) % 2], np.eye(2)[np.arange(700) % 2]
    d = np.sqrt(((xa[:, None] - xb[None]) ** 2).sum(-1))
    to_b, to_a = C._distance_sums(xa, ha, xb, hb, False)
    assert np.allclose(to_b, d @ hb) and np.allclose(to_a, d.T @ ha)
    own = np.sqrt(((xa[:, None] - xa[None]) ** 2).sum(-1))
    assert np.allclose(C._distance_sums(xa, ha, xa, ha, True)[0], own @ ha)


@pytest.mark.parametrize("block", [16, 1 << 15])
def test_pair_distances_are_euclidean_over_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    frame, x, lab = _labelled_blobs(spark, 90)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = {(r["own"], r["other"]): r["mean_distance"] for r in C.pair_distances(frame).collect()}
    counts = {int(k): int((lab == k).sum()) for k in np.unique(lab)}
    assert set(got) == {(a + 1, b + 1) for a in counts for b in counts if a != b or counts[a] > 1}
    for (own, other), v in got.items():
        a, b = lab == own - 1, lab == other - 1
        assert v == pytest.approx(d[np.ix_(a, b)].sum() / (a.sum() * (b.sum() - (own == other))), rel=1e-9)


def test_moments_hold_no_product_a_row():
    import pyarrow as pa
    import tracemalloc
    x = np.random.default_rng(2).normal(size=(10000, 64))
    z = pa.ListArray.from_arrays(np.arange(0, x.size + 1, 64, dtype=np.int32), x.ravel())
    batch = pa.RecordBatch.from_arrays([z], names=["z"])
    tracemalloc.start()
    try:
        (out,) = C._moments(iter([batch, batch.slice(0, 0), batch.slice(100)]), 64)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    both = np.vstack([x, x[100:]])
    row = out.to_pylist()[0]
    assert row["n"] == 19900 and np.allclose(row["s"][:64], both.sum(axis=0)) and np.allclose(np.reshape(row["s"][64:], (64, 64)), both.T @ both)
    assert peak < 40e6  # 10,000 rows of 2,144 products alone are 171 MB


def test_answer_runs_bridge_gaps_without_shuffle(spark, capsys):
    rows = spark.createDataFrame([(1, 2.0, None, 2.0, 3.0), (2, None, None, None, None), (3, None, 5.0, 4.0, 5.0), (4, 1.0, 1.0, 1.0, 1.0)],
                                 "respondent_id long, C060 double, C061 double, C062 double, C063 double")
    runs = S.answer_runs(rows, ["C060", "C061", "C062", "C063"], "respondent_id")
    assert sorted(map(tuple, runs.collect())) == [(1, 2.0, 60, 2), (1, 3.0, 63, 1), (3, 4.0, 62, 1), (3, 5.0, 61, 1), (3, 5.0, 63, 1), (4, 1.0, 60, 4)]
    runs.explain()
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Exchange", "Sort", "Window", "Aggregate"))


_CELLS = ["5", "-3", "+2.5", "007", "1e3", " .5 ", ".5", "5.", "1^文本", " 4 ^x", "", None, "　７", "5\n", "5 ", "5\u0085", "1_0", "inf", "-Infinity", "NaN", "5d", "１.５", "1^2^3", "2f"]


def test_numbers_parsed_as_arrays_equal_those_of_single_cells(spark, capsys):
    from pollmill.sources import tables as TB
    df = spark.createDataFrame([(i, c, c) for i, c in enumerate(_CELLS)], "respondent_id long, a string, b string")
    want = {r[0]: r[1] for r in df.select("respondent_id", X.safe_float(X.split_code_text("a")["code"])).collect()}
    cells = R.numeric_cells(df, ["a", "b"])
    assert {r[0]: r[1] for r in cells.collect()} == want == {r[0]: r[2] for r in cells.collect()}
    assert [want[i] for i, c in enumerate(_CELLS) if c in ("5", "1e3", "5\n", "5 ", "　７", "1^文本")] == [5.0, None, 1.0, 7.0, 5.0, 5.0]
    lenient = TB.numeric_columns(df, ["a", "missing", "b"], ["respondent_id"])
    assert lenient.columns == ["respondent_id", "a", "missing", "b"]
    got = {r["respondent_id"]: (r["a"], r["missing"], r["b"]) for r in lenient.collect()}
    named = dict(zip(_CELLS, (got[i][0] for i in range(len(_CELLS)))))
    assert named == {"5": 5, "-3": -3, "+2.5": 2.5, "007": 7, "1e3": 1000, " .5 ": .5, ".5": .5, "5.": 5, "1^文本": None, " 4 ^x": None, "": None, None: None, "　７": 7, "5\n": 5,
                     "5 ": 5, "5\u0085": 5, "1_0": 10, "inf": float("inf"), "-Infinity": float("-inf"), "NaN": None, "5d": None, "１.５": 1.5, "1^2^3": None, "2f": None}
    assert all(v[1] is None and v[0] == v[2] for v in got.values())
    assert [tuple(r) for r in TB.numeric_columns(df, ["missing"], ["respondent_id"]).limit(1).collect()] == [(0, None)]
    # one parse expression, however many columns
    R.numeric_cells(df.select("*", *[F.col("a").alias(f"c{i}") for i in range(40)]), [f"c{i}" for i in range(40)]).explain()
    assert capsys.readouterr().out.count("RLIKE") < 40


def test_ties_of_a_resample_are_counted_in_tasks(spark, capsys):
    ids = spark.createDataFrame([(i % 40,) for i in range(200)], "id long").repartition(4)
    at = {r: int(S.portable_hash_array(np.array([3 * r]), r)[0]) for r in range(1, 6)}
    tied = ST._tied(ids, at)
    assert sorted(map(tuple, tied.collect())) == [(r, 3 * r, 5) for r in range(1, 6)]
    tied.explain()
    assert "2654435761" not in capsys.readouterr().out  # no hash expression a run in the plan
    assert ST._tied(ids.limit(0), at).count() == 0


def test_unknown_answers_trim_only_what_no_book_knows(spark, capsys):
    book, cells = {"是": 1, "不 是": 2, "其他": 3}, ["是", " 是　", "不 是", "不是", "其他x", "", None, "  ", " 未 知 ", "┋", "是┋ 未知 ┋其他: y┋(跳过)┋ ┋ 不是"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id long, c string")
    got = df.select("id", R.unknown_single(F.col("c"), book).alias("s"), R.unknown_multi(F.col("c"), list(book)).alias("m")).orderBy("id")
    single, multi = zip(*[(r["s"], r["m"]) for r in got.collect()])
    assert list(single) == [None] * 8 + ["未 知", "┋", "是┋ 未知 ┋其他: y┋(跳过)┋ ┋ 不是"]
    assert list(multi) == [[]] * 8 + [["未 知"], [], ["未知"]]
    df.select(R.unknown_multi(F.col("c"), list(book)).alias("m")).explain()
    assert "filter(transform(" not in capsys.readouterr().out


def test_sums_of_runs_without_a_copy_a_run():
    import tracemalloc
    rng = np.random.default_rng(6)
    n, p, runs = 10000, 40, 60
    v = np.column_stack([np.ones(n), rng.normal(size=(n, p))])
    m, cell, label = rng.random((n, runs)) < 0.7, rng.integers(0, 5, n), rng.integers(0, 2, (n, runs))
    cell[cell == 3] = 4  # an empty cell
    out = np.zeros((5, 2, runs, p + 1))
    tracemalloc.start()
    try:
        ST._slot_sums(v, m, cell, label, out)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    for c, k, r in ((0, 0, 0), (4, 1, 59), (3, 1, 7), (2, 0, 30)):
        assert np.allclose(out[c, k, r], v[m[:, r] & (cell == c) & (label[:, r] == k)].sum(axis=0))
    assert out[..., 0].sum() == m.sum() and peak < 30e6  # the members' rows of all runs are 140 MB
    one = np.zeros((1, 1, runs, p + 1))
    ST._slot_sums(v, m, None, None, one)
    assert np.allclose(one[0, 0], m.T.astype(float) @ v)


def test_severe_straightline_by_brute_force(spark):
    rng = np.random.default_rng(9)
    cols = [f"q{i}" for i in range(38)]
    rows = rng.integers(1, 6, (400, 38)).astype(float)
    for i in range(360):  # runs of 17 to 38 at any place, at a scale end or not, with gaps in and around them
        length, value = rng.integers(17, 39), rng.choice([1.0, 3.0, 5.0])
        start = rng.integers(0, 38 - length + 1)
        rows[i, start:start + length] = value
        if i % 3 == 0:
            rows[i][rng.random(38) < 0.15] = np.nan
        if i % 5 == 0:
            rows[i][rows[i] == 2.0] = 5.0
    rows[0], rows[1] = np.nan, np.where(np.arange(38) == 5, 4.0, np.nan)

    def severe(r):
        a = r[~np.isnan(r)]
        run = max((len(s) for s in np.split(a, np.flatnonzero(np.diff(a)) + 1)), default=0) if len(a) else 0
        return int(len(set(a.tolist())) <= 1 or run >= 30 or (run >= 20 and np.isin(a, (1.0, 5.0)).mean() >= 0.8))

    want = [severe(r) for r in rows]
    df = spark.createDataFrame([(i, *[None if np.isnan(x) else float(x) for x in r]) for i, r in enumerate(rows)], ", ".join(["i int", *[f"{c} double" for c in cols]]))
    got = [r[1] for r in sorted(df.select("i", Q.severe_straightline_flag(cols)).collect())]
    assert got == want and 0.2 < np.mean(want) < 0.8


def test_clustering_reads_kept_rows_written_once(spark):
    from pollmill.plans import queries_quality as QQ
    from pollmill.sources import scratch
    once = QQ.scored_once(spark, SF)
    key = [k for k in scratch._KEPT if k[1].startswith("scored-")]
    assert len(key) == 1 and spark.read.parquet(scratch._KEPT[key[0]][0]).where("invalid_union_flag = 1").count() == 0
    whole = QQ.scored(spark, SF)
    assert once.columns == whole.columns and whole.count() > 0
    assert once.exceptAll(whole).count() == 0 and whole.exceptAll(once).count() == 0


def test_label_numbers_ignore_the_noise_of_sums():
    points = np.array([[0.5, 9.0, 1.0], [0.5, 1.0, 1.0], [7.0, 3.0, 2.0]])
    noise = np.array([[-1e-15, 0, 0], [1e-15, 0, 0], [0, 0, 0]])
    for x in (points, points + noise, points - noise):
        assert np.allclose(C.ward_centres(x, np.ones(3), {3, 2})[3], [[0.5, 1.0, 1.0], [0.5, 9.0, 1.0], [7.0, 3.0, 2.0]])
        assert np.allclose(C.ward_centres(x, np.array([1.0, 1.0, 50.0]), {2})[2][:, 0], [0.5, 7.0])
