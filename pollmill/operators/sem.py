"""Latent-variable path models, fitted from moment rows.

Executors reduce respondents to moments, per subset and per bootstrap replicate; a fit sees one
moment row.  Models are rows (model, lhs, op, rhs, fixed value).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scores as S
from ..functions.pvalues import normal_p, normal_two_sided
from . import cluster as C
from .moments import covariance_of, cross_moments, moment_rows
from .partials import add_up, batches_of

_ROWS = "model_id string, subset string, rep int, lhs string, op string, rhs string, estimate double, std_err double, z double, p_value double, est_std double"


def observed_of(spec) -> list[str]:
    """Observed variables: everything named that is not itself measured."""
    latent = {lhs for _, lhs, op, _, _ in spec if op == "=~"}
    seen: list[str] = []
    for _, lhs, op, rhs, _ in spec:
        for v in (rhs, lhs):
            if v not in latent and v not in seen:
                seen.append(v)
    return seen


class _Model:
    """Parameter places of a spec: directed effects in A, (co)variances in S."""

    def __init__(self, spec):
        self.obs = observed_of(spec)
        self.names = self.obs + sorted({lhs for _, lhs, op, _, _ in spec if op == "=~"})
        at = {v: i for i, v in enumerate(self.names)}
        self.p, self.size = len(self.obs), len(self.names)
        self.fixed, self.free = [], []  # (matrix, i, j, value) and (matrix, i, j, label)
        for _, lhs, op, rhs, value in spec:
            place = ("A", at[rhs], at[lhs]) if op == "=~" else ("A", at[lhs], at[rhs]) if op == "~" else ("S", at[lhs], at[rhs])
            label = (lhs, op, rhs)
            if value is not None:
                self.fixed.append((*place, float(value), label))
            else:
                self.free.append((*place, label))
        self.free += [("S", i, i, (v, "~~", v)) for i, v in enumerate(self.names)]
        self.dof = self.p * (self.p + 1) // 2 - len(self.free)

    def start(self, cov: np.ndarray) -> np.ndarray:
        marker = {label[0]: self.obs.index(label[2]) for m, _, _, v, label in self.fixed if label[1] == "=~" and label[2] in self.obs}
        out = []
        for m, i, j, label in self.free:
            if m == "A":
                out.append(1.0 if label[1] == "=~" else 0.0)
            elif i != j:
                out.append(0.0)
            else:
                k = i if i < self.p else marker.get(self.names[i], 0)
                out.append(0.5 * cov[k, k])
        return np.array(out)

    def matrices(self, theta):
        a, s = np.zeros((self.size, self.size)), np.zeros((self.size, self.size))
        for m, i, j, v, _ in self.fixed:
            (a if m == "A" else s)[i, j] = v
            if m == "S":
                s[j, i] = v
        for (m, i, j, _), v in zip(self.free, theta):
            (a if m == "A" else s)[i, j] = v
            if m == "S":
                s[j, i] = v
        b = np.linalg.inv(np.eye(self.size) - a)
        return b, b @ s @ b.T

    def derivatives(self, b, e):
        out = np.empty((len(self.free), self.p, self.p))
        for k, (m, i, j, _) in enumerate(self.free):
            left, right = (b[:self.p, i], e[j, :self.p]) if m == "A" else (b[:self.p, i], b[:self.p, j])
            d = np.outer(left, right)
            out[k] = d if m == "S" and i == j else d + d.T
        return out


def _ml(cov, sigma, logdet):
    sign, ld = np.linalg.slogdet(sigma)
    if sign <= 0 or not np.isfinite(ld):
        return np.inf
    return ld + np.trace(cov @ np.linalg.inv(sigma)) - logdet - len(cov)


def fit_moments(model: _Model, cov: np.ndarray, n: int, start=None, steps: int = 200):
    """Maximum-likelihood discrepancy by Fisher scoring with step halving; None when it does not converge."""
    sign, logdet = np.linalg.slogdet(cov)
    if sign <= 0 or model.dof < 0:
        return None
    theta = model.start(cov) if start is None else np.array(start, float)
    with np.errstate(all="ignore"):
        b, e = model.matrices(theta)
        f = _ml(cov, e[:model.p, :model.p], logdet)
        for _ in range(steps):
            sigma = e[:model.p, :model.p]
            w = np.linalg.inv(sigma)
            d = np.matmul(w, model.derivatives(b, e))
            flat = d.reshape(len(d), -1)
            info = flat @ d.transpose(0, 2, 1).reshape(len(d), -1).T
            g = flat @ (w @ (sigma - cov)).T.ravel()
            step = np.linalg.lstsq(info, -g, rcond=None)[0]
            size = 1.0
            while True:
                new = theta + size * step
                nb, ne = model.matrices(new)
                nf = _ml(cov, ne[:model.p, :model.p], logdet)
                if np.isfinite(nf) and nf <= f + 1e-12:
                    break
                size /= 2.0
                if size < 1e-8:
                    return None
            moved = np.abs(new - theta).max()
            theta, b, e, f = new, nb, ne, nf
            if moved < 1e-8:
                return theta, b, e, max(f, 0.0), info
    return None


def _index_rows(model: _Model, cov, e, f, n):
    """Fit indices against the independence model; SRMR over the lower triangle without the diagonal."""
    chi2, dof = n * f, model.dof
    d = np.sqrt(np.diag(cov))
    r = cov / np.outer(d, d)
    base, base_dof = -n * np.linalg.slogdet(r)[1], model.p * (model.p - 1) // 2
    sd = np.sqrt(np.diag(e)[:model.p])
    low = np.tril_indices(model.p, -1)
    out = {"n": n, "chi2": chi2, "dof": dof, "SRMR": float(np.sqrt(np.mean((r - e[:model.p, :model.p] / np.outer(sd, sd))[low] ** 2)))}
    if dof > 0:
        out |= {"CMIN/DF": chi2 / dof, "RMSEA": float(np.sqrt(max(0.0, (chi2 / dof - 1) / (n - 1)))),
                "CFI": 1 - (chi2 - dof) / (base - base_dof), "TLI": (base / base_dof - chi2 / dof) / (base / base_dof - 1)}
    return out


def _fit_rows(model_id, subset, rep, model, cov, n, start, detail):
    got = fit_moments(model, cov, n, start)
    if got is None:
        return [(model_id, subset, rep, "converged", "fit", "", 0.0, None, None, None, None)]
    theta, _, e, f, info = got
    sd = np.sqrt(np.clip(np.diag(e), 0, None))
    se = np.sqrt(np.clip(np.diag(np.linalg.pinv(info)) * 2.0 / n, 0, None)) if detail else np.full(len(theta), np.nan)
    rows = [(model_id, subset, rep, "converged", "fit", "", 1.0, None, None, None, None)]
    for (m, i, j, (lhs, op, rhs)), v, s in zip(model.free, theta, se):
        if not detail and op != "~":
            continue
        std = v * sd[j] / sd[i] if m == "A" else v / (sd[i] * sd[j])
        z = v / s if s > 0 else None
        rows.append((model_id, subset, rep, lhs, op, rhs, float(v), float(s) if s > 0 else None, z, None if z is None else normal_two_sided(z), float(std)))
    if detail:
        for m, i, j, v, (lhs, op, rhs) in model.fixed:
            rows.append((model_id, subset, rep, lhs, op, rhs, v, None, None, None, float(v * sd[j] / sd[i]) if m == "A" else None))
        rows += [(model_id, subset, rep, k, "fit", "", float(v), None, None, None, None) for k, v in _index_rows(model, cov, e, f, n).items()]
    return rows


def sem_fit(moments: DataFrame, columns: list[str], specs: dict[str, list], detail: bool = True, starts: dict | None = None, split: int | None = None) -> DataFrame:
    """Fit every model on every moment row (subset, rep, n, s, q); parameters and indices as rows.

    Indices have op 'fit' and their name in lhs; 'converged' is 0 where the solver gave up.
    """
    models = {k: _Model(v) for k, v in specs.items()}
    picks = {k: [columns.index(o) for o in m.obs] for k, m in models.items()}
    starts = starts or {}
    jobs = moments.select("subset", "rep", "n", "s", "q", F.explode(F.array(*[F.lit(m) for m in specs])).alias("model_id"))
    jobs = jobs.repartition(split or moments.sparkSession.sparkContext.defaultParallelism, "model_id", "subset", "rep")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                pick = picks[r.model_id]
                cov = covariance_of(int(r.n), r.s, r.q, ddof=0)[np.ix_(pick, pick)]
                rows += _fit_rows(r.model_id, r.subset, int(r.rep), models[r.model_id], cov, int(r.n), starts.get(r.model_id), detail)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ROWS.split(", ")])

    return jobs.mapInPandas(run, _ROWS)


def sem_moments(df: DataFrame, columns: list[str], subsets: dict[str, Column]) -> DataFrame:
    """One moment row per subset; a row that belongs to several subsets is expanded in place."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in subsets.items()]))
    rows = df.select(*columns, F.explode(names).alias("subset"))
    return cross_moments(rows, columns, ["subset"]).withColumn("rep", F.lit(0))


# --- bootstrap -------------------------------------------------------------------------------
def _poisson_cuts(limit: int = 12) -> np.ndarray:
    k = np.arange(limit)
    return np.exp(-1.0) * np.cumsum(1.0 / np.cumprod(np.maximum(k, 1).astype(float)))


def bootstrap_moments(df: DataFrame, columns: list[str], reps: int, seed: int = 42, id_col: str = "respondent_id", chunk: int = 250) -> DataFrame:
    """Moment rows of ``reps`` resamples: Poisson(1) weights from a seeded hash of (id, replicate).

    Rows are never multiplied: a task turns its rows into one weighted moment row per replicate.
    """
    p = len(columns)
    iu = np.triu_indices(p)
    cuts = _poisson_cuts()
    frame = C.vectors(df, columns, id_col).select(F.col(id_col).cast("bigint").alias("id"), "z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((reps, 1 + p + len(iu[0])))
        for b in batches:
            if not b.num_rows:
                continue
            x = C._z(b)
            ok = ~np.isnan(x).any(axis=1)
            x, ids = x[ok], b.column(0).to_numpy(zero_copy_only=False)[ok]
            v = np.column_stack([np.ones(len(x)), x, x[:, iu[0]] * x[:, iu[1]]])
            for lo in range(0, reps, chunk):
                hi = min(reps, lo + chunk)
                u = np.column_stack([S.portable_hash_array(ids, seed * 100003 + r) for r in range(lo, hi)]) / 4294967296.0
                acc[lo:hi] += np.searchsorted(cuts, u.ravel(), side="right").reshape(u.shape).astype(float).T @ v
        yield from batches_of([(r,) for r in range(reps)], acc[:, 0].astype(np.int64).tolist(), list(acc[:, 1:]), ["rep"], [pa.int32()])

    sums = add_up(frame.mapInArrow(run, "rep int, n bigint, s array<double>"), ["rep"])
    return moment_rows(sums, ["rep"], p).withColumn("subset", F.lit("main"))


def indirect_effects(fits: DataFrame, paths: list[tuple]) -> DataFrame:
    """(model_id, subset, rep, hypothesis, label, effect): product of the two standardised paths."""
    table = fits.sparkSession.createDataFrame([(m, h, label, a[0], a[1], b[0], b[1]) for m, h, label, a, b in paths],
                                              "model_id string, hypothesis string, label string, a_lhs string, a_rhs string, b_lhs string, b_rhs string")
    reg = fits.filter("op = '~'").select("model_id", "subset", "rep", "lhs", "rhs", "est_std")
    a = reg.select("model_id", "subset", "rep", F.col("lhs").alias("a_lhs"), F.col("rhs").alias("a_rhs"), F.col("est_std").alias("a"))
    b = reg.select("model_id", "subset", "rep", F.col("lhs").alias("b_lhs"), F.col("rhs").alias("b_rhs"), F.col("est_std").alias("b"))
    j = a.join(F.broadcast(table), ["model_id", "a_lhs", "a_rhs"]).join(b, ["model_id", "subset", "rep", "b_lhs", "b_rhs"])
    return j.select("model_id", "subset", "rep", "hypothesis", "label", (F.col("a") * F.col("b")).alias("effect"))


def bootstrap_ci(draws: DataFrame, by: list[str], value: str = "effect") -> DataFrame:
    """(by, draws, ci_low, ci_high, p_boot, significant) of a table of draws."""
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.025), F.lit(0.975)))
    p = F.least(F.lit(1.0), F.least(F.avg((v <= 0).cast("double")), F.avg((v >= 0).cast("double"))) * 2.0)
    out = draws.groupBy(*by).agg(F.count(F.lit(1)).alias("draws"), q.alias("_q"), p.alias("p_boot"))
    return out.select(*by, "draws", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"), "p_boot",
                      ((F.col("_q")[0] > 0) | (F.col("_q")[1] < 0)).alias("significant"))


def bootstrap_indirect(df: DataFrame, columns: list[str], specs: dict, paths: list[tuple], reps: int = 2000, seed: int = 42, id_col: str = "respondent_id",
                       min_success: float = 0.8) -> DataFrame:
    """Point effect, percentile interval and p per indirect path; fails when too few refits converge."""
    spark = df.sparkSession
    main = C.cut(sem_fit(sem_moments(df, columns, {"main": F.lit(True)}), columns, specs))
    starts = {}
    for m, spec in specs.items():
        model = _Model(spec)
        est = {(r["lhs"], r["op"], r["rhs"]): r["estimate"] for r in main.filter((F.col("model_id") == m) & (F.col("op") != "fit")).collect()}
        if est:
            starts[m] = [est[label] for *_, label in model.free]
    moments = bootstrap_moments(df, columns, reps, seed, id_col)
    draws = C.cut(sem_fit(moments, columns, specs, detail=False, starts=starts, split=4 * spark.sparkContext.defaultParallelism))
    ok = draws.filter("lhs = 'converged'").groupBy("model_id").agg(F.sum("estimate").alias("success"), F.count(F.lit(1)).alias("requested"))
    poor = ok.filter(F.col("success") < F.col("requested") * min_success).collect()
    if poor:
        raise RuntimeError("; ".join(f"{r['model_id']}: {int(r['success'])} of {r['requested']} refits converged" for r in poor))
    points = indirect_effects(main, paths).select("model_id", "hypothesis", "label", F.col("effect").alias("point"))
    ci = bootstrap_ci(indirect_effects(draws, paths), ["model_id", "hypothesis"])
    return points.join(ci, ["model_id", "hypothesis"]).join(ok, "model_id")


# --- tables from fits ------------------------------------------------------------------------------
def sem_fit_indices(fits: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(model_id, subset, metric, value, pass) against the cut-off table."""
    v = fits.filter("op = 'fit'").select("model_id", "subset", F.col("lhs").alias("metric"), F.col("estimate").alias("value"))
    return v.join(F.broadcast(cutoffs), "metric").withColumn("pass", S.pass_threshold("value", "op", "threshold"))


def sem_paths(fits: DataFrame, paths: list[tuple]) -> DataFrame:
    """Direct hypotheses: standardised coefficient, p, and support (p < .05 and positive)."""
    table = fits.sparkSession.createDataFrame(paths, "model_id string, hypothesis string, label string, lhs string, rhs string")
    j = fits.filter("op = '~'").join(F.broadcast(table), ["model_id", "lhs", "rhs"])
    p = F.coalesce("p_value", F.lit(1.0))
    return j.select("model_id", "subset", "hypothesis", "label", F.col("est_std").alias("beta"), "estimate", "std_err", p.alias("p"),
                    ((p < 0.05) & (F.col("est_std") > 0)).alias("supported"))


def sem_model_compare(indices: DataFrame, reference: str) -> DataFrame:
    """Indices per model side by side, with the change of CFI and RMSEA against a reference model."""
    wide = indices.groupBy("model_id", "subset").pivot("metric", ["CMIN/DF", "RMSEA", "CFI", "TLI", "SRMR"]).agg(F.first("value"))
    ok = indices.groupBy("model_id", "subset").agg(F.min(F.col("pass").cast("int")).alias("all_pass"))
    ref = wide.filter(F.col("model_id") == reference).select("subset", F.col("CFI").alias("_c"), F.col("RMSEA").alias("_r"))
    return wide.join(ok, ["model_id", "subset"]).join(ref, "subset").withColumns(
        {"delta_cfi": F.col("CFI") - F.col("_c"), "delta_rmsea": F.col("RMSEA") - F.col("_r")}).drop("_c", "_r")


def fixed_loadings(fits: DataFrame, model_id: str, spec: list, name: str) -> list:
    """The spec with every loading held at its estimate in ``fits`` (a few rows read by the driver)."""
    est = {(r["lhs"], r["rhs"]): r["estimate"] for r in fits.filter((F.col("model_id") == model_id) & (F.col("op") == "=~")).collect()}
    return [(name, lhs, op, rhs, round(est[(lhs, rhs)], 8) if op == "=~" else v) for _, lhs, op, rhs, v in spec]


def multigroup_cfa(df: DataFrame, columns: list[str], spec: list, groups: dict[str, Column], limit: float = -0.01) -> DataFrame:
    """Free against pooled loadings by group: CFI per level and group, weighted CFI, change and verdict."""
    moments = C.cut(sem_moments(df, columns, {"pooled": F.lit(True), **groups}))
    free = C.cut(sem_fit(moments, columns, {"configural": spec}))
    metric = fixed_loadings(free.filter("subset = 'pooled'"), "configural", spec, "metric")
    fits = free.unionByName(sem_fit(moments, columns, {"metric": metric})).filter(F.col("subset") != "pooled")
    wide = fits.filter("op = 'fit'").groupBy("model_id", "subset").pivot("lhs", ["n", "CMIN/DF", "RMSEA", "CFI", "TLI", "SRMR"]).agg(F.first("estimate"))
    total = wide.groupBy("model_id").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("CFI")) / F.sum("n")).alias("CFI"))
    by_level = total.groupBy().pivot("model_id", ["configural", "metric"]).agg(F.first("CFI"))
    delta = by_level.select((F.col("metric") - F.col("configural")).alias("d")).scalar()
    none = F.lit(None).cast("double")
    rows = wide.select("model_id", "subset", "n", "CMIN/DF", "RMSEA", "CFI", "TLI", "SRMR", none.alias("delta_cfi"), F.lit(None).cast("boolean").alias("invariant"))
    summary = total.withColumn("_d", delta).select("model_id", F.lit("weighted").alias("subset"), "n", *[none.alias(c) for c in ("CMIN/DF", "RMSEA")], "CFI",
                                                  none.alias("TLI"), none.alias("SRMR"), F.col("_d").alias("delta_cfi"), (F.col("_d") >= limit).alias("invariant"))
    return rows.unionByName(summary)


def wald_group_diff(paths: DataFrame, a: str, b: str, group: str = "subset", key: str = "path") -> DataFrame:
    """(path, diff, z, p) between two groups' estimates; NULL without positive standard errors."""
    def side(g, t):
        return paths.filter(F.col(group) == g).select(key, F.col("estimate").alias(f"e_{t}"), F.col("std_err").alias(f"s_{t}"))

    j = side(a, "a").join(side(b, "b"), key)
    se = F.sqrt(F.col("s_a") ** 2 + F.col("s_b") ** 2)
    z = F.when((F.col("s_a") > 0) & (F.col("s_b") > 0), (F.col("e_a") - F.col("e_b")) / se)
    return j.select(key, (F.col("e_a") - F.col("e_b")).alias("diff"), z.alias("z")).withColumn("p", normal_p("z"))


def attention_sensitivity(df: DataFrame, paths: DataFrame, subsets: dict[str, Column], path_key: str) -> DataFrame:
    """Per attention rule: rows, share of the main sample, coefficient, p and direction of one path."""
    row = df.agg(*[F.count_if(c).alias(n) for n, c in subsets.items()], F.count(F.lit(1)).alias("_all"))
    counts = row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("subset"), F.col(n).alias("n"), (F.col(n) / F.col("_all")).alias("share")) for n in subsets])))
    mine = paths.filter(F.col("hypothesis") == path_key).select("subset", "beta", "p")
    return counts.join(mine, "subset", "left").withColumn("direction", F.when(F.col("beta").isNull(), "NA").otherwise(S.sign_label("beta")))
