"""Binary logit models: fits, metrics, robust errors, margins, out-of-fold predictions.

All fits on a frame advance together, whatever their response, features and rows: one pass per Newton step, in which a task
adds up the gradient and information of every fit over its rows. Only those sums reach the driver, as arrays (``partials``).
Categorical features are level numbers: a row holds the numbers of its levels, never a column a level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import scores as S
from ..functions.pvalues import Z_975, normal_two_sided
from ..sources.scratch import cut, spread
from . import cluster as C, ranks as K
from .prefix import row_numbers

MIN_ROWS = 30
_STEPS = 60
#: McFadden's R2 from which the classes count as separated: the likelihood has no finite maximum and no estimate exists.
SEPARATED = 0.999
#: Numbers of a block of dense rows inside a task.
_BLOCK = 1 << 22


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- categorical features ---------------------------------------------------------------------
def level_table(df: DataFrame, controls: list[str]) -> DataFrame:
    """(control, level, term, idx): every level but each control's lowest, numbered from 0 in the order of controls and levels.

    Levels come from a partial aggregate and are numbered over sorted ranges, so there may be any number of them.
    """
    each = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_no"), F.lit(c).alias("control"), F.col(c).cast("double").alias("level")) for i, c in enumerate(controls)])))
    levels = cut(each.where("level IS NOT NULL").distinct())
    lowest = levels.groupBy("_no").agg(F.min("level").alias("_low"))
    rest = levels.join(lowest, "_no").where("level > _low").drop("_low")
    name = F.regexp_replace(F.col("level").cast("string"), r"\.0$", "")
    term = F.concat(F.lit("C("), "control", F.lit(")[T."), name, F.lit("]"))
    return row_numbers(rest, [F.col("_no"), F.col("level")], "_at").select("control", "level", term.alias("term"), (F.col("_at") - 1).cast("int").alias("idx"))


def encode_rows(df: DataFrame, controls: list[str], levels: DataFrame, out: str = "on", keep=("respondent_id",)) -> DataFrame:
    """keep and ``out``, the sorted numbers of the row's levels (a lowest or missing level has none): a sparse 0/1 row."""
    rows = df
    for i, c in enumerate(controls):
        mine = levels.where(F.col("control") == c).select(F.col("level").alias(f"_l{i}"), F.col("idx").alias(f"_i{i}"))
        rows = rows.join(mine, F.col(c).cast("double") == F.col(f"_l{i}"), "left").drop(f"_l{i}")
    on = F.array_compact(F.array(*[F.col(f"_i{i}") for i in range(len(controls))])) if controls else F.lit(None).cast("array<int>")
    return rows.select(*keep, on.alias(out))


def dummy_encode(df: DataFrame, controls: list[str], keep=("respondent_id",)) -> DataFrame:
    """A 0/1 column per level but the lowest of a few controls; ``encode_rows`` is the form for many levels."""
    terms = level_table(df, controls).orderBy("idx").collect()
    return df.select(*keep, *[(F.col(r["control"]) == r["level"]).cast("double").alias(r["term"]) for r in terms])


def formula_features(df: DataFrame, numeric: list[str], controls: list[str]) -> dict[str, Column]:
    out: dict[str, Column] = {c: F.col(c) for c in numeric}
    out.update({r["term"]: (F.col(r["control"]) == r["level"]).cast("double") for r in level_table(df, controls).orderBy("idx").collect()})
    return out


# --- frames and fits -----------------------------------------------------------------------------
@dataclass(frozen=True)
class Model:
    """A fit: its response, its features (names of the frame's) and its rows."""
    y: str
    features: tuple[str, ...]
    rows: Column


class Frame:
    """Rows as (id, y, z, on, fits): responses, numeric features, levels, and the numbers of the fits that a row takes part in.

    Rows with a missing response, feature or control of a fit are masked inside the tasks; a filter here would drag every feature
    expression into a predicate.
    """

    def __init__(self, df: DataFrame, ys: dict, features: dict, models: dict[str, Model], id_col: str = "respondent_id", controls: list[str] = ()):
        self.names, self.models, self.numeric = list(models), models, list(features)
        self.spark = df.sparkSession
        members = F.array_compact(F.array(*[F.when(m.rows, F.lit(i)) for i, m in enumerate(models.values())]))
        cols = [F.col(id_col).cast("bigint").alias("id"), F.array(*[_col(y).cast("double") for y in ys.values()]).alias("y"),
                F.array(*[_col(x).cast("double") for x in features.values()]).alias("z"), members.alias("fits")]
        self.terms: list[str] = []
        if controls:
            # the driver holds a coefficient a level, so it may read their names
            levels = cut(level_table(df, controls))
            self.terms = [r["term"] for r in levels.orderBy("idx").collect()]
            known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in controls])
            rows = encode_rows(df.where(known), controls, levels, "on", (*df.columns,)).select(*cols, "on")
        else:
            rows = df.select(*cols, F.lit(None).cast("array<int>").alias("on"))
        self.rows = spread(rows, "id")
        order = list(ys)
        every = [*self.numeric, *self.terms]
        self.plan = []
        for m in models.values():
            wanted = [i for i, n in enumerate(every) if n in m.features or n in self.terms]
            self.plan.append((order.index(m.y), np.array(wanted, dtype=int)))

    def labels(self, f: int) -> list[str]:
        every = [*self.numeric, *self.terms]
        return [every[i] for i in self.plan[f][1]]

    @property
    def width(self) -> int:
        return len(self.numeric) + len(self.terms)


def _blocks(b: pa.RecordBatch, numeric: int, width: int, n_fits: int) -> Iterator[tuple]:
    """(first row, dense features, responses, membership) of a batch, in blocks of bounded size."""
    z, y = C._z(b), C._z(b, "y")
    col = b.column(b.schema.get_field_index("fits"))
    fits = np.zeros((b.num_rows, n_fits), dtype=bool)
    fits[np.repeat(np.arange(b.num_rows), np.diff(col.offsets.to_numpy())), col.flatten().to_numpy()] = True
    on = b.column(b.schema.get_field_index("on"))
    step = max(1, _BLOCK // max(1, width))
    for lo in range(0, b.num_rows, step):
        hi = min(b.num_rows, lo + step)
        x = np.zeros((hi - lo, width))
        x[:, :numeric] = z[lo:hi]
        if width > numeric:
            part = on.slice(lo, hi - lo)
            x[np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy())), numeric + part.flatten().to_numpy()] = 1.0
        yield lo, x, y[lo:hi], fits[lo:hi]


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(v, -30, 30)))


_COLUMNS = ("z", "y", "fits", "on")


def _per_fit(frame: Frame, widths: list[int], contribute, active=None) -> dict[int, tuple[int, np.ndarray]]:
    """Sum ``contribute(fit, design, y)`` over the rows of every (active) fit, in one pass."""
    plan, numeric, width = frame.plan, len(frame.numeric), frame.width
    active = set(range(len(plan))) if active is None else set(active)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = {f: [0, np.zeros(widths[f])] for f in sorted(active)}
        for b in batches:
            for _, x, y, member in _blocks(b, numeric, width, len(plan)):
                designs: dict[bytes, tuple] = {}
                for f in acc:
                    yi, cols = plan[f]
                    key = cols.tobytes()
                    if key not in designs:
                        own = x[:, cols]
                        designs[key] = (_design(own), ~np.isnan(own).any(axis=1))
                    d, ok = designs[key]
                    rows = np.flatnonzero(member[:, f] & ok & ~np.isnan(y[:, yi]))
                    if len(rows):
                        acc[f][0] += len(rows)
                        acc[f][1] += contribute(f, d[rows], y[rows, yi])
        yield from C._emit(acc)

    return C.collect_sums(frame.rows.select(*_COLUMNS).mapInArrow(run, C._SUMS))


def _exp(v: float) -> float:
    return math.exp(v) if v < 700 else math.inf


def _loglik(y, p):
    return float(np.sum(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12)))


class Fit:
    """One fitted model in the units of the frame: coefficients, covariance, moments, likelihoods, and whether it converged."""

    def __init__(self, n, events, coef, cov, llf, mean, sd, converged):
        self.n, self.events, self.coef, self.cov, self.llf, self.mean, self.sd = n, events, coef, cov, llf, mean, sd
        p0 = events / n
        self.llnull = n * (p0 * math.log(p0 + 1e-12) + (1 - p0) * math.log(1 - p0 + 1e-12))
        self.separated = 1.0 - llf / self.llnull > SEPARATED
        self.converged = converged and not self.separated

    def standardised(self) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and covariance for z-scored features."""
        t = np.diag([1.0, *self.sd])
        t[0, 1:] = self.mean
        return t @ self.coef, t @ self.cov @ t.T


def _square(v: np.ndarray, q: int) -> np.ndarray:
    out = np.zeros((q, q))
    out[np.triu_indices(q)] = v
    return out + np.triu(out, 1).T


def _inverse(h: np.ndarray) -> np.ndarray:
    """Features that others determine get the solution of least length."""
    return np.linalg.pinv(h, rcond=1e-10, hermitian=True)


def fit_all(frame: Frame, ridge: float = 0.0) -> list[Fit | None]:
    """Newton fits of every model in shared passes; None under 30 rows or with one class.

    ``ridge`` is the weight of half the squared coefficients (intercept apart), which keeps separated classes finite.
    """
    qs = [len(cols) + 1 for _, cols in frame.plan]
    first = _per_fit(frame, [2 * q - 1 for q in qs], lambda f, x, y: np.concatenate([[y.sum()], x[:, 1:].sum(axis=0), (x[:, 1:] ** 2).sum(axis=0)]))
    info, beta = {}, {}
    for f, (n, v) in first.items():
        q = qs[f]
        if n >= MIN_ROWS and 0 < v[0] < n:
            mean = v[1:q] / n
            sd = np.sqrt(np.clip(v[q:] / n - mean ** 2, 0, None))
            info[f] = (n, int(round(v[0])), mean, np.where(sd < 1e-10, 1.0, sd))
            beta[f] = np.zeros(q)
    done: dict[int, tuple] = {}
    state: dict[int, tuple[np.ndarray, float, np.ndarray]] = {}
    for _ in range(_STEPS):
        active = {f: b.copy() for f, b in beta.items() if f not in done}
        if not active:
            break

        def contribute(f, x, y, active=active):
            pr = _sigmoid(x @ active[f])
            return np.concatenate([x.T @ (y - pr), ((x * (pr * (1 - pr))[:, None]).T @ x)[np.triu_indices(x.shape[1])], [_loglik(y, pr)]])

        sums = _per_fit(frame, [q + q * (q + 1) // 2 + 1 for q in qs], contribute, active)
        for f, b in active.items():
            v, q = sums[f][1], qs[f]
            held = np.concatenate([[0.0], b[1:]])
            ll = float(v[-1]) - 0.5 * ridge * float(held @ held)
            if f in state and ll < state[f][1] - 1e-9 * abs(state[f][1]):
                beta[f] = (state[f][0] + b) / 2.0  # overshoot: go half way back
                continue
            inv = _inverse(_square(v[q:-1], q) + np.diag([0.0, *[ridge] * (q - 1)]))
            step = inv @ (v[:q] - ridge * held)
            # Separated classes have no finite maximum: stop once the likelihood no longer gains.
            flat = f in state and abs(ll - state[f][1]) <= 1e-12 * (abs(ll) + 1.0)
            state[f] = (b, ll, inv)
            if flat or np.abs(step).max() < 1e-9:
                done[f] = (b, inv, ll)
            beta[f] = b + step
    out: list[Fit | None] = [None] * len(qs)
    for f, (n, events, mean, sd) in info.items():
        coef, inv, ll = done[f] if f in done else (state[f][0], state[f][2], state[f][1])
        out[f] = Fit(n, events, coef, inv, ll, mean, sd, f in done)
    return out


def robust_covariances(frame: Frame, fits: list[Fit | None]) -> dict[int, tuple[np.ndarray, float]]:
    """fit -> (HC3 sandwich covariance, mean of p (1 - p)): leverage-corrected residuals of every fit, in one pass more."""
    live = [f for f, fit in enumerate(fits) if fit is not None]
    qs = [len(cols) + 1 for _, cols in frame.plan]

    def contribute(f, x, y):
        p = _sigmoid(x @ fits[f].coef)
        w = p * (1 - p)
        h = ((x @ fits[f].cov) * x).sum(axis=1) * w
        e = (y - p) / np.clip(1.0 - h, 1e-12, None)
        return np.concatenate([((x * (e ** 2)[:, None]).T @ x)[np.triu_indices(x.shape[1])], [w.sum()]])

    sums = _per_fit(frame, [q * (q + 1) // 2 + 1 for q in qs], contribute, live)
    return {f: (fits[f].cov @ _square(v[:-1], qs[f]) @ fits[f].cov, float(v[-1] / n)) for f, (n, v) in sums.items()}


_COEF = ("sample string, term string, coef double, std_err double, z double, p_value double, odds_ratio double, marginal_effect double")


def standardised_rows(sample: str, fit: Fit, names: list[str]) -> list[tuple]:
    """Coefficient rows on z-scored features, with the marginal effect at the intercept's probability."""
    b, cov = fit.standardised()
    se = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    pbar = 1.0 / (1.0 + math.exp(-b[0]))
    rows = []
    for i, name in enumerate(["Intercept", *names]):
        z = float(b[i] / se[i])
        rows.append((sample, name, float(b[i]), float(se[i]), z, normal_two_sided(z), _exp(b[i]), None if i == 0 else float(b[i] * pbar * (1 - pbar))))
    return rows


def _score_rows(frame: Frame, fits: list[Fit | None], names: list[str], held_out: bool, schema: str, clip: float = 0.0) -> DataFrame:
    """Rows (name, id, y, prob) of each fit's own complete rows, or of those it was not made on."""
    plan, numeric, width = frame.plan, len(frame.numeric), frame.width
    live = [(f, fit.coef) for f, fit in enumerate(fits) if fit is not None]
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(b.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
            for lo, x, y, member in _blocks(b, numeric, width, len(plan)):
                for f, coef in live:
                    yi, cols = plan[f]
                    own = x[:, cols]
                    r = np.flatnonzero((member[:, f] != held_out) & ~np.isnan(own).any(axis=1) & ~np.isnan(y[:, yi]))
                    prob = _sigmoid(_design(own[r]) @ coef)
                    yield pa.RecordBatch.from_arrays([pa.array([names[f]] * len(r), pa.string()), pa.array(ids[lo + r]), pa.array(y[r, yi].astype(np.int32)),
                                                      pa.array(np.clip(prob, clip, 1 - clip))], names=columns)

    return frame.rows.select("id", *_COLUMNS).mapInArrow(run, schema)


def predictions(frame: Frame, fits: list[Fit | None]) -> DataFrame:
    """(sample, id, y, prob) for the rows each fit was made on."""
    return _score_rows(frame, fits, frame.names, False, "sample string, id bigint, y int, prob double")


def logit_metrics(pred: DataFrame, by=("sample",), label: str = "y", score: str = "prob") -> DataFrame:
    """(by, n, events, accuracy, auc, pseudo_r2) of a table of predictions."""
    y, p = F.col(label), F.col(score)
    ll = F.sum(y * F.ln(p + 1e-12) + (1 - y) * F.ln(F.lit(1.0) - p + 1e-12))
    p0 = F.avg(y)
    null = F.count(F.lit(1)) * (p0 * F.ln(p0 + 1e-12) + (F.lit(1.0) - p0) * F.ln(F.lit(1.0) - p0 + 1e-12))
    keyed = pred if by else pred.withColumn("_one", F.lit(1))
    keys = list(by) or ["_one"]
    base = keyed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).cast("bigint").alias("events"), F.avg(((p >= 0.5).cast("int") == y).cast("double")).alias("accuracy"),
        F.when(F.abs(null) > 1e-12, F.lit(1.0) - ll / null).alias("pseudo_r2"))
    return base.join(K.auc_rank(keyed, label, score, keys).select(*keys, "auc"), keys).drop("_one")


def logit_fits(df: DataFrame, ys: dict, features: dict, models: dict[str, Model], id_col: str = "respondent_id"):
    """Fit every model in shared passes: (coefficient rows on z-scored features, metric rows)."""
    frame = Frame(df, ys, features, models, id_col)
    fits = fit_all(frame)
    rows = [r for i, (n, f) in enumerate(zip(frame.names, fits)) if f is not None for r in standardised_rows(n, f, frame.labels(i))]
    return frame.spark.createDataFrame(rows, _COEF), logit_metrics(predictions(frame, fits))


def logit_fit(df: DataFrame, y, features: dict, samples: dict[str, Column], id_col: str = "respondent_id"):
    """One response and feature set on every sample."""
    return logit_fits(df, {"y": y}, features, {n: Model("y", tuple(features), rows) for n, rows in samples.items()}, id_col)


def compare_signs(main: DataFrame, sub: DataFrame, term: str = "term", value: str = "coef") -> DataFrame:
    """(term, main_sign, sub_sign, reversed) for every term of the main table."""
    a = main.select(term, F.signum(value).alias("main_sign"))
    b = sub.select(term, F.signum(value).alias("sub_sign"))
    return a.join(b, term, "left").withColumn("reversed", S.flag(F.col("main_sign") * F.col("sub_sign") < 0))


def sign_counts(signs: DataFrame, by=()) -> DataFrame:
    both = F.col("main_sign") * F.col("sub_sign")
    return signs.groupBy(*by).agg(F.count_if(both > 0).alias("consistent_direction_n"), F.count_if(both < 0).alias("reversed_direction_n"),
                                  F.count_if(both.isNull() | (both == 0)).alias("unknown_direction_n"))


def robustness_compare(main: DataFrame, sub: DataFrame, key: str = "path") -> DataFrame:
    """Estimates of two samples side by side with their directions and whether these agree."""
    j = main.select(key, F.col("beta").alias("main_beta"), F.col("p").alias("main_p")).join(
        sub.select(key, F.col("beta").alias("sub_beta"), F.col("p").alias("sub_p")), key)
    out = j.withColumns({"main_direction": S.sign_label("main_beta"), "sub_direction": S.sign_label("sub_beta")})
    return out.withColumn("same_direction", F.col("main_direction") == F.col("sub_direction"))


def top_effects(terms: DataFrame, alpha: float = 0.05, k: int = 3) -> DataFrame:
    return terms.filter((F.col("term") != "Intercept") & (F.col("p_value") < alpha)).orderBy(F.abs("coef").desc(), "term").limit(k)


def attention_calibrations(df: DataFrame, y, features: dict, logic="logic_branch_flag", item="C064", codes=((1, "口径A_应选1"), (5, "口径B_应选5"))) -> DataFrame:
    """Each expected attention code: abnormal and sensitivity counts, model metrics, sign agreement with the main fit."""
    from .quality import attention_flag
    ok = {f"eq{code}": (attention_flag(item, code) == 0) & (F.col(logic) == 0) for code, _ in codes}
    coefs, metrics = logit_fit(df, y, features, {"main": F.lit(True), **ok})
    counts = df.agg(*[F.sum(attention_flag(item, code)).alias(f"a{code}") for code, _ in codes], *[F.count_if(c).alias(f"s_{n}") for n, c in ok.items()])
    rows = counts.select(F.inline(F.array(*[F.struct(
        F.lit(f"eq{code}").alias("sample"), F.lit(name).alias("calibration"), F.lit(code).alias("expected_code"), F.col(f"a{code}").alias("attention_abnormal_n"),
        F.col(f"s_eq{code}").alias("sensitivity_n")) for code, name in codes])))
    main = coefs.filter("sample = 'main' and term <> 'Intercept'")
    subs = coefs.filter("sample <> 'main' and term <> 'Intercept'").select("sample", "term", F.signum("coef").alias("sub_sign"))
    signs = sign_counts(subs.join(main.select("term", F.signum("coef").alias("main_sign")), "term"), ["sample"])
    return rows.join(metrics.withColumnRenamed("n", "model_n"), "sample", "left").join(signs, "sample", "left")


# --- models with categorical controls ---------------------------------------------------------
_FORMULA = ("model_id string, term string, coef double, std_err double, robust_se double, z double, p_value double, ci_lower double, ci_upper double, "
            "odds_ratio double, or_ci_lower double, or_ci_upper double, marginal_effect double, abs_coef double")
_FORMULA_FIT = "model_id string, n bigint, events bigint, event_rate double, pseudo_r2_mcfadden double, llf double, llnull double, aic double, bic double, converged boolean"


class Formulas:
    """Models with treatment-coded controls, in raw units, all fitted in shared passes: (model_id, response, numeric features)."""

    def __init__(self, df: DataFrame, models: list[tuple[str, str, list[str]]], controls: list[str], id_col: str = "respondent_id"):
        numeric = list(dict.fromkeys(x for _, _, xs in models for x in xs))
        ys = list(dict.fromkeys(y for _, y, _ in models))
        base = df.select(id_col, *dict.fromkeys([*ys, *numeric, *controls]))
        self.frame = Frame(base, {y: y for y in ys}, {x: x for x in numeric}, {m: Model(y, tuple(xs), F.lit(True)) for m, y, xs in models}, id_col, controls)
        self.fits = fit_all(self.frame)
        poor = [m for (m, _, _), f in zip(models, self.fits) if f is None]
        if poor:
            raise ValueError(f"{poor}: needs {MIN_ROWS} rows and both classes")

    def coefficients(self) -> DataFrame:
        """Classical and HC3 errors; z, p and intervals are the robust ones. Separated classes have terms without figures."""
        robust = robust_covariances(self.frame, self.fits)
        rows = []
        for f, fit in enumerate(self.fits):
            if fit.separated:
                rows += [(self.frame.names[f], term, *[None] * 12) for term in ["Intercept", *self.frame.labels(f)]]
                continue
            cov, slope = robust[f]
            se, hc3 = np.sqrt(np.clip(np.diag(fit.cov), 0, None)), np.sqrt(np.clip(np.diag(cov), 0, None))
            for i, term in enumerate(["Intercept", *self.frame.labels(f)]):
                b, s = float(fit.coef[i]), float(hc3[i])
                lo, hi = b - Z_975 * s, b + Z_975 * s
                z = b / s if s > 0 else None
                rows.append((self.frame.names[f], term, b, float(se[i]), s, z, None if z is None else normal_two_sided(z), lo, hi, _exp(b), _exp(lo), _exp(hi),
                             None if i == 0 else slope * b, abs(b)))
        return self.frame.spark.createDataFrame(rows, _FORMULA)

    def fit_rows(self) -> DataFrame:
        rows = []
        for name, t in zip(self.frame.names, self.fits):
            k = len(t.coef)
            rows.append((name, t.n, t.events, t.events / t.n, 1.0 - t.llf / t.llnull, t.llf, t.llnull, -2 * t.llf + 2 * k, -2 * t.llf + k * math.log(t.n), t.converged))
        return self.frame.spark.createDataFrame(rows, _FORMULA_FIT)

    def gradients(self, core: str, levels=(1, 2, 3, 4, 5), mediator: str | None = None) -> DataFrame:
        """(model_id, mediator, level, probability): mean predictions with the core feature set to each level, and a mediator to 0 and 1, in one pass."""
        settings = [[(m, float(v)) for m in ((0.0, 1.0) if mediator in self.frame.labels(f) else (None,)) for v in levels] for f in range(len(self.fits))]
        at = [{t: i + 1 for i, t in enumerate(self.frame.labels(f))} for f in range(len(self.fits))]
        coefs = [fit.coef for fit in self.fits]

        def contribute(f, x, y):
            out = []
            for m, v in settings[f]:
                d = x.copy()
                d[:, at[f][core]] = v
                if m is not None:
                    d[:, at[f][mediator]] = m
                out.append(_sigmoid(d @ coefs[f]).sum())
            return np.array(out)

        sums = _per_fit(self.frame, [len(s) for s in settings], contribute)
        rows = [(self.frame.names[f], m, int(v), None if self.fits[f].separated else float(t / sums[f][0])) for f, s in enumerate(settings) for (m, v), t in zip(s, sums[f][1])]
        return self.frame.spark.createDataFrame(rows, "model_id string, mediator double, level int, probability double")


def linear_predictor(coef: dict[str, float], features: dict[str, Column], replaced: dict[str, float] | None = None) -> Column:
    """Intercept plus coefficient-weighted features; ``replaced`` fixes features at a value."""
    replaced = replaced or {}
    terms = [F.lit(float(coef["Intercept"]))]
    terms += [F.lit(float(coef[t])) * (F.lit(float(replaced[t])) if t in replaced else e) for t, e in features.items()]
    return reduce(lambda a, b: a + b, terms)


def _sigmoid_col(v: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-v))


def gradient_table(df: DataFrame, coef: dict[str, float], features: dict[str, Column], core: str, levels=(1, 2, 3, 4, 5), fixed: dict[str, float] | None = None) -> DataFrame:
    """(level, probability): mean prediction over all rows with the core feature set to each level, in one aggregate."""
    row = df.agg(*[F.avg(_sigmoid_col(linear_predictor(coef, features, {core: lv, **(fixed or {})}))).alias(f"p{lv}") for lv in levels])
    return row.select(F.inline(F.array(*[F.struct(F.lit(lv).alias("level"), F.col(f"p{lv}").alias("probability")) for lv in levels])))


def avg_marginal_effect(df: DataFrame, coef: dict[str, float], features: dict[str, Column]) -> DataFrame:
    """(term, marginal_effect): the row average of p(1-p) times each coefficient."""
    p = _sigmoid_col(linear_predictor(coef, features))
    row = df.agg(F.avg(p * (F.lit(1.0) - p)).alias("s"))
    return row.select(F.inline(F.array(*[F.struct(F.lit(t).alias("term"), (F.col("s") * F.lit(float(coef[t]))).alias("marginal_effect")) for t in features])))


def oof_models(df: DataFrame, models: list[tuple[str, str, list[str]]], controls: list[str] = (), folds: int = 5, seed: int = 42, id_col: str = "respondent_id", clip: float = 1e-6):
    """(model_id, id, y_true, prob_oof, pred_0_5, oof_method): every row of every model predicted by a fit that did not see it.

    Models are (model_id, response, numeric features); folds are stratified by each model's response. The fits of all models and folds
    share their passes. A class smaller than the folds lowers their number, and under two folds the prediction is in-sample.
    """
    numeric = list(dict.fromkeys(x for _, _, xs in models for x in xs))
    ys = list(dict.fromkeys(y for _, y, _ in models))
    src = cut(df.select(id_col, *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*ys, *numeric, *controls])]))
    fold_of, method, fits, names = src, {}, {}, []
    for i, (mid, y, xs) in enumerate(models):
        mine = src.na.drop(subset=list(dict.fromkeys([y, *xs, *controls]))).select(id_col, F.col(y).cast("int").alias("y"))
        cls = {r["y"]: r["n"] for r in mine.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        k = min(folds, cls.get(0, 0), cls.get(1, 0))
        if k < 2:
            method[mid] = "insample_fallback"
            tagged, parts = mine.withColumn("fold", F.lit(0)), [F.col(f"_fold{i}") == 0]
        else:
            method[mid] = f"stratified_{k}fold_oof"
            tagged, parts = K.stratified_folds(mine, "y", k, seed, id_col), [F.col(f"_fold{i}") != j for j in range(k)]
        fold_of = fold_of.join(tagged.select(F.col(id_col).alias(f"_id{i}"), F.col("fold").alias(f"_fold{i}")), F.col(id_col) == F.col(f"_id{i}"), "left").drop(f"_id{i}")
        for j, rows in enumerate(parts):
            fits[f"{mid} {j}"] = Model(y, tuple(xs), F.coalesce(rows, F.lit(False)))
            names.append(mid)
    frame = Frame(fold_of, {y: y for y in ys}, {x: x for x in numeric}, fits, id_col, list(controls))
    made = fit_all(frame, ridge=1e-6)  # as a penalised fit of weight 1e6 on the data, which has a solution for separated classes too
    schema = "model_id string, id bigint, y_true int, prob_oof double"
    inside = [f if method[m] == "insample_fallback" else None for m, f in zip(names, made)]
    outside = [None if method[m] == "insample_fallback" else f for m, f in zip(names, made)]
    out = _score_rows(frame, outside, names, True, schema, clip)
    if any(f is not None for f in inside):
        out = out.unionByName(_score_rows(frame, inside, names, False, schema, clip))
    how = F.create_map(*[F.lit(x) for kv in method.items() for x in kv])
    return out.select("model_id", F.col("id").alias(id_col), "y_true", "prob_oof", (F.col("prob_oof") >= 0.5).cast("int").alias("pred_0_5"), how[F.col("model_id")].alias("oof_method"))


def oof_predict(df: DataFrame, y: str, features: dict[str, Column], folds: int = 5, seed: int = 42, id_col: str = "respondent_id", clip: float = 1e-6):
    """One model of given feature columns, without model_id."""
    cols = {n: f"x{i}" for i, n in enumerate(features)}
    base = df.select(id_col, F.col(y).alias("y"), *[_col(e).cast("double").alias(cols[n]) for n, e in features.items()])
    return oof_models(base, [("", "y", list(cols.values()))], (), folds, seed, id_col, clip).drop("model_id")
