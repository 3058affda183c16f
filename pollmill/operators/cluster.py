"""Segmentation: feature sets, scaling, two-stage clustering, indices, naming, soft segments.

Rows stay in Spark as (id, z); a task reduces its rows to per-cluster sums with numpy and only
those sums, the <= 1,024 micro-cluster centres and the k centres ever reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scores as S
from ..plans import profile as P
from ..sources.scratch import cut, spread
from .describe import long_items
from .partials import add_up, batches_of, collected
from .ranks import running_totals

MAX_MICRO = 1024
LLOYD_STEPS = 80
#: Rows of a block of the all-pairs silhouette, of a step inside a tile, and of a row of sums it emits.
BLOCK = 1 << 15
_STEP, _PIECE = 256, 4096


# --- features ---------------------------------------------------------------------------
BINARIES = P.MOTIVE + P.PROJECTS + P.PROMOS
BASELINE = [*BINARIES, "importance_mean", "performance_mean", "cognition_mean"]
INDICES = ["price_sensitivity_index", "culture_interest_index", "deep_experience_index"]
ENHANCED = [*BINARIES, *P.IMPORTANCE, *P.PERFORMANCE, *P.COGNITION, *P.cols(24, 25, 90, 91),
            "importance_mean", "performance_mean", "cognition_mean", *P.COUNTS, *INDICES]
FEATURE_SETS = {"baseline": BASELINE, "enhanced": ENHANCED}


def index_scores() -> dict[str, Column]:
    """Mixed indices: rated items as they are or reversed, 0/1 items stretched to 0..5."""
    def five(i):
        return F.col(P.c(i)) * 5.0

    def reverse(i):
        return S.reverse_score(P.c(i))

    return {
        "price_sensitivity_index": S.row_nanmean([F.col(P.c(73)), reverse(83), reverse(57), five(38)]),
        "culture_interest_index": S.row_nanmean([F.col(P.c(86)), F.col(P.c(89)), five(16), five(17), five(27)]),
        "deep_experience_index": S.row_nanmean([five(i) for i in (92, 94, 97, 98, 99, 21, 26, 31)]),
    }


def feature_matrix(df: DataFrame, feature_set: str, keep=("respondent_id",)) -> DataFrame:
    """Feature columns of a set; unanswered 0/1 items count as not chosen."""
    answers = [c for c in P.NUMERIC if c in df.columns]
    src = df.withColumns({c: S.negatives_to_null(c) for c in answers}).withColumns(index_scores())
    return src.select(*keep, *[(F.coalesce(F.col(c), F.lit(0.0)) if c in BINARIES else F.col(c)).alias(c)
                               for c in FEATURE_SETS[feature_set]])


# --- scaling ------------------------------------------------------------------------------
def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str] = ()) -> DataFrame:
    """(by, item, q0, q1, ...): linearly interpolated quantiles from the counts of distinct values."""
    by = list(by)
    values = cut(long_items(df, columns, by).groupBy(*by, "item", "value").agg(F.count(F.lit(1)).alias("n")))
    return quantiles_of_counts(values, probs, [*by, "item"])


def quantiles_of_counts(values: DataFrame, probs: list[float], by: list[str]) -> DataFrame:
    total = values.groupBy(*by).agg(F.sum("n").alias("_total"))
    rows = running_totals(values, "value", ["n"], by).join(total, by)
    last, out = F.col("_total") - 1, []
    aggs = []
    for i, p in enumerate(probs):
        pos = last * F.lit(float(p))
        for side, rank in (("lo", F.floor(pos)), ("hi", F.least(F.floor(pos) + 1, last))):
            inside = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
            aggs.append(F.max(F.when(inside, F.col("value"))).alias(f"{side}{i}"))
        frac = F.col("_t") * F.lit(float(p)) - F.floor(F.col("_t") * F.lit(float(p)))
        out.append((F.col(f"lo{i}") + frac * (F.col(f"hi{i}") - F.col(f"lo{i}"))).alias(f"q{i}"))
    return rows.groupBy(*by).agg((F.first("_total") - 1).alias("_t"), *aggs).select(*by, *out)


def _column_stats(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """Mean, population spread and minimum per column after mean imputation: one row of figures."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(columns):
        aggs += [F.avg(c).alias(f"m{i}"), F.var_pop(c).alias(f"v{i}"), F.count(c).alias(f"c{i}"), F.min(c).alias(f"l{i}")]
    row = df.agg(*aggs).first()
    n = max(row["_n"], 1)
    return {c: {"mean": row[f"m{i}"] or 0.0, "sd": math.sqrt((row[f"v{i}"] or 0.0) * row[f"c{i}"] / n),
                "min": row[f"l{i}"] if row[f"l{i}"] is not None else -1.0} for i, c in enumerate(columns)}


def scale_features(df: DataFrame, columns: list[str], method: str = "zscore", keep=("respondent_id",)) -> DataFrame:
    """Impute the mean, then scale: zscore, robust (median / IQR), winsor_z (clip 1-99 %), log1p_z.

    The scale constants are a few numbers per column; the rows are transformed in place.
    """
    # Only the features are kept, once: the passes below do not re-run what produced them.
    src = cut(df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]))
    if method == "winsor_z":
        q = {r["item"]: (r["q0"], r["q1"]) for r in exact_quantiles(src, columns, [0.01, 0.99]).collect()}
        src = src.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(q[c][0])), F.lit(q[c][1])))
                               for c in columns if c in q})
    stats = _column_stats(src, columns)
    if method == "log1p_z":
        positive = [c for c in columns if stats[c]["min"] >= 0]
        src = src.withColumns({c: F.log1p(F.col(c)) for c in positive})
        stats = _column_stats(src, columns)
    filled = src.select(*keep, *[F.coalesce(F.col(c), F.lit(float(stats[c]["mean"]))).alias(c) for c in columns])
    if method == "robust":
        q = {r["item"]: (r["q1"], r["q2"] - r["q0"]) for r in exact_quantiles(filled, columns, [0.25, 0.5, 0.75]).collect()}
        centre = {c: q[c][0] for c in columns}
        spread_by = {c: q[c][1] if q[c][1] >= 1e-10 else 1.0 for c in columns}
    else:
        centre = {c: stats[c]["mean"] for c in columns}
        spread_by = {c: stats[c]["sd"] if stats[c]["sd"] >= 1e-10 else 1.0 for c in columns}
    return filled.select(*keep, *[((F.col(c) - F.lit(float(centre[c]))) / F.lit(float(spread_by[c]))).alias(c) for c in columns])


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values become the column mean, in the plan and without a collect."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m")).scalar()
    out = df.withColumn("_m", means)
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_m.{c}")) for c in columns}).drop("_m")


def vectors(df: DataFrame, columns: list[str], id_col: str = "respondent_id") -> DataFrame:
    """(id, z) with the columns as one array, cut and spread for the iterations that follow."""
    return spread(df.select(id_col, F.array(*[F.col(c).cast("double") for c in columns]).alias("z")), id_col)


# --- numpy kernels run by tasks ---------------------------------------------------------------
def _z(batch: pa.RecordBatch, name: str = "z") -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(axis=1)[None, :] - 2.0 * (x @ centres.T), axis=1)


_SUMS = "grp int, n bigint, s array<double>"


def _grouped_sums(x: np.ndarray, g: np.ndarray, acc: dict[int, list]) -> None:
    order = np.argsort(g, kind="stable")
    keys, starts = np.unique(g[order], return_index=True)
    sums, counts = np.add.reduceat(x[order], starts, axis=0), np.diff([*starts, len(g)])
    for k, c, s in zip(keys.tolist(), counts.tolist(), sums):
        if k in acc:
            acc[k][0] += c
            acc[k][1] += s
        else:
            acc[k] = [c, s.copy()]


def _emit(acc: dict[int, list]) -> Iterator[pa.RecordBatch]:
    return batches_of([(k,) for k in acc], [v[0] for v in acc.values()], [v[1] for v in acc.values()], ["grp"], [pa.int32()])


def grouped_sums(frame: DataFrame, group_of) -> dict[int, tuple[int, np.ndarray]]:
    """Row counts and vector sums per group number; ``group_of(x)`` runs inside tasks.

    A task emits one row per group, so the shuffle is groups x tasks whatever the row count.
    """
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, list] = {}
        for b in batches:
            if b.num_rows:
                x = _z(b)
                for g, v in group_of(x):
                    _grouped_sums(v, g, acc)
        yield from _emit(acc)

    return collect_sums(frame.select("z").mapInArrow(reduce, _SUMS))


def collect_sums(part: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Add up the tasks' (grp, n, s) rows."""
    return collected(part, ["grp"])


def _width(frame: DataFrame) -> int:
    return frame.select(F.size("z")).first()[0]


# --- two-stage clustering -----------------------------------------------------------------------
def _moments(batches: Iterator[pa.RecordBatch], p: int) -> Iterator[pa.RecordBatch]:
    """A task's count, sums and p x p sums of products, as one row; the products of a row are never held."""
    n, s, m = 0, np.zeros(p), np.zeros((p, p))
    for b in batches:
        if b.num_rows:
            x = _z(b)
            n += len(x)
            s += x.sum(axis=0)
            m += x.T @ x
    if n:
        yield from batches_of([(0,)], [n], [np.concatenate([s, m.ravel()])], ["grp"], [pa.int32()])


def _direction_bits(frame: DataFrame, p: int, bits: int):
    """Principal axes and per-axis cut points for at most 2^bits cells, from the p x p moments."""
    n, s = collect_sums(frame.select("z").mapInArrow(lambda batches: _moments(batches, p), _SUMS))[0]
    mean = s[:p] / n
    cov = s[p:].reshape(p, p) / n - np.outer(mean, mean)
    lam, vec = np.linalg.eigh(cov)
    lam, vec = np.clip(lam[::-1], 0, None), vec[:, ::-1]
    share = np.zeros(p, dtype=int)
    for _ in range(bits):  # the next bit goes to the axis with the most variance left inside a cell
        a = int(np.argmax(lam / 4.0 ** share))
        if lam[a] <= 1e-12:
            break
        share[a] += 1
    axes = np.flatnonzero(share)
    cuts = [[NormalDist(0, math.sqrt(lam[a])).inv_cdf(j / 2 ** share[a]) for j in range(1, 2 ** share[a])] for a in axes]
    return mean, vec[:, axes], cuts


def _cells(x: np.ndarray, mean, axes, cuts) -> np.ndarray:
    y = (x - mean) @ axes
    cell = np.zeros(len(x), dtype=np.int64)
    for j, c in enumerate(cuts):
        cell = cell * (len(c) + 1) + np.searchsorted(c, y[:, j], side="right")
    return cell.astype(np.int32)


def micro_clusters(frame: DataFrame, p: int, limit: int = MAX_MICRO) -> tuple[np.ndarray, np.ndarray]:
    """Centres and weights of at most ``limit`` micro-clusters: cells along the principal axes, however many rows there are."""
    mean, axes, cuts = _direction_bits(frame, p, int(math.log2(limit)))
    sums = grouped_sums(frame, lambda x: [(_cells(x, mean, axes, cuts), x)])
    keys = sorted(sums)
    w = np.array([sums[k][0] for k in keys], dtype=float)
    return np.array([sums[k][1] / sums[k][0] for k in keys]), w


def ward_centres(points: np.ndarray, weights: np.ndarray, ks) -> dict[int, np.ndarray]:
    """Weighted Ward merging of the micro-clusters; one tree serves every k."""
    order = np.lexsort(points.T[::-1])
    c, w = points[order].astype(float).copy(), weights[order].astype(float).copy()
    m = len(c)
    out = {k: c.copy() for k in ks if m <= k}

    def cost(i):
        d = ((c - c[i]) ** 2).sum(axis=1) * (w * w[i] / (w + w[i]))
        d[~alive] = np.inf
        d[i] = np.inf
        return d

    alive = np.ones(m, dtype=bool)
    table = np.array([cost(i) for i in range(m)])
    for left in range(m, min(ks, default=m), -1):
        i, j = np.unravel_index(np.argmin(table), table.shape)
        i, j = min(i, j), max(i, j)
        c[i] = (w[i] * c[i] + w[j] * c[j]) / (w[i] + w[j])
        w[i] += w[j]
        alive[j] = False
        table[j, :] = table[:, j] = np.inf
        d = cost(i)
        table[i, :] = table[:, i] = d
        if left - 1 in ks:
            out[left - 1] = c[alive].copy()
    # rounded, so that the order of equal figures does not hang on the order in which tasks added them up
    return {k: v[np.lexsort(np.round(v, 9).T[::-1])] for k, v in out.items()}


def lloyd(frame: DataFrame, start: dict[int, np.ndarray], steps: int = LLOYD_STEPS) -> dict[int, np.ndarray]:
    """Refine the centres of every k in the same passes until none moves or ``steps`` is reached."""
    centres, active = dict(start), set(start)
    for _ in range(steps):
        if not active:
            break
        now = {k: centres[k] for k in sorted(active)}
        first = dict(zip(now, np.cumsum([0, *map(len, now.values())]).tolist()))

        def groups(x, now=now, first=first):
            return [(_nearest(x, c).astype(np.int32) + first[k], x) for k, c in now.items()]

        sums = grouped_sums(frame, groups)
        for k, c in now.items():
            new = np.array([sums[first[k] + i][1] / sums[first[k] + i][0] if first[k] + i in sums else c[i] for i in range(len(c))])
            if np.allclose(new, c, rtol=0, atol=1e-12):
                active.discard(k)
            centres[k] = new
    return centres


def label_rows(frame: DataFrame, centres: dict[int, np.ndarray], id_col: str = "respondent_id") -> DataFrame:
    """(id, z, labels): one 1-based label per k, in key order."""
    ordered = [centres[k] for k in sorted(centres)]
    schema = pa.schema([("id", pa.int64()), ("z", pa.list_(pa.float64())), ("labels", pa.list_(pa.int32()))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _z(b)
                lab = np.column_stack([_nearest(x, c) + 1 for c in ordered]).astype(np.int32)
                offsets = np.arange(0, lab.size + 1, lab.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, lab.ravel())], schema=schema)

    out = frame.select(F.col(id_col).cast("bigint").alias("id"), "z").mapInArrow(assign, "id bigint, z array<double>, labels array<int>")
    return out.withColumnRenamed("id", id_col)


def cluster_two_stage(frame: DataFrame, ks=(2, 3, 4), id_col: str = "respondent_id", limit: int = MAX_MICRO):
    """Ward on micro-clusters, refined by k-means: ({k: centres}, labelled rows)."""
    p = _width(frame)
    points, weights = micro_clusters(frame, p, limit)
    centres = lloyd(frame, ward_centres(points, weights, set(ks)))
    return centres, cut(label_rows(frame, centres, id_col))


def nearest_center(frame: DataFrame, centres: DataFrame, id_col: str, center_col: str = "cluster", vec="z", center_vec="center") -> DataFrame:
    """(id, cluster, distance): the nearest of a small table of centres, folded over an array of them."""
    table = centres.agg(F.array_sort(F.collect_list(F.struct(F.col(center_col).alias("k"), F.col(center_vec).alias("c")))).alias("t")).scalar()
    dist = F.transform(F.col("_t"), lambda t: F.struct(euclidean(F.col(vec), t["c"]).alias("distance"), t["k"].alias("k")))
    best = F.array_min(dist)
    return frame.withColumn("_t", table).withColumn("_b", best).select(
        id_col, F.col("_b.k").alias(center_col), F.col("_b.distance").alias("distance"))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v))


# --- internal indices ------------------------------------------------------------------------------
def _label_groups(frame: DataFrame, models: int):
    """Per model and label: count and centre."""
    return _sums_with_labels(frame, models, lambda x, lab, m: x)


def _sums_with_labels(frame: DataFrame, models: int, values) -> dict[int, dict[int, tuple[int, np.ndarray]]]:
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, list] = {}
        for b in batches:
            if b.num_rows:
                x = _z(b)
                lab = _z(b, "labels").astype(np.int32)
                for m in range(models):
                    _grouped_sums(values(x, lab[:, m], m), lab[:, m] * models + m, acc)
        yield from _emit(acc)

    out: dict[int, dict[int, tuple[int, np.ndarray]]] = {m: {} for m in range(models)}
    for g, v in collect_sums(frame.select("z", "labels").mapInArrow(reduce, _SUMS)).items():
        out[g % models][g // models] = v
    return out


def ch_db_indices(frame: DataFrame, models: int = 1) -> list[dict]:
    """Calinski-Harabasz and Davies-Bouldin for every labelling of the rows, in two passes."""
    groups = _label_groups(frame, models)
    centres = [{k: s / n for k, (n, s) in g.items()} for g in groups.values()]
    tables = [(np.array([c[k] for k in sorted(c)]), np.array(sorted(c))) for c in centres]

    def distances(x, lab, m):
        c, keys = tables[m]
        d2 = ((x - c[np.searchsorted(keys, lab)]) ** 2).sum(axis=1)
        return np.column_stack([d2, np.sqrt(d2)])

    inner = _sums_with_labels(frame, models, distances)
    out = []
    for m in range(models):
        keys = sorted(groups[m])
        k, n = len(keys), sum(groups[m][i][0] for i in keys)
        size = np.array([groups[m][i][0] for i in keys], dtype=float)
        cen = np.array([centres[m][i] for i in keys])
        within = sum(inner[m][i][1][0] for i in keys)
        between = float((size * ((cen - (size[:, None] * cen).sum(axis=0) / n) ** 2).sum(axis=1)).sum())
        ch = (between / (k - 1)) / (within / (n - k)) if k > 1 and n > k and within > 1e-12 else None
        db = None
        if k > 1:
            scatter = np.array([inner[m][i][1][1] for i in keys]) / size
            gap = np.sqrt(((cen[:, None, :] - cen[None, :, :]) ** 2).sum(axis=2))
            ratio = np.where(gap > 1e-12, (scatter[:, None] + scatter[None, :]) / np.where(gap > 1e-12, gap, 1.0), np.inf)
            np.fill_diagonal(ratio, 0.0)
            db = float(ratio.max(axis=1).mean())
        out.append({"calinski_harabasz": None if ch is None else float(ch), "davies_bouldin": db,
                    "cluster_size_distribution": "|".join(str(int(s)) for s in size)})
    return out


# --- silhouette ----------------------------------------------------------------------------------------
def _one_hot(lab: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return (lab[:, None] == levels[None, :]).astype(float)


def _score(sums: np.ndarray, lab: np.ndarray, levels: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Silhouette per row from distance sums to each cluster."""
    own = np.searchsorted(levels, lab)
    rows = np.arange(len(lab))
    n_own = sizes[own]
    a = np.where(n_own > 1, sums[rows, own] / np.maximum(n_own - 1, 1), 0.0)
    other = sums / sizes[None, :]
    other[rows, own] = np.inf
    b = other.min(axis=1)
    top = np.maximum(a, b)
    return np.where(top > 0, (b - a) / np.where(top > 0, top, 1.0), 0.0)


def silhouette_of_cells(lab: np.ndarray, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> float | None:
    """Euclidean silhouette of labelled cells of rows from their counts, vector sums and sums of squares.

    The distance between the rows of two cells is the root of its mean square, |m1 - m2|^2 + v1 + v2, which is exact for cells of equal
    rows and too long by the spread of the distances otherwise: with 64 cells the mean silhouette is within 0.02 of that of all pairs.
    """
    levels = np.unique(lab)
    if len(levels) < 2:
        return None
    m = s / n[:, None]
    v = np.clip(q / n - (m ** 2).sum(axis=1), 0.0, None)
    norm = (m ** 2).sum(axis=1)
    d = np.sqrt(np.clip(norm[:, None] + norm[None, :] - 2.0 * (m @ m.T), 0.0, None) + v[:, None] + v[None, :])
    hot = _one_hot(lab, levels)
    # a row has n - 1 others in its own cell
    np.fill_diagonal(d, np.sqrt(2.0 * v * n / np.maximum(n - 1, 1)) * (n - 1) / n)
    return float((n * _score(d @ (hot * n[:, None]), lab, levels, hot.T @ n)).sum() / n.sum())


def _micro_silhouette(frame: DataFrame, models: int, p: int) -> list[float | None]:
    """From the moments of at most 256 cells per cluster, in one pass."""
    mean, axes, cuts = _direction_bits(frame, p, 8)
    slots = math.prod(len(c) + 1 for c in cuts)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, list] = {}
        for b in batches:
            if b.num_rows:
                x, lab = _z(b), _z(b, "labels").astype(np.int64)
                cell = _cells(x, mean, axes, cuts).astype(np.int64)
                both = np.column_stack([x, (x ** 2).sum(axis=1)])
                for m in range(models):
                    _grouped_sums(both, (lab[:, m] * models + m) * slots + cell, acc)
        yield from _emit(acc)

    held: list[list] = [[] for _ in range(models)]
    for g, (n, v) in collect_sums(frame.select("z", "labels").mapInArrow(reduce, _SUMS)).items():
        lab, m = divmod(g // slots, models)
        held[m].append((lab, n, v[:-1], v[-1]))
    return [silhouette_of_cells(*(np.array(c, dtype=t) for c, t in zip(zip(*h), (int, float, float, float)))) for h in held]


def _label_moments(frame: DataFrame, models: int):
    """Per model: labels, their counts, vector sums and sums of squares."""
    got = _sums_with_labels(frame, models, lambda x, lab, m: np.column_stack([x, (x ** 2).sum(axis=1)]))
    out = []
    for m in range(models):
        keys = sorted(got[m])
        v = np.array([got[m][k][1] for k in keys])
        out.append((np.array(keys), np.array([got[m][k][0] for k in keys], dtype=float), v[:, :-1], v[:, -1]))
    return out


def _squared_silhouette(frame: DataFrame, models: int) -> list[float | None]:
    """Exact for squared distances: a row's sum of squares to a cluster follows from the cluster's n, sum and sum of squares."""
    tables = _label_moments(frame, models)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, list] = {}
        for b in batches:
            if b.num_rows:
                x, lab = _z(b), _z(b, "labels").astype(np.int32)
                own = (x ** 2).sum(axis=1)
                for m, (levels, n, s, q) in enumerate(tables):
                    sums = np.clip(own[:, None] * n[None, :] - 2.0 * (x @ s.T) + q[None, :], 0.0, None)
                    _grouped_sums(_score(sums, lab[:, m], levels, n)[:, None], np.full(len(x), m, dtype=np.int32), acc)
        yield from _emit(acc)

    got = collect_sums(frame.select("z", "labels").mapInArrow(reduce, _SUMS))
    return [float(got[m][1][0] / got[m][0]) if len(tables[m][0]) > 1 else None for m in range(models)]


def cluster_distances(frame: DataFrame) -> DataFrame:
    """(own, other, mean_squared_distance): mean over the rows of ``own`` of their mean squared distance to the other rows of ``other``, from moments."""
    levels, n, s, q = _label_moments(frame, 1)[0]
    rows = []
    for i, a in enumerate(levels):
        for j, b in enumerate(levels):
            if i != j:
                rows.append((int(a), int(b), float(q[i] / n[i] + q[j] / n[j] - 2.0 * (s[i] @ s[j]) / (n[i] * n[j]))))
            elif n[i] > 1:
                rows.append((int(a), int(b), float(2.0 * (q[i] - s[i] @ s[i] / n[i]) / (n[i] - 1))))
    return frame.sparkSession.createDataFrame(rows, "own int, other int, mean_squared_distance double")


def _blocks(frame: DataFrame, n: int) -> DataFrame:
    """(tile_a, tile_b, side, pos, z, labels): rows dealt to blocks of at most about ``BLOCK`` rows; a tile is a pair of blocks and holds both.

    Tiles bound the memory of a task by two blocks. A block travels once a block, n / BLOCK times, never once a row.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    # enough tiles for every core, also where the table is small
    blocks = max(math.ceil(n / BLOCK), min(math.ceil(math.sqrt(2 * cores)), math.ceil(n / 256)), 1)
    # the frame is materialised, so that positions stay what they are
    rows = cut(frame.select("z", "labels").withColumn("pos", F.monotonically_increasing_id()).withColumn("block", F.pmod("pos", F.lit(blocks)).cast("int")))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return met.select(F.least("block", "other").alias("tile_a"), F.greatest("block", "other").alias("tile_b"), (F.col("block") > F.col("other")).cast("int").alias("side"), "pos", "z", "labels")


def _tiles(frame: DataFrame, n: int, reduce, schema: str) -> DataFrame:
    """``reduce(a, b, xa, la, xb, lb)`` of every tile: its two blocks' vectors and labels in order of position; the same block twice on the diagonal."""
    def run(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        a, b = (k.as_py() for k in keys)
        side = table.column("side").to_numpy()
        order = np.lexsort((table.column("pos").to_numpy(), side))
        x, lab = (_z(table.select([c]).combine_chunks().to_batches()[0], c)[order] for c in ("z", "labels"))
        x = x - x.mean(axis=0)  # distances are those of the rows; near zero fewer digits cancel
        m = int((side == 0).sum())
        return reduce(a, b, x[:m], lab[:m], *((x[:m], lab[:m]) if a == b else (x[m:], lab[m:])))

    return _blocks(frame, n).groupBy("tile_a", "tile_b").applyInArrow(run, schema)


def _distance_sums(xa, ha, xb, hb, same: bool):
    """Sums of Euclidean distances of every row of a to b's clusters, and of b to a's, in steps of ``_STEP`` rows."""
    to_b, to_a = np.zeros((len(xa), hb.shape[1])), np.zeros((len(xb), ha.shape[1]))
    na, nb = (xa ** 2).sum(axis=1), (xb ** 2).sum(axis=1)
    for i in range(0, len(xa), _STEP):
        for j in range(i if same else 0, len(xb), _STEP):
            u, v = slice(i, i + _STEP), slice(j, j + _STEP)
            d = xa[u] @ xb[v].T
            d *= -2.0
            d += na[u, None]
            d += nb[None, v]
            np.sqrt(np.maximum(d, 0.0, out=d), out=d)
            if same and i == j:
                np.fill_diagonal(d, 0.0)
                to_b[u] += d @ hb[v]
            else:
                to_b[u] += d @ hb[v]
                to_a[v] += d.T @ ha[u]
    return (to_b + to_a, None) if same else (to_b, to_a)


def _label_sizes(frame: DataFrame, models: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per model: its labels in order and their counts."""
    counts = frame.select(F.posexplode("labels").alias("m", "k")).groupBy("m", "k").agg(F.count(F.lit(1)).alias("n")).collect()
    by = [sorted((r["k"], r["n"]) for r in counts if r["m"] == m) for m in range(models)]
    return [(np.array([k for k, _ in v], dtype=int), np.array([n for _, n in v], dtype=float)) for v in by]


def _exact_silhouette(frame: DataFrame, models: int) -> list[float | None]:
    """Euclidean over all pairs of rows: a tile emits the distance sums of its rows to the clusters, never pairs."""
    sizes = _label_sizes(frame, models)
    first = np.cumsum([0, *(len(levels) for levels, _ in sizes)])
    width, total = int(first[-1]), int(sizes[0][1].sum()) if len(sizes[0][1]) else 0
    # numbers a row: a sum per label, then its own labels, which the diagonal tile knows
    names, kinds = ["block", "piece"], [pa.int32(), pa.int32()]

    def hot(lab):
        return np.column_stack([_one_hot(lab[:, m], levels) for m, (levels, _) in enumerate(sizes)])

    def reduce(a, b, xa, la, xb, lb):
        keys, n, arrays = [], [], []
        sums = _distance_sums(xa, hot(la), xb, hot(lb), a == b)
        for block, s, lab in ((a, sums[0], la if a == b else np.zeros_like(la)), (b, sums[1], np.zeros_like(lb))):
            if s is not None:
                both = np.column_stack([s, lab])
                for p, i in enumerate(range(0, len(both), _PIECE)):
                    keys.append((block, p))
                    n.append(0)
                    arrays.append(both[i:i + _PIECE].ravel())
        return pa.Table.from_batches(batches_of(keys, n, arrays, names, kinds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, list] = {}
        for b in batches:
            s = b.column(b.num_columns - 1)
            if b.num_rows:
                rows = s.flatten().to_numpy(zero_copy_only=False).reshape(-1, width + models)
                lab = rows[:, width:].astype(int)
                for m, (levels, n) in enumerate(sizes):
                    if len(levels) > 1:
                        _grouped_sums(_score(rows[:, first[m]:first[m + 1]].copy(), lab[:, m], levels, n)[:, None], np.full(len(rows), m, dtype=np.int32), acc)
        yield from _emit(acc)

    part = _tiles(frame, total, reduce, "block int, piece int, n bigint, s array<double>")
    got = collect_sums(add_up(part, names).mapInArrow(score, _SUMS))
    return [float(got[m][1][0] / got[m][0]) if m in got else None for m in range(models)]


def pair_distances(frame: DataFrame) -> DataFrame:
    """(own, other, mean_distance): mean over the rows of ``own`` of their mean Euclidean distance to the other rows of ``other``, over all pairs."""
    levels, size = _label_sizes(frame, 1)[0]

    def reduce(a, b, xa, la, xb, lb):
        ha, hb = _one_hot(la[:, 0], levels), _one_hot(lb[:, 0], levels)
        to_b, _ = _distance_sums(xa, ha, xb, hb, a == b)
        both = ha.T @ to_b
        return pa.Table.from_batches(batches_of([()], [0], [(both if a == b else both + both.T).ravel()], [], []))

    total = int(size.sum())
    got = collected(_tiles(frame, total, reduce, "n bigint, s array<double>"), []) if total else {}
    rows = []
    for sums in (v.reshape(len(levels), -1) for _, v in got.values()):
        for i, a in enumerate(levels):
            for j, b in enumerate(levels):
                others = size[j] - (i == j)
                if others > 0:
                    rows.append((int(a), int(b), float(sums[i, j] / (size[i] * others))))
    return frame.sparkSession.createDataFrame(rows, "own int, other int, mean_distance double")


def silhouette(frame: DataFrame, models: int = 1, method: str = "micro") -> list[dict]:
    """Mean silhouette of every labelling: Euclidean from cells ('micro') or exact on squared distances ('squared'), in passes that grow with the rows,
    or Euclidean over all pairs ('exact'), whose time grows with their square."""
    if method == "exact":
        got = _exact_silhouette(frame, models)
    else:
        got = _squared_silhouette(frame, models) if method == "squared" else _micro_silhouette(frame, models, _width(frame))
    return [{"silhouette": v, "silhouette_method": method} for v in got]


# --- choosing, naming, aligning -----------------------------------------------------------------------
def best_k(metrics: DataFrame, then: list[str], score: str = "silhouette") -> DataFrame:
    return metrics.orderBy(F.col(score).desc(), *then).limit(1)


def preferred_model(metrics: DataFrame, score="stratified_external_score", sil="silhouette", db="davies_bouldin") -> DataFrame:
    return metrics.orderBy(F.col(score).desc(), F.col(sil).desc(), F.col(db).asc()).limit(1)


def cluster_names(profiles: DataFrame, by: str = "cluster") -> DataFrame:
    """Names handed out greedily: culture + motives first, then promotions, then performance, then the rest.

    Profiles are one row per cluster; each step keeps the rows the earlier steps left over.
    """
    rules = [F.col("cognition_mean") + F.col("motive_count"), F.col("promo_pref_count"), F.col("performance_mean")]
    out = profiles.withColumn("cluster_name", F.lit(None).cast("string"))
    for name, score in zip(P.CLUSTER_NAMES, rules):
        open_rows = F.col("cluster_name").isNull()
        rank = F.row_number().over(W.partitionBy(open_rows).orderBy(score.desc(), F.col(by)))
        out = out.withColumn("_r", rank).withColumn("cluster_name", F.when(open_rows & (F.col("_r") == 1), name).otherwise(F.col("cluster_name"))).drop("_r")
    return out.withColumn("cluster_name", F.coalesce("cluster_name", F.lit(P.CLUSTER_NAMES[-1])))


def label_crosswalk(a: DataFrame, b: DataFrame, id_col: str = "respondent_id", label: str = "cluster") -> DataFrame:
    """(ref_label, new_label, n) of two labelings of the same rows."""
    return (a.select(id_col, F.col(label).alias("ref_label")).join(b.select(id_col, F.col(label).alias("new_label")), id_col)
            .groupBy("ref_label", "new_label").agg(F.count(F.lit(1)).alias("n")))


def best_assignment(gain: list[list[int]]) -> list[int]:
    """Column of each row of a square table of integers, one to one, with the largest sum (augmenting paths, cubic time)."""
    n = len(gain)
    row_of, u, v = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        slack, back, used = [None] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while row_of[j0]:
            used[j0], i0 = True, row_of[j0]
            for j in range(1, n + 1):
                if not used[j]:
                    cost = -gain[i0 - 1][j - 1] - u[i0] - v[j]
                    if slack[j] is None or cost < slack[j]:
                        slack[j], back[j] = cost, j0
            j1 = min((j for j in range(1, n + 1) if not used[j]), key=lambda j: slack[j])
            step = slack[j1]
            for j in range(n + 1):
                if used[j]:
                    u[row_of[j]] += step
                    v[j] -= step
                elif slack[j] is not None:
                    slack[j] -= step
            j0 = j1
        while j0:
            row_of[j0] = row_of[back[j0]]
            j0 = back[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[row_of[j] - 1] = j - 1
    return out


def align_labels(crosswalk: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, new_label, aligned_label, agreement): the one-to-one mapping with the most overlap, the first in order of labels on ties.

    A new label that finds no reference label keeps its own.
    """
    by = list(by)

    def mapping(pdf: pd.DataFrame) -> pd.DataFrame:
        refs, news = sorted(pdf["ref_label"].unique()), sorted(pdf["new_label"].unique())
        cell = {(r.ref_label, r.new_label): int(r.n) for r in pdf.itertuples(index=False)}
        n = max(len(refs), len(news))
        slots = [*refs, *[None] * (n - len(refs))]
        # exact integers: overlap first, then small references for small new labels
        gain = [[(cell.get((r, news[i]), 0) if i < len(news) else 0) * (n + 1) ** (n + 1) + (n - j) * (n + 1) ** (n - 1 - i) for j, r in enumerate(slots)] for i in range(n)]
        best = [slots[j] for j in best_assignment(gain)[: len(news)]]
        hit = sum(cell.get((r, x), 0) for r, x in zip(best, news))
        return pd.DataFrame([(*[pdf[b].iloc[0] for b in by], int(x), int(x if r is None else r), hit / pdf["n"].sum()) for r, x in zip(best, news)],
                            columns=[*by, "new_label", "aligned_label", "agreement"])

    fields = [f"{b} {dict(crosswalk.dtypes)[b]}" for b in by]
    keyed = crosswalk if by else crosswalk.withColumn("_one", F.lit(1))
    return keyed.groupBy(*(by or ["_one"])).applyInPandas(mapping, ", ".join([*fields, "new_label int, aligned_label int, agreement double"]))


# --- soft segments -------------------------------------------------------------------------------------
def soft_quantile_cut(df: DataFrame, score: str, low: float = 0.3, high: float = 0.7) -> DataFrame:
    return exact_quantiles(df, [score], [low, high]).select(F.col("q0").alias("q_low"), F.col("q1").alias("q_high"))


def top2_margin(shares: Column) -> Column:
    """Largest minus second largest membership; 1 when there is only one."""
    s = F.sort_array(shares, asc=False)
    return F.when(F.size(s) >= 2, s[0] - F.try_element_at(s, F.lit(2))).otherwise(F.lit(1.0))


def soft_segment(frame: DataFrame, centres: DataFrame, focus, id_col: str = "respondent_id", hard: str | None = None, names: DataFrame | None = None) -> DataFrame:
    """(id, hard_cluster, hard_cluster_name, affinity, certainty, segment): exp(-distance) shares and a 30/70 cut of the focus cluster's share.

    ``centres`` is a small table (cluster, center); ``focus`` is the cluster the affinity is measured to; ``hard`` is the frame's own label and
    ``names`` a small table (cluster, cluster_name). Without them the columns are left out.
    """
    own = [F.col(hard).cast("int").alias("hard_cluster")] if hard else []
    if hard and names is not None:
        known = names.agg(F.map_from_entries(F.collect_list(F.struct(F.col("cluster").cast("int"), "cluster_name"))).alias("m")).scalar()
        frame = frame.withColumn("_n", known)
        own.append(F.try_element_at("_n", F.col(hard).cast("int")).alias("hard_cluster_name"))
    table = centres.agg(F.array_sort(F.collect_list(F.struct(F.col("cluster").alias("k"), F.col("center").alias("c")))).alias("t")).scalar()
    raw = F.transform(F.col("_t"), lambda t: F.exp(-euclidean(F.col("z"), t["c"])))
    shares = F.transform(F.col("_w"), lambda w: w / F.aggregate(F.col("_w"), F.lit(0.0), lambda a, v: a + v))
    keys = F.transform(F.col("_t"), lambda t: t["k"])
    rows = (frame.withColumn("_t", table).withColumn("_w", raw).withColumn("_s", shares)
            .select(id_col, *own, F.element_at("_s", F.array_position(keys, focus).cast("int")).alias("affinity"), top2_margin(F.col("_s")).alias("certainty")))
    cutoff = soft_quantile_cut(rows, "affinity").select(F.struct("q_low", "q_high")).scalar()
    seg = (F.when(F.col("affinity") >= F.col("_c.q_high"), P.SOFT_SEGMENTS["high"])
           .when(F.col("affinity") <= F.col("_c.q_low"), P.SOFT_SEGMENTS["low"]).otherwise(P.SOFT_SEGMENTS["grey"]))
    return rows.withColumn("_c", cutoff).withColumn("soft_segment", seg).drop("_c")


def soft_summary(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("soft_segment").agg(F.count(F.lit(1)).alias("n"), F.avg("affinity").alias("mean_affinity"), F.avg("certainty").alias("mean_certainty"))
    return out.withColumn("share_pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()))


def centre_table(spark, centres: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres, 1)], "cluster int, center array<double>")
