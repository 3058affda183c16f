"""Resampling stability of a segmentation.

Membership in a resample is a hash test, so rows are never copied per run: a task scores its
rows for all runs at once and emits one array of sums per run and slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scores as S
from . import cluster as C
from .partials import batches_of, collected

# Histogram slots of the first two passes, and the bits left to the last one.
_SLOTS = 4096
_LAST_SHIFT = 8
#: Bins of a column's values that all runs count in, and the size of the sketch that places them.
BINS = 256
_SKETCH_K = 2048
#: Columns of at most so many bins are counted for all runs by one matrix product; rows of a step of such products.
_FEW_BINS = 32
_ROWS = 2048


def _hash_histogram(ids: DataFrame, runs: int, shift: int, parents: dict[int, int] | None) -> dict[int, np.ndarray]:
    """run -> rows per hash bucket of width 2^shift, inside each run's parent bucket; a task emits an array a run."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((runs, _SLOTS))
        for b in batches:
            if b.num_rows:
                x = _ids(b)
                for r in range(runs):
                    h = S.portable_hash_array(x, r + 1).view(np.int64) >> shift
                    if parents is not None:
                        h = h[(h >> (12 if shift else _LAST_SHIFT)) == parents[r + 1]]
                    acc[r] += np.bincount(h & (_SLOTS - 1), minlength=_SLOTS)
        yield from batches_of([(r + 1,) for r in range(runs)], [0] * runs, list(acc), ["run"], [pa.int32()])

    return {r: v for r, (_, v) in collected(ids.mapInArrow(count, "run int, n bigint, s array<double>"), ["run"]).items()}


def _tied(ids: DataFrame, at: dict[int, int]) -> DataFrame:
    """(run, id, n): rows whose hash is the run's last one, counted per id, so an id that many rows hold is one row."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, run, found, count = _ids(b), [], [], []
            for r, h in at.items():
                same, n = np.unique(x[S.portable_hash_array(x, r) == np.uint64(h)], return_counts=True)
                run.append(np.full(len(same), r, np.int32))
                found.append(same)
                count.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(run)), pa.array(np.concatenate(found).astype(np.int64)), pa.array(np.concatenate(count).astype(np.int64))],
                                             names=["run", "id", "n"])

    return ids.mapInArrow(find, "run int, id bigint, n bigint").groupBy("run", "id").agg(F.sum("n").alias("n"))


def resample_cuts(df: DataFrame, runs: int, ratio: float, min_n: int = 50, id_col: str = "respondent_id") -> list[tuple[int, int, int]]:
    """(run, hash, id) of the last member of each run: exactly round(ratio * n) rows, no replacement.

    Three histogram passes narrow the cut to one hash value per run; only rows that share that
    value (about n / 2^32) are compared by id.  Rows are never copied per run.
    """
    ids = df.select(F.col(id_col).cast("bigint").alias("id"))
    n = ids.count()
    take = min(n, max(min_n, int(round(ratio * n))))
    if not n:
        return []
    need = {r: take for r in range(1, runs + 1)}
    prefix: dict[int, int] | None = None
    for shift in (20, 8, 0):
        hist = _hash_histogram(ids, runs, shift, prefix)
        width = _SLOTS if shift else 1 << _LAST_SHIFT
        found = {}
        for r, have in hist.items():
            upto = np.cumsum(have).astype(np.int64)
            at = int(np.searchsorted(upto, need[r]))
            need[r] -= int(upto[at] - have[at])
            found[r] = (prefix[r] if prefix else 0) * width + at % width
        prefix = found
    tied = _tied(ids, prefix)
    out = {}
    for r in sorted(tied.collect(), key=lambda t: (t["run"], t["id"])):
        if need[r["run"]] > 0:
            need[r["run"]] -= r["n"]
            out[r["run"]] = (r["run"], prefix[r["run"]], r["id"])
    return [out[r] for r in sorted(out)]


def resample_summary(df: DataFrame, cuts, id_col: str = "respondent_id") -> DataFrame:
    """(run, n, id_sum, id_max) of every run: a task tests its rows against all runs and emits a row a run."""
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, top = (np.zeros(len(cuts), np.int64) for _ in range(3))
        top -= 1 << 62
        for b in batches:
            if b.num_rows:
                ids = _ids(b)
                m = _mask(ids, cuts)
                n += m.sum(axis=0)
                total += ids @ m
                top = np.maximum(top, np.where(m, ids[:, None], -(1 << 62)).max(axis=0))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([cuts[i][0] for i in met], pa.int32()), *(pa.array(v[met]) for v in (n, total, top))], names=["run", "n", "id_sum", "id_max"])

    part = df.select(F.col(id_col).cast("bigint").alias("id")).mapInArrow(reduce, "run int, n bigint, id_sum bigint, id_max bigint")
    return part.groupBy("run").agg(F.sum("n").alias("n"), F.sum("id_sum").alias("id_sum"), F.max("id_max").alias("id_max"))


def membership(cuts: list[tuple[int, int, int]], id_col: str = "respondent_id") -> Column:
    """Array of the runs a row belongs to."""
    tests = []
    for run, h, i in cuts:
        v = S.portable_hash(id_col, run)
        tests.append(F.when((v < h) | ((v == h) & (F.col(id_col) <= i)), F.lit(run)))
    return F.array_compact(F.array(*tests))


def _mask(ids: np.ndarray, cuts) -> np.ndarray:
    out = np.empty((len(ids), len(cuts)), dtype=bool)
    for j, (run, h, i) in enumerate(cuts):
        v = S.portable_hash_array(ids, run).view(np.int64)
        out[:, j] = (v < h) | ((v == h) & (ids <= i))
    return out


def with_members(frame: DataFrame, cuts) -> DataFrame:
    """frame with its rows' runs as packed bits, materialised: the passes that follow test a bit instead of a hash per run."""
    schema = frame.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.packbits(_mask(_ids(b), cuts), axis=1)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bits.shape[1]), len(bits), [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, packed], names=[*b.schema.names, "runs"])

    return C.cut(frame.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "runs binary"])))


def _members(b: pa.RecordBatch, runs: int) -> np.ndarray:
    col = b.column(b.schema.get_field_index("runs"))
    bits = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1)
    return np.unpackbits(bits, axis=1, count=runs).astype(bool)


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return b.column(b.schema.get_field_index("id")).to_numpy(zero_copy_only=False).astype(np.int64)


def value_bins(frame: DataFrame, p: int, bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of at most ``bins`` bins per column: quantiles of one mergeable sketch a column, the largest value last.

    A column of fewer values than bins gets a bin a value, so that its quantiles are exact.
    """
    sketches = frame.agg(*[F.kll_sketch_agg_double(F.col("z")[j], F.lit(_SKETCH_K)).alias(f"k{j}") for j in range(p)])
    ranks = F.array(*[F.lit(i / bins) for i in range(1, bins + 1)])
    row = sketches.select(*[F.kll_sketch_get_quantile_double(f"k{j}", ranks).alias(f"k{j}") for j in range(p)]).first()
    return [np.unique(np.array(row[f"k{j}"], dtype=float)) for j in range(p)]


def _by_run(x: np.ndarray, m: np.ndarray, slots: int) -> np.ndarray:
    """(slots, runs) counts of the runs' members per slot."""
    order = np.argsort(x, kind="stable")
    held, starts = np.unique(x[order], return_index=True)
    out = np.zeros((slots, m.shape[1]))
    out[held] = np.add.reduceat(m[order], starts, axis=0, dtype=np.int32)
    return out


def run_quantiles(frame: DataFrame, runs: int, p: int, probs: list[float], bins: int = BINS) -> np.ndarray:
    """probs x runs x columns: interpolated quantiles of every run's members.

    All runs count in the column's bins, p x bins x runs figures a task however many values there are. A quantile is the upper end of
    its bin, whose share of the rows bounds the error in rank: below 1 % with 256 bins, none where a value is a bin of its own.
    """
    ends = value_bins(frame, p, bins)

    few = [j for j in range(p) if len(ends[j]) <= _FEW_BINS]
    first = np.cumsum([0, *(len(ends[j]) for j in few)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, small = [np.zeros((len(e), runs)) for e in ends], np.zeros((int(first[-1]), runs))
        for b in batches:
            if b.num_rows:
                x, m = C._z(b), _members(b, runs)
                at = [np.minimum(np.searchsorted(e, x[:, j]), len(e) - 1) for j, e in enumerate(ends)]
                for i in range(0, len(x) if few else 0, _ROWS):
                    # a step's counts stay far below 2^24, so single precision is exact
                    w = m[i:i + _ROWS].astype(np.float32)
                    hot = np.zeros((len(w), len(small)), dtype=np.float32)
                    for lo, j in zip(first, few):
                        hot[np.arange(len(w)), lo + at[j][i:i + _ROWS]] = 1.0
                    small += hot.T @ w
                m = m.astype(np.int32)
                for j, e in enumerate(ends):
                    if len(e) > _FEW_BINS:
                        acc[j] += _by_run(at[j], m, len(e))
        for lo, j in zip(first, few):
            acc[j] = small[lo:lo + len(ends[j])]
        yield from batches_of([(j,) for j in range(p)], [0] * p, [a.ravel() for a in acc], ["item"], [pa.int32()])

    out = np.zeros((len(probs), runs, p))
    counts = collected(frame.select("z", "runs").mapInArrow(count, "item int, n bigint, s array<double>"), ["item"])
    for j, (_, v) in counts.items():
        upto = np.cumsum(v.reshape(len(ends[j]), runs), axis=0)
        last = upto[-1] - 1
        for i, q in enumerate(probs):
            low = np.floor(last * q)
            at = [ends[j][np.minimum((upto <= rank[None, :]).sum(axis=0), len(ends[j]) - 1)] for rank in (low, np.minimum(low + 1, last))]
            out[i, :, j] = at[0] + (last * q - low) * (at[1] - at[0])
    return out


def _run_scales(frame: DataFrame, runs: int, p: int, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Centre and spread per run and column: median and quartile range, or mean and standard deviation."""
    if method == "robust":
        low, centre, high = run_quantiles(frame, runs, p, [0.25, 0.5, 0.75])
        scale = high - low
    else:
        n, sums = _run_sums(frame, range(runs), runs, values=lambda x: np.column_stack([x, x ** 2]))
        mean = sums[:, 0] / n[:, 0, None]
        centre = mean[:, :p]
        scale = np.sqrt(np.clip(mean[:, p:] - centre ** 2, 0.0, None))
    return centre, np.where(scale < 1e-10, 1.0, scale)


def _slot_sums(v: np.ndarray, m: np.ndarray, cell: np.ndarray | None, label: np.ndarray | None, out: np.ndarray) -> None:
    """Adds the rows (count first in ``v``) of every run to out[cell, label, run]: one product of members with rows a cell and step, no row copied per run."""
    order, ends = (slice(None), [len(v)]) if cell is None else (np.argsort(cell, kind="stable"), None)
    v, m, label = v[order], m[order], None if label is None else label[order]
    if ends is None:
        cell = cell[order]
        ends = [*(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
    start = 0
    for end in ends:
        at = 0 if cell is None else int(cell[start])
        for i in range(start, end, _ROWS):
            rows = slice(i, min(i + _ROWS, end))
            for k in range(out.shape[1]):
                w = m[rows] if label is None else m[rows] & (label[rows] == k)
                out[at, k] += w.T.astype(float) @ v[rows]
        start = end


def _run_sums(frame: DataFrame, which, runs: int, cells: int = 1, k: int = 1, cell_of=None, label_of=None, values=lambda x: x) -> tuple[np.ndarray, np.ndarray]:
    """Counts (runs x slots) and vector sums (runs x slots x width) over the members of the runs ``which`` of all ``runs``; slot = cell * k + label.

    ``cell_of`` gives a row's cell, the same in all runs, ``label_of`` its label in each of ``which``. A task emits a row a run.
    """
    which = list(which)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            if b.num_rows:
                x, m = C._z(b), _members(b, runs)
                m = m if len(which) == runs else m[:, which]
                v = np.column_stack([np.ones(len(x)), values(x)])
                out = np.zeros((cells, k, len(which), v.shape[1])) if out is None else out
                _slot_sums(v, m, cell_of(x) if cell_of else None, label_of(x) if label_of else None, out)
        if out is not None:
            yield from batches_of([(r,) for r in which], [0] * len(which), [out[:, :, i].ravel() for i in range(len(which))], ["grp"], [pa.int32()])

    got = C.collect_sums(frame.select("z", "runs").mapInArrow(reduce, C._SUMS))
    both = np.array([got[r][1] for r in which]).reshape(len(which), cells * k, -1)
    return both[:, :, 0], both[:, :, 1:]


def run_silhouettes(frame: DataFrame, runs: int, k: int, centre: np.ndarray, scale: np.ndarray, label_of, cell_of, cells: int) -> np.ndarray:
    """Silhouette of every run from one pass: counts, sums and sums of squares of its cells and labels, in the run's own scale.

    The raw sums of values and of squares of a cell give its moments in any run's scale, so a row is summed as it is.
    """
    p = centre.shape[1]
    n, sums = _run_sums(frame, range(runs), runs, cells, k, cell_of, label_of, lambda x: np.column_stack([x, x ** 2]))
    out = []
    for r in range(runs):
        held = np.flatnonzero(n[r])
        size, raw, square = n[r, held, None], sums[r, held, :p], sums[r, held, p:]
        s = (raw - size * centre[r]) / scale[r]
        q = ((square - 2.0 * centre[r] * raw + size * centre[r] ** 2) / scale[r] ** 2).sum(axis=1)
        out.append(C.silhouette_of_cells(held % k, size[:, 0], s, q) if len(held) else None)
    return np.array([np.nan if v is None else v for v in out])


def stability_resample(raw: DataFrame, labelled: DataFrame, k: int, method: str = "robust", runs: int = 120, ratio: float = 0.7,
                       id_col: str = "respondent_id", cells: int = 64, steps: int = C.LLOYD_STEPS):
    """Re-scale and re-cluster ``runs`` resamples; returns (run rows with consistency and silhouette, person rows).

    ``raw`` is (id, z) unscaled and imputed; ``labelled`` is (id, cluster), the labels to reproduce.
    """
    spark = raw.sparkSession
    frame = C.spread(raw.join(labelled.select(id_col, F.col("cluster").cast("int").alias("ref")), id_col).select(
        F.col(id_col).cast("bigint").alias("id"), "z", "ref"), "id")
    p = C._width(frame)
    cuts = resample_cuts(frame, runs, ratio, id_col="id")
    frame = with_members(frame, cuts)
    centre, scale = _run_scales(frame, runs, p, method)
    mean, axes, marks = C._direction_bits(frame, p, int(np.log2(cells)))
    n, sums = _run_sums(frame, range(runs), runs, cells, cell_of=lambda x: C._cells(x, mean, axes, marks))
    start = []
    for r in range(runs):
        have = np.flatnonzero(n[r])
        pts = (sums[r, have] / n[r, have, None] - centre[r]) / scale[r]
        start.append(C.ward_centres(pts, n[r, have], {k})[k])
    centres = np.array(start)  # runs x k x p, in each run's own scale

    def nearest(cen, which=slice(None)):
        # |z - m|^2 up to a constant, as one product of raw rows with all runs' centres.
        a = (cen / scale[which][:, None, :]).reshape(len(cen) * k, p)
        b = 0.5 * (cen ** 2).sum(axis=2) + (cen * (centre / scale)[which][:, None, :]).sum(axis=2)
        return lambda x: np.argmin(b[None, :, :] - (x @ a.T).reshape(len(x), len(cen), k), axis=2)

    active = np.arange(runs)  # a run whose centres rest takes no part in the passes that follow
    for _ in range(steps):
        old = centres[active]
        n, sums = _run_sums(frame, active.tolist(), runs, 1, k, label_of=nearest(old, active))
        moved = (sums / np.maximum(n, 1)[:, :, None] - centre[active][:, None, :]) / scale[active][:, None, :]
        new = np.where(n[:, :, None] > 0, moved, old)
        centres[active] = new
        active = active[np.abs(new - old).max(axis=(1, 2)) > 1e-12]
        if not len(active):
            break
    label_of = nearest(centres)
    sil = run_silhouettes(frame, runs, k, centre, scale, label_of, lambda x: C._cells(x, mean, axes, marks), cells)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                m, g = _members(b, runs), label_of(C._z(b))
                ref = b.column(b.schema.get_field_index("ref")).to_numpy(zero_copy_only=False)
                for y in range(k):
                    mine = m & (g == y)
                    for x in np.unique(ref).tolist():
                        total[(x, y + 1)] = total.get((x, y + 1), 0) + mine[ref == x].sum(axis=0)
        acc = {(r, x, y): c for (x, y), v in total.items() for r, c in enumerate(v.tolist()) if c}
        keys = list(acc)
        yield pa.RecordBatch.from_arrays([pa.array([cuts[q[0]][0] for q in keys], pa.int32()), pa.array([q[1] for q in keys], pa.int32()),
                                          pa.array([q[2] for q in keys], pa.int32()), pa.array(list(acc.values()), pa.int64())],
                                         schema=pa.schema([("run_id", pa.int32()), ("ref_label", pa.int32()), ("new_label", pa.int32()), ("n", pa.int64())]))

    walk = frame.select("z", "ref", "runs").mapInArrow(cross, "run_id int, ref_label int, new_label int, n bigint") \
        .groupBy("run_id", "ref_label", "new_label").agg(F.sum("n").alias("n"))
    aligned = C.cut(C.align_labels(walk, ["run_id"]))
    sizes = walk.groupBy("run_id").agg(F.sum("n").alias("sample_n"))
    scores = spark.createDataFrame([(run, None if np.isnan(v) else float(v)) for (run, _, _), v in zip(cuts, sil)], "run_id int, silhouette double")
    run_rows = aligned.groupBy("run_id").agg(F.first("agreement").alias("consistency_rate")).join(sizes, "run_id").join(scores, "run_id")

    table = np.zeros((runs, k), dtype=np.int64)
    at = {run: i for i, (run, _, _) in enumerate(cuts)}
    for r in aligned.collect():  # runs x k rows
        table[at[r["run_id"]], r["new_label"] - 1] = r["aligned_label"]

    def persons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = _ids(b)
                m, g = _members(b, runs), label_of(C._z(b))
                ref = b.column(b.schema.get_field_index("ref")).to_numpy(zero_copy_only=False)
                hit = (table[np.arange(runs)[None, :], g] == ref[:, None]) & m
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(m.sum(axis=1).astype(np.int32)), pa.array(hit.sum(axis=1).astype(np.int32))],
                                                 names=["id", "included_runs", "hits"])

    rows = frame.select("id", "z", "ref", "runs").mapInArrow(persons, "id bigint, included_runs int, hits int").filter("included_runs > 0")
    person_rows = rows.select(F.col("id").alias(id_col), "included_runs", (F.col("hits") / F.col("included_runs")).alias("consistency_rate"))
    return run_rows, person_rows


def stability_summary(run_rows: DataFrame) -> DataFrame:
    """(metric, value): mean, P10, P50 and minimum of the runs' consistency."""
    c = F.col("consistency_rate")
    row = run_rows.agg(F.count(F.lit(1)).cast("double").alias("resample_runs"), F.avg(c).alias("consistency_mean"), F.percentile(c, 0.1).alias("consistency_p10"),
                       F.percentile(c, 0.5).alias("consistency_p50"), F.min(c).alias("consistency_min"))
    return row.unpivot([], row.columns, "metric", "value")
