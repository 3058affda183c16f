"""Element-wise sums of array rows that tasks emit, in two levels.

A task reduces its rows to one array per key. The arrays are added inside a few groups of tasks first and then once per key,
as arrays: nothing is ever turned into a row per number, and no task meets the arrays of all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Groups of tasks whose arrays are added before all are.
GROUPS = 64
#: Numbers in one emitted batch.
_BATCH = 1 << 20

KINDS = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.StringType(): pa.string()}


def batches_of(keys: list[tuple], n: list[int], arrays: list[np.ndarray], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows (key columns, n, s), cut where a batch would get too large."""
    schema = pa.schema([*zip(names, kinds), ("n", pa.int64()), ("s", pa.list_(pa.float64()))])
    start = 0
    while start < len(keys):
        end, size = start, 0
        while end < len(keys) and (end == start or size + len(arrays[end]) <= _BATCH):
            size += len(arrays[end])
            end += 1
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays[start:end]])]).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays[start:end]).astype(float, copy=False)))
        yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in keys[start:end]], t) for i, t in enumerate(kinds)], pa.array(n[start:end], pa.int64()), values], schema=schema)
        start = end


def _adder(names: list[str], kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple, int] = {}
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            s = b.column(b.num_columns - 1)
            at, flat = s.offsets.to_numpy(), s.values.to_numpy()
            keys = list(zip(*[b.column(i).to_pylist() for i in range(len(names))])) if names else [()] * b.num_rows
            for key, n, lo, hi in zip(keys, b.column(len(names)).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                if key in total:
                    count[key] += n
                    total[key] += flat[lo:hi]
                else:
                    count[key], total[key] = n, flat[lo:hi].copy()
        yield from batches_of(list(total), list(count.values()), list(total.values()), names, kinds)

    return run


def add_up(part: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, s): the sums over all tasks' rows (keys: int, bigint or string; n bigint; s array<double>) of each key."""
    keys = list(keys)
    rows = part.select(*keys, "n", "s")
    schema = rows.schema
    add = _adder(keys, [KINDS[schema[k].dataType] for k in keys])
    group = F.pmod(F.spark_partition_id(), F.lit(GROUPS))
    first = rows.withColumn("_g", group).repartition(*keys, "_g").drop("_g").mapInArrow(add, schema)
    # without keys a constant brings the groups' sums together
    return first.repartition(*(keys or [F.lit(0)])).mapInArrow(add, schema)


def collected(part: DataFrame, keys: list[str]) -> dict:
    """{key or key tuple: (n, array)} on the driver: as many arrays as there are keys."""
    out = {}
    for b in add_up(part, keys).toArrow().to_batches():
        s = b.column(b.num_columns - 1)
        at, flat = s.offsets.to_numpy(), s.values.to_numpy()
        cols = [b.column(i).to_pylist() for i in range(len(keys))]
        for i, n in enumerate(b.column(len(keys)).to_pylist()):
            out[cols[0][i] if len(cols) == 1 else tuple(c[i] for c in cols)] = (n, flat[at[i]:at[i + 1]].copy())
    return out
