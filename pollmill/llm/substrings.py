"""Substring dedup by level-wise doubling: only windows that repeat at one length are extended to twice that length.

A window of `window` words is followed from a short length to its own (18 -> 35 by default; `start` = 9 makes it 9, 18, 35). At a
shorter length a window stands for itself by the smallest hash of the runs of that length inside it, so equal windows always
choose the same run and only about 2 of `window - length + 2` runs are counted. A run that repeats nowhere drops every
window that it stands for. At the full length each window left is counted; windows that start twice or more are removed.

Counting: a task counts its own step of texts first; what repeats there is settled at once and goes on as one row per step,
whatever the size of a group of copies. Rows then meet by hash. Survivors go back to their documents as lists of places.
A word's hash is XXH3 of 128 bits, and each half makes a polynomial modulo 2 ** 64 of its own. A shorter run is told apart by the
first half alone, as a chance match there only keeps a candidate; a window of the full length by both halves, 128 bits.
Texts travel compressed to where the survivors are.

Nulls and texts of fewer words than a window keep all words. Repeated rows are occurrences of their own, so all their windows
repeat; they share a key, whose places are held once. Rows that share an id, or have none, are told apart by a 64-bit hash of id
and text. An empty table gives an empty result. Columns of docs named like the result stay: the result's name gets underscores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import fresh, sized, stored, struct, to_arrow, words

#: The odd base of each half's polynomial.
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_KEPT = struct("n_words bigint, n_removed bigint, kept string, span_start bigint[], span_end bigint[]")
_ROWS = ["h", "key", "place", "kind"]
#: A row that waits for its count, one that stands for several of a step, and one whose window is known to repeat.
ONE, MANY, KNOWN = 0, 1, 2


def lengths(window: int, start: int) -> list[int]:
    """start-ish lengths, each at most twice the one before, up to window."""
    out = [window]
    while out[0] > start:
        out.insert(0, -(-out[0] // 2))
    return out


class _Hashes(dict):
    def __missing__(self, w):
        h = self[w] = xxhash.xxh3_128_digest(w)
        return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Step:
    """The words of a step of texts, their documents, and hashes of runs."""

    def __init__(self, texts: list[bytes | None]):
        split = [words(t) for t in texts]
        self.sizes = np.array([len(s) for s in split], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.n = int(self.sizes.sum())
        get = _Hashes().__getitem__
        self.halves = np.frombuffer(b"".join([b"".join(map(get, s)) for s in split]), "<u8").reshape(-1, 2)
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _sums(self, half: int) -> tuple[np.ndarray, np.ndarray]:
        if half not in self.made:
            sums = np.cumsum(self.halves[:, half] * _powers(_BASES[half], self.n)[: self.n], dtype=np.uint64)
            self.made[half] = np.r_[np.zeros(1, np.uint64), sums], _powers(pow(_BASES[half], -1, 1 << 64), self.n)
        return self.made[half]

    def runs(self, length: int, half: int = 0) -> np.ndarray:
        """A half's hash of the run of `length` words at each place; runs across documents have one as well."""
        n = max(0, self.n - length + 1)
        sums, back = self._sums(half)
        x = (sums[length:length + n] - sums[:n]) * back[:n]
        for mul in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(mul)
        return x ^ (x >> np.uint64(33))

    def windows(self, window: int) -> np.ndarray:
        """Places where a window starts."""
        n = max(0, self.n - window + 1)
        return np.flatnonzero(self.doc[:n] == self.doc[self.n - n:])

    def stands(self, length: int, window: int) -> np.ndarray:
        """For each place the place of the smallest run of `length` words in the window that starts there, leftmost of equals."""
        h = self.runs(length)
        at = np.arange(len(h))
        reach = 1
        while reach < (most := window - length + 1):
            step = min(reach, most - reach)
            a, b = at[:-step], at[step:]
            at = np.where(h[a] <= h[b], a, b)
            reach += step
        return at


def _classes(h: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs (h, more): the first place of each class, the class of each place, and the sizes."""
    order = np.lexsort((more, h))
    a, b = h[order], more[order]
    new = np.ones(len(h), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which, np.bincount(which, minlength=int(new.sum()))


def _wide(h: np.ndarray, more: np.ndarray) -> pa.Array:
    """Pairs as 16 bytes each."""
    pairs = np.column_stack([h, more]).astype("<u8")
    return pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(np.arange(0, 16 * len(h) + 1, 16, dtype=np.int32)), pa.py_buffer(pairs.tobytes())])


def level_rows(texts: list, keys: np.ndarray, survivors: list | None, level: int, steps: list[int]) -> list[pa.Array]:
    """The rows of a step at a level: h (a long, or 16 bytes at the full length), key, place, kind."""
    s, window = Step(texts), steps[-1]
    full = steps[level] == window
    at = s.windows(window)
    if survivors is not None:
        alive = np.zeros(s.n, bool)
        for first, places in zip(s.first, survivors):
            alive[first + np.asarray(places, np.int64)] = True
        at = at[alive[s.stands(steps[level - 1], window)[at]]]
    if not full:
        at = s.stands(steps[level], window)[at]
        at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at  # they never go back
    h = s.runs(steps[level])[at]
    more = s.runs(window, 1)[at] if full else np.zeros(len(h), np.uint64)
    place, key = at - s.first[s.doc[at]], keys[s.doc[at]]
    first, which, count = _classes(h, more)
    many = count > 1
    known = many[which]
    # repeated rows share a key: each of its places goes on once
    again = np.flatnonzero(known)
    again = again[np.lexsort((place[again], key[again]))]
    drop = again[1:][(key[again[1:]] == key[again[:-1]]) & (place[again[1:]] == place[again[:-1]])]
    left = np.ones(len(h), bool)
    left[drop] = False
    stand = first[many]
    kind = np.where(known[left], KNOWN, ONE).astype(np.int8)
    spread, others = h.copy(), more.copy()
    # known rows only pass, so they are dealt anywhere
    spread[known] ^= (key[known] * 31 + place[known]).view(np.uint64)
    others[known] = 0
    out_h, out_more = np.r_[spread[left], h[stand]], np.r_[others[left], more[stand]]
    return [_wide(out_h, out_more) if full else pa.array(out_h.view(np.int64)), pa.array(np.r_[key[left], key[stand]]),
            pa.array(np.r_[place[left], place[stand]].astype(np.int32)), pa.array(np.r_[kind, np.full(len(stand), MANY, np.int8)])]


def removed(n: int, places, window: int) -> np.ndarray:
    """Which of n words lie in windows at places."""
    step = np.zeros(n + 1, np.int64)
    at = np.unique(np.asarray(places, np.int64))
    np.add.at(step, at, 1)
    np.add.at(step, at + window, -1)
    return np.cumsum(step[:-1]) > 0


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs with a long that tells rows apart (but equal ones): the id where it is one of its own, else a hash of id and text."""
    name = fresh(docs, "row_key")
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    ident = F.col(f"`{key}`")
    if not isinstance(docs.schema[key].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return docs.withColumn(name, F.xxhash64(ident, body))
    again = stored(docs.groupBy(ident.alias(name)).count().where(F.col("count") > 1).select(name), "repeated-ids")
    twice = fresh(docs.withColumn(name, F.lit(0)), "repeated_id")
    joined = docs.join(again.select(F.col(name).alias(twice)), ident == F.col(twice), "left")
    return joined.withColumn(name, F.when(ident.isNull() | F.col(twice).isNotNull(), F.xxhash64(ident, body)).otherwise(ident.cast("long"))).drop(twice)


def _packed(docs: DataFrame, text: str, keep: list[str], z: str) -> DataFrame:
    """keep and the text, compressed by document."""
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(z, T.BinaryType())])

    def run(batches):
        press = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            for lo, hi in sized(b.column(len(keep))):
                part = b.slice(lo, hi - lo)
                packed = pa.array([press(t or b"") for t in part.column(len(keep)).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], packed], [*keep, z])

    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").cast("binary").alias(z)).mapInArrow(run, schema)


def _unpacked(column: pa.Array) -> list[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return [expand(z) if z else b"" for z in column.to_pylist()]


def _survivors(rows: DataFrame) -> DataFrame:
    """(key, places) of the rows whose window repeats anywhere; each place once, however many rows share the key."""
    total = F.sum(F.when(F.col("kind") == ONE, 1).when(F.col("kind") == MANY, 2).otherwise(0)).over(Window.partitionBy("h"))
    alive = rows.withColumn("n", total).where((F.col("kind") == KNOWN) | ((F.col("kind") == ONE) & (F.col("n") > 1)))
    return alive.groupBy("key").agg(F.collect_set("place").alias("places"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, start: int = 18, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """(docs' columns `keep` and a struct: n_words, n_removed, kept (words left, joined by one space), span_start and span_end of
    what went (words, end exclusive); its name)."""
    keep = docs.columns if keep is None else keep
    out, z = fresh(docs, "dedup"), fresh(docs, "packed_text")
    steps = lengths(window, start)
    keyed = _keyed(docs, key, text)
    row_key = keyed.columns[-1]
    alive_key, places = fresh(keyed, "alive_key"), fresh(keyed, "places")
    alive = None
    for level in range(len(steps)):
        h_kind = T.BinaryType() if steps[level] == window else T.LongType()
        row_schema = T.StructType([T.StructField(n, t) for n, t in zip(_ROWS, (h_kind, T.LongType(), T.IntegerType(), T.ByteType()))])
        if level == 0:
            source = keyed.select(F.col(row_key), F.col(f"`{text}`").cast("string").cast("binary"))
        else:
            source = _packed(keyed, text, [row_key], z).join(alive, F.col(row_key) == F.col(alive_key)).select(row_key, z, places)
        rows = source.mapInArrow(_level(level, steps), row_schema)
        alive = _survivors(rows).toDF(alive_key, places)
        if level < len(steps) - 1:
            alive = stored(alive, "survivors")
            if alive.isEmpty():
                break
    final = _packed(keyed, text, [*keep, row_key], z).join(alive, F.col(row_key) == F.col(alive_key), "left").select(*(F.col(f"`{c}`") for c in keep), z, places)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, _KEPT)])
    return final.mapInArrow(_cutter(window, len(keep), [*keep, out]), schema), out


def _level(level: int, steps: list[int]):
    def run(batches):
        for b in batches:
            for lo, hi in sized(b.column(1)) if level == 0 else sized(b.column(1), 2 << 20):
                part = b.slice(lo, hi - lo)
                texts = part.column(1).to_pylist() if level == 0 else _unpacked(part.column(1))
                places = part.column(2).to_pylist() if level else None
                yield pa.RecordBatch.from_arrays(level_rows(texts, np.asarray(part.column(0)), places, level, steps), _ROWS)

    return run


def _cutter(window: int, n_keep: int, names: list[str]):
    kinds = [to_arrow(f.dataType) for f in _KEPT.fields]

    def run(batches):
        for b in batches:
            for lo, hi in sized(b.column(n_keep), 2 << 20):
                part = b.slice(lo, hi - lo)
                rows = []
                for t, places in zip(_unpacked(part.column(n_keep)), part.column(n_keep + 1).to_pylist()):
                    w = words(t)
                    gone = removed(len(w), places or [], window)
                    edge = np.diff(np.r_[False, gone, False].astype(np.int8))
                    left = w if not places else [x for x, g in zip(w, gone.tolist()) if not g]
                    rows.append((len(w), int(gone.sum()), b" ".join(left).decode(), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
                made = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _KEPT.names)
                yield pa.RecordBatch.from_arrays([*part.columns[:n_keep], made], names)

    return run
