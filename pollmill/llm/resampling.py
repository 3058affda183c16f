"""Resampling by importance towards a target: hashed features, their gains, and a Gumbel draw of the highest scores.

Features are runs of consecutive words. Their CRC-32 is computed by length-bucketed matrices: the distinct features of a
step of texts are grouped by byte length into two-dimensional uint8 arrays, all rows of an array advance by one column at a
time through the 256-entry table, and the results are scattered back to the features. A feature's bucket is its CRC modulo
`buckets`; counts per bucket of the documents and of the target (at most `buckets` rows a task) give the bucket's gain,
1000 * ln of the ratio of smoothed frequencies, floored. A document's weight is the sum of the gains of its features, its
score adds a Gumbel value from a hash of its id, and the highest scores are drawn, which samples without repeats in
proportion to exp(weight / 1000). Ranks come from sorted ranges and their offsets, so no task holds all rows.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Null and empty texts have no features and weight 0, and
are never drawn as long as `least_words` is 1 or more. A null id is hashed as "null" and comes after the others in a tie; rows
that share an id share their Gumbel value; repeated rows are ranked one after the other. Empty documents give an empty result;
an empty target leaves the gains to the documents' own frequencies. A long text is a step of its own. Columns of docs named
like the result stay: the result's name gets underscores.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pollmill.operators.prefix import row_numbers

from .common import fresh, over_texts, plain_words, sized, stored, struct

_POLYNOMIAL = 0xEDB88320


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(_POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_TABLE = _table()


def crc32_of(features: list[bytes]) -> np.ndarray:
    """Unsigned CRC-32 of each, by matrices of equal length."""
    out = np.zeros(len(features), np.uint32)
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(sizes, kind="stable")
    ends = np.flatnonzero(np.diff(np.r_[sizes[order], -1]))
    start = 0
    for end in ends + 1:
        rows = order[start:end]
        width = int(sizes[rows[0]])
        matrix = np.frombuffer(b"".join([features[i] for i in rows]), np.uint8).reshape(len(rows), width)
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in np.ascontiguousarray(matrix.T):
            crc = _TABLE[(crc ^ column) & 0xFF] ^ crc >> 8
        out[rows] = ~crc
        start = end
    return out


def featured(texts: list[bytes | None], buckets: int, longest: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words a text, features a text, the buckets of all features in order)."""
    number = defaultdict(count().__next__)
    n_words, parts = [], []
    for t in texts:
        w = plain_words(t)
        n_words.append(len(w))
        runs = w if longest == 1 else [b" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
        parts.append(np.fromiter(map(number.__getitem__, runs), np.int64, len(runs)))
    of = (crc32_of(list(number)) % np.uint32(buckets)).astype(np.int64)
    return np.array(n_words, np.int64), np.array([len(p) for p in parts], np.int64), of[np.concatenate(parts)] if parts else of


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """(bucket, n): features of all texts; a task emits a row per bucket that it met."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for lo, hi in sized(b.column(0)):
                total += np.bincount(featured(b.column(0).slice(lo, hi - lo).to_pylist(), buckets, longest)[2], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    tasks = docs.select(F.col(f"`{text}`").cast("string").cast("binary").alias("t")).mapInArrow(run, "bucket long, n long")
    return tasks.groupBy("bucket").agg(F.sum("n").alias("n"))


def _known(counts: DataFrame, buckets: int) -> list[int]:
    """One number a bucket: the driver holds `buckets` of them, whatever the corpus."""
    out = [0] * buckets
    for b, n in counts.collect():
        out[b] = n
    return out


def gains(own: list[int], target: list[int]) -> list[int]:
    """floor(1000 * ln(((t + 1) (S + B)) / ((s + 1) (T + B)))) of each of B buckets, in doubles."""
    b = len(own)
    all_own, all_target = float(sum(own) + b), float(sum(target) + b)
    return [math.floor(1000 * math.log((float(t + 1) * all_own) / (float(s + 1) * all_target))) for s, t in zip(own, target, strict=True)]


def gumbel(key: str, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256 of "seed:id"."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", key: str = "doc_id", buckets: int = 10_000, longest: int = 1,
             least_words: int = 20, percent: int = 10, seed: int = 2024, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """(docs' columns `keep` and a struct: n_words, n_features, weight, score, rank (null: not drawn); its name).

    Of N documents with at least `least_words` words, floor(percent * N / 100) are drawn.
    """
    out = fresh(docs, "resampled")
    keep = docs.columns if keep is None else keep
    gain = np.array(gains(_known(bucket_counts(docs, text, buckets, longest), buckets), _known(bucket_counts(target, target_text, buckets, longest), buckets)), np.int64)

    def work(texts):
        n_words, sizes, at = featured(texts, buckets, longest)
        sums, ends = np.r_[0, np.cumsum(gain[at])], np.cumsum(sizes)
        return [n_words, sizes, sums[ends] - sums[ends - sizes]]

    weighed = over_texts(docs, text, out, struct("n_words bigint, n_features bigint, weight bigint"), work, list(dict.fromkeys([*keep, key])))
    field = lambda n: F.col(f"`{out}`.{n}")
    row = fresh(weighed, "row")
    rows = stored(weighed.withColumn(out, F.struct(f"`{out}`.*", (field("weight") + gumbel(key, seed)).alias("score"))).withColumn(row, F.monotonically_increasing_id()), "resample")
    able = field("n_words") >= least_words
    drawn = rows.where(able).count() * percent // 100
    place = fresh(rows, "place")
    ranked = row_numbers(rows, [able.desc(), field("score").desc(), F.col(f"`{key}`").asc_nulls_last(), F.col(f"`{row}`").asc()], place)
    rank = F.when(able & (F.col(f"`{place}`") <= drawn), F.col(f"`{place}`"))
    return ranked.select(*(F.col(f"`{c}`") for c in keep), F.struct(*(field(n).alias(n) for n in ("n_words", "n_features", "weight", "score")), rank.alias("rank")).alias(out)), out


def sample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs, all columns as they are."""
    rows, out = resample(docs, target, **options)
    return rows.where(F.col(f"`{out}`.rank").isNotNull()).select(*(F.col(f"`{c}`") for c in docs.columns))
