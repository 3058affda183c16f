"""Filter interaction audit: what each filter removes in every order of application, alone, and by Shapley value.

A table-driven byte transducer reads each text once. A byte's class and the state before it (between words, in a word) select
from two 256- and 12-entry tables what the byte emits: a word starts, a word ends, a capital, a code point, a symbol. The state
after a byte depends on its class alone, so a step of texts is one lookup of all its bytes, not a loop. The word spans go
into an open-addressing hash table per step, keyed by document and word; an entry counts as the same word only after its bytes
were compared, so distinct words are exact whatever the hash does.

Bits of failed filters, source and label outcomes are then counted: a row per (text, source, id), per (text, source, outcome), at
last per (source, bits, outcome). Copies of a text are found by its SHA-256: a copy fails `repeated` unless its id is the smallest of
that text, which counts of rows at the smallest id decide without joining rows to their text, so a text that a third of all rows
share is a row per source and outcome. All orders of n filters follow from 2 ** n sums per source: kept after a set of filters are the
documents whose bits miss that set.

Words are `[^\\x20\\x09-\\x0D]+`, case-sensitive; code points are bytes that don't continue a character. Null texts count as empty:
no words, equal to each other. A null id never fails `repeated` and makes no other row fail; rows that share id and text
don't make each other fail. Several labels of an id: any that says so counts. A null source is the part "". Empty documents
give an empty audit. Columns of docs named like the result stay: the result's name gets underscores. A text is a step of its own if it
is longer than one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, over_texts, stored, struct

BLANK, CAPITAL, SYMBOL, ASCII, LEAD, CONTINUES = range(6)
START, END, IS_CAPITAL, POINT, IS_SYMBOL = 1, 2, 4, 8, 16
SYMBOLS = b"#$%&*|"


def _class(x: int) -> int:
    if x == 0x20 or 0x09 <= x <= 0x0D:
        return BLANK
    if 0x41 <= x <= 0x5A:
        return CAPITAL
    if x in SYMBOLS:
        return SYMBOL
    return ASCII if x < 0x80 else CONTINUES if x < 0xC0 else LEAD


CLASS = np.array([_class(x) for x in range(256)], np.uint8)
#: State after a class: 0 between words, 1 in a word.
NEXT = np.array([0, 1, 1, 1, 1, 1], np.uint8)
_SELF = np.array([POINT, POINT | IS_CAPITAL, POINT | IS_SYMBOL, POINT, POINT, 0], np.uint8)
#: What a class emits when met between words, then in a word.
EMIT = np.concatenate([_SELF | np.where(NEXT == 1, START, 0), _SELF | np.where(NEXT == 0, END, 0)]).astype(np.uint8)

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Spans:
    """Byte spans of one array and their comparison, eight bytes at a time."""

    def __init__(self, data: bytes, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.sizes = starts, ends - starts
        self.eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the array ends in eight bytes that no span holds

    def lane(self, which: np.ndarray, at: int) -> np.ndarray:
        left = np.minimum(self.sizes[which] - at, 8)
        return self.eights[self.starts[which] + at] & _MASK[left]

    def hashes(self) -> np.ndarray:
        out = self.sizes.astype(np.uint64) * _MIX
        which, at = np.arange(len(out)), 0
        while len(which):
            h = (out[which] ^ self.lane(which, at)) * _MIX
            out[which] = h ^ h >> np.uint64(29)
            at += 8
            which = which[self.sizes[which] > at]
        return out

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which spans of a have the bytes of those of b."""
        same = self.sizes[a] == self.sizes[b]
        open_, at = np.flatnonzero(same), 0
        while len(open_):
            ok = self.lane(a[open_], at) == self.lane(b[open_], at)
            same[open_[~ok]] = False
            at += 8
            open_ = open_[ok]
            open_ = open_[self.sizes[a[open_]] > at]
        return same


def distinct_mask(spans: Spans, doc: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """Which spans are the ones that stand for their word in their document: one for each distinct word of each document."""
    n = len(doc)
    first = np.zeros(n, bool)
    if not n:
        return first
    bits = max(4, (2 * n - 1).bit_length())
    h = spans.hashes() if hashes is None else hashes
    slot = ((h + doc.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) * _MIX >> np.uint64(64 - bits)).astype(np.int64)
    entries = np.full(1 << bits, -1, np.int64)
    waiting = np.arange(n)
    while len(waiting):
        at = slot[waiting]
        free = entries[at] < 0
        entries[at[free]] = waiting[free]  # of several that want one place, one gets it
        holder = entries[at]
        own = holder == waiting
        first[waiting[own]] = True
        same = own | (doc[holder] == doc[waiting])
        check = np.flatnonzero(same & ~own)
        same[check] = spans.equal(holder[check], waiting[check])
        waiting, at = waiting[~same], at[~same]
        slot[waiting] = (at + 1) & (len(entries) - 1)
    return first


def transduce(texts: list[bytes | None]) -> list[np.ndarray]:
    """n_words, n_distinct, n_capitals, n_points, n_symbols of each text."""
    sizes = np.array([len(t or b"") for t in texts], np.int64)
    begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    data = b" ".join(t or b"" for t in texts) + b" " + bytes(8)  # a blank ends each text and its last word
    kinds = CLASS[np.frombuffer(data, np.uint8, len(data) - 8)]
    emitted = EMIT[np.r_[np.uint8(0), NEXT[kinds[:-1]]] * np.uint8(6) + kinds]
    total = lambda bit: np.add.reduceat((emitted & bit) != 0, begin, dtype=np.int64)
    starts, ends = np.flatnonzero(emitted & START), np.flatnonzero(emitted & END)
    doc = np.searchsorted(begin, starts, "right") - 1
    distinct = np.bincount(doc[distinct_mask(Spans(data, starts, ends), doc)], minlength=len(texts))
    return [np.bincount(doc, minlength=len(texts)), distinct, total(IS_CAPITAL), total(POINT) - 1, total(IS_SYMBOL)]


@dataclass(frozen=True)
class Filter:
    """A letter and a SQL condition on the measurements that is true where a document fails; None: its text repeats one of a smaller id."""
    letter: str
    fails: str | None


FILTERS = (
    Filter("A", "n_words < 50"),
    Filter("B", "100 * n_distinct < 65 * n_words"),
    Filter("C", "100 * n_capitals > 5 * n_points"),
    Filter("D", "n_symbols > 0"),
    Filter("E", None),
)
_FIELDS = "n_words n_distinct n_capitals n_points n_symbols".split()


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """(docs' columns `keep` and a struct: n_words, n_distinct, n_capitals, n_points, n_symbols, digest (SHA-256); its name)."""
    out = fresh(docs, "measured")

    def work(texts):
        return [*transduce(texts), pa.array([hashlib.sha256(t or b"").digest() for t in texts], pa.binary())]

    return over_texts(docs, text, out, struct(", ".join(f"{f} bigint" for f in _FIELDS) + ", digest binary"), work, keep), out


def _bits(out: str, filters: Sequence[Filter]) -> Column:
    bits = F.lit(0)
    for i, f in enumerate(filters):
        if f.fails is not None:
            bits = bits + F.when(F.expr(re.sub(r"\bn_\w+", lambda m: f"`{out}`.{m[0]}", f.fails)), 1 << i).otherwise(0)
    return bits


def failures(docs: DataFrame, labels: DataFrame, filters: Sequence[Filter] = FILTERS, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(part, bits, good, toxic, n): documents of each pattern of failed filters and label outcome; bit i is filter i.

    labels: (doc_id, quality, toxic); without a label neither good nor toxic.
    """
    seen, out = measure(docs, text, list(dict.fromkeys([key, source])))
    rows = seen.select(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{key}`").alias("id"), F.col(f"`{out}`.digest").alias("digest"),
                       _bits(out, filters).cast("int").alias("bits"))
    # a text has one pattern but for copies; rows with the same id and text become one
    rows = rows.groupBy("digest", "bits", "part", "id").agg(F.count("*").alias("n"))
    outcomes = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"), F.lit(0).alias("salt")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # null ids match no label: they are dealt by their text
    salted = rows.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.crc32("digest"), F.lit(1 << 20))).otherwise(0).cast("int"))
    no = F.lit(False)
    known = salted.join(outcomes, ["id", "salt"], "left").withColumns({c: F.coalesce(F.col(c), no) for c in ("good", "toxic")})
    at_least = known.groupBy("digest", "bits", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.min("id").alias("least"), F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("n_least"))
    least = stored(at_least, "audit")
    by_text = least.groupBy("digest").agg(F.min("least").alias("first_id"))
    passed = F.col("n_null") + F.when(F.col("least") == F.col("first_id"), F.col("n_least")).otherwise(0)
    counted = least.join(by_text, "digest").groupBy("part", "bits", "good", "toxic").agg(F.sum(passed).alias("first"), F.sum(F.col("n") - passed).alias("copies"))
    again = sum(1 << i for i, f in enumerate(filters) if f.fails is None)
    both = counted.select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("bits"), F.col("first").alias("n")),
                                                                    F.struct(F.col("bits").bitwiseOR(F.lit(again)).alias("bits"), F.col("copies").alias("n")))))
    return both.groupBy("part", "bits", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(counts: DataFrame, filters: Sequence[Filter] = FILTERS) -> DataFrame:
    """A row per part, order of the filters and step from the counts of `failures`.

    kept, removed, redundant (fails this filter, removed earlier), unique_fails (fails this filter only), good_lost, toxic_lost, and shapley:
    what this filter removes, summed over all orders.
    """
    sets, everyone = range(1 << len(filters)), math.factorial(len(filters))
    bits, n = F.col("bits"), F.col("n")

    def sums(which: Column) -> Column:
        """Element s: documents that fail no filter of set s."""
        return F.array(*(F.coalesce(F.sum(F.when(which & (bits.bitwiseAND(F.lit(s)) == 0), n)), F.lit(0)) for s in sets))

    # of the orders, 1 in m has this filter first of the m that a document fails
    shares = F.array(*(F.coalesce(F.sum(F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, n * F.expr(f"{everyone} div bit_count(bits)"))), F.lit(0)) for i in range(len(filters))))
    per_part = counts.groupBy("part").agg(sums(F.lit(True)).alias("kept_of"), sums(F.col("good")).alias("good_of"), sums(F.col("toxic")).alias("toxic_of"), shares.alias("shares"))
    plan = []
    for order in permutations(range(len(filters))):
        before = 0
        for step, i in enumerate(order, 1):
            plan.append(f"named_struct('filter_order', '{''.join(filters[j].letter for j in order)}', 'step', {step}, 'i', {i}, 'had', {before})")
            before |= 1 << i
    # a fixed number of rows a part, which is the result's own size
    steps = per_part.select("*", F.inline(F.expr(f"array({', '.join(plan)})")))
    own = F.expr("shiftleft(1, i)")
    after = F.col("had").bitwiseOR(own)
    lost = lambda of: F.get(of, F.col("had")) - F.get(of, after)
    all_bits = F.lit((1 << len(filters)) - 1)
    rest = all_bits.bitwiseXOR(own)
    removed = lost("kept_of")
    fails = F.get("kept_of", F.lit(0)) - F.get("kept_of", own)
    return steps.select("part", "filter_order", "step", F.get("kept_of", after).alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"),
                        (F.get("kept_of", rest) - F.get("kept_of", all_bits)).alias("unique_fails"), lost("good_of").alias("good_lost"), lost("toxic_of").alias("toxic_lost"),
                        F.get("shares", F.col("i")).alias("shapley"))
