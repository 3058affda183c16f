"""Benchmark decontamination by an FM-index per training shard.

A shard is a step of documents of one Arrow batch (bounded bytes). Its words that the test phrases use form the alphabet; other
words end a stretch. Over the stretches stand a suffix array (prefix doubling), the Burrows-Wheeler transform in a wavelet
tree with rank counts, and sampled suffix positions. All phrases are searched backwards together, their occurrences are
located by walking to a sampled position, and the word spans found are merged per document.

The test items come as blocks of at most `block_bytes` of text, each block a broadcast with that bound and a pass over the
documents; with several blocks the documents are stored with a row number, and results are merged by that number alone. So
neither side has to fit in one task.

Windows: `size` consecutive item words; an item of fewer words is one window; an item without words has none.
Nulls and empty texts have no words and no hits (contaminated is false). Repeated rows get the same result each; items
that share an id are reported once, items with a null id as "null". Empty tables give an empty
result or no hits. Columns of docs named like the result stay: the result's name gets underscores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, over_texts, plain_words, stored, struct

_HITS = struct("n_words bigint, n_hit bigint, items string[], span_start bigint[], span_end bigint[]")


class Wavelet:
    """Symbols below 2 ** bits with ranks: one bit vector a level, counts of ones per block of 64."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, n = bits, [], len(symbols)
        for level in range(bits - 1, -1, -1):
            one = (symbols >> level & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            words = np.zeros(n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))]
            self.levels.append((words, before, n - int(before[-1])))
            symbols = np.concatenate([symbols[~one], symbols[one]])  # stable: zeros first

    @staticmethod
    def _ones(words, before, i):
        """Ones in front of place i."""
        rest = words[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return before[i >> 6] + np.bitwise_count(rest).astype(np.int64)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands in front of place i."""
        start = np.zeros_like(i)
        for k, (words, before, zeros) in enumerate(self.levels):
            one = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = self._ones(words, before, start), self._ones(words, before, i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def at(self, i: np.ndarray) -> np.ndarray:
        """The symbol at place i."""
        out = np.zeros_like(i)
        for words, before, zeros in self.levels:
            one = (words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            a = self._ones(words, before, i)
            out, i = out << 1 | one, np.where(one, zeros + a, i - a)
        return out


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes. ends marks the separators, each a smallest symbol of its own, so no comparison passes one."""
    n = len(text)
    order = np.where(ends, np.cumsum(ends), text + int(ends.sum()))
    bits = int(order.max()).bit_length()
    width = max(1, 62 // bits)
    padded = np.r_[order, np.zeros(width, np.int64)]
    key = np.zeros(n, np.int64)
    for i in range(width):
        key = key << bits | padded[i:i + n]
    sa = np.argsort(key)
    key = key[sa]
    head = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    # a rank is the first place of its group, so the ranks of settled suffixes stay as they are
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    at = np.flatnonzero(~head | np.r_[~head[1:], False])
    while len(at):
        # only suffixes whose order isn't settled are sorted again; a group keeps the places that it has
        here = sa[at]
        later, group = rank[here + width], rank[here]
        way = np.lexsort((later, group))
        here, group, later = here[way], group[way], later[way]
        sa[at] = here
        head = np.r_[True, (group[1:] != group[:-1]) | (later[1:] != later[:-1])]
        rank[here] = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        at = at[~head | np.r_[~head[1:], False]]
        width *= 2
    return sa


class FMIndex:
    """Of stretches of symbols 1 .. alphabet; symbol 0 ends each."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = 16):
        self.n = len(text)
        ends = text == 0
        sa = suffix_array(text, ends)
        self.bwt = Wavelet(text[sa - 1], max(1, int(alphabet).bit_length()))
        self.less = np.r_[0, np.cumsum(np.bincount(text, minlength=alphabet + 1))]
        begin = np.r_[True, ends[:-1]]  # walks never leave a stretch
        place = np.arange(self.n) - np.maximum.accumulate(np.where(begin, np.arange(self.n), 0))
        keep = (place % sample == 0)[sa]
        self.kept = Wavelet(keep.astype(np.int64), 1)
        self.places = sa[keep]

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase (symbols, filled up with 0 in front)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            on = np.flatnonzero((lengths >= back) & (low < high))
            if not len(on):
                break
            c = phrases[on, -back]
            low[on] = self.less[c] + self.bwt.rank(c, low[on])
            high[on] = self.less[c] + self.bwt.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffixes: steps back to a sampled one."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left, row = np.arange(len(rows)), rows
        while len(left):
            done = self.kept.at(row).astype(bool)
            out[left[done]] = self.places[self.kept.rank(np.ones(int(done.sum()), np.int64), row[done])] + steps[left[done]]
            left, row = left[~done], row[~done]
            steps[left] += 1
            c = self.bwt.at(row)
            row = self.less[c] + self.bwt.rank(c, row)
        return out


class Phrases:
    """Test windows of a block of items: numbered words, windows as rows of symbols, and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes | None]], size: int):
        self.symbol: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            w = [self.symbol.setdefault(x, len(self.symbol) + 1) for x in plain_words(text)]
            for i in range(max(1, len(w) - size + 1) if w else 0):
                windows.setdefault(tuple(w[i:i + size]), set()).add(name)
        self.lengths = np.array([len(x) for x in windows], np.int64)
        self.rows = np.zeros((len(windows), size), np.int64)
        for k, x in enumerate(windows):
            self.rows[k, size - len(x):] = x
        self.items = [sorted(x) for x in windows.values()]
        self.shortest = int(self.lengths.min()) if len(windows) else 0

    def hits(self, texts: list[bytes | None]) -> list:
        """The columns of _HITS for a shard."""
        get = self.symbol.get
        symbols, sizes = [], []
        for t in texts:
            w = plain_words(t)
            sizes.append(len(w))
            symbols.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
            symbols.append(np.zeros(1, np.int64))
        items: list[set[str]] = [set() for _ in texts]
        spans: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2 for _ in texts]
        n_hit = np.zeros(len(texts), np.int64)
        flat = np.concatenate(symbols) if symbols else np.empty(0, np.int64)
        del symbols
        # stretches of known words that can hold a window, each with the separator after it
        end = np.flatnonzero(flat == 0)
        begin = np.r_[0, end[:-1] + 1] if len(end) else end
        ok = end - begin >= max(1, self.shortest)
        begin, end = begin[ok], end[ok] + 1
        if len(self.lengths) and len(begin):
            n = end - begin
            place = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            index = FMIndex(flat[place], len(self.symbol))
            low, high = index.find(self.rows, self.lengths)
            count = high - low
            which = np.repeat(np.arange(len(count)), count)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
            at = place[index.locate(rows)]
            first = np.cumsum(np.r_[0, np.array(sizes[:-1], np.int64) + 1])  # each text has a separator after it
            doc = np.searchsorted(first, at, "right") - 1
            step = np.zeros(len(flat) + 1, np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + self.lengths[which], -1)
            hit = np.cumsum(step[:-1]) > 0
            edge = np.diff(np.r_[False, hit, False].astype(np.int8))
            start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            owner = np.searchsorted(first, start, "right") - 1
            for d in np.unique(owner):
                mine = slice(*np.searchsorted(owner, [d, d + 1]))
                spans[d] = (start[mine] - first[d], stop[mine] - first[d])
                n_hit[d] = int((spans[d][1] - spans[d][0]).sum())
            for d, w in zip(*np.divmod(np.unique(doc * len(self.items) + which), len(self.items))):
                items[d].update(self.items[w])
        kind = pa.list_(pa.int64())
        return [pa.array(sizes, pa.int64()), pa.array(n_hit), pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                pa.array([s for s, _ in spans], kind), pa.array([e for _, e in spans], kind)]


def find_phrases(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                 size: int = 13, block_bytes: int = 8 << 20, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """(docs' columns `keep` and a struct: n_words, n_hit, items (sorted ids of items with occurring windows), span_start and
    span_end (merged word ranges, end exclusive); its name)."""
    spark, out = docs.sparkSession, fresh(docs, "hits")
    total = items.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{item_text}`").cast("string"))), F.lit(0))).first()[0]
    blocks = total // block_bytes + 1
    numbered = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{item_text}`").cast("string").cast("binary").alias("text"))
    block = lambda: F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    # more blocks until each keeps to the bound; items of equal text and id, or one item, can't be parted
    while 1 < blocks < 1 << 20 and (numbered.groupBy(block().alias("b")).agg(F.sum(F.octet_length("text")).alias("n"), F.count_distinct("item", "text").alias("k"))
                                    .where((F.col("n") > block_bytes) & (F.col("k") > 1)).limit(1).count()):
        blocks *= 2
    keep = docs.columns if keep is None else keep
    if blocks > 1:
        row, body = fresh(docs, "row_number"), fresh(docs, "body")
        base = stored(docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias(body), F.monotonically_increasing_id().alias(row)), "numbered")
        source, column, kept = base, body, [row]
    else:
        source, column, kept = docs, text, keep
    both = None
    for b in range(blocks):
        mine = numbered.where(block() == b) if blocks > 1 else numbered
        share = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in mine.toLocalIterator()])
        part = over_texts(source, column, out, _HITS, _searcher(share, size), kept)
        both = part if both is None else both.unionByName(part)
    if blocks == 1:
        return both, out
    both = stored(both, "hits")
    spans = F.flatten(F.collect_list(F.arrays_zip(F.col(f"{out}.span_start").alias("s"), F.col(f"{out}.span_end").alias("e"))))
    merged = both.groupBy(row).agg(
        F.max(f"{out}.n_words").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{out}.items")))).alias("i"), F.array_sort(spans).alias("s"))
    merged = merged.select(row, _merged("s", "n", "i").alias(out))
    return base.join(merged, row).select(*(base[f"`{c}`"] for c in keep), merged[out]), out


def _merged(spans: str, n: str, items: str) -> Column:
    """Sorted word ranges, put together where they touch, as the struct of _HITS."""
    kind = "array<struct<s:bigint,e:bigint>>"
    joined = F.expr(f"""aggregate({spans}, cast(array() as {kind}), (a, x) -> if(size(a) > 0 and element_at(a, -1).e >= x.s,
        concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.e)))), concat(a, array(named_struct('s', x.s, 'e', x.e)))))""")
    hit = F.aggregate(joined, F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return F.struct(F.col(n).alias("n_words"), hit.alias("n_hit"), F.col(items).alias("items"), joined["s"].alias("span_start"), joined["e"].alias("span_end"))


def _searcher(share, size: int):
    held = {}  # one index of phrases per Python worker and block

    def work(texts):
        if "phrases" not in held:
            held["phrases"] = Phrases(share.value, size)
        return held["phrases"].hits(texts)

    return work


def contaminated(hits: str) -> Column:
    """A twentieth or more of the words, and at least one, lie in windows of test items."""
    n, h = F.col(f"`{hits}`.n_words"), F.col(f"`{hits}`.n_hit")
    return (h > 0) & (20 * h >= n)


def without_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without contaminated rows, other rows and columns as they are."""
    found, out = find_phrases(docs, items, **options)
    return found.where(~contaminated(out)).select(*(found[f"`{c}`"] for c in docs.columns))
