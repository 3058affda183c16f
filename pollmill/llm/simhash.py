"""Near duplicates by SimHash, linked through a Gray-order hierarchical index.

1. `fingerprints`: one Arrow pass; XXH64 of every 3-word shingle, majority of each bit.
2. `links`: distinct fingerprints only, so copies cost nothing. Codes at most 2 bits apart agree in two of four 16-bit blocks
   (pigeonhole), so each of the 6 block pairs is moved to the front and the codes are sorted by Gray rank: those that share
   the front are neighbours. Each run gets a tree whose nodes hold the bits that all codes below share. Two nodes whose
   shared bits already differ in more than 2 places are dropped with all pairs below them.
   A run of more than `most` codes is split by the same rule over the other 32 bits, so no run can exceed 2 ** 16 codes.
   A run gives a spanning forest of its links, never all pairs.
3. `components`: large-star and small-star steps over the forest's edges until nothing changes.

Null and empty texts have fingerprint zero and are linked like any other. Null ids join their group but are never its
smallest id (a group of null ids alone has a null id). Repeated rows get one row each. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pollmill.operators.skew import lookup

from .common import cut, fresh, lower_words, over_texts, stored, struct

_FINGERPRINT = struct("fingerprint bigint")
#: Codes below a node, and pairs of nodes that are compared at once.
FAN, PAIRS = 16, 1 << 16


def fingerprint(text: bytes | None, size: int = 3, seed: int = 42) -> int:
    """Signed 64 bits: a bit is 1 if over half of the shingles' hashes have it."""
    w = lower_words(text)
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(size)))) if len(w) >= size else [b" ".join(w)]
    hashes = np.frombuffer(b"".join(map(partial(xxhash.xxh64_digest, seed=seed), shingles)), np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(hashes[i:i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(hashes), 1 << 16))
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """(docs' columns `keep` and a struct with the fingerprint; the struct's name)."""
    out = fresh(docs, "simhash")
    return over_texts(docs, text, out, _FINGERPRINT, lambda t: [pa.array([fingerprint(x, size) for x in t], pa.int64())], keep), out


def _moved(code, widths: tuple[int, ...], front: tuple[int, ...], total: int):
    """The code with the blocks `front` first; blocks are counted from the top of its `total` low bits."""
    order = [*front, *(i for i in range(len(widths)) if i not in front)]
    out, place = F.lit(0).cast("long"), total
    for i in order:
        low = total - sum(widths[: i + 1])
        place -= widths[i]
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << widths[i]) - 1).cast("long")), place))
    return out


def _gray_rank(code):
    """Place of the code in Gray order: the running XOR of its bits from the top."""
    for s in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, s))
    return code


def tree(codes: np.ndarray, run: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels (shared bits' values, mask of shared bits, first child), codes first; a node's codes are of one run."""
    value, shared = codes, np.full(len(codes), ~np.uint64(0))
    levels = [(value, shared, np.arange(len(codes)))]
    while len(run) and (run[1:] == run[:-1]).any():
        begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        place = np.arange(len(run)) - np.repeat(begin, np.diff(np.r_[begin, len(run)]))
        first = np.flatnonzero(place % FAN == 0)
        own = np.repeat(value[first], np.diff(np.r_[first, len(run)]))
        shared = ~np.bitwise_or.reduceat((value ^ own) | ~shared, first)
        value = value[first] & shared
        levels.append((value, shared, first))
        run = run[first]
    return levels


def near(levels, bits: int):
    """Yields arrays (i, j), i < j, of codes of one run that differ in at most `bits` places; whole node pairs are pruned."""
    top = len(levels) - 1
    own = np.arange(len(levels[top][0]))
    work = [(top, own[i:i + PAIRS], own[i:i + PAIRS]) for i in range(0, len(own), PAIRS)]
    while work:
        level, a, b = work.pop()
        if level == 0:
            yield a, b
            continue
        first = levels[level][2]
        value, shared = levels[level - 1][:2]
        end = np.r_[first[1:], len(value)]
        na, nb = end[a] - first[a], end[b] - first[b]
        n = na * nb
        pair = np.repeat(np.arange(len(a)), n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        x, y = first[a][pair] + k // nb[pair], first[b][pair] + k % nb[pair]
        ok = (x < y) if level == 1 else (x <= y)
        x, y = x[ok], y[ok]
        ok = np.bitwise_count((value[x] ^ value[y]) & shared[x] & shared[y]) <= bits
        x, y = x[ok], y[ok]
        work += [(level - 1, x[i:i + PAIRS], y[i:i + PAIRS]) for i in range(0, len(x), PAIRS)]


def forest(n: int, pairs) -> np.ndarray:
    """For each of n nodes the smallest node that the pairs connect it with."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            a, b = root[a], root[b]
            ok = a != b
            a, b = a[ok], b[ok]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def _runs(batches, bits: int):
    """Spanning links of the runs of a partition sorted by run and Gray rank; runs that batches cut are put together again."""
    held: list[tuple[np.ndarray, ...]] = []

    def solve(parts):
        head, tail, rank, code = (np.concatenate(c) for c in zip(*parts))
        run = np.cumsum(np.r_[0, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])])
        ranks = rank.view(np.uint64)
        root = forest(len(code), near(tree(ranks ^ (ranks >> np.uint64(1)), run), bits))
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(code[at]), pa.array(code[root[at]])], ["a", "b"])

    for b in batches:
        cols = [np.asarray(b.column(i)) for i in range(4)]
        if not len(cols[0]):
            continue
        if held and (held[-1][0][-1], held[-1][1][-1]) != (cols[0][0], cols[1][0]):
            yield solve(held)
            held = []
        held.append(tuple(cols))
        new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))
        if len(new):
            end = int(new[-1]) + 1
            yield solve([*held[:-1], tuple(c[:end] for c in cols)])
            held = [tuple(c[end:] for c in cols)]
    if held:
        yield solve(held)


def links(codes: DataFrame, bits: int = 2, most: int = 1 << 20) -> DataFrame:
    """Edges (a, b) that connect the distinct longs `code` just as all pairs at most `bits` (up to 2) bits apart do."""
    code = F.col("code")
    pairs = list(combinations(range(4), 2))
    heads = F.array(*(F.struct(F.lit(i).alias("way"), _moved(code, (16,) * 4, p, 64).alias("moved")) for i, p in enumerate(pairs)))
    rows = codes.select("code", F.inline(heads)).select(
        "code", "moved", (F.shiftrightunsigned("moved", 32) + F.col("way").cast("long") * F.lit(1 << 32)).alias("head"))
    large = rows.groupBy("head").count().where(F.col("count") > most).select("head", F.lit(True).alias("large"))
    low = F.col("moved").bitwiseAND(F.lit((1 << 32) - 1))
    finer = F.array(*(F.struct((F.lit(i + 1).cast("long") * F.lit(1 << 16) + F.shiftrightunsigned(_moved(low, (8,) * 4, p, 32), 16)).alias("tail"),
                               F.shiftleft(F.shiftrightunsigned("moved", 32), 32).bitwiseOR(_moved(low, (8,) * 4, p, 32)).alias("inner")) for i, p in enumerate(pairs)))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("tail"), F.col("moved").alias("inner")))
    runs = (rows.join(large, "head", "left").select("code", "head", F.inline(F.when(F.col("large"), finer).otherwise(whole)))
            .select("head", "tail", _gray_rank(F.col("inner")).alias("rank"), "code"))
    dealt = runs.repartition("head", "tail").sortWithinPartitions("head", "tail", "rank")
    return dealt.mapInArrow(lambda batches: _runs(batches, bits), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge and the smallest node that it is connected with.

    Alternating large-star and small-star steps, each a minimum per node (partial aggregate) and a join that AQE can split.
    """
    def star(e, small):
        # small: neighbours not above the node, and the node itself, move to the smallest of them; large: those above do
        if small:
            e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        else:
            e = e.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
        low = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        j = e.join(low, "u")
        moved = j.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        if small:
            moved = j.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    def state(e):
        return tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("b", "a") % 1000003), F.lit(0))).first())

    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = state(e)
    while before[0]:
        e = cut(star(star(e, False), True))
        after = state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def groups(codes: DataFrame, bits: int = 2) -> DataFrame:
    """From distinct (code, first: smallest key): fingerprint, group_code (the group's smallest code), first_id (its smallest key)."""
    roots = components(links(codes.select("code"), bits))
    known = codes.join(roots, codes["code"] == roots["node"], "left").select("code", "first", F.coalesce("root", "code").alias("group_code"))
    first = known.groupBy("group_code").agg(F.min("first").alias("first_id"))
    return known.select(F.col("code").alias("fingerprint"), "group_code").join(first, "group_code")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 2, size: int = 3, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """(docs' columns `keep` and a struct: fingerprint, group_code, first_id; its name). A row for each of docs' rows."""
    marked, out = fingerprints(docs, text, size, keep)
    code, seen = fresh(marked, "simhash_code"), fresh(marked, "simhash_known")
    rows = stored(marked.withColumn(code, F.col(f"`{out}`.fingerprint")), "fingerprints")
    known = _known(rows, key, code, bits).select(F.col("fingerprint").alias(code), F.struct("fingerprint", "group_code", "first_id").alias(seen))
    both = lookup(rows, stored(known, "groups"), [code])
    return both.select(*(F.col(f"`{c}`") for c in marked.columns if c != out), F.col(f"`{seen}`").alias(out)), out


def _known(rows: DataFrame, key: str, code: str, bits: int) -> DataFrame:
    return groups(stored(rows.groupBy(F.col(f"`{code}`").alias("code")).agg(F.min(f"`{key}`").alias("first")), "codes"), bits)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 2, size: int = 3) -> DataFrame:
    """docs with one row of each group: the one with the smallest key; of rows that share it, any one.

    Which rows stay is decided on row numbers, keys and fingerprints; the rows themselves are joined once, by their own number.
    """
    marked, out = fingerprints(docs, text, size)
    row = fresh(marked, "simhash_row")
    rows = stored(marked.withColumn(row, F.monotonically_increasing_id()), "fingerprints")
    narrow = rows.select(F.col(f"`{row}`").alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{out}`.fingerprint").alias("code"))
    met = lookup(narrow, stored(_known(narrow, "key", "code", bits).withColumnRenamed("fingerprint", "code"), "groups"), ["code"])
    kept = met.where(F.col("key").eqNullSafe(F.col("first_id"))).groupBy("group_code").agg(F.min("row").alias(row)).select(row)
    return rows.join(kept, row, "left_semi").select(*(rows[f"`{c}`"] for c in docs.columns))
