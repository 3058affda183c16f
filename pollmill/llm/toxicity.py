"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Labelled documents that may be learned from are parted by a hash of the id: one half gives the lexicon (words and word stems that are far
more frequent in toxic documents; a partial aggregate per unit), of the other half three quarters grow the trees and a
quarter calibrates them. So no document trains on lexicon entries that it brought in itself. Features are shares and
densities of whole texts: lexicon hits, hits near second-person words, capitals, punctuation, symbols, disguised spellings.
The trees and the calibration are Spark's own. Scoring is one pass over the texts for features, the rest column expressions.

What is learned is bounded: the lexicon by `most_units`; the labelled documents that it is counted over and, as many again, those
for trees and calibration by `most_rows`: of more labels a hash of the id takes an even share of about that many. So labels are
broadcast to the documents and no text is shuffled. Nulls and empty texts have features of zero and a score like any other. Repeated rows get the same score. Several labels of
one id count as toxic if one is; null labels and labels without a document are left out. Without two classes to learn from, the score
is the share of toxic labels (0 without labels). An empty table gives an empty result. Columns named like the result stay:
the result's name gets underscores.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from .common import _LOWER, fresh, over_texts, plain_words, stored, struct

#: Words of abuse that are counted whatever the labels say.
SEED = frozenset(b"idiot idiots stupid moron morons trash scum clown loser losers pathetic worthless disgusting dumb fool garbage filth vermin".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".encode().split())
#: Signs that stand for letters in disguised words.
_LEET = bytes.maketrans(b"013457@$!", b"oieastasi")
#: Runs of letters, digits and @$!* after lower-casing; every other byte parts them.
_RUNS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x in b"0123456789@$!*" else 0x20 for x in range(256))
_THRICE = re.compile(rb"([a-z])\1\1")
_UPPER = bytes(x for x in range(256) if not 65 <= x <= 90)
_LETTER = bytes(x for x in range(256) if not (65 <= x <= 90 or 97 <= x <= 122 or x >= 0xC0))
_POINTS = bytes(x for x in range(256) if x not in b".,;:!?")
_CALLS = bytes(x for x in range(256) if x not in b"!?")
_SIGNS = bytes(x for x in range(256) if x not in b"#*$%&@^~|<>")
NEAR = 5
FEATURES = ("seed_density", "word_density", "stem_density", "seed_hits", "word_hits", "stem_hits", "stem_weight", "top_weights", "you_density", "near_you", "capitals", "capital_words", "points", "calls", "signs",
            "disguised", "disguised_hits", "drawn_out", "log_words", "distinct_hits")
_FEATURES = struct("features double[]")


def units(text: bytes | None) -> list[bytes]:
    """Distinct words of a text, digits aside, and their beginnings of 4 and 5 bytes, marked, where UTF-8 can be cut."""
    out = set()
    for w in set(plain_words(text)):
        if not w.isdigit():
            out.add(w)
            for k in (4, 5):
                if len(w) > k and w[k] & 0xC0 != 0x80:
                    out.add(w[:k] + b"-")
    return list(out)


class Marks:
    """What the lexicon (unit -> log odds of being toxic) says of words; a word is looked up once while it is remembered."""

    MOST = 300_000

    def __init__(self, lexicon: dict[bytes, float]):
        self.lexicon, self.plain, self.marked = lexicon, set(), {}

    def of(self, words) -> list[tuple[bytes, tuple[bool, float, float, bool]]]:
        """(word, (seed, log odds of the word, of its best stem, second person)) of the distinct words that have any."""
        if len(self.plain) + len(self.marked) > self.MOST:
            self.plain.clear()
            self.marked.clear()
        out, odds, marked, plain = [], self.lexicon.get, self.marked, self.plain
        for x in words - plain:
            m = marked.get(x)
            if m is None:
                stem = max(odds(x[:4] + b"-", 0.0) if len(x) > 4 else 0.0, odds(x[:5] + b"-", 0.0) if len(x) > 5 else 0.0)
                m = (x in SEED, odds(x, 0.0), stem, x in SECOND_PERSON)
                if m == (False, 0.0, 0.0, False):
                    plain.add(x)
                    continue
                marked[x] = m
            out.append((x, m))
        return out


def _disguised(text: bytes) -> list[bytes]:
    """Runs of three or more that hold a letter and a digit or sign."""
    return [x for x in text.translate(_RUNS).split() if not x.isalpha() and len(x) > 2 and x.strip(b"0123456789@$!*")]


def _drawn_out(text: bytes) -> int:
    """Letters written three times over."""
    a = np.frombuffer(text.translate(_LOWER), np.uint8)
    same = a[1:] == a[:-1]
    if not (same[1:] & same[:-1] & (a[2:] >= 97) & (a[2:] <= 122)).any():
        return 0
    return len(_THRICE.findall(a.tobytes()))


def _near(words: list[bytes], bad: set[bytes], you: set[bytes]) -> int:
    """Words of `bad` with one of `you` at most NEAR words away."""
    y, h = np.flatnonzero([x in you for x in words]), np.flatnonzero([x in bad for x in words])
    at = np.searchsorted(y, h)
    return int((np.minimum(np.abs(h - y[np.minimum(at, len(y) - 1)]), np.abs(h - y[np.maximum(at - 1, 0)])) <= NEAR).sum())


def features(text: bytes | None, marks: Marks) -> list[float]:
    """In the order of FEATURES."""
    t = text or b""
    w = plain_words(t)
    n = len(w)
    if not n:
        return [0.0] * len(FEATURES)
    count = Counter(w)
    found = marks.of(count.keys())
    seed = word = stem = second = 0
    weights, shares, bad, you = [], [], set(), set()
    for x, (seeded, whole, half, person) in found:
        c = count[x]
        if person:
            second += c
            you.add(x)
        if seeded or whole:
            seed += c * seeded
            word += c * (whole > 0)
            bad.add(x)
        if half:
            stem += c
            shares.append(half * c)
        if seeded or whole or half:
            weights.append(max(whole, half, 4.0 if seeded else 0.0))
    weights.sort(reverse=True)
    near = _near(w, bad, you) if bad and you else 0
    letters, upper = len(t.translate(None, _LETTER)), len(t.translate(None, _UPPER))
    spaced = t.split()
    capital = sum(len(x) > 2 for x in filter(bytes.isupper, spaced))
    disguised = _disguised(t)
    drawn = [x for x in disguised if x.translate(_LEET).strip(b"s").strip(b"*") in SEED or x.translate(_LEET) in SEED]
    return [seed / n, word / n, stem / n, math.log1p(seed), math.log1p(word), math.log1p(stem), math.fsum(shares) / n, math.fsum(weights[:5]),
            second / n, near / n, upper / max(1, letters), capital / max(1, len(spaced)), len(t.translate(None, _POINTS)) / n, len(t.translate(None, _CALLS)) / n,
            len(t.translate(None, _SIGNS)) / n, len(disguised) / n, len(drawn) / n, _drawn_out(t) / n, math.log1p(n), float(len(weights))]


def with_features(docs: DataFrame, lexicon: dict[bytes, float], text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    out = fresh(docs, "toxicity_features")
    share = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most `most_units` entries
    held = []  # a task's own

    def work(texts):
        if not held:
            held.append(Marks(share.value))
        return [pa.array([features(x, held[0]) for x in texts], pa.list_(pa.float64()))]

    return over_texts(docs, text, out, _FEATURES, work, keep), out


def remainder(key: str) -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")) % 3


def learn_lexicon(labelled: DataFrame, text: str = "text", most_units: int = 20_000, least: int = 3, log_odds: float = 1.5) -> dict[bytes, float]:
    """unit -> log odds, of units that occur in `least` toxic documents or more (rows: text, toxic 0/1)."""
    out = fresh(labelled, "units")
    found = over_texts(labelled, text, out, struct("unit binary[]"), lambda t: [pa.array([units(x) for x in t], pa.list_(pa.binary()))], ["toxic"])
    n = labelled.agg(F.coalesce(F.sum("toxic"), F.lit(0)).cast("double").alias("t"), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0)).cast("double").alias("c")).first()
    counts = found.select("toxic", F.explode(f"{out}.unit").alias("unit")).groupBy("unit").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n["t"] + 1)) - F.log((F.col("c") + 0.5) / (n["c"] + 1))
    top = counts.where(F.col("t") >= least).withColumn("odds", odds).where(F.col("odds") >= log_odds).orderBy(F.desc(F.col("odds") * F.log1p("t")), "unit").limit(most_units)
    return {bytes(r["unit"]): r["odds"] for r in top.select("unit", "odds").collect()}


def _even_share(known: DataFrame, most: int, seed: int) -> DataFrame:
    """All rows, or an even share of about `most` of them by a hash of the id."""
    share = min(1.0, most / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64(F.lit(seed), "label_key"), F.lit(1 << 52)) < F.lit(int(share * (1 << 52))))


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_units: int = 20_000, most_rows: int = 200_000,
          trees: int = 40, depth: int = 4, seed: int = 11, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """(docs' columns `keep` and a struct: held_out, score; its name). Learns from labels of rows that aren't held out."""
    keep = docs.columns if keep is None else keep
    out, part = fresh(docs, "toxicity"), remainder(key)
    known = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("label_key")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("toxic"))
    known = stored(known.where(F.crc32(F.col("label_key").cast("string").cast("binary")) % 3 != 1), "toxicity-labels")
    # labels go to the documents, not whole texts to the labels: `most_rows` bounds what is broadcast
    lexicon_rows, train_rows = (F.broadcast(_even_share(known.where(F.pmod(F.xxhash64(F.lit(seed), "label_key"), F.lit(2)) == half), most_rows, seed + 1)) for half in (0, 1))
    texts = docs.where(part != 1).select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("body")).where(F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(2)) == 0)
    lexicon = learn_lexicon(texts.join(lexicon_rows, F.col("k") == F.col("label_key")).select("body", "toxic"), "body", most_units)
    rows, feats = with_features(docs, lexicon, text, list(dict.fromkeys([*keep, key])))
    rows = stored(rows, "toxicity")
    vector = array_to_vector(F.col(f"`{feats}`.features"))
    fit = rows.select(F.col(f"`{key}`").alias("k"), vector.alias("features")).join(train_rows, F.col("k") == F.col("label_key")).select("features", F.col("toxic").cast("double").alias("label"), F.pmod(F.xxhash64(F.lit(seed + 2), "k"), F.lit(4)).alias("fold"))
    fit = stored(fit, "toxicity-fit").cache()
    grow, tune = fit.where("fold > 0"), fit.where("fold = 0")
    classes = {(r["f"], r["label"]): r["n"] for r in fit.groupBy((F.col("fold") > 0).alias("f"), "label").agg(F.count("*").alias("n")).collect()}
    held = (part == 1).alias("held_out")
    kept = [F.col(f"`{c}`") for c in keep]
    if len(classes) < 4:
        total = sum(classes.values())
        rate = sum(v for (_, y), v in classes.items() if y == 1) / total if total else 0.0
        return rows.select(*kept, F.struct(held, F.lit(rate).alias("score")).alias(out)), out
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, subsamplingRate=0.8, minInstancesPerNode=5, seed=seed).fit(grow)
    raw = lambda df: model.transform(df).withColumn("p", vector_to_array("probability")[1])
    # copies share a probability: one weighted row for each, so that none fills a task of the regression
    points = raw(tune).groupBy("p").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
    steps = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight", predictionCol="calibrated").fit(points)
    fit.unpersist()
    bare = rows.select(F.struct(*kept).alias("kept"), held, vector.alias("features"))
    scored = steps.transform(raw(bare).select("kept", "held_out", "p"))
    # calibration has plateaus; a hundredth of the trees' own probability keeps the order on them
    final = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("calibrated") + 0.01 * F.col("p")))
    return scored.select(*(F.col(f"kept.`{c}`") for c in keep), F.struct("held_out", final.alias("score")).alias(out)), out
