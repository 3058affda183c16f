"""Mixing sources to target weights: iterative proportional fitting on cells, then sampling by calibrated probabilities.

Documents are summed to cells of source, language and topic (a partial aggregate: a hot source costs nothing). Raking looks for
each cell's probability p <= 1 such that the expected tokens meet all three marginals and add up to the asked share of all
tokens: p = min(1, u), and u of a cell is scaled by goal / expected of its source, its language and its topic in turn. The bound is
part of the fit, so no probability is cut afterwards.

A level can't give more than its tokens: goals above that are set to it, the other levels of the marginal share the rest in
proportion, and the cells of such a level are taken whole. Sweeps end when all marginals are within `tolerance` of the budget, or
when five sweeps have not halved the largest deviation: then the goals contradict each other, or nearly so. Either way each document's row says
how far the expected share of its source, language and topic is from the goal, and whether the goals were met.
A document is sampled if a hash of its id is below its cell's probability, so a run repeated gives the same sample.
DataFrame functions only: cells and levels stay tables, the driver sees a figure a step.

Topics are rules in order (name, pattern); the first that a text matches, else "general". A null source or language is a
level of its own. Null and empty texts have no tokens: they are sampled like others of their cell (a cell without any tokens
has probability 1, but 0 where a goal is 0). Rows that share an id are sampled together; null ids are one id. Targets: rows (level,
share); shares of levels that have no tokens are left out and the rest is scaled to 1; a level without a target, or with a share of 0
or less, gets none. An empty table gives an empty result. Columns of docs named like the result stay: the result's name gets underscores.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pollmill.operators.skew import lookup

from .common import cut, fresh, stored

#: What sets apart kinds of text here; a caller passes its own.
TOPICS = (
    ("notice", r"(?i)licensed under|all rights reserved|copyright"),
    ("contact", r"[A-Za-z0-9._-]@[A-Za-z0-9-]+\.[A-Za-z]"),
    ("table", r" \| "),
    ("figures", r"[0-9]{6}"),
    ("web", r"https?://"),
    ("list", r"\n[-*•] "),
    ("questions", r"\?[^?]{0,200}\?"),
)
MARGINS = ("source", "lang", "topic")


def topic_of(text: str, topics: Sequence[tuple[str, str]] = TOPICS) -> Column:
    c = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    out = F.lit("general")
    for name, pattern in reversed(topics):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def key_of(level: Column) -> Column:
    """A level as a key: null is one too."""
    return F.coalesce(F.concat(F.lit("="), level), F.lit("null"))


def cells_of(rows: DataFrame) -> DataFrame:
    """A row per source, language and topic, with its keys, tokens and documents."""
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("tokens"), F.count("*").alias("n_docs"))
    return cells.withColumns({f"key_{m}": key_of(F.col(m)) for m in MARGINS})


def wishes(cells: DataFrame, targets: Mapping[str, DataFrame], alpha: float) -> dict[str, DataFrame]:
    """margin -> (key, wish): the level's share, unscaled, of targets, else its tokens ** alpha."""
    out = {}
    for m in MARGINS:
        levels = cells.groupBy(F.col(f"key_{m}").alias("key")).agg(F.sum("tokens").alias("t"))
        if m in targets:
            asked = targets[m].groupBy(key_of(F.col("level").cast("string")).alias("key")).agg(F.sum(F.col("share").cast("double")).alias("share"))
            wish = F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(0.0))
            levels = levels.join(asked, "key", "left")
        else:
            wish = F.pow("t", F.lit(float(alpha)))
        out[m] = cut(levels.select("key", F.when(F.col("t") > 0, wish).otherwise(0.0).alias("wish")))
    return out


def _filled(levels: DataFrame, budget: float) -> DataFrame:
    """levels (key, wish, most) with `goal` = min(most, scale * wish), adding up to the budget, and `whole`: the level's bound holds.

    Every step sets the scale from the levels below their bound; levels at their bound only grow, so it ends.
    """
    scale = 0.0
    while True:
        at = F.col("wish") * F.lit(scale) >= F.col("most")
        taken, free = levels.agg(F.sum(F.when(at, F.col("most")).otherwise(0.0)), F.sum(F.when(at, 0.0).otherwise(F.col("wish")))).first()
        new = (budget - (taken or 0.0)) / free if free else scale
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    at = F.col("wish") * F.lit(scale) >= F.col("most") * F.lit(1 - 1e-12)
    return levels.select("key", "most", F.when(at, F.col("most")).otherwise(F.col("wish") * F.lit(scale)).alias("goal"), at.alias("whole"))


def with_goals(cells: DataFrame, targets: Mapping[str, DataFrame], alpha: float, share: float) -> tuple[DataFrame, float]:
    """(cells with goal_source ... in tokens, `out` (a goal is 0), `whole` (taken in full); the budget: tokens that the goals add up to)."""
    asked = wishes(cells, targets, alpha)
    for m in MARGINS:
        cells = cells.join(asked[m].select(F.col("key").alias(f"key_{m}"), F.col("wish").alias(f"wish_{m}")), f"key_{m}")
    none = F.lit(False)
    for m in MARGINS:
        none = none | (F.col(f"wish_{m}") <= 0)
    cells = cut(cells.withColumn("out", none))
    total, inside = cells.agg(F.sum("tokens"), F.sum(F.when(~F.col("out"), F.col("tokens")).otherwise(0.0))).first()
    budget = min((total or 0.0) * share, inside or 0.0)
    whole = F.lit(False)
    for m in MARGINS:
        levels = cells.where("NOT out").groupBy(F.col(f"key_{m}").alias("key")).agg(F.first(f"wish_{m}").alias("wish"), F.sum("tokens").alias("most"))
        goals = _filled(cut(levels.where("most > 0")), budget)
        cells = cells.join(goals.select(F.col("key").alias(f"key_{m}"), F.col("goal").alias(f"goal_{m}"), F.col("whole").alias(f"whole_{m}")), f"key_{m}", "left")
        whole = whole | F.coalesce(F.col(f"whole_{m}"), F.lit(False))
    return cut(cells.withColumns({f"goal_{m}": F.coalesce(F.col(f"goal_{m}"), F.lit(0.0)) for m in MARGINS}).withColumn("whole", whole & ~F.col("out"))), budget


def _probability() -> Column:
    return F.when(F.col("out"), 0.0).when(F.col("whole") | (F.col("tokens") <= 0), 1.0).otherwise(F.least(F.lit(1.0), F.col("u")))


def raked(cells: DataFrame, budget: float, share: float, tolerance: float = 1e-6) -> DataFrame:
    """cells with `probability`, `off_source` ... (expected minus asked share of the sample, of the cell's level) and `met` (all within tolerance).

    A sweep is three sums by level, each a partial aggregate that joins back on the level.
    """
    now = cut(cells.withColumn("u", F.lit(float(share))))
    best, since = float("inf"), 0
    while True:
        step = now
        for m in MARGINS:
            full = F.col("whole") | (F.col("u") >= 1)
            bound, free = F.when(F.col("whole"), F.col("tokens")).otherwise(0.0), F.when(full, 0.0).otherwise(F.col("u") * F.col("tokens"))
            sums = step.where("NOT out").groupBy(f"key_{m}").agg(F.first(f"goal_{m}").alias("_goal"), F.sum(bound).alias("_bound"), F.sum(F.when(full, F.col("tokens")).otherwise(0.0)).alias("_full"),
                                                                  F.sum(free).alias("_free"))
            # upwards only cells below 1 give more: a Newton step on a concave function, which never passes the goal; downwards all scaled cells give less
            more = F.when(F.col("_free") > 0, (F.col("_goal") - F.col("_full")) / F.col("_free")).otherwise(1.0)
            loose = F.col("_full") + F.col("_free") - F.col("_bound")
            less = F.when(loose > 0, F.greatest(F.col("_goal") - F.col("_bound"), F.lit(0.0)) / loose).otherwise(1.0)
            ratio = F.when(F.col("_goal") >= F.col("_full") + F.col("_free"), more).otherwise(less)
            step = step.join(sums.select(f"key_{m}", ratio.alias("_ratio")), f"key_{m}", "left").withColumn("u", F.col("u") * F.coalesce("_ratio", F.lit(1.0))).drop("_ratio")
        now = cut(step)
        worst = offs(now, budget).agg(F.max(F.abs("off"))).first()[0]
        if worst is None or worst <= tolerance:
            break
        best, since = (worst, 0) if worst < best / 2 else (best, since + 1)
        if since == 5:
            break
    levels = offs(now, budget)
    out = now.withColumns({"probability": _probability(), "met": F.lit(worst is None or worst <= tolerance)})
    for m in MARGINS:
        out = out.join(levels.where(F.col("margin") == m).select(F.col("key").alias(f"key_{m}"), F.col("off").alias(f"off_{m}")), f"key_{m}", "left")
    return out


def offs(cells: DataFrame, budget: float) -> DataFrame:
    """(margin, key, goal, expected, off): shares of the budget asked and expected, and their difference, of every level."""
    taken = _probability() * F.col("tokens")
    rows = cells.select(F.inline(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(f"key_{m}").alias("key"), F.col(f"goal_{m}").alias("goal"), taken.alias("taken")) for m in MARGINS])))
    part = F.lit(float(budget) or 1.0)
    return rows.groupBy("margin", "key").agg((F.first("goal") / part).alias("goal"), (F.sum("taken") / part).alias("expected")).withColumn("off", F.col("expected") - F.col("goal"))


def draw(key: str, seed: int) -> Column:
    """Uniform in [0, 1) from the id alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{key}`")), 11).cast("double") / F.lit(float(1 << 53))


def mix(docs: DataFrame, share: float = 0.5, alpha: float = 0.7, targets: Mapping[str, DataFrame] | None = None, key: str = "doc_id", text: str = "text",
        source: str = "source", lang: str = "lang", topics: Sequence[tuple[str, str]] = TOPICS, seed: int = 7, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """(docs' columns `keep` and a struct: source, lang, topic, n_tokens, probability (of its cell), draw, sampled, off_source, off_lang, off_topic, met; its name).

    alpha makes default targets from the tokens of each level (1: as they are, 0: all alike).
    """
    out, cell = fresh(docs, "mix"), fresh(docs, "cell")
    keep = docs.columns if keep is None else keep
    words = F.regexp_count(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    own = F.struct(F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{lang}`").cast("string").alias("lang"),
                   topic_of(text, topics).alias("topic"), words.alias("n_tokens"), draw(key, seed).alias("draw"))
    place = fresh(docs, "cell_key")
    # written once: texts are scanned once, for the cells and for the rows
    rows = stored(docs.select(*(F.col(f"`{c}`") for c in keep), own.alias(out)).withColumn(place, F.to_json(F.struct(*(key_of(F.col(f"`{out}`.{m}")).alias(m) for m in MARGINS)))), "mix")
    cells, budget = with_goals(cut(cells_of(rows.select(f"{out}.*"))), targets or {}, alpha, share)
    known = raked(cells, budget, share).select(F.to_json(F.struct(*(F.col(f"key_{m}").alias(m) for m in MARGINS))).alias(place),
                                               F.struct("probability", "off_source", "off_lang", "off_topic", "met").alias(cell))
    # rows of a hot cell meet a broadcast of at most 1,024 cells and stay where they are
    both = lookup(rows, stored(known, "cells"), [place])
    o, c = (lambda n: F.col(f"`{out}`.{n}")), (lambda n: F.col(f"`{cell}`.{n}"))
    made = F.struct(*(o(n).alias(n) for n in (*MARGINS, "n_tokens")), c("probability").alias("probability"), o("draw").alias("draw"), (o("draw") < c("probability")).alias("sampled"),
                    *(c(n).alias(n) for n in ("off_source", "off_lang", "off_topic", "met")))
    return both.select(*(F.col(f"`{x}`") for x in keep), made.alias(out)), out


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of docs, all columns as they are."""
    mixed, out = mix(docs, **options)
    return mixed.where(F.col(f"`{out}`.sampled")).select(*(mixed[f"`{c}`"] for c in docs.columns))
