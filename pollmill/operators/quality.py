"""Quality flags, sample selection and input validation.

Flags are null-safe column expressions: an unknown comparison gives 0, and the rules that
treat a missing answer as a failure say so explicitly.  Only duplicates need a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scores as S
from ..functions.text import open_text_gibberish, strip
from ..plans import profile as P
from ..sources.scratch import cut


def _any(conds) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in conds])


def attention_flag(item="C064", expected: float = 1) -> Column:
    """1 when the attention item is missing or differs from the expected code."""
    return F.coalesce(F.col(item) != expected, F.lit(True)).cast("int")


def logic_flag(status="C008", visited=P.VISITED_BLOCK, unvisited=P.UNVISITED_BLOCK,
               missing: float = P.STRUCTURAL_MISSING) -> Column:
    """1 when a respondent skipped the block of their own branch or answered the other one."""
    def skipped(block):
        return _any([F.col(x) == missing for x in block])

    def answered(block):
        return _any([F.col(x) != missing for x in block])

    own = F.col(status)
    return S.flag(((own == 1) & (skipped(visited) | answered(unvisited)))
                  | ((own == 2) & (answered(visited) | skipped(unvisited))))


def logic_text_flag(q8="q8_text", visited_text="q14_text", unvisited_text="q15_text", fallback: Column | None = None) -> Column:
    """The branch test on the raw texts; without a status text the coded test decides."""
    status = strip(q8)
    bad = (((status == P.LABEL_NO) & (strip(visited_text) != P.SKIP_TOKEN))
           | ((status == P.LABEL_YES) & (strip(unvisited_text) != P.SKIP_TOKEN)))
    return F.when(status != "", S.flag(bad)).otherwise(logic_flag() if fallback is None else fallback)


def straightline_flag(blocks=P.STRAIGHT_BLOCKS) -> Column:
    """1 when every block is complete and constant."""
    same = [F.col(x) == F.col(b[0]) for b in blocks for x in b]
    return S.flag(reduce(lambda a, b: a & b, same))


def duration_flag(seconds="duration_sec", limit: float = 90) -> Column:
    return S.flag(F.col(seconds) < limit)


def severe_straightline_flag(items=P.LIKERT_ALL, long_run: int = 30, mid_run: int = 20, extreme: float = 0.8) -> Column:
    """Long constant runs, or at most one distinct answer (also when nothing was answered).

    A run that long covers the columns around the middle, whether it starts in the first or the second half of its places, and nulls
    only stretch it: rows with two different neighbours in both of these spans are told by plain comparisons, without walking the answers.
    """
    items = list(items)
    run = S.max_same_run(items)
    hit = S.flag((S.distinct_count(items) <= 1) | (run >= long_run)
                 | ((run >= mid_run) & (S.extreme_share(items) >= extreme)))
    n, r = len(items), min(long_run, mid_run)
    late = max(n - r, 0)
    spans = [items[late // 2:r], items[late:late // 2 + r]]

    def even(span):
        return reduce(lambda a, b: a & b, [F.coalesce(F.col(a).cast("double") == F.col(b).cast("double"), F.lit(True)) for a, b in zip(span, span[1:])], F.lit(True))

    return F.when(even(spans[0]) | even(spans[1]), hit).otherwise(F.lit(0))


def attention_failed(item="C064", expected: float = 1, text="attention_text") -> Column:
    """The label decides where there is one, else the code."""
    label = strip(text)
    return F.when(label != "", label != P.ATTENTION_LABEL).otherwise(attention_flag(item, expected) == 1)


def attention_conditional_flag(failed: Column, severe: Column, seconds="duration_sec", limit: float = 120) -> Column:
    return S.flag(failed & (F.coalesce(F.col(seconds) < limit, F.lit(False)) | (severe == 1)))


def key_missing_flag(items=P.KEY_ITEMS) -> Column:
    return S.flag(_any([F.col(x).isNull() for x in items]))


def gibberish_flag(text="C108") -> Column:
    return open_text_gibberish(text)


def invalid_union_flag(flags=P.FLAG_UNION) -> Column:
    return F.greatest(*[F.col(f) for f in flags])


def answer_key(columns: list[str]) -> Column:
    """Digest of a whole answer row; JSON keeps missing answers apart from blank ones."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def flag_duplicate(df: DataFrame, columns: list[str], id_col: str = "respondent_id", out: str = "duplicate_flag") -> DataFrame:
    """1 on every row whose answers an earlier row (by id) has too.

    Answers become a 128-bit key (values and which are missing). Keys with several rows come from a partial aggregate; those that
    at least 1/1024 of the rows hold, so at most 1,024, meet their rows by broadcast, the others by shuffle: no task gets all
    copies of an answer. Only the ids of repeats join back, by id.
    """
    seen = [F.col(c) for c in columns] + [F.col(c).isNull() for c in columns]
    keyed = cut(df.select(F.col(id_col).alias("_id"), F.xxhash64(F.lit(1), *seen).alias("_k1"), F.xxhash64(F.lit(2), *reversed(seen)).alias("_k2")))
    keys = ["_k1", "_k2"]
    several = cut(keyed.groupBy(*keys).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"))
    share = keyed.agg(F.count(F.lit(1)) / 1024.0).scalar()
    heavy = F.broadcast(several.filter(F.col("_n") >= share).select(*keys, "_first"))
    light = keyed.join(F.broadcast(several.filter(F.col("_n") >= share).select(*keys)), keys, "left_anti").join(several.filter(F.col("_n") < share).select(*keys, "_first"), keys)
    repeats = keyed.join(heavy, keys).unionByName(light).filter("_id <> _first").select("_id").distinct()
    return df.join(repeats, F.col(id_col) == F.col("_id"), "left").withColumn(out, F.col("_id").isNotNull().cast("int")).drop("_id")


def legacy_flags(df: DataFrame, id_col: str = "respondent_id") -> DataFrame:
    return flag_duplicate(df.withColumns({
        "attention_flag": attention_flag(), "logic_flag": logic_flag(), "straightline_flag": straightline_flag(),
    }), P.CODES, id_col, "duplicate_legacy_flag")


def balanced_flags(df: DataFrame) -> DataFrame:
    """The seven rules and their union; ``df`` carries the legacy flags and the context columns."""
    out = df.withColumns({
        "duration_lt90_flag": duration_flag(),
        "severe_straightline_flag": severe_straightline_flag(),
        "logic_branch_flag": logic_text_flag(fallback=F.col("logic_flag")),
        "key_missing_flag": key_missing_flag(),
        "open_gibberish_flag": gibberish_flag(),
        "duplicate_flag": F.col("duplicate_legacy_flag"),
    })
    out = out.withColumn("attention_conditional_flag",
                         attention_conditional_flag(attention_failed(), F.col("severe_straightline_flag")))
    return out.withColumn("invalid_union_flag", invalid_union_flag())


# Names of the two rule sets.
BALANCED, LEGACY = "balanced_v20260221", "legacy_balanced"


def quality_profile(df: DataFrame, profile: str = BALANCED, id_col: str = "respondent_id") -> DataFrame:
    """All flags under a rule set; ``balanced`` marks rows to drop, ``legacy`` only reports."""
    out = legacy_flags(df, id_col)
    if profile == BALANCED:
        return balanced_flags(out)
    zero = F.lit(0)
    return out.withColumns({
        "duration_lt90_flag": zero, "severe_straightline_flag": F.col("straightline_flag"),
        "attention_conditional_flag": zero, "logic_branch_flag": F.col("logic_flag"), "key_missing_flag": zero,
        "open_gibberish_flag": zero, "duplicate_flag": F.col("duplicate_legacy_flag"), "invalid_union_flag": zero,
    })


def valid_sample(flagged: DataFrame) -> DataFrame:
    return flagged.filter("invalid_union_flag = 0")


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def sensitivity_sample(df: DataFrame, logic="logic_branch_flag") -> DataFrame:
    return df.filter((F.col("attention_flag") == 0) & (F.col(logic) == 0))


def keep_semi(detail: DataFrame, kept: DataFrame, id_col: str = "respondent_id") -> DataFrame:
    return detail.join(kept.select(id_col), id_col, "left_semi")


def attention_subsets(df: DataFrame, item="C064") -> DataFrame:
    """Rows repeated once per subset they belong to: main, eq1, not_eq1, eq5."""
    names = [("main", F.lit(True)), ("eq1", F.col(item) == 1), ("not_eq1", F.col(item) != 1), ("eq5", F.col(item) == 5)]
    return df.withColumn("subset", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in names]))))


EVIDENCE = ["duration_sec", "q8_text", "q14_text", "q15_text", "attention_text", "ip"]


def flagged_rows(flagged: DataFrame) -> DataFrame:
    """Rows with any of the first-generation flags."""
    return flagged.select("respondent_id", *P.LEGACY_FLAGS).filter(_any([F.col(f) == 1 for f in P.LEGACY_FLAGS]))


def dropped_rows(flagged: DataFrame, profile: str = BALANCED) -> DataFrame:
    """Rows removed by the union rule, with the evidence behind each flag."""
    return flagged.filter("invalid_union_flag = 1").select(
        "respondent_id", F.lit(profile).alias("quality_profile"), *P.FLAG_UNION, "invalid_union_flag",
        *[strip(e).alias(e) if e != "duration_sec" else F.col(e) for e in EVIDENCE], strip("C108").alias("open_text"))


def survey_clean(flagged: DataFrame, extra=()) -> DataFrame:
    """Kept rows with structural missing codes nulled and the derived scores added.  No shuffle."""
    kept = valid_sample(flagged).withColumns(
        {x: S.codes_to_null(x) for x in P.VISITED_BLOCK + P.UNVISITED_BLOCK})
    return with_scores(kept).select(
        "respondent_id", *P.CODES, *P.LEGACY_FLAGS, *P.FLAG_UNION, "invalid_union_flag",
        "visit_depth_bin", *P.SCORES, *P.COUNTS, *extra)


def with_scores(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "visit_depth_bin": S.visit_depth("C024", "C025"),
        "perception_mean": S.row_nanmean(P.PERCEPTION),
        "importance_mean": S.row_nanmean(P.IMPORTANCE),
        "performance_mean": S.row_nanmean(P.PERFORMANCE),
        "cognition_mean": S.row_nanmean(P.COGNITION),
        "motive_count": S.row_nansum(P.MOTIVE),
        "new_project_pref_count": S.row_nansum(P.PROJECTS),
        "promo_pref_count": S.row_nansum(P.PROMOS),
    })


def survey_model(clean: DataFrame, labels: DataFrame, id_col: str = "respondent_id") -> DataFrame:
    """Model table: scores and flags with the segment label joined on the respondent id."""
    return clean.join(labels.select(id_col, F.col("cluster").alias("cluster_label")), id_col).select(
        id_col, F.col("C008").alias("visit_group"), "visit_depth_bin", "attention_flag", "logic_flag",
        "invalid_union_flag", "cluster_label", *P.SCORES, *P.COUNTS)


# --- validation ---------------------------------------------------------------
def _violations(df: DataFrame, bad_by_column: dict[str, Column], examples: int) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(n).alias("column"), F.coalesce(F.col(n).cast("string"), F.lit("missing")).alias("value"),
                                 S.flag(cond).alias("bad")) for n, cond in bad_by_column.items()])
    # Distinct bad values first: a column of mostly bad values still reduces map-side.
    counts = df.select(F.inline(F.filter(entries, lambda e: e["bad"] == 1))).groupBy("column", "value").count()
    rank = F.row_number().over(W.partitionBy("column").orderBy("value"))
    shown = (counts.withColumn("_rank", rank).filter(F.col("_rank") <= examples).groupBy("column")
             .agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("examples")))
    return counts.groupBy("column").agg(F.sum("count").alias("violations")).join(shown, "column")


def likert_violations(df: DataFrame, columns: list[str], low=1, high=5, examples: int = 8) -> DataFrame:
    """(column, violations, examples) for values that are missing, fractional or out of range."""
    return _violations(df, {x: F.col(x).isNull() | (F.col(x) < low) | (F.col(x) > high)
                            | (F.abs(F.col(x) - F.rint(F.col(x))) > 1e-6) for x in columns}, examples)


def binary_violations(df: DataFrame, columns: list[str], examples: int = 8) -> DataFrame:
    return _violations(df, {x: F.col(x).isNull() | ~F.col(x).isin(0.0, 1.0) for x in columns}, examples)


def validate(violations: DataFrame) -> None:
    """Raise when any column has violations; at most one row per column reaches the driver."""
    rows = violations.collect()
    if rows:
        raise ValueError("; ".join(f"{r['column']}: {r['violations']} bad values, e.g. {r['examples']}" for r in rows))
