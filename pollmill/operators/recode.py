"""Label sheets to coded sheets: single choice, multiple choice, branches, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import code_number, is_other, norm_label, parse_duration, parsed_columns, split_code_text, split_multi, strip

LOG_COLUMNS = "row_id", "source_col_idx", "source_value", "target_col_idx", "reason"


def label_map(book: dict[str, int]) -> Column:
    """Literal map from normalised label to code."""
    clean = {"".join(k.split()): v for k, v in book.items()}
    return F.create_map(*[F.lit(x) for kv in clean.items() for x in kv])


def map_single(cell: Column, book: dict[str, int], other: str = "其他") -> Column:
    """Code of a single-choice answer; "其他..." falls back to the "其他" code; unmatched or blank is missing."""
    codes = label_map(book)
    hit = F.try_element_at(codes, norm_label(cell))
    if other in book:
        hit = F.coalesce(hit, F.when(is_other(cell, other), F.lit(book[other])))
    return hit


def unknown_single(cell: Column, book: dict[str, int], other: str = "其他") -> Column:
    """The raw answer when it is filled in but not in the book, else NULL."""
    # most answers are labels as the book lists them: one look-up settles those
    listed = F.coalesce(cell.isin(sorted({"".join(k.split()) for k in book})), F.lit(False))
    return F.when(~listed, F.when(map_single(cell, book, other).isNull(), F.nullif(strip(cell), F.lit(""))))


def _tokens(cell: Column, skip: str) -> Column:
    return F.filter(split_multi(cell), lambda t: norm_label(t) != norm_label(F.lit(skip)))


def marked_cell(cell: Column, separator: str = "┋") -> Column:
    """The cell without white space, every token enclosed in separators: one regex per cell."""
    return F.concat(F.lit(separator), norm_label(cell), F.lit(separator))


def map_multi(cell: Column, options: list[str], skip: str = "(跳过)", other: str = "其他",
              marked: Column | None = None, separator: str = "┋") -> list[Column]:
    """One cell per option: "1" selected, "0" not; the last option keeps free text as "1^text".

    Listed options are plain substring tests on the marked cell; tokens are only split when an
    "other" answer is present.
    """
    marked = marked_cell(cell, separator) if marked is None else marked

    def chosen(label):
        return marked.contains(f"{separator}{''.join(label.split())}{separator}").cast("int").cast("string")

    # Free text wins over the bare label unless the bare label comes last in the cell.
    last = F.try_element_at(F.filter(_tokens(cell, skip), lambda t: is_other(t, other)), F.lit(-1))
    other_cell = (F.when(~marked.contains(separator + other), F.lit("0"))
                  .when(norm_label(last) == other, F.lit("1")).otherwise(F.concat(F.lit("1^"), last)))
    return [chosen(o) for o in options[:-1]] + [other_cell]


def other_text_count(cell: Column, skip: str = "(跳过)", other: str = "其他") -> Column:
    found = F.size(F.filter(_tokens(cell, skip), lambda t: is_other(t, other) & (norm_label(t) != other)))
    return F.when(F.contains(cell, F.lit(other)), found).otherwise(0)


def unknown_multi(cell: Column, options: list[str], skip: str = "(跳过)", other: str = "其他") -> Column:
    """Array of tokens that match no option."""
    known = {"".join(o.split()) for o in options} | {"".join(skip.split())}
    # white space is trimmed on what is left, as the tests don't see it
    tokens = F.split(F.coalesce(cell, F.lit("")), "┋")
    return F.transform(F.filter(tokens, lambda t: ~norm_label(t).isin(["", *sorted(known)]) & ~is_other(t, other)), strip)


def branch_skip(status: Column, visited: list[Column], unvisited: list[Column]) -> tuple[list[Column], list[Column]]:
    """Blank or -3 the block that does not apply: status 1 keeps ``visited``, 2 keeps ``unvisited``."""
    left = [F.when(status == 1, v).when(status == 2, F.lit("-3")).otherwise(F.lit("")) for v in visited]
    right = [F.when(status == 2, v).when(status == 1, F.lit("-3")).otherwise(F.lit("")) for v in unvisited]
    return left, right


def _answered(cell: Column, skip: str, separator: str = "┋") -> Column:
    """Whether any token other than the skip marker is present."""
    rest = F.replace(marked_cell(cell, separator), F.lit(separator + "".join(skip.split())), F.lit(""))
    return F.replace(rest, F.lit(separator), F.lit("")) != ""


def branch_conflict(status: Column, visited_cell: Column, unvisited_cell: Column, skip: str = "(跳过)") -> Column:
    """1 when the branch that does not apply was answered, or either one when the status is unknown."""
    v, u = _answered(visited_cell, skip), _answered(unvisited_cell, skip)
    return F.when(status == 1, u).when(status == 2, v).otherwise(v | u).cast("int")


def _books(profile):
    for src, book in profile.SINGLE_BOOKS.items():
        yield src, profile.SINGLE_TARGETS[src], book
    for lo, hi, dst, labels in profile.LIKERT_BOOKS:
        book = {label: k for k, label in enumerate(labels, 1)}
        for src in range(lo, hi + 1):
            yield src, dst + src - lo, book


def _raw(i: int) -> Column:
    return F.col(f"R{i:02d}")


def recode_wide(raw: DataFrame, profile, keep=("respondent_id",)) -> DataFrame:
    """64 label columns R01..R64 -> 108 coded text columns, in one projection without a shuffle."""
    out: dict[int, Column] = {}
    for src, dst, book in _books(profile):
        out[dst] = F.coalesce(map_single(_raw(src), book).cast("string"), F.lit(""))
    raw = raw.withColumns({f"_m{src}": marked_cell(_raw(src)) for src, _ in profile.MULTI_SOURCES.values()}
                          | {"_status": map_single(_raw(14), profile.SINGLE_BOOKS[14])})
    for q, (src, dst) in profile.MULTI_SOURCES.items():
        cells = map_multi(_raw(src), profile.OPTIONS[q], profile.SKIP_TOKEN, marked=F.col(f"_m{src}"))
        out.update({dst + n: cell for n, cell in enumerate(cells)})
    status = F.col("_status")
    spans = [range(33, 43), range(43, 52)]
    left, right = branch_skip(status, [out[i] for i in spans[0]], [out[i] for i in spans[1]])
    out.update(zip(spans[0], left))
    out.update(zip(spans[1], right))
    text = strip(_raw(64))
    out[108] = F.when(text == "", F.lit(profile.NO_TEXT)).otherwise(text)
    return raw.select(*keep, *[out[i].alias(profile.c(i)) for i in range(1, 109)])


def _log_struct(src: int, value: Column, target: str, reason: str) -> Column:
    return F.struct(F.lit(src).alias("source_col_idx"), value.alias("source_value"),
                    F.lit(target).alias("target_col_idx"), F.lit(reason).alias("reason"))


def _log_tokens(src: int, tokens: Column, target: str) -> Column:
    return F.transform(tokens, lambda t: _log_struct(src, t, target, "multi_unmapped"))


def _applies(q: str, status: Column) -> Column:
    """The two branch questions are read only in their own branch."""
    return {"Q14": status == 1, "Q15": status == 2}.get(q, F.lit(True))


def unknown_value_log(raw: DataFrame, profile, row_id: str = "respondent_id") -> DataFrame:
    """One row per answer that no codebook or option list knows."""
    singles = [F.array(_log_struct(s, unknown_single(_raw(s), b), str(d), "single_unmapped")) for s, d, b in _books(profile)]
    multis = []
    for q, (src, dst) in profile.MULTI_SOURCES.items():
        target = f"{dst}-{dst + len(profile.OPTIONS[q]) - 1}"
        found = F.when(_applies(q, F.col("_status")), unknown_multi(_raw(src), profile.OPTIONS[q], profile.SKIP_TOKEN))
        multis.append(_log_tokens(src, F.coalesce(found, F.array().cast("array<string>")), target))
    entries = F.filter(F.concat(*singles, *multis), lambda e: e["source_value"].isNotNull())
    return raw.withColumn("_status", map_single(_raw(14), profile.SINGLE_BOOKS[14])).select(
        F.col(row_id).alias("row_id"), F.inline(entries))


def conversion_counts(raw: DataFrame, profile) -> DataFrame:
    """Per respondent: unknown values, free "other" texts, branch conflict."""
    raw = raw.withColumn("_status", map_single(_raw(14), profile.SINGLE_BOOKS[14]))
    status = F.col("_status")
    unknown = [unknown_single(_raw(s), b).isNotNull().cast("int") for s, _, b in _books(profile)]
    other = []
    for q, (src, _) in profile.MULTI_SOURCES.items():
        here = _applies(q, status)
        unknown.append(F.when(here, F.size(unknown_multi(_raw(src), profile.OPTIONS[q], profile.SKIP_TOKEN))).otherwise(0))
        other.append(F.when(here, other_text_count(_raw(src), profile.SKIP_TOKEN)).otherwise(0))
    return raw.select(sum(unknown[1:], unknown[0]).alias("unknown_n"), sum(other[1:], other[0]).alias("other_n"),
                      branch_conflict(status, _raw(20), _raw(21), profile.SKIP_TOKEN).alias("conflict"))


def audit_from_counts(counts: DataFrame, n_columns: int = 108) -> DataFrame:
    """One audit row: unknown rate, conflict rate, integrity = clamp(1 - unknown - conflict / 2)."""
    agg = counts.agg(F.count(F.lit(1)).alias("n_rows"),
                     F.coalesce(F.sum("unknown_n"), F.lit(0)).alias("unknown_value_count"),
                     F.coalesce(F.sum("other_n"), F.lit(0)).alias("other_text_count"),
                     F.coalesce(F.sum("conflict"), F.lit(0)).alias("branch_conflict_count"))
    rows = F.greatest(F.col("n_rows"), F.lit(1)).cast("double")
    unknown, conflict = F.col("unknown_value_count") / (rows * n_columns), F.col("branch_conflict_count") / rows
    return agg.select(
        "n_rows", "unknown_value_count", unknown.alias("unknown_value_rate"), "other_text_count",
        "branch_conflict_count", conflict.alias("branch_conflict_rate"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - unknown - conflict * 0.5)).alias("conversion_integrity"))


def conversion_audit(raw: DataFrame, profile) -> DataFrame:
    return audit_from_counts(conversion_counts(raw, profile))


def coded_audit(coded: DataFrame) -> DataFrame:
    """The audit of input that is already coded: nothing unknown, no conflicts."""
    return audit_from_counts(coded.select(*[F.lit(0).alias(c) for c in ("unknown_n", "other_n", "conflict")]))


def numeric_cells(coded: DataFrame, columns: list[str], keep=("respondent_id",)) -> DataFrame:
    """Coded text cells -> numbers; the text after a caret is dropped here (see ``cell_markers``)."""
    return parsed_columns(coded, columns, code_number, keep)


def cell_markers(coded: DataFrame, columns: list[str], id_col: str = "respondent_id") -> DataFrame:
    """(respondent_id, col_idx, marker_text) of the cells that carry free text."""
    found = F.filter(F.array(*[F.struct(F.lit(n).alias("col_idx"), split_code_text(c)["text"].alias("marker_text"))
                               for n, c in enumerate(columns, 1)]), lambda m: m["marker_text"] != "")
    return coded.select(id_col, F.inline(found))


def quality_context(raw: DataFrame, keep=("respondent_id",)) -> DataFrame:
    """Evidence columns of the 64-column sheet used by the quality flags."""
    return raw.select(*keep, parse_duration(_raw(3)).alias("duration_sec"), strip(_raw(6)).alias("ip"),
                      strip(_raw(14)).alias("q8_text"), strip(_raw(20)).alias("q14_text"),
                      strip(_raw(21)).alias("q15_text"), strip(_raw(34)).alias("attention_text"),
                      strip(_raw(64)).alias("open_text"))


# --- long form: the same lookups as joins -----------------------------------
def join_codebook(answers: DataFrame, book: DataFrame, on: str = "src_col") -> DataFrame:
    """Long answers (id, src_col, value) with the code of the label; the book is a broadcast dimension."""
    keyed = book.select(on, norm_label("label").alias("label_key"), "dst_col", "code")
    left = answers.withColumn("label_key", norm_label("value"))
    return left.join(F.broadcast(keyed), [on, "label_key"], "left").drop("label_key")


def anti_unknown(answers: DataFrame, book: DataFrame, on: str = "src_col") -> DataFrame:
    """Long answers whose label the book does not hold."""
    keyed = book.select(on, norm_label("label").alias("label_key")).distinct()
    left = answers.withColumn("label_key", norm_label("value")).filter("label_key <> ''")
    return left.join(F.broadcast(keyed), [on, "label_key"], "left_anti").drop("label_key")


# --- dimension joins ---------------------------------------------------------
def join_blocks(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """Attach the block whose span holds the column number: (lo, hi, block) against col_idx."""
    span = F.broadcast(blocks)
    return items.join(span, (items["col_idx"] >= span["lo"]) & (items["col_idx"] <= span["hi"]), "left").drop("lo", "hi")


def join_item_text(rows: DataFrame, items: DataFrame, on: str = "col_idx") -> DataFrame:
    """Item text by column number; an unknown column is named after its number."""
    return rows.join(F.broadcast(items.select(on, "item_text")), on, "left").withColumn(
        "item_text", F.coalesce("item_text", F.concat(F.lit("Q"), F.col(on).cast("string"))))


def variable_dictionary(spark, profile) -> DataFrame:
    """Column number, code, text, block, type, uses and missing rule of all coded columns."""
    items = profile.item_table(spark)
    out = join_blocks(items, profile.span_table(spark, profile.BLOCKS, "question_block"))
    out = join_blocks(out, profile.span_table(spark, profile.ITEM_TYPES, "item_type"))
    uses = spark.createDataFrame(profile.MODEL_USES, "rank int, lo int, hi int, use string")
    joined = items.select("col_idx").join(F.broadcast(uses), F.col("col_idx").between(F.col("lo"), F.col("hi")))
    joined = joined.groupBy("col_idx").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("rank", "use"))), lambda s: s["use"]), "；").alias("model_use"))
    out = out.join(joined, "col_idx", "left")
    out = join_blocks(out, profile.span_table(spark, profile.MISSING_RULES, "missing_rule"))
    return out.select(
        "col_idx", "var_code", "item_text", "question_block",
        F.coalesce("item_type", F.lit(profile.ITEM_TYPE_DEFAULT)).alias("item_type"),
        F.coalesce("model_use", F.lit(profile.MODEL_USE_DEFAULT)).alias("model_use"),
        F.coalesce("missing_rule", F.lit(profile.MISSING_RULE_DEFAULT)).alias("missing_rule"))
