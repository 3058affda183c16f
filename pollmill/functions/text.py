"""String and number expressions on answer cells.  All are plain Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Unicode white space as the survey export uses it, plus the ASCII separators 1C-1F.
_WS = r"(?U)[\s\x1c-\x1f]+"
_EDGE_WS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
# The same set as characters, for the cheaper per-character removal.
_WS_CHARS = "".join(ch for ch in map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_STRICT_NUMBER = r"^[-+]?[0-9]+(\.[0-9]+)?$"
_FLOAT = r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"
# The same two on a cell as it lies, \z because $ also fits before a line end: such cells have nothing to trim, translate or split.
_PLAIN_STRICT = r"\A[-+]?[0-9]+(?:\.[0-9]+)?\z"
_PLAIN_FLOAT = r"\A[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\z"
_INFINITE = r"(?i)^[-+]?inf(inity)?$"
_WIDE_DIGITS, _DIGITS = "０１２３４５６７８９", "0123456789"

# Filler answers, and the characters of an answer that is punctuation only.
FILLER_TOKENS = ["好", "行", "嗯呢"]
_PUNCT_ONLY = r"^[/\\.|。\-_=+*~`!@#$%^&()\[\]{}<>?]+$"
_SHORT_NUMBER = r"(?U)^\d{1,3}$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim Unicode white space at both ends; missing becomes the empty string."""
    return F.regexp_replace(F.coalesce(_col(c), F.lit("")), _EDGE_WS, "")


def norm_ws(c) -> Column:
    """Collapse white space to one blank and trim."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), _WS, " "))


def norm_label(c) -> Column:
    """Label key: all white space removed."""
    return F.translate(F.coalesce(_col(c), F.lit("")), _WS_CHARS, "")


def is_other(c, other: str = "其他") -> Column:
    return norm_label(c).startswith(other)


def split_multi(c, separator: str = "┋") -> Column:
    """Tokens of a multiple-choice cell, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(F.coalesce(_col(c), F.lit("")), separator), strip), lambda t: t != "")


def split_code_text(c) -> Column:
    """``code^text`` -> struct(code, text), split at the first caret."""
    parts = F.split(norm_ws(c), r"\^", 2)
    return F.struct(F.trim(parts[0]).alias("code"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("text"))


def safe_float(c) -> Column:
    """Strict decimal: optional sign, digits, optional fraction; anything else is missing."""
    t = F.translate(norm_ws(c), _WIDE_DIGITS, _DIGITS)
    return F.when(t.rlike(_STRICT_NUMBER), t.try_cast("double"))


def code_number(c) -> Column:
    """``safe_float`` of the code of a ``code^text`` cell; a cell that is a plain number skips the steps that leave it as it is."""
    return F.when(_col(c).rlike(_PLAIN_STRICT), _col(c).try_cast("double")).otherwise(safe_float(split_code_text(c)["code"]))


def to_float(c) -> Column:
    """Lenient number: exponents, bare fractions and infinities are accepted. A plain number skips the steps that leave it as it is."""
    t = F.regexp_replace(F.translate(strip(c), _WIDE_DIGITS, _DIGITS), r"(?<=[0-9])_(?=[0-9])", "")
    inf = F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return (F.when(_col(c).rlike(_PLAIN_FLOAT), _col(c).try_cast("double"))
            .when(t.rlike(_FLOAT), t.try_cast("double")).when(t.rlike(_INFINITE), inf))


def parsed_columns(df: DataFrame, columns: list[str], parse, keep) -> DataFrame:
    """(keep, columns) with every text cell parsed, as one expression over the row's cells: a hundred copies of it compile and run slowly."""
    cells = F.transform(F.array(*[F.col(c).cast("string") for c in columns]), parse)
    rows = df.select(*keep, cells.alias("_cells"))
    kept = [F.col(f"`{c}`") for c in rows.columns[:-1]]
    return rows.select(*kept, *[F.col("_cells")[i].alias(c) for i, c in enumerate(columns)])


def parse_duration(c) -> Column:
    """First unsigned number inside a text, in seconds."""
    return F.nullif(F.regexp_extract(strip(c), r"([0-9]+(\.[0-9]+)?)", 1), F.lit("")).try_cast("double")


def open_text_gibberish(c) -> Column:
    """1 when an open answer is a filler word, punctuation only or a 1-3 digit number."""
    t = norm_label(c)
    return (t.isin(FILLER_TOKENS) | t.rlike(_PUNCT_ONLY) | t.rlike(_SHORT_NUMBER)).cast("int")


def num_format(c, digits: int = 6, bare_integers: bool = True) -> Column:
    """Printed number: integers bare, other values with fixed decimals, missing blank."""
    v = _col(c).cast("double")
    text = F.format_string(f"%.{digits}f", v)
    if bare_integers:
        text = F.when(F.abs(v - F.rint(v)) < 1e-12, F.rint(v).cast("bigint").cast("string")).otherwise(text)
    return F.when(v.isNull() | F.isnan(v), F.lit("")).otherwise(text)


def term_parts(c) -> Column:
    """``C(C002)[T.3]`` -> struct(variable, level, is_dummy); other terms keep their name."""
    pattern = r"^C\((C[0-9]{3})\)\[T\.(.+)\]$"
    t = _col(c)
    hit = t.rlike(pattern)
    return F.struct(
        F.when(hit, F.regexp_extract(t, pattern, 1)).otherwise(t).alias("variable"),
        F.when(hit, F.regexp_replace(F.regexp_extract(t, pattern, 2), r"\.0", "")).alias("level"),
        hit.cast("int").alias("is_dummy"),
    )
