"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations only read bits.

`ledger` makes, in one pass over the texts, the measurements of every document and the bits of the rules that it fails.
A policy is a version and the rules that it uses; `apply_policy` is one bitwise AND, so a new policy needs no new pass.
`ablation` first counts documents per distinct bit pattern (at most 2 ** rules, a partial aggregate, whatever the skew) and
derives what each rule of each policy does alone from those counts.

Nulls and empty texts have no words: all measurements are 0, rules on shares don't apply, too_few_words fails. Repeated
rows and ties get the same result each. An empty table gives an empty ledger. Columns of docs that are named like the
result stay: the result's name gets underscores (`common.fresh`).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, over_texts, struct, words

_SYMBOL = re.compile(rb"[^#*$%&|<>]+")
_MEASURES = struct(
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_upper bigint, n_letters bigint, n_symbol_words bigint, n_stutter bigint"
)
_UPPER = bytes(x for x in range(256) if not 65 <= x <= 90)
_LETTER = bytes(x for x in range(256) if not (65 <= x <= 90 or 97 <= x <= 122 or x >= 0xC0))
_NOT_START = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Rule:
    """name, and a SQL condition on the measurements that is true where a document fails; integers only, so every engine agrees."""
    name: str
    fails: str


#: In this order the rules are bits 0, 1, 2 ... of the ledger. Add at the end only: stored bits keep their meaning.
RULES = (
    Rule("too_few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("upper_case", "n_letters >= 40 AND 10 * n_upper > 6 * n_letters"),
    Rule("symbol_words", "10 * n_symbol_words > 5 * n_words"),
    Rule("stutter", "2 * n_stutter > n_words"),
)
#: Version -> rules that reject. base is what every policy has.
BASE = ("too_few_words", "repeated_windows")
POLICIES: Mapping[str, Sequence[str]] = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "upper_case"),
    "v3": tuple(r.name for r in RULES),
}


def repeat_mask(doc: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a window of n words (a power of 2) that its own document has twice or more.

    Exact: the windows of 2, 4, 8 ... words are numbered by the pair of numbers of their halves.
    """
    name, width = ids, 1
    while width < n:
        if len(name) <= width:
            return np.zeros(len(ids), bool)
        _, name = np.unique(name[:-width] << 32 | name[width:], return_inverse=True)
        width *= 2
    inside = doc[: len(name)] == doc[n - 1:]
    at = np.flatnonzero(inside)
    _, which, count = np.unique(doc[at] << 32 | name[at], return_inverse=True, return_counts=True)
    again = at[count[which] > 1]
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, again, 1)
    np.add.at(step, again + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(texts: list[bytes | None], window: int = 8) -> list[np.ndarray]:
    """The fields of the measurements, one value a text."""
    names: dict[bytes, int] = {}
    number = names.setdefault
    out, ids, sizes = [], [], []
    for t in texts:
        t = t or b""
        w = words(t)
        sizes.append(len(w))
        ids.append(np.fromiter((number(x, len(names)) for x in w), np.int64, len(w)))
        lines = [x for x in t.split(b"\n") if x.strip()]
        marks = len(_SYMBOL.sub(b"", t))
        out.append((len(w), len(b"".join(w).translate(None, _NOT_START)), marks, len(lines) - len(set(lines)), 0, len(lines),
                    len(t.translate(None, _UPPER)), len(t.translate(None, _LETTER)), sum(bool(x.strip(b"#*$%&|<>") != x) for x in w) if marks else 0,
                    int((ids[-1][1:] == ids[-1][:-1]).sum())))
    rows = np.array(out, np.int64).reshape(-1, len(_MEASURES.names))
    doc = np.repeat(np.arange(len(texts)), sizes)
    if len(doc):
        rows[:, 4] = np.bincount(doc, repeat_mask(doc, np.concatenate(ids), window), len(texts)).astype(np.int64)
    return list(rows.T)


def ledger(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """(docs' columns `keep` and the ledger's struct: measurements and failed_bits; the struct's name)."""
    import pyarrow as pa

    out = fresh(docs, "ledger")
    measured = over_texts(docs, text, out, _MEASURES, lambda t: [pa.array(c) for c in measure(t)], keep)
    fields = {n: F.col(f"`{out}`.{n}") for n in _MEASURES.names}
    bits = sum((F.when(_on(r.fails, out), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)), F.lit(0).cast("long"))
    return measured.withColumn(out, F.struct(*(c.alias(n) for n, c in fields.items()), bits.alias("failed_bits"))), out


def _on(condition: str, out: str) -> Column:
    return F.expr(re.sub(r"\b(n_\w+|word_chars)\b", rf"`{out}`.\1", condition))


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    known = [r.name for r in rules]
    return sum(1 << known.index(n) for n in set(names))


def passes(bits: Column, version: str, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES) -> Column:
    """True where no rule of the policy failed."""
    return bits.bitwiseAND(F.lit(mask(policies[version], rules)).cast("long")) == 0


def ablation(book: DataFrame, bits: str = "failed_bits", policies: Mapping[str, Sequence[str]] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per policy and rule: documents that fail the rule, that it alone rejects, and that the policy without it would keep."""
    spark = book.sparkSession
    counts = book.groupBy(F.col(bits).alias("bits")).agg(F.count("*").alias("n"))
    plan = spark.createDataFrame([(v, n, mask(names, rules), mask([n], rules)) for v, names in policies.items() for n in names],
                                 "policy string, rule string, policy_mask bigint, rule_mask bigint")
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    hit = F.col("bits").bitwiseAND(F.col("policy_mask"))
    one = F.col("bits").bitwiseAND(F.col("rule_mask")) != 0
    # plan has one row a policy and rule, so each count meets a fixed number of rows
    return (counts.withColumn("plan", F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in plan.columns)) for r in plan.collect())))
            .select("bits", "n", F.inline("plan")).groupBy("policy", "rule")
            .agg(some(one).alias("n_failed"), some(one & (hit == F.col("rule_mask"))).alias("n_only_this"),
                 some(hit.bitwiseAND(F.bitwise_not("rule_mask")) == 0).alias("n_kept_without"), some(hit == 0).alias("n_kept")))
