"""Secret scans by corpus-wide ownership frequency.

Patterns give candidate spans. The hash of each candidate's value is counted over distinct repositories and owners of the whole
corpus: a value of several owners is a copied example, a value of one owner looks live. Spans of the base kinds stay whatever
their verdict; spans of the added kind `opaque` (long mixed tokens) count only if one owner has them.
DataFrame functions only. Counting goes (value, owner, repository) -> (value, owner) -> value, each a partial aggregate, so a
value that a third of all rows copy is a few rows by the last step.

A pattern's spans are placed by the lengths of the pieces between matches. Nulls and empty texts have no spans. Repeated rows
get one row each and count once (same owner and repository). A null owner or repository is a value of its own. An empty table
gives an empty result. Columns of docs named like the result stay: the result's name gets underscores.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pollmill.operators.skew import lookup

from .common import fresh, stored


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, the group that is the secret value, the least code points of that group, and whether spans stay whoever owns them."""
    name: str
    pattern: str
    group: int
    least: int
    base: bool = True
    also: tuple[str, ...] = ()


_KEYS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: In the order that spans of one start are listed. A run too short for access, hex or opaque can't hold one that is long enough,
#: so their lengths stand in the pattern; assign drops failing matches afterwards, as the scan goes on behind them.
KINDS = (
    Kind("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    Kind("hex", "[0-9a-f]{24,}", 0, 24),
    Kind("opaque", "[A-Za-z0-9+/_-]{20,}", 0, 20, False, ("[0-9]", "[a-z]", "[A-Z]")),
)

_PAIR = "array<struct<start:bigint,end:bigint,value:string>>"


def spans_of(text: Column, kind: Kind) -> Column:
    """array<struct<start, end, value>> of leftmost non-overlapping matches, those that fail dropped."""
    pattern = F.lit(kind.pattern)
    found = F.arrays_zip(F.transform(F.split(text, kind.pattern, -1), lambda p: F.length(p)).alias("gap"),
                         F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m)).alias("size"),
                         F.regexp_extract_all(text, pattern, F.lit(kind.group)).alias("value"))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.expr(f"cast(array() as {_PAIR})").alias("spans"))

    def step(s, m):
        start = s["at"] + m["gap"]
        end = start + m["size"]
        ok = F.length(m["value"]) >= kind.least
        for more in kind.also:
            ok = ok & m["value"].rlike(more)
        one = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), m["value"].alias("value")))
        return F.when(m["size"].isNull(), s).otherwise(F.struct(F.coalesce(end, s["at"]).cast("long").alias("at"), F.when(ok, F.concat(s["spans"], one)).otherwise(s["spans"]).alias("spans")))

    return F.when(text.rlike(kind.pattern), F.aggregate(found, state, step, lambda s: s["spans"])).otherwise(F.expr(f"cast(array() as {_PAIR})"))


def _ranked(spans: Column, rank: int, name: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(name).alias("kind"), s["end"].alias("end"),
                                                 F.sha2(s["value"], 256).alias("value_hash")))


def ownership(candidates: DataFrame) -> DataFrame:
    """(value_hash, owner, repo) rows to a row per value: n_owners, n_repos."""
    by_owner = candidates.distinct().groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"))


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id", copied_from: int = 2, kinds=KINDS, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """(docs' columns `keep` and an array of spans (start, rank, kind, end, n_owners, n_repos, live), by start and kind; its name).

    live: fewer than `copied_from` owners have the value. Offsets are code points, end exclusive.
    """
    out, row = fresh(docs, "secrets"), fresh(docs, "row")
    keep = docs.columns if keep is None else keep
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    raw = F.flatten(F.array(*(_ranked(spans_of(body, k), i, k.name) for i, k in enumerate(kinds))))
    own, rep = fresh(docs, "owner_key"), fresh(docs, "repo_key")
    # written once: the row number is then fixed, and texts are scanned once
    rows = stored(docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{owner}`").cast("string").alias(own), F.col(f"`{repo}`").cast("string").alias(rep), raw.alias(out))
                  .withColumn(row, F.monotonically_increasing_id()), "secrets")
    spans = rows.select(F.col(row).alias("row_id"), F.col(own).alias("owner"), F.col(rep).alias("repo"), F.inline(F.col(out)))
    # a value that a large share of the spans hold meets them by broadcast
    known = lookup(spans, stored(ownership(spans.select("value_hash", "owner", "repo")), "owners"), ["value_hash"])
    live, found = F.col("n_owners") < copied_from, fresh(rows, "secrets_found")
    base = F.array(*(F.lit(k.base) for k in kinds))
    kept = known.where(F.get(base, F.col("rank")) | live).groupBy("row_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "n_owners", "n_repos", live.alias("live")))).alias(found))
    both = rows.join(kept, rows[row] == kept["row_id"], "left")
    none = F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint,n_owners:bigint,n_repos:bigint,live:boolean>>)")
    return both.select(*(rows[f"`{c}`"] for c in keep), F.coalesce(F.col(found), none).alias(out)), out


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
