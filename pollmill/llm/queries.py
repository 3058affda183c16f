"""The thin queries op1_ to op13_: each applies its operator to the whole table and derives the asked columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import sql
from .common import table
from . import decontaminate, filter_audit, html_text, mixing, quality, resampling, secrets, simhash, substrings, token_store, toxicity, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(sql.CHECKS)


@_query
def op1_decontamination(spark, sf_dir):
    """Hits of the benchmark's windows in each document."""
    found, out = decontaminate.find_phrases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.col(f"{out}.items")
    return found.select("doc_id", f"{out}.n_words", f"{out}.n_hit", F.size(items).cast("long").alias("n_items"),
                        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), decontaminate.contaminated(out).alias("contaminated"))


@_query
def op2_quality_rules(spark, sf_dir):
    """The ledger of documents and the verdict of the newest policy."""
    book, out = quality.ledger(table(spark, sf_dir, "documents"), keep=["doc_id"])
    bits = F.col(f"{out}.failed_bits")
    base_ok, ok = quality.passes(bits, "v1"), quality.passes(bits, "v3")
    return book.select("doc_id", *(f"{out}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                       (~base_ok).alias("base_failed"), (base_ok & ok).alias("kept"), bits.alias("failed_bits"))


@_query
def op3_mixing(spark, sf_dir):
    """Cell, probability and draw of each document: given shares of languages and topics, sources by tokens ** 0.7."""
    goals = {"lang": [("en", 0.5), ("de", 0.18), ("es", 0.16), ("fr", 0.16)],
             "topic": [("general", 0.8), ("notice", 0.04), ("contact", 0.04), ("table", 0.04), ("figures", 0.04), ("web", 0.02), ("list", 0.01), ("questions", 0.01)]}
    targets = {m: spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(level).alias("level"), F.lit(share).alias("share")) for level, share in rows)))) for m, rows in goals.items()}
    rows, out = mixing.mix(table(spark, sf_dir, "documents"), targets=targets, keep=["doc_id"])
    return rows.select("doc_id", f"{out}.*")


@_query
def op4_substring_dedup(spark, sf_dir):
    rows, out = substrings.dedup(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("doc_id", f"{out}.n_words", f"{out}.n_removed", F.sha2(F.col(f"{out}.kept").cast("binary"), 256).alias("kept_sha256"))


@_query
def op5_secrets(spark, sf_dir):
    """Spans of secrets; owners are sources, repositories are documents."""
    rows, out = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    spans = F.col(out)
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["rank"] < 3)
    return rows.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                       F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(spans).alias("spans"),
                       F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"))


def token_rows(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    import public_tokenizers
    rows = token_store.store(docs, str(public_tokenizers.path("word_bpe_49k.json")), 2)
    return token_store.with_crc(rows, with_ids).withColumnRenamed("key", "doc_id")


@_query
def op6_token_store(spark, sf_dir):
    """Place, length and checksum of each document's ids, read from the written store."""
    return token_rows(table(spark, sf_dir, "documents"))


@_query
def op7_html_text(spark, sf_dir):
    rows, out = html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return rows.select("page_id", "url", f"{out}.text", F.length(f"{out}.text").cast("long").alias("n_chars"))


@_query
def op8_warc(spark, sf_dir):
    """What the normalised archives of pages say of each record."""
    rows = warc.read_records(warc.archive(table(spark, sf_dir, "pages")))
    return rows.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@_query
def op9_simhash(spark, sf_dir):
    rows, out = simhash.near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select("doc_id", F.lower(F.lpad(F.hex(f"{out}.fingerprint"), 16, "0")).alias("fingerprint"), F.col(f"{out}.first_id").alias("component_id"))


@_query
def op10_toxicity(spark, sf_dir):
    rows, out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return rows.select("doc_id", f"{out}.held_out", f"{out}.score", (F.col(f"{out}.score") >= 0.7).cast("int").alias("predicted"))


@_query
def op11_importance_resampling(spark, sf_dir):
    """Weight, score and rank of each document towards the benchmark's words."""
    rows, out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return rows.select("doc_id", *(f"{out}.{c}" for c in ("n_features", "weight", "score", "rank")))


@_query
def op12_filter_audit(spark, sf_dir):
    """All orders of the five filters, per source."""
    return filter_audit.audit(filter_audit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


@_query
def op13_url_filter(spark, sf_dir):
    """Verdicts on urls. A page shows the document whose id ends its path: that document's label is the page's outcome (bad: low quality or toxic)."""
    labels = table(spark, sf_dir, "labels")
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    outcomes = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").select(F.col("doc_id").alias("key"), bad.alias("bad"))
    shown = F.regexp_extract(url_filter.path_of(F.col("url")), "([0-9]+)[^0-9/]*/?$", 1).try_cast("bigint")
    rows, out = url_filter.judge(table(spark, sf_dir, "pages"), outcomes, key=shown, keep=["page_id"])
    return rows.select("page_id", *(f"{out}.{c}" for c in ("host", "path", "rule", "verdict", "n_outcomes", "n_bad")), F.round(f"{out}.low", 6).alias("bad_low"))
