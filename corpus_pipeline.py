"""The training-data pipeline: each stage takes what the one before kept, as documents, and the last writes token ids.

Nulls, empty texts, repeated rows and further columns are as the operators of pollmill/llm define; stages but the last
return the columns of documents as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pollmill.llm import decontaminate, mixing, quality, queries, simhash, token_store
from pollmill.llm.common import stored, table

#: SQL has no XXH64, no suffix arrays and no tokenizer: tests hold every stage against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the newest policy keeps."""
    book, out = quality.ledger(docs)
    return book.where(quality.passes(F.col(f"`{out}`.failed_bits"), "v3")).select(*(book[f"`{c}`"] for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the smallest id."""
    return simhash.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with windows of benchmark items."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics come near their target shares."""
    return mixing.sample(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of what is left, read back: doc_id, start, n_tokens, ids_crc32, ids."""
    return queries.token_rows(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
