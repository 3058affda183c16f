"""The registered queries: check SQL where there is some, and the pipeline stage by stage."""

import re

import pytest
from compare import connect, differences

import corpus_pipeline
from pollmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(queries.oracle_sql()))
def test_check(spark, key):
    assert differences(queries.queries()[key](spark, SF), connect(SF), queries.oracle_sql()[key]) == ""


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules"
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = {r.doc_id for r in docs.collect()}
        assert kept <= before
        before = kept
    assert set(out) == before
    assert [r.start for r in sorted(out.values(), key=lambda r: r.doc_id)] == [sum(out[k].n_tokens for k in out if k < d) for d in sorted(out)]
    assert all(r.n_tokens == len(r.ids) and r.ids[-1] == 2 for r in out.values())
    assert re.match("5|4", str(len(corpus_pipeline.STAGES)))
