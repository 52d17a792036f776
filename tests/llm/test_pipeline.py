"""The stages one by one against plain versions, and the whole run."""

import os

import pytest

import corpus_pipeline
from edgeloom.llm import decontaminate, registry

TABLES = "/root/testdata/sf0.001"


def test_stages_keep_columns_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        out = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, TABLES)
            assert out.columns == corpus_pipeline.COLUMNS
        assert corpus_pipeline.STAGES[-1][1](spark, out, TABLES).count() >= 0


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_decisions_take_effect(spark, odd_docs):
    from tests.llm.test_operators import plain_components, plain_fingerprint, plain_repeats

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    seen = stages["language_id"](spark, docs, TABLES)
    assert seen.count() == docs.count()
    assert {r["doc_id"] for r in stages["language_id"](spark, odd_docs, TABLES).collect()} == {1, 2, 6, 7, 8, 9, None}
    rows = sorted((r["doc_id"], r["text"]) for r in seen.collect())
    comp = plain_components([plain_fingerprint(t) for _, t in rows])
    near = stages["near_dedup"](spark, seen, TABLES)
    assert {r["doc_id"] for r in near.collect()} == {rows[c][0] for c in comp}
    want = plain_repeats([(r["doc_id"], r["text"]) for r in near.collect()])
    cut = stages["suffix_dedup"](spark, near, TABLES)
    assert {r["doc_id"] for r in cut.collect()} == {d for d, s in want.items() if any(n > g or not n for n, g, _, _ in s)}
    bad = {r["doc_id"] for r in decontaminate.overlaps(cut, spark.read.parquet(f"{TABLES}/benchmark.parquet")).collect()}
    left = stages["decontaminate"](spark, cut, TABLES)
    assert {r["doc_id"] for r in left.collect()} == {r["doc_id"] for r in cut.collect()} - bad


def test_registry_names():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{k}" for k in range(1, 11)} | {"pipeline"}
