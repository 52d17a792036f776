"""The pipeline's near-copy stage against all pairs of five-word shingle sets."""

import os

import pytest

import corpus_pipeline
from edgeloom.llm import near_copies
from tests.llm.test_operators import pairs

TABLES = "/root/testdata/sf0.001"


def plain_shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(docs):
    """Ids that stay: the smallest of each component over all pairs."""
    docs = sorted(docs)
    sets, root = [plain_shingles(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(docs)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {docs[i][0] for i in range(len(docs)) if find(i) == i}


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_near_copies_of_a_table_go(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, TABLES)
    assert {r["doc_id"] for r in got.collect()} == plain_kept(pairs(docs))


def test_similarity_decides(spark):
    words = [f"w{i}" for i in range(200)]
    cut = lambda n: " ".join(words[:n])  # noqa: E731  a prefix of n words has n - 4 of the 196 shingles
    rows = [(1, " ".join(words)), (2, cut(161)), (3, " ".join(words).upper()), (4, cut(160)[::-1]), (5, None), (6, " \n"), (None, cut(180))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, None: 1}
    apart = spark.createDataFrame([(1, " ".join(words)), (2, cut(160))], docs.schema)  # 156 of 196 shingles
    assert [r["component_id"] for r in near_copies.near_duplicates(apart).orderBy("doc_id").collect()] == [1, 2]


def test_crowds_are_starred(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CROWD", 3)
    body = [f"v{i}" for i in range(120)]
    rows = [(k, " ".join([*body, f"tail{k}"])) for k in range(40)]
    got = near_copies.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_rows_decide_not_ids(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, text("z")), (2, text("z") + " more"), (2, text("b")), (2, text("a")), (None, text("n")), (None, text("n")), (None, text("z")), (3, text("q")), (3, text("q"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((str(r["doc_id"]), r["text"][0]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == [("1", "z"), ("2", "a"), ("2", "b"), ("3", "q"), ("None", "n")]
