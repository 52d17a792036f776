"""Groups of copies and common passages cost rows in proportion to what they hold."""

import numpy as np
import pyarrow as pa
import pytest

from edgeloom.llm import near_copies, suffix_dedup
from tests.llm.test_near_crowds import classes, drawn
from tests.llm.test_operators import found_repeats, plain_repeats


def sets_of(texts):
    return [near_copies.shingles(t) for t in texts]


def near_pairs(sets):
    return [(i, j) for j in range(len(sets)) for i in range(j) if near_copies.is_near(sets[i], sets[j])]


def strange(count, words=60):
    return [" ".join(f"s{k}_{i}" for i in range(words)) for k in range(count)]


@pytest.mark.parametrize("texts", [drawn(200), drawn(60) + strange(40) + drawn(50, seed=9), strange(80) + drawn(6, seed=1), [t for k in range(60) for t in (drawn(60, seed=k)[0], drawn(60, seed=k)[1] + f" tail{k}")]])
def test_places_are_spanned(spark, monkeypatch, texts):
    monkeypatch.setattr(near_copies, "PLACE", 16)
    monkeypatch.setattr(near_copies, "HUBS", 2)
    sets = sets_of(texts)
    rows = [(1, k, len(s), s.tobytes()) for k, s in enumerate(sets)] + [(2, 1000 + k, len(s), s.tobytes()) for k, s in enumerate(sets[:5])]
    rows = spark.createDataFrame(rows, "group long, key long, n long, held binary")
    got = [(r["src"], r["dst"]) for r in near_copies.spanned(rows, 8, near_copies._by_sets).collect()]
    first, second = [p for p in got if p[0] < 1000], [(a - 1000, b - 1000) for a, b in got if a >= 1000]
    assert {tuple(sorted(p)) for p in first} <= set(near_pairs(sets)) and len(first) + len(second) == len(got)
    assert classes(len(sets), first) == classes(len(sets), near_pairs(sets))
    assert classes(5, second) == classes(5, near_pairs(sets[:5]))


def test_blocks_of_a_crowd_grow_with_its_nodes(spark, monkeypatch):
    """160 copies of one text in ten places: before, each went to nine blocks."""
    monkeypatch.setattr(near_copies, "PLACE", 16)
    dealt, blocks = [], near_copies._blocks
    monkeypatch.setattr(near_copies, "_blocks", lambda rows: dealt.append(rows.count()) or blocks(rows))
    body = [f"v{i}" for i in range(120)]
    sets = sets_of([" ".join([*body, f"tail{k}"]) for k in range(160)])
    rows = spark.createDataFrame([(1, k, len(s), s.tobytes()) for k, s in enumerate(sets)], "group long, key long, n long, held binary")
    got = [(r["src"], r["dst"]) for r in near_copies.spanned(rows, 8, near_copies._by_sets).collect()]
    assert set(classes(160, got)) == {0}
    assert sum(dealt) <= 160 + near_copies.HUBS * 10


@pytest.mark.parametrize("compared", [1 << 25, 100])
def test_crowds_are_settled_in_their_bucket(spark, monkeypatch, compared):
    """Members of crowds were given out once a variant: more than ten thousand rows for 300 texts. What is not settled in its bucket is settled elsewhere."""
    monkeypatch.setattr(near_copies, "COMPARED", compared)
    monkeypatch.setattr(near_copies, "PLACE", 64)
    members, written = [], near_copies.written

    def counted(df, tag="stage"):
        out = written(df, tag)
        if tag == "met":
            members.append(out.where("slot >= 0").count())
        return out

    monkeypatch.setattr(near_copies, "written", counted)
    texts = drawn(300)
    got = near_copies.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(classes(300, near_pairs(sets_of(texts)))))
    assert sum(members) == 0 if compared > 100 else sum(members) > 0


def test_forest_tells_what_it_has_not_compared():
    sets = sets_of(drawn(60) + strange(60))
    every = near_pairs(sets)
    near = lambda at, others: np.array([near_copies.is_near(sets[at], sets[k]) for k in others.tolist()], bool)
    for most in (1, 150, 1000, 3000, 10_000):
        a, b, rest = near_copies._forest(120, near, most)
        links = list(zip(a.tolist(), b.tolist(), strict=True))
        among = set(rest.tolist())
        assert classes(120, [*links, *[p for p in every if set(p) <= among]]) == classes(120, every)


def test_turned_in_parts_as_at_once():
    low = np.random.default_rng(5).integers(0, 1 << 9, 300).astype("<u4")
    odd = np.bitwise_count(low) % 2 == 1
    whole = sorted(zip(*(x.tolist() for x in near_copies.turned(low, odd, 9, 9, 0)), strict=True))
    parts = sorted(p for k in range(8) for p in zip(*(x.tolist() for x in near_copies.turned(low, odd, 9, 6, k)), strict=True))
    assert whole == parts and len(whole) == int(odd.sum()) * 9 + int((~odd).sum())


def test_a_sketch_goes_once_to_a_bucket():
    """Variants are turned where they meet: before, a text took 6 bytes for each."""
    bits, tables = near_copies.shape(256_410)
    bytes_a_row = (2 + 1) / 2 * (16 + 8 * near_copies.CHECKS)
    assert max(z - a for a, z in near_copies.passes(tables, 1)) * bytes_a_row <= near_copies.PASS
    assert len(near_copies.passes(tables, 1)) == 2


def test_a_common_passage_costs_a_row_a_text(spark, monkeypatch):
    """400 texts with one passage: a row for each place that its anchors were found at before."""
    rng = np.random.default_rng(2)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage = word(2000)
    rows = [(k, word(80) + passage + word(80)) for k in range(400)]
    kinds, keyed = {}, suffix_dedup.written_by_key

    def counted(df, *more):
        out = keyed(df, *more)
        kinds.update({r["kind"]: r["count"] for r in out.groupBy("kind").count().collect()})
        return out

    monkeypatch.setattr(suffix_dedup, "written_by_key", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_repeats(suffix_dedup.remove_repeats(docs)) == plain_repeats(rows)
    assert kinds[2] <= 2 * len(rows)


def test_marks_that_differ_in_their_highest_bit():
    """Counted as signed numbers, words that differ in all 64 bits differed in one."""
    marks = {c: [7, 7 - (1 << 63)] for c in near_copies._MARKS}
    near = near_copies._by_marks(pa.table({"n": [100, 100], **marks}))
    assert near(0, np.array([1])).tolist() == [True]
    far = near_copies._by_marks(pa.table({"n": [100, 100], **{c: [0, -1] for c in near_copies._MARKS}}))
    assert far(0, np.array([1])).tolist() == [False]
