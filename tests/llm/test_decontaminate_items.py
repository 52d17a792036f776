"""Benchmark items without an item_id, and short ones with substituted words."""

from itertools import combinations
from math import ceil

from edgeloom.llm import decontaminate


def test_items_without_an_id_are_found(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "before " + item + " after"), (2, "nothing of the kind stands in here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, item), (7, "some other words than those " * 4)], "item_id long, text string")
    for bound in (decontaminate.BROADCAST_BYTES, -1):
        assert [(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs, items, bound).collect()] == [(1, None)]


def test_masks_meet_every_pattern():
    for n in range(5, 21):
        masks = decontaminate.MASKS + (decontaminate.SHORT_MASKS if n < decontaminate.SHORT else ())
        for lost in combinations(range(n), n - ceil(n * decontaminate.SHARE)):
            assert any(not {at + o for o in m} & set(lost) for m in masks for at in range(n - m[-1])), (n, lost)


def test_short_items_with_a_substituted_word_are_found(spark):
    words = "alpha beta gamma delta epsilon".split()
    texts = [" ".join(["lead", *words[:i], "other", *words[i + 1 :], "tail"]) for i in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    for bound in (decontaminate.BROADCAST_BYTES, -1):
        assert {r["doc_id"] for r in decontaminate.overlaps(docs, items, bound).collect()} == set(range(5))
