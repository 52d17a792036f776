"""Crowds of texts that resemble each other more or less: few links, all components."""

import numpy as np

from edgeloom.llm import near_copies


def drawn(count, words=80, seed=3):
    """Texts that have 0 to 5 of the 80 words of one body replaced."""
    draw = np.random.default_rng(seed)
    body = np.array([f"v{i}" for i in range(words)], object)
    out = []
    for k in range(count):
        mine = body.copy()
        for at in draw.choice(words, int(draw.integers(0, 6)), replace=False):
            mine[at] = f"x{k}_{at}"
        out.append(" ".join(mine))
    return out


def classes(count, links):
    root = list(range(count))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        low, high = sorted((find(int(a)), find(int(b))))
        root[high] = low
    return [find(x) for x in range(count)]


def test_forest_has_the_components_of_all_pairs():
    sets = [near_copies.shingles(t) for t in drawn(150)]
    every = [(i, j) for j in range(len(sets)) for i in range(j) if near_copies.is_near(sets[i], sets[j])]
    a, b = near_copies.near_forest(sets)
    found = list(zip(a.tolist(), b.tolist(), strict=True))
    assert {tuple(sorted(p)) for p in found} <= set(every)
    assert classes(150, found) == classes(150, every)
    assert len(found) == 150 - len(set(classes(150, every))) < len(every)


def test_blocks_hold_every_pair(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "PLACES", 3)
    rows = spark.createDataFrame([(1, k, 5) for k in range(40)] + [(2, k, 5) for k in range(3)], "group long, key long, n long")
    blocks = {}
    for r in near_copies.in_blocks(rows, 8).collect():
        blocks.setdefault((r["group"], r["lo"], r["hi"]), set()).add(r["key"])
    met = {(g, i, j) for (g, _, _), keys in blocks.items() for i in keys for j in keys if i < j}
    assert met == {(1, i, j) for j in range(40) for i in range(j)} | {(2, i, j) for j in range(3) for i in range(j)}
    assert len([b for b in blocks if b[0] == 1]) == 3 and len([b for b in blocks if b[0] == 2]) == 1


def test_no_step_lists_the_pairs_of_a_crowd(spark, monkeypatch):
    sizes, written = {}, near_copies.written

    def counted(df, tag="stage"):
        out = written(df, tag)
        sizes[tag] = max(sizes.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(near_copies, "written", counted)
    texts = drawn(160)
    got = near_copies.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = [near_copies.shingles(t) for t in texts]
    every = [(i, j) for j in range(len(sets)) for i in range(j) if near_copies.is_near(sets[i], sets[j])]
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(classes(160, every)))
    assert max(n for tag, n in sizes.items() if tag not in ("met",)) <= 2 * len(texts) < len(every)
