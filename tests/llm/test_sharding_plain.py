"""Label propagation against a plain version, and on a hot text."""

import numpy as np

from edgeloom.llm import sharding


def plain(units, quota, shards, rounds, draw):
    """The rounds of ``propagated`` on lists: units are [text, lane, size, group_size, copies, shard]."""
    units = [list(u) for u in units]
    for turn in range(rounds):
        held = [sum(u[2] for u in units if u[5] == s) for s in range(shards)]
        room = [max(0.0, quota - h) for h in held]
        weight = {}
        for u in units:
            weight[u[0], u[5]] = weight.get((u[0], u[5]), 0) + u[2]
        best = {}
        for (t, s), w in sorted(weight.items(), key=lambda x: (-x[1], x[0][1])):
            if room[s] >= sharding.FULL * quota:
                best.setdefault(t, (s, w))
        asks = []
        for u in units:
            s, w = best.get(u[0], (None, 0))
            own, closed = weight[u[0], u[5]], room[u[5]] < sharding.FULL * quota
            asks.append(s is not None and (w > own or w == own and (s < u[5] or closed)))
        wanted = [sum(u[2] for u, a in zip(units, asks, strict=True) if a and best[u[0]][0] == s) for s in range(shards)]
        moved = False
        for u, a in zip(units, asks, strict=True):
            if a:
                s = best[u[0]][0]
                if draw(u, turn) < min(1.0, room[s] / wanted[s]):
                    u[5], moved = s, True
        if not moved:
            break
    return {(u[0], u[1]): u[5] for u in units}


def test_rounds_equal_the_plain_ones(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    rows = []
    for t in range(40):
        lanes = 60 if t == 0 else int(rng.integers(2, 6))
        sizes = rng.integers(5, 50, lanes)
        rows += [(f"t{t}", k, int(x), int(sizes.sum()), 1, int(rng.integers(0, 4))) for k, x in enumerate(sizes)]
    schema = "text_key string, lane int, size long, group_size long, copies long, shard int"
    units, quota = spark.createDataFrame(rows, schema), sum(r[2] for r in rows) / 4 * 1.05
    turns = range(30)
    drawn = units.select("text_key", "lane", *[sharding._unit("text_key", "lane", F.lit(k)).alias(f"u{k}") for k in turns], *[sharding._unit("text_key", F.lit(k)).alias(f"g{k}") for k in turns]).collect()
    at = {(r["text_key"], r["lane"]): r for r in drawn}
    draw = lambda u, k: at[u[0], u[1]][f"u{k}" if u[3] > quota / 8 else f"g{k}"]
    got = sharding.propagated(units, quota, 4, 30)
    assert {(r["text_key"], r["lane"]): r["shard"] for r in got.collect()} == plain(rows, quota, 4, 30, draw)
    assert sharding.cut_links(got) < sharding.cut_links(units) / 2


def test_a_hot_text_fills_few_shards(spark):
    rows = [(i, "hot") for i in range(6000)] + [(10_000 + i, f"pair {i // 2}") for i in range(6000)] + [(30_000 + i, f"single {i}") for i in range(6000)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = np.bincount([r["shard"] for r in got], [r["size"] for r in got], 16)
    assert held.max() <= 1.02 * held.mean()
    hot = np.sort(np.bincount([r["shard"] for r in got if r["doc_id"] < 10_000], minlength=16))[::-1]
    per = held.mean() / 4  # copies of the hot text that one shard holds
    assert hot[: int(np.ceil(6000 / per)) + 2].sum() >= 0.9 * 6000
    pairs = {}
    for r in got:
        if 10_000 <= r["doc_id"] < 20_000:
            pairs.setdefault(r["text_key"], set()).add(r["shard"])
    assert np.mean([len(x) > 1 for x in pairs.values()]) < 0.02
