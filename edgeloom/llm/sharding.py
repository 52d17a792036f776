"""Balanced label propagation: linked documents move to their neighbours' shard under byte quotas.

Documents with equal texts are linked through a node for their text, so a
group of k copies has k links, not k squared. Copies are first added up by text
and one of ``LANES`` lanes (a hash of doc_id), and lanes are what moves: a text
with a third of all rows has ``LANES`` rows from there on and no key is hot.

Each round counts, per text node, the bytes that every shard holds, proposes
the fullest shard that still has room to the lanes of that text which stand
where less of it is (or as much, but no room for more), and accepts as many moves as the quota has room for. Lanes
of a text that is larger than an eighth of a quota are accepted one by one, all
others as a group. Rounds end when one moves nothing (or after ``rounds``; a
move only ever brings more of a text together, so this is a matter of time).
Unlinked documents level the shards at the end by a running sum.

Defined results: a null text counts as empty (size 1, crc 0); null and
repeated doc_ids keep their rows (rows that share doc_id and text may change
places with each other); shards that tie are taken by number; a text of any
length is one row; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from edgeloom.plans.durable import forget, written
from edgeloom.plans.ranking import buckets_for, global_row_number, running_offsets

LAW = "bytes"
LANES = 128
FULL = 0.002  # of a quota: a shard with less room takes part no more


def _unit(*cols):
    """A number in [0, 1) fixed by the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _by_shard(df: DataFrame, shards: int) -> list[int]:
    rows = df.groupBy("shard").agg(F.sum("size").alias("w")).collect()  # a row per shard
    held = [0] * shards
    for r in rows:
        held[r["shard"]] = int(r["w"])
    return held


def _level(held: list[int], extra: int) -> list[int]:
    """Room per shard so that filling it evens the shards and uses up ``extra``."""
    order = sorted(range(len(held)), key=lambda s: (held[s], s))
    level, used = held[order[0]], 0
    for k in range(1, len(order) + 1):
        nxt = held[order[k]] if k < len(order) else None
        need = None if nxt is None else (nxt - level) * k
        if need is None or used + need >= extra:
            left = extra - used
            base, odd = divmod(left, k)
            room = [0] * len(held)
            for i, s in enumerate(order[:k]):
                room[s] = level + base + (i < odd) - held[s]
            return room
        used, level = used + need, nxt
    raise AssertionError("unreachable")


def _fill(pool: DataFrame, room: list[int]) -> DataFrame:
    """Gives each row the shard in whose room the running sum of sizes falls."""
    sums = running_offsets(pool.groupBy("_b").agg(F.sum("size").alias("w")), [], "_b", "w", "before").select("_b", "before")
    inside = Window.partitionBy("_b").orderBy("doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    pool = pool.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, "_b")
    at, ends, end = F.col("before") + F.col("_in"), [], 0
    for s, r in enumerate(room):
        end += r
        if r:
            ends.append((s, end))
    where = F.lit(ends[-1][0])
    for s, e in reversed(ends):
        where = F.when(at < e, F.lit(s)).otherwise(where)
    return pool.withColumn("shard", where.cast("int"))


def cut_links(units: DataFrame) -> int:
    """Links to a text node whose document stands outside the shard that holds most of the text."""
    per = units.groupBy("text_key", "shard").agg(F.sum("copies").alias("c")).groupBy("text_key").agg((F.sum("c") - F.max("c")).alias("cut"))
    return int(per.agg(F.coalesce(F.sum("cut"), F.lit(0))).head()[0])


def propagated(units: DataFrame, quota: float, shards: int, rounds: int) -> DataFrame:
    """Written table of ``units`` (text_key, lane, size, group_size, copies, shard) after rounds of propagation."""
    units = written(units, "units")
    for turn in range(rounds):
        held = _by_shard(units, shards)
        room = [max(0.0, quota - h) for h in held]
        is_open = F.col("shard").isin(*[s for s in range(shards) if room[s] >= FULL * quota])
        votes = units.groupBy("text_key", "shard").agg(F.sum("size").alias("w"))
        best = votes.where(is_open).groupBy("text_key").agg(F.max(F.struct("w", (-F.col("shard")).alias("s"))).alias("m")).select("text_key", (-F.col("m.s")).cast("int").alias("best"), F.col("m.w").alias("best_w"))
        asked = units.join(best, "text_key", "left").join(votes.withColumnRenamed("w", "own_w"), ["text_key", "shard"])
        nearer = (F.col("best_w") > F.col("own_w")) | (F.col("best_w") == F.col("own_w")) & ((F.col("best") < F.col("shard")) | ~is_open)
        asked = written(asked.withColumn("asks", F.coalesce(nearer, F.lit(False))).drop("best_w", "own_w"), "asked")
        wanted = {r["best"]: r["w"] for r in asked.where("asks").groupBy("best").agg(F.sum("size").alias("w")).collect()}  # a row per shard
        share = [min(1.0, room[s] / wanted[s]) if wanted.get(s) else 0.0 for s in range(shards)]
        fits = F.element_at(F.array(*[F.lit(x) for x in share]), F.col("best") + 1)
        draw = F.when(F.col("group_size") > quota / 8, _unit("text_key", "lane", F.lit(turn))).otherwise(_unit("text_key", F.lit(turn)))
        moves = F.col("asks") & (draw < fits)
        moved = written(asked.select("text_key", "lane", "size", "group_size", "copies", F.when(moves, F.col("best")).otherwise(F.col("shard")).alias("shard"), moves.alias("moved")), "units")
        forget(units)
        forget(asked)
        done = moved.where("moved").isEmpty()
        units = moved
        if done:
            break
    return units


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = 30) -> DataFrame:
    """doc_id, size, text_crc32, text_key, shard, slot, linked (has a neighbour)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    nodes = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("text_key"),
            F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(7)), F.lit(LANES)).cast("int").alias("lane"),
        ),
        "nodes",
    )
    rows, total = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).head()
    n_buckets, quota = buckets_for(rows), total / shards
    lanes = written(nodes.groupBy("text_key", "lane").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("copies")), "lanes")
    groups = lanes.groupBy("text_key").agg(F.sum("copies").alias("all_copies"), F.sum("size").alias("group_size")).where("all_copies > 1").select("text_key", "group_size")
    home = F.pmod(F.xxhash64("text_key", "lane"), F.lit(shards)).cast("int")
    units = propagated(lanes.join(groups, "text_key").withColumn("shard", home), quota, shards, rounds)
    named = nodes.join(units.select("text_key", "lane", F.col("shard")), ["text_key", "lane"], "left")
    named = written(named.select("doc_id", "size", "text_crc32", "text_key", "shard"), "named")
    linked, singles = named.where("shard is not null"), named.where("shard is null").drop("shard")

    # A shard that holds more than its quota gives single documents back to the pool.
    held = _by_shard(linked, shards)
    shed = [max(0.0, (h - quota) / h) if h else 0.0 for h in held]
    stays = _unit("doc_id", "text_key", F.lit("shed")) >= F.element_at(F.array(*[F.lit(x) for x in shed]), F.col("shard") + 1)
    cols = ["doc_id", "size", "text_crc32", "text_key"]
    kept = linked.where(stays).select(*cols, "shard", F.lit(True).alias("linked"))
    pool = singles.withColumn("linked", F.lit(False)).unionByName(linked.where(~stays).select(*cols).withColumn("linked", F.lit(True)))

    # Large documents first, small ones last: the shards differ by a small document at most.
    bucket = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(n_buckets)).cast("int")
    pool = written(pool.withColumn("_b", bucket), "pool")
    held, mean, placed = _by_shard(kept, shards), total / max(rows, 1), kept
    bands = [(mean, None), (mean / 8, mean), (None, mean / 8)]
    for low, high in bands:
        part = pool
        if low is not None:
            part = part.where(F.col("size") > low)
        if high is not None:
            part = part.where(F.col("size") <= high)
        extra = int(part.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0])
        if not extra:
            continue
        dealt = written(_fill(part, _level(held, extra)).select(*cols, "shard", "linked"), "dealt")
        placed = placed.unionByName(dealt)
        held = [x + y for x, y in zip(held, _by_shard(dealt, shards), strict=True)]
    placed = placed.withColumn("_b", bucket)
    return global_row_number(placed, "slot", ["doc_id", "text_key"], ["shard"]).drop("_b")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shard_documents(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")
