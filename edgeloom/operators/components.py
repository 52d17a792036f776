"""Connected components by alternating large-star and small-star steps.

Each step keeps at most one row per edge and points every vertex at a smaller
one of its neighbourhood; the label of a component is its smallest vertex. The
minimum per vertex is a partial aggregate, so a hub costs its map tasks one row
each, and the join back is one that skew handling can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.plans.durable import forget, written

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger vertex to the smaller one."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    onward = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return onward.unionAll(low.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a") % 65537), F.sum(F.col("b") % 65537)).head()


def connected_components(links: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """id, comp for every vertex of ``links`` (longs; direction, loops, nulls and repeats do not matter)."""
    raw = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    raw = written(raw.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    alone = raw.where("a = b").select(F.col("a").alias("id"))
    edges = raw.where("a <> b")
    mark = _mark(edges)
    for _ in range(MAX_ROUNDS):
        turned = written(_small_star(_large_star(edges)), "star")
        new = _mark(turned)
        forget(edges)
        edges = turned
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    members = edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    roots = edges.select(F.col("b").alias("id")).unionAll(alone).distinct()
    rest = roots.join(members.select("id"), "id", "left_anti").select("id", F.col("id").alias("comp"))
    return members.unionAll(rest)
