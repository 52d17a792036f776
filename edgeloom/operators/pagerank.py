"""Edge-centric PageRank with a fixed number of rounds and without redistribution of dangling mass."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.simplify import Graph
from edgeloom.plans.durable import forget, written

ROUNDS, DAMPING = 20, 0.85
CUT_EVERY = 5
SENT_TO_ALL = 1_000_000  # scores (16 bytes each) that are broadcast; more are joined where the edges lie
HUB = 200_000  # out-edges of a source that one task takes


def _sent_by_join(edges: DataFrame, out: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Edges dealt once by source, a hub's edges in several places, and how scores get there."""
    places = F.ceil(F.col("k") / HUB)
    edges = edges.withColumn("salt", F.pmod(F.xxhash64("dst"), F.ceil(1 / (F.col("w") * HUB)).cast("long")).cast("int")).repartition("src", "salt").persist()
    hubs = F.broadcast(out.where(F.col("k") > HUB).select(F.col("src").alias("id"), places.cast("int").alias("places")))  # at most edges / HUB rows

    def spread(scores: DataFrame) -> DataFrame:
        placed = scores.join(hubs, "id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("places", F.lit(1)) - 1)))
        return edges.join(placed.select(F.col("id").alias("src"), "score", "salt"), ["src", "salt"])

    return edges, spread


def pagerank(g: Graph, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """id, score. Edges carry 1 / out-degree and stay where they are over all rounds; a round shuffles partial sums by target only."""
    n = g.vertices.count()
    out = g.edges.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    edges = g.edges.join(out, "src").select("src", "dst", (F.lit(1.0) / F.col("k")).alias("w"))
    if n <= SENT_TO_ALL:
        edges = edges.persist()
        spread = lambda scores: edges.join(F.broadcast(scores.withColumnRenamed("id", "src")), "src")
    else:
        edges, spread = _sent_by_join(edges, out)
    scores = g.vertices.select("id", F.lit(1.0 / n if n else 0.0).alias("score"))
    none = g.vertices.select("id", F.lit(0.0).alias("got"))
    base, last = (1 - damping) / n if n else 0.0, None
    for turn in range(1, rounds + 1):
        sent = spread(scores).select(F.col("dst").alias("id"), (F.col("score") * F.col("w")).alias("got"))
        scores = sent.unionByName(none).groupBy("id").agg((F.lit(base) + damping * F.sum("got")).alias("score"))
        if turn % CUT_EVERY == 0 or turn == rounds:
            scores = written(scores, "scores")
            if last is not None:
                forget(last)
            last = scores
    edges.unpersist()
    return scores


def normalized(scores: DataFrame) -> DataFrame:
    """Scores divided by their sum."""
    total = scores.agg(F.sum("score").alias("t"))
    return scores.crossJoin(F.broadcast(total)).select("id", (F.col("score") / F.col("t")).alias("score"))  # total: one row


def unpermuted(scores: DataFrame, ordering: DataFrame) -> DataFrame:
    """Scores of new ids as scores of the ids they stand for."""
    return scores.join(ordering.select(F.col("id").alias("_o"), F.col("new_id").alias("id")), "id").select(F.col("_o").alias("id"), "score")


def agrees(a: DataFrame, b: DataFrame, within: float = 1e-4) -> DataFrame:
    """One row: valid (1 if all scores lie within the tolerance)."""
    other = b.select("id", F.col("score").alias("_b"))
    return a.join(other, "id", "full_outer").agg(F.coalesce(F.bool_and(F.abs(F.col("score") - F.col("_b")) < within), F.lit(True)).cast("int").alias("valid"))


def spmv(edges: DataFrame, vector: DataFrame) -> DataFrame:
    """id, value of A x for x (id, value); rows without entries are absent."""
    return edges.join(vector.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("value").alias("value"))


def experiments(g: Graph, orderings: dict[str, DataFrame], edge_orders: list[str], rounds: int = ROUNDS, repeats: int = 1) -> DataFrame:
    """A row per (vertex order, edge order, repeat): edges, milliseconds of the rounds alone, valid (1 if all scores agree with the plain run)."""
    from edgeloom.operators.curves import ordered
    from edgeloom.operators.simplify import apply_ordering

    spark, n, truth, rows = g.edges.sparkSession, g.n(), written(pagerank(g, rounds), "truth"), []
    for name, order in orderings.items():
        order = written(order.select("id", "new_id"), "order")
        moved = written(apply_ordering(g.edges, order), "moved")
        vertices = order.select(F.col("new_id").alias("id"), F.col("id").alias("orig_id"))
        for edge_order in edge_orders:
            edges = written(ordered(moved, edge_order, n).select("src", "dst"), "sorted")
            for repeat in range(repeats):
                began = time.perf_counter()
                scores = pagerank(Graph(edges, vertices), rounds)
                took = (time.perf_counter() - began) * 1000
                valid = agrees(truth, unpermuted(scores, order)).head()["valid"]
                rows.append((name, edge_order, repeat, edges.count(), took, valid))
    return spark.createDataFrame(rows, "vertex_order string, edge_order string, repeat int, m long, ms double, valid int")
