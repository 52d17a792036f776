"""Strongly connected components: trimming, then forward and backward colouring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.simplify import Graph
from edgeloom.plans.durable import written


def _settle(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Each vertex gets the largest colour that reaches it along ``edges``."""
    color = written(vertices.select("id", F.col("id").alias("color")), "color")
    while True:
        sent = edges.join(color.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("color").alias("got"))
        new = written(color.join(sent, "id", "left").select("id", F.greatest("color", F.coalesce("got", "color")).alias("color"), F.coalesce(F.col("got") > F.col("color"), F.lit(False)).alias("moved")), "color")
        color = new.select("id", "color")
        if new.where("moved").isEmpty():
            return color


def strongly_connected(g: Graph, trims: int = 200) -> DataFrame:
    """id, scc (the largest id of the component)."""
    left, edges, done = written(g.vertices.select("id"), "left"), written(g.edges.select("src", "dst"), "edges"), []
    while not left.isEmpty():
        for _ in range(trims):  # vertices without an in- or an out-edge are alone
            ins, outs = edges.select(F.col("dst").alias("id")).distinct(), edges.select(F.col("src").alias("id")).distinct()
            core = written(left.join(ins, "id", "left_semi").join(outs, "id", "left_semi"), "core")
            alone = left.join(core, "id", "left_anti")
            if alone.isEmpty():
                break
            done.append(written(alone.select("id", F.col("id").alias("scc")), "alone"))
            left = core
            edges = written(edges.join(core.withColumnRenamed("id", "src"), "src", "left_semi").join(core.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "edges")
        if left.isEmpty():
            break
        color = written(_settle(left, edges), "colored")
        # Against the edges, inside a colour, from the vertex that gave it its name.
        a, b = color.select(F.col("id").alias("src"), F.col("color").alias("ca")), color.select(F.col("id").alias("dst"), F.col("color").alias("cb"))
        inside = written(edges.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst"), "inside")
        front = written(color.where("id = color").select("id", F.col("color").alias("scc")), "front")
        reached = front
        while True:
            back = inside.join(front.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "scc").distinct()
            front = written(back.join(reached.select("id"), "id", "left_anti"), "front")
            if front.isEmpty():
                break
            reached = written(reached.unionByName(front), "reached")
        done.append(reached)
        left = written(left.join(reached.select("id"), "id", "left_anti"), "left")
        keep = left.withColumnRenamed("id", "src")
        edges = written(edges.join(keep, "src", "left_semi").join(left.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"), "edges")
    out = None
    for d in done:
        out = d if out is None else out.unionByName(d)
    return out if out is not None else g.vertices.select("id", F.col("id").alias("scc"))


def component_summary(comp: DataFrame, col: str) -> DataFrame:
    """n_components, largest."""
    return comp.groupBy(col).agg(F.count(F.lit(1)).alias("size")).agg(F.count(F.lit(1)).alias("n_components"), F.max("size").alias("largest"))


def extract_component(g: Graph, comp: DataFrame, col: str = "comp") -> DataFrame:
    """src, dst of the largest component (ties: the smallest label), with dense ids in the old order."""
    from edgeloom.operators.simplify import dense_ids, relabel

    top = comp.groupBy(col).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", (-F.col(col)).alias("c"))).alias("m")).head()["m"]
    inside = written(comp.where(F.col(col) == -top["c"]).select(F.col("id").alias("orig_id")), "inside")
    ids = dense_ids(inside, "orig_id")
    return relabel(g.edges, ids)
