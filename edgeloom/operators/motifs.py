"""Small subgraph counts on the undirected graph, over edges oriented from low to high degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.operators.simplify import Graph, undirected
from edgeloom.plans.durable import written


def oriented(g: Graph) -> DataFrame:
    """lo, hi: each linked pair once, from the vertex of lower (degree, id); no vertex has many out-edges then."""
    u = undirected(g.edges)
    deg = u.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    e = u.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    first = F.struct("da", "a") < F.struct("db", "b")
    return e.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("lo"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("hi"))


def cliques(g: Graph, k: int, edges: DataFrame | None = None) -> DataFrame:
    """v1 .. vk of each k-clique once: out-neighbour wedges closed by joins."""
    e = edges if edges is not None else written(oriented(g), "oriented")
    out = e.select(F.col("lo").alias("v1"), F.col("hi").alias("v2"))
    for size in range(3, k + 1):
        grown = out.join(e.select(F.col("lo").alias("v1"), F.col("hi").alias(f"v{size}")), "v1")
        for i in range(2, size):
            grown = grown.join(e.select(F.col("lo").alias(f"v{i}"), F.col("hi").alias(f"v{size}")), [f"v{i}", f"v{size}"], "left_semi")
        out = grown.select(*[f"v{i}" for i in range(1, size + 1)])
    return out


def _choose(c, k: int):
    top = F.lit(1)
    for i in range(k):
        top = top * (c - i)
    return top / {2: 2, 3: 6, 4: 24}[k]


def motif_counts(g: Graph) -> DataFrame:
    """One row of exact counts: triangles, wedges (induced and not), claws, 4-cliques and the induced 4-motifs."""
    e = written(oriented(g), "oriented")
    tri = written(cliques(g, 3, e), "triangles")
    k4 = cliques(g, 4, e).agg(F.count(F.lit(1)).alias("clique_4"))
    both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    deg = written(both.groupBy("u").agg(F.count(F.lit(1)).alias("d")), "deg")
    tv = tri.select(F.explode(F.array("v1", "v2", "v3")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("t"))
    pairs = F.explode(F.array(F.struct(F.least("v1", "v2").alias("a"), F.greatest("v1", "v2").alias("b")), F.struct(F.least("v1", "v3").alias("a"), F.greatest("v1", "v3").alias("b")), F.struct(F.least("v2", "v3").alias("a"), F.greatest("v2", "v3").alias("b"))))
    te = tri.select(pairs.alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("t"))
    # Every 4-cycle once, at its vertex of highest degree (and id): wedges from it over a lower middle to a lower end.
    rank = lambda x: F.struct(F.col(f"{x}d"), F.col(x))
    named = lambda a, b: both.select(F.col("u").alias(a), F.col("v").alias(b)).join(deg.select(F.col("u").alias(b), F.col("d").alias(f"{b}d")), b)
    up = named("m", "top").join(deg.select(F.col("u").alias("m"), F.col("d").alias("md")), "m").where(rank("m") < rank("top"))
    mid = up.select("m", "top", "topd").join(named("m", "low"), "m").where(rank("low") < rank("top"))
    codeg = mid.groupBy("top", "low").agg(F.count(F.lit(1)).alias("c")).agg((2 * F.sum(_choose(F.col("c"), 2))).alias("cc"))
    d = deg.agg(F.sum(_choose(F.col("d"), 2)).alias("w"), F.sum(_choose(F.col("d"), 3)).alias("claw"))
    ends = e.join(deg.select(F.col("u").alias("lo"), F.col("d").alias("x")), "lo").join(deg.select(F.col("u").alias("hi"), F.col("d").alias("y")), "hi").agg(F.sum((F.col("x") - 1) * (F.col("y") - 1)).alias("pp"))
    tails = tv.join(deg, "u").agg(F.sum(F.col("t") * (F.col("d") - 2)).alias("tt"))
    one = [tri.agg(F.count(F.lit(1)).alias("triangle")), k4, codeg, d, ends, tails, te.agg(F.sum(_choose(F.col("t"), 2)).alias("ch"))]
    row = one[0]
    for o in one[1:]:
        row = row.crossJoin(F.broadcast(o))  # one row each
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)")
    row = row.select("triangle", "clique_4", z("w").alias("edge_wedge"), z("claw").alias("claw"), z("cc").alias("cc"), z("pp").alias("pp"), z("tt").alias("tt"), z("ch").alias("ch"))
    row = row.withColumn("chordal_cycle_4", F.col("ch") - 6 * F.col("clique_4"))
    row = row.withColumn("cycle_4", F.col("cc") / 2 - F.col("chordal_cycle_4") - 3 * F.col("clique_4"))
    row = row.withColumn("tailed_triangle", F.col("tt") - 4 * F.col("chordal_cycle_4") - 12 * F.col("clique_4"))
    row = row.withColumn("star_4", F.col("claw") - F.col("tailed_triangle") - 2 * F.col("chordal_cycle_4") - 4 * F.col("clique_4"))
    row = row.withColumn("path_4", F.col("pp") - 3 * F.col("triangle") - 4 * F.col("cycle_4") - 2 * F.col("tailed_triangle") - 6 * F.col("chordal_cycle_4") - 12 * F.col("clique_4"))
    row = row.withColumn("wedge", F.col("edge_wedge") - 3 * F.col("triangle"))
    names = ["triangle", "wedge", "edge_wedge", "claw", "clique_4", "path_4", "star_4", "tailed_triangle", "cycle_4", "chordal_cycle_4"]
    return row.select(*[F.col(c).cast("long").alias(c) for c in names], (3 * F.col("triangle") / F.col("edge_wedge")).cast("double").alias("clustering"))


def clique_count(g: Graph, k: int) -> DataFrame:
    return cliques(g, k).agg(F.count(F.lit(1)).alias(f"clique_{k}"))
