"""Vertex orderings: permutations (id, new_id) of a graph's vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.operators.components import connected_components
from edgeloom.operators.simplify import Graph, relabel, symmetrize, undirected
from edgeloom.plans.durable import written
from edgeloom.plans.ranking import numbered, running_offsets

NAMES = ("orig", "rnd", "srt", "hs", "hc", "dbg", "sb", "parsb", "cm", "rev_cm", "rbt")


def check_names(names: list[str]) -> list[str]:
    unknown = sorted(set(names) - set(NAMES))
    if unknown:
        raise ValueError(f"unknown vertex orderings: {', '.join(unknown)}")
    return list(names)


def ranked(df: DataFrame, lead: Column, tie: str = "id") -> DataFrame:
    """id, new_id by ``lead`` ascending (a long), ties by ``tie``."""
    keyed = df.select("id", tie, lead.cast("long").alias("_k")) if tie != "id" else df.select("id", lead.cast("long").alias("_k"))
    return numbered(keyed, "new_id", ["_k", tie]).select("id", "new_id")


def original(g: Graph) -> DataFrame:
    return g.vertices.select("id", F.col("id").alias("new_id"))


def random_order(g: Graph, seed: int = 0) -> DataFrame:
    """A multiplicative hash of the id, the same in any engine."""
    return ranked(g.vertices, F.pmod((F.col("id") + seed) * F.lit(2654435761), F.lit(1 << 32)))


def degree_sort(deg: DataFrame, col: str = "out_deg") -> DataFrame:
    return ranked(deg, -F.col(col))


def _with_mean(deg: DataFrame, col: str) -> DataFrame:
    mean = deg.agg(F.avg(col)).head()[0] or 0.0
    return deg.withColumn("_hub", F.col(col) > F.lit(mean)).withColumn("_mean", F.lit(mean))


def hub_sort(deg: DataFrame, col: str = "out_deg") -> DataFrame:
    """Vertices above the mean degree first, by falling degree; the others keep their order."""
    d = _with_mean(deg, col)
    return ranked(d, F.when(F.col("_hub"), -F.col(col)).otherwise(F.lit(1)))


def hub_cluster(deg: DataFrame, col: str = "out_deg") -> DataFrame:
    """Vertices above the mean degree first; both groups keep their order."""
    return ranked(_with_mean(deg, col), F.when(F.col("_hub"), F.lit(0)).otherwise(F.lit(1)))


def degree_groups(deg: DataFrame, col: str = "out_deg") -> DataFrame:
    """Eight groups of falling degree, bounds 32, 16, 8, 4, 2, 1, 1/2 and 0 times the mean; stable inside."""
    d, group = _with_mean(deg, col), None
    for i, times in enumerate((32, 16, 8, 4, 2, 1, 0.5)):
        cond = F.col(col) >= F.col("_mean") * times
        group = F.when(cond, F.lit(i)) if group is None else group.when(cond, F.lit(i))
    return ranked(d, group.otherwise(F.lit(7)))


def reverse(ordering: DataFrame) -> DataFrame:
    n = ordering.count()
    return ordering.select("id", (F.lit(n - 1) - F.col("new_id")).cast("long").alias("new_id"))


def bandwidth(edges: DataFrame, ordering: DataFrame | None = None) -> DataFrame:
    e = edges if ordering is None else relabel(edges, ordering, "id", "new_id")
    return e.agg(F.coalesce(F.max(F.abs(F.col("src") - F.col("dst"))), F.lit(0)).cast("long").alias("bandwidth"))


def is_permutation(ordering: DataFrame) -> DataFrame:
    """n, distinct, least, most of the new ids: a bijection on 0 .. n-1 has n, n, 0, n-1."""
    return ordering.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("new_id").alias("distinct_ids"), F.min("new_id").alias("least"), F.max("new_id").alias("most"))


def cuthill_mckee(g: Graph) -> DataFrame:
    """Level-synchronous Cuthill-McKee: per component a breadth-first search from the vertex of least degree.

    In a level vertices are ordered by their earliest parent's place, degree
    and id. Components follow each other by their root's degree and id.
    """
    both = written(symmetrize(g.edges), "adjacent")
    deg = written(g.vertices.select("id").join(both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg")), "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg")), "deg")
    comp = connected_components(both)
    comp = deg.select("id", "deg").join(comp, "id", "left").select("id", "deg", F.coalesce("comp", "id").alias("comp"))
    roots = comp.groupBy("comp").agg(F.min(F.struct("deg", "id")).alias("r")).select("comp", F.col("r.deg").alias("rdeg"), F.col("r.id").alias("id"))
    rooted = numbered(roots, "place", ["rdeg", "id"])
    front = written(rooted.select("id", F.col("place").alias("component"), F.lit(0).cast("long").alias("place"), F.lit(0).alias("level")), "front")
    done, level = front, 0
    while True:
        level += 1
        reached = front.select(F.col("id").alias("src"), "component", "place").join(both, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("place", "component")).alias("p"))
        fresh = reached.join(done.select("id"), "id", "left_anti").join(deg, "id")
        fresh = numbered(fresh.select("id", "p.component", "p.place", "deg"), "nth", ["component", "place", "deg", "id"])  # a level of one component may hold most vertices
        begins = fresh.groupBy("component").agg(F.min("nth").alias("begin"))
        front = written(fresh.join(begins, "component").select("id", "component", (F.col("nth") - F.col("begin")).alias("place"), F.lit(level).alias("level")), "front")
        if front.isEmpty():
            break
        done = written(done.unionByName(front), "visited")
    sized = done.groupBy("component", "level").agg(F.count(F.lit(1)).alias("n"))
    inside = running_offsets(sized, ["component"], "level", "n", "before").select("component", "level", "before")
    whole = running_offsets(sized.groupBy("component").agg(F.sum("n").alias("n")), [], "component", "n", "start").select("component", "start")
    return done.join(inside, ["component", "level"]).join(whole, "component").select("id", (F.col("start") + F.col("before") + F.col("place")).cast("long").alias("new_id"))


def slashburn(g: Graph, share: float = 0.005) -> tuple[DataFrame, dict]:
    """Hubs to the front, small components to the back, again on the largest component.

    Returns the ordering and {k, n_iters}. Ties: hubs by id; among components of
    one size the one of the smallest vertex lies furthest back; inside a
    component by id. A largest component of less than k vertices goes, by id,
    behind the hubs that were placed last.
    """
    n = g.vertices.count()
    k = max(1, int(n * share))
    edges = written(undirected(g.edges), "sb")
    left = written(g.vertices.select("id"), "left")
    placed, front, back, rounds = [], 0, n, 0
    while front < back:
        rounds += 1
        ends = edges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("deg"))
        ranks = numbered(left.join(ends, "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg")), "rank", [F.desc("deg"), "id"])
        hubs = written(ranks.where(F.col("rank") < k).select("id", (F.col("rank") + front).alias("new_id")), "hubs")
        placed.append(hubs)
        front += min(k, back - front)
        gone = hubs.select("id")
        edges_left = edges.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        comp = left.join(gone, "id", "left_anti").join(connected_components(edges_left, "a", "b"), "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))
        comp = written(comp, "comp")
        sizes = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
        giant = sizes.agg(F.max(F.struct("size", (-F.col("comp")).alias("c"))).alias("m")).head()["m"]
        if giant is None:
            break
        small = comp.where(F.col("comp") != -giant["c"]).join(sizes, "comp")
        spokes = back - front - giant["size"]
        if spokes:
            placed.append(numbered(small, "nth", ["size", F.desc("comp"), "id"]).select("id", (F.col("nth") + (back - spokes)).alias("new_id")))
            back -= spokes
        left = written(comp.where(F.col("comp") == -giant["c"]).select("id"), "left")
        edges = written(edges_left.join(left.withColumnRenamed("id", "a"), "a", "left_semi").select("a", "b"), "sb")
        if giant["size"] < k:
            placed.append(numbered(left, "nth", ["id"]).select("id", (F.col("nth") + front).alias("new_id")))
            break
    out = g.vertices.select("id", F.col("id").alias("new_id")).where(F.lit(False))
    for p in placed:
        out = out.unionByName(p)
    return out, {"k": k, "n_iters": rounds}


def slashburn_metrics(n: int, k: int, n_iters: int) -> dict:
    """Side of the square that holds the hubs, and its share of the matrix (the wing width ratio)."""
    return {"n": n, "k": k, "n_iters": n_iters, "core_side": k * n_iters, "wing_width_ratio": k * n_iters / n if n else None}


def inverted(ordering: DataFrame) -> DataFrame:
    """The permutation that undoes one: id and new_id change places."""
    return ordering.select(F.col("new_id").alias("id"), F.col("id").alias("new_id"))


def modularity_merge(g: Graph) -> DataFrame:
    """id, path: the communities of each vertex from the outermost inwards, named by their vertex of highest degree (and id).

    Round by round every community looks for the neighbour whose union gains
    most modularity (if any does) and proposes to join it if that has the higher
    degree; proposals to communities that move themselves wait for a later
    round. The best pair of all is always mutual, so every round merges
    something. The contracted graph carries summed weights, so a round costs
    what is left.
    """
    und = undirected(g.edges)
    edges = written(und.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1.0).alias("w")), "merge")
    ends = edges.select(F.explode(F.array("u", "v")).alias("id"), "w")
    deg = g.vertices.select("id").join(ends.groupBy("id").agg(F.sum("w").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d"))
    deg, m = written(deg, "strength"), edges.agg(F.sum("w")).head()[0] or 0.0
    member = written(g.vertices.select("id", F.col("id").alias("top"), F.array("id").alias("path")), "member")
    while m:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
        rated = both.join(deg.select(F.col("id").alias("u"), F.col("d").alias("du")), "u").join(deg.select(F.col("id").alias("v"), F.col("d").alias("dv")), "v")
        gain = F.col("w") - F.col("du") * F.col("dv") / (2 * m)
        rated = rated.withColumn("gain", gain).where("gain > 1e-12")
        best = rated.groupBy("u", "du").agg(F.max(F.struct("gain", F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y"), "dv", "v")).alias("best"))
        wish = written(best.where(F.struct("du", "u") < F.struct("best.dv", "best.v")).select(F.col("u").alias("id"), F.col("best.v").alias("into")), "wish")
        moves = written(wish.join(wish.select(F.col("id").alias("into")), "into", "left_anti").select("id", "into"), "moves")
        if moves.isEmpty():
            break
        to = lambda name: moves.select(F.col("id").alias(name), F.col("into").alias(f"{name}_"))
        merged = edges.join(to("u"), "u", "left").join(to("v"), "v", "left").select(F.coalesce("u_", "u").alias("a"), F.coalesce("v_", "v").alias("b"), "w").where("a <> b")
        edges = written(merged.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("w").alias("w")), "merge")
        deg = written(deg.join(to("id"), "id", "left").groupBy(F.coalesce("id_", "id").alias("id")).agg(F.sum("d").alias("d")), "strength")
        moved = F.col("top_").isNotNull()
        member = member.join(to("top"), "top", "left").select("id", F.coalesce("top_", "top").alias("top"), F.when(moved, F.concat(F.array("top_"), "path")).otherwise(F.col("path")).alias("path"))
        member = written(member, "member")
    return member.select("id", "path")


def hierarchy_order(g: Graph) -> DataFrame:
    """Rabbit's order: vertices along the tree of merged communities, so every community is a run at every level."""
    return numbered(modularity_merge(g), "new_id", ["path", "id"]).select("id", "new_id")


def modularity(g: Graph, comms: DataFrame) -> DataFrame:
    """One row: the modularity of a partition (id, comm) of the undirected graph."""
    und = undirected(g.edges)
    a, b = comms.select(F.col("id").alias("a"), F.col("comm").alias("ca")), comms.select(F.col("id").alias("b"), F.col("comm").alias("cb"))
    e = und.join(a, "a").join(b, "b")
    inside = e.agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("ca") == F.col("cb")).alias("inside"))
    sums = e.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("d")).agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("squares"))
    return inside.crossJoin(F.broadcast(sums)).select((F.col("inside") / F.col("m") - F.col("squares") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"))  # one row each


def communities(g: Graph, rounds: int = 5) -> DataFrame:
    """id, comm: vertices take the label most frequent among their neighbours (ties: the smallest), on even and odd ids in turn."""
    both = written(symmetrize(g.edges), "adjacent")
    label = written(g.vertices.select("id", F.col("id").alias("comm")), "label")
    for turn in range(rounds):
        votes = both.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "comm").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("id").agg(F.max(F.struct("n", (-F.col("comm")).alias("c"))).alias("m")).select("id", (-F.col("m.c")).alias("best"))
        mine = (F.col("id") % 2) == turn % 2
        label = written(label.join(best, "id", "left").select("id", F.when(mine, F.coalesce("best", "comm")).otherwise(F.col("comm")).alias("comm")), "label")
    return label


def community_order(g: Graph, deg: DataFrame, rounds: int = 5) -> DataFrame:
    """Communities one after another by label; inside by falling degree, then id."""
    c = communities(g, rounds).join(deg.select("id", "deg"), "id")
    return numbered(c, "new_id", ["comm", F.desc("deg"), "id"]).select("id", "new_id")
