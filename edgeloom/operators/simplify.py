"""From a raw edge list to a simple graph with dense vertex ids, and small edge-set operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.plans.durable import written
from edgeloom.plans.ranking import numbered


@dataclass
class Graph:
    """edges (src, dst): dense ids, no loops, distinct; vertices (id, orig_id)."""

    edges: DataFrame
    vertices: DataFrame

    def n(self) -> int:
        return self.vertices.count()

    def m(self) -> int:
        return self.edges.count()


def drop_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def endpoints(edges: DataFrame) -> DataFrame:
    """The distinct vertices that some edge touches."""
    return edges.select(F.explode(F.array("src", "dst")).alias("orig_id")).distinct()


def dense_ids(values: DataFrame, col: str, out: str = "id") -> DataFrame:
    """Numbers distinct values from 0 in their own order; ranges are numbered apart and then shifted."""
    return numbered(values, out, [col]).select(out, col)


def relabel(edges: DataFrame, ids: DataFrame, old: str = "orig_id", new: str = "id") -> DataFrame:
    """Both endpoints through a map of ids, two equi-joins."""
    a = ids.select(F.col(old).alias("src"), F.col(new).alias("_s"))
    b = ids.select(F.col(old).alias("dst"), F.col(new).alias("_d"))
    return edges.join(a, "src").join(b, "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst"))


def simplify(raw: DataFrame, loops: bool = False) -> Graph:
    """Loops go first (so vertices with nothing else vanish), then edges are made distinct and ids dense."""
    kept = raw.where("src is not null and dst is not null")
    kept = written((kept if loops else drop_loops(kept)).select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct(), "kept")
    vertices = dense_ids(endpoints(kept), "orig_id")
    return Graph(written(relabel(kept, vertices), "edges"), vertices)


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, once."""
    both = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.select(both.alias("e")).select("e.src", "e.dst").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """a < b, once per linked pair."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def laplacian(edges: DataFrame, in_degree: bool = False) -> DataFrame:
    """Triplets (row, col, val): the degree on the diagonal, -1 where an edge is."""
    side = "dst" if in_degree else "src"
    diagonal = edges.groupBy(F.col(side).alias("row")).agg(F.count(F.lit(1)).alias("val")).select("row", F.col("row").alias("col"), "val")
    return edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(-1).cast("long").alias("val")).unionByName(diagonal)


def is_symmetric(edges: DataFrame) -> DataFrame:
    """One row: symmetric (1 if each edge has its reverse)."""
    return edges.exceptAll(transpose(edges)).agg((F.count(F.lit(1)) == 0).cast("int").alias("symmetric"))


def apply_ordering(edges: DataFrame, ordering: DataFrame) -> DataFrame:
    """Edges under a permutation (id, new_id)."""
    return relabel(edges, ordering, "id", "new_id")
