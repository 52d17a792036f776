"""Summaries over experiment logs and the datasets behind plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.functions import power_below


def runtime_stats(runs: DataFrame, keys: list[str], value: str = "runtime") -> DataFrame:
    return runs.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.count(F.lit(1)).alias("runs"))


def runtime_pivot(runs: DataFrame, row: str, col: str, values: list, value: str = "runtime") -> DataFrame:
    return runs.groupBy(row).pivot(col, values).agg(F.avg(value))


def complete(runs: DataFrame, group: str, vertex_orders: int, edge_orders: int, repeats: int) -> DataFrame:
    """Groups with all of their (orders + 1) * edge orders * repeats runs."""
    return runs.groupBy(group).agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") >= (vertex_orders + 1) * edge_orders * repeats)


def edge_cut(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """cut, volume of a partition (id, part): crossing edges; distinct other parts per vertex, summed."""
    a, b = parts.select(F.col("id").alias("src"), F.col("part").alias("pa")), parts.select(F.col("id").alias("dst"), F.col("part").alias("pb"))
    e = edges.join(a, "src").join(b, "dst").where("pa <> pb")
    per = e.groupBy("src").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("pb").alias("v"))
    return per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("cut"), F.coalesce(F.sum("v"), F.lit(0)).alias("volume"))


def spy_grid(edges: DataFrame, cell: int) -> DataFrame:
    """x, y, n: edges per cell of a plot."""
    return edges.groupBy(F.floor(F.col("dst") / cell).alias("x"), F.floor(F.col("src") / cell).alias("y")).agg(F.count(F.lit(1)).alias("n"))


def extents(placed: DataFrame, group: str, place: str) -> DataFrame:
    """First and last place of each group and the padded size of its square."""
    return placed.groupBy(group).agg(F.min(place).alias("first"), F.max(place).alias("last")).withColumn("side", F.col("last") - F.col("first") + 1)


def polyline(points: DataFrame, order: str, group: str) -> DataFrame:
    """Each point with its predecessor, per curve."""
    w = Window.partitionBy(group).orderBy(order)
    return points.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w))


def groups_by_size(runs: DataFrame, group: str, size: str) -> DataFrame:
    """Each group with its size and its place when the largest comes first (ties: by name)."""
    from edgeloom.plans.ranking import numbered

    sized = runs.groupBy(group).agg(F.max(size).alias("size"), F.count(F.lit(1)).alias("runs"))
    return numbered(sized, "place", [F.desc("size"), group])


def guide_lines(wing: Column, cache: int = 1600) -> list[Column]:
    """Where a plot is marked for a wing width: the line itself, the largest power of two in the cache and half of it, the side of the dense core."""
    top = 1 << (cache.bit_length() - 1)
    return [wing.alias("line"), F.lit(top).alias("cache_power"), F.lit(top // 2).alias("quadrant_side"), power_below(wing).alias("core_side")]
