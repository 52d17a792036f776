"""Edge orders: row, column, Hilbert; tiles; quadrants; generalised Hilbert walks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.plans.ranking import numbered


def power_at_least(n: int) -> int:
    """The smallest power of two that is at least n (and at least 2)."""
    return max(2, 1 << max(0, (n - 1).bit_length()))


def power_above(x: int) -> int:
    """The smallest power of two above x; 0 for 0."""
    return 0 if x == 0 else 1 << x.bit_length()


def hilbert_key(x: Column, y: Column, side: int) -> Column:
    """Place on the Hilbert curve of a ``side`` x ``side`` grid (a power of two), one fold step per bit."""
    def step(acc, s):
        rx = F.when(acc["x"].bitwiseAND(s) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        ry = F.when(acc["y"].bitwiseAND(s) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
        d = acc["d"] + s * s * ((3 * rx).bitwiseXOR(ry))
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, F.lit(side - 1) - acc["x"]).otherwise(acc["x"]), F.when(flip, F.lit(side - 1) - acc["y"]).otherwise(acc["y"])
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    steps = F.array(*[F.lit(1 << b).cast("long") for b in range(side.bit_length() - 2, -1, -1)])
    return F.aggregate(steps, F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d")), step, lambda a: a["d"])


def hilbert_point(d: Column, side: int) -> Column:
    """struct(x, y) of a place on the curve."""
    def step(acc, s):
        rx = F.floor(acc["t"] / 2).cast("long").bitwiseAND(F.lit(1).cast("long"))
        ry = acc["t"].bitwiseXOR(rx).bitwiseAND(F.lit(1).cast("long"))
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, s - 1 - acc["x"]).otherwise(acc["x"]), F.when(flip, s - 1 - acc["y"]).otherwise(acc["y"])
        x, y = F.when(ry == 0, fy).otherwise(fx), F.when(ry == 0, fx).otherwise(fy)
        return F.struct((x + s * rx).alias("x"), (y + s * ry).alias("y"), F.floor(acc["t"] / 4).cast("long").alias("t"))

    steps = F.array(*[F.lit(1 << b).cast("long") for b in range(side.bit_length() - 1)])
    zero = F.lit(0).cast("long")
    return F.aggregate(steps, F.struct(zero.alias("x"), zero.alias("y"), d.cast("long").alias("t")), step, lambda a: F.struct(a["x"], a["y"]))


def ordered(edges: DataFrame, how: str, n: int) -> DataFrame:
    """src, dst, idx: each edge's number from 0 in row, column or hilbert order."""
    if how == "row":
        keyed, order = edges, ["src", "dst"]
    elif how == "column":
        keyed, order = edges, ["dst", "src"]
    elif how == "hilbert":
        keyed, order = edges.withColumn("_k", hilbert_key(F.col("src"), F.col("dst"), power_at_least(n))), ["_k"]
    else:
        raise ValueError(f"unknown edge order: {how}")
    return numbered(keyed, "idx", order).select("src", "dst", "idx")


def tile_nnz(edges: DataFrame, side: int) -> DataFrame:
    """qx, qy, nnz of each non-empty tile of ``side`` x ``side`` cells (a power of two)."""
    b = side.bit_length() - 1
    return edges.groupBy(F.shiftright("src", b).alias("qx"), F.shiftright("dst", b).alias("qy")).agg(F.count(F.lit(1)).alias("nnz"))


def tile_order(tiles: DataFrame, n: int, side: int) -> DataFrame:
    """Tiles with their place on the Hilbert curve over tiles."""
    per = max(1, -(-n // side))
    return numbered(tiles.withColumn("key", hilbert_key(F.col("qx"), F.col("qy"), power_at_least(per))), "q_idx", ["key"])


def inside_tiles(edges: DataFrame, side: int) -> DataFrame:
    """qx, qy, x, y, nth: edges inside each tile in Hilbert order of their local place."""
    b, mask = side.bit_length() - 1, side - 1
    local = edges.select(F.shiftright("src", b).alias("qx"), F.shiftright("dst", b).alias("qy"), F.col("src").bitwiseAND(F.lit(mask)).alias("x"), F.col("dst").bitwiseAND(F.lit(mask)).alias("y"))
    keyed = local.withColumn("_h", hilbert_key(F.col("x"), F.col("y"), max(2, side)))
    return keyed.withColumn("nth", F.row_number().over(Window.partitionBy("qx", "qy").orderBy("_h")) - 1).drop("_h")


def quadrants(spark, n: int, depth: int) -> DataFrame:
    """qx, qy, x0, x1, y0, y1 of the 4 ** depth parts of an n x n square, halved at midpoints."""
    k = 1 << depth
    line = spark.range(k).select(F.col("id").alias("q"), F.floor(F.col("id") * n / k).alias("lo"), F.floor((F.col("id") + 1) * n / k).alias("hi"))
    x, y = line.select(F.col("q").alias("qx"), F.col("lo").alias("x0"), F.col("hi").alias("x1")), line.select(F.col("q").alias("qy"), F.col("lo").alias("y0"), F.col("hi").alias("y1"))
    return x.crossJoin(F.broadcast(y))  # 2 ** depth rows each


def rectangle_walk(width: int, height: int) -> Iterator[tuple[int, int]]:
    """Every cell of a rectangle once, each beside the one before: a walk of Peano's kind.

    A block with an odd side can be crossed from a corner to the opposite one.
    It is cut across its longer side into three blocks of which each has an odd
    side again (the outer two are odd there, the middle one takes the rest), and
    these are crossed in turn, every second one mirrored, so each ends beside
    the next one's beginning. With two even sides no walk ends in the opposite
    corner; such a rectangle is walked as two halves of odd width.
    """

    def thirds(n: int) -> tuple[int, int, int]:
        outer = max(1, n // 3 - (n // 3 + 1) % 2)
        return outer, n - 2 * outer, outer

    def cross(x: int, y: int, w: int, h: int, east: bool, north: bool) -> Iterator[tuple[int, int]]:
        """From the corner that lies against both directions to the opposite one."""
        if min(w, h) == 1:
            for i in range(w * h):
                dx, dy = (i, 0) if h == 1 else (0, i)
                yield x + (dx if east else w - 1 - dx), y + (dy if north else h - 1 - dy)
            return
        begun, wide = 0, w >= h
        for turn, size in enumerate(thirds(w if wide else h)):
            ahead = begun if (east if wide else north) else (w if wide else h) - begun - size
            flip = turn % 2 == 1
            yield from cross(x + ahead, y, size, h, east, north ^ flip) if wide else cross(x, y + ahead, w, size, east ^ flip, north)
            begun += size

    if width % 2 or height % 2:
        yield from cross(0, 0, width, height, True, True)
    else:
        half = width // 2 - (width // 2 + 1) % 2
        yield from cross(0, 0, half, height, True, True)
        yield from cross(half, 0, width - half, height, True, False)


def wing_envelope(edges: DataFrame, core: int) -> DataFrame:
    """For each row of the core: last column, and its largest value at or below the row in falling row order."""
    rows = edges.where(F.col("src") < core).groupBy(F.col("src").alias("row")).agg(F.max("dst").alias("last"))
    w = Window.orderBy(F.desc("row")).rowsBetween(Window.unboundedPreceding, 0)  # at most core rows
    return rows.withColumn("envelope", F.max("last").over(w))


def outside_extents(edges: DataFrame, core: int) -> DataFrame:
    """row, least, most: first and last column at or beyond the core in each row at or beyond it."""
    return edges.where((F.col("src") >= core) & (F.col("dst") >= core)).groupBy(F.col("src").alias("row")).agg(F.min("dst").alias("least"), F.max("dst").alias("most"))


def halved_squares(spark, side: int, most: int) -> DataFrame:
    """x0, x1, y0, y1: a square cut in four at its midpoints until a part has a side of at most half of ``most``; log(side) rounds."""
    if most < 2:
        raise ValueError("parts cannot be smaller than a cell")
    done, left = None, spark.createDataFrame([(0, side, 0, side)], "x0 long, x1 long, y0 long, y1 long")
    longest = side
    while True:
        small = (2 * (F.col("x1") - F.col("x0")) <= most) | (2 * (F.col("y1") - F.col("y0")) <= most)
        kept = left.where(small)
        done = kept if done is None else done.unionByName(kept)
        if 2 * longest <= most:
            return done
        xm, ym = F.floor((F.col("x0") + F.col("x1")) / 2), F.floor((F.col("y0") + F.col("y1")) / 2)
        parts = [(F.col("x0"), xm, F.col("y0"), ym), (xm, F.col("x1"), F.col("y0"), ym), (F.col("x0"), xm, ym, F.col("y1")), (xm, F.col("x1"), ym, F.col("y1"))]
        four = F.explode(F.array(*[F.struct(*[c.cast("long").alias(n) for c, n in zip(p, ("x0", "x1", "y0", "y1"), strict=True)]) for p in parts]))
        left = left.where(~small).select(four.alias("p")).select("p.*")
        longest = -(-longest // 2)


def quadrant_chain(spark, depth: int) -> DataFrame:
    """place, qx, qy, direction, start, finish, rotation of the 4 ** depth quadrants along the curve.

    The direction is the step to the next quadrant (the last one keeps that of
    its predecessor). A way right or up ends in the top right corner, a way down
    or left in the bottom left one; the next begins in that corner's mirror
    image over the shared side, the first in the top left corner.
    """
    side = 1 << depth
    cells = spark.range(side * side).select((F.col("id") % side).alias("qx"), F.floor(F.col("id") / side).alias("qy"))
    placed = cells.select("qx", "qy", hilbert_key(F.col("qx"), F.col("qy"), max(2, side)).alias("place"))
    w = Window.orderBy("place")  # 4 ** depth rows, a parameter
    dx, dy = F.lead("qx").over(w) - F.col("qx"), F.lead("qy").over(w) - F.col("qy")
    step = F.when(dx == 1, "right").when(dx == -1, "left").when(dy == 1, "up").when(dy == -1, "down")
    chain = placed.withColumn("step", step).withColumn("before", F.lag("step").over(w))
    chain = chain.withColumn("direction", F.coalesce("step", "before", F.lit("right")))
    chain = chain.withColumn("start", F.when(F.col("before").isin("up", "left"), "bot_right").otherwise("top_left"))
    chain = chain.withColumn("finish", F.when(F.col("before").isNull(), "top_right").when(F.col("direction").isin("right", "up"), "top_right").otherwise("bot_left"))
    left = F.col("start") == "top_left"
    turn = F.when(left & (F.col("finish") == "top_right"), 0).when(left, 90).when(F.col("finish") == "bot_left", 180).otherwise(270)
    return chain.select("place", "qx", "qy", "direction", "start", "finish", turn.alias("rotation"))
