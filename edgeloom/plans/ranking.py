"""Global positions (row numbers, running sums, successors) without one global window.

Rows are dealt to buckets, each bucket is ranked by itself, and only one row
per bucket takes part in the running total over buckets. ``numbered`` deals
them by one range exchange whose partitions are the buckets, so neither the
plan nor what the driver sees grows with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.plans.durable import written

ROWS_PER_BUCKET = 20_000


def buckets_for(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, -(-rows // per_bucket))


def range_bounds(df: DataFrame, col: str, n: int) -> list:
    """At most ``n - 1`` cut points that split ``col`` into runs of like size."""
    if n <= 1:
        return []
    shares = [i / n for i in range(1, n)]
    cuts = df.agg(F.percentile_approx(col, shares, max(10_000, 20 * n)).alias("q")).head()["q"]
    return sorted(set(cuts or []))


def range_bucket(col: Column, bounds: list) -> Column:
    """Number of cut points at or below ``col`` (null: 0), by two short searches."""
    if not bounds:
        return F.when(col.isNull(), F.lit(0)).otherwise(F.lit(0))
    step = max(1, int(len(bounds) ** 0.5))
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    coarse = F.array(*[F.lit(r[0]) for r in runs])
    which = F.size(F.filter(coarse, lambda b: b <= col))
    if step == 1:
        return F.when(col.isNull(), F.lit(0)).otherwise(which)
    fine = F.array(*[F.array(*[F.lit(b) for b in r]) for r in runs])
    inside = F.size(F.filter(F.element_at(fine, which), lambda b: b <= col))
    return F.when(col.isNull() | (which == 0), F.lit(0)).otherwise((which - 1) * step + inside)


def running_offsets(sizes: DataFrame, keys: list[str], bucket: str, amount: str, out: str) -> DataFrame:
    """``sizes`` has a row per (keys, bucket); adds the sum of ``amount`` over earlier buckets."""
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(out, F.coalesce(F.sum(amount).over(w), F.lit(0).cast("long")))


def global_row_number(df: DataFrame, out: str, order: list, keys: list[str] | None = None, bucket: str = "_b") -> DataFrame:
    """Gapless numbers from 0 within ``keys``, in ``bucket`` order and then ``order``.

    ``df`` has the column ``bucket`` already; it must rise with the wanted order.
    """
    keys = keys or []
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_offsets(counts, keys, bucket, "_n", "_off").drop("_n")
    local = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)) - 1)
    cond = None
    right = offsets
    for k in [*keys, bucket]:
        right = right.withColumnRenamed(k, f"_r{k}")
        c = F.col(k).eqNullSafe(F.col(f"_r{k}"))
        cond = c if cond is None else cond & c
    joined = local.join(right, cond, "left")
    return joined.withColumn(out, (F.col("_rn") + F.col("_off")).cast("long")).drop("_rn", "_off", *[f"_r{k}" for k in [*keys, bucket]])


def numbered(df: DataFrame, out: str, order: list) -> DataFrame:
    """``df`` with gapless numbers from 0 in ``order`` (which should leave no ties).

    One exchange by ranges, sorted inside; a row's place in its partition is
    written with it, and the driver adds up one count per partition, of which
    there are at most ``spark.sql.shuffle.partitions``.
    """
    place = F.monotonically_increasing_id()  # partition number and, in the low 33 bits, the place in the partition
    cut = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", place)
    cut = written(cut.withColumn("_b", F.shiftright("_m", 33)).withColumn("_m", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    sizes = sorted((r["_b"], r["n"]) for r in cut.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    before, total = [], 0
    for b, n in sizes:
        before.append((b, total))
        total += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_b long, _off long"))
    return cut.join(offsets, "_b").withColumn(out, F.col("_m") + F.col("_off")).drop("_b", "_m", "_off")
