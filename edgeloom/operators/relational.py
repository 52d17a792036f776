"""Catalog tables: filters, upserts, profiles. Tables are DataFrames; a change returns the new table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def between_all(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Rows inside all ranges, ends included."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, (lo, hi) in bounds.items()]))


def downloadable(df: DataFrame, names: list[str], name: str, url: str) -> DataFrame:
    return df.where(F.col(name).isin(*names) & (F.col(url) != "none"))


def point(df: DataFrame, key: str, value, col: str):
    """One value, or None where there is no such row."""
    row = df.where(F.col(key) == value).select(col).head()
    return row[0] if row else None


def set_point(df: DataFrame, key: str, value, col: str, new) -> DataFrame:
    return df.withColumn(col, F.when(F.col(key) == value, F.lit(new)).otherwise(F.col(col)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows replace old rows of their key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows whose key is not there yet."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def update_columns(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Values of ``new`` where it has any, old ones elsewhere; no rows are added."""
    cols = [c for c in new.columns if c not in keys]
    right = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols])
    out = old.join(right, keys, "left")
    kept = [F.coalesce(f"_new_{c}", c).alias(c) if c in cols else F.col(c) for c in old.columns]
    return out.select(*kept, *[F.col(f"_new_{c}").alias(c) for c in cols if c not in old.columns])


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, zeros, nulls of each numeric column, in one pass."""
    aggs = [x for c in cols for x in (F.sum(F.when(F.col(c) == 0, 1).otherwise(0)).alias(f"{c}__zeros"), F.sum(F.col(c).isNull().cast("int")).alias(f"{c}__nulls"))]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__zeros").alias("zeros"), F.col(f"{c}__nulls").alias("nulls")) for c in cols])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def covered_columns(df: DataFrame, cols: list[str], least: int) -> DataFrame:
    """column, filled: columns with at least ``least`` values other than null and 0."""
    one = df.agg(*[F.sum(F.when(F.col(c).isNotNull() & (F.col(c) != 0), 1).otherwise(0)).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "filled").where(F.col("filled") >= least)


def imputed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c).cast(types[c]), F.lit(0).cast(types[c])).alias(c) if c in types else F.col(c) for c in df.columns])


def numbered_parts(df: DataFrame, kind: str, order: list[str], out: str = "number") -> DataFrame:
    """Rows of each kind numbered from 0."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(kind).orderBy(*order)) - 1)


def chunked(df: DataFrame, order: list[str], size: int, kind: str, out: str = "chunk") -> DataFrame:
    """Pieces of ``size`` rows inside each kind."""
    n = F.row_number().over(Window.partitionBy(kind).orderBy(*order)) - 1
    return df.withColumn(out, F.floor(n / size))


def extended(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Adds the columns of ``schema`` that are missing, as nulls."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in schema.items() if c not in df.columns])


def verified(df: DataFrame, known: str, computed: str, out: str) -> DataFrame:
    """The computed value where the known one is 0 or null."""
    return df.withColumn(out, F.when(F.coalesce(F.col(known), F.lit(0)) == 0, F.col(computed)).otherwise(F.col(known)))


def grid(*dims: DataFrame) -> DataFrame:
    """Every combination of small dimension tables (graphs, orders, repeats)."""
    return reduce(lambda a, b: a.crossJoin(b), dims)


def without_empty_columns(df: DataFrame) -> DataFrame:
    """``df`` without the columns that hold nothing but nulls and (if numeric) zeros; one pass over the rows."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    kinds = dict(df.dtypes)
    filled = [F.count_if((F.col(c) != 0) if kinds[c] in numeric else F.col(c).isNotNull()).alias(c) for c in df.columns]
    row = df.agg(*filled).head()
    return df.select(*[c for c in df.columns if row[c]])
