"""Cutting lineage through the folder that all executors share.

Everything written here goes to ``spark.checkpoint.dir``. Only where that is
unset and one machine runs everything (tests, notebooks) a temporary folder is
chosen and set; on a cluster the folder has to be named.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_PATHS: list[str] = []
_TABLES: list[str] = []


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="edgeloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _PATHS.append(path)
    return path


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile delete their shuffle files when they end, instead of when the driver's memory is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, tag: str = "stage") -> DataFrame:
    """``df`` as a Parquet table in the shared folder; later plans start from its files, and its shuffles are deleted."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    with shuffles_go(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._edgeloom_path = path
    return out


def written_by_key(df: DataFrame, key: str, buckets: int, tag: str = "keyed") -> DataFrame:
    """``df`` as a table in the warehouse, bucketed by ``key``: joins on it move only their other side."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    with shuffles_go(spark):
        df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, key).saveAsTable(name)
    _TABLES.append(name)
    return spark.table(name)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table from ``written`` that nothing reads any more."""
    path = getattr(df, "_edgeloom_path", None)
    if path:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clean_up(spark: SparkSession) -> None:
    """Drops all staged tables and files of this session. Results that still read them must be written before."""
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _PATHS:
        drop_path(spark, _PATHS.pop())
