"""Structured Streaming over event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, glob: str = "events*") -> DataFrame:
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """day, event_type, n: closed days only, once the watermark has passed them."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return windowed.select(F.col("window.start").alias("day"), "event_type", "n")


def new_edges(edges: DataFrame, late: str = "1 hour") -> DataFrame:
    """Edges of a stream (src, dst, ts), each pair once within the watermark."""
    return edges.withWatermark("ts", late).dropDuplicatesWithinWatermark(["src", "dst"])
