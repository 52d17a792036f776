"""Graphs derived from the star-schema tables, as raw edge lists (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.plans.ranking import numbered
from edgeloom.session import table


def consecutive(df: DataFrame, order: list[str], value: str, keep: list[str] | None = None) -> DataFrame:
    """Pairs (src, dst) of ``value`` in rows that follow each other in ``order``, with the first row's ``keep``."""
    keep = keep or []
    ranked = numbered(df, "_pos", order).select("_pos", F.col(value).alias("src"), *keep)
    following = ranked.select((F.col("_pos") - 1).alias("_pos"), F.col("src").alias("dst"))
    return ranked.join(following, "_pos").drop("_pos")


def g_ps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))


def g_cc(spark: SparkSession, d: str) -> DataFrame:
    return consecutive(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], "o_custkey").select("src", "dst")


def g_uu(spark: SparkSession, d: str) -> DataFrame:
    return consecutive(table(spark, d, "events").select("ts", "event_id", "user_id"), ["ts", "event_id"], "user_id").select("src", "dst")


def g_tree(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers point to their nation, nations to their region: one component per region, regions are sinks."""
    nation, region = F.lit(1 << 40), F.lit(1 << 41)
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), (nation + F.col("c_nationkey")).alias("dst"))
    firms = table(spark, d, "supplier").select((F.lit(1 << 42) + F.col("s_suppkey")).alias("src"), (nation + F.col("s_nationkey")).alias("dst"))
    nations = table(spark, d, "nation").select((nation + F.col("n_nationkey")).alias("src"), (region + F.col("n_regionkey")).alias("dst"))
    return people.unionByName(firms).unionByName(nations)


SQL = {
    "g_ps": "SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem",
    "g_cc": "SELECT src, dst FROM (SELECT o_custkey AS src, lead(o_custkey) OVER (ORDER BY o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL",
    "g_uu": "SELECT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL",
    "g_tree": f"SELECT c_custkey AS src, {1 << 40} + c_nationkey AS dst FROM customer UNION ALL SELECT {1 << 42} + s_suppkey, {1 << 40} + s_nationkey FROM supplier UNION ALL SELECT {1 << 40} + n_nationkey, {1 << 41} + n_regionkey FROM nation",
}
GRAPHS = {"g_ps": g_ps, "g_cc": g_cc, "g_uu": g_uu, "g_tree": g_tree}


def simple_sql(name: str) -> str:
    """CTEs raw, v (id, orig_id), e (src, dst): the simplified graph in SQL."""
    return (
        f"raw AS ({SQL[name]}), kept AS (SELECT DISTINCT src, dst FROM raw WHERE src <> dst), "
        "v AS (SELECT orig_id, row_number() OVER (ORDER BY orig_id) - 1 AS id FROM (SELECT src AS orig_id FROM kept UNION SELECT dst FROM kept)), "
        "e AS (SELECT a.id AS src, b.id AS dst FROM kept JOIN v a ON a.orig_id = kept.src JOIN v b ON b.orig_id = kept.dst), "
        "u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), "
        "both_ways AS (SELECT a AS src, b AS dst FROM u UNION ALL SELECT b, a FROM u), "
        "deg AS (SELECT v.id, coalesce(o.n, 0) AS out_deg, coalesce(i.n, 0) AS in_deg, coalesce(t.n, 0) AS deg FROM v LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) o ON o.src = v.id "
        "LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) i ON i.dst = v.id LEFT JOIN (SELECT src, count(*) AS n FROM both_ways GROUP BY src) t ON t.src = v.id)"
    )
