"""Edge deduplication on a stream of events."""

import datetime as dt

from edgeloom.streaming import new_edges


def test_edges_of_a_stream_come_once(spark, tmp_path):
    rows = [(1, 2, dt.datetime(2024, 1, 1, 1)), (1, 2, dt.datetime(2024, 1, 1, 2)), (2, 1, dt.datetime(2024, 1, 1, 3)), (3, 3, dt.datetime(2024, 1, 1, 4))]
    schema = "src long, dst long, ts timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = new_edges(stream).writeStream.format("memory").queryName("fresh_edges").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((r["src"], r["dst"]) for r in spark.table("fresh_edges").collect())
    assert got.count((1, 2)) == 1 and got.count((2, 1)) == 1
