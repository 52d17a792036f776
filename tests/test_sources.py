"""Readers and writers, by round trip."""

import gzip
import tarfile

from edgeloom import sources
from edgeloom.streaming import daily_counts, event_stream


def test_text_edges(spark, tmp_path):
    text = "% head\n# more\n1 2\n3\t4 0.5\n\n% 9 9\nx y\n5,6\n"
    (tmp_path / "a.txt").write_text(text)
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("7 8\n")
    got = sorted(tuple(r) for r in sources.read_edge_text(spark, str(tmp_path)).collect())
    assert got == [(1, 2), (3, 4), (5, 6), (7, 8)]


def test_edge_files_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(1, 2), (3, 4)], "src long, dst long")
    for form in ("bin", "net"):
        sources.write_edges(e, str(tmp_path / form), form)
        assert sorted(sources.read_edges(spark, str(tmp_path / form), form).collect()) == sorted(e.collect())


def test_ordering_text_skips_counts(spark, tmp_path):
    (tmp_path / "o").write_text("3\n2\n0 2\n1 0\n2 1\n")
    assert sorted(tuple(r) for r in sources.read_ordering_text(spark, str(tmp_path / "o")).collect()) == [(0, 2), (1, 0), (2, 1)]


def test_tar_and_pick(spark, tmp_path):
    (tmp_path / "out.x").write_text("1 2\n")
    (tmp_path / "big.txt").write_text("1 2\n" * 50)
    assert sources.pick_edge_file(spark, str(tmp_path)).endswith("out.x")
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        t.add(tmp_path / "out.x", "d/out.x")
    assert [r["name"] for r in sources.read_tar(spark, str(tmp_path / "t.tar.gz")).collect()] == ["d/out.x"]


def test_json_tables_and_logs(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"datasets": [{"name": "a", "data-url": "u"}, {"name": "b", "data-url": "v"}]}')
    assert [r["name"] for r in sources.read_datasets_json(spark, str(tmp_path / "d.json"), ["b"]).collect()] == ["b"]
    page = spark.createDataFrame([(1, "<table><tr><th>Size</th><td><b>5</b></td></tr></table>")], "page_id long, html string")
    assert sources.table_cells(page).head()["cells"] == ["Size", "5"]
    log = spark.createDataFrame([("Options: #Parts: 8 - Edgecut: 31, communication volume: 40.",)], "value string")
    assert tuple(sources.partition_log(log).head()) == (8, 31, 40)
    job = spark.createDataFrame([('{"jobs": [{"job_id": 3, "state": {"current": "DONE"}}]}',)], "value string")
    assert tuple(sources.job_states(job).head()) == (3, "DONE")


def test_csv_append_and_tree(spark, tmp_path):
    df = spark.createDataFrame([("g", 1)], "name string, n int")
    for _ in range(2):
        sources.append_csv(df, str(tmp_path / "x"))
    assert sources.read_csv_tree(spark, str(tmp_path), "name string, n int").count() == 2


def test_event_stream_counts_closed_days(spark, tmp_path):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(hours=6 * i), i % 2, "a", 1.0) for i in range(12)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events"))
    q = daily_counts(event_stream(spark, str(tmp_path / "events"), "*.parquet")).writeStream.format("memory").queryName("days").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r["n"] for r in spark.table("days").collect()) == 8
