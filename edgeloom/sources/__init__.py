"""Readers and writers of edge lists, orderings, catalogs and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_edge_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """src, dst of lines ``src dst [more]`` parted by blanks, tabs or commas; comment and broken lines go."""
    text = F.col(column)
    a, b = F.regexp_extract(text, r"^\s*([0-9]+)[\s,]+([0-9]+)", 1), F.regexp_extract(text, r"^\s*([0-9]+)[\s,]+([0-9]+)", 2)
    return lines.where(~text.rlike(r"^\s*[%#]") & (a != "")).select(a.cast("long").alias("src"), b.cast("long").alias("dst"))


def first_data_line(lines: DataFrame, number: str = "n", column: str = "value") -> DataFrame:
    """One row: the 1-based place of the first line that is no comment (``number`` counts lines from 0; null if there is none)."""
    return lines.where(~F.col(column).rlike(r"^\s*[%#]")).agg((F.min(number) + 1).alias("first_data_line"))


def without_header(lines: DataFrame, number: str = "n", column: str = "value") -> DataFrame:
    """The lines from the first one on that is no comment; later comments stay."""
    first = F.broadcast(first_data_line(lines, number, column))  # one row
    return lines.crossJoin(first).where(F.col(number) + 1 >= F.col("first_data_line")).drop("first_data_line")


def read_edge_text(spark: SparkSession, path: str) -> DataFrame:
    """Text edge lists, plain or .gz / .bz2; large plain files are split."""
    return parse_edge_lines(spark.read.text(path))


def write_edge_text(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    edges.select(F.concat_ws(" ", "src", "dst")).write.mode(mode).text(path)


def write_edges(edges: DataFrame, path: str, form: str = "bin", mode: str = "errorifexists") -> None:
    """``bin``: Parquet; ``net``: text."""
    if form == "net":
        write_edge_text(edges, path, mode)
    elif form == "bin":
        edges.select("src", "dst").write.mode(mode).parquet(path)
    else:
        raise ValueError(f"unknown form: {form}")


def read_edges(spark: SparkSession, path: str, form: str = "bin") -> DataFrame:
    return read_edge_text(spark, path) if form == "net" else spark.read.parquet(path).select("src", "dst")


def write_ordering(ordering: DataFrame, path: str, mode: str = "errorifexists", form: str = "bin", m: int | None = None) -> None:
    """``bin``: Parquet; ``net``: text lines ``id new_id`` in one folder, headed by a file with the counts of vertices and edges."""
    if form == "bin":
        ordering.select("id", "new_id").write.mode(mode).parquet(path)
    elif form == "net":
        spark = ordering.sparkSession
        spark.createDataFrame([(str(ordering.count()),), (str(m or 0),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/counts")
        ordering.select(F.concat_ws(" ", "id", "new_id")).write.mode(mode).text(f"{path}/map")
    else:
        raise ValueError(f"unknown form: {form}")


def read_ordering_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``id new_id`` of a file or folder; lines of a single number (the counts at the head) are passed over."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return parse_edge_lines(lines).select(F.col("src").alias("id"), F.col("dst").alias("new_id"))


def ordering_to_bin(spark: SparkSession, text: str, path: str) -> DataFrame:
    """A permutation from text to Parquet; returns what was written."""
    write_ordering(read_ordering_text(spark, text), path)
    return spark.read.parquet(path).select("id", "new_id")


def write_triplets(triplets: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A sparse matrix as (row, col, val); rows without entries need no line."""
    triplets.select("row", "col", "val").write.mode(mode).parquet(path)


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("row", "col", "val")


def columns_in_text(lines: DataFrame, number: str = "n", column: str = "value") -> DataFrame:
    """One row: how many fields the first line that is no comment has, parted by blanks, else by tabs."""
    line = lines.where(~F.col(column).rlike(r"^\s*[%#]")).agg(F.min_by(column, number).alias("_line"))
    blanks = F.size(F.split(F.trim("_line"), " +"))
    return line.select(F.when(F.instr(F.trim("_line"), " ") > 0, blanks).otherwise(F.size(F.split("_line", "\t"))).alias("n_columns"))


def files_by_size(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of the files below a folder, the largest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length").orderBy(F.desc("length"), "path")


def pick_edge_file(spark: SparkSession, folder: str) -> str | None:
    """The smallest file whose stem is ``out``, else the largest file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^/]*)?$", 1)
    named = files.where(stem == "out").agg(F.min_by("path", "length")).head()[0]
    return named or files.agg(F.max_by("path", "length")).head()[0]


def read_tar(spark: SparkSession, path: str) -> DataFrame:
    """name, content of the files in tar archives (.tar, .tar.gz, .tar.bz2), an archive per task."""
    import io
    import tarfile

    import pyarrow as pa

    def unpack(batches):
        for batch in batches:
            for raw in batch["content"].to_pylist():
                with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
                    for m in tar:
                        if m.isfile():
                            yield pa.RecordBatch.from_pydict({"name": [m.name], "content": pa.array([tar.extractfile(m).read()], pa.binary())})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "name string, content binary")


def read_datasets_json(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """The rows of ``datasets`` in a JSON catalog, by name if asked."""
    rows = spark.read.option("multiLine", "true").json(path).select(F.explode("datasets").alias("d")).select("d.*")
    return rows.where(F.col("name").isin(*names)) if names else rows


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", "true").csv(path)


def read_csv_tree(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All CSV files below a folder; nothing is deleted."""
    return spark.read.schema(schema).option("header", "true").option("recursiveFileLookup", "true").csv(path)


def href_edges(pages: DataFrame) -> DataFrame:
    """page_id, href of every link in a page."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)).alias("href"))


def table_cells(pages: DataFrame, column: str = "html") -> DataFrame:
    """page_id, row, cells: text of the cells of each table row."""
    rows = F.posexplode(F.regexp_extract_all(column, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1))
    cells = F.transform(F.regexp_extract_all("_row", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", "")))
    return pages.select("page_id", rows.alias("row", "_row")).select("page_id", "row", cells.alias("cells"))


def labelled_values(cells: DataFrame) -> DataFrame:
    """page_id, label, text, value of table rows (label, symbol, value): the label in snake case, the value as a number where it is one."""
    from edgeloom.functions import parse_numeric, snake_label

    rows = cells.where(F.size("cells") >= 3)
    text = F.element_at("cells", 3)
    return rows.select("page_id", snake_label(F.element_at("cells", 1)).alias("label"), text.alias("text"), parse_numeric(text).alias("value"))


def pivoted_values(values: DataFrame, labels: list[str]) -> DataFrame:
    """A row per page with a column per label, and ``directed`` (1 unless the network format says undirected)."""
    form = F.max(F.when(F.col("label") == "network_format", (~F.col("text").contains("undirected")).cast("int"))).alias("directed")
    return values.groupBy("page_id").agg(*[F.max(F.when(F.col("label") == k, F.col("value"))).alias(k) for k in labels], form)


def unexpected_columns(found: DataFrame, known: list[str], column: str = "label") -> DataFrame:
    """Names that occur in a column of names and are not known."""
    return found.select(F.col(column).alias("name")).distinct().where(~F.col("name").isin(*known))


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Wanted column names that a table does not have, sorted."""
    return sorted(set(wanted) - set(df.columns))


#: Columns of a partitioner's log and the words before their values.
PARTITION_FIELDS = {
    "name": "Name: ",
    "num_parts": "#Parts: ",
    "num_vertices": "#Vertices: ",
    "num_edges": "#Edges: ",
    "part_time": "Partitioning: ",
    "io_time": "I/O: ",
    "comm_vol": "communication volume: ",
    "edge_cut": "Edgecut: ",
    "max_mem_used": "Max memory used: ",
    "rusage_ru_maxrss": "rusage.ru_maxrss: ",
    "report_time": "Reporting: ",
}


def partition_runs(logs: DataFrame, text: str = "value", path: str = "path") -> DataFrame:
    """A row per run in the logs of a partitioner (one log per row, whole): name, obj_type, the fields, and the timer's figures.

    ``obj_type`` is the last part but one of the file name. The timer writes a
    signed number per run behind the runs, then the mean and the deviation.
    Logs that lack a field give no rows, as do empty ones.
    """
    found = logs
    for field, words in PARTITION_FIELDS.items():
        stop = "[^, ]*" if field in ("name", "part_time", "io_time", "report_time", "max_mem_used", "rusage_ru_maxrss") else "[^, .]*"
        found = found.withColumn(field, F.regexp_extract_all(F.regexp_replace(text, r"\s+", " "), F.lit(f"{words.replace('.', '[.]')}({stop})"), 1))
    perf = F.regexp_extract_all(F.col(text), F.lit(r"(?m)^\s*([+-]?[0-9]+[.][0-9]+)(?= )"), 1)
    found = found.withColumn("perf", perf).withColumn("obj_type", F.element_at(F.split(F.element_at(F.split(path, "/"), -1), "[.]"), -2))
    needed = [f for f in PARTITION_FIELDS if f != "report_time"]
    found = found.where(F.least(*[F.size(f) for f in needed]) > 0)
    runs = found.select("obj_type", "perf", F.posexplode(F.arrays_zip(*PARTITION_FIELDS)).alias("i", "run"))
    total, spread = F.try_element_at("perf", F.lit(-2)), F.try_element_at("perf", F.lit(-1))
    time = F.try_element_at("perf", F.col("i") + 1)
    values = [F.element_at(F.split("run.name", "/"), -1).alias("name"), "obj_type"]
    values += [F.col(f"run.{f}").cast("double" if "time" in f or "mem" in f or "rss" in f else "long").alias(f) for f in PARTITION_FIELDS if f != "name"]
    return runs.where(F.col("run.name").isNotNull()).select(*values, *[c.cast("double").alias(n) for c, n in ((time, "perf_time"), (total, "perf_total_time"), (spread, "perf_std"))])


def partition_log(logs: DataFrame) -> DataFrame:
    """parts, objective, value of the lines ``#Parts: k ... - Edgecut: c, communication volume: v`` of partitioner logs."""
    parts = F.regexp_extract("value", r"#Parts:\s*([0-9]+)", 1)
    cut, volume = F.regexp_extract("value", r"Edgecut:\s*([0-9]+)", 1), F.regexp_extract("value", r"volume:\s*([0-9]+)", 1)
    return logs.select(*[F.when(c != "", c).cast("long").alias(n) for c, n in ((parts, "parts"), (cut, "edge_cut"), (volume, "volume"))])


def motif_lines(outputs: DataFrame, names: dict[str, str], text: str = "value") -> DataFrame:
    """motif, n of the lines ``pattern: count`` of a motif counter's output; three lines of heading and the last line are passed over."""
    lines = F.split(text, "\n")
    body = F.slice(lines, 4, F.greatest(F.lit(0), F.size(lines) - 4))
    line = outputs.select("*", F.explode(body).alias("_line"))
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return line.select(*[c for c in outputs.columns if c != text], known[F.substring_index("_line", ":", 1)].alias("motif"), F.trim(F.element_at(F.split("_line", ":"), 2)).cast("long").alias("n"))


def job_states(jobs: DataFrame, column: str = "value") -> DataFrame:
    """job_id, state of a scheduler's JSON report."""
    schema = "jobs array<struct<job_id: long, state: struct<current: string>>>"
    return jobs.select(F.explode(F.from_json(column, schema)["jobs"]).alias("j")).select("j.job_id", F.col("j.state.current").alias("state"))
