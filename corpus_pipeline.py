"""Five stages from raw documents to packed training sequences.

Each stage takes all that its predecessor kept. All but the last return the
columns of ``documents``. Every stage decides on rows: a null doc_id counts as
larger than all others, and rows that share a doc_id are told apart by text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom.llm import decontaminate, language, near_copies, packing, suffix_dedup
from edgeloom.plans.durable import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NONE = (1 << 63) - 1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which no language can be told (null, or no letter) go; the others carry the language that was found."""
    docs = docs.select(*COLUMNS)
    found = language.identify(docs, language.learn(docs)).where(F.col("lang_pred") != language.UNKNOWN)
    return found.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash, then five-word shingles with a Jaccard of 0.8 at least) the row with the smallest doc_id stays (null is the largest; of rows with one text and doc_id the first by source, lang and n_chars)."""
    docs = docs.select(*COLUMNS)
    groups = near_copies.near_duplicates(docs.select("doc_id", "text"))
    per = groups.groupBy("root", F.col("key").alias("_key"), "doc_id").agg(F.count(F.lit(1)).alias("alike")).withColumn("_id", F.coalesce("doc_id", F.lit(NONE)))
    first = per.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key", "_id", "alike")).alias("m")).select("m._key", "m._id", "m.alike")
    first = written(first, "first")
    named = docs.withColumn("_key", near_copies.text_key()).withColumn("_id", F.coalesce("doc_id", F.lit(NONE)))
    gone = written(per.select("_key", "_id").distinct().join(first, ["_key", "_id"], "left_anti"), "gone")
    if first.agg(F.max("alike")).head()[0] in (None, 1) and gone.count() <= near_copies.BROADCAST_ROWS:  # texts need not move
        return named.join(F.broadcast(gone), ["_key", "_id"], "left_anti").select(*COLUMNS)
    again = Window.partitionBy("_key", "_id").orderBy(F.col("doc_id").isNull(), "source", "lang", "n_chars")  # dealt as the join has dealt the rows: texts move once
    return named.join(first, ["_key", "_id"], "left_semi").withColumn("_n", F.row_number().over(again)).where("_n = 1").select(*COLUMNS)


def remove_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long byte strings of earlier documents are cut out; documents of which nothing is left go."""
    docs = docs.select(*COLUMNS)
    done = suffix_dedup.remove_repeats(docs, extra=["lang", "source"]).where("n_removed < n_bytes or n_bytes = 0")
    extra = F.from_json("extra", "lang string, source string")
    done = done.select("doc_id", F.col("kept").cast("string").alias("text"), extra.alias("e"))
    return done.select("doc_id", "text", "e.lang", "e.source", F.char_length("text").cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    docs = docs.select(*COLUMNS).withColumn("_key", F.xxhash64("doc_id", "text"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = decontaminate.overlaps(docs.select(F.col("_key").alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_key")).distinct()
    return docs.join(bad, "_key", "left_anti").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in one sequence of at most 2048."""
    return packing.with_crc(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", remove_repeated_bytes),
    ("decontaminate", drop_contaminated),
    ("pack", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
