"""Merkle trees over the clauses, paragraphs and sections of a text.

Leaves are short runs of characters inside a paragraph (line). A leaf ends
behind the blanks that follow a sentence mark or a character of every fourth
ASCII code, after MOST characters at the latest, and at the end of the line; so
an insertion moves later cuts no further than the next such place. The leaves
of a text, blanks included, are the whole text without its line ends. A
paragraph hashes its leaves, a section hashes the paragraphs up to one whose
hash ends in 0 to 3, the root hashes the sections. All of that is done on full
MD5 values, so equal roots mean equal texts as far as MD5 goes; where roots
differ, the branches that differ locate the edit. A fingerprint is the whole
tree as a string: root (32 hex digits), sections, paragraphs and leaves (the
first 64 bits of each in base64), each level joined by commas, levels joined by
a blank; paragraphs end with ``;`` in the leaves' level.

Likeness of two fingerprints is Dice's coefficient of their sets of leaves, 1
for equal roots. Everything is a built-in expression.

Defined results: null text counts as empty; a text of no characters has one
paragraph without leaves, and two such texts are alike (1); repeated doc_ids
follow each other by text, rows that are equal in both in any order; null
doc_ids come last in descending order; a text of any length is one row and is
never cut; an empty table gives no rows; a single row is its own next one;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.plans.ranking import range_bounds, range_bucket

MOST = 64
_END = "[" + "".join(map(chr, range(36, 127, 4))).replace("\\", "\\\\") + ".;:!?]"  # codes 36, 40, ..., 124 and the sentence marks
LEAF = rf"[^\n]{{1,{MOST}}}?(?:{_END}[ \t]+|\z)|[^\n]{{{MOST}}}"
ROWS_PER_RANGE = 2000
_LAST = -(1 << 63)


def _short(c: Column) -> Column:
    """The first 64 bits of a hash in hex digits, as 11 characters."""
    return F.substring(F.base64(F.unhex(F.substring(c, 1, 16))), 1, 11)


def _hash(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint of column ``text`` (null: empty)."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    df = df.withColumn("_tree", F.transform(lines, lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), _hash)))
    df = df.withColumn("_paras", F.transform("_tree", lambda a: _hash(F.array_join(a, ""))))
    ends = F.transform("_paras", lambda h: F.concat(h, F.when(F.substring(h, 32, 1) < "4", F.lit("|")).otherwise(F.lit(""))))
    df = df.withColumn("_sections", F.transform(F.split(F.array_join(ends, ""), "\\|", -1), _hash))
    short = lambda name: F.array_join(F.transform(name, _short), ",")
    levels = [_hash(F.array_join("_sections", "")), short("_sections"), short("_paras"), F.array_join(F.transform("_tree", short), ";")]
    return df.withColumn(out, F.concat_ws(" ", *levels)).drop("_tree", "_paras", "_sections")


def leaves(fingerprint: Column) -> Column:
    return F.array_distinct(F.split(F.element_at(F.split(fingerprint, " "), 4), "[,;]"))


def likeness(a: Column, b: Column) -> Column:
    """Dice's coefficient of two arrays of distinct leaves."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 0) of the paragraphs of ``a`` that are nowhere in ``b``; nothing below equal roots is compared."""
    old, new = F.split(F.element_at(F.split(a, " "), 3), ","), F.split(F.element_at(F.split(b, " "), 3), ",")
    at = F.filter(F.sequence(F.lit(0), F.size(old) - 1), lambda i: ~F.array_contains(new, F.element_at(old, i + 1)))
    return F.when(F.substring(a, 1, 32) == F.substring(b, 1, 32), F.array().cast("array<int>")).otherwise(at)


def edited_documents(docs: DataFrame) -> DataFrame:
    """Each document beside the next one in descending doc_id and its edited text.

    doc_id, text, fingerprint, next_text, next_fingerprint, edited. Rows are
    dealt to ranges of doc_id; the first row of a range goes to the range
    above it once more, as the next one of that range's last row.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_key"))
    rows = base.count()
    n = min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_RANGE))
    base = base.withColumn("_b", range_bucket(F.col("_key"), range_bounds(base, "_key", n)))
    tops = base.groupBy("_b").agg(F.max("_key").alias("_key")).orderBy("_b").collect()  # at most n rows
    above = [(r["_b"], r["_key"], tops[(i + 1) % len(tops)]["_b"]) for i, r in enumerate(tops)]
    ghosts = F.broadcast(spark.createDataFrame(above, "_b int, _key long, _up int"))  # at most n rows
    base = base.join(ghosts, ["_b", "_key"], "left")
    own = F.struct(F.col("_b").alias("range"), F.lit(0).alias("ghost"))
    up = F.struct(F.col("_up").alias("range"), F.lit(1).alias("ghost"))
    dealt = base.withColumn("_to", F.explode(F.when(F.col("_up").isNull(), F.array(own)).otherwise(F.array(own, up)))).select("doc_id", "text", "_key", "_to.range", "_to.ghost")
    dealt = with_fingerprint(dealt.repartition("range"), "text", "fingerprint")  # behind the exchange: only texts are moved
    order = Window.partitionBy("range").orderBy("ghost", F.desc("_key"), "text")
    seen = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where("ghost = 0")
    size = F.char_length("text")
    k = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - k), F.substring(F.col("next_text"), F.lit(1), k))
    return seen.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint", edited.alias("edited"))


def query(spark, sf_dir: str) -> DataFrame:
    out = with_fingerprint(edited_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")), "edited", "edited_fingerprint")
    out = out.withColumn("_own", leaves(F.col("fingerprint")))
    return out.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("_own"), leaves(F.col("edited_fingerprint"))).alias("near_edited"),
        likeness(F.col("_own"), leaves(F.col("next_fingerprint"))).alias("near_next"),
    )


def _sql_tree(text: str) -> str:
    return f"list_transform(string_split({text}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{LEAF}', 0), lambda x: md5(x)))"


def _sql_joined(values: str, by: str = "") -> str:
    return f"array_to_string({values}, '{by}')"


def _sql_short(values: str) -> str:
    return f"list_transform({values}, lambda x: substring(to_base64(unhex(substring(x, 1, 16))), 1, 11))"


def _sql_sections(paras: str) -> str:
    ends = f"list_transform({paras}, lambda h: h || CASE WHEN substring(h, 32, 1) < '4' THEN '|' ELSE '' END)"
    return f"list_transform(string_split({_sql_joined(ends)}, '|'), lambda s: md5(s))"


def _sql_fingerprint(k: int) -> str:
    leaves = f"list_transform(t{k}, lambda a: {_sql_joined(_sql_short('a'), ',')})"
    return f"md5({_sql_joined(f's{k}')}) || ' ' || {_sql_joined(_sql_short(f's{k}'), ',')} || ' ' || {_sql_joined(_sql_short(f'p{k}'), ',')} || ' ' || {_sql_joined(leaves, ';')}"


ORACLE_SQL = f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lined AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC, text), first_value(text) OVER (ORDER BY doc_id DESC, text)) AS next_text FROM base),
edits AS (SELECT *, substring(text, 1, length(text) - length(text) // 3) || substring(next_text, 1, length(text) // 3) AS edited FROM lined),
trees AS (SELECT *, {_sql_tree('text')} AS t1, {_sql_tree('edited')} AS t2, {_sql_tree('next_text')} AS t3 FROM edits),
paras AS (SELECT *, list_transform(t1, lambda a: md5({_sql_joined('a')})) AS p1, list_transform(t2, lambda a: md5({_sql_joined('a')})) AS p2, list_transform(t3, lambda a: md5({_sql_joined('a')})) AS p3 FROM trees),
sections AS (SELECT *, {_sql_sections('p1')} AS s1, {_sql_sections('p2')} AS s2, {_sql_sections('p3')} AS s3 FROM paras),
prints AS (SELECT *, {_sql_fingerprint(1)} AS f1, {_sql_fingerprint(2)} AS f2, {_sql_fingerprint(3)} AS f3 FROM sections),
bags AS (SELECT *,
  list_distinct(string_split_regex(string_split(f1, ' ')[4], '[,;]')) AS l1,
  list_distinct(string_split_regex(string_split(f2, ' ')[4], '[,;]')) AS l2,
  list_distinct(string_split_regex(string_split(f3, ' ')[4], '[,;]')) AS l3 FROM prints)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, f1 AS fingerprint, f2 AS edited_fingerprint,
  2.0::DOUBLE * len(list_intersect(l1, l2)) / (len(l1) + len(l2)) AS near_edited,
  2.0::DOUBLE * len(list_intersect(l1, l3)) / (len(l1) + len(l3)) AS near_next
FROM bags
"""
