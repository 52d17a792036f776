"""Benchmark passages in documents, found by spaced-seed hashing.

Texts are lower-cased and cut into words (letters and digits). A mask picks
some of a few neighbouring words and ignores the others; the hashes of the
picked words of the benchmark items are joined with those of the documents. A
hit fixes how item and document lie against each other. There the words are
compared place by place, and the document is contaminated if some window of
``WINDOW`` words (the whole item if it is shorter) agrees in at least 80 %.

The mask 11011 alone meets every window of 20 words with up to four
substitutions (all 4,845 patterns were tried); both masks meet all that items
of 15 words or more may differ in. If there are items below that, three masks
more are used for all, and no pattern is missed from five words on. Documents
are not shuffled: their seeds meet the item seeds in a map-side join as long as
these and the items' words (``ROW_BYTES`` for each) are below
``BROADCAST_BYTES``; beyond, narrow seed rows are shuffled and only documents
with hits are read again. Where a passage agrees word by word every place is a
hit of the same lie; only the first of such a run is compared.

Defined results: null or empty texts have no words and match nothing; items of
fewer than five words cannot be found; null ids are kept as they are; repeated
rows count once; a text of any length is one row; empty tables, of documents or
of items, give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASKS = ((0, 1, 3, 4), (0, 2, 3, 5))
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 2, 3, 4))
SHORT = 15
WINDOW = 20
SHARE = 0.8
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 96


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def _seed(place: Column, which: Column, masks: tuple) -> Column:
    """Hash of the words that a mask picks at a place of ``tokens`` (null where it does not fit)."""
    out = F.lit(None).cast("long")
    for k, mask in reversed(list(enumerate(masks))):
        fits = (place >= 0) & (place + mask[-1] < F.size("tokens"))
        out = F.when(which == k, F.when(fits, F.xxhash64(F.lit(k), *[F.get("tokens", place + o) for o in mask]))).otherwise(out)
    return out


def _seeds(df: DataFrame, at: str, masks: tuple = MASKS) -> DataFrame:
    """A row per mask and place where the mask fits into ``tokens``: adds ``at``, ``mask`` and ``seed``."""
    n = len(masks)
    spread = df.where(F.size("tokens") > min(m[-1] for m in masks)).withColumn("_g", F.explode(F.sequence(F.lit(0), n * F.size("tokens") - 1)))
    spread = spread.withColumn(at, F.floor(F.col("_g") / n).cast("int")).withColumn("mask", (F.col("_g") % n).cast("int"))
    return spread.withColumn("seed", _seed(F.col(at), F.col("mask"), masks)).where("seed is not null").drop("_g")


def _agreement(df: DataFrame) -> DataFrame:
    """Keeps rows whose item lies over the document (``lead`` words in) with a window that agrees; adds matched."""
    need = F.least(F.lit(WINDOW), F.size("item_tokens"))
    same = F.transform(F.sequence(F.lit(0), F.size("item_tokens") - 1), lambda k: F.when(F.get("tokens", F.col("lead") + k) == F.get("item_tokens", k), 1).otherwise(0))
    # F.get is null for places before or behind the words, and null never agrees.
    df = df.withColumn("same", same).withColumn("matched", F.aggregate("same", F.lit(0), lambda a, x: a + x))
    df = df.where(F.col("matched") >= F.ceil(need * SHARE))
    best = F.exists(F.sequence(F.lit(0), F.size("item_tokens") - need), lambda s: F.aggregate(F.slice("same", s + 1, need), F.lit(0), lambda a, x: a + x) >= F.ceil(need * SHARE))
    return df.where(best).drop("same")


def overlaps(docs: DataFrame, items: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, item_id, matched (most words that agree at one lie), item_words: a row per contaminated pair."""
    docs = docs.select("doc_id", "text")
    items = items.select("item_id", words(F.col("text")).alias("item_tokens")).where(F.size("item_tokens") > 0)
    n_words, octets, short = items.agg(F.coalesce(F.sum(F.size("item_tokens")), F.lit(0)), F.coalesce(F.sum(F.octet_length(F.array_join("item_tokens", " "))), F.lit(0)), F.count_if(F.size("item_tokens").between(5, SHORT - 1))).head()
    masks = MASKS + SHORT_MASKS if short else MASKS
    size = n_words * (len(masks) + 1) * ROW_BYTES + octets
    seeds = _seeds(items.withColumnRenamed("item_tokens", "tokens"), "item_at", masks)
    seeds = seeds.select("item_id", "item_at", "mask", "seed", _seed(F.col("item_at") - 1, F.col("mask"), masks).alias("before")).distinct()
    named = items.withColumnRenamed("item_id", "_item")
    lead = (F.col("at") - F.col("item_at")).alias("lead")
    tokens = words(F.col("text")).alias("tokens")
    if size <= broadcast_bytes:
        hits = _seeds(docs.select("doc_id", tokens), "at", masks).join(F.broadcast(seeds), ["seed", "mask"])
        begins = ~F.coalesce(F.col("before") == _seed(F.col("at") - 1, F.col("mask"), masks), F.lit(False))
        hits = hits.where(begins).select("doc_id", "tokens", "item_id", lead)
        found = hits.join(F.broadcast(named), F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")
    else:
        key = F.xxhash64("doc_id", "text").alias("_row")
        hits = _seeds(docs.select(key, tokens), "at", masks).select("_row", "at", "mask", "seed").join(seeds, ["seed", "mask"]).select("_row", "item_id", lead).distinct()
        found = docs.select("doc_id", key, tokens).join(hits, "_row").join(named, F.col("item_id").eqNullSafe(F.col("_item"))).drop("_item")
    return _agreement(found).groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.first(F.size("item_tokens")).cast("long").alias("item_words"))


def query(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql_seeds(source: str, key: str) -> str:
    parts = []
    for k, m in enumerate(MASKS):
        picked = " || chr(1) || ".join(f"tokens[i + {o + 1}]" for o in m)
        parts.append(f"SELECT {key}, i AS at, {k} AS mask, {picked} AS seed FROM (SELECT {key}, tokens, unnest(range(0, len(tokens) - {m[-1]})) AS i FROM {source} WHERE len(tokens) > {m[-1]})")
    return " UNION ALL ".join(parts)


def _sql_words(table: str, key: str) -> str:
    return rf"SELECT {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS tokens FROM {table}"


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, * FROM ({_sql_words('documents', 'doc_id')})),
b AS ({_sql_words('benchmark', 'item_id')}),
ds AS ({_sql_seeds('d', 'rid')}), bs AS ({_sql_seeds('b', 'item_id')}),
hits AS (SELECT DISTINCT ds.rid, bs.item_id, ds.at - bs.at AS lead FROM ds JOIN bs USING (mask, seed)),
lies AS (SELECT d.doc_id, h.item_id, len(b.tokens) AS n,
  list_transform(range(0, len(b.tokens)), lambda k: CASE WHEN h.lead + k >= 0 AND h.lead + k < len(d.tokens) AND d.tokens[h.lead + k + 1] = b.tokens[k + 1] THEN 1 ELSE 0 END) AS same
  FROM hits h JOIN d USING (rid) JOIN b USING (item_id)),
kept AS (SELECT * FROM lies WHERE len(list_filter(range(0, n - least({WINDOW}, n) + 1), lambda s: list_sum(same[s + 1 : s + least({WINDOW}, n)]) >= ceil(least({WINDOW}, n) * {SHARE}))) > 0)
SELECT doc_id, item_id, max(list_sum(same))::BIGINT AS matched, any_value(n)::BIGINT AS item_words FROM kept GROUP BY doc_id, item_id
"""
