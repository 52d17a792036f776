"""Toxicity by subword-bag embeddings averaged into a linear softmax.

Every word stands for the n-grams of its letters (3 to 5 bytes, word ends
included); an n-gram is a bucket with an embedding, a text is the mean of its
embeddings, and a softmax over two labels reads that mean. Embeddings and
softmax are trained jointly with Adam in numpy on a bounded sample of labelled
rows. A misspelling nobody has seen still shares most of its n-grams with the
word it stands for. As the softmax is linear, a bucket's part in the score is
one number, so scoring is one table look-up per n-gram over the whole text.

Bounds: ``PER_LABEL`` labelled rows for each label, of at most ``LEARN_BYTES``
bytes each, are kept for the fit, the ones with the smallest hash of doc_id; the
intercept is corrected to the labels' shares among all learnable rows. Every
text is scored as a whole. Defined results: a null or letterless text scores by
the intercept alone; null doc_ids are not learned from, of rows with one doc_id
the least text is; labels without a document, null labels and repeated labels of
a row (the largest counts) are harmless; without two labels to learn from every
score is the share of label 1 (0 if nothing is known); equal texts get equal
scores, null and repeated doc_ids keep their rows; texts of any length are read
in pieces; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.ngrams import buffers, hashed, held_out
from edgeloom.llm.workers import lean_batches, tidy

PER_LABEL = (3000, 1200)
LEARN_BYTES = 100_000
ORDERS = (3, 4, 5)
BITS = 18
DIMS = 8
COMMON = 0.3  # n-grams of more than this share of the rows tell no labels apart
STEPS = 60
RATE = 0.05
SCALE = 100.0
NEUTRAL = 60  # n-grams without a label that every text is given, so that few words say little
THRESHOLD = 0.3


def _valid(raw: np.ndarray, n: int) -> np.ndarray:
    """Places whose n-gram lies in one word: no space but at its ends, a letter inside."""
    m = len(raw) - 6
    space = raw == 32
    seen = np.concatenate([[0], np.cumsum(space, dtype=np.int32)])
    return (seen[n - 1 : n - 1 + m] == seen[1 : 1 + m]) & ~(space[:m] & space[n - 1 : n - 1 + m] & (n <= 2))


def _bags(texts: list[str | None]):
    """For each text its buckets and their counts."""
    got: list[list[np.ndarray]] = [[] for _ in texts]
    for raw, starts, who in buffers(texts):
        place = np.arange(len(raw) - 6)
        for n in ORDERS:
            ok = _valid(raw, n)
            at, h = place[ok], hashed(raw, n, BITS)[ok]
            cut = np.searchsorted(at, starts)
            for k, i in enumerate(who.tolist()):
                got[i].append(h[cut[k] : cut[k + 1]])
    for parts in got:
        yield np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def train(texts: list[str], labels: list[int], share: float | None = None, seed: int = 0) -> dict:
    """table (a number per bucket), bias; ``share`` is the share of label 1 to expect."""
    y = np.array(labels, np.float64)
    size = 1 << BITS
    sampled = float(y.mean()) if len(y) else 0.0
    if sampled in (0.0, 1.0):
        p = min(max(sampled if share is None else share, 1e-6), 1 - 1e-6)
        return {"table": np.zeros(size, np.float32), "bias": float(np.log(p / (1 - p)))}
    cols, vals = [], []
    for ids, counts in _bags(texts):
        cols.append(ids.astype(np.int32))
        vals.append((counts / (NEUTRAL + counts.sum()) * SCALE).astype(np.float32))
    seen = np.zeros(size, np.int32)
    for ids in cols:
        seen[ids] += 1
    used = np.flatnonzero((seen >= 3) & (seen <= COMMON * len(y)))
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    cols = [place[ids] for ids in cols]
    vals = [v[c >= 0] for v, c in zip(vals, cols, strict=True)]
    cols = [c[c >= 0] for c in cols]
    n, m = len(y), len(used)
    doc = np.repeat(np.arange(n, dtype=np.int32), [len(c) for c in cols])
    col, val = np.concatenate(cols), np.concatenate(vals)
    del cols, vals
    by_col = np.argsort(col, kind="stable").astype(np.int32)
    col_t = col[by_col]
    doc_at, col_at = np.searchsorted(doc, np.arange(n)), np.searchsorted(col_t, np.arange(m))
    del col_t
    full = np.diff(np.append(doc_at, len(doc))) > 0
    doc_at = doc_at[full]

    def by_doc(x):  # mean of x over each text's n-grams
        out = np.zeros(n)
        out[full] = np.add.reduceat(val * x[col], doc_at)
        return out

    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1 / DIMS, (m, DIMS)), rng.normal(0, 0.5, (DIMS, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        emb, soft, bias = params
        logits = np.stack([by_doc((emb @ soft[:, k]).astype(np.float32)) for k in range(2)], 1) + bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        g = (p - np.stack([1 - y, y], 1)) / n
        up = np.stack([np.add.reduceat((val * g[doc, k].astype(np.float32))[by_col], col_at) for k in range(2)], 1)
        grads = [up @ soft.T, emb.T @ up, g.sum(0)]
        for q, d, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    emb, soft, bias = params
    table = np.zeros(size, np.float32)
    table[used] = (emb @ (soft[:, 1] - soft[:, 0])) * SCALE
    p = min(max(sampled if share is None else share, 1e-6), 1 - 1e-6)
    shift = np.log(p / (1 - p)) - np.log(sampled / (1 - sampled))
    return {"table": table, "bias": float(bias[1] - bias[0] + shift)}


def scores(model: dict, texts: list[str | None]) -> np.ndarray:
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    table = model["table"]
    for raw, starts, who in buffers(texts):
        starts = np.minimum(starts[:-1], len(raw) - 7)
        for n in ORDERS:
            ok = _valid(raw, n)
            part = np.where(ok, table[hashed(raw, n, BITS)], np.float32(0)).astype(np.float64)
            np.add.at(total, who, np.add.reduceat(part, starts))
            np.add.at(count, who, np.add.reduceat(ok.astype(np.int64), starts))
    return 1 / (1 + np.exp(-np.clip(total / (NEUTRAL + count) + model["bias"], -40, 40)))


def learn(docs: DataFrame, labels: DataFrame, column: str = "toxic") -> dict:
    """The model of the rows that may be learned from."""
    open_rows = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    marks = labels.where(open_rows & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    wanted = [min(1.0, 1.25 * PER_LABEL[k] / max(1, counts.get(k, 0))) for k in (0, 1)]
    picked = marks.where(draw < F.when(F.col("y") == 1, wanted[1]).otherwise(wanted[0]))
    rows = docs.where(open_rows & (F.octet_length("text") <= LEARN_BYTES)).select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # picked: about 1.25 PER_LABEL rows
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).withColumn("draw", draw)
    rows = rows.toPandas().sort_values(["draw", "doc_id", "text"], kind="stable")  # bounded: see wanted
    rows = pd.concat([rows[rows["y"] == k].head(PER_LABEL[k]) for k in (0, 1)])
    known = counts.get(0, 0) + counts.get(1, 0)
    return train(rows["text"].tolist(), rows["y"].tolist(), counts.get(1, 0) / known if known else 0.0)


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches):
        for b in batches:
            s = scores(model, b["text"].to_pylist())
            held = [held_out(i) for i in b["doc_id"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(held), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
        tidy()

    lean_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score_documents(docs, model)
