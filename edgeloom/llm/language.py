"""Language identification by error-correcting output codes over byte n-grams.

Each language gets a codeword: all splits of the languages in two for up to six
of them, else the widest-spaced of seeded random codes. For each bit a binary
classifier weighs byte 2- and 3-grams by the log-odds of the bit, averages them
over the whole text and passes the mean through a fitted logistic scale.
Decoding is loss-weighted: a bit's logistic loss counts for a language as much
as that bit's classifier is right on it; the nearest codeword wins, and a
runner-up that is close flags the text as ambiguous.

Bounds: at most ``PER_LANGUAGE`` labelled rows of each language, of at most
``LEARN_BYTES`` bytes each, are learned from, those with the smallest hash of
doc_id; every text is identified as a whole. Defined results: ``und`` with
score 0 for a null text or one without a letter (Unicode category L), or if no
language could be learned; a row with a null doc_id or lang is not learned
from; of rows with one lang and doc_id the least text is; equal texts get equal
results, equally near codewords the first language by name; texts of any length
are read in pieces; an empty table gives no rows. ``identify`` replaces columns
named lang_pred, score and ambiguous, other extra columns stay as they are.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.ngrams import buffers, has_letter, hashed
from edgeloom.llm.workers import lean_batches, tidy

PER_LANGUAGE = 500
LEARN_BYTES = 100_000
BITS = 16
SMOOTH = 0.5
AMBIGUOUS = 0.7
UNKNOWN = "und"


def codewords(k: int, seed: int = 0) -> np.ndarray:
    """k rows of +1/-1, no constant columns and no column twice or negated."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= 6:
        cols = [(1, *c) for c in itertools.product((1, -1), repeat=k - 1) if -1 in c]
        return np.array(cols, float).T
    rng, best, width = np.random.default_rng(seed), None, 12 * int(np.ceil(np.log2(k)))
    for _ in range(200):
        code = rng.choice([1.0, -1.0], size=(k, width))
        if (abs(code.sum(0)) == k).any():
            continue
        apart = ((1 - code @ code.T / width) + 2 * np.eye(k)).min()
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


def _counts(texts: list[str]) -> np.ndarray:
    out = np.zeros((2, 1 << BITS))
    for raw, _, _ in buffers(texts):
        for row, n in enumerate((2, 3)):
            out[row] += np.bincount(hashed(raw, n, BITS), minlength=1 << BITS)
    return out


def _means(tables: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Mean weight of each text's n-grams, a column per bit."""
    total, count = np.zeros((len(texts), tables.shape[2])), np.zeros(len(texts))
    for raw, starts, who in buffers(texts):
        m = len(raw) - 6
        at = np.minimum(starts[:-1], m - 1)
        real = raw[:m] != 32
        both = np.where(real[:, None], tables[0][hashed(raw, 2, BITS)], 0) + np.where(real[:, None], tables[1][hashed(raw, 3, BITS)], 0)
        np.add.at(total, who, np.add.reduceat(both, at, axis=0, dtype=np.float64))
        np.add.at(count, who, np.add.reduceat(real.astype(np.int64), at))
    return total / np.maximum(count, 1)[:, None]


def train(texts: list[str], langs: list[str], seed: int = 0) -> dict:
    names = sorted(set(langs))
    code = codewords(len(names), seed)
    kind = np.array([names.index(x) for x in langs], int)
    bits = code.shape[1]
    share = np.zeros((len(names), 2, 1 << BITS))
    for i, _ in enumerate(names):
        c = _counts([t for t, k in zip(texts, kind, strict=True) if k == i]) + SMOOTH
        share[i] = c / c.sum(1, keepdims=True)
    tables = np.zeros((2, 1 << BITS, bits), np.float32)
    for j in range(bits):
        tables[:, :, j] = np.log(share[code[:, j] > 0].mean(0)) - np.log(share[code[:, j] < 0].mean(0))
    model = {"names": names, "code": code, "tables": tables, "scale": np.ones(bits), "shift": np.zeros(bits), "weight": np.ones((len(names), bits))}
    if not bits:
        return model
    means = _means(tables, texts)
    for j in range(bits):  # a logistic scale and shift, by Newton steps with a little shrinkage
        x, y = np.stack([means[:, j], np.ones(len(means))], 1), (code[kind, j] > 0).astype(float)
        w = np.array([1.0, 0.0])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (p - y) + 1e-2 * w)
        model["scale"][j], model["shift"][j] = w
    right = np.sign(means * model["scale"] + model["shift"]) == code[kind]
    weight = np.stack([right[kind == i].mean(0) for i in range(len(names))]) + 1e-3
    model["weight"] = weight / weight.sum(1, keepdims=True)
    return model


def decode(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score (0 to 1) and ambiguity of each text."""
    names, known = model["names"], np.array([has_letter(t) for t in texts])
    if not names:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    f = np.clip(_means(model["tables"], texts) * model["scale"] + model["shift"], -30, 30)
    loss = np.logaddexp(0, -model["code"][None] * f[:, None, :])
    far = (model["weight"][None] * loss).sum(2) * max(1, model["code"].shape[1])
    p = np.exp(-(far - far.min(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    score = np.where(known, p[np.arange(len(p)), best], 0.0)
    return [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], score, known & (score < AMBIGUOUS)


def learn(docs: DataFrame) -> dict:
    """The model of the rows that may be learned from."""
    open_rows = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2) & F.col("lang").isNotNull() & (F.octet_length("text") <= LEARN_BYTES))
    counts = {r["lang"]: r["n"] for r in open_rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}  # a row per language
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.lit(0.0)
    for name, n in sorted(counts.items()):
        share = F.when(F.col("lang") == name, F.lit(min(1.0, 1.3 * PER_LANGUAGE / max(1, n)))).otherwise(share)
    picked = open_rows.where(draw < share).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))  # about 1.3 PER_LANGUAGE rows a language
    rows = picked.withColumn("draw", draw).toPandas()
    rows = rows.sort_values(["draw", "doc_id"], kind="stable").groupby("lang", sort=True).head(PER_LANGUAGE)
    return train(rows["text"].tolist(), rows["lang"].tolist())


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous; its other columns stay as they are."""
    lean_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    docs = docs.select(*keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        for b in batches:
            lang, score, unsure = decode(model, b["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=[*b.schema.names, "lang_pred", "score", "ambiguous"])
        tidy()

    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double, ambiguous boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
