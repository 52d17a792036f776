"""SimHash near-duplicates by meeting in the middle of the Hamming ball.

Two 64-bit fingerprints that differ in at most three bits share a variant in
the middle. Parity says who flips how many: a pair with unequal parity differs
in 1 or 3 bits, and then the odd one flips one bit and the even one none or
two; a pair with equal parity differs in 2 bits and both flip one. Of three
differing bits two lie in the same half of the word, so the pairs of bits that
even fingerprints flip need only be pairs inside a half (992 of 2016). That
leaves 64 variants of an odd and 1,057 of an even fingerprint, no pair is
missed, and only distinct fingerprints take part.

Variants are shuffled on their value, dealt to buckets whose number follows
the input. A row carries, for one bucket, the fingerprints of a batch and
the numbers of the masks they used: two bytes a variant. At one variant there
are at most 2,081 distinct fingerprints, so no bucket can run hot, and the
fingerprints there are linked to one of them, not all to all: those one bit
off are within two bits of each other, those one and two bits off within three.

Defined results: a null, empty or blank text has fingerprint zero and links to
other zeros; null and repeated doc_ids keep their rows (a null never names a
component unless it has no other); extra columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.workers import lean_batches, tidy
from edgeloom.operators.components import connected_components
from edgeloom.plans.durable import written

RADIUS = 3
SHINGLE = 3
SEED = 42
VARIANTS_PER_BUCKET = 1_200_000
_LOW = np.uint64(0x0101010101010101)


def _masks() -> tuple[np.ndarray, int]:
    """Masks of weight 1, then 0 and 2 (inside a half); the count of the first."""
    one = [1 << i for i in range(64)]
    two = [one[i] | one[j] for i in range(64) for j in range(i + 1, 64) if i // 32 == j // 32]
    return np.array([*one, 0, *two], np.uint64), len(one)


MASKS, N_ONE = _masks()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i : i + n] for i in range(shingle)), strict=True)) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    if n % 255:
        h = np.concatenate([h, np.zeros(255 - n % 255, np.uint64)])
    h, out = h.reshape(-1, 255), 0
    for j in range(8):  # eight counters of a byte each at a time; 255 hashes cannot overflow them
        sums = ((h >> np.uint64(j)) & _LOW).sum(axis=1, dtype=np.uint64)
        counts = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n).tolist():
            out |= 1 << (8 * byte + j)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
        tidy()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return z ^ (z >> np.uint64(29))


def _deal(fps: np.ndarray, masks: np.ndarray, first: int, buckets: int):
    """bucket, payload for the variants of some fingerprints."""
    z = (fps[:, None] ^ masks[None, :]).ravel()
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    bucket = (_mixed(z) % np.uint64(buckets)).astype(kind)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.int64)) if buckets < len(z) else None
    used = np.flatnonzero(np.diff(ends)) if ends is not None else np.unique(bucket)
    for b in used.tolist():
        if ends is not None:
            at = order[ends[b] : ends[b + 1]]
        else:
            at = np.flatnonzero(bucket == b)
        who, code = at // len(masks), (at % len(masks) + first).astype("<u2")
        ids, counts = np.unique(who, return_counts=True)
        yield b, np.uint32(len(ids)).tobytes() + fps[ids].astype("<u8").tobytes() + counts.astype("<u2").tobytes() + code.tobytes()


def _undeal(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(payload, "<u4", 1)[0])
    fps = np.frombuffer(payload, "<u8", n, 4)
    counts = np.frombuffer(payload, "<u2", n, 4 + 8 * n)
    return np.repeat(fps, counts), np.frombuffer(payload, "<u2", -1, 4 + 10 * n)


def _links(fp: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Links (rep, other) among the fingerprints that share a variant; each within RADIUS."""
    z = fp ^ MASKS[code]
    order = np.argsort(z)
    z, fp, code = z[order], fp[order], code[order]
    new = np.concatenate([[True], z[1:] != z[:-1]]) if len(z) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(z)))
    shared = np.repeat(sizes > 1, sizes)
    if not shared.any():
        return np.zeros((0, 2), np.uint64)
    fp, one, run = fp[shared], code[shared] < N_ONE, np.repeat(np.arange((sizes > 1).sum()), sizes[sizes > 1])
    at = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    rep = np.minimum.reduceat(np.where(one, fp, top), at)[run]
    has = np.add.reduceat(one.astype(np.int64), at)[run] > 0
    keep = has & (rep != fp) & (np.bitwise_count(rep ^ fp) <= RADIUS)
    return np.unique(np.stack([rep[keep], fp[keep]], 1), axis=0)


def near_links(fps: DataFrame) -> DataFrame:
    """src, dst: links between distinct fingerprints of ``fps`` (column fp) that keep its components."""
    spark = fps.sparkSession
    fps = written(fps.select("fp").where("fp is not null").distinct(), "fps")
    n = fps.count()
    buckets = max(1, -(-n * (1 + (len(MASKS) + N_ONE) // 2) // VARIANTS_PER_BUCKET))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 8192))

    def emit(batches):
        for b in batches:
            fp = b["fp"].to_numpy().view(np.uint64)
            odd = np.bitwise_count(fp) % 2 == 1
            for own, masks in ((fp[odd], MASKS[:N_ONE]), (fp[~odd], MASKS)):
                for at in range(0, len(own), 4096):
                    rows = list(_deal(own[at : at + 4096], masks, 0, buckets))
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])
        tidy()

    def meet(table: pa.Table) -> pa.Table:
        parts = [_undeal(p.as_py()) for p in table["payload"]]
        got = _links(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])).view(np.int64)
        return pa.table({"src": pa.array(got[:, 0]), "dst": pa.array(got[:, 1])})

    dealt = fps.repartition(parts, "fp").mapInArrow(emit, "bucket long, payload binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links)."""
    lean_batches(docs.sparkSession)
    marks = written(fingerprints(docs, shingle), "marks")
    per = marks.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = connected_components(near_links(marks)).withColumnRenamed("id", "fp")
    per = per.join(comp, "fp", "left").select("fp", "least", F.coalesce("comp", "fp").alias("root"))
    named = per.groupBy("root").agg(F.min("least").alias("component_id"))
    names = per.join(named, "root").select("fp", "component_id")
    return marks.join(names, "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
