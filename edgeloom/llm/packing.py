"""Packing by cutting-stock column generation.

Documents are encoded once and cut at multiples of the sequence length; what
is left of each is a piece of less than a sequence. The pieces' lengths, in
steps of ``GRAIN`` tokens, form a histogram with at most LENGTH / GRAIN bars,
whatever the input. A linear program over patterns (multisets of lengths that
fit one sequence) covers it: a revised simplex starts from the patterns of
first-fit decreasing and holds the basis, a knapsack
dynamic program prices further columns, and it ends when the area bound or
Farley's bound says that
at most ``GAP`` is left to gain. Patterns are rounded down, then up as long as
their lengths are still there; pieces are ranked within their length (per-task
counters plus a running sum over tasks) and rank ranges are mapped to pattern
copies. The pieces that no rounded pattern takes (their number is bounded by
the histogram, not by the input) fill sequences one after another and are cut
where a sequence is full.

Defined results: a null or empty text is its end id alone; null and repeated
doc_ids keep their rows; an empty table gives no rows; extra columns are
ignored. Only the last sequence can be padded by more than its pieces' rounding.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.llm.encoding import default_tokenizer, encoder
from edgeloom.llm.workers import lean_batches, tidy
from edgeloom.plans.durable import fresh_path
from edgeloom.plans.ranking import running_offsets

LENGTH = 2048
GRAIN = 4
GAP = 2e-4
END_ID = 1


def knapsack(value: np.ndarray, size: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of a multiset of sizes (ascending) for each room up to ``room``; the item taken last there, -1 for none."""
    best, taken = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(size, np.arange(room + 1), side="right").tolist()
    for cap in range(1, room + 1):
        best[cap] = best[cap - 1]
        k = fits[cap]
        if k:
            got = value[:k] + best[cap - size[:k]]
            i = got.argmax()
            if got[i] > best[cap] + 1e-12:
                best[cap], taken[cap] = got[i], i
    return best, taken


def pattern_from(taken: np.ndarray, size: np.ndarray, room: int, with_item: int = -1) -> np.ndarray:
    pattern, cap = np.zeros(len(size), np.int64), room
    if with_item >= 0:
        pattern[with_item] += 1
        cap -= int(size[with_item])
    while cap > 0:
        i = taken[cap]
        if i < 0:
            cap -= 1
        else:
            pattern[i] += 1
            cap -= int(size[i])
    return pattern


def first_fit(size: np.ndarray, need: np.ndarray, room: int) -> list[np.ndarray]:
    """Patterns of first-fit decreasing over the histogram, the columns to begin with."""
    left, out = need.astype(np.int64).copy(), []
    while left.any():
        pattern, free = np.zeros(len(size), np.int64), room
        for i in range(len(size) - 1, -1, -1):
            if left[i] and size[i] <= free:
                pattern[i] = min(int(left[i]), free // int(size[i]))
                free -= int(pattern[i]) * int(size[i])
        used = pattern > 0
        left -= pattern * int((left[used] // pattern[used]).min())
        out.append(pattern)
    return out


def inverted(basis: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots, in plain array steps (a threaded library would fight the executors of a local session)."""
    m = len(basis)
    a = np.concatenate([basis.astype(float), np.eye(m)], 1)
    for i in range(m):
        top = i + int(np.abs(a[i:, i]).argmax())
        if top != i:
            a[[i, top]] = a[[top, i]]
        a[i] /= a[i, i]
        rows = np.flatnonzero(a[:, i])
        rows = rows[rows != i]
        a[rows] -= a[rows, i, None] * a[i]
    return a[:, m:]


def solve_patterns(size: np.ndarray, need: np.ndarray, room: int, gap: float = GAP, most: int = 2000) -> list[tuple[np.ndarray, float]]:
    """(pattern, times) of a linear program that covers ``need`` with the fewest sequences, within ``gap``."""
    m, floor = len(size), float((size * need).sum()) / room
    patterns = [np.eye(m, dtype=np.int64)[i] * (room // size[i]) for i in range(m)]
    inverse = np.diag([1.0 / p.max() for p in patterns])
    times, ready, pivots = (inverse * need).sum(1), first_fit(size, need, room)[::-1], 0
    while pivots < most and times.sum() > floor * (1 + gap):
        prices = inverse.sum(0)
        column = ready.pop() if ready else pattern_from(knapsack(prices, size, room)[1], size, room)
        held = np.flatnonzero(column)
        worth = float((prices[held] * column[held]).sum())
        if worth <= 1 + gap:
            if ready:
                continue
            break
        move = (inverse[:, held] * column[held]).sum(1)
        up = move > 1e-9
        out = int(np.where(up, times / np.where(up, move, 1), np.inf).argmin())
        patterns[out] = column
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        pivots += 1
        if pivots % 300 == 0:
            inverse = inverted(np.stack(patterns, 1))
        times = np.maximum((inverse * need).sum(1), 0)
    return list(zip(patterns, times.tolist(), strict=True))


def round_patterns(solution: list[tuple[np.ndarray, float]], need: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that take no more of a length than there is."""
    left, counts = need.astype(np.int64).copy(), []
    for p, x in solution:
        k = int(x + 1e-9)
        used = p > 0
        k = min(k, int((left[used] // p[used]).min())) if used.any() else 0
        left -= k * p
        counts.append(k)
    for i in sorted(range(len(solution)), key=lambda i: -(solution[i][1] - counts[i])):
        p = solution[i][0]
        if solution[i][1] - counts[i] > 1e-6 and (p <= left).all() and p.any():
            left -= p
            counts[i] += 1
    return [(p, k) for (p, _), k in zip(solution, counts, strict=True) if k]


def encode_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """Written table of pieces: part, kind (length in grains), nth (of its kind in the part), doc_id, start, length, doc_tokens, ids."""
    lean_batches(docs.sparkSession)
    name = tokenizer or default_tokenizer()

    def run(batches):
        enc, part = encoder(name), TaskContext.get().partitionId()
        met: dict[int, int] = {}
        for b in batches:
            rows: list[list] = [[], [], [], [], [], [], []]
            held = 0
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                ids = np.append(enc.ids(text), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), length):
                    piece = ids[at : at + length]
                    kind = -(-len(piece) // grain)
                    nth = met.get(kind, 0)
                    met[kind] = nth + 1
                    for column, v in zip(rows, (kind, nth, doc, at, len(piece), len(ids), piece.tobytes()), strict=True):
                        column.append(v)
                held += len(ids)
                if held > 1_000_000:
                    yield batch(part, rows)
                    rows, held = [[], [], [], [], [], [], []], 0
            if rows[0]:
                yield batch(part, rows)
        tidy()

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["kind", "nth", "doc_id", "start", "length", "doc_tokens", "ids"]

    def batch(part, rows):
        return pa.RecordBatch.from_arrays([pa.array([part] * len(rows[0]), pa.int32()), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], names=["part", *names])

    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "pieces")
    schema = "part int, kind int, nth long, doc_id long, start long, length long, doc_tokens long, ids binary"
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def pack(docs: DataFrame, carry=None, tokenizer: str | None = None, end_id: int = END_ID, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """doc_id, start, length, doc_tokens, the carried columns, sequence_id, offset: a row per piece.

    ``carry`` makes the columns to keep from a piece's ``ids`` (little-endian
    unsigned 32-bit numbers as binary); by default the ids themselves.
    """
    carry = carry or (lambda ids: [ids.alias("ids")])
    spark = docs.sparkSession
    pieces = encode_pieces(docs, tokenizer, end_id, length, grain)
    counts = pieces.groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n"))
    need = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # at most length / grain rows
    room = length // grain
    kinds = np.array(sorted(k for k in need if k < room), np.int64)
    wanted = np.array([need[k] for k in kinds], np.int64)
    used = round_patterns(solve_patterns(kinds, wanted.astype(float), room), wanted) if len(kinds) else []

    # Rank ranges of each kind: from which rank on, the first sequence, pieces per sequence.
    ranges: dict[int, list[tuple[int, int, int]]] = {int(k): [] for k in need}
    given = {int(k): 0 for k in need}
    sequence = 0
    if need.get(room):
        ranges[room].append((0, 0, 1))
        given[room] = sequence = need[room]
    for pattern, times in used:
        for i in np.flatnonzero(pattern).tolist():
            k = int(kinds[i])
            ranges[k].append((given[k], sequence, int(pattern[i])))
            given[k] += int(pattern[i]) * times
        sequence += times
    table = [(k, given[k], [r[0] for r in v], [r[1] for r in v], [r[2] for r in v]) for k, v in ranges.items()]
    plan = spark.createDataFrame(table, "kind int, given long, froms array<long>, firsts array<long>, copies array<long>")

    before = running_offsets(counts, ["kind"], "part", "n", "before").select("part", "kind", "before")
    cols = ["doc_id", "start", "length", "doc_tokens"]
    narrow = pieces.select("part", "kind", "nth", *cols, *carry(F.col("ids")))
    carried = [c for c in narrow.columns if c not in ("part", "kind", "nth", *cols)]
    ranked = narrow.join(before, ["part", "kind"]).withColumn("rank", F.col("nth") + F.col("before")).join(F.broadcast(plan), "kind")  # plan: at most room rows

    which = F.size(F.filter("froms", lambda x: x <= F.col("rank")))
    seq = F.element_at("firsts", which) + F.floor((F.col("rank") - F.element_at("froms", which)) / F.element_at("copies", which))
    placed = ranked.where("rank < given").select(*cols, *carried, seq.cast("long").alias("sequence_id"), "kind", "rank")
    behind = Window.partitionBy("sequence_id").orderBy(F.desc("kind"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(behind), F.lit(0)).cast("long"))

    # The rest: fewer pieces than the patterns of one basis hold. They fill sequences in turn.
    cuts, at = [], 0
    for r in ranked.where("rank >= given").select("part", "kind", "nth", "rank", "length").orderBy(F.desc("kind"), "rank").collect():
        done = 0
        while done < r["length"]:
            take = min(r["length"] - done, length - at % length)
            cuts.append((r["part"], r["kind"], r["nth"], done, take, sequence + at // length, at % length))
            done, at = done + take, at + take
    cut = spark.createDataFrame(cuts, "part int, kind int, nth long, skip long, take long, sequence_id long, offset long")
    part_ids = F.expr("substring(ids, cast(4 * skip + 1 as int), cast(4 * take as int))")
    filled = pieces.join(F.broadcast(cut), ["part", "kind", "nth"]).select("doc_id", (F.col("start") + F.col("skip")).alias("start"), F.col("take").alias("length"), "doc_tokens", *carry(part_ids), "sequence_id", "offset")
    return placed.select(*cols, *carried, "sequence_id", "offset").unionByName(filled)


def with_crc(docs: DataFrame) -> DataFrame:
    out = pack(docs, lambda ids: [F.crc32(ids).alias("ids_crc32")])
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return with_crc(spark.read.parquet(f"{sf_dir}/documents.parquet"))
