"""Repeated byte strings across documents, by bucket-pointer refinement.

Every byte goes that lies in a LENGTH-byte string which also starts in a
document with a smaller doc_id. Sorting all suffixes of all documents in one
place cannot be spread, so the suffixes that can matter are found first:

1. Each window of LENGTH bytes picks its least-hashed q-gram (its anchor), so
   equal windows pick equal anchors wherever they stand. Anchors go to buckets
   by hash, one entry per chunk of text and hash, and come back to the
   documents that share them. An anchor that two documents of one chunk share
   is known to be shared there and sends a single entry, so a passage that
   stands in a third of all documents costs one entry per chunk.
2. Around shared anchors the suffixes are put in order by bucket-pointer
   refinement: initial buckets of 8-byte prefixes; buckets of more than one
   suffix are sorted by the buckets of the suffixes 8, then 16, then 18 bytes
   on, each round reusing the numbers of the last, until equal numbers mean
   equal LENGTH-byte prefixes. (Numbers that changed inside a round are not
   reused in it: they would tell strings apart behind their LENGTH-th byte.)
   This is done within the chunk, which settles
   all but the smallest document of each string, and for what is left within
   the bucket of its anchor, where chunks meet.
3. Per document the found places are united.

A text that has an exact copy with a smaller doc_id goes as a whole (if it has
LENGTH bytes) without taking part in 2.

Defined results: null text counts as empty; a null doc_id counts as larger
than all others (which have to be below 2 ** 62), rows without doc_id are told
apart by their texts and follow each other by a hash of them; rows with equal
doc_ids, and equal rows without one, never remove from each other; texts shorter
than LENGTH bytes stay; an empty table gives no rows; extra columns are ignored.
Very long texts are handled in overlapping segments.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.workers import lean_batches, tidy
from edgeloom.plans.durable import written, written_by_key

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1  # q-grams, and so window starts, per window
WIDE = LENGTH + SPAN - 1  # bytes that an anchor's windows cover
SEGMENT = 1 << 19
CHUNK = 1 << 19
BLOCK = 8000  # questions settled at a time
ASKED = 100_000  # questions held before they are sent
SLICE = 500  # rows turned into Python objects at a time
_MAX = (1 << 63) - 1
UNNAMED = 1 << 62  # ids of rows without doc_id begin here
LANES = 256
_U = np.uint64


class Chunk:
    """Segments of some texts end to end."""

    def __init__(self):
        self.parts, self.owner, self.base, self.starts, self.size = [], [], [], [0], 0

    def add(self, owner: int, raw: bytes, base: int) -> None:
        self.parts.append(raw)
        self.owner.append(owner)
        self.base.append(base)
        self.size += len(raw)
        self.starts.append(self.size)

    def seal(self) -> Chunk:
        self.buf = np.frombuffer(b"".join(self.parts) + bytes(WIDE), np.uint8)
        self.starts, self.owner, self.base = np.array(self.starts), np.array(self.owner), np.array(self.base)
        self.parts = []
        return self


def segments(raw: bytes):
    """(base, bytes) so that each window lies in exactly one segment."""
    if len(raw) < LENGTH:
        return
    for at in range(0, max(1, len(raw) - LENGTH + 1), SEGMENT):
        yield at, raw[at : at + SEGMENT + LENGTH - 1]


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(chunk: Chunk):
    """Places of anchors, their hashes, the hash each window start picked (0: no window)."""
    b = chunk.buf.astype(_U) + _U(1)
    m = [_U(pow(0x100000001B3, 1 << k, 1 << 64)) for k in range(4)]
    h2 = b[:-1] * m[0] + b[1:]
    h4 = h2[:-2] * m[1] + h2[2:]
    h8 = h4[:-4] * m[2] + h4[4:]
    h16 = h8[:-8] * m[3] + h8[8:]
    h = h16[:-8] * m[3] + h8[16:]
    h ^= h >> _U(32)
    h *= _U(0x9E3779B97F4A7C15)
    h ^= h >> _U(29)
    h |= _U(1)
    low = _slide(h, SPAN, np.minimum)
    for e in chunk.starts[1:].tolist():  # windows that would cross the end of a segment
        low[max(0, e - LENGTH + 1) : e] = 0
    low = low[: chunk.size]
    held = _slide(np.concatenate([np.zeros(SPAN - 1, _U), low]), SPAN, np.maximum)
    at = np.flatnonzero((held == h[: len(held)]) & (held > 0))
    return at, h[at], low


def refined_buckets(buf: np.ndarray) -> np.ndarray:
    """For each place of ``buf`` a number; equal numbers mean equal LENGTH-byte prefixes.

    The last LENGTH places are not meant to be used. Numbers are places in
    suffix order, so singletons keep theirs and only buckets of two or more
    suffixes are sorted again.
    """
    n = len(buf)
    wide = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(_U)
    code = wide[:n].copy()
    for k in range(1, 8):
        code = (code << _U(8)) | wide[k : k + n]
    order = np.argsort(code)
    code = code[order]
    first = np.concatenate([[True], code[1:] != code[:-1]])
    start = np.flatnonzero(first)
    number = np.empty(n, np.int64)
    number[order] = np.repeat(start, np.diff(np.append(start, n)))
    live = order[np.repeat(np.diff(np.append(start, n)) > 1, np.diff(np.append(start, n)))]
    for step in (8, 16, 18):  # prefixes of 16, 32, 50 bytes
        if not len(live):
            break
        onward = number[np.minimum(live + step, n - 1)]
        key = (number[live] << np.int64(32)) | onward
        by = np.argsort(key)
        live, key = live[by], key[by]
        old = key >> np.int64(32)
        run = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        begin = np.repeat(run, np.diff(np.append(run, len(old))))
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(cut, len(key)))
        fresh = (old[cut] + cut - begin[cut]).repeat(sizes)
        number = number.copy()
        number[live] = fresh
        live = live[np.repeat(sizes > 1, sizes)]
    return number


def _beaten(number: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether an equal number stands with a smaller id."""
    order = np.lexsort((ids, number))
    run = np.concatenate([[True], number[order][1:] != number[order][:-1]])
    least = ids[order][np.maximum.accumulate(np.where(run, np.arange(len(run)), 0))]
    out = np.empty(len(ids), bool)
    out[order] = least < ids[order]
    return out


def _chunks(texts: list[bytes], most: int | None = None):
    chunk = Chunk()
    for i, raw in enumerate(texts):
        for base, part in segments(raw):
            chunk.add(i, part, base)
            if chunk.size >= (most or CHUNK):
                yield chunk.seal()
                chunk = Chunk()
    if chunk.size:
        yield chunk.seal()


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _raw(batch, column: str = "text") -> list[bytes]:
    return [b or b"" for b in batch[column].cast(pa.binary()).to_pylist()]


def _emit_anchors(buckets: int):
    """bucket, settled, hashes, ids: what a chunk knows by itself, and one question per hash."""

    def run(batches):
        turn = 0
        for batch in _slices(batches):
            texts, ids = _raw(batch), batch["id"].to_numpy()
            for chunk in _chunks(texts):
                at, hashes, _ = anchors(chunk)
                who = ids[chunk.owner[np.searchsorted(chunk.starts, at, side="right") - 1]]
                order = np.lexsort((who, hashes))
                hashes, who = hashes[order], who[order]
                new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (who[1:] != who[:-1])]) if len(hashes) else np.zeros(0, bool)
                hashes, who = hashes[new], who[new]
                if not len(hashes):
                    continue
                start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                many = np.diff(np.append(start, len(hashes))) > 1
                inside = np.repeat(many, np.diff(np.append(start, len(hashes))))
                rows = []
                if inside.any():
                    turn += 1
                    rows.append((int(hashes[0] + _U(turn)) % buckets, True, hashes[inside].tobytes(), who[inside].tobytes(), b""))
                one, own, flag = hashes[start], who[start], many
                place = (one % _U(buckets)).astype(np.int64)
                by = np.argsort(place, kind="stable")
                one, own, flag, place = one[by], own[by], flag[by], place[by]
                cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
                for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(place)], strict=True):
                    rows.append((int(place[a]), False, one[a:z].tobytes(), own[a:z].tobytes(), flag[a:z].tobytes()))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1]), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["bucket", "settled", "hashes", "ids", "flags"])
        tidy()

    return run


def _share(table: pa.Table) -> pa.Table:
    """id, hash of anchors that stand in two documents or more."""
    settled, hashes, ids, flags = table["settled"].to_pylist(), table["hashes"].to_pylist(), table["ids"].to_pylist(), table["flags"].to_pylist()
    out_h, out_i = [np.frombuffer(h, _U) for h, s in zip(hashes, settled, strict=True) if s], [np.frombuffer(i, np.int64) for i, s in zip(ids, settled, strict=True) if s]
    asked = [k for k, s in enumerate(settled) if not s]
    if asked:
        h = np.concatenate([np.frombuffer(hashes[k], _U) for k in asked])
        i = np.concatenate([np.frombuffer(ids[k], np.int64) for k in asked])
        f = np.concatenate([np.frombuffer(flags[k], bool) for k in asked])
        order = np.argsort(h)
        h, i, f = h[order], i[order], f[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(start, len(h)))
        differ = (np.maximum.reduceat(i, start) != np.minimum.reduceat(i, start)) | np.logical_or.reduceat(f, start)
        hit = np.repeat(differ, size)
        out_h.append(h[hit])
        out_i.append(i[hit])
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.table({"id": pa.array(cat(out_i, np.int64)), "hash": pa.array(cat(out_h, _U).view(np.int64))})


_CANDIDATE = "kind int, id long, doc_id long, extra string, rk long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, bucket long, ids binary, rks binary, places binary, masks binary, around binary"
_FIELDS = [f.split() for f in _CANDIDATE.split(", ")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _rows(kind: int, **cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    arrays = [pa.array([kind] * n, pa.int32()) if f == "kind" else pa.array(cols[f], _TYPES[t]) if f in cols else pa.nulls(n, _TYPES[t]) for f, t in _FIELDS]
    return pa.RecordBatch.from_arrays(arrays, names=[f for f, _ in _FIELDS])


_FOUND = "id long, rk long, places binary, masks binary"


def _by_text(ids: np.ndarray, rks: np.ndarray, places: np.ndarray, masks: np.ndarray) -> dict[str, pa.Array]:
    """A row for each text with all its places: a passage that stands in all documents costs no more rows than there are documents."""
    order = np.lexsort((rks, ids))
    ids, rks, places, masks = ids[order], rks[order], places[order].astype("<u4"), masks[order].astype("<i4")
    cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (rks[1:] != rks[:-1])])) if len(ids) else np.zeros(0, np.int64)
    ends = list(zip(cut.tolist(), [*cut[1:].tolist(), len(ids)]))
    pack = lambda x: pa.array([x[a:z].tobytes() for a, z in ends], pa.binary())
    return {"id": pa.array(ids[cut]), "rk": pa.array(rks[cut]), "places": pack(places), "masks": pack(masks)}


def _questions(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """A row for each bucket."""
    goes, ids, rks, places, masks, around = (np.concatenate(c) for c in zip(*held, strict=True))
    by = np.argsort(goes, kind="stable")
    goes = goes[by]
    cut = np.flatnonzero(np.concatenate([[True], goes[1:] != goes[:-1]]))
    pieces = [by[a:z] for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(goes)], strict=True)]
    return _rows(1, bucket=goes[cut], **{f: [x[p].tobytes() for p in pieces] for f, x in (("ids", ids), ("rks", rks), ("places", places), ("masks", masks), ("around", around))})


def _candidates(buckets: int, keep: bool):
    """Kinds of rows: 0 finished documents, 1 questions, 2 places found, 3 documents that wait for places."""

    def run(batches):
        held, count = [], 0
        for batch in _slices(batches):
            texts, ids, rks = _raw(batch), batch["id"].to_numpy(), batch["rk"].to_numpy()
            docs, copies, hits, extra = batch["doc_id"].to_pylist(), batch["copies"].to_pylist(), batch["hashes"], batch["extra"].to_pylist()
            done, wait = [], []
            for i, raw in enumerate(texts):
                if copies[i] and hashlib.md5(raw).hexdigest() in copies[i] and len(raw) >= LENGTH:
                    done.append((ids[i], docs[i], extra[i], rks[i], len(raw), len(raw), 1, b""))
                elif hits[i].is_valid and len(raw) >= LENGTH:
                    wait.append(i)
                else:
                    done.append((ids[i], docs[i], extra[i], rks[i], len(raw), 0, 0, raw))
            for at in range(0, len(done), 200):
                k, d, e, r, n, gone, spans, kept = zip(*done[at : at + 200], strict=True)
                more = {"kept": kept} if keep else {}
                yield _rows(0, id=k, doc_id=d, extra=e, rk=r, n_bytes=n, n_removed=gone, n_spans=spans, kept_sha256=[hashlib.sha256(b).hexdigest() for b in kept], **more)
            for at in range(0, len(wait), 200):
                some = wait[at : at + 200]
                yield _rows(3, id=ids[some], doc_id=[docs[i] for i in some], extra=[extra[i] for i in some], rk=rks[some], kept=[texts[i] for i in some])
            waits = set(wait)
            wanted = np.concatenate([hits[i].values.to_numpy(zero_copy_only=False).view(_U) ^ _salt(i) for i in wait]) if wait else np.zeros(0, _U)
            wanted = np.unique(wanted)
            for chunk in _chunks([texts[i] if i in waits else b"" for i in range(len(texts))], CHUNK // 2):
                at, hashes, low = anchors(chunk)
                seg = np.searchsorted(chunk.starts, at, side="right") - 1
                owner = chunk.owner[seg]
                mine = hashes ^ _salt(owner)
                take = wanted[np.minimum(np.searchsorted(wanted, mine), len(wanted) - 1)] == mine
                at, hashes, seg, owner = at[take], hashes[take], seg[take], owner[take]
                if not len(at):
                    continue
                at = at.astype(np.int32)
                begin, end = chunk.starts[seg].astype(np.int32), chunk.starts[seg + 1].astype(np.int32)
                starts = at[:, None] - np.arange(SPAN - 1, -1, -1, dtype=np.int32)[None, :]
                own = (starts >= begin[:, None]) & (low[np.maximum(starts, 0)] == hashes[:, None])
                step = np.zeros(len(chunk.buf) + 1, np.int32)
                np.add.at(step, np.maximum(at - SPAN + 1, 0), 1)
                np.add.at(step, np.minimum(at - SPAN + 1 + WIDE, len(chunk.buf)), -1)
                near = np.cumsum(step[:-1]) > 0
                place = np.flatnonzero(near)
                number = np.zeros(len(near), np.int64)
                number[place] = refined_buckets(chunk.buf[place])
                where = np.unique(starts[own])
                who = ids[chunk.owner[np.searchsorted(chunk.starts, where, side="right") - 1]]
                lost = np.zeros(len(near), bool)
                lost[where[_beaten(number[where], who)]] = True
                beaten = own & lost[np.maximum(starts, 0)]
                bits = (1 << np.arange(SPAN, dtype=np.int32))[None, :]
                found = (beaten * bits).sum(1, dtype=np.int32)
                local = at - chunk.starts[seg] + chunk.base[seg]
                if found.any():
                    yield _rows(2, **_by_text(ids[owner[found > 0]], rks[owner[found > 0]], local[found > 0], found[found > 0]))
                asks = ((own & ~beaten) * bits).sum(1, dtype=np.int32)
                del starts, own, beaten, number, lost, near, step
                ask = np.flatnonzero(asks)
                if not len(ask):
                    continue
                spot = at[ask, None] - np.int32(SPAN - 1) + np.arange(WIDE, dtype=np.int32)[None, :]
                around = chunk.buf[np.clip(spot, 0, len(chunk.buf) - 1)]
                around[(spot < begin[ask, None]) | (spot >= end[ask, None])] = 0
                del spot
                goes = (hashes[ask] % _U(buckets)).astype(np.int64)
                held.append((goes, ids[owner[ask]], rks[owner[ask]], local[ask].astype(np.uint32), asks[ask].astype(np.int32), around))
                count += len(ask)
                if count >= ASKED:
                    yield _questions(held)
                    held, count = [], 0
        if held:
            yield _questions(held)
        tidy()

    return run


def _salt(i):
    """Keeps the same hash of different texts apart."""
    salt = (np.atleast_1d(i).astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93)
    return salt if np.ndim(i) else salt[0]


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, group starts in that order, and each row's group."""
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    group = np.empty(len(key), np.int64)
    group[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    return order, start, group


def _digest(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    width = -(-rows.shape[1] // 8) * 8
    wide = np.zeros((len(rows), width), np.uint8)
    wide[:, : rows.shape[1]] = rows
    out = np.full(len(rows), 0x9E3779B97F4A7C15, _U)
    for w in wide.view(_U).T:
        out = (out ^ w) * _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(32)
    return out


def _answer(table: pa.Table) -> pa.Table:
    """id, rk, places, masks: windows of the questions that a smaller document also has, a row for each place: texts have few places in one bucket, and the fewer the more buckets there are.

    Only questions with one anchor can meet, so they are settled in blocks
    that end where an anchor does.
    """
    cat = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
    ids, rks, places, masks = cat("ids", np.int64), cat("rks", np.int64), cat("places", np.uint32), cat("masks", np.int32)
    around = cat("around", np.uint8).reshape(-1, WIDE)
    order, start, _ = _groups(_digest(around[:, SPAN - 1 : SPAN - 1 + GRAM]))
    out, at, n = np.zeros(len(ids), np.int32), 0, len(ids)
    while at < n:
        end = int(np.append(start, n)[np.searchsorted(start, min(at + BLOCK, n))]) if at + BLOCK < n else n
        some = order[at:end]
        if end - at > 1:
            out[some] = _settled(ids[some], masks[some], around[some])
        at = end
    hit = out > 0
    each = lambda x: pa.FixedSizeBinaryArray.from_buffers(pa.binary(4), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
    found = pa.table({"id": pa.array(ids[hit]), "rk": pa.array(rks[hit]), "places": each(places[hit].astype("<u4")), "masks": each(out[hit].astype("<i4"))})
    del around, order, start
    tidy()
    return found


def _settled(ids: np.ndarray, masks: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Masks of the windows that a smaller id has too. Equal surroundings are taken together
    first; only surroundings whose anchor has others are refined."""
    order, start, group = _groups(_digest(around))
    if (around != around[order[start]][group]).any():  # two surroundings with one hash: take none together
        order, start, group = np.arange(len(ids)), np.arange(len(ids)), np.arange(len(ids))
    own = (masks[:, None] >> np.arange(SPAN, dtype=np.int32)[None, :]) & 1 > 0
    least = np.minimum.reduceat(np.where(own, ids[:, None], _MAX)[order], start, axis=0)
    there = np.logical_or.reduceat(own[order], start, axis=0)  # not told by least: a null doc_id is _MAX itself
    some = around[order[start]]
    _, first, family = _groups(_digest(some[:, SPAN - 1 : SPAN - 1 + GRAM]))
    mixed = np.flatnonzero(np.diff(np.append(first, len(family)))[family] > 1)
    if len(mixed):
        number = refined_buckets(np.concatenate([some[mixed].ravel(), np.zeros(LENGTH, np.uint8)]))
        live = there[mixed]
        where = (np.arange(len(mixed))[:, None] * WIDE + np.arange(SPAN)[None, :])[live]
        by, begin, one = _groups(number[where])
        found = least[mixed]
        if len(by):
            found[live] = np.minimum.reduceat(found[live][by], begin)[one]
        least[mixed] = found
    return ((own & (least[group] < ids[:, None])) * (1 << np.arange(SPAN, dtype=np.int64))[None, :]).sum(1)


def _cut(keep: bool):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out: list[list] = [[], [], [], [], [], [], [], []]
                marks = part["marks"]
                for i, (doc, extra, rk, raw) in enumerate(zip(part["doc_id"].to_pylist(), part["extra"].to_pylist(), part["rk"].to_pylist(), _raw(part, "kept"), strict=True)):
                    step = np.zeros(len(raw) + 1, np.int64)
                    if marks[i].is_valid:
                        mine = [f for f in marks[i].as_py() if f["rk"] == rk]
                        place, mask = np.frombuffer(b"".join(f["places"] for f in mine), "<u4").astype(np.int64), np.frombuffer(b"".join(f["masks"] for f in mine), "<i4")
                        row, bit = np.nonzero((mask[:, None] >> np.arange(SPAN)[None, :]) & 1)
                        start = np.unique(place[row] - (SPAN - 1) + bit)
                        step[start] += 1
                        step[start + LENGTH] -= 1
                    gone = np.cumsum(step[:-1]) > 0
                    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    for column, v in zip(out, (doc, extra, rk, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore").encode() if keep else None), strict=True):
                        column.append(v)
                kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "extra", "rk", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _shared_anchors(base: DataFrame) -> tuple[DataFrame, int]:
    """Written table id, hashes (its shared anchors), copies (digests of texts that an earlier document has); a bucket count for step 2."""
    keys = written(base.select("id", F.md5(F.col("text").cast("binary")).alias("md5"), F.octet_length("text").alias("n")), "texts")
    total = keys.agg(F.sum("n")).head()[0] or 0
    buckets, meetings = max(1, total * 71 // 1000 // 250_000), max(1, total // 4_000_000)

    lane = F.pmod(F.xxhash64("id"), F.lit(LANES))  # a text with very many copies is met in as many places
    cells = keys.groupBy("md5", lane.alias("lane")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    first = cells.groupBy("md5").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most")
    named = cells.select("md5", "lane").join(first.select("md5", "least"), "md5")
    copies = keys.withColumn("lane", lane).join(named, ["md5", "lane"]).where("id > least").groupBy("id").agg(F.collect_set("md5").alias("copies"))
    sent = base.select("id", "text").mapInArrow(_emit_anchors(buckets), "bucket long, settled boolean, hashes binary, ids binary, flags binary")
    shared = sent.groupBy("bucket").applyInArrow(_share, "id long, hash long").groupBy("id").agg(F.collect_list("hash").alias("hashes"))
    return written(shared.join(copies, "id", "full_outer"), "shared"), meetings


def remove_repeats(docs: DataFrame, keep_bytes: bool = True, extra: list[str] | None = None) -> DataFrame:
    """doc_id, extra, rk (a hash of doc_id and text), n_bytes, n_removed, n_spans, kept_sha256, kept.

    ``kept`` has the bytes that stay, less the parts of characters that were
    cut through (null without ``keep_bytes``); ``extra`` the named columns as JSON.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(UNNAMED) + F.pmod(F.xxhash64(text), F.lit(1 << 61))).alias("id"), (F.to_json(F.struct(*extra)) if extra else F.lit(None).cast("string")).alias("extra"))
    info, meetings = _shared_anchors(base)
    joined = base.withColumn("rk", F.xxhash64("id", "text")).join(info, "id", "left").select("doc_id", "id", "rk", "text", "extra", "hashes", "copies")
    rows = written_by_key(joined.mapInArrow(_candidates(meetings, keep_bytes), _CANDIDATE), "id", int(spark.conf.get("spark.sql.shuffle.partitions")), "candidates")
    asked = rows.where("kind = 1").select("bucket", "ids", "rks", "places", "masks", "around")
    answers = asked.groupBy("bucket").applyInArrow(_answer, _FOUND)
    marks = answers.unionByName(rows.where("kind = 2").select("id", "rk", "places", "masks"))
    marks = written(marks.groupBy("id").agg(F.collect_list(F.struct("rk", "places", "masks")).alias("marks")), "marks")
    cols = ["doc_id", "extra", "rk", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    cut = rows.where("kind = 3").select("id", "doc_id", "extra", "rk", "kept").join(marks, "id", "left").select("doc_id", "extra", "rk", "kept", "marks")
    cut = cut.mapInArrow(_cut(keep_bytes), "doc_id long, extra string, rk long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return rows.where("kind = 0").select(*cols).unionByName(cut)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_bytes=False).drop("rk", "kept", "extra")
