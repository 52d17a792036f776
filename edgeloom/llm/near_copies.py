"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

The method is that of ``simhash``, meeting in the middle of the Hamming ball,
with several short fingerprints in place of one long one: at that similarity
0.15 of the bits of a SimHash differ, far more than three of 64. A text gets
``tables`` fingerprints of ``bits`` bits, and two texts meet in a table where
these differ in one bit at most: fingerprints of odd parity emit all their
neighbours at distance one, those of even parity themselves. A fingerprint goes
once to each bucket of values that its variants fall in and is turned there;
texts that share a variant and whose sizes and SimHash bits
in all allow the similarity are candidates, and each candidate pair is decided
on the full sets of both texts. ``bits`` follows the number of rows, so
that a text meets few strangers, and ``tables`` follows from it: a pair at 0.8
meets nowhere with a chance of ``MISS``. The tables are met in passes, so that
what is on disk at once stays at ``PASS`` bytes a row.

Equal texts are one node, so copies cost nothing beyond their first row. Pairs
that meet are never listed one by one: each bucket gives, for the nodes that its
pairs hang together, a link to the smallest. In a crowd at one variant, nodes
that are known to be connected are not compared; what is not settled after
``COMPARED`` comparisons goes on to other tasks. The components of these links
hold every pair that met; inside a component all pairs are decided on the full
sets, except those that are known to be connected, and only a spanning forest is
given out.

A large component is cut into places (``spanned``). Each node goes to its own
place and only a few hubs go to all; nodes that hang on one hub, in whatever
place, are connected. Only the others, few if the component is one crowd of
copies, meet the nodes of the other places, so rows grow with the nodes of a
crowd, and with their square only where a component holds many that no hub
connects.

Defined results: a text of fewer than five words is one shingle, a null, empty
or blank text an empty one; null and repeated doc_ids keep their rows (a null
never names a component unless it has no other); rows that are equal are one
node; a text of any length counts with all its shingles; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.workers import lean_batches, tidy
from edgeloom.operators.components import connected_components
from edgeloom.plans.durable import forget, written

SHINGLE = 5
TURNED = math.acos(8 / 9) / math.pi  # share of the bits that differ at similarity 0.8 in sets of one size
MISS = 0.005
CHECKS = 4  # words of 64 further bits
FAR = 62  # of these bits; at 0.8 39 differ with a deviation of 6, of strangers 128
SMALL, TURNED_SMALL, FAR_SMALL = 16, 0.1875, 75  # sets of so few shingles differ in more bits at 0.8, up to those of 4 and 5
CROWD = 32  # nodes at one variant whose pairs are taken at once
COMPARED = 1 << 25  # comparisons in a larger crowd before the rest goes to other tasks
TURNED_AT_ONCE = 4_000_000  # variants
BATCH = 8192
VARIANTS_PER_BUCKET = 2_000_000
HUBS = 16  # nodes that go to all places of their group
BROADCAST_ROWS = 400_000
PASS = 1000  # bytes a row that move in one pass
PLACES = 8  # a group of several times ``least`` nodes is cut into so many places, a larger one by the two bounds below
PLACE = 4096  # nodes
PLACE_SHINGLES = 1 << 20
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_LOW = _U(0x0101010101010101)


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as in the fingerprints of op3
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], _U)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))
    n = len(w) - SHINGLE + 1
    h = np.zeros(n, _U)
    for k in range(SHINGLE):
        h = _mixed(h * _STEP + w[k : k + n])
    return np.unique(h)


def is_near(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def shape(rows: int) -> tuple[int, int]:
    """Bits of a fingerprint and number of tables for so many rows."""
    bits = max(8, math.ceil(math.log2(max(2, rows))) + 1)
    same = 1 - TURNED
    meet = same**bits + bits * TURNED * same ** (bits - 1)
    return bits, math.ceil(math.log(MISS) / math.log(1 - meet))


def width(rows: int) -> int:
    """Words of 64 bits in a sketch: the fingerprints of all tables, then the further bits."""
    bits, tables = shape(rows)
    return -(-bits * tables // 64) + CHECKS


def sketches(sets: list[np.ndarray], words: int) -> np.ndarray:
    """A row of 64 * ``words`` SimHash bits (as bytes, lowest bit first) for each set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    h = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    runs = -(-sizes // 255)  # eight counters of a byte each at a time; 255 hashes cannot overflow them
    at = np.concatenate([[0], np.cumsum(runs)[:-1]])
    start = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(at, runs))
    out = np.zeros((len(sets), words * 8), np.uint8)
    for w in range(words):
        z = _mixed(h + _U((w + 1) * int(_STEP) % (1 << 64)))
        for j in range(8):
            sums = np.add.reduceat((z >> _U(j)) & _LOW, start).astype("<u8")
            counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), at, axis=0, dtype=np.int64)
            out[:, 8 * w : 8 * w + 8] |= (2 * counts > sizes[:, None]).astype(np.uint8) << j
    return out


def _sketch(words: int):
    def run(batches):
        for b in batches:
            if b.num_rows:
                sets = [shingles(t) for t in b["text"].to_pylist()]
                rows = sketches(sets, words)
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["key"], pa.array([len(s) for s in sets], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "key", "n", "sketch"])
        tidy()

    return run


def _sets(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["key"], pa.array([shingles(t).tobytes() for t in b["text"].to_pylist()], pa.binary())], names=["key", "held"])
    tidy()


def _forest(count: int, near: Callable[[int, np.ndarray], np.ndarray], most: float = math.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links that span the components of ``near``, which tells for a node and others which of these it is linked to. Nodes that are known to be connected are not compared. After ``most`` comparisons it stops: pairs that are not compared by then are among the nodes given last."""
    left, waiting, ends = np.arange(count), [], [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(left) and most > 0:
        if waiting:
            at = waiting.pop()
        else:
            at, left = int(left[0]), left[1:]
        most -= len(left)
        ok = near(at, left)
        found = left[ok]
        if len(found):
            ends.append((np.full(len(found), at), found))
            waiting.extend(found.tolist())
            left = left[~ok]
    rest = np.concatenate([np.array(waiting, np.int64), left]) if len(left) else left
    return *(np.concatenate(e) for e in zip(*ends, strict=True)), rest


def _smallest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the nodes 0 .. count - 1 the smallest in its component over the links a, b."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _runs(batches) -> Iterator[pa.Table]:
    """The rows of each block: those that follow each other with one group, lo and hi."""
    held, last = [], None
    for b in batches:
        if b.num_rows:
            ids = np.stack([b[c].to_numpy() for c in ("group", "lo", "hi")], 1)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(ids)]
            for start, end in zip(cuts, cuts[1:]):
                if held and last != tuple(ids[start]):
                    yield pa.Table.from_batches(held)
                    held = []
                last = tuple(ids[start])
                held.append(b.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _by_marks(t: pa.Table) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which nodes of a block may be near."""
    sizes, checks = t["n"].to_numpy(), np.stack([t[c].to_numpy() for c in _MARKS], 1).view(_U)  # bits of signed numbers are counted without the sign
    return lambda i, others: may_be_near(sizes, checks, i, others)


def _overlap(sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which of the sets are near. The others that are asked about have to be among those asked about before."""
    if len(sets) == 2:
        return lambda at, others: np.array([is_near(sets[at], sets[k]) for k in others.tolist()], bool)
    n = np.array([len(s) for s in sets], np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    node = np.repeat(np.arange(len(sets), dtype=np.int32), n)
    most = int(ids.max()) + 1

    def listed(open_: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The open nodes by shingle, where each shingle's begin, and how many nodes there are."""
        mask = np.zeros(len(sets), bool)
        mask[open_] = True
        some = mask[node]
        order = np.argsort(ids[some], kind="stable")
        return node[some][order], np.concatenate([[0], np.cumsum(np.bincount(ids[some], minlength=most))]), len(open_)

    held = listed(np.arange(len(sets)))

    def near(at: int, others: np.ndarray) -> np.ndarray:
        nonlocal held
        if 2 * len(others) < held[2]:
            held = listed(others)
        nodes, begin, _ = held
        mine = ids[first[at] : first[at + 1]]
        counts = begin[mine + 1] - begin[mine]
        place = np.repeat(begin[mine] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        both = np.bincount(nodes[place], minlength=len(sets))[others]
        return 5 * both >= 4 * (n[at] + n[others] - both)

    return near


def near_forest(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that are near and span all components of near copies among the sets."""
    return _forest(len(sets), _overlap(sets))[:2]


def _by_sets(t: pa.Table) -> Callable[[int, np.ndarray], np.ndarray]:
    return _overlap([np.frombuffer(x, _U) for x in t["held"].to_pylist()])


_SPAN = "group long, src long, dst long, hubs long"


def _span(group: np.ndarray, src: np.ndarray, dst: np.ndarray | None, hubs: np.ndarray | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(group), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(src, pa.int64()), none if dst is None else pa.array(dst, pa.int64()), none if hubs is None else pa.array(hubs, pa.int64())], names=[f.split()[0] for f in _SPAN.split(", ")])


def _within(relation):
    """The links that span a block; in blocks with hubs (rank 0 and up) a row for each node that is at home there, with a bit for each hub that it hangs on."""

    def run(batches):
        for t in _runs(batches):
            keys, group = t["key"].to_numpy(), t["group"].to_numpy()
            a, b, _ = _forest(len(keys), relation(t))
            yield _span(group[a], keys[a], keys[b])
            rank = t["rank"].to_numpy()
            hub = np.flatnonzero(rank >= 0)
            if len(hub):
                root, bits = _smallest(len(keys), a, b), np.zeros(len(keys), np.int64)
                np.bitwise_or.at(bits, root[hub], np.int64(1) << rank[hub])
                home = np.flatnonzero(t["home"].to_numpy(zero_copy_only=False))
                yield _span(group[home], keys[home], None, bits[root[home]])
        tidy()

    return run


def _across(relation):
    """For each open node of a block one settled node that it is linked to; the settled ones are connected already."""

    def run(batches):
        for t in _runs(batches):
            keys, group = t["key"].to_numpy(), t["group"].to_numpy()
            open_ = t["open"].to_numpy(zero_copy_only=False)
            near, settled = relation(t), np.flatnonzero(~open_)
            ends = [(settled[ok][0], at) for at in np.flatnonzero(open_).tolist() if len(settled) and (ok := near(at, settled)).any()]
            a, b = np.array(ends, np.int64).reshape(-1, 2).T
            yield _span(group[a], keys[a], keys[b])
        tidy()

    return run


def _parts(least: int | None = None) -> Column:
    """Places of a group of rows key, n."""
    m, n = F.count(F.lit(1)), F.sum("n")
    bound = F.greatest(F.ceil(m / PLACE), F.ceil(n / PLACE_SHINGLES), F.lit(1))
    return (F.greatest(F.least(F.ceil(m / least), F.lit(PLACES)), bound) if least else bound).cast("int")


def _place(column: str) -> Column:
    return F.pmod(F.xxhash64("key"), F.col(column)).cast("int")


def _every(column: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(column) - 1))


def _blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi")


def spanned(rows: DataFrame, least: int, relation) -> DataFrame:
    """src, dst: links that span the components of ``relation`` within each group of ``rows`` (group, key, n, more; keys are distinct in a group). Groups of more than ``least`` are cut into places."""
    hubs = F.slice(F.sort_array(F.collect_set("key")), 1, HUBS)  # of the smallest of each place
    many = rows.groupBy("group").agg(_parts(least).alias("places")).where("places > 1")
    low = rows.join(many, "group").groupBy("group", "places", _place("places").alias("lo")).agg(F.min("key").alias("key")).groupBy("group", "places").agg(hubs.alias("first"))
    many = written(low, "places")
    if many.isEmpty():
        forget(many)
        alone = rows.withColumn("rank", F.lit(-1).cast("long")).withColumn("home", F.lit(True)).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0))
        return _blocks(alone).mapInArrow(_within(relation), _SPAN).select("src", "dst")
    alone = rows.join(many, "group", "left").withColumn("places", F.coalesce("places", F.lit(1)))
    alone = alone.withColumn("rank", F.coalesce(F.array_position("first", F.col("key")) - 1, F.lit(-1)).cast("long")).drop("first")
    alone = alone.withColumn("lo", _place("places")).withColumn("home", F.lit(True))
    visits = alone.where("rank >= 0").withColumn("own", F.col("lo")).withColumn("lo", _every("places")).where("lo <> own").withColumn("home", F.lit(False)).select(*alone.columns)
    found = written(_blocks(alone.unionAll(visits).drop("places").withColumn("hi", F.col("lo"))).mapInArrow(_within(relation), _SPAN), "span")
    marked = found.where("dst is null").select("group", F.col("src").alias("key"), "hubs")
    sums = F.array(*[F.sum(F.shiftright("hubs", k).bitwiseAND(1)) for k in range(HUBS)])
    main = marked.groupBy("group").agg(sums.alias("s")).select("group", (F.array_position("s", F.array_max("s")) - 1).cast("int").alias("main"))
    apart = written(marked.join(main, "group").where("(hubs & shiftleft(1L, main)) = 0").select("group", "key"), "apart")
    links = found.where("dst is not null").select("src", "dst")
    if apart.isEmpty():
        return links
    wide = rows.join(many.select("group"), "group", "left_semi")
    open_ = wide.join(apart, ["group", "key"], "left_semi")
    chunks = written(open_.groupBy("group").agg(_parts().alias("chunks")), "chunks")
    rest = wide.join(chunks.select("group"), "group", "left_semi").join(apart, ["group", "key"], "left_anti")
    sized = chunks.join(rest.groupBy("group").agg(_parts().alias("places")), "group")
    theirs = rest.join(sized, "group").withColumn("lo", _place("places")).withColumn("hi", _every("chunks")).withColumn("open", F.lit(False))
    mine = open_.join(sized, "group").withColumn("hi", _place("chunks")).withColumn("lo", _every("places")).withColumn("open", F.lit(True)).select(*theirs.columns)
    over = _blocks(theirs.unionAll(mine).drop("places", "chunks")).mapInArrow(_across(relation), _SPAN)
    among = in_blocks(open_, least).withColumn("rank", F.lit(-1).cast("long")).mapInArrow(_within(relation), _SPAN)
    return links.unionAll(over.select("src", "dst")).unionAll(among.select("src", "dst"))


def in_blocks(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` (group, key, n, more) with lo and hi, sorted by block: every two rows of a group share a block. A group of at most ``least`` is one block; in a larger one each pair of places is a block."""
    many = rows.groupBy("group").agg(_parts(least).alias("places")).where("places > 1")
    placed = rows.join(many, "group", "left").withColumn("places", F.coalesce("places", F.lit(1))).withColumn("lo", _place("places"))
    others = F.when(F.col("places") == 1, F.array(F.lit(0))).otherwise(F.array_except(F.sequence(F.lit(0), F.col("places") - 1), F.array("lo")))
    met = placed.withColumn("hi", F.explode(others)).withColumn("lo_", F.least("lo", "hi")).withColumn("hi", F.greatest("lo", "hi"))
    met = met.withColumn("lo", F.col("lo_")).drop("lo_", "places")
    return _blocks(met)


def turned(low: np.ndarray, odd: np.ndarray, bits: int, cut: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, node) of the balls of half the radius, of values that are ``part`` above their lowest ``cut`` bits: odd nodes give all their neighbours in ``bits`` bits, the others themselves."""
    values, who = [], []
    for k in range(-1, bits):
        node = np.flatnonzero(odd if k >= 0 else ~odd).astype(np.uint32)
        value = low[node] ^ np.uint32(1 << k if k >= 0 else 0)
        if part or cut < bits:
            here = value >> np.uint32(cut) == part
            value, node = value[here], node[here]
        values.append(value)
        who.append(node)
    return np.concatenate(values), np.concatenate(who)


_DEALT = "bucket long, keys binary, sizes binary, checks binary, lows binary"
_MET = "slot long, key long, n long, " + ", ".join(f"c{k} long" for k in range(CHECKS)) + ", other long"
_MARKS = [f"c{k}" for k in range(CHECKS)]


def _emit(bits: int, split: int, first: int, last: int):
    """A row per batch and bucket of the tables from ``first`` to before ``last``: its nodes and the lower bits of their values. A bucket is a table and the ``split`` upper bits of a value; an odd value goes to its own and, with one of these bits turned, to ``split`` others."""
    width = bits - split

    def rows_of(keys, sizes, sketch):
        flat = np.unpackbits(sketch, axis=1, bitorder="little")[:, bits * first : bits * last].reshape(len(keys), last - first, bits)
        checks = np.ascontiguousarray(sketch[:, -8 * CHECKS :]).view("<u8")
        value = (flat.astype(np.int64) << np.arange(bits, dtype=np.int64)).sum(2)
        node, table = np.divmod(np.arange(value.size), value.shape[1])
        slot = ((table + first) << bits) | value.ravel()
        odd = np.flatnonzero(np.bitwise_count(value.ravel().astype(_U)) % 2 == 1)
        slot, node = np.concatenate([slot, *(slot[odd] ^ (1 << k) for k in range(width, bits))]), np.concatenate([node, *[node[odd]] * split])
        order = np.argsort(slot >> width, kind="stable")
        slot, node = slot[order], node[order]
        home = slot >> width
        cuts = [*np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])).tolist(), len(home)]
        low = (slot & ((1 << width) - 1)).astype("<u4")
        for a, z in zip(cuts, cuts[1:]):
            ids = node[a:z]
            yield int(home[a]), keys[ids].tobytes(), sizes[ids].astype("<u4").tobytes(), checks[ids].tobytes(), low[a:z].tobytes()

    def run(batches):
        held, count = [], 0

        def dealt():
            got = pa.Table.from_batches(held)
            sketch = np.frombuffer(b"".join(got["sketch"].to_pylist()), np.uint8).reshape(got.num_rows, -1)
            cols = list(zip(*rows_of(got["key"].to_numpy(), got["n"].to_numpy(), sketch), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=[f.split()[0] for f in _DEALT.split(", ")])

        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                held.append(b.slice(at, BATCH))
                count += held[-1].num_rows
                if count >= BATCH // 2:
                    yield dealt()
                    held, count = [], 0
        if held:
            yield dealt()
        tidy()

    return run


def may_be_near(n: np.ndarray, checks: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.minimum(n[a], n[b])
    fits = 5 * least >= 4 * np.maximum(n[a], n[b])
    return fits & (np.bitwise_count(checks[a] ^ checks[b]).sum(1, dtype=np.int64) <= np.where(least <= SMALL, FAR_SMALL, FAR))


def _meet(bits: int, split: int, crowd: int, most: int):
    """Links to the smallest of the nodes that candidate pairs hang together (slot -1), and the nodes of crowds that are not settled after ``most`` comparisons."""
    width = bits - split

    def met(bucket: int, table: pa.Table) -> pa.RecordBatch:
        cat = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
        keys, sizes, checks, low = cat("keys", "<i8"), cat("sizes", "<u4").astype(np.int64), cat("checks", "<u8").reshape(-1, CHECKS), cat("lows", "<u4")
        odd = (np.bitwise_count(low) + (bucket & ((1 << split) - 1)).bit_count()) % 2 == 1
        count = int(odd.sum()) * (width - 1) + len(low)
        upper = min(width, max(0, math.ceil(math.log2(max(1, count / TURNED_AT_ONCE)))))  # a bucket with a crowd is turned in parts
        pairs, members = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for part in range(1 << upper):
            slots, who = turned(low, odd, width, width - upper, part)
            order = np.argsort(slots, kind="stable")
            slots, who = slots[order], who[order]
            start = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]])) if len(slots) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(slots)))
            large = size > crowd
            for s in np.unique(size[~large & (size > 1)]).tolist():
                i, j = np.triu_indices(s, 1)
                runs = start[~large & (size == s)]
                for at in range(0, len(runs), max(1, 400_000 // len(i))):
                    some = runs[at : at + max(1, 400_000 // len(i)), None]
                    a, b = who[(some + i).ravel()], who[(some + j).ravel()]
                    ok = may_be_near(sizes, checks, a, b)
                    pairs.append((a[ok], b[ok]))
            for at, s in zip(start[large].tolist(), size[large].tolist()):
                own = who[at : at + s]
                n, c = sizes[own], checks[own]
                a, b, rest = _forest(s, lambda i, others, n=n, c=c: may_be_near(n, c, i, others), most)
                pairs.append((own[a], own[b]))
                members.append((own[rest], np.full(len(rest), (bucket << width) | int(slots[at]))))
        by_key = np.argsort(keys)
        rank = np.argsort(by_key)
        root = _smallest(len(keys), *(rank[np.concatenate(e)] for e in zip(*pairs, strict=True)))
        own = np.flatnonzero(root != np.arange(len(keys)))
        found = np.stack([keys[by_key[root[own]]], keys[by_key[own]]], 1)
        node, slot = (np.concatenate(e).astype(np.int64) for e in zip(*members, strict=True))
        zero = np.zeros(len(found), np.int64)
        cols = [
            np.concatenate([zero - 1, slot]),
            np.concatenate([found[:, 0], keys[node]]),
            np.concatenate([zero, sizes[node]]),
            *(np.concatenate([zero, checks[node, k].astype(np.int64)]) for k in range(CHECKS)),
            np.concatenate([found[:, 1], np.zeros(len(node), np.int64)]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in _MET.split(", ")])

    def run(batches):
        """All rows of a bucket are in one partition, which holds few buckets."""
        held: dict[int, list] = {}
        for b in batches:
            buckets = b["bucket"].to_pylist()
            for k in set(buckets):
                held.setdefault(k, []).append(b.filter(pa.array([x == k for x in buckets])))
        for k in sorted(held):
            yield met(k, pa.Table.from_batches(held.pop(k)))
        tidy()

    return run


def passes(tables: int, split: int) -> list[tuple[int, int]]:
    """Runs of tables whose buckets take at most ``PASS`` bytes a row, or one table."""
    per = (2 + split) / 2 * (16 + 8 * CHECKS)
    step = max(1, int(PASS / per))
    return [(k, min(tables, k + step)) for k in range(0, tables, step)]


def _met(nodes: DataFrame, rows: int) -> list[DataFrame]:
    """Written tables of candidates' links (slot -1) and crowds' members."""
    bits, tables = shape(rows)
    total = rows * tables * (bits + 1) // 2
    split = min(bits - 1, max(0, math.ceil(math.log2(max(1, total / tables / VARIANTS_PER_BUCKET)))))
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // BATCH))
    out = []
    for first, last in passes(tables, split):
        dealt = nodes.select("key", "n", "sketch").repartition(parts, "key").mapInArrow(_emit(bits, split, first, last), _DEALT)
        out.append(written(dealt.repartition("bucket").mapInArrow(_meet(bits, split, CROWD, COMPARED), _MET), "met"))
    return out


def _held(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Written table key, held (the shingles) of the wanted nodes. Texts are moved only where the nodes are too many to be sent to all."""
    chosen = written(nodes.join(wanted, "key", "left_semi").select(F.col("key").alias("_key"), "least", "alike"), "chosen")
    count, alike = chosen.agg(F.count(F.lit(1)), F.max("alike")).head()
    side = F.broadcast(chosen) if count <= BROADCAST_ROWS else chosen
    texts = docs.join(side, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("least")), "left_semi").select("key", "text")
    sets = texts.mapInArrow(_sets, "key long, held binary")
    held = written(sets if alike == 1 else sets.groupBy("key").agg(F.first("held").alias("held")), "held")  # rows that are equal in doc_id and text come in numbers
    forget(chosen)
    return held


def near_links(docs: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """src, dst: links that keep the components of near copies among the nodes (key, least, alike, n, sketch); ``docs`` (doc_id, key, text) has their texts."""
    met = _met(nodes, rows)
    every = reduce(DataFrame.unionAll, met)
    crowd = spanned(every.where("slot >= 0").select(F.col("slot").alias("group"), "key", "n", *_MARKS), 1024, _by_marks)
    alike = every.where("slot = -1").select(F.col("key").alias("src"), F.col("other").alias("dst")).unionAll(crowd)
    comp = connected_components(alike).select(F.col("id").alias("key"), F.col("comp").alias("group"))
    groups = written(comp.join(nodes.select("key", "n"), "key"), "groups")
    for part in met:
        forget(part)
    held = _held(docs, nodes, groups.select("key"))
    links = written(spanned(groups.join(held, "key"), 256, _by_sets), "links")
    forget(groups)
    forget(held)
    return links


def text_key() -> Column:
    """A hash of column ``text`` (null: empty)."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, key (``text_key``), root (a key of the component), component_id (the smallest doc_id reachable over near copies)."""
    lean_batches(docs.sparkSession)
    rows = docs.count()
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long"), text_key().alias("key"), text.alias("text"))
    marks = written(keyed.mapInArrow(_sketch(width(rows)), "doc_id long, key long, n long, sketch binary"), "marks")
    who = marks.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("alike"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "alike", "n", "sketch")).alias("m")
    nodes = written(who.groupBy("key").agg(least).select("key", F.col("m.doc_id").alias("least"), "m.alike", "m.n", "m.sketch"), "nodes")
    comp = connected_components(near_links(keyed, nodes, rows)).withColumnRenamed("id", "key")
    rooted = nodes.select("key", "least").join(comp, "key", "left").select("key", "least", F.coalesce("comp", "key").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = rooted.join(named, "root").select("key", "root", "component_id")
    out = written(marks.select("doc_id", "key").join(names, "key").select("doc_id", "key", "root", "component_id"), "groups")
    forget(marks)
    forget(nodes)
    return out
