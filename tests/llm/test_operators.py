"""Each operator against a plain version of itself, on odd rows and on tables of the smallest size."""

import hashlib
import os
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from edgeloom.llm import decontaminate, encoding, html_text, language, merkle, packing, sharding, simhash, suffix_dedup, token_files, toxicity

TABLES = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# 1 language


def test_codewords_tell_languages_apart():
    for k in (2, 3, 5, 9):
        code = language.codewords(k)
        assert len({tuple(r) for r in code}) == k
    assert language.codewords(1).shape == (1, 0)


@needs_tables
def test_language_of_held_out_rows(tiny):
    model = language.learn(tiny)
    got = language.identify(tiny, model).select("doc_id", "lang", "lang_pred").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_language_of_odd_rows(odd_docs, no_docs):
    model = language.train(["the and of " * 20, "der die das und " * 20], ["en", "de"])
    got = {(r["doc_id"], r["text"]): r for r in language.identify(odd_docs, model).collect()}
    assert len(got) == odd_docs.distinct().count()
    for r in got.values():
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or ""))
    assert language.identify(no_docs, language.learn(no_docs)).count() == 0
    assert language.decode(language.train([], []), ["text"])[0] == ["und"]
    assert language.decode(language.train(["hello"], ["en"]), ["text", None])[0] == ["en", "und"]


# 2 packing


def check_packing(docs, out, length=2048):
    enc = encoding.encoder(encoding.default_tokenizer())
    pieces, seqs = {}, {}
    for r in out.collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    want = {}
    for doc, text in docs:
        ids = np.append(enc.ids(text), np.uint32(1)).astype("<u4")
        want.setdefault(doc, []).append(ids)
    for doc, texts in want.items():
        got = sorted(pieces.pop(doc))
        if len(texts) == 1:
            at = 0
            for start, n, crc, total in got:
                assert start == at and total == len(texts[0]) and crc == zlib.crc32(texts[0][at : at + n].tobytes())
                at += n
            assert at == len(texts[0])
        else:
            assert sum(n for _, n, _, _ in got) == sum(map(len, texts))
    assert not pieces
    for held in seqs.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= length
    assert sorted(seqs) == list(range(len(seqs)))
    return len(seqs), sum(len(t) for ts in want.values() for t in ts)


@needs_tables
def test_packing_is_exact_and_tight(tiny):
    n, tokens = check_packing(pairs(tiny), packing.with_crc(tiny))
    assert n <= tokens / 2048 * 1.02 + 1


def test_packing_of_odd_rows(odd_docs, no_docs):
    check_packing(pairs(odd_docs), packing.with_crc(odd_docs))
    assert packing.with_crc(no_docs).count() == 0


def test_linear_program_is_near_the_bound():
    rng = np.random.default_rng(3)
    size, need = np.arange(1, 25), rng.integers(1, 400, 24)
    found = packing.solve_patterns(size, need.astype(float), 64)
    assert all((p @ size) <= 64 for p, _ in found)
    assert (sum(x * p for p, x in found) >= need - 1e-6).all()
    assert sum(x for _, x in found) <= (size @ need) / 64 * 1.01
    used = packing.round_patterns(found, need)
    assert (sum(k * p for p, k in used) <= need).all()


def test_knapsack_prices_the_best_pattern():
    size, value = np.array([3, 5, 7]), np.array([0.3, 0.55, 0.72])
    best, taken = packing.knapsack(value, size, 16)
    brute = max(a * 0.3 + b * 0.55 + c * 0.72 for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 16)
    assert abs(best[16] - brute) < 1e-12 and abs(packing.pattern_from(taken, size, 16) @ value - brute) < 1e-12


# 3 SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(fps))]


def test_fingerprints_equal_the_definition():
    for t in ("", "  ", "One", "one two", "A b\tC d\x0be", "x " * 700 + "y"):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_links_keep_the_components_of_the_ball(spark):
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64)]
    for f in list(fps):
        for _ in range(3):
            bits = rng.choice(64, rng.integers(1, 5), replace=False)
            fps.append(f ^ sum(1 << int(b) for b in bits))
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    at, parent = {x: i for i, x in enumerate(signed)}, list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in got:
        a, b = at[r["src"]], at[r["dst"]]
        assert (fps[a] ^ fps[b]).bit_count() <= 3
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert [find(a) for a in range(len(fps))] == plain_components(fps)


@needs_tables
def test_near_duplicates_of_a_table(tiny):
    docs = sorted(pairs(tiny))
    fps = [plain_fingerprint(t) for _, t in docs]
    comp = plain_components(fps)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(tiny).collect()}
    for (i, _), f, c in zip(docs, fps, comp, strict=True):
        assert got[i]["fp"] % (1 << 64) == f and got[i]["component_id"] == docs[c][0]


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    zero = {r["doc_id"]: r["component_id"] for r in got if r["fp"] == 0}
    assert set(zero) == {3, 4, 5} and set(zero.values()) == {3}
    assert simhash.near_duplicates(no_docs).count() == 0


# 4 suffix dedup


def plain_repeats(docs):
    seen, out = {}, {}
    for doc, text in docs:
        raw = text.encode()
        for s in range(len(raw) - 49):
            w = raw[s : s + 50]
            seen[w] = min(seen.get(w, doc), doc)
    for doc, text in docs:
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 49):
            if seen[raw[s : s + 50]] < doc:
                gone[s : s + 50] = b"\x01" * 50
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.setdefault(doc, set()).add((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def found_repeats(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], set()).add((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    return out


@needs_tables
def test_repeats_of_a_table(tiny):
    assert found_repeats(suffix_dedup.remove_repeats(tiny, False)) == plain_repeats(pairs(tiny))


def test_repeats_of_odd_rows(odd_docs, no_docs):
    last = 1 << 62
    want = plain_repeats([(last if d is None else d, t) for d, t in pairs(odd_docs)])
    got = found_repeats(suffix_dedup.remove_repeats(odd_docs))
    got[last] = got.pop(None)
    assert got == want
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_repeats_across_segments_and_one_id(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 128)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("ab c"), n))
    shared = word(400)
    rows = [(1, word(200) + shared + word(90)), (2, shared[100:] + word(60)), (3, word(30) + shared[50:220]), (3, shared[:120]), (4, word(49)), (5, "z" * 300), (6, "z" * 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_repeats(suffix_dedup.remove_repeats(df)) == plain_repeats(rows)


def test_refined_buckets_group_equal_prefixes():
    rng = np.random.default_rng(4)
    buf = rng.integers(97, 99, 4000).astype(np.uint8)
    buf[2000:2600] = buf[100:700]
    number = suffix_dedup.refined_buckets(buf)
    raw, first = buf.tobytes(), {}
    for i in range(len(raw) - 50):
        key = raw[i : i + 50]
        assert first.setdefault(key, number[i]) == number[i]
    assert len(set(first.values())) == len(first)


# 5 Merkle


def test_merkle_of_odd_rows(odd_docs, no_docs):
    got = merkle.edited_documents(odd_docs).collect()
    order = sorted(pairs(odd_docs), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1]))
    after = {}
    for k, (d, t) in enumerate(order):
        after.setdefault((d, t), set()).add(order[(k + 1) % len(order)][1])
    assert len(got) == len(order)
    for r in got:
        assert r["next_text"] in after[(r["doc_id"], r["text"])]
        k = len(r["text"]) // 3
        assert r["edited"] == r["text"][: len(r["text"]) - k] + r["next_text"][:k]
    assert merkle.edited_documents(no_docs).count() == 0


def test_merkle_finds_the_edit(spark):
    lines = [f"Paragraph number {i} tells its own story." for i in range(30)]
    other = list(lines)
    other[11] = "Something else stands here now."
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    df = merkle.with_fingerprint(merkle.with_fingerprint(df, "a", "fa"), "b", "fb")
    row = df.select(merkle.changed_paragraphs(F.col("fa"), F.col("fb")).alias("c"), merkle.changed_paragraphs(F.col("fa"), F.col("fa")).alias("same"), merkle.likeness(merkle.leaves(F.col("fa")), merkle.leaves(F.col("fb"))).alias("n")).head()
    assert row["c"] == [11] and row["same"] == [] and 0.8 < row["n"] < 1


# 6 token files


def check_files(docs, out):
    enc = encoding.encoder(encoding.default_tokenizer())
    at = 0
    rows = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out.collect())
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(rows) == len(order)
    for (start, doc, n, crc), (want, text) in zip(rows, order, strict=True):
        ids = np.append(enc.ids(text), np.uint32(2)).astype("<u4")
        assert (start, doc, n, crc) == (at, want, len(ids), zlib.crc32(ids.tobytes()))
        at += n


def test_token_files_of_odd_rows(odd_docs, no_docs):
    check_files(pairs(odd_docs), token_files.read_documents(token_files.write_token_files(odd_docs)))
    assert token_files.read_documents(token_files.write_token_files(no_docs)).count() == 0


@needs_tables
def test_token_files_are_mapped_sequences(tiny):
    manifest = token_files.write_token_files(tiny)
    check_files(pairs(tiny), token_files.read_documents(manifest))
    row = manifest.head()
    reader, _ = token_files.open_sequences(row["root"], row["path"])
    assert reader.schema.field("ids").type.list_size == 2048 and reader.schema.field("mask").type.list_size == 2048
    masked = sum(int(np.count_nonzero(reader.get_batch(i).column(1).flatten().to_numpy(zero_copy_only=False))) for i in range(reader.num_record_batches))
    assert masked == row["n_tokens"]


def test_encoder_equals_the_library():
    enc = encoding.Encoder(encoding.default_tokenizer())
    for t in ["", " ", "a  b\n\n c\t\td   \n", "　x \xa0y <|endoftext|> 1's don't ", "a\x1cb c", "\r\n x  y", "日本語 テスト  12３", "x²y ½z", "it's'tis 'll", "éa"]:
        assert enc.ids(t).tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


# 7 decontamination


def test_decontamination_of_odd_rows(odd_docs, no_docs, spark):
    item = " ".join(f"w{i}" for i in range(30))
    broken = " ".join(w if i % 6 else "other" for i, w in enumerate(item.split()))
    sparse = " ".join(w if i % 2 else "other" for i, w in enumerate(item.split()))
    extra = spark.createDataFrame([(50, "before " + broken + " after"), (51, sparse), (52, item[:40])], "doc_id long, text string")
    items = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, None, 0), (3, "", 0), (4, "too short", 0)], "item_id long, text string, tokens int")
    docs = odd_docs.unionByName(extra, allowMissingColumns=True)
    for bound in (decontaminate.BROADCAST_BYTES, -1):
        got = decontaminate.overlaps(docs, items, bound).collect()
        assert [(r["doc_id"], r["item_id"]) for r in got] == [(50, 1)]
    assert decontaminate.overlaps(no_docs, items).count() == 0
    assert decontaminate.overlaps(docs, items.limit(0)).count() == 0


# 8 toxicity


def test_toxicity_learns_and_meets_misspellings(odd_docs, no_docs, spark):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(["ba", "ne", "ti", "lo", "ru", "sha", "en", "or", "mi", "qua"], 3)) for _ in range(300)]
    plain = lambda: " ".join(rng.choice(vocabulary, 40))
    texts = [plain() for _ in range(120)] + [plain() + " horrible rotten " + plain() for _ in range(60)]
    model = toxicity.train(texts, [0] * 120 + [1] * 60)
    s = toxicity.scores(model, [plain(), plain() + " horrribles rottten " + plain(), "", None])
    assert s[0] < 0.3 < s[1] and s[2] == s[3]
    got = toxicity.score_documents(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_documents(no_docs, toxicity.learn(no_docs, none)).count() == 0
    some = spark.createDataFrame([(1, 1), (1, 0), (2, None), (99, 1), (None, 1)], "doc_id long, toxic int")
    assert 0 <= toxicity.scores(toxicity.learn(odd_docs, some), ["x"])[0] <= 1


# 9 sharding


def check_shards(docs, out, shards=16):
    rows = out.collect()
    assert len(rows) == len(docs)
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len(t.encode()) + 1, zlib.crc32(t.encode())) for _, t in docs)
    for s in range(shards):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    return rows


@needs_tables
def test_shards_of_a_table(tiny):
    rows = check_shards(pairs(tiny), sharding.shard_documents(tiny))
    held = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], 16)
    assert held.max() - held.min() <= max(r["size"] for r in rows)


def test_shards_keep_copies_together_and_split_hot_texts(spark, odd_docs, no_docs):
    rows = [(i, f"text {i % 100} of a small group that has copies") for i in range(400)] + [(1000 + i, "hot") for i in range(3000)] + [(9000 + i, f"single {i} " * 3) for i in range(3000)]
    got = check_shards(rows, sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")))
    held = np.bincount([r["shard"] for r in got], [r["size"] for r in got], 16)
    assert held.max() <= 1.02 * held.mean()
    groups = {}
    for r in got:
        if r["doc_id"] < 400:
            groups.setdefault(r["text_crc32"], []).append(r["shard"])
    together = np.mean([max(np.bincount(g)) / len(g) for g in groups.values()])
    assert together > 0.9
    check_shards(pairs(odd_docs), sharding.shard_documents(odd_docs))
    assert sharding.shard_documents(no_docs).count() == 0


# 10 html


def test_html_scanner_is_tolerant():
    page = "<article><p>One <b>two<br>three<p>Four &amp; five</article><script>x='<p>no</p>'</script><!-- <p>no</p> --><p>six"
    assert [b.text for b in html_text.blocks(page)] == ["One two three", "Four & five", "six"]
    assert html_text.blocks(None) == [] and html_text.blocks("<<<>>") is not None


def test_html_on_held_out_layouts(spark):
    model = html_text.train(html_text.labelled(html_text.sample_pages()))
    test = html_text.sample_pages(200, seed=123)
    right = sum(html_text.main_text(model, p) == "\n".join(" ".join(g.split()) for g in good) for p, good in test)
    assert right >= 190
    rows = [(1, "u", test[0][0], 5), (2, None, None, 5), (None, "u", "", 5), (2, "u", "<p>", 5)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), model).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 8))
        w = {f"f{i}": float(rng.normal()) for i in range(n)}
        move = rng.normal(size=(2, 2)).tolist()
        feats = [[f"f{i}"] for i in range(n)]
        score = lambda y: sum(w[f"f{i}"] * y[i] for i in range(n)) + sum(move[y[i]][y[i + 1]] for i in range(n - 1))  # noqa: B023, E731
        best = max(([int(b) for b in np.binary_repr(k, n)] for k in range(1 << n)), key=score)
        assert abs(score(html_text.viterbi({"weights": w, "move": move}, feats)) - score(best)) < 1e-9
