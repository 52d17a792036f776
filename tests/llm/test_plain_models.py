"""Decoding and scores of the two classifiers against plain versions of them, text by text and gram by gram."""

import math
import unicodedata

import numpy as np
import pytest

from edgeloom.llm import language, ngrams, toxicity

TEXTS = ["Der Hund und die Katze", "the dog and the cat", "x", "½ ² ① Ⅷ 7", "", None, "été à la plage " * 40, "日本語", "a  b\tc\nd", "ß" * 3, "MiXeD CaSe, with 12 numbers!"]


def bucket(gram, bits):
    h = 0
    for b in gram:
        h = (h << 8) | b
    return (h * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - bits)


def padded(text):
    low = (text or "").lower().encode()
    return b"  " + bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in low) + b"  "


def plain_mean(tables, text, j):
    raw, total, count = padded(text), 0.0, 0
    for k in range(len(raw)):
        if raw[k] == 32:
            continue
        count += 1
        for row, n in enumerate((2, 3)):
            total += float(tables[row][bucket((raw + b"    ")[k : k + n], language.BITS)][j])
    return total / max(1, count)


def test_decoding_equals_the_plain_loss_weighted_one():
    rng = np.random.default_rng(3)
    vocabulary = {lang: ["".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(40)] for lang, letters in {"aa": "abcdefg", "bb": "efghijk", "cc": "ijklmno", "dd": "mnopqab", "ee": "qrstuvw"}.items()}
    texts, langs = [], []
    for lang, words in vocabulary.items():
        for _ in range(30):
            texts.append(" ".join(rng.choice(words, 12)))
            langs.append(lang)
    model = language.train(texts, langs)
    asked = TEXTS + texts[::17] + [texts[0] + " " + texts[40]]
    pred, score, unsure = language.decode(model, asked)
    for text, p, s, u in zip(asked, pred, score, unsure, strict=True):
        if not any(unicodedata.category(c).startswith("L") for c in text or ""):
            assert (p, s, u) == ("und", 0.0, False)
            continue
        f = [min(30, max(-30, plain_mean(model["tables"], text, j) * model["scale"][j] + model["shift"][j])) for j in range(model["code"].shape[1])]
        far = [sum(model["weight"][i][j] * math.log1p(math.exp(-model["code"][i][j] * f[j])) for j in range(len(f))) * len(f) for i in range(len(model["names"]))]
        share = [math.exp(min(far) - x) for x in far]
        best = far.index(min(far))
        assert p == model["names"][best]
        assert s == pytest.approx(share[best] / sum(share), abs=1e-4) and u == (s < language.AMBIGUOUS)


def test_letters_are_of_category_l():
    assert not any(map(ngrams.has_letter, [None, "", "½", "²", "①", "Ⅷ", "_", "7 !!", "́"]))
    assert all(map(ngrams.has_letter, ["a", "é", "日", "ʰ", "ß 1"]))


def test_scores_equal_the_plain_mean():
    rng = np.random.default_rng(4)
    model = {"table": rng.normal(size=1 << toxicity.BITS).astype(np.float32) * 50, "bias": -0.3}
    got = toxicity.scores(model, TEXTS)
    for text, s in zip(TEXTS, got, strict=True):
        raw, total, count = padded(text), 0.0, 0
        for n in toxicity.ORDERS:
            for k in range(len(raw) - n + 1):
                if 32 not in raw[k + 1 : k + n - 1]:
                    count += 1
                    total += float(model["table"][bucket(raw[k : k + n], toxicity.BITS)])
        assert s == pytest.approx(1 / (1 + math.exp(-(total / (toxicity.NEUTRAL + count) + model["bias"]))), abs=1e-5)
    assert got.tolist() == toxicity.scores(model, TEXTS + TEXTS[:2])[: len(TEXTS)].tolist()


def test_scores_of_one_text_do_not_depend_on_its_neighbours():
    rng = np.random.default_rng(5)
    model = {"table": rng.normal(size=1 << toxicity.BITS).astype(np.float32), "bias": 0.1}
    one = [float(toxicity.scores(model, [t])[0]) for t in TEXTS]
    assert one == pytest.approx(toxicity.scores(model, TEXTS).tolist(), abs=1e-9)


def test_samples_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "PER_LANGUAGE", 50)
    seen = []
    monkeypatch.setattr(language, "train", lambda texts, langs, seed=0: seen.append((texts, langs)))
    rows = [(i, f"text number {i}", "en" if i % 2 else "de") for i in range(800)] + [(1, "again and again", "en")] * 300 + [(900 + i, "z" * 200_000, "en") for i in range(5)]
    language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts, langs = seen[0]
    assert all(30 <= langs.count(x) <= 50 for x in ("de", "en")) and texts.count("again and again") <= 1 and max(map(len, texts)) <= language.LEARN_BYTES
