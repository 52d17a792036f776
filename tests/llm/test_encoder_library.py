"""Ids of the segment encoder against a fresh tokenizer of the library, on strings drawn to be awkward."""

import os
import random

import pytest

from edgeloom.llm import encoding

PARTS = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "a", "B", " the", "word", "été", "ñandú", "日本語", "Ⅷ", "²", "12", "3", "'s", "'t", "!!", ".", "-", "_", "😀", "​", "́", "ſ", "İ", "\r\n", "xyzzyqq" * 20]


@pytest.mark.parametrize("kept", [3, 400_000])
def test_ids_equal_the_library(monkeypatch, kept):
    monkeypatch.setattr(encoding, "KEPT", kept)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    path = encoding.default_tokenizer()
    plain, enc, rng = Tokenizer.from_file(path), encoding.Encoder(path), random.Random(5)
    for _ in range(6000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
        assert enc.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert enc.ids("foo <|endoftext|> bar").tolist() == plain.encode("foo <|endoftext|> bar", add_special_tokens=False).ids
    assert enc.ids(None).tolist() == []
