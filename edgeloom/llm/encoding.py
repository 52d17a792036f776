"""Token ids of whole texts by the ``tokenizers`` library, with each distinct segment encoded once.

A byte-level BPE never merges across the segments that its own pattern cuts.
Runs of non-space characters, each with at most one space before it (cut once
more behind a leading word of Latin letters), and the white space between them
are unions of such segments, so a text's ids are its segments' ids in a row. Words
repeat, so a worker keeps the ids of the short segments it has met lately (two
generations of ``KEPT`` segments of at most ``SHORT`` characters, which bounds
their bytes whatever the texts hold). Texts with the few control
characters on which the two libraries' ideas of white space differ, and texts
that hold the string of an added token, are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

KEPT = 600_000
SHORT = 64
_SEGMENT = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[\s!-@\[-`{-~]|\Z)| ?\S+|\s+(?!\S)|\s+")
_WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+\Z")
_ODD = re.compile("[\x1c-\x1f]")


def _byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_SIGNS = _byte_signs()
_BLANK = _BYTE_SIGNS[32]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Segments(dict):
    """Bytes of the ids of each segment met; one that is not there yet is encoded when it is asked for."""

    def __init__(self, encoder: Encoder, old: dict[str, bytes]):
        self.encoder, self.old = encoder, old

    def __missing__(self, segment: str) -> bytes:
        got = self.old.get(segment) or self.encoder.encoded(segment)
        if len(segment) <= SHORT:
            self[segment] = got
        return got


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.model = self.tokenizer.model
        self.seen = _Segments(self, {})

    def encoded(self, segment: str) -> bytes:
        """A single word goes to the model itself, anything else through the whole tokenizer."""
        if segment.isascii() and segment[1:].isalpha() and (segment[0] == " " or segment[0].isalpha()):
            units = _BLANK + segment[1:] if segment[0] == " " else segment
            return array("I", [t.id for t in self.model.tokenize(units)]).tobytes()
        if _WORD.match(segment):
            units = segment.encode().decode("latin-1").translate(_BYTE_SIGNS)
            return array("I", [t.id for t in self.model.tokenize(units)]).tobytes()
        return array("I", self.tokenizer.encode(segment, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        """uint32 ids of one text; null: none."""
        if not text:
            return np.zeros(0, np.uint32)
        if _ODD.search(text) or self.added and self.added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self.seen) > KEPT:
            self.seen = _Segments(self, dict(self.seen))
        return np.frombuffer(b"".join(map(self.seen.__getitem__, _SEGMENT.findall(text))), "<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
