"""Byte n-grams of many texts at once, as numpy arrays.

Texts are lower-cased, ASCII characters other than letters become spaces, and
each text lies between two spaces before and two after, so its n-grams are the
same in whatever batch it comes. Very long texts are cut into pieces of
``PIECE`` characters, whose sums add up, so memory stays bounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import regex

PIECE = 500_000
BATCH_BYTES = 400_000
_PLAIN = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")  # not the numbers that are written as letters


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def held_out(doc_id) -> bool:
    """Rows that no model may learn from (a null doc_id is never held out)."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def plain(text: str | None) -> list[bytes]:
    """Normalised pieces of a text."""
    text = text or ""
    return [text[i : i + PIECE].lower().encode("utf-8", "replace").translate(_PLAIN) for i in range(0, max(1, len(text)), PIECE)]


def buffers(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, owner): each piece's run goes from its start to the next one; owner is the text's number."""
    parts, who, held = [], [], 0
    for i, t in enumerate(texts):
        for p in plain(t):
            parts.append(p)
            who.append(i)
            held += len(p) + 4
            if held >= BATCH_BYTES:
                yield _joined(parts, who)
                parts, who, held = [], [], 0
    if parts:
        yield _joined(parts, who)


def _joined(parts: list[bytes], who: list[int]):
    raw = np.frombuffer(b"  " + b"    ".join(parts) + b"      ", np.uint8)
    sizes = np.array([len(p) + 4 for p in parts], np.int64)
    return raw, np.concatenate([[0], np.cumsum(sizes)]), np.array(who)


def hashed(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram at each place from 0 to len(raw) - 6, for n up to 6."""
    m = len(raw) - 6
    h = raw[:m].astype(np.uint64)
    for k in range(1, n):
        h <<= np.uint64(8)
        h |= raw[k : k + m]
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - bits)).astype(np.int64)
