"""Windows of rows without a doc_id that meet smaller documents across chunks."""

import numpy as np

from edgeloom.llm import suffix_dedup as sd


def test_null_ids_lose_windows_at_unequal_surroundings():
    rng = np.random.default_rng(3)
    whole = rng.integers(97, 123, sd.WIDE).astype(np.uint8)
    other = whole.copy()
    other[-1] ^= 1  # all windows but the last are shared
    every = (1 << sd.SPAN) - 1
    got = sd._settled(np.array([1, sd._MAX, sd._MAX]), np.array([every] * 3, np.int32), np.stack([whole, other, other]))
    assert got.tolist() == [0, every >> 1, every >> 1]
    none = sd._settled(np.array([sd._MAX, sd._MAX]), np.array([every] * 2, np.int32), np.stack([whole, other]))
    assert none.tolist() == [0, 0]
