"""64-bit hashes of words and of windows of consecutive words, for many documents at once."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ (x >> _SHIFT)
    x *= _ODD
    x ^= x >> np.uint64(32)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, by where they start; runs are doubled, so this takes about 2 log2(k) passes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, covered, power, width = None, 0, mixed(words), 1
    while True:
        if k & width:
            out = power[:n] if out is None else mixed(out * np.uint64(5) + power[covered : covered + n] * np.uint64(3))[:n]
            covered += width
        if covered == k:
            return out
        power = mixed(power[:-width] * np.uint64(7) + power[width:])
        width *= 2


def window_places(lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of documents laid end to end: the word where each whole window starts, and the document it lies in."""
    counts = np.maximum(lengths - k + 1, 0)
    owner = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(lengths) - lengths
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[owner] + inside, owner
