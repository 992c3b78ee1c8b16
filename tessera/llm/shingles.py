"""Word shingles of a document as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class WordHashes(dict):
    """Word -> 64-bit hash; forgets everything at ``limit`` words to bound memory."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that leaves no low-order pattern."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of all ``size``-word shingles.

    Bytes A-Z are lower-cased and words are runs of bytes other than space and
    \\t-\\r, which is what ``bytes.lower`` and ``bytes.split`` do. A text with
    fewer words is one shingle; a text without words has none.
    """
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    take = min(size, len(h))
    total = np.full(len(h) - take + 1, take, dtype=np.uint64)
    for i in range(take):
        part = h[i : len(h) - take + 1 + i]
        total = mixed(total + part * _MUL[i % len(_MUL)] + np.uint64(i))
    return np.unique(total)
