"""Words, hashed words and hashed word n-grams, vectorised over numpy arrays."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word: a run of letters and digits.
WORD = re.compile(r"[^\W_]+")

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class WordHasher:
    """64-bit word hashes, each word hashed once per worker task; the cache is emptied when it is full."""

    def __init__(self, limit: int = 500_000):
        self.cache: dict[str, int] = {}
        self.limit = limit

    def __call__(self, ws: list[str]) -> np.ndarray:
        cache = self.cache
        if len(cache) > self.limit:
            cache.clear()
        new = set(ws).difference(cache)
        for w in new:
            cache[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(cache.__getitem__, ws), np.uint64, len(ws))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive words, in order of place."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    out = hashes[:size].copy()
    for k in range(1, n):
        out *= _MUL
        out += hashes[k : k + size]
    return mixed(out)
