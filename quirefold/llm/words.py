"""Words as 64-bit hashes, and the mixing function that all hashed draws use."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import claim

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of the public SplitMix64 generator."""
    with np.errstate(over="ignore"):
        x = x + GOLDEN
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode())
        if len(self) < 200_000 and len(word) <= 40:
            self[word] = h
        return h


_hashes = _Hashes()


def word_hashes(words: list[str]) -> np.ndarray:
    claim(_hashes.clear)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of the whole where there are fewer, none where there are none."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    last = len(hashes) - n + 1
    out = np.zeros(last, np.uint64)
    for k in range(n):
        out = mix(out ^ hashes[k : k + last])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
