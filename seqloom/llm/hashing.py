"""Numpy helpers of the tasks: word hashes, window hashes, sliding minima, byte planes."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
#: Words that a task remembers the hash of.
CACHED_WORDS = 150_000


class WordHashes(dict):
    """word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), U, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, U)
    out = words[:count].copy()
    for k in range(1, n):
        out *= _BASE
        out += words[k : k + count]
    return mix(out)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each ``width`` (a power of two) consecutive values."""
    best, at, step = values, np.arange(len(values)), 1
    while step < width:
        right = best[step:] < best[:-step]
        at = np.where(right, at[step:], at[:-step])
        best = np.where(right, best[step:], best[:-step])
        step *= 2
    return at


def planes(values: np.ndarray) -> bytes:
    """The bytes of an array, all lowest bytes first: equal high bytes then compress to nothing."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(dtype).ravel()
