"""Hashes of words and word windows, vectorised over one text inside a task."""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SECOND_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, remembered for up to a fixed number of words per worker."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int, multiplier: np.uint64 = MULTIPLIER) -> np.ndarray:
    """Hash of every n consecutive word hashes (empty if there are fewer), by doubling of window lengths."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, length, power = None, 0, int(multiplier)
    block, block_length = h, 1
    rest = n
    while rest:
        if rest & 1:
            out = block[: len(h) - block_length + 1] if out is None else out[: len(h) - length - block_length + 1] * np.uint64(power) + block[length : len(h) - block_length + 1]
            length += block_length
        rest >>= 1
        if rest:
            block = block[: len(block) - block_length] * np.uint64(power) + block[block_length:]
            block_length *= 2
            power = power * power & (1 << 64) - 1
    return mixed(out)


def shingle_set(words: list[bytes], n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a text of 1 to n-1 words is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(n, len(words))))
