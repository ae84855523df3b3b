"""Sets of word shingles and their MinHash values, in vectorised numpy.

Permutation j is the universal hash ``a[j] * x + b[j]`` modulo 2**32 of the upper half of a shingle's 64-bit hash;
a[j] is odd. Of each least value 16 bits are kept: unequal values then still differ but once in 65,536.
"""

from __future__ import annotations

import numpy as np

import pyarrow as pa

from .common import Words, hash_runs, mix

_BLOCK = 2048


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of k words; with fewer words, of the whole sequence; without words, none."""
    if not len(words):
        return words
    return np.unique(hash_runs(words, min(k, len(words))))


class Sets:
    """The sets of word shingles of several texts, by numbers that equal shingles of these texts share and others do not:
    the words themselves are compared, no hashes. `lead`: so many blank words stand before each text."""

    def __init__(self, words: Words, k: int, lead: int = 0):
        count = np.diff(words.first)
        size = np.where(count > 0, np.maximum(count + lead, k), 0)  # texts of fewer words are filled up with a word of its own
        first = np.concatenate([[0], np.cumsum(size)])
        text = np.repeat(np.arange(len(size), dtype=np.int32), size)
        ids = np.zeros(first[-1], np.int32)
        ids[np.arange(len(words.starts)) + np.repeat(first[:-1] + np.where(count > 0, lead, 0) - words.first[:-1], count)] = words.numbers() + 1
        codes, kinds = ids, int(ids.max(initial=0)) + 1
        for j in range(1, min(k, len(ids))):
            found = pa.array(codes[:-1] * np.int64(kinds) + ids[j:]).dictionary_encode()
            codes = np.asarray(found.indices)
            del found
        codes = codes[: max(0, len(ids) - k + 1)]
        own = text[: len(codes)]
        inside = np.arange(len(codes)) + k <= first[1:][own]
        self.kinds = int(codes.max(initial=0)) + 1
        keys = np.unique(own[inside] * np.int64(self.kinds) + codes[inside])
        self.text, self.codes = keys // self.kinds, keys % self.kinds
        self.size = np.bincount(self.text, minlength=len(size))
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    def of(self, i: int) -> np.ndarray:
        return self.codes[self.first[i] : self.first[i + 1]]

    def common(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The sizes of the intersections of texts one[j] and two[j]."""
        side = lambda at: np.repeat(np.arange(len(at)), self.size[at]) * np.int64(self.kinds) + self.codes[np.arange(self.size[at].sum()) + np.repeat(self.first[at] - np.cumsum(self.size[at]) + self.size[at], self.size[at])]
        return np.bincount(np.intersect1d(side(one), side(two), assume_unique=True) // self.kinds, minlength=len(one))


def reach(common: np.ndarray, one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, for sizes of intersections and sets; empty sets reach nothing."""
    return (100 * common >= percent * (one + two - common)) & (common > 0)


class Permutations:
    def __init__(self, n: int, seed: int = 1):
        draw = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.n = n
        self.a = (draw[:n] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
        self.b = (draw[n:] >> np.uint64(32)).astype(np.uint32)[:, None]
        self.room = np.empty((n, _BLOCK), np.uint32)

    def least(self, hashes: np.ndarray) -> np.ndarray:
        """The 16-bit values of a set; all ones for an empty set."""
        if not len(hashes):
            return np.full(self.n, 0xFFFF, np.uint16)
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        low = None
        for at in range(0, len(x), _BLOCK):
            part = x[at : at + _BLOCK]
            room = self.room[:, : len(part)]
            np.multiply(part[None, :], self.a, out=room)
            np.add(room, self.b, out=room)
            found = room.min(axis=1)
            low = found if low is None else np.minimum(low, found)
        return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def set_key(hashes: np.ndarray, size: int) -> int:
    """A 64-bit key that equal sets share: order does not matter; each member is given once."""
    return int(np.sum(mix(hashes ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64) ^ mix(np.array([size], np.uint64))[0])
