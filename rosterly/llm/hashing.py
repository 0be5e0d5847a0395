"""Hashes of words and of runs of consecutive words, for tasks that work on Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

#: An odd multiplier; runs hash as polynomials in it, modulo 2^64, over the 64-bit hashes of their words.
BASE = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """Word -> 64-bit hash, remembered for as many words as there is room for."""

    def __init__(self, room: int = 150_000):
        super().__init__()
        self.room = room

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.room:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads differences over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(a: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k consecutive words, by doubling: O(len(a) log k)."""
    if len(a) < k:
        return a[:0]
    out, done, power, length = None, 0, a, 1
    while True:
        if k & length:
            out = power if out is None else out[: len(a) - done - length + 1] * np.uint64(pow(BASE, length, 1 << 64)) + power[done : done + len(a) - done - length + 1]
            done += length
        if done == k:
            return mixed(out[: len(a) - k + 1])
        power = power[:-length] * np.uint64(pow(BASE, length, 1 << 64)) + power[length:]
        length *= 2
