"""Minimal perfect hashing of 64-bit integers, in arrays.

Level by level, every key that is alone at its place of a bit array keeps it, and the others go on to
the next, smaller array. A key's number is the count of set bits before its own: 0 to n - 1, without
gaps. A key that was not there when the hash was built gets some number or none, so that the caller
verifies keys.
"""

from __future__ import annotations

import numpy as np

#: Bits of a level for each key that reaches it; a new set of 64-bit mixes is used at each level.
SPACE = 2
LEVELS = 64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 mixed bits of each key (the finalizer of splitmix64)."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        """`levels`: the bits of each level as 64-bit words."""
        self.levels = levels
        self.before, total = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.before.append(total + np.cumsum(ones) - ones)
            total += int(ones.sum())
        self.size = total

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """The hash of distinct keys."""
        levels, rest = [], np.asarray(keys, np.int64)
        while len(rest):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            bits = 64 * max(1, -(-SPACE * len(rest) // 64))
            at = (mix(rest, len(levels)) % np.uint64(bits)).astype(np.int64)
            met = np.bincount(at, minlength=bits)
            levels.append(np.packbits(met == 1, bitorder="little").view(np.uint64))
            rest = rest[met[at] > 1]
        return cls(levels)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for some of the keys that it was not built with."""
        keys = np.asarray(keys, np.int64)
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, before) in enumerate(zip(self.levels, self.before)):
            if not len(rest):
                break
            at = (mix(keys[rest], level) % np.uint64(64 * len(words))).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            under = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[rest[hit]] = before[at[hit] >> 6] + under[hit]
            rest = rest[~hit]
        return out
