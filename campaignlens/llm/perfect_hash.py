"""Minimal perfect hashing of integer keys, in NumPy.

Level by level every key left over marks one bit of a table twice as large as the keys;
bits that exactly one key marks are its place, the other keys go on to the next level. The
index of a key is the number of set bits before its own. A key that was not hashed also
finds some index, so the keys are kept in their order to tell.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

ROOM = 2  # bits of a level for each of its keys


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A hash of each key for a level: an odd multiple plus the level's own number, its high bits folded down twice."""
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def build(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The levels, each an array of bits as booleans, and the distinct ``keys`` in the order of their indexes."""
    levels, order, left = [], [], keys
    while len(left):
        size = ROOM * len(left)
        at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
        times = np.bincount(at, minlength=size)
        alone = times[at] == 1
        levels.append(times == 1)
        order.append(left[alone][np.argsort(at[alone])])
        left = left[~alone]
    return levels, np.concatenate(order) if order else keys


@dataclass
class PerfectHash:
    """One or more hashes side by side: a key belongs to the shard ``shard_of`` names for it.

    ``sizes`` and ``starts`` are (shard, level) tables of bits and first bits in ``words``.
    """

    sizes: np.ndarray
    starts: np.ndarray
    words: np.ndarray
    before: np.ndarray  # set bits before each word
    keys: np.ndarray

    @classmethod
    def of(cls, shards: Sequence[tuple[list[np.ndarray], np.ndarray]]) -> PerfectHash:
        depth = max((len(levels) for levels, _ in shards), default=0)
        sizes = np.zeros((len(shards), depth), np.int64)
        for i, (levels, _) in enumerate(shards):
            sizes[i, : len(levels)] = [len(x) for x in levels]
        starts = (np.cumsum(sizes) - sizes.ravel()).reshape(sizes.shape)
        bits = np.concatenate([x for levels, _ in shards for x in levels] or [np.zeros(0, bool)])
        bits = np.concatenate([bits, np.zeros(64 - len(bits) % 64, bool)])
        words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        keys = np.concatenate([k for _, k in shards] or [np.zeros(0, np.int64)])
        return cls(sizes, starts, words, np.cumsum(counts) - counts, keys)

    def find(self, keys: np.ndarray, shards: np.ndarray | None = None) -> np.ndarray:
        """The index of each key, -1 for keys that were not hashed."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level in range(self.sizes.shape[1]):
            shard = np.zeros(len(left), np.int64) if shards is None else shards[left]
            size = self.sizes[shard, level]
            left, shard, size = (x[size > 0] for x in (left, shard, size))
            at = self.starts[shard, level] + (mixed(keys[left], level) % size.astype(np.uint64)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            value = self.words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = value & ((np.uint64(1) << bit) - np.uint64(1))
            index = self.before[word] + np.bitwise_count(below)
            out[left[hit]] = index[hit]
            left = left[~hit]
        known = out >= 0
        out[known] = np.where(self.keys[out[known]] == keys[known], out[known], -1)
        return out
