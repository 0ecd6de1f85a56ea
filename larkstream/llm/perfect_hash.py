"""Minimal perfect hashing of 64-bit keys in numpy: n keys to the slots 0 to n - 1, in some three bits a key.

Level by level, keys are dealt over a bit array of twice their number; keys alone at their place set its bit
and are done, the others go on to the next level. A key's slot is the rank of its bit, from the ranks of 64-bit words and
the bits before it in its word, so a table takes little more memory than its keys. It keeps them in the order of their
slots, so `find` tells keys from strangers exactly.
"""

from __future__ import annotations

import numpy as np

_STEP = 0x9E3779B97F4A7C15


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Well spread 64 bits of each key (the finaliser of splitmix64)."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * _STEP & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    def __init__(self, levels: list[np.ndarray], keys: np.ndarray):
        """levels: bits in 64-bit words, lowest first; keys: in the order of their slots."""
        self.levels, self.keys = levels, keys
        counts = [np.bitwise_count(words) for words in levels]
        starts = np.cumsum([0, *[int(c.sum()) for c in counts]])
        self.ranks = [np.cumsum(c, dtype=np.int64) - c + before for c, before in zip(counts, starts[:-1], strict=True)]

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct int64."""
        levels, slots, left = [], [], np.asarray(keys, np.int64)
        while len(left):
            n = -(-2 * len(left) // 64) * 64
            at = (mixed(left, len(levels)) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(at, minlength=n) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            mine = alone[at]
            slots.append(left[mine][np.argsort(at[mine])])
            left = left[~mine]
        return cls(levels, np.concatenate(slots) if slots else np.zeros(0, np.int64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those that are none of the table's."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_):
                break
            at = mixed(keys[open_], level) % np.uint64(64 * len(words))
            of, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            held = words[of]
            hit = held & bit != 0
            out[open_[hit]] = ranks[of[hit]] + np.bitwise_count(held[hit] & (bit[hit] - np.uint64(1)))
            open_ = open_[~hit]
        found = np.flatnonzero(out >= 0)
        wrong = found[self.keys[out[found]] != keys[found]]  # the stored key decides
        out[wrong] = -1
        return out

    def packed(self) -> tuple[list[bytes], bytes]:
        return [b.tobytes() for b in self.levels], self.keys.astype("<i8").tobytes()

    @classmethod
    def unpacked(cls, levels: list[bytes], keys: bytes) -> PerfectHash:
        return cls([np.frombuffer(b, "<u8") for b in levels], np.frombuffer(keys, "<i8"))
