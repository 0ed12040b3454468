"""A bounded table of what a worker knows: from a piece of text to its ids, looked up for whole arrays at once.

A piece is told by its first eight bytes and a 64-bit hash of all of it. It may lie in two slots; a
taken slot is kept, as frequent pieces come first. A table that fills up is emptied.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from corpusflow.llm import arrays

BITS = 19  # 12 MB of slots


class IdCache:
    def __init__(self, bits: int = BITS) -> None:
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        slots = 1 << self.bits
        self.head, self.full = np.ones(slots, np.uint64), np.zeros(slots, np.uint64)
        self.at, self.n = np.zeros(slots, np.int32), np.full(slots, -1, np.int32)
        self.pool, self.used, self.taken = np.zeros(1 << 18, np.int32), 0, 0

    def find(self, head: np.ndarray, full: np.ndarray, learn: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(place in pool, number of ids) of each piece. learn gets indices of new pieces and returns their sizes and ids."""
        if self.taken > 3 << self.bits - 2 or self.used > 16 << self.bits:
            self.clear()
        shift, mask = np.uint64(64 - self.bits), np.uint64((1 << self.bits) - 1)
        slot = (full >> shift).astype(np.int64)
        other = (full & mask).astype(np.int64)
        miss = np.flatnonzero((self.full[slot] != full) | (self.head[slot] != head))
        second = other[miss]
        hit = (self.full[second] == full[miss]) & (self.head[second] == head[miss])
        slot[miss[hit]] = second[hit]
        miss = miss[~hit]
        at, n = self.at[slot], self.n[slot]
        if len(miss):
            value, first, back = np.unique(full[miss], return_index=True, return_inverse=True)
            new = miss[first]
            sizes, ids = learn(new)
            sizes = np.asarray(sizes, np.int64)
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.int32)])
            self.pool[self.used : self.used + len(ids)] = ids
            place = self.used + np.cumsum(sizes) - sizes
            self.used += len(ids)
            for where in (slot[new], other[new]):
                free = np.flatnonzero(self.n[where] < 0)
                s = where[free]
                self.full[s], self.head[s], self.at[s], self.n[s] = value[free], head[new[free]], place[free], sizes[free]
                self.taken += len(s)
            at[miss], n[miss] = place[back], sizes[back]
        return at, n

    def gather(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """All pieces' ids, one after the other."""
        return self.pool[arrays.spread(at.astype(np.int64), n.astype(np.int64))]
