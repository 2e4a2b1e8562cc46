"""Texts as arrays of letters, and tables keyed by hashes of letter sequences."""

from __future__ import annotations

import numpy as np

_TABLE: list[np.ndarray] = []


def letters(text: str | None) -> np.ndarray:
    """The lower-cased letters' code points plus one; 1 for each stretch of other characters, and at both ends."""
    if not _TABLE:
        known = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        _TABLE.append(np.where(known, np.arange(1, 0x110001), 1).astype(np.uint32))
    raw = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    s = _TABLE[0][raw]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 1) | (s[:-1] != 1)
    return s[keep]


#: Odd multipliers of the symbols of a sequence, from its last.
FACTORS = np.random.default_rng(2).integers(1, 2**64, 8, np.uint64) | np.uint64(1)


class HashTable:
    """Numbers by 64-bit keys; looked up for whole arrays at a time (open addressing, at most a quarter full)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        n = 1 << self.bits
        self.keys, self.values, used = np.zeros(n, np.uint64), np.zeros(n, np.float32), np.zeros(n, bool)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = left[~used[slot[left]]]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            used[slot[won]], self.keys[slot[won]], self.values[slot[won]] = True, keys[won], values[won]
            left = np.setdiff1d(left, won)
            slot[left] = (slot[left] + 1) & (n - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray, missing: float = np.nan) -> np.ndarray:
        """Key 0 is never found."""
        out, at, slot = np.full(len(keys), missing, np.float32), None, self._slot(keys)
        for _ in range(self.probes):
            own = self.keys[slot]
            hit = own == (keys if at is None else keys[at])
            place = np.flatnonzero(hit)
            out[place if at is None else at[place]] = self.values[slot[place]]
            more = np.flatnonzero(~hit & (own != 0))
            if not len(more):
                break
            at = more if at is None else at[more]
            slot = (slot[more] + 1) & (len(self.keys) - 1)
        return out
