"""Suffix arrays by prefix doubling in numpy, with longest common prefixes read from its levels."""

from __future__ import annotations

import numpy as np


class SuffixArray:
    """Suffix array of ``keys``; a key stands for ``unit`` symbols that start at its position.

    ``order`` holds suffix positions in sorted order. ``levels[k]`` ranks every position by its first
    ``unit * 2**k`` symbols: two positions have equal ranks there exactly if those symbols are equal.
    Callers end each text with a separator, so that no match crosses texts: one that occurs once, or
    ``alone`` marks all keys that reach a separator, and equal ones of them are ordered by position.
    """

    def __init__(self, keys: np.ndarray, unit: int = 1, alone: np.ndarray | None = None):
        n = len(keys)
        self.unit, self.n = unit, n
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        first = np.ones(n, bool)
        first[1:] = ordered[1:] != ordered[:-1]
        if alone is not None:
            first |= alone[order]
        starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank = np.empty(n + 1, np.int64)
        rank[n] = -1
        rank[order] = starts
        self.levels = [rank.astype(np.int32)]
        step = unit
        while True:
            alone = first & np.append(first[1:], True)
            slots = np.flatnonzero(~alone)
            if not len(slots):
                break
            at = order[slots]
            pair = (rank[at] << 32) | (rank[np.minimum(at + step, n)] + 1)
            o = np.argsort(pair, kind="stable")
            at, pair = at[o], pair[o]
            order[slots] = at
            new = np.ones(len(slots), bool)
            new[1:] = pair[1:] != pair[:-1]
            first[slots] = new
            rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
            self.levels.append(rank.astype(np.int32))
            step *= 2
            if step > 2 * n + unit:
                break
        self.order = order

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length, in whole units, of the longest common prefix of the suffixes at ``a`` and ``b``."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            x, y = np.minimum(a + length, self.n), np.minimum(b + length, self.n)
            same = (level[x] == level[y]) & (x < self.n) & (y < self.n)
            length += np.where(same, self.unit << k, 0)
        return length
