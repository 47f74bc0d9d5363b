"""FM-index over a sequence of word numbers: suffix order, BWT, wavelet matrix, sampled positions.

All queries take arrays, so that thousands of phrases go through each rank at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffix order of ``x`` (its end sorts before all), by prefix doubling."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        # Rank of the suffix ``step`` further on, 0 behind the end.
        after = np.r_[rank[step:], np.zeros(min(step, n), np.int64)]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.cumsum(np.r_[1, key[1:] != key[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n:
            return order
        step *= 2


class WaveletMatrix:
    """Rank of any value in a sequence, by one bit vector for each bit of the values (Claude and Navarro, 2012)."""

    def __init__(self, x: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (x >> b) & 1
            zeros = np.r_[0, np.cumsum(bit == 0)].astype(np.int32)
            self.levels.append((b, zeros, int(zeros[-1])))
            x = np.r_[x[bit == 0], x[bit == 1]]

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` values equal ``value``."""
        start = np.zeros_like(at)
        for b, zeros, total in self.levels:
            one = ((value >> b) & 1).astype(bool)
            z_at, z_start = zeros[at], zeros[start]
            at = np.where(one, total + at - z_at, z_at)
            start = np.where(one, total + start - z_start, z_start)
        return at - start

    def get(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros_like(at)
        for _, zeros, total in self.levels:
            one = zeros[at + 1] == zeros[at]
            value = (value << 1) | one
            at = np.where(one, total + at - zeros[at], zeros[at])
        return value


class FMIndex:
    def __init__(self, x: np.ndarray, sample: int = 8):
        """``x``: numbers from 1 on; 0 is the end of the sequence."""
        x = np.r_[x.astype(np.int64), 0]
        self.n = len(x)
        order = suffix_array(x)
        kinds = int(x.max()) + 1
        self.before = np.r_[0, np.cumsum(np.bincount(x, minlength=kinds))]
        self.bwt = WaveletMatrix(x[order - 1], max(1, (kinds - 1).bit_length()))
        marked = order % sample == 0
        self.marked = np.r_[0, np.cumsum(marked)]
        self.sampled = order[marked]
        self.kinds = kinds

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with each row of ``phrases`` (all of one length), from the last word back."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        known = (phrases < self.kinds).all(1)
        hi[~known] = 0
        for c in np.where(known[:, None], phrases, 0).T[::-1]:
            live = hi > lo
            if not live.any():
                break
            c, a, b = c[live], lo[live], hi[live]
            lo[live] = self.before[c] + self.bwt.rank(c, a)
            hi[live] = self.before[c] + self.bwt.rank(c, b)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in ``rows``: back to a sampled one, counting the steps."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            hit = self.marked[at + 1] > self.marked[at]
            out[open_[hit]] = self.sampled[self.marked[at[hit]]] + steps[open_[hit]]
            open_, at = open_[~hit], at[~hit]
            c = self.bwt.get(at)
            rows[open_] = self.before[c] + self.bwt.rank(c, at)
            steps[open_] += 1
        return out
