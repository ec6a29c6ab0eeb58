"""An FM-index over a sequence of runs of symbols, searched in batches with numpy.

The sequence holds symbols 1..sigma; 0 ends each run.  Matches never cross a run's end.
"""

from __future__ import annotations

import numpy as np


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Positions of `seq` by suffix up to the run's end, equal ones by position.

    Prefix doubling: ranks by the first h symbols give ranks by the first 2h.  A suffix that
    has reached its run's end is not compared further, so runs may be of any length and the
    number of rounds follows the longest repeated one.
    """
    n = len(seq)
    if n == 0:
        return np.zeros(0, np.int64)
    stops = np.flatnonzero(seq == 0)
    left = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)  # symbols to the run's end
    rank = seq.astype(np.int64)
    h = 1
    while True:
        second = np.zeros(n, np.int64)  # 0: the run has ended; no suffix with symbols ranks 0
        inside = np.flatnonzero(left > h)
        second[inside] = rank[inside + h]
        key = rank * (max(n, int(rank.max())) + 1) + second
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        h *= 2
        going = left > h
        if not going.any() or np.bincount(rank)[rank[going]].max() == 1:
            return order


class WaveletMatrix:
    """rank(c, i): how often symbol c occurs before position i, for arrays of c and i."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max()).bit_length()) if len(symbols) else 1
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = symbols.astype(np.int64)
        for k in range(self.bits - 1, -1, -1):
            bit = (level >> k & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(level) - self.ones[-1][-1]))
            level = np.concatenate([level[~bit], level[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        first = np.zeros(len(at), np.int64)
        last = at.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = symbol >> (self.bits - 1 - k) & 1
            a, b = ones[first], ones[last]
            first = np.where(bit, zeros + a, first - a)
            last = np.where(bit, zeros + b, last - b)
        return last - first

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        at = at.astype(np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[at + 1] - ones[at]
            out = out << 1 | bit
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Backward search and location of phrases in one sequence of runs."""

    def __init__(self, seq: np.ndarray, sample: int = 8):
        n = len(seq)
        order = suffix_order(seq)
        self.size = n
        before = seq[order - 1]  # the first position is preceded by the last, a 0
        self.tree = WaveletMatrix(before)
        self.first = np.zeros(int(seq.max(initial=0)) + 2, np.int64)
        np.cumsum(np.bincount(seq, minlength=len(self.first) - 1), out=self.first[1:])
        # The walk back can't pass a run's start, so those are sampled as well.
        self.marked = (order % sample == 0) | (before == 0)
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.samples = order[self.marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-order intervals [low, high) of phrases, which are rows of symbols of which
        the first `lengths` count.  Symbols unknown to the sequence give an empty interval."""
        rows = np.arange(len(phrases))
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        for step in range(int(lengths.max(initial=0))):
            rows = rows[(lengths[rows] > step) & (high[rows] > low[rows])]
            if not len(rows):
                break
            c = phrases[rows, lengths[rows] - 1 - step].astype(np.int64)
            seen = c < len(self.first) - 1
            high[rows[~seen]] = low[rows[~seen]]
            rows, c = rows[seen], c[seen]
            low[rows] = self.first[c] + self.tree.rank(c, low[rows])
            high[rows] = self.first[c] + self.tree.rank(c, high[rows])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Sequence positions of suffix-order rows, walking back to the nearest sample."""
        rows = rows.astype(np.int64)
        out = np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        steps = 0
        while len(todo):
            at = rows[todo]
            found = self.marked[at]
            done = todo[found]
            out[done] = self.samples[self.mark_rank[at[found]]] + steps
            todo, at = todo[~found], at[~found]
            c = self.tree.access(at)
            rows[todo] = self.first[c] + self.tree.rank(c, at)
            steps += 1
        return out
