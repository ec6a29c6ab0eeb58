"""Choosing text positions by content, so that equal strings hold equal choices."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        out[done : done + take] = out[:take] * step
        done += take
    return out


class Rolling:
    """Polynomial hashes of any substrings of one byte array."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=self.sums[1:])
        self.inverse = _powers(_INVERSE, n + 1)

    def all(self, size: int) -> np.ndarray:
        """Hashes of every substring of `size` bytes, by start."""
        out = self.sums[size:] - self.sums[: len(self.sums) - size]
        out *= self.inverse[: len(out)]
        return out

    def at(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        return (self.sums[starts + sizes] - self.sums[starts]) * self.inverse[starts]


def scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of `size` values, by the minima before and after block borders."""
    n = len(values)
    blocks = -(-n // size)
    padded = np.full(blocks * size, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    table = padded.reshape(blocks, size)
    before = np.minimum.accumulate(table, axis=1).reshape(-1)
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[: n - size + 1], before[size - 1 : n])


def window_anchors(rolling: Rolling, lengths: np.ndarray, window: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor) of runs of window starts that share an anchor.

    The bytes are those of documents of the given lengths, one after the other (at most
    2^24 bytes).  A window's anchor is the start of the least of its `lead`-byte substrings
    under a hash, the leftmost on a tie; so equal windows have their anchors at equal
    places.  Windows that would cross documents are left out.
    """
    total = int(lengths.sum())
    empty = np.zeros(0, np.int64)
    if total < window:
        return empty, empty, empty
    marks = scrambled(rolling.all(lead))
    marks &= ~_POSITION
    marks |= np.arange(len(marks), dtype=np.uint64)
    anchors = (_sliding_min(marks, window - lead + 1) & _POSITION).astype(np.int64)
    ends = np.cumsum(lengths)
    windows = np.maximum(lengths - window + 1, 0)
    inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = np.repeat(ends - lengths, windows) + inner
    if not len(starts):
        return empty, empty, empty
    owner = anchors[starts]
    cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1) | (inner[1:] == 0)]))
    last = np.append(cut[1:], len(starts)) - 1
    return starts[cut], starts[last], owner[cut]
