"""A bounded cache from text chunks to something computed from them."""

from __future__ import annotations

from collections.abc import Callable


class ChunkCache(dict):
    """Two generations of at most `limit` entries each.

    Frequent chunks are promoted from the old generation, rare ones age out.  A miss is
    computed again, so the bound changes time and never results.
    """

    def __init__(self, compute: Callable[[str], object], limit: int = 350_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, chunk: str):
        value = self.old.get(chunk)
        if value is None:
            value = self.compute(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[chunk] = value
        return value
