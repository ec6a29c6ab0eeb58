"""Byte-pair merging over a public SentencePiece vocabulary.

The vocabulary file is only read: nothing here trains a tokenizer.  The merge rule is
that of SentencePiece BPE: symbols start as single characters, and of all adjacent pairs
whose concatenation is a vocabulary piece the best-ranked one is merged first, the
leftmost on a tie, until no pair is left.  Characters outside the vocabulary fall back to
one byte piece per UTF-8 byte.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

SPACE = "▁"

#: Latin letters, as a character class: Basic Latin, Latin-1, Latin Extended-A and -B.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"

#: Piece kinds of the model file's `type` field.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = buf[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def _fields(buf: bytes):
    """(field number, wire type, value) of one protobuf message."""
    at = 0
    while at < len(buf):
        key, at = _varint(buf, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(buf, at)
        elif kind == 1:
            value, at = buf[at : at + 8], at + 8
        elif kind == 5:
            value, at = buf[at : at + 4], at + 4
        else:
            size, at = _varint(buf, at)
            value, at = buf[at : at + size], at + size
        yield key >> 3, kind, value


class PieceVocabulary:
    """Pieces, merge ranks and normaliser settings of one SentencePiece BPE model."""

    def __init__(self, path: str):
        import struct

        pieces: list[tuple[str, float, int]] = []
        self.charsmap = b""
        self.add_dummy_prefix = self.remove_extra_whitespaces = self.escape_whitespaces = True
        self.byte_fallback = False
        model_type = 1
        with open(path, "rb") as f:
            model = f.read()
        for number, _, value in _fields(model):
            if number == 1:
                text, score, kind = "", 0.0, NORMAL
                for n, _, v in _fields(value):
                    if n == 1:
                        text = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                pieces.append((text, score, kind))
            elif number == 2:
                for n, _, v in _fields(value):
                    if n == 3:
                        model_type = v
                    elif n == 35:
                        self.byte_fallback = bool(v)
            elif number == 3:
                for n, _, v in _fields(value):
                    if n == 2:
                        self.charsmap = v
                    elif n == 3:
                        self.add_dummy_prefix = bool(v)
                    elif n == 4:
                        self.remove_extra_whitespaces = bool(v)
                    elif n == 5:
                        self.escape_whitespaces = bool(v)
        if model_type != 2:
            raise ValueError("only BPE models are supported")
        if any(kind == USER_DEFINED for _, _, kind in pieces):
            raise ValueError("user-defined pieces are not supported")
        self.pieces = [p for p, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, UNUSED)}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown_id = self.kinds.index(UNKNOWN)
        # Rank 0 is the best score; equal scores share a rank, so that position decides.
        scores = sorted({s for _, s, k in pieces if k in (NORMAL, UNUSED)}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        self.ranks = {p: place[s] for p, s, k in pieces if k in (NORMAL, UNUSED) and len(p) > 1}
        self.chunks = re.compile(self._chunk_pattern())

    def _chunk_pattern(self) -> str:
        """A pattern whose matches tile any text and that no merge can cross.

        Two neighbouring characters can meet in a piece only if some piece holds them side
        by side.  The pairs of character classes that do meet are read off the vocabulary,
        and a text is cut only between classes that never meet.  Without any such pair the
        whole text is one chunk, which is slower and gives the same pieces.
        """
        latin = re.compile(f"[{LATIN}]")
        kind = lambda c: "s" if c == SPACE else "n" if c == "\n" else "l" if latin.match(c) else "o"
        met = {(kind(a), kind(b)) for p in self.ranks for a, b in zip(p, p[1:])}
        if any((k, "s") in met for k in "lo") or any("n" in pair for pair in met):
            return r"(?s:.+)"
        if ("l", "o") in met or ("o", "l") in met:
            return rf"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+"
        return rf"{SPACE}*[{LATIN}]+|\n|{SPACE}*[^{SPACE}\n{LATIN}]+|{SPACE}+"

    def merge(self, chunk: str) -> list[int]:
        """End positions of the symbols that remain after all merges.

        The symbols form a doubly linked list over character positions (`after[p]` is where
        the symbol starting at p ends and the next begins).  A heap holds rank and position
        of each candidate pair in one integer.  `live[p]` is the present rank of the pair
        that starts at p: the text of that pair only ever grows, so a popped entry is stale
        exactly if its rank differs.
        """
        n = len(chunk)
        if n < 2:
            return [n] if n else []
        get = self.ranks.get
        live = [get(chunk[i : i + 2], -1) for i in range(n - 1)]
        live.append(-1)
        heap = [r << 32 | i for i, r in enumerate(live) if r >= 0]
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        heapify(heap)
        while heap:
            top = heappop(heap)
            at = top & 0xFFFFFFFF
            if live[at] != top >> 32:
                continue
            right = after[at]
            live[right] = -1
            after[at] = end = after[right]
            if end < n:
                before[end] = at
                live[at] = rank = get(chunk[at : after[end]], -1)
                if rank >= 0:
                    heappush(heap, rank << 32 | at)
            else:
                live[at] = -1
            left = before[at]
            if left >= 0:
                live[left] = rank = get(chunk[left:end], -1)
                if rank >= 0:
                    heappush(heap, rank << 32 | left)
        ends = []
        at = 0
        while at < n:
            at = after[at]
            ends.append(at)
        return ends

    def count(self, chunk: str) -> int:
        """Tokens of a chunk, as initial symbols minus merges; no identifiers are formed.

        A character outside the vocabulary takes part in no merge and counts one symbol for
        each UTF-8 byte.
        """
        ends = self.merge(chunk)
        symbols, merges = len(chunk), len(chunk) - len(ends)
        if self.byte_fallback:
            ids = self.ids
            symbols += sum(len(c.encode()) - 1 for c in chunk if c not in ids)
        return symbols - merges

    def encode(self, chunk: str) -> list[tuple[int, int, int]]:
        """(piece id, start, end) of each piece; start and end are character positions in
        the chunk, and the byte pieces of one character all carry that character's span."""
        out = []
        at = 0
        ids = self.ids
        for end in self.merge(chunk):
            piece = chunk[at:end]
            found = ids.get(piece)
            if found is not None:
                out.append((found, at, end))
            elif self.byte_fallback:
                out += [(self.byte_ids[b], at, end) for b in piece.encode()]
            else:
                out.append((self.unknown_id, at, end))
            at = end
        return out
