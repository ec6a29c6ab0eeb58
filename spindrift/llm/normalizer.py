"""Offset-preserving text normalisation by a model's compiled character map."""

from __future__ import annotations

import struct

from .bpe import SPACE, PieceVocabulary


class Normalizer:
    """Longest-prefix replacement through the compiled character map, then white space.

    The map is a double-array trie over UTF-8 prefixes followed by the replacement strings,
    each ended by a zero byte.  At each position the longest prefix in the trie is replaced;
    without one, the next character is copied.  Every normalised character remembers the
    original bytes that it came from.  A model without a map copies the text.
    """

    def __init__(self, vocabulary: PieceVocabulary):
        self.prefix = vocabulary.add_dummy_prefix
        self.squeeze = vocabulary.remove_extra_whitespaces
        self.escape = vocabulary.escape_whitespaces
        self.plain = not vocabulary.charsmap and not self.squeeze
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if vocabulary.charsmap:
            (size,) = struct.unpack_from("<I", vocabulary.charsmap)
            self.units = struct.unpack_from(f"<{size // 4}I", vocabulary.charsmap, 4)
            self.strings = vocabulary.charsmap[4 + size :]

    def _longest(self, data: bytes, at: int) -> tuple[int, int]:
        """(bytes of the longest mapped prefix of data[at:], offset of its replacement)."""
        units = self.units
        if not units:
            return 0, 0
        found = (0, 0)
        node = self._base(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._base(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return found

    @staticmethod
    def _base(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)

    def aligned(self, text: str) -> tuple[str, list[int], list[int]]:
        """(normalised text, start byte, end byte of the source of each of its characters)."""
        data = text.encode()
        chars: list[str] = []
        starts: list[int] = []
        ends: list[int] = []
        at = 0
        while at < len(data):
            size, offset = self._longest(data, at)
            if size:
                new = self.strings[offset : self.strings.index(b"\0", offset)].decode()
            else:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = data[at : at + size].decode()
            for c in new:
                if self.squeeze and c == " " and (not chars or chars[-1] == " "):
                    continue
                chars.append(c)
                starts.append(at)
                ends.append(at + size)
            at += size
        if self.squeeze:
            while chars and chars[-1] == " ":
                chars.pop(), starts.pop(), ends.pop()
        if chars and self.prefix:
            chars.insert(0, " ")
            starts.insert(0, starts[0])
            ends.insert(0, starts[0])
        out = "".join(chars)
        return out.replace(" ", SPACE) if self.escape else out, starts, ends

    def text(self, text: str) -> str:
        """The normalised text alone."""
        if not self.plain:
            return self.aligned(text)[0]
        if not text:
            return ""
        if self.prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text
