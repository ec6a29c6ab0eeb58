"""The perfect binary Golay code (23, 12, 7), for arrays of words."""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, DATA, RADIUS = 23, 12, 3
CHECK = LENGTH - DATA


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


def _xor_table(first: int, bits: int) -> np.ndarray:
    """Remainders of all words whose set bits lie in [first, first + bits)."""
    out = np.zeros(1, np.uint32)
    for k in range(bits):
        out = np.concatenate([out, out ^ np.uint32(_remainder(1 << (first + k)))])
    return out


_LOW, _HIGH = _xor_table(0, DATA), _xor_table(DATA, CHECK)
#: The error of at most RADIUS bits for each remainder; the code is perfect, so each has one.
_ERROR = np.zeros(1 << CHECK, np.uint32)
for _n in range(RADIUS + 1):
    for _bits in combinations(range(LENGTH), _n):
        _e = sum(1 << b for b in _bits)
        _ERROR[_remainder(_e)] = _e


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the one codeword within three bits of each 23-bit word."""
    words = words.astype(np.uint32)
    return (words ^ _ERROR[_LOW[words & 0xFFF] ^ _HIGH[words >> DATA]]) >> CHECK


def nearby(words: np.ndarray, width: int) -> np.ndarray:
    """For each word the indices that it and its one-bit neighbours (in the low `width`
    bits) decode to, one column each, with repeats."""
    flips = np.array([0, *(1 << k for k in range(width))], np.uint32)
    return decode(words.astype(np.uint32)[:, None] ^ flips[None, :])
