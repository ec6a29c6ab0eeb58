"""Boolean trigram queries that every match of a regular expression must satisfy.

A query is True (says nothing), a trigram (3 bytes, ASCII letters in lower case), or
("and" | "or", parts).
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

#: Alternatives that are followed as exact strings before their trigrams are taken.
LIMIT = 64


def _all(parts) -> object:
    flat = []
    for p in parts:
        if p is True:
            continue
        for q in p[1] if isinstance(p, tuple) and p[0] == "and" else [p]:
            if q not in flat:
                flat.append(q)
    return True if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def _any(parts) -> object:
    flat = []
    for p in parts:
        if p is True:
            return True
        for q in p[1] if isinstance(p, tuple) and p[0] == "or" else [p]:
            if q not in flat:
                flat.append(q)
    return flat[0] if len(flat) == 1 else ("or", flat)


def _grams(text: bytes) -> object:
    return _all(text[i : i + 3] for i in range(len(text) - 2))


def _fold(codes) -> set[bytes]:
    return {chr(c).encode().lower() for c in codes}


def _strings(op, arg) -> set[bytes] | None:
    """The folded strings one element can match, if they are few."""
    if op is C.LITERAL:
        return _fold([arg])
    if op is C.IN:
        codes: set[int] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                codes.add(x)
            elif kind is C.RANGE and x[1] - x[0] < 8:
                codes.update(range(x[0], x[1] + 1))
            else:
                return None
        return s if len(s := _fold(codes)) <= 8 else None
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {b""}
    if op is C.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is C.BRANCH:
        parts = [_sequence_strings(p) for p in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 4 and arg[1] is not C.MAXREPEAT:
        one = _sequence_strings(arg[2])
        if one is None:
            return None
        out: set[bytes] = set()
        level = {b""}
        for k in range(arg[1] + 1):
            if k >= arg[0]:
                out |= level
            level = {a + b for a in level for b in one}
            if len(level) + len(out) > LIMIT:
                return None
        return out
    return None


def _sequence_strings(items) -> set[bytes] | None:
    out = {b""}
    for op, arg in items:
        own = _strings(op, arg)
        if own is None or len(out) * len(own) > LIMIT:
            return None
        out = {a + b for a in out for b in own}
    return out


def _sequence(items) -> object:
    """Neighbouring elements with few strings are joined before taking trigrams."""
    parts: list[object] = []
    held = {b""}

    def flush():
        nonlocal held
        parts.append(_any(_grams(s) for s in held))
        held = {b""}

    for op, arg in items:
        own = _strings(op, arg)
        if own is not None:
            if len(held) * len(own) > LIMIT:
                flush()
            held = {a + b for a in held for b in own}
            continue
        flush()
        if op is C.SUBPATTERN:
            parts.append(_sequence(arg[3]))
        elif op is C.BRANCH:
            parts.append(_any(_sequence(p) for p in arg[1]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            parts.append(_sequence(arg[2]))
    flush()
    return _all(parts)


def trigram_query(pattern: str) -> object:
    """The query of a pattern; True if the pattern has no mandatory trigram."""
    return _sequence(_parser.parse(pattern))


def trigrams(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern)
