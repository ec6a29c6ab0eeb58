"""Secret scans by a trigram inverted index over each shard of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_by_worker, keyed_text, slices
from .trigram_query import trigram_query, trigrams


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` whose `group` has `least` characters or more.
    The secret's span is that of group `span`, the whole match by default."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    span: int = 0


#: What parts the lines of a key: white space, also escaped, and marks of quotes and comments.
_BETWEEN = r"""(?:\s|\\[nrt]|["'+,;>#*|])"""
#: After the BEGIN line of a private key: all up to its END line; where the next BEGIN or
#: another END comes first, or none at all, the header fields and base64 lines.
_KEY_BODY = (
    r"(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_BETWEEN}*+[A-Z][A-Za-z0-9-]*+:\x20[^\r\n\\]*+)*+(?:{_BETWEEN}*+[A-Za-z0-9+/]{{16,}}+={{0,2}})++"
    rf"""(?:{_BETWEEN}++[A-Za-z0-9+/]{{1,15}}+(?:={{1,2}}|(?=[\x20\t]*(?:[\r\n"'\\<`]|-----|\Z))))?)?"""
)

#: Spans of one start are listed in the order of these rules.  The first three are the base.
RULES = (
    Rule("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----" + _KEY_BODY),
    Rule("temporary_access", r"ASIA[A-Z0-9]+", 0, 20),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("payment_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    # From a run's start to its first eyJ: if that one fails, so do the later ones of the run.
    Rule("web_token", r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)", span=1),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
    Rule("bearer", r"(?ai:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*"),
)
BASE = ("assign", "access", "hex")
#: A run rule, whose match is a whole run of one class, can skip short runs while searching.
_RUN = re.compile(r"\[[^\]]+\]\+")


class Scanner:
    """The trigram queries of some rules, and the search of a shard."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.grams = sorted(set().union(*map(trigrams, self.queries)))
        # A match of a bare class run is a whole run, so short ones need not be visited.
        self.patterns = [re.compile(r.pattern[:-1] + f"{{{r.least},}}" if _RUN.fullmatch(r.pattern) and not r.group else r.pattern) for r in rules]
        # 1 + the place of each trigram that some rule asks for, by its 24 bits.
        self.place = np.zeros(1 << 24, np.uint16)
        for k, g in enumerate(self.grams):
            self.place[int.from_bytes(g, "big")] = k + 1

    def postings(self, texts: list[str]) -> list[np.ndarray]:
        """For each trigram of the queries the documents that hold it, in order."""
        raw = [t.encode() for t in texts]
        joined = np.frombuffer(b"\0".join([*raw, b"\0\0"]).lower(), np.uint8)
        starts = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1]
        code = joined[:-2].astype(np.uint32)
        code <<= 8
        code |= joined[1:-1]
        code <<= 8
        code |= joined[2:]
        place = self.place[code]
        at = np.flatnonzero(place)
        doc = np.searchsorted(starts, at, side="right") - 1
        pairs = np.unique(place[at].astype(np.int64) << 32 | doc)
        cuts = np.searchsorted(pairs >> 32, np.arange(1, len(self.grams) + 2))
        return [pairs[a:b] & 0xFFFFFFFF for a, b in zip(cuts, cuts[1:])]

    def candidates(self, query: object, postings: list[np.ndarray], count: int) -> np.ndarray:
        if query is True:
            return np.arange(count)
        if isinstance(query, bytes):
            return postings[int(self.place[int.from_bytes(query, "big")]) - 1]
        parts = sorted((self.candidates(q, postings, count) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Per document the spans (start, end, kind), by start and then by rule."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.postings(texts)
        for k, (rule, query, pattern) in enumerate(zip(self.rules, self.queries, self.patterns)):
            for d in self.candidates(query, postings, len(texts)).tolist():
                for m in pattern.finditer(texts[d]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[d].append((m.start(rule.span), k, m.end(rule.span)))
        return [[(a, b, self.rules[k].kind) for a, k, b in sorted(f)] for f in found]


@kept_by_worker(2)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def secret_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
    redact_as: str | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Find secrets; returns the id column, `spans`, an array of (kind, start, end) in code
    points of the text, end exclusive, and `carried`, a struct of the columns named in
    `carry`, if any.

    Each rule's regular expression is turned into a Boolean query over trigrams that any
    match holds.  A shard of documents gets an inverted index from those trigrams to its
    documents; postings are intersected and united as the query says, and only candidates
    are verified by the expression itself.  A rule without mandatory trigrams (a bare run of
    characters) scans every document.  Matches are leftmost and non-overlapping within a
    rule; those with too short a group are dropped after matching.

    With `redact_as` the result also has `redacted`, the text with each span, overlapping
    ones merged, replaced.

    Null texts have no spans, and `redacted` stays null for them.  Repeated rows and null
    ids give a row each; texts of any length are scanned whole; an empty table gives an empty
    result; other columns are ignored.  One pass, no shuffle.
    """
    source = keyed_text(docs, id_col, text_col, *([F.struct(*carry).alias("carried")] if carry else []))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kept = source.schema.fields[2:]
    fields = [source.schema[0], *kept, T.StructField("spans", T.ArrayType(span))]
    if redact_as is not None:
        fields.append(T.StructField("redacted", T.StringType()))
    arrow_span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(rules)
        for batch in slices(batches):
            given = batch.column(1).to_pylist()
            found = own.scan([t or "" for t in given])
            out = [batch.column(0), *(batch.column(2 + k) for k in range(len(kept)))]
            out.append(pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in f] for f in found], pa.list_(arrow_span)))
            if redact_as is not None:
                out.append(pa.array([redacted(t, f, redact_as) for t, f in zip(given, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return source.mapInArrow(scan, T.StructType(fields))


def redacted(text: str | None, spans: list[tuple[int, int, str]], mark: str) -> str | None:
    """The text with each maximal union of overlapping spans replaced by the mark."""
    if text is None or not spans:
        return text
    out, at, end = [], 0, -1
    for a, b, _ in sorted(spans):
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            out.append(mark)
            at = end
        out.append(text[at:a])
        end = b
    return "".join([*out, mark, text[end:]])
