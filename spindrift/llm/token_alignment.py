"""Alignment of two tokenizers by the bytes that their tokens cover."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import BYTE, SPACE, PieceVocabulary
from .common import kept_by_worker, keyed_text, slices, stored, texts_of
from .hot_join import join_by_weight
from .normalizer import Normalizer
from .packing import encode_text
from .piece_cache import ChunkCache

#: Id pairs with over 1 / 2**18 of all links are broadcast; by counting there are fewer.
PAIR_PARTS = 1 << 18
# Fixed value: how byte-level vocabularies of this family cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies show printable bytes as themselves and the others as the
    characters from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers, and the bytes of their tokens; kept by each Python worker."""

    def __init__(self, byte_path: str, piece_path: str):
        with open(byte_path, encoding="utf-8") as f:
            model = json.load(f)
        byte_of = _byte_of_char()
        own = {i: bytes(byte_of[c] for c in s) for s, i in model["model"]["vocab"].items() if all(c in byte_of for c in s)}
        added = {t["id"]: t["content"].encode() for t in model["added_tokens"]}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        ids = [model["model"]["vocab"][x + y] for x, y in merges]
        if ids != sorted(ids):
            raise ValueError("merges have to be in the order of their ids")
        # Merging by rank needs no merge list, as a merge's rank is its id; added tokens are plain text.
        self.a = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks={b: i for i, b in own.items() if i not in added}, special_tokens={})
        self.a_bytes = [b""] * (max(*own, *added) + 1)
        for i, b in (own | added).items():
            self.a_bytes[i] = b
        v = PieceVocabulary(piece_path)
        self.normalizer, self.chunks = Normalizer(v), v.chunks
        self.cache = ChunkCache(lambda chunk: np.array([i for i, _, _ in v.encode(chunk)], np.int32).tobytes())
        self.b_bytes = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(v.pieces, v.kinds)]
        self.a_width = np.array([len(x) for x in self.a_bytes])
        self.b_width = np.array([len(x) for x in self.b_bytes])
        self.n_b = len(self.b_bytes)
        if len(self.a_bytes) * self.n_b >= 1 << 32:
            raise ValueError("a pair of ids has to fit 32 bits")
        # What a token adds to the text of its groups: its id and what separates it from the next.
        self.shown = [f"{i}{s}" for i in range(len(self.a_bytes)) for s in (",", "|")] + [f"{i}{s}" for i in range(self.n_b) for s in (",", ";", "")]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text under both; none where their bytes are not space + text."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        a = encode_text(self.a, f" {text}", PATTERN)
        b = np.frombuffer(b"".join(map(self.cache.__getitem__, self.chunks.findall(self.normalizer.text(text)))), np.int32)
        whole = b" " + text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole:
            return none, none
        return np.array(a, np.int64), b

    def align(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        """Counts, groups and distinct id pairs of each text, for all texts at once.

        The texts stand one after the other on one axis of bytes.  Ends of A and B tokens
        are counted on it once; where both end a group ends, and between two neighbouring
        ends of either lies just one link.  Sums before each byte, taken at the documents'
        bounds, give the figures of each.
        """
        lists = [self.encode(t) for t in texts]
        n_a, n_b = (np.array([len(x[k]) for x in lists], np.int64) for k in (0, 1))
        a, b = (np.concatenate([x[k] for x in lists]).astype(np.int64) for k in (0, 1))
        a_end, b_end = np.cumsum(self.a_width[a]), np.cumsum(self.b_width[b])
        size = int(a_end[-1]) if len(a) else 0
        ends_a, ends_b = np.bincount(a_end, minlength=size + 1), np.bincount(b_end, minlength=size + 1)
        both = ends_a & ends_b
        groups, a_before, b_before = np.cumsum(both), np.cumsum(ends_a), np.cumsum(ends_b)
        doc_end = np.concatenate([[0], a_end])[np.cumsum(n_a)]
        doc_start = np.concatenate([[0], doc_end[:-1]])

        # Tokens in the order of groups, A before B: each comes after its own kind and after
        # those of the other kind that stand in groups before it.
        a_group, b_group = groups[a_end - 1], groups[b_end - 1]
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = 2 * a + both[a_end]
        last = np.zeros(size + 1, bool)
        last[doc_end] = True
        order[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = 2 * len(self.a_bytes) + 3 * b + both[b_end] + last[b_end]
        shown = list(map(self.shown.__getitem__, order.tolist()))
        bounds = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()

        at = np.flatnonzero(ends_a | ends_b)
        at = at[at > 0]
        pairs = a[a_before[at] - ends_a[at]] * self.n_b + b[b_before[at] - ends_b[at]]
        doc = np.searchsorted(doc_end, at)
        keys, times = np.unique(doc << 32 | pairs, return_counts=True)
        return {
            "n_a": n_a,
            "n_b": n_b,
            "n_groups": groups[doc_end] - groups[doc_start],
            "n_links": np.bincount(doc, minlength=len(texts)),
            "groups": ["".join(shown[s:e]) for s, e in zip(bounds, bounds[1:])],
            "pairs": keys & 0xFFFFFFFF,
            "times": times,
            "of": np.searchsorted(keys >> 32, np.arange(len(texts) + 1)),
        }


@kept_by_worker(1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def align_tokens(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """How a byte-level tokenizer (A, on space + text) and a piece tokenizer (B) cut each text.

    Returns the id, n_a and n_b tokens, n_groups (pieces of the text between byte offsets
    where tokens of both end), n_links (pairs of an A and a B token that share bytes), n_best
    and count_sum, and `groups` as text, `a1,a2|b1;a3|b2,b3`; with `digest`, as the text's
    SHA-256 in hex, empty without tokens, as the text is longer than the document.  The count of an id pair is the
    number of its links in all of `docs`; count_sum adds it up over a row's links, n_best
    counts the links whose count is the highest of their B id.

    One pass cuts and links whole Arrow batches and writes each row's distinct pairs.
    Pairs are summed with partial aggregates; a B id's highest counts are as many as B ids.
    Then rows meet the counts: pairs with more than a fixed share of all links are fewer than
    its inverse and are broadcast, only the others are joined by a shuffle, which none can
    unbalance.

    Null and empty texts, and those whose tokens don't spell space + text, have no tokens:
    zeros and empty groups.  Repeated rows and null ids give a row each; texts of any length
    are read whole; an empty table gives an empty one; other columns are ignored.
    """
    source = keyed_text(docs, id_col, text_col)
    names = ["n_a", "n_b", "n_groups", "n_links"]
    n_b = len(PieceVocabulary(piece_path).pieces)
    schema = T.StructType(
        [
            T.StructField("_id", source.schema[0].dataType),
            *(T.StructField(n, T.LongType()) for n in names),
            T.StructField("groups", T.StringType()),
            T.StructField("_pairs", T.ArrayType(T.LongType())),
            T.StructField("_times", T.ArrayType(T.IntegerType())),
        ]
    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(byte_path, piece_path)
        for batch in slices(batches, 1 << 20):
            found = own.align(texts_of(batch))
            if digest:
                found["groups"] = [g and hashlib.sha256(g.encode()).hexdigest() for g in found["groups"]]
            of = pa.array(found["of"].astype(np.int32))
            columns = [batch.column(0), *(pa.array(np.asarray(found[n], np.int64)) for n in names), pa.array(found["groups"], pa.string())]
            columns += [pa.ListArray.from_arrays(of, pa.array(found["pairs"])), pa.ListArray.from_arrays(of, pa.array(found["times"].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    rows = stored(source.mapInArrow(link, schema).withColumn("_row", F.monotonically_increasing_id()), "token-links")
    links = rows.select("_row", F.inline(F.arrays_zip(F.col("_pairs").alias("_pair"), F.col("_times").alias("_n")))).toDF("_row", "_pair", "_n")
    counts = stored(links.groupBy("_pair").agg(F.sum("_n").alias("_count")), "pair-counts")
    of_b = F.col("_pair") % n_b
    highest = counts.groupBy(of_b.alias("_b")).agg(F.max("_count").alias("_highest"))
    table = stored(counts.withColumn("_b", of_b).join(F.broadcast(highest), "_b").select("_pair", "_count", (F.col("_count") == F.col("_highest")).alias("_best")), "pair-table")
    met = join_by_weight(links, table, ["_pair"], "_count", None, PAIR_PARTS)
    sums = met.groupBy("_row").agg(F.sum(F.when(F.col("_best"), F.col("_n")).otherwise(0)).alias("_n_best"), F.sum(F.col("_n") * F.col("_count")).alias("_count_sum"))
    none = F.lit(0).cast("long")
    return rows.join(sums, "_row", "left").select(F.col("_id").alias(id_col), *names, F.coalesce("_n_best", none).alias("n_best"), F.coalesce("_count_sum", none).alias("count_sum"), "groups")
