"""Packing of token sequences into rows of fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import kept_by_worker, keyed_text, slices, texts_of


class CapacityTree:
    """A segment tree over room 0..most; each leaf holds the bins with just that room left.

    A node is set while a leaf below it has a bin, so the least sufficient room is found in
    one walk up and one down.
    """

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.set = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        at = room + self.leaves
        while at and not self.set[at]:
            self.set[at] = 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, bin) of the fullest bin that still has room for `size`, taken out."""
        has, at = self.set, size + self.leaves
        while not has[at]:
            while at & 1:  # climb until a subtree to the right exists
                at >>= 1
            if not at:
                return None
            at += 1
            if at & (at - 1) == 0:  # past the right end of this level
                return None
        while at < self.leaves:
            at = 2 * at if has[2 * at] else 2 * at + 1
        room = at - self.leaves
        number = self.bins[room].pop()
        if not self.bins[room]:
            has[at] = 0
            at >>= 1
            while at and not (has[2 * at] or has[2 * at + 1]):
                has[at] = 0
                at >>= 1
        return room, number


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers: items in falling size, equal ones in order, each into
    the bin that it leaves least room in."""
    tree = CapacityTree(capacity)
    bins: list[list[int]] = []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        found = tree.take(size)
        if found is None:
            bins.append([item])
            room = capacity - size
            if room:
                tree.add(room, len(bins) - 1)
            continue
        room, number = found
        bins[number].append(item)
        if room > size:
            tree.add(room - size, number)
    return bins


@kept_by_worker(2)
def byte_pair_encoder(path: str, pattern: str):
    """The public tokenizer whose ranks the file at `path` lists."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: White space in a row from which on the library's matcher can run out of stack.
LONG_SPACE = regex.compile(r"\s{100000}")


def encode_text(encoder, text: str, pattern: str) -> list[int]:
    """The ids of a text, as the library's encode_ordinary gives them, for any text.

    The library keeps a stack entry for each character that white space before a lookahead
    matches, and breaks off on some 1,000,000 of them.  Such texts are cut by the same pattern
    with a matcher that has no such stack, and each piece is merged by the library.
    """
    if len(text) < 100_000 or not LONG_SPACE.search(text):
        return encoder.encode_ordinary(text)
    out: list[int] = []
    for piece in regex.finditer(pattern, text):
        out += encoder._encode_single_piece(piece[0])
    return out


def pack_tokens(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    end_id: int = 50256,
    pad_id: int = 50256,
    group_tokens: int = 4_000_000,
) -> DataFrame:
    """Tokenise documents and pack them in rows of `length` token ids.

    Each document's ids, with `end_id` after the last, are cut into pieces of at most
    `length`; no token is lost.  The pieces of a group of some `group_tokens` tokens are
    packed best-fit-decreasing, the fullest bin with room being found in a segment tree.

    Returns one row for each packed row: pack (its number, unique in the result), n_tokens,
    n_segments, `ids` (binary: `length` little-endian unsigned 32-bit ids, padded with
    `pad_id`), `cu_seqlens` (0 and the end of each segment), `positions` (binary of the same
    shape: position within the segment, restarting at 0; padding counts on from 0), and for
    each segment `doc_ids`, `doc_rows` (number of the document within the group, so that
    repeated ids stay apart), `groups` number and `offsets` (first token within its document).

    Null and empty texts give the end alone; a text of any length or white space is encoded
    as the library would, and one longer than a group makes a group of its own.  Repeated rows and null ids are packed like
    others; an empty table gives an empty result; other columns are ignored.  Groups are
    packed where they are read: one pass, no shuffle, memory bounded by the group.
    """
    source = keyed_text(docs, id_col, text_col)
    schema = T.StructType(
        [
            *(T.StructField(n, T.LongType()) for n in ("pack", "group", "n_tokens", "n_segments")),
            T.StructField("ids", T.BinaryType()),
            T.StructField("positions", T.BinaryType()),
            T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
            T.StructField("doc_ids", T.ArrayType(source.schema[0].dataType)),
            T.StructField("doc_rows", T.ArrayType(T.LongType())),
            T.StructField("offsets", T.ArrayType(T.LongType())),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_pair_encoder(ranks_path, pattern)
        base = TaskContext.get().partitionId() << 32
        made = group = 0
        held: list[np.ndarray] = []
        names: list[object] = []
        total = 0
        id_type = None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, group, held, names, total
            pieces = [(d, at, min(length, len(ids) - at)) for d, ids in enumerate(held) for at in range(0, len(ids), length)]
            bins = best_fit_decreasing(np.array([n for _, _, n in pieces]), length)
            for first in range(0, len(bins), 256):
                out: dict[str, list] = {f.name: [] for f in schema}
                for number, members in enumerate(bins[first : first + 256], first):
                    own = [pieces[m] for m in members]
                    ends = np.cumsum([0, *(n for _, _, n in own)])
                    row = np.full(length, pad_id, "<u4")
                    place = np.arange(length, dtype="<u4")
                    for (d, at, n), s in zip(own, ends.tolist()):
                        row[s : s + n] = held[d][at : at + n]
                        place[s : s + n] = np.arange(n)
                    place[ends[-1] :] -= np.uint32(ends[-1])
                    for name, v in (
                        ("pack", base + made + number),
                        ("group", base + group),
                        ("n_tokens", int(ends[-1])),
                        ("n_segments", len(own)),
                        ("ids", row.tobytes()),
                        ("positions", place.tobytes()),
                        ("cu_seqlens", ends.tolist()),
                        ("doc_ids", [names[d] for d, _, _ in own]),
                        ("doc_rows", [d for d, _, _ in own]),
                        ("offsets", [at for _, at, _ in own]),
                    ):
                        out[name].append(v)
                types = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.list_(pa.int32()), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))
            made, group, held, names, total = made + len(bins), group + 1, [], [], 0

        for batch in slices(batches):
            id_type = batch.schema.field(0).type
            for name, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                ids = encode_text(encoder, text, pattern)
                ids.append(end_id)
                held.append(np.array(ids, "<u4"))
                names.append(name)
                total += len(ids)
                if total >= group_tokens:
                    yield from flush()
        if held:
            yield from flush()

    return source.mapInArrow(pack, schema)
