"""Removal of long repeated strings by sorted, sampled suffixes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed_text, slices, stored
from .sampled_suffixes import Rolling, scrambled, window_anchors


class Layer(NamedTuple):
    """One reading of the texts as symbols: windows of `window` symbols are compared, and
    each is assigned to one of its strings of `lead` symbols."""

    unit: int  # bytes of a symbol
    window: int
    lead: int


#: What a block is told of a lead: several contexts have it; very many have it.
MANY, LARGE = 1, 2
#: What a block is told of a context: it occurs again; the block speaks for it.
REPEATED, OWNER = 1, 2


def _zip(a: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes())


def _unzip(data: bytes, dtype: type = np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def word_symbols(text: bytes) -> np.ndarray:
    """The words of a text as 32-bit hashes; a passage is told apart by all of its words'."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words))


def equal_windows(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, window: int) -> np.ndarray:
    """Which of the windows data[s : s + window] equal another one of the same group.

    A multikey sort: windows are ordered by group and leading word of eight bytes, those
    alone are settled, and the rest go on to the next word.  After two words, ties are
    ordered by a hash of what remains, and neighbours are then compared byte for byte; only
    if a hash has brought different windows together are those sorted through all words.
    """
    out = np.zeros(len(starts), bool)
    padded = np.concatenate([data, np.zeros(8 + (-window) % 8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    rolling = Rolling(data)

    def refine(rows: np.ndarray, classes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((values, classes))
        rows, classes, values = rows[order], classes[order], values[order]
        fresh = np.concatenate([[True], (classes[1:] != classes[:-1]) | (values[1:] != values[:-1])])
        number = np.cumsum(fresh) - 1
        several = np.bincount(number)[number] > 1
        return rows[several], number[several]

    def word(rows: np.ndarray, at: int) -> np.ndarray:
        got = np.ascontiguousarray(words[starts[rows] + at]).view(">u8").reshape(-1).astype(np.uint64)
        return got if at + 8 <= window else got >> np.uint64(8 * (at + 8 - window))

    rows, classes = np.arange(len(starts)), groups
    for at in (0, 8):
        if len(rows):
            rows, classes = refine(rows, classes, word(rows, at))
    if not len(rows):
        return out
    tail = min(16, window)
    rows, classes = refine(rows, classes, rolling.at(starts[rows] + tail, window - tail))
    # Neighbours of a class must agree in every byte.
    head = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    first = rows[np.repeat(head, np.diff(np.append(head, len(rows))))]
    same = np.ones(len(rows), bool)
    for at in range(tail, window, 8):
        same &= word(rows, at) == word(first, at)
    bad = np.unique(classes[~same]) if not same.all() else np.zeros(0, np.int64)
    good = ~np.isin(classes, bad)
    out[rows[good]] = True
    rows, classes = rows[~good], classes[~good]
    for at in range(tail, window, 8):
        if len(rows):
            rows, classes = refine(rows, classes, word(rows, at))
    out[rows] = True
    return out


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of [start, end) spans, touching ones joined."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[cut], reach[np.append(cut[1:], len(starts)) - 1]


class Runs:
    """Runs of windows of one layer of a block, each with its lead and its context.

    `leads` and `contexts` (128-bit hashes) list different values in rising order; `context`
    numbers the context of each run and `lead` the lead of each context; `times` says how
    often a context occurs in the block.
    """

    PLACED = (("places", np.int64), ("context", np.int32), ("lead", np.int32))
    HASHED = (("lead", np.int32), ("leads", np.uint64), ("contexts", np.uint64), ("times", np.uint32))

    def __init__(self, raw: np.ndarray, lengths: np.ndarray, layer: Layer):
        places, leads, digests = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.uint64)], [b""]
        # Hashing takes some hundred bytes of memory a symbol, so it goes part by part.
        for offset, part, part_lengths in _parts(raw, lengths, layer.window):
            rolling = Rolling(part)
            first, last, anchor = window_anchors(rolling, part_lengths, layer.window, layer.lead)
            if not len(first):
                continue
            leads.append(scrambled(rolling.at(anchor, layer.lead)))
            view, u, w = memoryview(np.ascontiguousarray(part).view(np.uint8)), layer.unit, layer.window
            digests.append(b"".join(xxhash.xxh3_128_digest(view[a * u : (b + w) * u]) for a, b in zip(first.tolist(), last.tolist())))
            places.append(np.stack([first + offset, last - first, anchor - first], axis=1))
        self.places = np.concatenate(places)
        whole = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        order = np.lexsort((whole[:, 1], whole[:, 0]))
        ranked = whole[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
        self.contexts = ranked[fresh]
        self.context = np.empty(len(order), np.int32)
        self.context[order] = np.cumsum(fresh) - 1
        self.times = np.bincount(self.context, minlength=len(self.contexts)).astype(np.uint32)
        self.leads, lead = np.unique(np.concatenate(leads)[order[fresh]], return_inverse=True)
        self.lead = lead.astype(np.int32)

    def packed(self, fields: tuple) -> bytes:
        parts = [_zip(np.ascontiguousarray(getattr(self, n).T)) for n, _ in fields]
        return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)

    @classmethod
    def unpacked(cls, placed: bytes | None = None, hashed: bytes | None = None) -> Runs:
        out = cls.__new__(cls)
        for data, fields in ((placed, cls.PLACED), (hashed, cls.HASHED)):
            at = 8 * len(fields)
            for (name, dtype), n in zip(fields, np.frombuffer(data, np.int64, len(fields)).tolist()) if data else ():
                values = _unzip(data[at : at + n], dtype)
                setattr(out, name, values.reshape({"places": 3, "contexts": 2}[name], -1).T if name in ("places", "contexts") else values)
                at += n
        return out


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of `buckets` equal ranges of 64-bit hashes begins among rising keys."""
    return np.append(np.searchsorted(keys, np.array([-(-b * (1 << 64) // buckets) for b in range(buckets)], np.uint64)), len(keys))


def _numbered(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, number in that order) of pairs: equal pairs share a number."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.cumsum(fresh) - 1


def repeated_strings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 400,
    lead: int = 96,
    words: int = 51,
    lead_words: int = 12,
    block_bytes: int = 8 << 20,
    bucket_bytes: int = 16 << 20,
    large_group: int = 250,
) -> DataFrame:
    """Remove every byte covered by a `window`-byte string that also starts elsewhere, and
    find passages of `words` words that also stand elsewhere.

    Returns the id column, n_bytes, `spans` (array of [start, end) byte ranges removed,
    merged), `kept` (the remaining bytes, joined) and `passages` (array of [start, end) word
    ranges covered by strings of `words` words that also start anywhere else; these may be
    shorter than `window` bytes and are not removed).  Strings are taken from the UTF-8 bytes
    of the input, and its words between ASCII white space, in any documents and the same one,
    and never cross documents.

    Sorting every suffix would move hundreds of bytes for each byte of text.  Instead each
    window is assigned to its anchor, the least of its strings of `lead` symbols under a
    hash, so that equal windows meet at anchors with equal leads:

    1. Documents are packed in blocks, with the runs of windows of each anchor.
    2. Each block sends hashes of its different leads and of the whole contexts of its runs,
       equal ones once, so that many copies, or many contexts of one lead, cost an entry a
       block.  A run whose context occurs again is settled, all its windows are repeated; a
       run whose lead has that context alone is settled too.  Answers go back to the blocks
       as one byte for each lead and context.
    3. Only runs of one lead and several contexts are left, mostly edges of copied passages.
       Of each different context one run sends its suffix with what precedes it.  Sampled
       splitters range-partition these suffixes by leading symbols; within a bucket, windows
       of equal lead are ordered by a multikey sort and neighbours are compared.  Equal leads
       share a bucket, so no comparison is lost at a boundary.
    4. A lead with over `large_group` contexts would be one large group there: a common
       passage in different surroundings.  Its windows are dealt by a 128-bit hash of the
       whole window instead, equal ones once a block, so that they spread over all buckets.
    5. Blocks gather their spans and cut their documents.

    Null texts are empty: nothing to remove, `kept` empty.  Repeated rows are copies of each
    other, so all their bytes go if there are `window` of them.  Null ids give a row each; a
    text longer than a block makes a block of its own; an empty table gives an empty result;
    other columns are ignored.
    """
    layers = (Layer(1, window, lead), Layer(4, words, lead_words))
    source = keyed_text(docs, id_col, text_col)
    id_type = source.schema[0]
    block_fields = [("block", pa.int64()), ("n_runs", pa.int64()), *((n, pa.binary()) for n in ("ids", "lengths", "words", "text", "placed0", "placed1", "hashed0", "hashed1"))]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, block_bytes):
            texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            lengths = np.array([len(t) for t in texts], np.int64)
            coded = [word_symbols(t) for t in texts]
            n_words = np.array([len(c) for c in coded], np.int64)
            raw = b"".join(texts)
            runs = Runs(np.frombuffer(raw, np.uint8), lengths, layers[0]), Runs(np.concatenate(coded), n_words, layers[1])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", batch.schema.field(0).type)])) as writer:
                writer.write_batch(pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_pylist(), batch.schema.field(0).type)], names=["id"]))
            values = (number, sum(len(r.places) for r in runs), sink.getvalue().to_pybytes(), _zip(lengths), _zip(n_words), _zip(raw), *(r.packed(Runs.PLACED) for r in runs), *(r.packed(Runs.HASHED) for r in runs))
            yield pa.RecordBatch.from_pydict({n: [v] for (n, _), v in zip(block_fields, values)}, schema=pa.schema(block_fields))
            number += 1

    blocks = stored(source.mapInArrow(build, "block long, n_runs long, ids binary, lengths binary, words binary, text binary, placed0 binary, placed1 binary, hashed0 binary, hashed1 binary"), "suffix-blocks")
    n_runs = blocks.agg(F.sum("n_runs")).first()[0] or 0
    buckets = max(16, -(-n_runs * 16 // bucket_bytes))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By kind, two for each layer: leads, with the context if there is but one in the
        block and the number of contexts; and contexts with their number."""
        for batch in batches:
            for row in batch.to_pylist():
                for k in range(len(layers)):
                    runs = Runs.unpacked(hashed=row[f"hashed{k}"])
                    several = np.bincount(runs.lead, minlength=len(runs.leads)).astype(np.uint32)
                    only = np.zeros(len(runs.leads), np.uint64)
                    only[runs.lead] = runs.contexts[:, 1]
                    for kind, one, two, count in ((2 * k, runs.leads, only, several), (2 * k + 1, runs.contexts[:, 0], runs.contexts[:, 1], runs.times)):
                        cuts = _cuts(one, buckets)
                        filled = np.flatnonzero(np.diff(cuts))
                        pieces = lambda a: pa.array([a[cuts[b] : cuts[b + 1]].tobytes() for b in filled], pa.binary())  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(filled), kind, np.int32)), pa.array(filled, pa.int64()), pa.array(np.full(len(filled), row["block"])), pieces(one), pieces(two), pieces(count)],
                            names=["kind", "bucket", "block", "one", "two", "count"],
                        )

    def judge(table: pa.Table) -> pa.Table:
        """Flags for each entry of each block, in the order in which they came."""
        whole = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        one, two, count = whole("one", np.uint64), whole("two", np.uint64), whole("count", np.uint32)
        flags = np.zeros(len(one), np.uint8)
        if table.column("kind")[0].as_py() % 2:
            order, number = _numbered(one, two)
            copies = np.bincount(number, weights=count[order])[number]
            owner = np.ones(len(order), bool)
            owner[1:] = number[1:] != number[:-1]
            flags[order] = np.where(copies > 1, REPEATED, 0) | np.where(owner, OWNER, 0)
        else:
            order = np.argsort(one, kind="stable")
            fresh = np.ones(len(order), bool)
            fresh[1:] = one[order][1:] != one[order][:-1]
            number, begins = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
            contexts = np.bincount(number, weights=count[order])
            seen = two[order]
            # Blocks with one context each may all have the same one.
            alike = (np.maximum.reduceat(count[order], begins) == 1) & (np.minimum.reduceat(seen, begins) == np.maximum.reduceat(seen, begins))
            flags[order] = (np.where(alike, 0, MANY) | np.where(~alike & (contexts > large_group), LARGE, 0))[number]
        sizes = [len(x) // 8 for x in table.column("one").to_pylist()]
        return pa.Table.from_arrays([table.column("block"), table.column("kind"), table.column("bucket"), pa.array([_zip(x) for x in np.split(flags, np.cumsum(sizes)[:-1])], pa.binary())], names=["block", "kind", "bucket", "flags"])

    messages = blocks.select("block", "hashed0", "hashed1").mapInArrow(send, "kind int, bucket long, block long, one binary, two binary, count binary")
    flags = messages.groupBy("kind", "bucket").applyInArrow(judge, "block long, kind int, bucket long, flags binary")

    suffixes = pa.schema(
        [("block", pa.int64()), ("layer", pa.int32()), ("spans", pa.binary()), ("first", pa.int64()), ("offset", pa.int32()), ("needed", pa.bool_()), ("lead", pa.binary()), ("context", pa.binary()), ("n", pa.int64()), ("keys", pa.binary()), ("starts", pa.binary())]
    )

    def sift(block: pa.Table, answers: pa.Table) -> pa.Table:
        """By layer: spans of the settled runs as one row, the suffixes to be compared, and
        the windows of large groups as one row (key, start; equal ones of the block once)."""
        row, told = block.to_pylist()[0], sorted(answers.to_pylist(), key=lambda a: a["bucket"])
        out: dict[str, list] = {n: [] for n in suffixes.names}

        def add(**values):
            for n in suffixes.names:
                out[n].append(values.get(n))

        raw = bytes(_unzip(row["text"]))
        ends = np.cumsum(_unzip(row["lengths"], np.int64))
        for k, layer in enumerate(layers):
            runs = Runs.unpacked(row[f"placed{k}"])
            first, more, back = runs.places.T
            of = [np.concatenate([np.zeros(0, np.uint8), *(_unzip(a["flags"]) for a in told if a["kind"] == 2 * k + j)]) for j in (0, 1)]
            by_context, by_lead = of[1][runs.context], of[0][runs.lead][runs.context]
            repeated = by_context & REPEATED > 0
            spoken = np.zeros(len(first), bool)  # of equal runs in the block one is sent
            spoken[np.unique(runs.context, return_index=True)[1]] = True
            ship = spoken & (by_context & OWNER > 0) & (by_lead & MANY > 0)
            data = b""
            if ship.any():
                data = raw if k == 0 else np.concatenate([word_symbols(raw[a:b]) for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())]).tobytes()
            part = lambda a, n: data[a * layer.unit : (a + n) * layer.unit]  # noqa: B023, E731
            large = by_lead & LARGE > 0
            for r in np.flatnonzero(ship & ~large).tolist():
                f, m, o = int(first[r]), int(more[r]), int(back[r])
                add(block=row["block"], layer=k, first=f, offset=o, needed=not repeated[r], lead=part(f + o, layer.lead), context=part(f, m + layer.window))
            spans = [np.stack([first[repeated], (first + more + layer.window)[repeated]], axis=1)]
            chosen = np.flatnonzero(ship & large)
            if len(chosen):
                starts = np.concatenate([np.arange(first[r], first[r] + more[r] + 1) for r in chosen.tolist()])
                wanted = np.repeat(~repeated[chosen], more[chosen] + 1)
                keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(part(a, layer.window)) for a in starts.tolist()), np.uint64).reshape(-1, 2)
                order, number = _numbered(keys[:, 0], keys[:, 1])
                several = np.bincount(number)[number] > 1  # equal windows of the block settle each other
                own = starts[order[several & wanted[order]]]
                spans.append(np.stack([own, own + layer.window], axis=1))
                speaker = order[np.unique(number, return_index=True)[1]]
                alone = np.bincount(number) == 1
                add(block=row["block"], layer=k, n=len(speaker), keys=np.ascontiguousarray(keys[speaker]).tobytes(), starts=np.where(alone & wanted[speaker], starts[speaker], -1).astype(np.int64).tobytes())
            add(block=row["block"], layer=k, spans=np.stack(_merge(*np.concatenate(spans).T)).astype(np.int64).tobytes())
        return pa.Table.from_pydict(out, schema=suffixes)

    shown = blocks.select("block", "lengths", "text", "placed0", "placed1")
    sifted = stored(shown.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(sift, "block long, layer int, spans binary, first long, offset int, needed boolean, lead binary, context binary, n long, keys binary, starts binary"), "suffixes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of (layer, lead), a group of at most `large_group` rows at a time."""
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            marks = _marks(table)
            cut = len(marks) - 1
            while cut > 0 and marks[cut - 1] == marks[-1]:
                cut -= 1
            held = table.slice(cut)
            if cut:
                yield from _compare_groups(table.slice(0, cut), marks[:cut], layers)
        if held is not None:
            yield from _compare_groups(held, _marks(held), layers)

    compared = (
        sifted.filter("context IS NOT NULL")
        .select("layer", "lead", "block", "first", "offset", "needed", "context")
        .repartitionByRange("layer", "lead")
        .sortWithinPartitions("layer", "lead")
        .mapInArrow(compare, "block long, layer int, spans binary")
    )
    windows = sifted.filter("keys IS NOT NULL")
    ranges = max(16, -(-(windows.agg(F.sum("n")).first()[0] or 0) * 24 // bucket_bytes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, starts = np.frombuffer(row["keys"], np.uint64).reshape(-1, 2), np.frombuffer(row["starts"], np.int64)
                cuts = _cuts(np.ascontiguousarray(keys[:, 0]), ranges)
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    s, e = cuts[b], cuts[b + 1]
                    yield pa.RecordBatch.from_pydict({"layer": [row["layer"]], "bucket": [b], "block": [row["block"]], "keys": [keys[s:e].tobytes()], "starts": [starts[s:e].tobytes()]}, schema=dealt)

    dealt = pa.schema([("layer", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("starts", pa.binary())])

    def meet(table: pa.Table) -> pa.Table:
        layer = table.column("layer")[0].as_py()
        keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64).reshape(-1, 2)
        starts = np.frombuffer(b"".join(table.column("starts").to_pylist()), np.int64)
        block = np.repeat(table.column("block").to_numpy(), [len(x) // 8 for x in table.column("starts").to_pylist()])
        order, number = _numbered(keys[:, 0], keys[:, 1])
        hit = order[np.bincount(number)[number] > 1]
        hit = hit[starts[hit] >= 0]
        return pa.Table.from_batches([_span_rows(block[hit], starts[hit], layer, layers[layer].window)])

    met = windows.select("layer", "block", "keys", "starts").mapInArrow(deal, "layer int, bucket long, block long, keys binary, starts binary").groupBy("layer", "bucket").applyInArrow(meet, "block long, layer int, spans binary")
    spans = sifted.filter("spans IS NOT NULL").select("block", "layer", "spans").unionByName(compared).unionByName(met)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [id_type, T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType()), T.StructField("passages", span)]
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(block: pa.Table, found: pa.Table) -> pa.Table:
        row, told = block.to_pylist()[0], found.to_pylist()
        text = _unzip(row["text"])
        ids = pa.ipc.open_stream(row["ids"]).read_all().column(0)
        kept, turns = [], []
        for k, lengths in enumerate((_unzip(row["lengths"], np.int64), _unzip(row["words"], np.int64))):
            pairs = [np.frombuffer(r["spans"], np.int64).reshape(2, -1) for r in told if r["layer"] == k]
            a, b = _merge(*np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1))
            edge = np.zeros(int(lengths.sum()) + 1, np.int8)
            edge[a] += 1
            edge[b] -= 1
            gone = np.cumsum(edge[:-1], dtype=np.int8) > 0
            turns.append([])
            at = 0
            for n in lengths.tolist():
                own = gone[at : at + n]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))) if own.any() else np.zeros(0, np.int64)
                turns[k].append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
                if k == 0:
                    kept.append((text[at : at + n][~own] if len(edges) else text[at : at + n]).tobytes())
                at += n
        return pa.Table.from_arrays([ids, pa.array(_unzip(row["lengths"], np.int64)), pa.array(turns[0], arrow_span), pa.array(kept, pa.binary()), pa.array(turns[1], arrow_span)], names=[f.name for f in fields])

    return blocks.select("block", "ids", "lengths", "words", "text").groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(cut, T.StructType(fields))


def _parts(raw: np.ndarray, lengths: np.ndarray, window: int, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, symbols, document lengths) pieces of about `most` symbols that together hold
    every window of each document once; a longer document comes in overlapping pieces."""
    ends = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        at = int(ends[first] - lengths[first])
        last = max(first + 1, int(np.searchsorted(ends, at + most, side="right")))
        n = int(ends[last - 1]) - at
        if n <= most:
            yield at, raw[at : at + n], lengths[first:last]
        else:
            for s in range(0, max(n - window + 1, 1), most - window + 1):
                size = min(n - s, most)
                yield at + s, raw[at + s : at + s + size], np.array([size])
        first = last


def _marks(table: pa.Table) -> list[tuple]:
    """What rows must have in common to be compared."""
    return list(zip(table.column("layer").to_pylist(), table.column("lead").to_pylist()))


def _span_rows(block: np.ndarray, starts: np.ndarray, layer: int, window: int) -> pa.RecordBatch:
    """One row of merged spans for each block that has windows at `starts`."""
    order = np.lexsort((starts, block))
    block, starts = block[order], starts[order]
    names, begins = np.unique(block, return_index=True)
    spans = [np.stack(_merge(own, own + window)).astype(np.int64).tobytes() for own in np.split(starts, begins[1:])] if len(names) else []
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([layer] * len(names), pa.int32()), pa.array(spans, pa.binary())], names=["block", "layer", "spans"])


def _compare_groups(table: pa.Table, marks: list, layers: tuple[Layer, ...]) -> Iterator[pa.RecordBatch]:
    """Spans of the needed windows of whole groups that equal another window of theirs."""
    step = 4000
    done = 0
    while done < len(marks):
        k = marks[done][0]
        layer = layers[k]
        end = done + 1
        while end < len(marks) and marks[end][0] == k and (end - done < step or marks[end] == marks[end - 1]):
            end += 1
        part = table.slice(done, end - done)
        contexts = part.column("context").to_pylist()
        sizes = np.array([len(c) // layer.unit for c in contexts])
        data = np.frombuffer(b"".join(contexts), np.uint8)
        counts = sizes - layer.window + 1
        row = np.repeat(np.arange(len(sizes)), counts)
        step_in = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = (np.cumsum(sizes) - sizes)[row] + step_in
        offset = part.column("offset").to_numpy()[row] - step_in
        group = np.cumsum([0, *(a != b for a, b in zip(marks[done : end - 1], marks[done + 1 : end]))])[row]
        same = equal_windows(data, starts * layer.unit, group * (int(offset.max()) + 1) + offset, layer.window * layer.unit)
        same &= np.array(part.column("needed").to_pylist(), bool)[row]
        hit = np.flatnonzero(same)
        if len(hit):
            yield _span_rows(part.column("block").to_numpy()[row[hit]], part.column("first").to_numpy()[row[hit]] + step_in[hit], k, layer.window)
        done = end
