"""Language-model scoring by a weighted backoff automaton learned from the documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed_text, slices, stored

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The end of a text; no word holds a space, so no word equals it.
END = b" "
_MIX = np.uint64(0x9E3779B97F4A7C15)


def is_held_out(doc_id: object, folds: int = 5, fold: int = 1) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == fold


def tokens(text: bytes | None) -> list[bytes]:
    out = (text or b"").translate(_LOWER).split()
    out.append(END)
    return out


# -- packed arrays: bytes of equal weight side by side compress better ----------------------


def _pack(values: np.ndarray, width: int) -> bytes:
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)[:, :width].T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, dtype: type, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], np.dtype(dtype).itemsize), np.uint8)
    out[:, :width] = planes.T
    return out.view(dtype).reshape(-1)


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Rising 64-bit keys, as differences."""
    return _pack(np.diff(keys, prepend=np.uint64(0)), 8)


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64, 8), dtype=np.uint64)


def key_bits(level: int) -> int:
    """Bits of hash that tell grams apart: all of a word's, 56 of a longer gram's."""
    return 64 if level == 1 else 56


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of 64-bit hashes; the order matters."""
    h = (a ^ (a >> np.uint64(29))) * _MIX + b
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


class Grams:
    """The distinct n-grams of a block of documents, one level after the other.

    Level k numbers the distinct k-grams by (number of the (k-1)-gram before, last word), so
    that any worker that has the block's word sequence finds the same numbering.  `at` gives
    the number of the k-gram that ends at each position, or -1 at a text's first k-1 words.
    """

    def __init__(self, sequence: np.ndarray, lengths: np.ndarray, n_words: int, order: int):
        first = np.cumsum(lengths) - lengths
        offset = np.arange(len(sequence)) - np.repeat(first, lengths)
        self.at = [sequence]
        self.sizes = [n_words]
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []  # (prefix gram, last word) of each gram
        for k in range(1, order):
            inside = np.flatnonzero(offset >= k)
            code = self.at[-1][inside - 1].astype(np.int64) * n_words + sequence[inside]
            distinct, number = np.unique(code, return_inverse=True)
            at = np.full(len(sequence), -1, np.int64)
            at[inside] = number
            self.at.append(at)
            self.sizes.append(len(distinct))
            self.parts.append((distinct // n_words, distinct % n_words))

    def keys(self, words: np.ndarray) -> list[np.ndarray]:
        """The key of each gram of each level, from the hashes of the words."""
        hashes = [words]
        for prefix, last in self.parts:
            hashes.append(_mixed(hashes[-1][prefix], words[last]))
        return [h >> np.uint64(64 - key_bits(k)) for k, h in enumerate(hashes, 1)]


class Automaton:
    """The part of the backoff automaton that a block's texts can reach.

    Nodes are the block's grams, level after level, and node 0 is the root, the empty
    context.  A node seen in training is the target of an arc from its prefix by its last
    word, with a log10 weight; one shorter than the order is also a state, with a failure arc
    to its suffix at a log10 cost.  The root has an arc for every word.

    `counts` and `follow` list, level by level, the training count of each gram and the
    number of different words seen after it; `discounts` are those of levels 2 and up.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], follow: list[np.ndarray], base: np.ndarray, discounts: list[float]):
        order = len(counts)
        self.order = order
        self.first = np.cumsum([1, *grams.sizes])  # the node of each level's gram 0
        self.level = np.repeat(np.arange(order + 1), [1, *grams.sizes])
        suffix = [np.zeros(grams.sizes[0], np.int64)]
        weights = [base]
        failing = [np.ones(1)]  # the share of each node's mass that goes along its failure arc
        for k, (prefix, _) in enumerate(grams.parts, 1):
            inside = np.flatnonzero(grams.at[k] >= 0)
            shorter = np.empty(grams.sizes[k], np.int64)
            shorter[grams.at[k][inside]] = grams.at[k - 1][inside]
            share = discounts[k - 1] * follow[k - 1] / np.maximum(counts[k - 1], 1)
            weights.append(np.maximum(counts[k] - discounts[k - 1], 0) / np.maximum(counts[k - 1][prefix], 1) + share[prefix] * weights[-1][shorter])
            suffix.append(self.first[k - 1] + shorter)
            failing.append(share)
        failing.append(np.ones(grams.sizes[-1]))
        self.seen = np.concatenate([[True], np.ones(grams.sizes[0], bool), *(c > 0 for c in counts[1:])])
        # Nothing follows an end: its context has no mass, and no walk leaves from it.
        self.weight, self.cost = (np.log10(x, out=np.zeros(len(x)), where=x > 0) for x in map(np.concatenate, ([np.ones(1), *weights], failing)))
        self.failure = np.concatenate([[0], *suffix])
        # Where a walk is after an arc: the longest suffix that is a state.
        state = (np.concatenate([[1.0], *follow, np.zeros(grams.sizes[-1])]) > 0) & (self.level < order)
        self.settle = np.where(state, np.arange(len(state)), self.failure)
        while not state[self.settle].all():
            self.settle = np.where(state[self.settle], self.settle, self.failure[self.settle])

    def walk(self, grams: Grams, lengths: np.ndarray, piece: int = 1024) -> np.ndarray:
        """The log10 weight of each position.

        All texts step at once, each with the state it carries.  Long ones are walked in
        pieces; a piece starts in the state of the position before, which depends on the
        last words alone.
        """
        nodes = np.stack([np.where(at >= 0, self.first[k] + at, -1) for k, at in enumerate(grams.at)])
        begins = np.cumsum(lengths) - lengths
        parts = -(-lengths // piece)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at = np.repeat(begins, parts) + nth * piece
        left = np.minimum(np.repeat(lengths, parts) - nth * piece, piece)
        longest = np.argsort(-left, kind="stable")
        at, left, nth = at[longest], left[longest], nth[longest]
        state = np.zeros(len(at), np.int64)
        later = np.flatnonzero(nth > 0)
        for k in range(self.order):  # the longest gram before the piece that the block holds
            node = nodes[k, at[later] - 1]
            state[later] = np.where(node >= 0, node, state[later])
        state = self.settle[state]
        out = np.zeros(nodes.shape[1])
        running = np.searchsorted(-left, -np.arange(piece), side="left")
        for step in range(int(left[0]) if len(left) else 0):
            n = running[step]
            here, own = at[:n] + step, state[:n]
            weight = np.zeros(n)
            target = nodes[self.level[own], here]
            stuck = np.flatnonzero(~self.seen[target])
            while len(stuck):
                weight[stuck] += self.cost[own[stuck]]
                own[stuck] = self.failure[own[stuck]]
                target[stuck] = nodes[self.level[own[stuck]], here[stuck]]
                stuck = stuck[~self.seen[target[stuck]]]
            out[here] = weight + self.weight[target]
            state[:n] = self.settle[target]
        return out


_BLOCK = "block long, n_docs long, n_tokens long, tokens binary, lengths binary, train binary, words binary, ids binary"


def _blocks(docs: DataFrame, block_bytes: int, folds: int, fold: int) -> DataFrame:
    """Documents as rows of packed word sequences, each of about `block_bytes` of text."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, block_bytes):
            vocabulary: dict[bytes, int] = {}
            lengths, coded = [], []
            for text in batch.column(1).cast(pa.large_binary()).to_pylist():
                own = tokens(text)
                lengths.append(len(own))
                coded.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in own), np.int32, len(own)))
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
            by_hash = np.argsort(words, kind="stable")
            number_of = np.empty(len(words), np.int32)
            number_of[by_hash] = np.arange(len(words))
            train = np.array([not is_held_out(i, folds, fold) for i in batch.column(0).to_pylist()], np.uint8)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", batch.schema.field(0).type)])) as writer:
                writer.write_batch(pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_pylist(), batch.schema.field(0).type)], names=["id"]))
            sequence = number_of[np.concatenate(coded)]
            yield pa.RecordBatch.from_pydict(
                {
                    "block": [number],
                    "n_docs": [len(lengths)],
                    "n_tokens": [len(sequence)],
                    "tokens": [_pack(sequence, 4)],
                    "lengths": [_pack(np.array(lengths, np.int32), 4)],
                    "train": [train.tobytes()],
                    "words": [_pack_sorted(words[by_hash])],
                    "ids": [sink.getvalue().to_pybytes()],
                },
                schema=schema,
            )
            number += 1

    schema = pa.schema([(n, pa.int64()) for n in ("block", "n_docs", "n_tokens")] + [(n, pa.binary()) for n in ("tokens", "lengths", "train", "words", "ids")])
    return docs.mapInArrow(build, _BLOCK)


def _open(row: dict, order: int) -> tuple[Grams, np.ndarray, np.ndarray]:
    lengths = _unpack(row["lengths"], np.int32, 4).astype(np.int64)
    words = _unpack_sorted(row["words"])
    return Grams(_unpack(row["tokens"], np.int32, 4).astype(np.int64), lengths, len(words), order), lengths, words


def _in_order(rows: list[dict], keys: np.ndarray, column: str, dtype: type) -> np.ndarray:
    """Answers of all buckets to one level of a block, by gram number."""
    out = np.zeros(len(keys), dtype)
    if len(keys):
        out[np.argsort(keys, kind="stable")] = np.concatenate([_unpack(r[column], dtype, np.dtype(dtype).itemsize) for r in sorted(rows, key=lambda r: r["bucket"])])
    return out


_MESSAGE = [("bucket", pa.int64()), ("block", pa.int64()), *((n, pa.binary()) for n in ("keys", "counts", "follow"))]
_ANSWER = [("block", pa.int64()), ("bucket", pa.int64()), ("level", pa.int32()), *((n, pa.binary()) for n in ("totals", "follow", "own")), *((n, pa.int64()) for n in ("n", "v", "n1", "n2"))]


def _messages(row: dict, above: list[dict], level: int, order: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """A block's grams of one level, bucket by bucket in key order: keys, training counts
    and, with the answers `above` of the next level, how many different words follow."""
    grams, lengths, words = _open(row, min(level + 1, order))
    trained = np.repeat(np.frombuffer(row["train"], np.uint8).astype(bool), lengths)
    keys = grams.keys(words)
    at = grams.at[level - 1]
    counts = np.bincount(at[trained & (at >= 0)], minlength=grams.sizes[level - 1]).astype(np.uint32)
    follow = np.zeros(len(counts), np.uint32)
    if level < order:
        # Each gram in training is owned by one block, which counts it for its context.
        owned = _in_order(above, keys[level], "own", np.uint8) > 0
        follow = np.bincount(grams.parts[level - 1][0][owned], minlength=len(counts)).astype(np.uint32)
    ordered = np.argsort(keys[level - 1], kind="stable")
    keys, counts, follow = keys[level - 1][ordered], counts[ordered], follow[ordered]
    span = 1 << key_bits(level)
    bounds = np.array([-(-b * span // buckets) for b in range(buckets)], np.uint64)
    starts = np.append(np.searchsorted(keys, bounds), len(keys))
    filled = np.flatnonzero(np.diff(starts)).tolist()
    for first in range(0, len(filled), 64):
        out: dict[str, list] = {n: [] for n, _ in _MESSAGE}
        for b in filled[first : first + 64]:
            s, e = starts[b], starts[b + 1]
            for n, v in zip(out, (b, row["block"], _pack_sorted(keys[s:e]), _pack(counts[s:e], 4), _pack(follow[s:e], 4))):
                out[n].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema(_MESSAGE))


def _add_up(table: pa.Table, level: int) -> pa.Table:
    """Totals of the keys of one bucket for each block that sent them, in its order, and the
    bucket's own sums as a row without a block."""
    rows = table.to_pylist()
    keys = [_unpack_sorted(r["keys"]) for r in rows]
    ends = np.cumsum([len(k) for k in keys])[:-1]
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([_unpack(r["counts"], np.uint32, 4) for r in rows])
    sums = np.bincount(number, weights=counts, minlength=len(distinct)).astype(np.uint64)
    follow = np.bincount(number, weights=np.concatenate([_unpack(r["follow"], np.uint32, 4) for r in rows]), minlength=len(distinct)).astype(np.uint64)
    trained = np.flatnonzero(counts)
    own = np.zeros(len(number), np.uint8)
    own[trained[np.unique(number[trained], return_index=True)[1]]] = 1
    bucket = rows[0]["bucket"]
    out: dict[str, list] = {n: [] for n, _ in _ANSWER}
    for r, *values in zip(rows, *(np.split(x, ends) for x in (sums[number], follow[number], own))):
        packed = [_pack(v, v.dtype.itemsize) for v in values]
        for n, v in zip(out, (r["block"], bucket, level, *packed, None, None, None, None)):
            out[n].append(v)
    for n, v in zip(out, (None, bucket, level, None, None, None, int(sums.sum()), *(int(x) for x in ((sums > 0).sum(), (sums == 1).sum(), (sums == 2).sum())))):
        out[n].append(v)
    return pa.Table.from_pydict(out, schema=pa.schema(_ANSWER))


def lm_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 3,
    folds: int = 5,
    fold: int = 1,
    block_bytes: int = 8 << 20,
    bucket_bytes: int = 16 << 20,
) -> DataFrame:
    """Train on the documents outside one fold and score all of them.

    Returns the id column, held_out, n_tokens, n_known, train_tokens, base_score (unigrams
    with half a count added) and score.

    The model: n-grams up to `order` words with absolute discounting.  The probability of a
    word w after a context h seen in training is
    (max(c(h w) - D, 0) + D * t(h) * p(w | h')) / c(h), t(h) being the number of different
    words seen after h and h' being h without its first word; after an unseen context it is
    p(w | h'), and without context it is the base probability.  The discount D of each length
    is fitted to the counts, n1 / (n1 + 2 n2) from the n-grams seen once and twice (with half
    an n-gram added to n1, so that it lies between 0 and 1).

    As an automaton: each context seen in training is a state; a seen n-gram is an arc with
    the weight above, and the failure arc to h' costs D * t(h) / c(h).  A text is one walk
    from the root that carries its state, and its log10 weights add up to the score.  Every
    n-gram of the training texts is counted.

    How it runs: documents are packed into blocks of about `block_bytes` of text.  Longest
    n-grams first, each block sends its distinct n-grams with their training counts, dealt by
    ranges of a hash into buckets of about `bucket_bytes`; a bucket adds the counts up and
    answers each block for its n-grams alone, in the block's order, naming one block the
    owner of each n-gram.  Owners count the words after each context, which go with the next
    shorter n-grams.  Each block then builds the part of the automaton that its texts can
    reach and walks them through it.  So the model is never in one place and no table is
    broadcast; a frequent n-gram costs one entry a block.  There is no limit to the buckets,
    so that a task's memory is the same for any corpus; blocks times buckets is the number
    of rows exchanged, so both sizes should grow with the square root of a corpus of many
    terabytes, on larger executors.

    Words are told apart by a 64-bit hash, longer n-grams by 56 bits.

    Null texts are empty: the end alone.  A null id counts as the empty text for the fold.  A
    text longer than a block makes a block of its own.  Repeated rows are scored, and counted,
    each by itself; with no training document every probability is that of an empty count; an
    empty table gives an empty result; other columns are ignored.
    """
    source = keyed_text(docs, id_col, text_col)
    blocks = stored(_blocks(source, block_bytes, folds, fold), "lm-blocks")
    total = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(16, -(-total * 6 // bucket_bytes))
    sent = "bucket long, block long, keys binary, counts binary, follow binary"
    answered = "block long, bucket long, level int, totals binary, follow binary, own binary, n long, v long, n1 long, n2 long"
    shown = blocks.select("block", "tokens", "lengths", "train", "words")

    def exchange(level: int, above: DataFrame | None) -> DataFrame:
        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield from _messages(row, [], level, order, buckets)

        def later(block: pa.Table, above: pa.Table) -> pa.Table:
            return pa.Table.from_batches(_messages(block.to_pylist()[0], above.to_pylist(), level, order, buckets), pa.schema(_MESSAGE))

        def add_up(table: pa.Table) -> pa.Table:
            return _add_up(table, level)

        if above is None:
            messages = shown.mapInArrow(first, sent)
        else:
            owned = above.filter("block IS NOT NULL").select("block", "bucket", "own")
            messages = shown.groupBy("block").cogroup(owned.groupBy("block")).applyInArrow(later, sent)
        return stored(messages.groupBy("bucket").applyInArrow(add_up, answered), "lm-totals")

    answers: list[DataFrame] = []
    for level in range(order, 0, -1):
        answers.append(exchange(level, answers[-1] if answers else None))

    everything = answers[0]
    for more in answers[1:]:
        everything = everything.unionByName(more)
    sums = {r.level: r for r in everything.filter("block IS NULL").groupBy("level").agg(*(F.sum(c).alias(c) for c in ("n", "v", "n1", "n2"))).collect()}
    n_train, n_distinct = (sums[1].n, sums[1].v) if sums else (0, 0)
    discounts = [(sums[k].n1 + 0.5) / (sums[k].n1 + 2 * sums[k].n2 + 1) if k in sums else 0.5 for k in range(2, order + 1)]

    fields = [
        source.schema[0],
        T.StructField("held_out", T.BooleanType()),
        *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")),
        *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score")),
    ]

    def walk(block: pa.Table, totals: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        grams, lengths, words = _open(row, order)
        got: dict[int, list[dict]] = {}
        for r in totals.to_pylist():
            got.setdefault(r["level"], []).append(r)
        keys = grams.keys(words)
        counts = [_in_order(got.get(k, []), keys[k - 1], "totals", np.uint64).astype(float) for k in range(1, order + 1)]
        follow = [_in_order(got.get(k, []), keys[k - 1], "follow", np.uint64).astype(float) for k in range(1, order)]
        base = (counts[0] + 0.5) / (n_train + 0.5 * (n_distinct + 1))
        known = (counts[0] > 0)[grams.at[0]]
        starts = np.cumsum(lengths) - lengths
        train = np.frombuffer(row["train"], np.uint8).astype(bool)
        return pa.Table.from_arrays(
            [
                pa.ipc.open_stream(row["ids"]).read_all().column(0),
                pa.array(~train),
                pa.array(lengths),
                pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                pa.array(np.full(len(lengths), n_train, np.int64)),
                pa.array(np.add.reduceat(np.log10(base)[grams.at[0]], starts)),
                pa.array(np.add.reduceat(Automaton(grams, counts, follow, base, discounts).walk(grams, lengths), starts)),
            ],
            names=[f.name for f in fields],
        )

    packed = blocks.select("block", "tokens", "lengths", "train", "words", "ids")
    totals = everything.filter("block IS NOT NULL").select("block", "bucket", "level", "totals", "follow")
    return packed.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(walk, T.StructType(fields))
