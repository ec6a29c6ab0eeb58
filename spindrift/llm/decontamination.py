"""Benchmark decontamination by an FM-index per shard of the training documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed_text, slices, stored
from .fm_index import FMIndex

#: Lower-cases A-Z and turns every byte outside words to a space; bytes from 0x80 on are
#: parts of letters beyond ASCII, which all belong to words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def windows_of(text: bytes | None, window: int) -> Iterator[bytes]:
    """The phrases of an item, their words joined by spaces."""
    own = words(text)
    for at in range(max(1, len(own) - window + 1)) if own else ():
        yield b" ".join(own[at : at + window])


class Phrases:
    """Some phrases as rows of symbols over their own words, with the items that own them."""

    def __init__(self, phrases: list[bytes], owners: pa.Array, window: int):
        self.symbols: dict[bytes, int] = {}
        self.lengths = np.zeros(len(phrases), np.int64)
        self.rows = np.zeros((len(phrases), window), np.int32)
        for k, phrase in enumerate(phrases):
            ids = [self.symbols.setdefault(w, len(self.symbols) + 1) for w in phrase.split()]
            self.lengths[k] = len(ids)
            self.rows[k, : len(ids)] = ids
        self.owners = owners
        self.shortest = int(self.lengths.min(initial=window))

    def items(self, phrase: int) -> list[str]:
        return self.owners[phrase].as_py()


def phrase_table(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> tuple[DataFrame, int]:
    """(block, phrase, items) of the different phrases, and the number of blocks.

    Phrases with their item names that take over an eighth of `block_bytes` are set apart
    first and packed into blocks of their own, one that is larger than a block alone; there
    are at most eight for each block's size of data.  The others are dealt by hash in so many
    blocks that none has more than `block_bytes`; these blocks are measured.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                own = list(dict.fromkeys(windows_of(text, window)))
                for at in range(0, len(own), 50_000):
                    part = own[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([item] * len(part), pa.string())], names=["phrase", "item"])

    bench = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("words"))
    owned = bench.mapInArrow(cut, "phrase binary, item string").groupBy("phrase").agg(F.collect_set("item").alias("items"))
    size = F.octet_length("phrase") + 16 + F.aggregate("items", F.lit(0), lambda n, i: n + 8 + F.octet_length(i))
    owned = stored(owned.withColumn("size", size.cast("long")), "phrases")
    apart = F.col("size") * 8 > block_bytes
    # The driver packs sizes alone: next fit by falling size.
    number, room, packed = -1, 0, []
    for r in owned.filter(apart).select(F.xxhash64("phrase").alias("of"), F.octet_length("phrase").alias("n"), "size").orderBy(F.desc("size"), "of").collect():
        if r["size"] > room:
            number, room = number + 1, block_bytes
        room -= r["size"]
        packed.append((r["of"], r["n"], number))
    large = number + 1
    rest = owned.filter(~apart)
    total = rest.agg(F.sum("size")).first()[0] or 0
    blocks = 1 if total <= block_bytes else -(-2 * total // block_bytes)
    while True:
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(blocks)))
        if blocks == 1 or dealt.groupBy("block").agg(F.sum("size").alias("s")).filter(F.col("s") > block_bytes).isEmpty():
            break
        blocks *= 2
    if large:
        places = benchmark.sparkSession.createDataFrame(packed, "_of long, _n int, _block long")
        own = owned.filter(apart).join(F.broadcast(places), (F.xxhash64("phrase") == F.col("_of")) & (F.octet_length("phrase") == F.col("_n")))
        dealt = dealt.withColumn("block", F.col("block") + large).unionByName(own.withColumn("block", F.col("_block")).drop("_of", "_n", "_block"))
    return dealt.select("block", "phrase", "items"), blocks + large


def search_shard(texts: list[bytes | None], phrases: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """Per document: its number of words, merged [start, end) word spans of phrase
    occurrences, and the items that own the phrases.

    Words that occur in no phrase become run ends, and runs shorter than the shortest phrase
    are left out, as nothing can occur there; the rest is indexed.
    """
    get = phrases.symbols.get
    coded, counts = [], []
    for text in texts:
        own = words(text)
        counts.append(len(own))
        ids = np.zeros(len(own) + 1, np.int32)  # a 0 after each document ends its last run
        ids[:-1] = np.fromiter(map(get, own, repeat(0)), np.int32, len(own))
        coded.append(ids)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    whole = np.concatenate(coded) if coded else np.zeros(0, np.int32)
    if not len(phrases.rows) or not whole.any():
        return counts, spans, items
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])])
    stops = np.flatnonzero(whole == 0)
    begins = np.concatenate([[0], stops[:-1] + 1])
    long = stops - begins >= phrases.shortest
    if not long.any():
        return counts, spans, items
    edge = np.zeros(len(whole) + 2, np.int32)
    np.add.at(edge, begins[long], 1)
    np.add.at(edge, stops[long] + 1, -1)
    kept = np.flatnonzero(np.cumsum(edge)[: len(whole)] > 0)

    index = FMIndex(whole[kept])
    low, high = index.search(phrases.rows, phrases.lengths)
    found = np.flatnonzero(high > low)
    if not len(found):
        return counts, spans, items
    sizes = (high - low)[found]
    phrase = np.repeat(found, sizes)
    rows = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low[found], sizes)
    starts = kept[index.locate(rows)]
    ends = starts + phrases.lengths[phrase]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    for d, p in set(zip(doc.tolist(), phrase.tolist())):
        items[d].update(phrases.items(p))
    order = np.lexsort((ends, starts))
    for d, a, b in zip(doc[order].tolist(), starts[order].tolist(), ends[order].tolist()):
        a, b = a - int(offsets[d]), b - int(offsets[d])
        own = spans[d]
        if own and a <= own[-1][1]:
            own[-1] = (own[-1][0], max(b, own[-1][1]))
        else:
            own.append((a, b))
    return counts, spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    one_in: int = 20,
    block_bytes: int = 32 << 20,
    blocks_at_once: int = 2,
    shard_bytes: int = 16 << 20,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Find benchmark phrases in documents.

    Returns the id column, n_words, n_hit, n_items, `items` (array of item ids as strings,
    sorted), `spans` (array of [start, end) word ranges to remove, merged), contaminated and
    `carried`, a struct of the columns named in `carry`, if any.  Contaminated means
    n_hit > 0 and one_in * n_hit >= n_words.

    Words are runs of ASCII letters, digits and characters beyond ASCII, lower-cased in A-Z.
    A phrase is `window` consecutive words of an item, or all words of a shorter one.  Each
    shard of about `shard_bytes` of text gets an FM-index: the phrases are searched backward
    through the ranks of a wavelet tree and located by sampled suffix positions.

    Words that occur in no phrase end the runs that are indexed, and runs shorter than the
    shortest phrase are left out of the index, as no phrase can occur there; so the index
    grows with what documents share with the benchmark's vocabulary.

    The benchmark's different phrases and their items are made on Spark and cut into blocks
    of at most `block_bytes`, measured.  The driver holds one block at a time, as Arrow
    columns, and broadcasts it; each takes one more pass over the documents within the same
    stage, and after `blocks_at_once` of them the documents are written and the broadcasts
    freed.  So neither the driver's nor a task's memory grows with the benchmark, and
    documents are not shuffled; the passes over documents are as many as blocks.

    Null texts have no words.  A null item id counts as the empty id.  Repeated rows, ties
    and null document ids give a row each; a text longer than a shard makes a shard of its
    own; an empty benchmark hits nothing; other columns are ignored.
    """
    spark = docs.sparkSession
    table, blocks = phrase_table(benchmark, item_col, item_text_col, window, block_bytes)
    source = keyed_text(docs, id_col, text_col, *([F.struct(*carry).alias("carried")] if carry else []))
    fixed = len(source.columns)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    found = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*source.schema.fields, *found])
    arrow_span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    out = source
    held = []
    for k in range(blocks):
        if len(held) == blocks_at_once:
            out = stored(out, "decontaminated")
            for b in held:
                b.destroy()
            held = []
        block = table.filter(F.col("block") == k).select("phrase", "items").toArrow()
        phrases = spark.sparkContext.broadcast(Phrases(block.column("phrase").to_pylist(), block.column("items").combine_chunks(), window))
        held.append(phrases)

        def search(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, shard_bytes):
                texts = batch.column(1).cast(pa.large_binary()).to_pylist()
                counts, spans, items = search_shard(texts, phrases.value)
                if batch.num_columns > fixed:
                    before = batch.column(fixed + 1).to_pylist(), batch.column(fixed + 2).to_pylist()
                    spans = [_merged(s + [(x["start"], x["end"]) for x in old]) for s, old in zip(spans, before[0])]
                    items = [s | set(old) for s, old in zip(items, before[1])]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in range(fixed)),
                        pa.array(counts, pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(arrow_span)),
                        pa.array([sorted(s, key=str.encode) for s in items], pa.list_(pa.string())),
                    ],
                    names=schema.names,
                )

        out = out.mapInArrow(search, schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return out.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        "spans",
        ((n_hit > 0) & (one_in * n_hit >= F.col("n_words"))).alias("contaminated"),
        *source.columns[2:],
    )
