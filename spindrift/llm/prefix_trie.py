"""The trie of conversation prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .hot_join import join_by_weight

#: A bucket is local from this many distinct sequences down, or from this part of all.
LOCAL_SEQUENCES, LOCAL_PARTS = 200, 20_000
#: Turns that a task gathers before it works them off.
GATHERED_TURNS = 100_000
#: Characters of joined ids in one row.
PART_CHARS = 1 << 16
#: White space between words.
BLANKS = "\\x20\\x09-\\x0D"

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
LARGE = "path string, above string, top long, depth long, n_convs long, conv_id long, up long, words array<long>"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def encoded_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, words): each conversation's turns in order, as dictionary codes with
    the words of their texts.

    The dictionary has one code for each distinct (role, text), recognised by 128 bits of
    SHA-256.  Only digests are shuffled; frequent turns meet their codes in a broadcast.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    words = F.regexp_count(text, F.lit(f"[^{BLANKS}]+"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("_turn"), F.substring(F.sha2(whole, 256), 1, 32).alias("_digest"), words.alias("_words")
    )
    codes = turns.groupBy("_digest").agg(F.count("*").alias("_n")).withColumn("_id", F.monotonically_increasing_id())
    codes = stored(codes, "turn-codes")
    coded = join_by_weight(turns, codes, ["_digest"], "_n", ["conv_id", "_turn"])
    row = F.sort_array(F.collect_list(F.struct("_turn", "_digest", "_id", "_words")))
    listed = coded.groupBy("conv_id").agg(row.alias("_rows"))
    return listed.select("conv_id", F.col("_rows._id").alias("ids"), F.col("_rows._words").alias("words"))


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Conversations that start as the first of their `group` does: h turns from there, then
    their own after the first h, where h is the CRC-32 of the id modulo `heads`."""
    first = F.col("conv_id") - F.col("conv_id") % group
    start = turns.filter(first == F.col("conv_id")).select(F.col("conv_id").alias("_base"), *(F.slice(c, 1, heads - 1).alias(f"_{c}") for c in ("ids", "words")))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    joined = turns.withColumn("_base", first).withColumn("_h", h).join(start, "_base", "left")

    def joint(c: str) -> Column:
        own = F.slice(c, F.col("_h") + 1, F.greatest(F.size(c) - F.col("_h"), F.lit(0)))
        return F.concat(F.coalesce(F.slice(f"_{c}", 1, F.col("_h")), F.slice(c, 1, 0)), own).alias(c)

    return joined.select("conv_id", joint("ids"), joint("words"))


def _member_digests(members: DataFrame) -> DataFrame:
    """(seq, ends): SHA-256 of each sequence's conversation ids, in order and comma-joined.

    Ids are range-partitioned by sequence and id, so a sequence of any number of members is
    sorted by many tasks; each joins its ids to strings, and a digest reads only those.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, first, own, size = None, 0, [], 0

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([first], pa.int64()), pa.array([",".join(own)])], names=["seq", "first", "part"])

        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != seq or size > PART_CHARS:
                    if own:
                        yield part()
                    seq, first, own, size = s, c, [], 0
                own.append(str(c))
                size += len(own[-1])
        if own:
            yield part()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, state = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for s, p in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if s == seq:
                    state.update(f",{p}".encode())
                else:
                    if seq is not None:
                        done.append((seq, state.hexdigest()))
                    seq, state = s, hashlib.sha256(p.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=["seq", "ends"])
        if seq is not None:
            yield pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([state.hexdigest()])], names=["seq", "ends"])

    parts = members.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(join, "seq string, first long, part string")
    return parts.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(digest, "seq string, ends string")


class Bucket:
    """Distinct sequences that share their first `depth` turns, and the nodes below."""

    def __init__(self, depth: int, up: int, rows: list[tuple]):
        #: Of a row: ids, words, number and least of the conversations, digest of their ids.
        self.rows = rows
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.conv: list[int] = []
        self.up = up
        self.n: list[int] = []
        self.saved: list[int] = []
        self.ends: list[str] = []
        self._split(depth, rows)

    def _node(self, parent: int, depth: int, rows: list[tuple]) -> int:
        n = sum(r[2] for r in rows)
        self.parent.append(parent)
        self.depth.append(depth)
        self.n.append(n)
        self.conv.append(min(r[3] for r in rows))
        self.saved.append((n - 1) * rows[0][1][depth - 1])
        self.ends.append(NO_ENDS)
        return len(self.n) - 1

    def _split(self, depth: int, rows: list[tuple]) -> None:
        """Multikey quicksort: rows are split in three by the turn at one place, and the
        equal part, which is a node, goes on at the next place.  The stack is a list, so
        conversations may be long."""
        open_ = [(self._node(-1, depth, rows), depth, rows)]
        while open_:
            parent, depth, rows = open_.pop()
            longer = []
            for r in rows:
                if len(r[0]) == depth:
                    self.ends[parent] = r[4]
                else:
                    longer.append(r)
            todo = [longer] if longer else []
            while todo:
                rows = todo.pop()
                pivot = rows[len(rows) // 2][0][depth]
                less = [r for r in rows if r[0][depth] < pivot]
                more = [r for r in rows if r[0][depth] > pivot]
                same = [r for r in rows if r[0][depth] == pivot] if less or more else rows
                todo += [x for x in (less, more) if x]
                open_.append((self._node(parent, depth + 1, same), depth + 1, same))

    def nodes(self) -> Iterator[tuple]:
        """Rows of NODE; a node follows its parent in the lists, so sums go from the end."""
        size = len(self.n)
        children, leaves = [0] * size, [0] * size
        for k in range(size - 1, -1, -1):
            leaves[k] = leaves[k] or 1
            p = self.parent[k]
            if p >= 0:
                children[p] += 1
                leaves[p] += leaves[k]
                self.saved[p] += self.saved[k]
        for k in range(size):
            p = self.parent[k]
            yield self.conv[k], self.depth[k], self.conv[p] if p >= 0 else self.up, self.n[k], children[k], leaves[k], self.saved[k], self.ends[k]


def _local_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of sorted buckets; `above` names the parent bucket in the row of a bucket's top."""
    bucket, rows, turns = None, [], 0
    out: list[tuple] = []
    head: tuple = ()

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=LOCAL_NAMES)

    def finish() -> None:
        depth, above, up = head
        for k, node in enumerate(Bucket(depth, up, rows).nodes()):
            out.append((*node, above if k == 0 else None))

    for batch in batches:
        for b, depth, above, up, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if b != bucket:
                if rows:
                    finish()
                    turns += sum(len(r[0]) for r in rows)
                    if turns > GATHERED_TURNS:
                        yield flush()
                        turns = 0
                bucket, rows, head = b, [], (depth, above, up)
            rows.append(tuple(row))
    if rows:
        finish()
    if out:
        yield flush()


LOCAL_NAMES = [f.split()[0] for f in NODE.split(", ")] + ["above"]


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of large buckets with the sums of what is below them, deepest first.  A
    bucket stands for a chain of nodes, from `top` to `depth`, with the same members."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    of = {r["path"]: r for r in rows}
    out = []
    for r in sorted(rows, key=lambda r: -r["depth"]):
        children, leaves, saved, ends = r["n_children"], r["n_leaves"] or 1, r["saved_tokens"], r["ends_sha256"]
        for depth in range(r["depth"], r["top"] - 1, -1):
            saved += (r["n_convs"] - 1) * r["words"][depth - r["top"]]
            out.append((r["conv_id"], depth, r["conv_id"] if depth > r["top"] else r["up"], r["n_convs"], children, leaves, saved, ends))
            children, ends = 1, NO_ENDS
        if r["above"] is not None:
            parent = of[r["above"]]
            parent["n_children"] += 1
            parent["n_leaves"] += leaves
            parent["saved_tokens"] += saved
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "ends_sha256" else pa.int64()) for n, c in zip(LOCAL_NAMES, zip(*out))], names=LOCAL_NAMES[:-1])


def prefix_trie(sequences: DataFrame, local_sequences: int = LOCAL_SEQUENCES) -> DataFrame:
    """One row for each node of the trie of `sequences` (conv_id, ids, words).

    A node is a sequence of the first d ids; conversations that start with it are its
    members.  Columns: conv_id, the least member; depth; parent_conv_id, the parent's
    conv_id, null for the root; n_convs; n_children; n_leaves; saved_tokens, over the subtree
    the words of each node's last turn for all members but one; ends_sha256 of the members
    that end there.

    Equal sequences are merged first, so copies of any number are one row.  Radix
    partitioning deals sequences by one id after the other, from the first: a bucket of more
    than `local_sequences` and of more than 1 / 20,000 of all is dealt again, by the id after
    the longest prefix that all its sequences share, so there are rounds for branches only.
    A round has fewer than 20,000 such buckets, which are broadcast.  The other buckets are
    sorted in tasks, which emit their nodes; large buckets become nodes when those below are
    summed.

    A conversation is held as a whole, 16 bytes a turn, and so is a bucket; groups of copies
    and large buckets never are.  An empty table gives no node.
    """
    seq = F.substring(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256), 1, 32)
    members = stored(sequences.select("conv_id", "ids", "words", seq.alias("seq")), "trie-members")
    merged = members.groupBy("seq", "ids", "words").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    merged = merged.join(_member_digests(members.select("seq", "conv_id")), "seq")
    active = stored(merged.select("ids", "words", "n", "conv_id", "ends", F.lit("").alias("path")), "trie-sequences")
    whole = active.agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id")).first()
    spark = sequences.sparkSession
    if not whole["rows"]:
        return spark.createDataFrame([], NODE)
    limit = max(local_sequences, whole["rows"] // LOCAL_PARTS)
    row = ["ids", "words", "n", "conv_id", "ends"]
    active = active.withColumns({"up": F.lit(whole["conv_id"]).cast("long"), "depth": F.lit(0)})
    root = spark.createDataFrame([("", None, 0, 0, whole["n"], whole["conv_id"], None, [0])], LARGE)
    tops, ended, local = [root], [], []
    while True:
        ended.append(active.filter(F.size("ids") == F.col("depth")).select("path", "ends"))
        down = active.filter(F.size("ids") > F.col("depth")).withColumn("above", F.col("path"))
        step = F.concat_ws(":", "above", F.get("ids", F.col("depth")).cast("string"))
        down = down.withColumns({"path": F.substring(F.sha2(step, 256), 1, 32), "depth": F.col("depth") + 1})
        found = down.groupBy("path").agg(F.count("*").alias("_rows"), *(F.min(c).alias(c) for c in ("above", "depth", "conv_id", "up")), F.sum("n").alias("n_convs"))
        heavy = stored(found.filter(F.col("_rows") > limit), "trie-heavy")
        if heavy.isEmpty():
            local.append(down.select("path", "depth", "above", "up", *row))
            break
        dealt = stored(down.join(F.broadcast(heavy.select("path", F.col("conv_id").alias("_up"))), "path", "left"), "trie-dealt")
        local.append(dealt.filter(F.col("_up").isNull()).select("path", "depth", "above", "up", *row))
        again = dealt.filter(F.col("_up").isNotNull()).select(*row, "path", F.col("_up").alias("up"))
        ends = again.groupBy("path").agg(F.min("ids").alias("_low"), F.max("ids").alias("_high"), F.min_by("words", "ids").alias("_words"))
        shared = F.array_position(F.zip_with("_low", "_high", lambda a, b: a.eqNullSafe(b)), False) - 1
        chains = heavy.join(ends.select("path", shared.cast("int").alias("_shared"), "_words"), "path")
        chains = chains.select("path", "above", F.col("depth").cast("long").alias("top"), F.col("_shared").cast("long").alias("depth"), "n_convs", "conv_id", "up", F.slice("_words", F.col("depth"), F.col("_shared") - F.col("depth") + 1).cast("array<long>").alias("words"))
        large = stored(chains, "trie-large")
        tops.append(large)
        active = again.join(F.broadcast(large.select("path", F.col("depth").cast("int").alias("depth"))), "path")

    union = lambda parts: reduce(DataFrame.unionByName, parts)
    below = union(local).repartition("path").sortWithinPartitions("path").mapInArrow(_local_nodes, f"{NODE}, above string")
    below = stored(below, "trie-nodes")
    sums = below.filter(F.col("above").isNotNull()).groupBy(F.col("above").alias("path")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    upper = union(tops).join(sums, "path", "left").join(union(ended), "path", "left")
    filled = upper.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_children", "n_leaves", "saved_tokens")}).withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS))).drop("ends")
    above = filled.coalesce(1).mapInArrow(_sum_up, NODE)
    return below.drop("above").unionByName(above)


def conversation_trie(conversations: DataFrame, local_sequences: int = LOCAL_SEQUENCES) -> DataFrame:
    """The nodes of `prefix_trie` over rebuilt conversations (conv_id, turn, role, text).

    Turns go by their number, those without one first and equal ones by a digest of role and
    text, repeated rows included.  A null role or text is empty; a row without conv_id belongs
    to no conversation; texts of any length are digested whole; other columns are ignored.
    """
    return prefix_trie(rebuilt(encoded_turns(conversations)), local_sequences)
