"""SimHash near-duplicate detection with Golay-code fuzzy keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import golay
from .common import keyed_text, slices, stored
from .components import connected_components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A fingerprint's three segments as (first bit, width); each fits a Golay word.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 3
#: Fingerprints of one bucket that a task compares at once.
BUCKET = 4096


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 for a text without words."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    spans = zip((ends - sizes)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, n)
    sums = np.zeros(64, np.int64)
    for at in range(0, n, 255_000):
        bits = np.unpackbits(hashes[at : at + 255_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(sums * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The id column and `fp`, the fingerprint as a signed long."""
    source = keyed_text(docs, id_col, text_col)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return source.mapInArrow(compute, T.StructType([source.schema[0], T.StructField("fp", T.LongType())]))


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, place of the fingerprint of each) such that any two fingerprints that differ
    in at most three bits share a key.

    With three errors over three segments either some segment is intact and another has at
    most one error, or each segment has exactly one.  In the first case the key is the
    intact segment with a Golay index of the other: words one bit apart differ in parity, so
    the even one takes the index of each word within one bit of it and the odd one only its
    own.  In the second case one half of each segment is intact, and the key is the three
    halves, in all eight choices.
    """
    fps = fps.view(np.uint64)
    parts = [(fps >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64) for first, width in SEGMENTS]
    keys, places = [], []
    rows = np.arange(len(fps))
    near = []
    for part, (_, width) in zip(parts, SEGMENTS):
        found = golay.nearby(part, width).astype(np.int64)
        odd = np.bitwise_count(part) % 2 == 1
        found[odd] = found[odd, :1]
        found.sort(axis=1)
        fresh = np.ones(found.shape, bool)
        fresh[:, 1:] = found[:, 1:] != found[:, :-1]
        place, column = np.nonzero(fresh)
        near.append((place, found[place, column]))
    table = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                place, index = near[j]
                keys.append(np.int64(table) << 40 | parts[i][place] << 12 | index)
                places.append(place)
                table += 1
    halves = [(part & 0x7FF, part >> 11) for part in parts]
    for choice in range(8):
        a, b, c = (halves[k][choice >> k & 1] for k in range(3))
        keys.append(np.int64(table) << 40 | a << 22 | b << 11 | c)
        places.append(rows)
        table += 1
    return np.concatenate(keys), np.concatenate(places)


def stars(members: np.ndarray) -> list[tuple[int, int]]:
    """Links (member, least member) of each component among distinct fingerprints."""
    rest = np.sort(members.view(np.uint64))
    out = []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        root = front[0]
        while len(front) and len(rest):
            close = np.zeros(len(rest), bool)
            for f in front:
                close |= np.bitwise_count(rest ^ f) <= MAX_BITS
            front, rest = rest[close], rest[~close]
            out += [(f, root) for f in front]
    return out


def _bucket_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of rows sorted by key; a large bucket gives stars only."""
    keep = np.ones(len(keys), bool)
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    keep[1:] = (keys[1:] != keys[:-1]) | (fps[1:] != fps[:-1])
    keys, fps = keys[keep], fps[keep]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(keys)))
    us, vs = [], []
    for d in range(1, 8):
        i = np.flatnonzero(keys[:-d] == keys[d:]) if len(keys) > d else np.zeros(0, np.int64)
        if not len(i):
            break
        small = sizes[np.searchsorted(starts, i, side="right") - 1] <= 8
        i = i[small]
        i = i[np.bitwise_count(fps[i].view(np.uint64) ^ fps[i + d].view(np.uint64)) <= MAX_BITS]
        us.append(fps[i])
        vs.append(fps[i + d])
    for s, n in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist()):
        found = np.array(stars(fps[s : s + n]), np.uint64).reshape(-1, 2).view(np.int64)
        us.append(found[:, 0])
        vs.append(found[:, 1])
    empty = np.zeros(0, np.int64)
    return np.concatenate(us) if us else empty, np.concatenate(vs) if vs else empty


_ROWS = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("key", T.LongType())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) in key order.  Gives links (u, v, null); a bucket of more than BUCKET
    rows is passed on as (fp, null, key) instead, piece by piece, to be split."""

    def links(keys, fps):
        u, v = _bucket_links(keys, fps)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], schema=schema)

    def passed(keys, fps):
        return pa.RecordBatch.from_arrays([pa.array(fps), pa.nulls(len(fps), pa.int64()), pa.array(keys)], schema=schema)

    schema = pa.schema([(n, pa.int64()) for n in ("u", "v", "key")])
    held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
    split_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([held_k, batch.column(0).to_numpy()])
        fps = np.concatenate([held_f, batch.column(1).to_numpy()])
        if split_key is not None:  # the rest of a large bucket
            n = int(np.searchsorted(keys, split_key, side="right"))
            if n:
                yield passed(keys[:n], fps[:n])
            keys, fps = keys[n:], fps[n:]
            if len(keys):
                split_key = None
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        large = np.repeat(sizes > BUCKET, sizes)
        last = starts[-1] if len(starts) else 0
        if len(keys) and large[-1]:
            split_key, last = keys[-1], len(keys)
        ready = np.zeros(len(keys), bool)
        ready[:last] = True
        if (ready & large).any():
            yield passed(keys[ready & large], fps[ready & large])
        if (ready & ~large).any():
            yield links(keys[ready & ~large], fps[ready & ~large])
        held_k, held_f = keys[last:], fps[last:]
    if len(held_k):
        yield links(held_k, held_f)


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) between fingerprints of `distinct` (fp) whose components are those of
    all pairs that differ in at most three bits; not every pair is listed."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fps = batch.column(0).slice(at, 20_000).to_numpy()
                keys, places = fuzzy_keys(fps)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[places])], names=["key", "fp"])

    rows = distinct.select("fp").mapInArrow(keyed, "key long, fp long")
    links, level = None, 0
    while True:
        found = stored(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_compare, _ROWS), "links")
        own = found.filter("key IS NULL").select("u", "v")
        links = own if links is None else links.unionByName(own)
        large = found.filter("key IS NOT NULL").select("key", F.col("u").alias("fp")).distinct()
        if large.isEmpty():
            return links.distinct()
        # Of four parts of the bits, three errors leave one intact: a large bucket is dealt by
        # each part, in another choice of parts each round, until no bucket is large.
        parts = F.array(*(F.xxhash64("key", F.lit(4 * level + k), F.col("fp").bitwiseAND(F.lit(mask))) for k, mask in enumerate(quarters(level))))
        rows = large.select(F.explode(parts).alias("key"), "fp")
        level += 1


def quarters(level: int) -> list[int]:
    """Four masks of 16 bits that together cover 64, as signed longs; another choice each level."""
    order = np.random.default_rng(level).permutation(64)
    masks = np.array([sum(1 << int(b) for b in order[k : k + 16]) for k in range(0, 64, 16)], np.uint64)
    return masks.view(np.int64).tolist()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Group documents whose SimHash fingerprints are linked.

    Returns the id column, `fp` (the fingerprint as a signed long) and component_id, the
    least id reachable over links of three or fewer differing bits, itself included.

    Equal fingerprints are first pre-aggregated to one row, so copies cost nothing more.
    Distinct fingerprints get some thirty keys each (see `fuzzy_keys`); rows of one key meet
    in one place, are verified bit by bit and give links, whose components are found by
    star steps.  Nothing but round checksums reaches the driver.

    Null and empty texts have the fingerprint zero and link like any other.  Repeated rows
    each get a row; a null id gets the component of its fingerprint, which is null only if
    it has no other id.  A text of any length is one fingerprint.  An empty table gives an empty result; other columns are ignored.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min(id_col).alias("least_id")), "nodes")
    roots = connected_components(near_links(nodes))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    ids = stored(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "ids")
    return fps.join(rooted.join(ids, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row of each near-duplicate group of `docs`, with all columns.

    The row with the least id stays; of several rows with that id the one with the least
    digest of its columns, so that the choice does not depend on the order of rows.  Rows
    without an id come after all others.  Rows of one id with different texts are judged each
    by itself: both stay unless they are near copies.  Rows that are equal in all columns
    count as one.  An empty table gives an empty result; a null text is the empty text.
    """
    hashable = [c for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
    digest = F.concat_ws(":", F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("\x00"))), F.xxhash64(*hashable).cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), digest.alias("digest"))
    grouped = near_duplicates(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", shingle)
    chosen = grouped.select("key.digest", F.col("component_id.digest").alias("least")).filter("digest = least").select("digest").distinct()
    rows = docs.select(digest.alias("digest"), F.struct(*docs.columns).alias("row"))
    return rows.join(chosen, "digest", "left_semi").dropDuplicates(["digest"]).select("row.*")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
