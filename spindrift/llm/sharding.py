"""Placement of rows in shards through a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(text: str) -> int:
    """The first 60 bits of the MD5 digest, as `row_number_of` takes them of a key."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int) -> list[int]:
    """For each slot the index of its shard.

    Every shard prefers the slots in the order offset, offset + skip, offset + 2 skip, ...
    modulo the prime size, both numbers taken from its name.  The shards take turns, each
    claiming the first slot of its order that is still free, until all are claimed.  So
    shares differ by one slot at most, and adding or removing a shard moves few slots.
    """
    if not is_prime(size) or size < len(shards) or len(set(shards)) != len(shards) or not shards:
        raise ValueError("the size must be a prime of at least the number of distinct shards")
    place = [_number(f"{s}/offset") % size for s in shards]
    skip = [_number(f"{s}/skip") % (size - 1) + 1 for s in shards]
    table = [-1] * size
    claimed = 0
    while True:
        for k in range(len(shards)):
            while table[place[k]] >= 0:
                place[k] = (place[k] + skip[k]) % size
            table[place[k]] = k
            claimed += 1
            if claimed == size:
                return table


def slot_of(key: Column, size: int) -> Column:
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(size)).cast("long")


def assign_shards(df: DataFrame, shards: list[str], key_col: str = "doc_id", size: int = 2039, slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """`df` with the slot of its key and the shard that holds the slot.

    The table has `size` entries, whatever the data, and is broadcast; a row is placed by
    one hash and one lookup, without a shuffle.  Columns of `df` that have the names of the
    two new ones are replaced.  Equal keys share a shard; a null key counts as the empty
    text; an empty table gives an empty result.  `size` should be a prime of a hundred times
    the number of shards or more.
    """
    if len({key_col, slot_name, shard_name}) < 3:
        raise ValueError("the key, the slot and the shard need different column names")
    spark = df.sparkSession
    rows = [(slot, shards[k]) for slot, k in enumerate(lookup_table(shards, size))]
    table = spark.createDataFrame(rows, f"`{slot_name}` long, `{shard_name}` string")
    kept = df.drop(slot_name, shard_name)
    return kept.withColumn(slot_name, slot_of(F.col(key_col), size)).join(F.broadcast(table), slot_name).select(*kept.columns, slot_name, shard_name)


def write_shards(placed: DataFrame, path: str, shard_name: str = "shard") -> None:
    """One folder of Parquet files for each shard; each task writes to the shards it has, so
    no shard is gathered in one place."""
    placed.write.partitionBy(shard_name).parquet(path)
