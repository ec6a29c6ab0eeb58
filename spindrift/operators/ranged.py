"""Keyed tables whose writes cost the ranges of keys that they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import discard, settled
from . import keyed

#: Partition column of the table's folder.
RANGE = "_range"


class RangedTable:
    """A Parquet folder partitioned by ranges of its key, with idempotent keyed writes.

    A write finds the ranges of its rows, reads and rewrites those alone (partition pruning,
    dynamic partition overwrite), and leaves the files of all others as they are.  Bounds are
    measured when the table is made and lie beside it, one row a range; `rebalanced` makes
    them anew when ranges have grown apart.  Key columns compare in their order, nulls first;
    rows with a null in the key are distinct from all others, as in a unique index.

    Each range is replaced by a rename when it is whole.  A write that fails between two
    ranges is repeated: the same rows change nothing the second time.  Two writers of one
    table need a lease (see `Store.lease`).
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _ranges(self) -> DataFrame:
        """The rows with their range; an empty table has a schema as well."""
        kept = self.spark.read.parquet(f"{self.path}/schema").schema
        return self.spark.read.schema(kept.add(RANGE, T.IntegerType())).parquet(f"{self.path}/rows")

    @classmethod
    def create(cls, path: str, df: DataFrame, keys: list[str], ranges: int = 200) -> RangedTable:
        """Write `df`, one row a key, in ranges of about equal size."""
        self = cls(df.sparkSession, path, keys)
        df.limit(0).write.parquet(f"{self.path}/schema")
        parted = settled(df.repartitionByRange(ranges, *keys).withColumn(RANGE, F.spark_partition_id()), "ranged")
        bounds = parted.groupBy(RANGE).agg(F.min(F.struct(*keys)).alias("low")).select("low")
        bounds.coalesce(1).write.parquet(f"{self.path}/bounds")
        parted.drop(RANGE).withColumn(RANGE, self._range_of()).write.partitionBy(RANGE).parquet(f"{self.path}/rows")
        discard(parted)
        return self

    def _range_of(self) -> Column:
        """The number of bounds up to a row's key; the bounds are one row a range, read once."""
        bounds = self.spark.read.parquet(f"{self.path}/bounds")
        kind = bounds.schema["low"].dataType
        lows = sorted((tuple(r.low) for r in bounds.collect()), key=lambda k: tuple((v is not None, v) for v in k))
        own = F.struct(*(F.col(k).cast(f.dataType).alias(f.name) for k, f in zip(self.keys, kind.fields)))

        def place(first: int, last: int) -> Column:
            """Binary search, as nested conditions: the comparisons of a row are log(ranges)."""
            if first >= last:
                return F.lit(first)
            middle = (first + last) // 2
            low = F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(lows[middle], kind.fields)))
            return F.when(low <= own, place(middle + 1, last)).otherwise(place(first, middle))

        return F.greatest(place(0, len(lows)) - 1, F.lit(0)) if lows else F.lit(0)

    def rows(self) -> DataFrame:
        return self._ranges().drop(RANGE)

    def _touched(self, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of `incoming` with their range, and the table's rows in these ranges."""
        placed = incoming.withColumn(RANGE, self._range_of())
        numbers = [r[0] for r in placed.select(RANGE).distinct().collect()]  # at most one a range
        return placed, self._ranges().filter(F.col(RANGE).isin(numbers))

    def _replace(self, ranges: DataFrame) -> None:
        whole = settled(ranges, "ranges")
        whole.repartition(RANGE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RANGE).parquet(f"{self.path}/rows")
        discard(whole)

    def upsert(self, incoming: DataFrame, order: str, updated: list[str]) -> None:
        """Insert the rows, or write `updated` over those of the same key, in `order`."""
        placed, current = self._touched(incoming)
        self._replace(keyed.upsert(current, placed, [*self.keys, RANGE], order, updated))

    def insert_or_ignore(self, incoming: DataFrame, *order: Column | str) -> None:
        """Append the first row of each key that the table does not have.  Nothing is
        rewritten: a touched range gets one more file."""
        placed, current = self._touched(incoming)
        fresh = settled(keyed.insert_or_ignore(current, placed, [*self.keys, RANGE], *order).select(*current.columns), "fresh")
        fresh.repartition(RANGE).write.mode("append").partitionBy(RANGE).parquet(f"{self.path}/rows")
        discard(fresh)

    def update(self, keys: DataFrame, **values: Column) -> None:
        """Replace columns in the rows whose key `keys` has."""
        placed, current = self._touched(keys.select(*self.keys))
        marked = keyed.mark_exists(current, placed, self.keys, "_hit")
        self._replace(keyed.update_where(marked, F.col("_hit"), **values).drop("_hit"))

    def rebalanced(self, path: str, ranges: int = 200) -> RangedTable:
        """The same rows at another place, in ranges of equal size again."""
        return RangedTable.create(path, self.rows(), self.keys, ranges)
