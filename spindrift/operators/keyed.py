"""Keyed writes on DataFrames: insert or ignore, upsert, first and last rows, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One whole row for each key, the first in `order`.

    A partial aggregate of the least (order, row) struct, so that each task sends one row a
    key: a key with a third of all rows costs no more than any other.
    """
    ranks = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{k}") for k, o in enumerate(order)]
    rest = [c for c in df.columns if c not in keys]
    row = F.min(F.struct(*ranks, F.struct(*rest).alias("row"))).alias("_first") if rest else F.count("*").alias("_first")
    grouped = df.groupBy(*keys).agg(row)
    return grouped.select(*(F.col(f"_first.row.{c}").alias(c) if c in rest else F.col(c) for c in df.columns))


#: Most copies of a row that one array of `_repeated` stands for.
_BLOCK = 1 << 16


def _loose(keys: list[str], columns: list[str]) -> Column:
    """Null for rows with a whole key; else the row itself, which is then its own group."""
    nulls = sum((F.col(k).isNull().cast("int") for k in keys), F.lit(0)) > 0
    return F.when(nulls, F.struct(*columns))


def _repeated(df: DataFrame) -> DataFrame:
    """Groups of equal loose rows as so many rows again, in two steps, so that no array grows
    with the number of copies but for one entry in 65,536."""
    n = F.when(F.col("_loose").isNull(), F.lit(1)).otherwise(F.col("_n"))
    blocks = df.withColumn("_left", F.explode(F.sequence(n, F.lit(1), F.lit(-_BLOCK))))
    return blocks.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), F.least(F.col("_left"), F.lit(_BLOCK)).cast("int"))))


def insert_or_ignore(target: DataFrame, incoming: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Rows of `incoming` to append: the first of each key that `target` does not have.

    Null keys are distinct from each other and from all others, as in a unique index.  They
    pass the same aggregate as the others, as groups of equal rows that are counted, so
    `incoming` is computed once.
    """
    ranks = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{k}") for k, o in enumerate(order)]
    rest = [c for c in incoming.columns if c not in keys]
    first = F.min(F.struct(*ranks, F.struct(*rest).alias("row")) if rest else F.lit(0)).alias("_first")
    grouped = incoming.withColumn("_loose", _loose(keys, incoming.columns)).groupBy(*keys, "_loose").agg(first, F.count("*").alias("_n"))
    fresh = _repeated(grouped.join(target.select(*keys), keys, "left_anti"))
    return fresh.select(*(F.col(f"_first.row.{c}").alias(c) if c in rest else F.col(c) for c in incoming.columns))


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], order: str, updated: list[str]) -> DataFrame:
    """`target` after the rows of `incoming` were inserted or, where the key exists, had
    their `updated` columns written over it, in the order of `order`.

    Columns that are not updated keep the value of the first row of the key, the target's
    row coming before all.  Rows with a null in the key are distinct from all others, as in
    a unique index: they are inserted.  Both sides have the columns of `target`; `incoming` has `order`
    as well.  One aggregate by key: no join, one row a key and task is shuffled, and either
    side is computed once.
    """
    columns = target.columns
    kept = [c for c in columns if c not in keys and c not in updated]
    both = target.select(*columns, F.lit(0).alias("_side"), F.lit(None).cast(incoming.schema[order].dataType).alias("_at")).unionByName(
        incoming.select(*columns, F.lit(1).alias("_side"), F.col(order).alias("_at"))
    )
    place = [F.col("_side").alias("s"), F.col("_at").alias("a")]
    merged = both.withColumn("_loose", _loose(keys, columns)).groupBy(*keys, "_loose").agg(
        F.min(F.struct(*place, F.struct(*kept).alias("row")) if kept else F.lit(0)).alias("_first"),
        F.max(F.struct(*place, F.struct(*updated).alias("row")) if updated else F.lit(0)).alias("_last"),
        F.count("*").alias("_n"),
    )
    return _repeated(merged).select(*(F.col(c) if c in keys else F.col(f"_last.row.{c}").alias(c) if c in updated else F.col(f"_first.row.{c}").alias(c) for c in columns))


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """`df` with columns replaced in the rows where the condition holds."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def apply_overrides(df: DataFrame, overrides: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """`df` with the columns that `overrides` sets for a key in their place."""
    given = overrides.select(*keys, F.struct(*columns).alias("_given"))
    joined = df.join(given, keys, "left")
    return joined.select(*(F.when(F.col("_given").isNotNull(), F.col(f"_given.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(~F.coalesce(condition, F.lit(False)))


def consume_once(requests: DataFrame, key: str, order: str, valid: Column) -> DataFrame:
    """The first valid request of each key: compare-and-set of one-time values."""
    return first_by(requests.filter(valid), [key], order)


def mark_exists(df: DataFrame, other: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`df` with a flag that tells whether `other` has its key.  `other` is reduced to its
    distinct keys first, so no row of `df` is repeated."""
    flags = other.select(*keys).distinct().withColumn("_there", F.lit(True))
    return df.join(flags, keys, "left").withColumn(name, F.coalesce("_there", F.lit(False))).drop("_there").select(*df.columns, name)


def numbered(df: DataFrame, order: list[Column | str], name: str = "position", by: list[str] | None = None) -> DataFrame:
    """`df` with each row's position from 0 in a total order.

    Within `by`, a window.  Over the whole table no single task may sort everything: rows
    are range-partitioned and sorted, partitions are counted, and each row adds the counts
    before its partition, of which there are as many as partitions.  The sorted rows are
    written to the checkpoint folder, so that both passes see the same partitions.
    """
    if by is not None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1)
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row"))
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        import tempfile

        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="checkpoint-"))
    parted = parted.checkpoint()
    counts = parted.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_from"))
    before = counts.select("_part", "_from", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = parted.join(F.broadcast(before), "_part")
    return joined.withColumn(name, F.col("_row") - F.col("_from") + F.col("_before")).select(*df.columns, name)


def chunked(df: DataFrame, size: int, order: list[Column | str], by: list[str] | None = None, name: str = "chunk") -> DataFrame:
    """`df` with the number of each row's chunk of `size` rows in order."""
    return numbered(df, order, "_position", by).withColumn(name, F.floor(F.col("_position") / size).cast("long")).drop("_position")


def three_way_split(items: DataFrame, existing: DataFrame, key: str, order: str, allowed: Column) -> DataFrame:
    """First occurrence of each key with `bucket`: rejected, else present, else add."""
    first = first_by(items.withColumn("_allowed", F.coalesce(allowed, F.lit(False))), [key], order)
    marked = mark_exists(first, existing, [key], "_present")
    bucket = F.when(~F.col("_allowed"), F.lit("rejected")).when(F.col("_present"), F.lit("present")).otherwise(F.lit("add"))
    return marked.withColumn("bucket", bucket).drop("_allowed", "_present")
