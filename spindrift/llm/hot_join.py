"""A left join that a hot key cannot unbalance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than this share of all weight are hot; by counting there are fewer than its inverse.
HOT_PARTS = 2_000


def join_by_weight(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, salt: list[str] | None, parts: int = HOT_PARTS) -> DataFrame:
    """`rows` LEFT JOIN `table`, which has one row for each key and, in `weight`, how many
    rows have it.

    Keys with over 1 / `parts` of the total weight are fewer than `parts`, whatever the size
    of the data: these are broadcast.  The others are joined by a shuffle in which none has
    more than that share; rows that the broadcast has answered spread over all its
    partitions by the columns of `salt`, as their answer is known.  Without a salt, `rows`
    are read twice, once for each kind of key, and only those of other keys are shuffled:
    better where most rows are hot and making them is cheap.  `table` is read three times,
    so it should be a written one.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    rest = [c for c in table.columns if c not in keys]
    is_hot = F.col(weight) * parts > F.lit(total)
    known = F.struct(*rest)
    hot = table.filter(is_hot).select(*keys, known.alias("_hot"))
    cold = table.filter(~is_hot).select(*keys, known.alias("_cold"), F.lit(0).cast("long").alias("_salt"))
    answered = rows.join(F.broadcast(hot), keys, "left")
    if salt is None:
        rows_hot = answered.filter(F.col("_hot").isNotNull()).select(*rows.columns, *(f"_hot.{c}" for c in rest))
        rows_cold = answered.filter(F.col("_hot").isNull()).drop("_hot").join(cold.drop("_salt"), keys, "left")
        return rows_hot.unionByName(rows_cold.select(*rows.columns, *(f"_cold.{c}" for c in rest)))
    spread = F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(*salt), F.lit(1 << 20))).otherwise(F.lit(0).cast("long"))
    joined = answered.withColumn("_salt", spread).join(cold, [*keys, "_salt"], "left")
    return joined.select(*rows.columns, *(F.coalesce(f"_hot.{c}", f"_cold.{c}").alias(c) for c in rest))
