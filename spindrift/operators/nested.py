"""Children as ordered arrays, and nested documents as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_children(children: DataFrame, keys: list[str], order: list[str], fields: list[Column | str], name: str = "children") -> DataFrame:
    """One row a parent with its children as an array of structs in order.

    The array is a feature of the result: a parent's children make one value, so they must
    fit a row.
    """
    item = F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("v"))
    return children.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias(name))


def with_children(parents: DataFrame, grouped: DataFrame, keys: list[str], name: str = "children") -> DataFrame:
    """Parents with their arrays; an empty one where a parent has no children."""
    joined = parents.join(grouped, keys, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(grouped.schema[name].dataType)))


def child_rows(df: DataFrame, array: str, order: str, *keep: str) -> DataFrame:
    """One row for each element with its position from 0 and its fields."""
    fields = df.schema[array].dataType.elementType.names
    out = df.select(*keep, F.posexplode(array).alias(order, "_e"))
    return out.select(*keep, order, *(F.col(f"_e.{f}").alias(f) for f in fields))
