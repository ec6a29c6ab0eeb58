"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v), root being the component's least node.

    Alternating large-star and small-star steps: in a large-star step each node links its
    greater neighbours to the least node it sees, in a small-star step its lesser ones.  The
    least neighbour is a partial aggregate joined back, and a link needs no other link of its
    node.  The aggregate is written before it is joined: adaptive execution splits the rows of
    a node with very many links only where both sides of the join come straight from a
    shuffle, which an aggregate within the join would prevent.  Rounds go on until one changes
    nothing, some logarithm of the longest path.  Each is written to the shared folder; only
    its count and checksum reach the driver.  Self-links and repeated
    links are allowed; an empty table gives an empty result.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "components")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(state)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.filter("u <> v").distinct(), "large")
        lower = stored(large.groupBy("u").agg(F.min("v").alias("m")), "lower")
        joined = large.join(lower, "u")
        small = joined.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        new = stored(small.filter("u <> v").distinct(), "components")
        for done in (now, least, large, lower):
            drop_stored(done)
        now = new
