"""Incremental resolution: repeated batches over whatever has arrived, absorbed by keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.keyed import insert_or_ignore
from ..plans.resolution import persist
from ..schemas import CANDIDATE, validated
from ..storage import Store, discard, settled


def resolve_stream(spark: SparkSession, folder: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Resolve the candidate files that are new since the last run, then stop.

    The stream's checkpoint tells which files are new; keys in the store absorb what comes
    twice, at any lateness, so no watermark is set.  A batch that is retried after a crash
    finds its own rows in the store and adds none.  A row that breaks a rule fails its batch,
    which is then not committed; a batch that meets another writer's commit starts again.
    """

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        rows = settled(validated(batch), "batch")
        store.transact(lambda tables: persist(rows, tables, f"stream-{number}")[0])
        discard(rows)

    return spark.readStream.schema(CANDIDATE).parquet(folder).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_stream(source: DataFrame, target: str, keys: list[str], order: str, checkpoint: str, read: Callable[[], DataFrame]) -> StreamingQuery:
    """Append the first row of each key to the Parquet folder `target`.

    `read` gives the rows there so far.  A batch is written to a folder named by its number,
    which a retry overwrites, so a row is never added twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        known = read().filter(F.col("_batch") < number)
        insert_or_ignore(known, batch, keys, order).write.mode("overwrite").parquet(f"{target}/_batch={number}")

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
