"""Plans of playlist exports: what to add, what is there, what is refused."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import exportable
from ..operators.keyed import chunked, first_by, three_way_split, upsert
from ..sources.chunk_sink import send_once
from ..storage import settled

REFUSED = "Only exact or manually confirmed matches may be exported"


def export_plan(items: DataFrame, existing: DataFrame, key: str = "provider_track_id", order: str = "ordinal") -> DataFrame:
    """The first occurrence of each track with `bucket` (rejected, present, add) and reason."""
    allowed = exportable(F.col("match_rule"), F.col("confidence"), F.col("manually_confirmed"))
    plan = three_way_split(items, existing, key, order, allowed)
    return plan.withColumn("reason", F.when(F.col("bucket") == "rejected", F.lit(REFUSED)))


def plan_sizes(plan: DataFrame) -> DataFrame:
    return plan.agg(*(F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in ("add", "present", "rejected")))


def create_playlist(post: Callable[[str, dict], dict], user_id: str, name: str, description: str = "") -> dict:
    """A new private playlist, as the service answers: one call, made by the driver."""
    return post(f"/users/{user_id}/playlists", {"name": name, "description": description, "public": False})


def plan_and_write(items: DataFrame, existing: DataFrame, send: Callable[[list[str]], str], size: int = 100, find: Callable[[list[str]], str | None] | None = None, ledger: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(plan, sent batches): what the playlist holds is read, the rest planned and added;
    with a `ledger`, a folder of this export alone, and `find` each batch is sent once."""
    plan = settled(export_plan(items, existing), "export-plan")
    if ledger is not None and find is not None:
        return plan, send_once(settled(export_batches(plan, size), "batches"), send, find, ledger)
    return plan, settled(write_batches(export_batches(plan, size), send), "sent")


def export_batches(plan: DataFrame, size: int = 100, order: str = "ordinal", by: list[str] | None = None) -> DataFrame:
    """The rows to add with the number of their write batch."""
    return chunked(plan.filter("bucket = 'add'"), size, [order], by, "batch")


def write_batches(batches: DataFrame, send: Callable[[list[str]], str], key: str = "provider_track_id", order: str = "ordinal") -> DataFrame:
    """Send each batch in order and return (batch, n_items, snapshot_id).

    A batch is bounded by its size, so it fits one call; batches are spread over tasks.  A
    retried task sends a batch again: the receiver should ignore items that it has, or the
    batches go through `sources.chunk_sink.send_once`, which keeps a ledger.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows.sort_values(order)[key].tolist()
        return pd.DataFrame({"batch": [rows["batch"].iloc[0]], "n_items": [len(ids)], "snapshot_id": [send(ids)]})

    return batches.select("batch", key, order).groupBy("batch").applyInPandas(one, "batch long, n_items long, snapshot_id string")


def record_exports(exports: DataFrame, sent: DataFrame, items: DataFrame, now) -> DataFrame:
    """The export table after the sent rows were recorded, one row for each target and track."""
    rows = first_by(items.join(sent.select("provider_track_id"), "provider_track_id", "left_semi"), ["target_id", "provider_track_id"], "ordinal")
    rows = rows.select("target_id", "provider_track_id", "track_id", F.lit("exported").alias("status"), now.alias("exported_at"), "ordinal")
    return upsert(exports, rows, ["target_id", "provider_track_id"], "ordinal", ["status", "exported_at", "track_id"])
