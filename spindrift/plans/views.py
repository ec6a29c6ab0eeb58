"""Smaller views: playlists to write to, duplicate names, statuses, links, items to export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import ladder
from ..operators.keyed import apply_overrides, mark_exists


def owned_private(account_id: str | Column, user_id: str | Column) -> Column:
    """Playlists that are known to be private and belong to one of the two ids; an unknown
    visibility does not count as private."""
    mine = (F.col("owner_id") == account_id) | (F.col("owner_id") == user_id)
    return F.coalesce(~F.col("public") & mine, F.lit(False))


def duplicate_names(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows whose name, in lower case, another row has as well.

    Least and greatest key of a name tell whether it is shared: one aggregate row a name is
    joined back, never rows with rows.
    """
    names = rows.groupBy(F.lower(name).alias("_name")).agg(F.min(key).alias("_least"), F.max(key).alias("_most"))
    shared = names.filter("_least <> _most").select("_name")
    return rows.join(shared, F.lower(F.col(name)) == F.col("_name"), "left_semi")


def status_label(enabled: Column, configured: Column) -> Column:
    return ladder((~enabled, "disabled"), (configured, "configured"), otherwise="missing")


def with_selection(preview: DataFrame, everything: bool | None = None, chosen: DataFrame | None = None, key: str = "provider_artist_id") -> DataFrame:
    """The preview with all rows (un)selected, and then those of `chosen` (key, selected)."""
    out = preview if everything is None else preview.withColumn("selected", F.lit(everything))
    return out if chosen is None else apply_overrides(out, chosen, [key], "selected")


def append_once(rows: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """`rows` with those of `more` whose key it lacks."""
    return rows.unionByName(more.join(rows.select(key), key, "left_anti").select(*rows.columns))


def link_rows(links: DataFrame, items: DataFrame) -> DataFrame:
    """Verified links with the names of what they lead to, or stand-ins for these."""
    named = items.select(F.col("id").alias("item_id"), F.col("title").alias("_title"), F.col("artist").alias("_artist"))
    verified = links.filter("state = 'USER_LINKED_VERIFIED'")
    return verified.join(named, "item_id", "left").select(*links.columns, F.coalesce("_title", F.lit("Unknown title")).alias("title"), F.coalesce("_artist", F.lit("Unknown artist")).alias("artist"))


def pending_reviews(reviews: DataFrame) -> DataFrame:
    return reviews.filter("status = 'pending'").agg(F.count("*").alias("n_pending"))


def items_to_export(candidates: DataFrame, availabilities: DataFrame, decisions: DataFrame, provider: str = "spotify") -> DataFrame:
    """Candidates with each place where their track can be had, as input of an export plan.

    A candidate without a track has none; one with several places gives a row for each, of
    which the plan takes the first of a track.  Confirmed are those with a decision to confirm.
    """
    places = availabilities.filter(F.col("provider") == provider).select("track_id", "provider_track_id", "provider_url")
    items = candidates.select("candidate_id", "track_id", "match_rule", F.col("match_confidence").alias("confidence")).join(places, "track_id")
    return mark_exists(items, decisions.filter("decision = 'confirm'"), ["candidate_id"], "manually_confirmed")
