"""Import of followed artists: preview and confirmation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import ladder
from ..functions.hashing import derived_id
from ..functions.text import normalize_text
from ..operators.keyed import first_by


def import_preview(imported: DataFrame, artists: DataFrame, aliases: DataFrame, compose: bool = True) -> DataFrame:
    """`imported` (provider_artist_id, name, ...) with existing_artist_id, proposed_action and
    selected: one artist of that name or alias merges, several need review, none creates.

    Names are aggregated to one row each before the join, so a name that very many artists
    share costs one row.
    """
    names = artists.select("artist_id", "name").unionByName(aliases.select("artist_id", "name"))
    keyed = names.select("artist_id", normalize_text(F.col("name"), compose).alias("_key"))
    # Several artists or one is all that matters: least and greatest id tell, without a distinct.
    known = keyed.groupBy("_key").agg(F.min("artist_id").alias("_least"), F.max("artist_id").alias("_most"))
    out = imported.withColumn("_key", normalize_text(F.col("name"), compose)).join(known, "_key", "left")
    action = ladder((F.col("_least").isNull(), "create"), (F.col("_least") == F.col("_most"), "merge"), otherwise="review")
    return out.select(*imported.columns, F.when(F.col("_least") == F.col("_most"), F.col("_least")).alias("existing_artist_id"), action.alias("proposed_action"), (action != "review").alias("selected"))


def default_decision(proposed_action) -> object:
    return F.when(proposed_action == "review", F.lit("skip")).otherwise(proposed_action)


def import_confirm(candidates: DataFrame, decisions: DataFrame, mappings: DataFrame) -> DataFrame:
    """`candidates` with outcome (skipped, merged, created, needs_review) and artist_id.

    The first decision of a candidate counts; without one its proposal does.  An existing
    mapping of the provider's artist wins over a wish to create.
    """
    chosen = first_by(decisions, ["provider_artist_id"], "ordinal").select("provider_artist_id", F.col("decision"), F.col("selected").alias("_selected"), F.col("existing_artist_id").alias("_given"))
    mapped = mappings.groupBy(F.col("external_id").alias("provider_artist_id")).agg(F.min("artist_id").alias("_mapped"))
    d = candidates.join(chosen, "provider_artist_id", "left").join(mapped, "provider_artist_id", "left")
    decision = F.coalesce("decision", default_decision(F.col("proposed_action")))
    selected = F.coalesce("_selected", "selected")
    given = F.coalesce("_given", "existing_artist_id")
    outcome = ladder(((~selected) | (decision == "skip"), "skipped"), (F.col("_mapped").isNotNull(), "merged"), (decision == "create", "created"), (given.isNotNull(), "merged"), otherwise="needs_review")
    artist = F.when(outcome == "merged", F.coalesce("_mapped", given)).when(outcome == "created", derived_id("artist", "provider_artist_id"))
    return d.select(*candidates.columns, outcome.alias("outcome"), artist.alias("artist_id"))


def import_counts(confirmed: DataFrame) -> DataFrame:
    return confirmed.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("created", "merged", "needs_review", "skipped")))
