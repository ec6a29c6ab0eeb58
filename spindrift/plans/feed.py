"""The denormalised feed, its filters, sorts, counts and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import PROVIDER_LABELS, cyclic_accent, export_status, label
from ..functions.text import credit_line
from ..operators.keyed import mark_exists
from ..operators.nested import ordered_children


def feed_rows(
    feed: DataFrame,
    candidates: DataFrame,
    tracks: DataFrame,
    releases: DataFrame,
    credits: DataFrame,
    evidence: DataFrame,
    availabilities: DataFrame,
    exports: DataFrame,
) -> DataFrame:
    """One wide row for each feed item that has its candidate.

    Children are aggregated before they are joined, so that no join multiplies rows; every
    join is on a key.  All that a candidate has is joined first, then all that a track has,
    then the release, so the wide rows are dealt out anew twice, and what the joined columns
    are only read for goes before that.  `position`, from 0, is counted before items without a candidate go.
    Nothing is collected and no filter is applied: a filter on the result is pushed below
    the joins where it can be.
    """
    f = feed.select("feed_id", "candidate_id", "track_id", "release_id", "state", "first_seen_at", "position")
    c = candidates.select("candidate_id", F.col("title").alias("c_title"), "artist_external_id", "release_date", "match_rule", "match_confidence", F.array_join("match_reasons", "; ").alias("match_reason"))
    t = tracks.select("track_id", F.col("title").alias("t_title"), F.col("release_id").alias("t_release_id"))
    r = releases.select(F.col("release_id").alias("r_id"), F.col("title").alias("r_title"), F.col("release_type").alias("r_type"), F.col("release_date_precision").alias("r_precision"))
    names = ordered_children(credits, ["track_id"], ["credit_order"], [F.col("credited_name").alias("name"), "role"], "credits")
    sources = ordered_children(evidence, ["candidate_id"], ["source_url", "provider"], [label(F.col("provider"), PROVIDER_LABELS, "Mock provider").alias("provider"), F.col("source_url").alias("href")], "sources")
    first = F.struct("provider_track_id", "region", "state")
    names = names.filter(F.size("credits") > 0).select("track_id", credit_line(F.col("credits")).alias("credited"))
    places = availabilities.groupBy("track_id").agg(F.min(F.when(F.col("provider") == "spotify", first)).alias("playing"), F.min(F.struct("provider", "provider_track_id", "region")).alias("anywhere"))
    places = places.select("track_id", F.col("playing.state").alias("playing_state"), F.coalesce("playing.region", "anywhere.region").alias("place_region"))
    wide = f.join(c, "candidate_id").join(sources, "candidate_id", "left").drop("candidate_id")
    wide = wide.join(t, "track_id", "left").join(names, "track_id", "left").join(places, "track_id", "left")
    wide = mark_exists(wide, exports.filter("status = 'exported'").dropna(subset=["track_id"]), ["track_id"], "exported")
    wide = wide.withColumns({"r_id": F.coalesce("release_id", "t_release_id"), "shown_artist": F.coalesce("credited", "artist_external_id"), "shown_title": F.coalesce("t_title", "c_title")})
    wide = wide.drop("track_id", "release_id", "t_release_id", "credited", "artist_external_id", "t_title").join(r, "r_id", "left")
    state = F.coalesce("playing_state", F.lit("unavailable"))
    sources_shown = F.coalesce("sources", F.array().cast("array<struct<provider:string,href:string>>"))
    return wide.select(
        F.col("feed_id").alias("id"),
        "state",
        F.col("shown_artist").alias("artist"),
        F.col("shown_title").alias("title"),
        F.coalesce("r_title", "c_title").alias("release_title"),
        F.coalesce("r_type", F.lit("other")).alias("release_type"),
        "release_date",
        F.when(F.col("r_precision").isin("year", "month"), F.col("r_precision")).otherwise(F.lit("day")).alias("release_date_precision"),
        "first_seen_at",
        sources_shown.alias("sources"),
        F.transform(sources_shown, lambda s: F.struct(F.lit("Source evidence").alias("label"), s["href"].alias("href"))).alias("links"),
        state.alias("availability"),
        F.lit("NOT_CHECKED").alias("link_state"),
        F.col("match_confidence").cast("double").alias("confidence"),
        "match_reason",
        F.coalesce("place_region", F.lit("ZZ")).alias("region"),
        export_status(F.col("exported"), F.col("state"), state, F.col("match_rule")).alias("export_status"),
        cyclic_accent(F.col("position")).alias("accent"),
        "position",
    )


def feed_filter(
    states: tuple[str, ...] | None = None,
    search: str | None = None,
    exact_only: bool = False,
    playable: bool | None = None,
    release_type: str | None = None,
    artist: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    search_in: tuple[str, ...] = ("artist", "title", "release_title"),
) -> Column:
    """The conjunction of the given conditions; those not given let all rows pass."""
    parts = [F.lit(True)]
    if states is not None:
        parts.append(F.col("state").isin(*states))
    if search and search.strip():
        parts.append(F.contains(F.lower(F.concat_ws(" ", *search_in)), F.lit(search.strip().lower())))
    if exact_only:
        parts.append(F.col("confidence") == 1)
    if playable is not None:
        parts.append((F.col("availability") == "playable") if playable else (F.col("availability") != "playable"))
    if release_type is not None:
        parts.append(F.col("release_type") == release_type)
    if artist is not None:
        parts.append(F.col("artist") == artist)
    if date_from is not None:
        parts.append(F.col("release_date") >= date_from)
    if date_to is not None:
        parts.append(F.col("release_date") <= date_to)
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def feed_order(by: str = "release_date") -> list[Column]:
    """Newest first by release date and then sighting, or by sighting alone; ties in order."""
    first = [F.col("release_date").desc()] if by == "release_date" else []
    return [*first, F.col("first_seen_at").desc(), F.col("position").asc()]


def review_actions(feed: DataFrame, decisions: DataFrame) -> DataFrame:
    """The feed after `decisions` (id, decision): keep_separate dismisses and blocks a row;
    confirm makes it new and certain, and eligible if it can be played."""
    joined = feed.join(decisions.select("id", "decision"), "id", "left")
    keep, confirm = F.col("decision") == "keep_separate", F.col("decision") == "confirm"
    eligible = F.when(F.col("availability") == "playable", F.lit("eligible")).otherwise(F.lit("blocked"))
    changed = {
        "state": F.when(keep, F.lit("dismissed")).when(confirm, F.lit("new")).otherwise(F.col("state")),
        "confidence": F.when(confirm, F.lit(1.0)).otherwise(F.col("confidence")),
        "export_status": F.when(keep, F.lit("blocked")).when(confirm, eligible).otherwise(F.col("export_status")),
    }
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in feed.columns))


def feed_counts(feed: DataFrame) -> DataFrame:
    """Counts of the feed page and the export page in one pass."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    status, state = F.col("export_status"), F.col("state")
    return feed.agg(
        F.count("*").alias("n_items"),
        n(state == "needs_review", "n_review"),
        n(status == "eligible", "n_eligible"),
        n(status == "exported", "n_exported"),
        (F.count("*") - F.count_if(status.isin("eligible", "exported"))).alias("n_blocked"),
        n(state == "saved", "n_saved"),
        n(state == "listened", "n_listened"),
        n(state == "dismissed", "n_dismissed"),
    )


def watchlist(feed: DataFrame, known: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """Artists with their latest sighting, number of rows and distinct providers; `known`
    artists (artist) without rows are listed as well, `removed` ones are not."""
    providers = feed.select("artist", F.explode_outer("sources.provider").alias("p")).dropna().distinct().groupBy("artist").agg(F.array_sort(F.collect_set("p")).alias("providers"))
    out = feed.groupBy("artist").agg(F.max("first_seen_at").alias("last_seen_at"), F.count("*").alias("n_rows")).join(providers, "artist", "left")
    if known is not None:
        out = known.select("artist").distinct().join(out, "artist", "full")
    if removed is not None:
        out = out.join(removed.select("artist"), "artist", "left_anti")
    return out.select("artist", "last_seen_at", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("providers", F.array().cast("array<string>")).alias("providers"))


def watchlist_order(by: str = "name", descending: bool = False) -> list[Column]:
    name = F.collate("artist", "en_USA")
    if by == "added":
        return [F.col("last_seen_at").desc_nulls_last(), name.asc()]
    return [name.desc() if descending else name.asc()]
