"""Resolution of a batch whose candidates can match tracks that the batch itself creates.

Read one after the other, candidate i sees the tracks that earlier candidates created and
the identifiers that they linked.  Here the whole batch is matched at once against what the
last round created, with ordinals keeping later rows out of sight, until a round changes
nothing.  A state that repeats itself satisfies the sequential definition for every row, and
by induction over ordinals there is one such state only; so the result is the sequential
one.  Each round settles at least the next ordinal, so the rounds end.  They follow the
longest chain of rows that each change the next, a handful in practice, since all rows of a
title after its first see that first.  Only the last round's tables are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.classify import announcement_confidence, feed_state, match_status
from ..functions.hashing import dedupe_key, derived_id
from ..functions.links import release_url
from ..functions.text import VERSION_MARKERS, blank_to_null, first_contained, normalize_identifier, normalize_text, zero_to_null
from ..operators.keyed import first_by, insert_or_ignore, numbered, upsert
from ..operators.nested import child_rows, ordered_children, with_children
from ..schemas import TRACK
from ..storage import Added, discard, settled
from .matching import asked_levels, confidence, level_rows, match_keyed, spread, with_match_keys

KEY = ["provider", "external_release_id", "external_track_id"]
ALGORITHM = "v2-real-providers"
#: Rows to decide again in a round up to which they and their keys are broadcast.
FEW_ROWS = 20_000


def loaded_tracks(tables: dict[str, DataFrame]) -> DataFrame:
    """Canonical tracks of the store; barcodes are their releases'.  Ordinals are negative."""
    credits = ordered_children(tables["track_credits"], ["track_id"], ["credit_order"], [F.col("credited_name").alias("name"), "role"], "credits")
    barcodes = tables["releases"].select("release_id", blank_to_null(F.col("upc")).alias("upc"), blank_to_null(F.col("ean")).alias("ean"))
    return with_children(tables["tracks"].join(barcodes, "release_id", "left"), credits, ["track_id"], "credits")


def _changed(now: DataFrame, *columns: Column | str) -> tuple:
    return tuple(now.agg(F.count("*"), F.sum(F.xxhash64("ordinal", *columns).cast("decimal(38,0)"))).first())


def fresh_candidates(candidates: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The first row of each key that the store does not know."""
    return first_by(candidates, KEY, "ordinal").join(tables["release_candidates"].select(*KEY), KEY, "left_anti").select(*candidates.columns)


def decide(candidates: DataFrame, tracks: DataFrame, links: DataFrame, compose: bool = True, index: DataFrame | None = None) -> DataFrame:
    """Candidates with kind, rule, points, reasons and track_id, as if read in order.

    `links` (provider, external_track_id, track_id) are identifiers linked before the batch;
    they go before every other rule.  Tracks of the batch carry no recording or release-group
    ids while it lasts.  Keys of candidates and tracks are made once; with `index`, the level
    rows of the stored tracks (see `indexed`), those of the store are not made at all.  Only
    level rows that some candidate asks for are kept.

    The rounds start from the state in which every row is a track of its own, and a round
    decides again only rows that ask for a key, or have an identifier, of an earlier row
    that is a track by now and was none before, is none any more, or links another track.

    Candidates are dealt out before their keys are made, and what is written of them stays so
    from file to file.  Else one or two files held all asked keys; where the adaptive plan joins
    by broadcast after their shuffle, it reads by map task, and one task read a whole file's.
    """
    own_id = derived_id("track", *KEY)
    keyed = settled(with_match_keys(spread(candidates), compose), "keyed")
    asked = settled(asked_levels(keyed), "asked")
    wanted = asked.select("_key").distinct()
    if index is None:
        index = level_rows(with_match_keys(tracks.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in TRACK]), compose))
    as_tracks = keyed.withColumns({"track_id": own_id, "k_recording": F.lit(None).cast("string"), "k_group": F.lit(None).cast("string"), "duration_ms": zero_to_null(F.col("duration_ms"))})
    as_tracks = as_tracks.withColumn("k_version", F.coalesce(blank_to_null(F.col("version")), first_contained(F.col("k_title"), VERSION_MARKERS)))
    old, new = (settled(rows.join(wanted, "_key", "left_semi"), "levels") for rows in (index, level_rows(as_tracks)))
    identifier, columns = ["provider", "external_track_id"], ["kind", "rule", "points", "reasons", "track_id"]
    ids = ["ordinal", *KEY]
    link = F.when(F.col("kind") != "review", F.col("track_id"))
    # Rounds write decisions alone; the candidates' other columns are joined to the last one.
    decided = settled(keyed.select(*ids, F.lit("new").alias("kind"), F.lit("new_canonical").alias("rule"), F.lit(100).alias("points"), F.array(F.lit("")).alias("reasons"), own_id.alias("track_id")), "decisions")
    dirty = settled(keyed.select("ordinal"), "dirty")
    while n := dirty.count():
        # What follows from a few rows is met by broadcast: at most some keys for each of them.
        few = F.broadcast if n <= FEW_ROWS else lambda df: df
        some, ask = keyed.join(few(dirty), "ordinal", "left_semi"), asked.join(few(dirty.withColumnRenamed("ordinal", "_of")), "_of", "left_semi")
        keys, made = few(ask.select("_key").distinct()), decided.filter("kind = 'new'").select("ordinal")
        rows = old.join(keys, "_key", "left_semi").unionByName(new.join(keys, "_key", "left_semi").join(made, "ordinal", "left_semi"))
        known = links.select(*identifier, F.lit(-1).cast("long").alias("at"), "track_id").unionByName(decided.filter("kind <> 'review'").select(*identifier, F.col("ordinal").alias("at"), "track_id"))
        known = known.join(few(some.select(*identifier).distinct()), identifier, "left_semi")
        first = known.groupBy(*identifier).agg(F.min(F.struct("at", "track_id")).alias("_link"))
        matched = match_keyed(some, ask, rows, ids).join(few(first), identifier, "left")
        linked = F.coalesce(F.col("_link.at") < F.col("ordinal"), F.lit(False))
        now = matched.select(
            "ordinal",
            F.struct(
                F.when(linked, F.lit("automatic")).otherwise(F.col("kind")).alias("kind"),
                F.when(linked, F.lit("exact_provider_id")).otherwise(F.col("rule")).alias("rule"),
                F.when(linked, F.lit(100)).otherwise(F.col("points")).alias("points"),
                F.when(linked, F.array(F.lit("Provider track identifier is identical"))).otherwise(F.col("reasons")).alias("reasons"),
                F.when(linked, F.col("_link.track_id")).when(F.col("kind") == "new", own_id).otherwise(F.col("track_id")).alias("track_id"),
            ).alias("_now"),
        )
        before = decided.select(*ids, *columns, (F.col("kind") == "new").alias("_was_track"), link.alias("_was_link"))
        after = before.join(few(now), "ordinal", "left").select(*ids, *(F.when(F.col("_now").isNull(), F.col(c)).otherwise(F.col(f"_now.{c}")).alias(c) for c in columns), "_was_track", "_was_link")
        after = after.select(*ids, *columns, (F.col("_was_track") != (F.col("kind") == "new")).alias("_turned"), (~link.eqNullSafe(F.col("_was_link"))).alias("_relinked"))
        last, decided = decided, settled(after, "decisions")
        # Those that see a change: they stand after the first row of their key that changed.
        turned = new.join(few(decided.filter("_turned").select("ordinal")), "ordinal", "left_semi").groupBy("_key").agg(F.min("ordinal").alias("_from"))
        relinked = decided.filter("_relinked").groupBy(*identifier).agg(F.min("ordinal").alias("_from"))
        seen = asked.join(few(turned), "_key").filter("_of > _from").select(F.col("_of").alias("ordinal"))
        seen = seen.unionByName(keyed.join(few(relinked), identifier).filter("ordinal > _from").select("ordinal"))
        done, dirty = dirty, settled(seen.distinct(), "dirty")
        discard(last)
        discard(done)
    whole = settled(keyed.select(*candidates.columns).join(decided.select("ordinal", *columns), "ordinal"), "decided")
    for done in (keyed, asked, old, new, decided, dirty):
        discard(done)
    return whole


def indexed(index: DataFrame, top: int) -> DataFrame:
    """The stored match index as level rows; ordinals become negative in their order."""
    key = F.struct(*(F.col(f"p{k}") for k in range(5)))
    return index.select((F.col("ordinal") - top).alias("ordinal"), "track_id", F.col("version").alias("k_version"), key.alias("_key"), F.col("duration").alias("_duration"))


def index_rows(tracks: DataFrame, compose: bool = True) -> DataFrame:
    """Rows of the match index for new tracks in the form of `loaded_tracks`.  Of a key and
    duration the first two tell, so a title of very many tracks adds two rows a batch."""
    rows = level_rows(with_match_keys(tracks, compose))
    rank = F.row_number().over(Window.partitionBy("_key", "_duration").orderBy("ordinal"))
    first = rows.withColumn("_rank", rank).filter("_rank <= 2")
    return first.select(*(F.col(f"_key.p{k}").alias(f"p{k}") for k in range(5)), F.col("_duration").alias("duration"), "ordinal", "track_id", F.col("k_version").alias("version"))


def place_in_releases(decided: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Decisions with release_id (that of the track) and creates_release.

    A new track joins the release linked to its provider's release id, else one with its UPC
    or EAN, else it creates one; links and releases of earlier rows count.  Settled in rounds
    like the decisions.
    """
    d = decided.withColumns({"_upc": normalize_identifier(blank_to_null(F.col("upc"))), "_ean": normalize_identifier(blank_to_null(F.col("ean"))), "_own": derived_id("release", *KEY)})
    old_tracks = tables["tracks"].select("track_id", F.col("release_id").alias("_of"))
    old_links = tables["release_external_ids"].select("provider", F.col("external_id").alias("external_release_id"), F.lit(-1).cast("long").alias("at"), "release_id")
    old = tables["releases"].select(F.lit(-1).cast("long").alias("at"), "release_id", "upc", "ean")
    before, last, now = None, None, d.select("*", F.when(F.col("kind") == "new", F.col("_own")).alias("release_id"), (F.col("kind") == "new").alias("creates_release"))
    while True:
        made = now.filter("kind = 'new'").select("track_id", F.col("release_id").alias("_of"))
        placed = now.drop("release_id", "creates_release").join(old_tracks.unionByName(made), "track_id", "left")
        links = old_links.unionByName(placed.filter("kind <> 'review' AND _of IS NOT NULL").select("provider", "external_release_id", F.col("ordinal").alias("at"), F.col("_of").alias("release_id")))
        links = links.groupBy("provider", "external_release_id").agg(F.min(F.struct("at", "release_id")).alias("_link"))
        releases = old.unionByName(now.filter("creates_release").select(F.col("ordinal").alias("at"), "release_id", F.col("_upc").alias("upc"), F.col("_ean").alias("ean")))
        first = lambda k: releases.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"_{k}")).agg(F.min(F.struct("at", "release_id")).alias(f"_by_{k}"))  # noqa: B023, E731
        out = placed.join(links, ["provider", "external_release_id"], "left").join(first("upc"), "_upc", "left").join(first("ean"), "_ean", "left")
        earlier = lambda c: F.when(F.col(f"{c}.at") < F.col("ordinal"), F.col(c))
        found = F.coalesce(earlier("_link")["release_id"], F.least(earlier("_by_upc"), earlier("_by_ean"))["release_id"])
        new = F.col("kind") == "new"
        now = settled(out.select(*d.columns, F.when(new, F.coalesce(found, F.col("_own"))).otherwise(F.col("_of")).alias("release_id"), (new & found.isNull()).alias("creates_release")), "releases")
        discard(last)
        last = now
        after = _changed(now, "release_id", "creates_release")
        if after == before:
            return now.drop("_upc", "_ean", "_own")
        before = after


def _json(*columns: str):
    names = {"source_label": "sourceLabel", "release_date": "releaseDate", "release_date_precision": "releaseDatePrecision", "release_type": "releaseType"}
    return F.to_json(F.struct(*(F.col(c).alias(names.get(c, c)) for c in columns)))


def persist(candidates: DataFrame, tables: dict[str, DataFrame], run_id: str, compose: bool = True) -> tuple[dict[str, DataFrame | Added], DataFrame]:
    """What a batch changes in the tables, and its decisions.

    Most tables are only added to, which costs the batch and not the store; the three whose
    rows can change are written again.  Stored tracks are met through
    the match index, which grows with each batch by the keys of its own tracks.
    Nothing is written here: the caller publishes all tables in one commit.  Every id follows
    from natural keys, so a repeated or retried run gives the same rows.
    """
    fresh = settled(fresh_candidates(candidates, tables), "fresh")
    links = tables["track_external_ids"].select("provider", F.col("external_id").alias("external_track_id"), "track_id")
    # Stored tracks are numbered from 0 in the order they came in; a batch sees them before its own.
    top = tables["tracks"].agg(F.coalesce(F.max("ordinal") + 1, F.lit(0))).first()[0]
    d = place_in_releases(decide(fresh, None, links, compose, indexed(tables["match_index"], top)), tables)
    clean = lambda c: normalize_text(F.col(c), compose)

    # Artists by provider id, else created; credited ones by name, else created.
    wanted = first_by(d.select("provider", F.col("artist_external_id").alias("external_id"), "artist_name", "provider_url", "ordinal"), ["provider", "external_id"], "ordinal")
    missing = wanted.join(tables["artist_external_ids"], ["provider", "external_id"], "left_anti").withColumn("artist_id", derived_id("artist", "provider", "external_id"))
    ids = tables["artist_external_ids"].unionByName(missing.select("artist_id", "provider", "external_id", "provider_url", F.lit(True).alias("confirmed")), allowMissingColumns=True)
    made = missing.select("artist_id", F.col("artist_name").alias("name"), clean("artist_name").alias("normalized_name"), F.col("ordinal").alias("at"))
    owner = ids.select("provider", F.col("external_id").alias("artist_external_id"), F.col("artist_id").alias("primary_artist_id"))
    d = settled(d.join(owner, ["provider", "artist_external_id"], "left"), "resolved")

    new = d.filter("kind = 'new'")
    credited = F.when(F.size("credits") > 0, F.col("credits")).otherwise(F.array(F.struct(F.col("artist_name").alias("name"), F.lit("primary").alias("role"))))
    credits = child_rows(new.withColumn("credits", credited), "credits", "credit_order", "track_id", "primary_artist_id", "ordinal").withColumn("normalized_name", clean("name"))
    known = tables["artists"].select("artist_id", "name", "normalized_name", F.lit(-1).cast("long").alias("at")).unionByName(made)
    by_name = known.groupBy("normalized_name").agg(F.min(F.struct("at", "artist_id")).alias("_known"))
    credits = credits.join(by_name, "normalized_name", "left")
    # An artist of this batch is known to rows from its own on.
    usable = F.when(F.col("_known.at") <= F.col("ordinal"), F.col("_known.artist_id"))
    credits = credits.withColumn("artist_id", F.when(F.col("credit_order") == 0, F.col("primary_artist_id")).otherwise(F.coalesce(usable, derived_id("credited artist", "normalized_name"))))
    guests = first_by(credits.filter((F.col("credit_order") > 0) & usable.isNull()).select("artist_id", "name", "normalized_name", "ordinal"), ["artist_id"], "ordinal")
    repeated = credits.groupBy("track_id", "artist_id", "role").agg(F.count("*").alias("n"))
    artists = made.drop("at").unionByName(guests.drop("ordinal").join(tables["artists"], "artist_id", "left_anti"))
    if not repeated.filter("n > 1").isEmpty():
        raise ValueError("a track credits an artist twice in one role")

    releases = d.filter("creates_release").select("release_id", F.col("release_title").alias("title"), clean("release_title").alias("normalized_title"), "release_type", "release_date", "release_date_precision", normalize_identifier(blank_to_null(F.col("upc"))).alias("upc"), normalize_identifier(blank_to_null(F.col("ean"))).alias("ean"), blank_to_null(F.col("version")).alias("version"))
    places = numbered(new.select("track_id", "ordinal"), ["ordinal"], "_place").select("track_id", (F.col("_place") + top).alias("_at"))
    tracks = new.join(places, "track_id").select("track_id", F.col("_at").alias("ordinal"), "release_id", "title", clean("title").alias("normalized_title"), zero_to_null(F.col("duration_ms")).alias("duration_ms"), normalize_identifier(blank_to_null(F.col("isrc"))).alias("isrc"), zero_to_null(F.col("disc_number")).alias("disc_number"), zero_to_null(F.col("track_number")).alias("track_number"), "musicbrainz_recording_id", "musicbrainz_release_group_id", blank_to_null(F.col("version")).alias("version"))
    tracks = settled(tracks, "tracks")
    track_credits = credits.select("track_id", "credit_order", "artist_id", "role", F.col("name").alias("credited_name"))
    own_releases = tables["releases"].join(tracks.select("release_id").distinct(), "release_id", "left_semi").unionByName(releases)
    index = index_rows(loaded_tracks({"tracks": tracks, "releases": own_releases, "track_credits": track_credits}), compose)
    candidate_id = derived_id("candidate", *KEY)
    d = d.withColumn("candidate_id", candidate_id)
    rows = d.select("candidate_id", F.lit(run_id).alias("run_id"), *KEY, "artist_external_id", "title", clean("title").alias("normalized_title"), "release_date", "payload_hash", match_status(F.col("kind")).alias("match_status"), "track_id", F.col("rule").alias("match_rule"), confidence(F.col("points")).alias("match_confidence"), F.col("reasons").alias("match_reasons"), F.lit(ALGORITHM).alias("algorithm"), "first_seen_at")
    evidence = d.select("candidate_id", "provider", "evidence_type", F.col("external_track_id").alias("external_id"), F.col("evidence_url").alias("source_url"), "payload_hash", F.col("first_seen_at").alias("retrieved_at"), "ordinal")
    sure = d.filter("kind <> 'review' AND track_id IS NOT NULL")
    availability = sure.select("provider", F.col("external_track_id").alias("provider_track_id"), "region", "track_id", F.col("availability").alias("state"), "provider_url", "ordinal")
    track_ids = sure.select("provider", F.col("external_track_id").alias("external_id"), "track_id", "provider_url", _json("availability", "region", "source_label").alias("provider_fields"), "ordinal")
    release_ids = sure.filter("release_id IS NOT NULL").select("provider", F.col("external_release_id").alias("external_id"), "release_id", release_url(F.col("provider"), F.col("external_release_id"), F.col("evidence_url")).alias("provider_url"), _json("release_date", "release_date_precision", "release_type", "source_label").alias("provider_fields"), "ordinal")
    announced = d.filter("is_upcoming AND release_id IS NOT NULL").select("provider", F.col("external_release_id").alias("external_id"), F.col("primary_artist_id").alias("artist_id"), "release_id", F.col("release_title").alias("title"), F.col("release_date").alias("scheduled_for"), F.col("release_date_precision").alias("date_precision"), announcement_confidence(F.col("provider")).alias("confidence"), "evidence_url", "first_seen_at", "ordinal")
    feed = d.select(derived_id("feed", *KEY).alias("feed_id"), "candidate_id", "track_id", "release_id", feed_state(F.col("is_upcoming"), F.col("kind")).alias("state"), dedupe_key(*KEY).alias("dedupe_key"), "first_seen_at", "ordinal")
    follows = d.select(F.col("primary_artist_id").alias("artist_id"), F.col("first_seen_at").alias("followed_at"), F.lit(True).alias("active"), "ordinal")

    def added(name: str, incoming: DataFrame, keys: list[str]) -> Added:
        new_rows = insert_or_ignore(tables[name], incoming, keys, "ordinal")
        return Added(new_rows.select(*tables[name].columns))

    changed = {
        "artists": Added(artists),
        "artist_external_ids": Added(missing.select(*(F.col(c) if c in ("artist_id", "provider", "external_id", "provider_url") else F.lit(True).alias(c) if c == "confirmed" else F.lit(None).cast(tables["artist_external_ids"].schema[c].dataType).alias(c) for c in tables["artist_external_ids"].columns))),
        "artist_follows": added("artist_follows", follows, ["artist_id"]),
        "releases": Added(releases),
        "tracks": Added(tracks),
        "match_index": Added(index),
        "track_credits": Added(track_credits),
        "release_candidates": Added(rows),
        "source_evidence": added("source_evidence", evidence, ["provider", "evidence_type", "external_id", "payload_hash"]),
        "track_availabilities": added("track_availabilities", availability, ["provider", "provider_track_id", "region"]),
        "track_external_ids": upsert(tables["track_external_ids"], track_ids, ["provider", "external_id"], "ordinal", ["provider_fields", "provider_url"]),
        "release_external_ids": upsert(tables["release_external_ids"], release_ids, ["provider", "external_id"], "ordinal", ["provider_fields"]),
        "announcements": upsert(tables["announcements"], announced, ["provider", "external_id"], "ordinal", ["scheduled_for", "date_precision", "evidence_url", "release_id"]),
        "date_history": added("date_history", announced, ["provider", "external_id", "scheduled_for", "date_precision"]),
        "feed_items": added("feed_items", feed, ["dedupe_key"]),
    }
    return changed, d
