"""Candidates from fetched documents of the two services, as DataFrame chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import availability, feature_override, positional_roles, region_code, titled_release, typed_release
from ..functions.dates import is_upcoming, padded_date, partial_date
from ..functions.hashing import content_hash
from ..functions.text import blank_to_null, extract_version
from ..schemas import CANDIDATE

ALBUM = "id string, name string, album_type string, artists array<struct<id:string,name:string>>, release_date string, release_date_precision string, total_tracks int, external_ids struct<upc:string,ean:string>"
TRACK = "id string, name string, artists array<struct<id:string,name:string>>, disc_number int, track_number int, duration_ms int, is_playable boolean, restrictions struct<reason:string>, external_ids struct<isrc:string>, external_urls struct<spotify:string>"
_CREDIT = "array<struct<name:string,artist:struct<id:string,name:string>>>"
RELEASE = (
    f"id string, title string, date string, country string, barcode string, `artist-credit` {_CREDIT},"
    f" `release-group` struct<id:string,title:string,`first-release-date`:string,`primary-type`:string,`secondary-types`:array<string>>,"
    f" media array<struct<position:int,tracks:array<struct<id:string,title:string,position:int,length:int,`artist-credit`:{_CREDIT},"
    f"recording:struct<id:string,title:string,length:int,isrcs:array<string>>>>>>"
)


def _numbered(rows: DataFrame, columns: dict[str, Column], order: list[str]) -> DataFrame:
    """Rows of the candidate schema.  The ordinal follows from the place in the source, so it
    needs no sort: 24 bits of the parent's place, 20 of the child's, 20 of the grandchild's."""
    room = {name: 1 << (23 if k == 0 else 20) for k, name in enumerate(order)}
    fits = [F.assert_true((F.col(o) >= 0) & (F.col(o) < n), F.lit(f"too many places in one source: {o}")).isNull() for o, n in room.items()]
    rows = rows.filter(fits[0] & fits[1] & fits[2])
    place = sum((F.col(o).cast("long") * (1 << s) for o, s in zip(order, (40, 20, 0))), F.lit(0).cast("long"))
    own = rows.select(place.alias("ordinal"), *(c.alias(n) for n, c in columns.items()))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in CANDIDATE if f.name not in own.columns and f.name != "payload_hash"]
    full = own.select("*", *missing)
    hashed = full.withColumn("payload_hash", content_hash(*(f.name for f in CANDIDATE if f.name not in ("ordinal", "payload_hash", "first_seen_at"))))
    return hashed.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in CANDIDATE))


def _since(date: Column, since: str | None) -> Column:
    return F.lit(True) if since is None else date >= since


def catalogue_candidates(mappings: DataFrame, albums: DataFrame, album_tracks: DataFrame, now: Column, region: str = "US", since: str | None = None, compose: bool = True) -> DataFrame:
    """Candidates of mapped artists from their albums and the albums' tracks.

    `mappings` (m, artist_external_id, artist_name), `albums` (artist_external_id, a, item)
    and `album_tracks` (album_id, t, item) hold documents as JSON; m, a and t are places in
    the source.  Albums before `since` go first, before their tracks are joined.
    """
    a = albums.select("artist_external_id", "a", F.from_json("item", ALBUM).alias("album")).filter(_since(padded_date(F.col("album.release_date")), since))
    t = album_tracks.select(F.col("album_id").alias("_album"), "t", F.from_json("item", TRACK).alias("track"))
    rows = mappings.join(a, "artist_external_id").withColumn("_album", F.col("album.id")).join(t, "_album")
    watched = F.col("artist_external_id")
    takes_part = lambda c: F.exists(c, lambda x: x["id"] == watched)
    rows = rows.filter(takes_part(F.col("album.artists")) | takes_part(F.col("track.artists")))
    primary = F.coalesce(F.get("track.artists", F.lit(0))["id"] == watched, F.lit(False))
    url = F.col("track.external_urls.spotify")
    columns = {
        "provider": F.lit("spotify"), "external_release_id": F.col("album.id"), "external_track_id": F.col("track.id"), "source_label": F.lit("Spotify catalog"),
        "artist_external_id": watched, "artist_name": F.col("artist_name"), "title": F.col("track.name"), "release_title": F.col("album.name"),
        "release_type": titled_release(F.col("album.album_type"), F.col("album.name"), F.col("track.name"), F.col("album.total_tracks"), primary, compose),
        "release_date": padded_date(F.col("album.release_date")), "release_date_precision": F.col("album.release_date_precision"), "first_seen_at": now,
        "credits": positional_roles(F.col("track.artists"), watched), "duration_ms": F.col("track.duration_ms"), "disc_number": F.col("track.disc_number"), "track_number": F.col("track.track_number"),
        "isrc": blank_to_null(F.col("track.external_ids.isrc")), "upc": blank_to_null(F.col("album.external_ids.upc")), "ean": blank_to_null(F.col("album.external_ids.ean")),
        "version": extract_version(F.col("track.name"), compose=compose), "region": F.lit(region), "availability": availability(F.coalesce("track.is_playable", F.lit(False)), F.col("track.restrictions").isNotNull()),
        "provider_url": url, "evidence_url": url, "evidence_type": F.lit("spotify_track"),
    }
    return _numbered(rows, columns, ["m", "a", "t"])


def community_candidates(mappings: DataFrame, releases: DataFrame, now: Column, since: str | None = None, compose: bool = True) -> DataFrame:
    """Candidates of mapped artists from their releases and appearances.

    `releases` (artist_external_id, a, item): the union of both browses; duplicates are left
    to the key check.  Media and tracks are unnested after the release's date is known.
    """
    date = partial_date(F.coalesce(F.col("r.date"), F.col("r.release-group.first-release-date")))
    r = releases.select("artist_external_id", "a", F.from_json("item", RELEASE).alias("r")).withColumn("when", date).filter(F.col("when").isNotNull() & _since(F.col("when.date"), since))
    # Tracks are numbered through all media, so that a long medium can't run into the next.
    listed = F.flatten(F.transform(F.array_sort(F.transform("r.media", lambda m: F.struct(m["position"].alias("position"), m["tracks"].alias("tracks")))), lambda m: F.transform(m["tracks"], lambda x: F.struct(m["position"].alias("position"), x.alias("track")))))
    rows = mappings.join(r, "artist_external_id").select("*", F.posexplode(listed).alias("t", "_place")).withColumns({"medium": F.struct(F.col("_place.position").alias("position")), "track": F.col("_place.track")}).drop("_place")
    watched = F.col("artist_external_id")
    takes_part = lambda c: F.exists(c, lambda x: x["artist"]["id"] == watched)
    rows = rows.filter(takes_part(F.col("track.artist-credit")) | takes_part(F.col("r.artist-credit")))
    named = F.transform("track.artist-credit", lambda c: F.struct(c["artist"]["id"].alias("id"), c["name"].alias("name")))
    rows = rows.withColumn("own", positional_roles(named, watched))
    kind = typed_release(F.col("r.release-group.primary-type"), F.col("r.release-group.secondary-types"), compose)
    url = F.concat(F.lit("https://musicbrainz.org/recording/"), F.col("track.recording.id"))
    columns = {
        "provider": F.lit("musicbrainz"), "external_release_id": F.col("r.id"), "external_track_id": F.col("track.recording.id"), "source_label": F.lit("MusicBrainz community metadata"),
        "artist_external_id": watched, "artist_name": F.col("artist_name"), "title": F.coalesce(blank_to_null(F.col("track.title")), F.col("track.recording.title")), "release_title": F.col("r.title"),
        "release_type": feature_override(F.col("own"), kind), "release_date": F.col("when.date"), "release_date_precision": F.col("when.precision"), "first_seen_at": now, "credits": F.col("own"),
        "duration_ms": F.coalesce("track.length", "track.recording.length"), "disc_number": F.col("medium.position"), "track_number": F.col("track.position"),
        "isrc": blank_to_null(F.get("track.recording.isrcs", F.lit(0))), "upc": blank_to_null(F.col("r.barcode")), "musicbrainz_recording_id": F.col("track.recording.id"), "musicbrainz_release_group_id": F.col("r.release-group.id"),
        "region": region_code(F.col("r.country")), "availability": F.lit("unavailable"), "provider_url": url, "evidence_url": url, "evidence_type": F.lit("musicbrainz_recording"), "is_upcoming": is_upcoming(F.col("when.date"), now),
    }
    return _numbered(rows, columns, ["m", "a", "t"])


def mapped_artists(external_ids: DataFrame, artists: DataFrame, aliases: DataFrame, provider: str, artist_id: str | None = None) -> DataFrame:
    """Confirmed mappings of a provider with the artist's name and aliases as an array."""
    confirmed = external_ids.filter((F.col("provider") == provider) & F.col("confirmed"))
    if artist_id is not None:
        confirmed = confirmed.filter(F.col("artist_id") == artist_id)
    grouped = aliases.groupBy("artist_id").agg(F.array_sort(F.collect_list("name")).alias("aliases"))
    out = confirmed.select("artist_id", F.col("external_id").alias("artist_external_id")).join(artists.select("artist_id", F.col("name").alias("artist_name")), "artist_id")
    return out.join(grouped, "artist_id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
