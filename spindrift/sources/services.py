"""Named readers of the two services, over the paged sources.

A `Get` takes a path and its parameters and returns one decoded answer; tests give canned
ones.  Readers of many keys take a DataFrame of ids and spread the chains over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .paged import Fetch, Paging, fetched, looked_up

Get = Callable[[str, dict], dict]

# Page sizes and parameters of the services.
PAGE = 50
ALBUM_PAGE, ALBUM_GROUPS = 10, "album,single,compilation,appears_on"
BROWSE_PAGE = 100
SEARCH_PAGE = 10
RELEASE_INCLUDES = "artist-credits+media+recordings+isrcs+release-groups"


def _offsets(get: Get, path: Callable[[str], str], size: int, **parameters) -> Fetch:
    return lambda key, at: get(path(key), {"limit": size, "offset": at, **parameters})


def _one(spark: SparkSession, key: str) -> DataFrame:
    return spark.createDataFrame([(key,)], "key string")


def followed_artists(spark: SparkSession, get: Get) -> DataFrame:
    """(position, item) of the followed artists: one cursor chain."""

    def page(_: str, after: object) -> dict:
        return get("/me/following", {"type": "artist", "limit": PAGE, **({"after": after} if after else {})})["artists"]

    return fetched(_one(spark, "me"), "key", page, Paging("cursor")).select("position", "item")


def artist_albums(artists: DataFrame, get: Get, key: str = "artist_external_id", width: int | None = None, metered: bool = False) -> DataFrame:
    """(artist, position, item) of the albums of all groups of each artist."""
    return fetched(artists, key, _offsets(get, lambda k: f"/artists/{k}/albums", ALBUM_PAGE, include_groups=ALBUM_GROUPS), Paging("next"), width, metered)


def album_tracks(albums: DataFrame, get: Get, key: str = "album_id", width: int | None = None, metered: bool = False) -> DataFrame:
    return fetched(albums, key, _offsets(get, lambda k: f"/albums/{k}/tracks", PAGE), Paging("next"), width, metered)


def my_playlists(spark: SparkSession, get: Get) -> DataFrame:
    return fetched(_one(spark, "me"), "key", _offsets(get, lambda _: "/me/playlists", PAGE), Paging("next")).select("position", "item")


def playlist_track_ids(playlists: DataFrame, get: Get, key: str = "playlist_id", width: int | None = None) -> DataFrame:
    """(playlist, provider_track_id), each once; places whose track is gone are left out."""
    items = fetched(playlists, key, _offsets(get, lambda k: f"/playlists/{k}/items", PAGE), Paging("next"), width)
    track = F.coalesce(F.get_json_object("item", "$.item.id"), F.get_json_object("item", "$.track.id"))
    return items.select(key, track.alias("provider_track_id")).dropna().distinct()


def artists_named(queries: DataFrame, get: Get, key: str = "query") -> DataFrame:
    """(query, item): the first page of a search, an answer of ten artists at most."""
    found = looked_up(queries, key, lambda q: get("/search", {"q": q, "type": "artist", "limit": SEARCH_PAGE})["artists"])
    return found.select(key, F.posexplode(F.from_json(F.get_json_object("item", "$.items"), "array<string>")).alias("position", "item"))


def community_artists(queries: DataFrame, get: Get, key: str = "query") -> DataFrame:
    """(query, position, item): the first ten artists for a query of quoted terms, such as
    `functions.text.any_of_terms` builds from a name and its aliases."""
    found = looked_up(queries, key, lambda q: get("/artist", {"query": q, "limit": SEARCH_PAGE, "offset": 0, "fmt": "json"}))
    return found.select(key, F.posexplode(F.from_json(F.get_json_object("item", "$.artists"), "array<string>")).alias("position", "item"))


def browsed_releases(artists: DataFrame, get: Get, link: str = "artist", key: str = "artist_external_id", width: int | None = None, metered: bool = False) -> DataFrame:
    """(artist, position, item) of the releases of each artist, or with the link
    `track_artist` of those it appears on, until the total is reached."""
    if link not in ("artist", "track_artist"):
        raise ValueError("the link is artist or track_artist")

    def page(k: str, at: object) -> dict:
        answer = get("/release", {link: k, "inc": RELEASE_INCLUDES, "limit": BROWSE_PAGE, "offset": at, "fmt": "json"})
        return {"items": answer["releases"], "total": answer["release-count"]}

    return fetched(artists, key, page, Paging("total"), width, metered)


def browsed_release_groups(artists: DataFrame, get: Get, key: str = "artist_external_id", width: int | None = None, metered: bool = False) -> DataFrame:
    def page(k: str, at: object) -> dict:
        answer = get("/release-group", {"artist": k, "limit": BROWSE_PAGE, "offset": at, "fmt": "json"})
        return {"items": answer["release-groups"], "total": answer["release-group-count"]}

    return fetched(artists, key, page, Paging("total"), width, metered)


class Metered:
    """A `Get` that counts its calls: `requests`, `failures` and `wait_ms` are accumulators,
    so that calls made in tasks add up on the driver.  A retried task counts again; readers
    with `metered` give their calls as columns instead (see `paged.observed`)."""

    def __init__(self, spark: SparkSession, get: Get):
        self.get = get
        self.requests, self.failures, self.wait_ms = (spark.sparkContext.accumulator(0) for _ in range(3))

    def __call__(self, path: str, parameters: dict) -> dict:
        self.requests.add(1)
        try:
            return self.get(path, parameters)
        except Exception as e:
            self.failures.add(1)
            self.wait_ms.add(int(getattr(e, "after_ms", None) or 0))
            raise
