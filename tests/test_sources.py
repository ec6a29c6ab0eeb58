"""Sources with canned answers."""

import datetime as dt
import json
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from spindrift.plans.artists import artist_score, map_or_propose
from spindrift.plans.exports import create_playlist, export_batches, plan_and_write, record_exports, write_batches
from spindrift.plans.imports import import_counts
from spindrift.sources import composite, paged, registry, services
from spindrift.sources.fixture import fixture_source

from .conftest import ROOT


def document(**changes):
    candidate = {
        "provider": "mock", "externalReleaseId": "r", "externalTrackId": "t", "sourceLabel": "s", "artistExternalId": "a", "artistName": "A", "title": "T", "releaseTitle": "R", "releaseType": "single",
        "releaseDate": "2030-05-01", "releaseDatePrecision": "day", "firstSeenAt": "2030-04-01T09:00:00.000Z", "credits": [{"name": "A", "role": "primary"}], "durationMs": 5, "region": "US", "availability": "playable",
        "providerUrl": "https://e.test/p", "evidenceUrl": "https://e.test/e", "evidenceType": "f", "payloadHash": "12345678", "unknown": 1,
    } | changes
    return {"fixtureVersion": 1, "candidates": [candidate, candidate | {"externalTrackId": "t2", "provider": "spotify"}]}


def test_fixture_documents(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(document()))
    rows = fixture_source(spark, str(tmp_path / "good.json")).collect()
    assert [(r.ordinal, r.external_track_id, r.duration_ms, r.first_seen_at.minute) for r in rows] == [(0, "t", 5, 0)]
    for n, bad in enumerate((document(durationMs="x"), document(region="USA"), {"fixtureVersion": 2, "candidates": []})):
        (tmp_path / f"bad{n}.json").write_text(json.dumps(bad))
        with pytest.raises(Exception):
            fixture_source(spark, str(tmp_path / f"bad{n}.json")).collect()


PAGES = {None: {"items": [1, 2], "cursors": {"after": "x"}, "next": "u"}, "x": {"items": [3], "cursors": {"after": None}, "next": None}}


def test_cursor_chain_and_retries():
    assert list(paged.chain(lambda k, at: PAGES[at], "k", paged.Paging("cursor"))) == [1, 2, 3]
    tries, waits = [], []

    def shaky(key, at):
        tries.append(at)
        if len(tries) < 3:
            raise paged.Transient("busy", after_ms=7000 if len(tries) == 1 else None)
        return {"items": []}

    paged.fetch_page(shaky, "k", 0, paged.Paging("next"), sleep=waits.append, jitter=lambda: 1.0)
    assert waits == [7.0, 0.5]
    with pytest.raises(ValueError):
        paged.fetch_page(lambda k, a: (_ for _ in ()).throw(ValueError("permanent")), "k", 0, paged.Paging("next"))


def offsets(key, at):
    items = [{"n": i} for i in range(int(key))]
    return {"items": items[at : at + 3], "total": len(items), "next": "u" if at + 3 < len(items) else None}


@pytest.mark.parametrize("style", ["next", "total"])
def test_paged_sources(spark, style):
    keys = spark.createDataFrame([("7",), ("0",), ("3",), ("7",)], "key string")
    rows = paged.fetched(keys, "key", offsets, paged.Paging(style)).collect()
    want = sorted((k, i) for k in ("7", "3") for i in range(int(k)))
    assert sorted((r.key, json.loads(r.item)["n"]) for r in rows) == want and all(json.loads(r.item)["n"] == r.position for r in rows)
    spark.dataSource.register(paged.paged_source(f"canned_{style}", offsets, paged.Paging(style)))
    read = spark.read.format(f"canned_{style}").option("keys", "7,0,3").load().collect()
    assert sorted((r.key, r.position) for r in read) == want
    got = paged.looked_up(keys, "key", lambda k: {"id": k} if k != "0" else None).collect()
    assert sorted(r.key for r in got) == ["3", "7"]


def test_catalogue_scan(spark):
    mappings = spark.createDataFrame([(0, "w", "Watched")], "m int, artist_external_id string, artist_name string")
    album = lambda i, date, artists: json.dumps({"id": i, "name": "Album", "album_type": "single", "artists": [{"id": a, "name": a} for a in artists], "release_date": date, "release_date_precision": "month", "total_tracks": 2})
    track = lambda i, artists: json.dumps({"id": i, "name": f"Track {i}", "artists": [{"id": a, "name": a.upper()} for a in artists], "disc_number": 1, "track_number": 1, "duration_ms": 9, "is_playable": i == "1", "external_ids": {"isrc": "isrc1"}, "external_urls": {"spotify": "https://e.test/" + i}})
    albums = spark.createDataFrame([("w", 0, album("A", "2030-05", ["w"])), ("w", 1, album("B", "2030-06", ["o"])), ("w", 2, album("C", "2029", ["w"]))], "artist_external_id string, a int, item string")
    tracks = spark.createDataFrame([("A", 0, track("1", ["w", "o"])), ("A", 1, track("2", ["o"])), ("B", 0, track("3", ["o"])), ("B", 1, track("4", ["o", "w"])), ("C", 0, track("5", ["w"]))], "album_id string, t int, item string")
    now = F.lit(dt.datetime(2030, 4, 1))
    rows = composite.catalogue_candidates(mappings, albums, tracks, now, since="2030-01-01").orderBy("ordinal").collect()
    assert [(r.external_track_id, r.release_type, r.release_date, r.availability) for r in rows] == [("1", "ep", "2030-05-01", "playable"), ("2", "feature", "2030-05-01", "unavailable"), ("4", "feature", "2030-06-01", "unavailable")]
    assert [(c.name, c.role) for c in rows[2].credits] == [("O", "primary"), ("W", "featured")] and len({r.payload_hash for r in rows}) == 3
    later = composite.catalogue_candidates(mappings, albums, tracks, F.lit(dt.datetime(2031, 1, 1)), since="2030-01-01").orderBy("ordinal").collect()
    assert [r.payload_hash for r in later] == [r.payload_hash for r in rows]


def test_community_scan(spark):
    credit = lambda *ids: [{"name": i.upper(), "artist": {"id": i, "name": i}} for i in ids]
    release = {
        "id": "R", "title": "Release", "date": None, "country": "GB", "barcode": "123456", "artist-credit": credit("o"), "release-group": {"id": "G", "first-release-date": "2030-06", "primary-type": "Album", "secondary-types": ["Live"]},
        "media": [{"position": 2, "tracks": [{"id": "x", "title": "", "position": 4, "length": None, "artist-credit": credit("o", "w"), "recording": {"id": "rec", "title": "Song", "length": 11, "isrcs": ["i1"]}}, {"id": "y", "title": "Not", "position": 5, "artist-credit": credit("o"), "recording": {"id": "rec2", "title": "Not", "isrcs": []}}]}],
    }
    mappings = spark.createDataFrame([(0, "w", "Watched")], "m int, artist_external_id string, artist_name string")
    docs = spark.createDataFrame([("w", 0, json.dumps(release)), ("w", 1, json.dumps(release | {"release-group": {"id": "G"}}))], "artist_external_id string, a int, item string")
    (r,) = composite.community_candidates(mappings, docs, F.lit(dt.datetime(2030, 5, 1))).collect()
    assert (r.title, r.release_type, r.release_date, r.release_date_precision, r.is_upcoming, r.region, r.duration_ms, r.disc_number, r.upc) == ("Song", "feature", "2030-06-01", "month", True, "GB", 11, 2, "123456")


def test_options_and_selection():
    now = dt.datetime(2030, 5, 1)
    o = registry.parse_options(["--", "--dry-run", "--artist", "a1", "--since", "2030-01-02", "--provider", "spotify"], now)
    assert (o.dry_run, o.artist_id, o.since, o.provider, o.since_date()) == (True, "a1", "2030-01-02", "spotify", "2030-01-02")
    assert registry.parse_options([], now).since_date() == "2030-03-02" and registry.parse_options(["--full"], now).since_date() is None
    for bad in (["--artist"], ["--since", "x"], ["--provider", "nope"], ["--what"]):
        with pytest.raises(ValueError):
            registry.parse_options(bad, now)
    keys = {"SPOTIFY_CLIENT_ID": "a", "SPOTIFY_CLIENT_SECRET": "b", "APP_ENCRYPTION_KEY": "c"}
    assert registry.select_sources(None, {}) == ["mock"] and registry.select_sources(None, keys) == ["spotify"] and registry.select_sources(None, keys | {"SPOTIFY_ENABLED": "false"}) == ["mock"]
    with pytest.raises(ValueError):
        registry.select_sources("tidal", {})


def test_artist_score_and_mapping(spark):
    df = spark.createDataFrame([("Name", ["Alias"], "NAME!", ["alias"], 100, "uk band"), ("Name", [], "Other", [], 50, None), ("Name", [], "Name", ["x"], 100, "")], "n string, a array<string>, f string, fa array<string>, s int, d string")
    got = [r[0] for r in df.select(artist_score(F.col("n"), F.col("a"), F.col("f"), F.col("fa"), F.col("s"), F.col("d"))).collect()]
    assert [g.millis for g in got] == [970, 225, 850] and len(got[0].reasons) == 4
    rows = spark.createDataFrame([("a", 1, 970), ("a", 2, 890), ("b", 1, 970), ("b", 2, 891), ("c", 1, 100), ("c", 2, 970)], "k string, i int, m int")
    assert sorted(tuple(r) for r in map_or_propose(rows, ["k"], "i", "m").collect()) == [("a", 1, 970, "mapped"), ("b", 1, 970, "proposed"), ("b", 2, 891, "proposed"), ("c", 1, 100, "proposed"), ("c", 2, 970, "proposed")]


def test_export_batches(spark):
    plan = spark.range(205).select(F.col("id").alias("ordinal"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("provider_track_id"), F.lit("add").alias("bucket"))
    sent = write_batches(export_batches(plan), lambda ids: f"snap-{ids[0]}").orderBy("batch").collect()
    assert [(r.batch, r.n_items, r.snapshot_id) for r in sent] == [(0, 100, "snap-t0"), (1, 100, "snap-t100"), (2, 5, "snap-t200")]


def service(path, parameters):
    """Canned answers of both services."""
    at, size = parameters.get("offset", 0), parameters.get("limit", 0)
    of = lambda n: [{"id": f"{path.split('/')[2] if path.count('/') > 1 else 'x'}-{i}"} for i in range(n)]
    if path == "/me/following":
        return {"artists": {"items": [{"id": f"f{parameters.get('after', '0')}"}], "next": "u" if "after" not in parameters else None, "cursors": {"after": "1" if "after" not in parameters else None}}}
    if path.startswith("/playlists/"):
        items = [{"item": {"id": "a"}}, {"item": None}, {"item": {"id": "b"}}, {"item": {"id": "a"}}, {"track": {"id": "c"}}]
        return {"items": items[at : at + 2], "next": "u" if at + 2 < len(items) else None}
    if path == "/search":
        return {"artists": {"items": [{"id": parameters["q"]}, {"id": "other"}]}}
    if path == "/artist":
        return {"artists": [{"id": parameters["query"], "score": 90}]}
    if path in ("/release", "/release-group"):
        key = parameters.get("artist") or parameters["track_artist"]
        rows = [{"id": f"{key}{i}"} for i in range(3)]
        return {f"{path[1:]}s": rows[at : at + 2], f"{path[1:]}-count": 3}
    rows = of(size + 1)
    return {"items": rows[at : at + size], "next": "u" if at + size < len(rows) else None}


def test_named_readers(spark):
    ids = lambda df: sorted(json.loads(r.item)["id"] for r in df.collect())
    keys = lambda name, *values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    assert ids(services.followed_artists(spark, service)) == ["f0", "f1"]
    assert services.artist_albums(keys("artist_external_id", "k", "m", "k"), service).groupBy("artist_external_id").count().collect().__len__() == 2
    assert services.artist_albums(keys("artist_external_id", "k"), service).count() == 11
    assert services.album_tracks(keys("album_id", "k"), service).count() == services.my_playlists(spark, service).count() == 51
    assert sorted(r.provider_track_id for r in services.playlist_track_ids(keys("playlist_id", "p"), service).collect()) == ["a", "b", "c"]
    assert ids(services.artists_named(keys("query", "q"), service)) == ["other", "q"]
    assert ids(services.community_artists(keys("query", "q"), service)) == ["q"]
    for link in ("artist", "track_artist"):
        assert ids(services.browsed_releases(keys("artist_external_id", "k"), service, link)) == ["k0", "k1", "k2"]
    assert ids(services.browsed_release_groups(keys("artist_external_id", "k"), service)) == ["k0", "k1", "k2"]
    with pytest.raises(ValueError):
        services.browsed_releases(keys("artist_external_id", "k"), service, "label")


def test_requests_are_metered(spark):
    def shaky(path, parameters):
        if path == "/bad":
            raise paged.Transient("busy", after_ms=300)
        return {}

    get = services.Metered(spark, shaky)
    get("/good", {})
    with pytest.raises(paged.Transient):
        get("/bad", {})

    def enriched(batches):
        for rows in batches:
            get("/good", {})
            yield rows

    spark.createDataFrame([("k",)], "key string").coalesce(1).mapInPandas(enriched, "key string").count()
    assert (get.requests.value, get.failures.value, get.wait_ms.value) == (3, 1, 300)


def test_a_long_medium_does_not_run_into_the_next(spark):
    credit = [{"name": "A", "artist": {"id": "a", "name": "A"}}]
    track = lambda i: {"id": f"t{i}", "title": f"T{i}", "position": i, "length": 1000, "artist-credit": credit, "recording": {"id": f"r{i}", "title": "R", "length": 1000, "isrcs": []}}
    release = {"id": "x", "title": "X", "date": "2030-01-01", "artist-credit": credit, "release-group": {"id": "g", "title": "G", "secondary-types": []}, "media": [{"position": 1, "tracks": [track(i) for i in range(2500)]}, {"position": 2, "tracks": [track(i) for i in range(2500, 3000)]}]}
    mapped = spark.createDataFrame([(0, "a", "A")], "m int, artist_external_id string, artist_name string")
    releases = spark.createDataFrame([("a", 0, json.dumps(release))], "artist_external_id string, a int, item string")
    rows = composite.community_candidates(mapped, releases, F.lit(dt.datetime(2030, 1, 2))).select("ordinal", "disc_number", "external_track_id").orderBy("ordinal").collect()
    assert len({r.ordinal for r in rows}) == 3000 and [r.external_track_id for r in rows] == [f"r{i}" for i in range(3000)]
    assert [r.disc_number for r in rows] == [1] * 2500 + [2] * 500


def test_plan_and_write(spark):
    items = spark.createDataFrame([(k, f"t{k % 4}", "exact_isrc", 1.0, False) for k in range(6)], "ordinal int, provider_track_id string, match_rule string, confidence double, manually_confirmed boolean")
    plan, sent = plan_and_write(items, spark.createDataFrame([("t1",)], "provider_track_id string"), lambda ids: ",".join(ids), size=2)
    assert {r.provider_track_id: r.bucket for r in plan.collect()} == {"t0": "add", "t1": "present", "t2": "add", "t3": "add"}
    assert sorted((r.n_items, r.snapshot_id) for r in sent.collect()) == [(1, "t3"), (2, "t0,t2")]
    assert create_playlist(lambda path, body: {"path": path, **body}, "u", "N") == {"path": "/users/u/playlists", "name": "N", "description": "", "public": False}
    exports = spark.createDataFrame([("p", "t0", "c0", "failed", None)], "target_id string, provider_track_id string, track_id string, status string, exported_at timestamp")
    wanted = items.selectExpr("'p' AS target_id", "provider_track_id", "provider_track_id AS track_id", "ordinal")
    rows = record_exports(exports, plan.filter("bucket = 'add'"), wanted, F.lit(dt.datetime(2030, 1, 2))).collect()
    assert sorted((r.provider_track_id, r.status) for r in rows) == [("t0", "exported"), ("t2", "exported"), ("t3", "exported")]
    done = spark.createDataFrame([("created",), ("created",), ("skipped",)], "outcome string")
    assert tuple(import_counts(done).first()) == (2, 0, 0, 1)


def test_calls_are_columns_of_the_rows_they_gave(spark):
    def page(key, at):
        if key == "busy" and at == 0 and not tries.append(at) and len(tries) == 1:
            raise paged.Transient("busy", after_ms=20)
        n = {"none": 0, "long": 1100, "busy": 3}[key]
        return {"items": list(range(at, min(n, at + 100))), "total": n}

    tries: list[int] = []
    keys = spark.createDataFrame([("none",), ("long",), ("busy",), ("long",), (None,)], "key string")
    rows = paged.fetched(keys, "key", page, paged.Paging("total"), metered=True)
    got = {r.key: tuple(r)[1:] for r in rows.groupBy("key").agg(F.count("item"), F.count("*"), *(F.sum(c) for c in paged.METER)).collect()}
    assert got == {"none": (0, 1, 1, 0, 0), "long": (1100, 1100, 11, 0, 0), "busy": (3, 3, 2, 1, 20)}
    shown, seen = paged.observed(rows)
    assert shown.columns == ["key", "position", "item"] and shown.count() == 1103
    assert seen.get == {"requests": 14, "failures": 1, "wait_ms": 20}
    known = paged.looked_up(keys, "key", lambda k: {"k": k} if k == "busy" else None, metered=True)
    shown, seen = paged.observed(known, "lookups")
    assert [r.key for r in shown.collect()] == ["busy"] and seen.get["requests"] == 3
    assert paged.counts_of(seen)["failures"] == 0 and paged.counts_of(paged.observed(rows, "unread")[1], 0.5) == {}
    shown, seen = paged.observed(paged.fetched(keys.limit(0), "key", page, paged.Paging("total"), metered=True), "nothing")
    assert shown.count() == 0 and seen.get == {"requests": 0, "failures": 0, "wait_ms": 0}


def test_a_retried_task_leaves_the_counts_as_they_are(tmp_path):
    """In a session of its own, as tasks of this one are not retried."""
    code = f"""
import os, sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from spindrift.sources import paged
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
calls = spark.sparkContext.accumulator(0)
def page(key, at):
    calls.add(1)
    with open({str(tmp_path)!r} + "/asked", "a") as f:
        f.write(key)
    if key == "b" and at == 2 and not os.path.exists({str(tmp_path)!r} + "/lost"):
        open({str(tmp_path)!r} + "/lost", "w").close()
        raise OSError("the executor was lost")
    return {{"items": [at], "total": 3}}
rows, seen = paged.observed(paged.fetched(spark.createDataFrame([("a",), ("b",)], "key string"), "key", page, paged.Paging("total"), metered=True))
rows.write.parquet({str(tmp_path)!r} + "/rows")
print("counts", spark.read.parquet({str(tmp_path)!r} + "/rows").count(), seen.get["requests"], len(open({str(tmp_path)!r} + "/asked").read()))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=180)
    n_rows, counted, asked = map(int, re.search(r"counts (\d+) (\d+) (\d+)", done.stdout).groups())
    assert (n_rows, counted) == (6, 6) and asked > 6
