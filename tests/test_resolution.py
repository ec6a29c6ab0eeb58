"""Matching and batch resolution against a row-by-row version, and the golden numbers."""

import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from spindrift.plans import matching, resolution
from spindrift.plans.runs import Options, recent_runs, run_scan, with_cursor
from spindrift.schemas import CANDIDATE, TRACK, candidate_rules, table_schema, validated, violations
from spindrift.storage import Added, Conflict, Store
from spindrift.streaming.incremental import resolve_stream

from .fixtures import candidate, five_candidates

NAMES = [f.name for f in CANDIDATE]


def clean(s):
    return "".join(c for c in (s or "").upper() if c.isalnum())


def sequential(rows, tracks, links):
    """Decisions row by row: a list of seen tracks that grows, and linked identifiers."""
    seen, links, out = list(tracks), dict(links), {}
    for row in sorted(rows, key=lambda r: r[0]):
        c = dict(zip(NAMES, row))
        credits = "|".join(f"{r}:{n.lower()}" for n, r in c["credits"])
        link = links.get((c["provider"], c["external_track_id"]))
        own = f"new-{c['ordinal']}"
        place = (clean(c["upc"] or c["ean"]), c["track_number"], c["disc_number"] or 1)
        first = lambda ok: next((t for t in seen if ok(t)), None)
        hit = None
        if link:
            decision = ("automatic", "exact_provider_id", 100, link)
        elif c["isrc"] and (hit := first(lambda t: t["isrc"] and clean(t["isrc"]) == clean(c["isrc"]))):
            decision = ("automatic", "exact_isrc", 100, hit["id"])
        elif (c["upc"] or c["ean"]) and c["track_number"] and (hit := first(lambda t: t["place"] and t["place"] == place)):
            decision = ("automatic", "exact_barcode_position", 99, hit["id"])
        elif hit := first(lambda t: (c["musicbrainz_recording_id"] and t["rec"] == c["musicbrainz_recording_id"]) or (c["musicbrainz_release_group_id"] and t["grp"] == c["musicbrainz_release_group_id"])):
            decision = ("automatic", "exact_musicbrainz", 98, hit["id"])
        else:
            scored = []
            for t in seen:
                if t["title"] == c["title"].lower():
                    near = c["duration_ms"] is not None and t["duration"] is not None and abs(c["duration_ms"] - t["duration"]) <= 2000
                    points = 45 + 30 * (credits == t["credits"]) + 15 * (c["version"] == t["version"]) + 10 * near
                    scored.append((-points, len(scored), t, bool(c["version"] and t["version"] and c["version"] != t["version"])))
            scored.sort(key=lambda s: s[:2])
            if not scored:
                decision = ("new", "new_canonical", 100, own)
            else:
                points, _, t, conflict = scored[0]
                sure = -points >= 93 and not conflict and not (len(scored) > 1 and scored[1][0] == points)
                decision = ("automatic", "metadata", -points, t["id"]) if sure else ("review", "manual_review", -points, t["id"])
        if decision[0] == "new":
            has_place = (c["upc"] or c["ean"]) and c["track_number"]
            seen.append({"id": own, "title": c["title"].lower(), "credits": credits, "isrc": c["isrc"], "place": place if has_place else None, "rec": None, "grp": None, "version": c["version"], "duration": c["duration_ms"]})
        if decision[0] != "review":
            links.setdefault((c["provider"], c["external_track_id"]), decision[3])
        out[c["ordinal"]] = decision
    return out


def random_candidates(seed, n):
    rng = random.Random(seed)
    pick = lambda *options: rng.choice(options)
    uuid = lambda: pick(None, None, None, "00000000-0000-0000-0000-00000000000" + pick("1", "2"))
    return [
        candidate(
            i, external_release_id=f"r{rng.randrange(n)}", external_track_id=f"t{rng.randrange(n)}", title=f"Song {rng.randrange(n // 3)}", credits=[(pick("A", "B"), "primary")],
            duration_ms=pick(None, 1000, 2500, 3001, 9000), isrc=pick(None, None, f"is-rc{rng.randrange(4)}", f"ISRC{rng.randrange(4)}"), upc=pick(None, None, "upc11", "UPC-22"), ean=pick(None, None, "upc22"),
            track_number=pick(None, 1, 2), disc_number=pick(None, 1, 2), version=pick(None, None, "live", "remix"), musicbrainz_recording_id=uuid(), musicbrainz_release_group_id=uuid(),
        )
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_a_batch_equals_the_sequential_version(spark, seed):
    rows = random_candidates(seed, 40)
    old = [(-5, "old-1", "Song 1", [("A", "primary")], 1000, None, 1, "isrc0", None, None, "00000000-0000-0000-0000-000000000001", None, None), (-4, "old-2", "Song 1", [("A", "primary")], 1500, None, 2, None, "UPC22", None, None, "00000000-0000-0000-0000-000000000002", "live")]
    tracks = [{"id": t[1], "title": t[2].lower(), "credits": "primary:a", "isrc": t[7], "place": (clean(t[8]), t[6], 1) if t[8] else None, "rec": t[10], "grp": t[11], "version": t[12], "duration": t[4]} for t in old]
    links = spark.createDataFrame([("mock", "t3", "old-1")], "provider string, external_track_id string, track_id string")
    shuffled = rows[:]
    random.Random(0).shuffle(shuffled)
    decided = resolution.decide(spark.createDataFrame(shuffled, CANDIDATE), spark.createDataFrame(old, TRACK), links)
    got = decided.collect()
    names = {r.track_id: f"new-{r.ordinal}" for r in got if r.kind == "new"}
    assert {r.ordinal: (r.kind, r.rule, r.points, names.get(r.track_id, r.track_id)) for r in got} == sequential(rows, tracks, {("mock", "t3"): "old-1"})


def test_rounds_go_on_until_nothing_changes(spark, monkeypatch):
    """A chain where each row matches the track of the row before, if that made one, takes a
    round for every two rows.  Matching is replaced by this one rule, so that rounds are short."""

    def by_previous(candidates, asked, rows, columns):
        before = rows.select((F.col("ordinal") + 1).alias("ordinal"), "track_id").distinct()
        joined = candidates.join(F.broadcast(before), "ordinal", "left")
        hit = F.col("track_id").isNotNull()
        return joined.select(*columns, F.when(hit, "automatic").otherwise("new").alias("kind"), F.lit("chain").alias("rule"), F.lit(100).alias("points"), F.array(F.lit("")).alias("reasons"), "track_id")

    monkeypatch.setattr(resolution, "match_keyed", by_previous)
    rows = [candidate(i, title="Same") for i in range(104)]  # a round looks at rows that share a key
    no_links = spark.createDataFrame([], "provider string, external_track_id string, track_id string")
    got = resolution.decide(spark.createDataFrame(rows, CANDIDATE).coalesce(1), spark.createDataFrame([], TRACK), no_links).collect()
    assert sorted(r.ordinal for r in got if r.kind == "new") == list(range(0, 104, 2)) and len(got) == 104


def test_a_tie_counts_only_tracks_before_the_candidate(spark):
    same = {"title": "Song", "credits": [("A", "primary")], "duration_ms": 200000}
    track = lambda ordinal: tuple((same | {"ordinal": ordinal, "track_id": f"T{ordinal}"}).get(f.name) for f in TRACK)
    of = lambda *ordinals: matching.match(spark.createDataFrame([candidate(5, **same)], CANDIDATE), spark.createDataFrame([track(o) for o in ordinals], TRACK)).first()
    assert (of(1, 9).kind, of(1, 9).track_id) == ("automatic", "T1")  # 9 comes later and is not seen
    assert of(1, 2, 9).kind == "review" and "Multiple canonical tracks have the same score" in of(1, 2, 9).reasons
    assert of(9).kind == "new"


def test_a_failed_commit_leaves_no_trace(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    row = spark.createDataFrame([("p", "global", "default", "v")], "provider string, scope string, scope_id string, value string")
    assert store.commit({"cursors": row}) == 1
    (tmp_path / "manifests" / "2" / "_temporary" / "0").mkdir(parents=True)
    assert store.version() == 1 and store.table("cursors").count() == 1
    assert store.commit({"cursors": row.limit(0)}) == 2 and store.table("cursors").count() == 0
    assert not [f for f in (tmp_path / "manifests").iterdir() if f.name.startswith("_new")]


def test_a_source_is_asked_once(spark, tmp_path):
    """What is counted is what is stored, and the run is in the history while it lasts."""
    store = Store(spark, f"file://{tmp_path}")
    calls, seen = spark.sparkContext.accumulator(0), []

    def source(session, options):
        seen.extend(r.status for r in store.table("scan_runs").collect())

        def ask(batches):
            for rows in batches:
                calls.add(1)
                yield rows

        return session.createDataFrame([candidate(1), candidate(2)], CANDIDATE).coalesce(1).mapInPandas(ask, CANDIDATE)

    out = run_scan(store, {"mock": source}, Options(now=dt.datetime(2030, 5, 2)))
    assert (out.discovered, out.inserted, calls.value, seen) == (2, 2, 1, ["running"])
    assert [(r.status, r.discovered) for r in store.table("scan_runs").collect()] == [("completed", 2)]


def pair(spark, c, t, **more):
    """The decision on one candidate against one track."""
    base = {"title": "Song", "credits": [("A", "primary")], "duration_ms": 200000}
    track = base | t
    row = tuple((track | {"ordinal": -1, "track_id": "T"}).get(f.name) for f in TRACK)
    return matching.match(spark.createDataFrame([candidate(0, **(base | c))], CANDIDATE), spark.createDataFrame([row, *more.get("others", [])], TRACK)).first()


@pytest.mark.parametrize(
    ("c", "t", "want"),
    [
        ({"isrc": "us-mck-26-00001"}, {"isrc": "USMCK2600001"}, ("automatic", "exact_isrc", 100)),
        ({"duration_ms": 207600}, {}, ("review", "manual_review", 90)),
        ({"duration_ms": 202000}, {}, ("automatic", "metadata", 100)),
        ({"duration_ms": 202001}, {}, ("review", "manual_review", 90)),
        ({"title": "Song (Remix)", "version": "remix"}, {"title": "Song (Remix)", "version": "live"}, ("review", "manual_review", 85)),
        ({"credits": [("B", "primary")]}, {}, ("review", "manual_review", 70)),
        ({"credits": [("A", "primary"), ("B", "featured")]}, {}, ("review", "manual_review", 70)),
        ({"upc": "12345", "track_number": 3}, {"ean": "1-2345", "track_number": 3, "disc_number": 1, "title": "Other"}, ("automatic", "exact_barcode_position", 99)),
        ({"upc": "12345"}, {"upc": "12345", "track_number": 3, "title": "Other"}, ("new", "new_canonical", 100)),
        ({"title": "Else"}, {}, ("new", "new_canonical", 100)),
        ({"version": "live"}, {}, ("review", "manual_review", 85)),
    ],
)
def test_pairs(spark, c, t, want):
    got = pair(spark, c, t)
    assert (got.kind, got.rule, got.points) == want


def test_a_tie_goes_to_review(spark):
    twin = tuple({"ordinal": -2, "track_id": "U", "title": "Song", "credits": [("A", "primary")], "duration_ms": 200500}.get(f.name) for f in TRACK)
    got = pair(spark, {}, {}, others=[twin])
    assert (got.kind, got.points, got.track_id) == ("review", 100, "U") and "Multiple canonical tracks have the same score" in got.reasons


def test_golden_numbers_and_rerun(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    options = Options(now=dt.datetime(2030, 4, 2))
    source = lambda s, o: s.createDataFrame(five_candidates(), CANDIDATE)

    def broken(s, o):
        raise OSError("no answer")

    first = run_scan(store, {"mock": source, "bad": broken}, options)
    assert (first.discovered, first.inserted, first.skipped, first.needs_review) == (5, 5, 0, 1) and "bad" in first.errors
    counts = {n: store.table(n).count() for n in ("release_candidates", "tracks", "source_evidence", "announcements", "date_history", "artists", "feed_items", "releases")}
    assert counts == {"release_candidates": 5, "tracks": 3, "source_evidence": 5, "announcements": 1, "date_history": 1, "artists": 3, "feed_items": 5, "releases": 3}
    assert {r.state: r["count"] for r in store.table("feed_items").groupBy("state").count().collect()} == {"new": 3, "needs_review": 1, "upcoming": 1}
    again = run_scan(store, {"mock": source}, Options(now=dt.datetime(2030, 4, 3)))
    assert (again.discovered, again.inserted, again.skipped) == (5, 0, 5)
    dry = run_scan(store, {"mock": source}, Options(now=dt.datetime(2030, 4, 4), dry_run=True))
    assert (dry.discovered, dry.inserted) == (5, 0) and store.table("scan_runs").count() == 3
    assert [r.status for r in recent_runs(store.table("scan_runs")).collect()][0] == "completed"
    with pytest.raises(RuntimeError):
        run_scan(store, {"bad": broken}, options)
    store.truncate("tracks")
    assert store.table("tracks").count() == 0


def test_lease_and_cursor(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    now = dt.datetime(2030, 4, 2)
    with store.lease("mock", "me", now), pytest.raises(RuntimeError, match="another run"), store.lease("mock", "you", now + dt.timedelta(minutes=30)):
        pass
    with store.lease("mock", "me", now), store.lease("mock", "you", now + dt.timedelta(minutes=31)):
        pass  # ended leases are taken over, and their first owner releases nothing
    with store.lease("mock", "third", now):
        pass
    one = with_cursor(store.table("cursors"), "mock", "a")
    assert [(r.provider, r.value) for r in with_cursor(one, "mock", "b").collect()] == [("mock", "b")]


def test_candidate_rules(spark):
    good = spark.createDataFrame([candidate(0)], CANDIDATE)
    assert validated(good).count() == 1
    bad = spark.createDataFrame([candidate(0, region="USA", duration_ms=0, title="", release_date="2030-02-31", credits=[])], CANDIDATE)
    names = bad.select(violations(candidate_rules())).first()[0]
    assert sorted(names) == ["credits has one", "duration_ms is positive", "region has 2 characters", "release_date is a date", "title is filled"]
    with pytest.raises(Exception, match="invalid candidate"):
        validated(bad).collect()


def test_resolution_as_a_stream(spark, tmp_path):
    rows = five_candidates()
    store = Store(spark, f"file://{tmp_path}/store")
    for n, part in enumerate((rows[:2], rows[1:4])):
        spark.createDataFrame(part, CANDIDATE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        resolve_stream(spark, str(tmp_path / "in"), store, str(tmp_path / "check")).awaitTermination()
        assert store.table("release_candidates").count() == (2, 4)[n]
    assert store.table("tracks").count() == 2
    assert store.table("release_candidates").filter(F.col("match_rule") == "manual_review").count() == 1


def test_a_chain_of_identifiers_equals_the_sequential_version(spark):
    """Row k has the ISRC of the row before or its barcode, in turn: every second is new."""
    rows = [candidate(k, title=f"Song {k}", isrc=f"ISRC{(k + 1) // 2:05d}", upc=f"UPC{k // 2:05d}", track_number=1, artist_name=f"A{k}", credits=[(f"A{k}", "primary")]) for k in range(9)]
    no_links = spark.createDataFrame([], "provider string, external_track_id string, track_id string")
    got = resolution.decide(spark.createDataFrame(rows, CANDIDATE), spark.createDataFrame([], TRACK), no_links).collect()
    names = {r.track_id: f"new-{r.ordinal}" for r in got if r.kind == "new"}
    assert {r.ordinal: (r.kind, r.rule, r.points, names.get(r.track_id, r.track_id)) for r in got} == sequential(rows, [], {})
    assert sorted(r.ordinal for r in got if r.kind == "new") == [0, 2, 4, 6, 8]


def test_batches_through_the_index_equal_one_batch(spark, tmp_path):
    """Stored tracks are met through the match index as the tracks of the batch itself are."""
    rows = [candidate(k, title=f"Song {k % 4}", duration_ms=1000 * (k % 5), artist_name="A", credits=[("A", "primary")], isrc=f"ISRC{k % 7}", version="live" if k % 3 == 0 else None) for k in range(24)]
    found = []
    for name, parts in (("one", [rows]), ("two", [rows[:11], rows[11:]])):
        store = Store(spark, f"file://{tmp_path}/{name}")
        for n, part in enumerate(parts):
            store.transact(lambda tables, part=part, n=n: resolution.persist(spark.createDataFrame(part, CANDIDATE), tables, f"run-{n}")[0])
        found.append(sorted(tuple(r) for r in store.table("release_candidates").select("external_track_id", "match_rule", "match_confidence", "track_id").collect()))
        assert sorted(r.ordinal for r in store.table("tracks").collect()) == list(range(store.table("tracks").count()))
    assert found[0] == found[1]
    assert len(store.manifest_folders("release_candidates")) == 2  # each batch added its own rows


def _cursors(spark, *values):
    return spark.createDataFrame([("p", "global", v, v) for v in values], "provider string, scope string, scope_id string, value string")


def test_racing_commits_are_both_kept_or_one_is_refused(spark, tmp_path):
    a, b = Store(spark, f"file://{tmp_path}"), Store(spark, f"file://{tmp_path}")
    read = a.snapshot()
    assert b.commit({"cursors": _cursors(spark, "b")}) == 1
    with pytest.raises(Conflict):
        a.commit({"cursors": _cursors(spark, "a")}, read)
    assert [r.value for r in a.table("cursors").collect()] == ["b"] and len(list((tmp_path / "cursors").iterdir())) == 1
    runs = spark.createDataFrame([], table_schema("scan_runs"))
    assert a.commit({"scan_runs": runs}, read) == 2  # another table: it goes after the other commit
    assert a.table("cursors").count() == 1
    # The number is taken between the look and the publication: both are there in the end.
    take, raced = a._take, []

    def late(folder, number, content):
        if not raced:
            raced.append(b.commit({"cursors": Added(_cursors(spark, "c"))}))
        return take(folder, number, content)

    a._take = late
    assert a.commit({"cursors": Added(_cursors(spark, "d"))}) == 4 and raced == [3]
    assert sorted(r.value for r in b.table("cursors").collect()) == ["b", "c", "d"]
    assert not [f for f in (tmp_path / "manifests").iterdir() if "_new" in f.name] and not list((tmp_path / "writing").glob("*.json"))


def test_commits_from_threads(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")

    def add(k):
        def change(tables):
            return {"cursors": tables["cursors"].unionByName(_cursors(spark, str(k)))}

        return Store(spark, f"file://{tmp_path}").transact(change, attempts=20)

    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(add, range(6)))
    assert sorted(versions) == [1, 2, 3, 4, 5, 6] and sorted(r.value for r in store.table("cursors").collect()) == list("012345")


def test_deletion_leaves_no_row_on_disk(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    for v in "abc":
        store.commit({"cursors": Added(_cursors(spark, v)), "scan_runs": spark.createDataFrame([], table_schema("scan_runs"))})
    assert store.expire(keep=1) and store.table("cursors").count() == 3  # only replaced folders go
    store._write("writing/other.json", {"since": dt.datetime.now(dt.UTC).isoformat()})
    (tmp_path / "cursors" / "other").mkdir()
    (tmp_path / "cursors" / "dead").mkdir()
    store.erase("cursors")
    assert store.table("cursors").count() == 0
    left = [f for f in (tmp_path / "cursors").rglob("*.parquet")]
    assert sum(spark.read.parquet(f"file://{f}").count() for f in left) == 0
    assert (tmp_path / "cursors" / "other").exists() and not (tmp_path / "cursors" / "dead").exists()


def test_the_rename_of_other_file_systems_does_not_overwrite(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    real = store._fs

    class Remote:
        """The same files under another scheme's name."""

        def __getattr__(self, name):
            return getattr(real(), name)

        def getUri(self):
            return store._jvm.java.net.URI("hdfs://somewhere/")

    store._fs = Remote
    assert store._take("manifests", 1, {"a": []}) and not store._take("manifests", 1, {"b": []})
    assert store._said("manifests/1.json") == {"a": []}


def test_an_ended_lease_goes_to_one_only(spark, tmp_path):
    store, now = Store(spark, f"file://{tmp_path}"), dt.datetime(2030, 1, 1)
    with store.lease("mock", "first", now):
        other = Store(spark, f"file://{tmp_path}")
        real = other._take
        other._take = lambda folder, n, content: store._take(folder, n, {"until": dt.datetime.max.isoformat(), "owner": "third"}) and real(folder, n, content)
        with pytest.raises(RuntimeError, match="another run"), other.lease("mock", "second", now + dt.timedelta(hours=1)):
            pass
    with pytest.raises(RuntimeError, match="another run"), store.lease("mock", "first", now + dt.timedelta(hours=2)):
        pass  # the third one's is not given back by the first


def test_many_added_folders_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "MOST_FOLDERS", 3)
    store = Store(spark, f"file://{tmp_path}")
    for v in "abcde":
        store.transact(lambda tables, v=v: {"cursors": Added(_cursors(spark, v))})
    assert store.table("cursors").count() == 5 and len(store.manifest_folders("cursors")) == 2


def test_a_stream_refuses_a_bad_row(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    spark.createDataFrame([candidate(0), candidate(1, region="USA")], CANDIDATE).coalesce(1).write.parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="invalid candidate"):
        resolve_stream(spark, str(tmp_path / "in"), store, str(tmp_path / "check")).awaitTermination()
    assert store.version() == 0


def test_durations_of_one_title_are_searched_not_paired(spark):
    """Many tracks and candidates of one title: one row a candidate and key, right at every edge."""
    random.seed(9)
    track = lambda k, ms: tuple({"ordinal": k, "track_id": f"T{k}", "title": "Song", "credits": [("A", "primary")], "duration_ms": ms}.get(f.name) for f in TRACK)
    tracks = [track(k, random.choice([None, 1, 4001, 8002, 8003, *range(0, 20_000, 250)])) for k in range(-600, 0)]
    wanted = [random.choice([None, 0, 2000, 2001, 4001, 6001, 6002, 8002, 10_003, random.randrange(20_000)]) for _ in range(60)]
    got = matching.match(spark.createDataFrame([candidate(k, title="Song", credits=[("A", "primary")], duration_ms=ms) for k, ms in enumerate(wanted)], CANDIDATE), spark.createDataFrame(tracks, TRACK)).collect()
    for r in got:
        own = wanted[r.ordinal]
        near = sorted(t[0] for t in tracks if own is not None and t[4] is not None and abs(t[4] - own) <= 2000)
        best = near or sorted(t[0] for t in tracks)
        assert (r.points, r.track_id) == (100 if near else 90, f"T{best[0]}") and r.kind == ("automatic" if len(near) == 1 else "review")
    rows = matching.level_rows(matching.with_match_keys(spark.createDataFrame(tracks, TRACK)))
    asked = matching.asked_levels(matching.with_match_keys(spark.createDataFrame([candidate(0, title="Song", duration_ms=5000)], CANDIDATE)))
    assert asked.join(matching._by_duration(rows), "_key").count() <= asked.count()


def test_a_single_stored_track_stands_before_the_next_batch(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    same = {"isrc": "USMCK2600001"}
    for n, row in enumerate((candidate(0, **same), candidate(0, external_release_id="other", external_track_id="other", title="Other", **same))):
        batch = spark.createDataFrame([row], CANDIDATE)
        store.transact(lambda tables: resolution.persist(batch, tables, f"run-{n}")[0])  # noqa: B023
    assert sorted((r.external_track_id, r.match_status) for r in store.table("release_candidates").collect()) == [("other", "matched"), ("track-0", "new")]
    assert [r.ordinal for r in store.table("tracks").collect()] == [0]


@pytest.mark.parametrize("side", ["candidates", "tracks"])
def test_a_task_makes_keys_of_few_rows(spark, monkeypatch, side):
    """Rows in one split are dealt out before their keys are made and sorted."""
    monkeypatch.setattr(matching, "ROWS_A_TASK", 100)
    few = spark.createDataFrame([candidate(ordinal=n + 1, title=f"Title {n % 7}", external_track_id=f"e{n}") for n in range(2)], CANDIDATE)
    many = spark.createDataFrame([candidate(ordinal=n + 1, title=f"Title {n % 7}", external_track_id=f"e{n}") for n in range(500)], CANDIDATE).coalesce(1)
    tracks = (many if side == "tracks" else few).select((F.col("ordinal") - 1000).alias("ordinal"), F.concat(F.lit("T"), "ordinal").alias("track_id"), *[f.name for f in TRACK if f.name not in ("ordinal", "track_id")])
    out = matching.match(many if side == "candidates" else few, tracks)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [ordinal" in plan
    sizes = [r["count"] for r in matching.spread(many).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 500 and max(sizes) < 200
    whole = {r.ordinal: r.kind for r in out.collect()}
    monkeypatch.setattr(matching, "ROWS_A_TASK", 1000)
    assert whole == {r.ordinal: r.kind for r in matching.match(many if side == "candidates" else few, tracks).collect()}


def test_a_batch_in_one_split_is_written_in_even_files(spark, monkeypatch):
    """Joins of the rounds read by file at times, so no file may hold most of a batch's keys."""
    monkeypatch.setattr(matching, "ROWS_A_TASK", 50)
    shares, write = {}, resolution.settled

    def settled(df, name="table"):
        done = write(df, name)
        sizes = [r["count"] for r in done.groupBy(F.input_file_name()).count().collect()]
        shares.setdefault(name, max(sizes, default=0) / max(1, sum(sizes)))
        return done

    monkeypatch.setattr(resolution, "settled", settled)
    rows = [candidate(n, title=f"Title {n}", external_release_id=f"r{n}", external_track_id=f"t{n}") for n in range(400)]
    no_links = spark.createDataFrame([], "provider string, external_track_id string, track_id string")
    got = resolution.decide(spark.createDataFrame(rows, CANDIDATE).coalesce(1), spark.createDataFrame([], TRACK), no_links).collect()
    assert sorted(r.ordinal for r in got) == list(range(400)) and {r.kind for r in got} == {"new"}
    assert shares["keyed"] < 0.5 and shares["asked"] < 0.5
