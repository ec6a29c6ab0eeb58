"""Keyed writes, numbering and set operations."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.operators import keyed, nested
from spindrift.streaming import gates


def test_insert_or_ignore(spark):
    target = spark.createDataFrame([("a", 0)], "k string, v int")
    incoming = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2), (None, 4), (None, 4)], "k string, v int")
    got = sorted(keyed.insert_or_ignore(target, incoming, ["k"], "v").collect(), key=str)
    assert [tuple(r) for r in got] == [("b", 2), (None, 4), (None, 4)]
    assert keyed.insert_or_ignore(target, incoming.limit(0), ["k"], "v").count() == 0


def test_rows_without_a_whole_key_are_counted_and_given_back(spark):
    n = 2 * 65536 + 3
    copies = spark.range(n).selectExpr("CAST(null AS string) AS k", "7 AS v")
    others = spark.createDataFrame([(None, None), ("a", 1), ("a", 0), (None, 8), (None, 8)], "k string, v int")
    rows = keyed.insert_or_ignore(others.limit(0), copies.union(others), ["k"], "v")
    assert {(r.k, r.v): r["count"] for r in rows.groupBy("k", "v").count().collect()} == {(None, 7): n, (None, None): 1, (None, 8): 2, ("a", 0): 1}
    only_keys = keyed.insert_or_ignore(others.select("k").limit(0), others.select("k"), ["k"])
    assert sorted((r.k for r in only_keys.collect()), key=str) == [None, None, None, "a"]
    stored = spark.createDataFrame([(None, "x", 1), (None, "x", 1), ("a", "x", 1)], "k string, kept string, new int")
    given = spark.createDataFrame([(None, "x", 1, 5), (None, "y", None, 5), ("a", "y", 2, 5)], "k string, kept string, new int, at int")
    rows = keyed.upsert(stored, given, ["k"], "at", ["new"]).collect()
    assert sorted(map(tuple, rows), key=str) == [("a", "x", 2), *[(None, "x", 1)] * 3, (None, "y", None)]


def test_incoming_rows_are_computed_once(spark, sf_dir):
    from spindrift.queries import QUERIES

    plan = QUERIES["q_insert_ignore"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("FileScan") == 1


def test_upsert_keeps_and_replaces(spark):
    target = spark.createDataFrame([("a", "first", "old")], "k string, kept string, new string")
    incoming = spark.createDataFrame([("a", "x", "n1", 1), ("a", "y", None, 2), ("b", "first b", "m2", 4), ("b", "z", "m1", 3)], "k string, kept string, new string, at int")
    got = {r.k: (r.kept, r.new) for r in keyed.upsert(target, incoming, ["k"], "at", ["new"]).collect()}
    assert got == {"a": ("first", None), "b": ("z", "m2")}


def test_overrides_and_once(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k int, x string, y string")
    over = spark.createDataFrame([(1, None)], "k int, x string")
    assert {r.k: r.x for r in keyed.apply_overrides(df, over, ["k"], "x").collect()} == {1: None, 2: "c"}
    once = spark.createDataFrame([("s", 1, False), ("s", 2, True), ("s", 3, True)], "k string, at int, ok boolean")
    assert [r.at for r in keyed.consume_once(once, "k", "at", F.col("ok")).collect()] == [2]


def test_numbering_over_the_whole_table(spark):
    rows = [(i, random.Random(i).random()) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, x double").repartition(7)
    got = {r.i: r.position for r in keyed.numbered(df, ["x", "i"]).collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    chunks = keyed.chunked(df, 100, ["x", "i"]).groupBy("chunk").count().collect()
    assert sorted((r["chunk"], r["count"]) for r in chunks) == [(k, 100) for k in range(5)]
    assert keyed.numbered(df.limit(0), ["x"]).count() == 0


def test_ordered_children(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None)], "p int, o int, n string")
    got = {r.p: [x.n for x in r.children] for r in nested.ordered_children(df, ["p"], ["o"], ["n"]).collect()}
    assert got == {1: ["a", "b"], 2: [None]}
    parents = spark.createDataFrame([(1,), (3,)], "p int")
    filled = nested.with_children(parents, nested.ordered_children(df, ["p"], ["o"], ["n"]), ["p"])
    assert {r.p: len(r.children) for r in filled.collect()} == {1: 2, 3: 0}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.booleans(), st.booleans()), min_size=1, max_size=12))
def test_three_way_split_partitions_keys(spark, rows):
    items = spark.createDataFrame([(k, ok, n) for n, (k, ok, _) in enumerate(rows)], "k string, ok boolean, n int")
    there = spark.createDataFrame([(k,) for k, _, p in rows if p], "k string")
    got = {r.k: r.bucket for r in keyed.three_way_split(items, there, "k", "n", F.col("ok")).collect()}
    first = {}
    for k, ok, _ in rows:
        first.setdefault(k, ok)
    present = {k for k, _, p in rows if p}
    assert got == {k: "rejected" if not ok else "present" if k in present else "add" for k, ok in first.items()}


# -- gates ------------------------------------------------------------------------------------


def events(seed=3, n=400, keys=3):
    rng = random.Random(seed)
    at = 0
    out = []
    for i in range(n):
        at += rng.choice([0, 1, 5, 40])
        out.append((i, rng.choice("abcdef"[:keys]), rng.choice("xyz"), at))
    return out


def test_rate_gate_equals_the_recurrence(spark):
    rows = events()
    df = spark.createDataFrame(rows, "i long, k string, h string, at long").repartition(5)
    got = {r.i: r.start_us for r in gates.rate_gate(df, F.col("at"), ["at", "i"], 10).collect()}
    last, want = None, {}
    for i, _, _, at in rows:
        last = at if last is None else max(at, last + 10)
        want[i] = last
    assert got == want
    by = {r.i: r.start_us for r in gates.rate_gate(df, F.col("at"), ["at", "i"], 10, by=["k"]).collect()}
    ends, want = {}, {}
    for i, k, _, at in rows:
        ends[k] = at if k not in ends else max(at, ends[k] + 10)
        want[i] = ends[k]
    assert by == want


def test_window_counter_and_lease(spark):
    rows = events(7)
    df = spark.createDataFrame(rows, "i long, k string, h string, at long").repartition(5)
    got = {r.i: r.granted for r in gates.replay(df, "k", "at", "i", "h", gates.WindowCounter(3, 50)).collect()}
    opened, want = {}, {}
    for i, k, _, at in rows:
        if k not in opened or opened[k][0] <= at:
            opened[k] = [at + 50, 0]
        opened[k][1] += 1
        want[i] = opened[k][1] <= 3
    assert got == want
    got = {r.i: r.granted for r in gates.replay(df, "k", "at", "i", "h", gates.Lease(30)).collect()}
    until, want = {}, {}
    for i, k, _, at in rows:
        want[i] = k not in until or until[k] < at
        if want[i]:
            until[k] = at + 30
    assert got == want


def test_gate_as_a_stream(spark, tmp_path):
    rows = events(9, 120)
    df = spark.createDataFrame(rows, "i long, k string, h string, at long")
    df.filter("i < 60").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    schema = df.schema
    step = gates.WindowCounter(2, 60)

    def drain():
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = gates.gate_stream(source, "k", "at", "i", "h", step)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    drain()
    df.filter("i >= 60").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    drain()
    got = {r.i: r.granted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.i: r.granted for r in gates.replay(df, "k", "at", "i", "h", step).collect()}
