"""Keyed writes in proportion to the touched ranges, null keys, and redaction token by token."""

import json
import random

import pytest

from spindrift.functions import hashing
from spindrift.operators import keyed
from spindrift.operators.ranged import RangedTable


def files(path):
    return {f.relative_to(path): f.stat().st_mtime_ns for f in (path / "rows").rglob("*.parquet")}


@pytest.fixture
def numbers(spark, tmp_path):
    rows = spark.range(200_000).selectExpr("CAST(id % 3 AS STRING) AS kind", "id AS key", "0 AS value", "'first' AS source")
    return RangedTable.create(f"file://{tmp_path}/t", rows, ["kind", "key"], 20), tmp_path / "t"


def test_a_batch_in_one_range_leaves_the_other_files(spark, numbers):
    table, path = numbers
    before = files(path)
    assert len({f.parent for f in before}) == 20
    batch = spark.range(60_000, 60_900).selectExpr("'0' AS kind", "id AS key", "CAST(id AS INT) AS value", "'second' AS source", "1 AS at").filter("key % 3 <> 1")
    for _ in range(2):  # the same rows change nothing the second time
        table.upsert(batch, "at", ["value"])
        rows = table.rows()
        assert rows.count() == 200_300 and rows.filter("value > 0").count() == 600
        assert rows.filter("source = 'second'").count() == 300  # those with key % 3 = 2 are new
    after = files(path)
    changed = {f.parent for f in before if after.get(f) != before[f]}
    assert 1 <= len(changed) <= 2 and {f: t for f, t in after.items() if f.parent not in changed} == {f: t for f, t in before.items() if f.parent not in changed}


def test_insert_update_and_rebalance(spark, numbers, tmp_path):
    table, path = numbers
    before = files(path)
    fresh = spark.createDataFrame([("0", 0, 9, "x"), ("0", 1, 9, "x"), ("0", 1, 8, "x"), ("9", 5, 9, "x"), (None, 5, 9, "x"), (None, 5, 9, "x")], "kind string, key long, value int, source string")
    table.insert_or_ignore(fresh, "value")
    after = files(path)
    assert before.items() <= after.items()  # ranges get a file more, nothing is rewritten
    assert sorted((r.kind or "", r.key, r.value) for r in table.rows().filter("source = 'x'").collect()) == [("", 5, 9), ("", 5, 9), ("0", 1, 8), ("9", 5, 9)]
    table.update(spark.createDataFrame([("9", 5), ("0", 1), ("7", 7)], "kind string, key long"), value=__import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    assert {(r.kind, r.key) for r in table.rows().filter("value = 1").collect()} == {("9", 5), ("0", 1)}
    again = table.rebalanced(f"file://{tmp_path}/again", 4)
    assert again.rows().exceptAll(table.rows()).isEmpty() and again.rows().count() == table.rows().count()


def test_an_empty_ranged_table_takes_rows(spark, tmp_path):
    empty = spark.createDataFrame([], "key string, value int")
    table = RangedTable.create(f"file://{tmp_path}/t", empty, ["key"], 3)
    table.upsert(spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1)], "key string, value int, at int"), "at", ["value"])
    assert sorted(map(tuple, table.rows().select("key", "value").collect())) == [("a", 2), ("b", 3)]


def test_null_keys_are_distinct_in_an_upsert(spark):
    target = spark.createDataFrame([(1, None, "t"), (2, 2, "t")], "a int, b int, v string")
    incoming = spark.createDataFrame([(1, None, "i", 1), (1, None, "j", 2), (2, 2, "k", 3)], "a int, b int, v string, at int")
    got = keyed.upsert(target, incoming, ["a", "b"], "at", ["v"]).collect()
    assert sorted((r.a, r.v) for r in got) == [(1, "i"), (1, "j"), (1, "t"), (2, "k")]


def plainly_redacted(value):
    if isinstance(value, list):
        return [plainly_redacted(v) for v in value]
    if isinstance(value, dict):
        import re

        return {k: "[REDACTED]" if re.search(hashing.REDACTED_KEYS, k) else plainly_redacted(v) for k, v in value.items()}
    return value


def test_redaction_equals_the_plain_version():
    random.seed(4)

    def value(depth):
        kind = random.randrange(7 if depth else 4)
        if kind > 3:
            return [value(depth - 1) for _ in range(random.randrange(4))] if kind == 4 else {random.choice(["a", "token", "État", 'q"', "x_SECRET", "b"]): value(depth - 1) for _ in range(random.randrange(4))}
        return random.choice([None, True, 3, -2.5, "é\n", "", "token", 10**20])

    for _ in range(300):
        v = value(5)
        text = json.dumps(v, indent=random.choice([None, 1]), ensure_ascii=random.random() < 0.5)
        assert hashing.redacted_json(text) == json.dumps(plainly_redacted(v), separators=(",", ":"), ensure_ascii=False)
    assert hashing.redacted_json('[1.50, 1E5, -0, {"code": [1, {"a": 2}], "n": 1.0}]') == '[1.50,1E5,-0,{"code":"[REDACTED]","n":1.0}]'


@pytest.mark.parametrize("text", ["", " ", "{", "[1,]", "[,1]", '{"a"}', '{"a":}', '{"a":1,}', "1 2", "[1}", "]", '"a', "nul", "01", '{"token": [}', "[1 2]", '{1:2}', ":"])
def test_what_is_no_json_is_refused(text):
    with pytest.raises(ValueError):
        hashing.redacted_json(text)
    with pytest.raises(ValueError):
        json.loads(text)


def test_any_depth_is_redacted(spark):
    deep = "[" * 100_000 + '{"token":' + "[" * 100_000 + "]" * 100_000 + "}" + "]" * 100_000
    frame = spark.createDataFrame([(deep,), ("[1.50]",), ("no",), (None,)], "t string")
    got = [r[0] for r in frame.select(hashing.redact_json("t")).collect()]
    assert got == ["[" * 100_000 + '{"token":"[REDACTED]"}' + "]" * 100_000, "[1.50]", '"[REDACTED]"', None]
