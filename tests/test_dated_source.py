"""Filters reach the service, and a restarted stream goes on from its checkpoint."""

import os

import pytest

from spindrift.sources.dated_source import dated_source
from spindrift.sources.paged import Paging


def service(folder):
    """Pages of two items; each call leaves a file that names the key, position and date asked for."""

    def fetch_since(since):
        def fetch(key, position):
            open(f"{folder}/{key}-{position}-{since}-{os.urandom(4).hex()}", "w").close()
            with open(f"{folder}.n-{key}") as f:
                items = [{"n": n, "released": f"20{30 + n}-01-01"} for n in range(int(f.read()))]
            items = [i for i in items if since is None or i["released"] >= since]
            return {"items": items[position : position + 2], "total": len(items)}

        return fetch

    def count(key):
        with open(f"{folder}.n-{key}") as f:
            return int(f.read())

    return fetch_since, count


@pytest.fixture
def source(spark, tmp_path):
    folder = str(tmp_path / "calls")
    os.mkdir(folder)
    for k in "abc":
        (tmp_path / f"calls.n-{k}").write_text("5")
    name = f"dated_{os.urandom(4).hex()}"
    fetch_since, count = service(folder)
    spark.dataSource.register(dated_source(name, fetch_since, Paging("total"), lambda i: i["released"], count))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield name, tmp_path, lambda: {tuple(f.rsplit("-", 1)[0].split("-", 2)) for f in os.listdir(folder)}
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_filters_reach_the_service(spark, source):
    name, _, asked = source
    rows = spark.read.format(name).option("keys", "a,b,c").load().filter("released >= '2033-01-01' AND key IN ('a', 'c')")
    assert sorted((r.key, r.released) for r in rows.collect()) == [(k, f"20{n}-01-01") for k in "ac" for n in (33, 34)]
    assert asked() == {(k, "0", "2033-01-01") for k in "ac"}
    assert spark.read.format(name).option("keys", "a,b").load().filter("key = 'z'").count() == 0


def test_a_restarted_stream_goes_on(spark, source, tmp_path):
    name, folder, asked = source

    def run():
        stream = spark.readStream.format(name).option("keys", "a,b").load().writeStream.format("parquet")
        stream.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.key, r.position) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [(k, n) for k in "ab" for n in range(5)]
    before = asked()
    (folder / "calls.n-b").write_text("8")
    assert run() == [("a", n) for n in range(5)] + [("b", n) for n in range(8)]
    assert {(k, p) for k, p, _ in asked() - before} == {("b", "5"), ("b", "7")}
