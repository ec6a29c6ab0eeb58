"""Every registered query against its SQL, and the contract of the entry module."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from spindrift import queries as Q

from .conftest import DATA


def plain(v):
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else v
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in DATA.joinpath("sf0.001").glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = Q.QUERIES[name](spark, sf_dir)
    want = duck.sql(Q.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in sorted(df.columns)]
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)


def test_entry_contract(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_selection_where_keys_meet(spark, tmp_path):
    """Suppliers whose number is a part's number are there already: the SQL says so as well."""
    con = duckdb.connect()
    con.sql("CREATE TABLE part AS SELECT * FROM (VALUES (7::BIGINT, 30, 'PROMO'), (8, 30, 'SMALL'), (1000002, 40, 'SMALL'), (1000003, 20, 'SMALL')) t(p_partkey, p_size, p_type)")
    con.sql("CREATE TABLE supplier AS SELECT * FROM (VALUES (1::BIGINT), (2), (3)) t(s_suppkey)")
    for name in ("part", "supplier"):
        con.sql(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    got = sorted(tuple(r) for r in Q.QUERIES["q_selection"](spark, str(tmp_path)).collect())
    assert got == [(7, True), (8, False), (1000001, True), (1000002, False), (1000003, True)]
    assert got == sorted(con.sql(Q.SQL["q_selection"]).fetchall())


def test_feed_deals_wide_rows_out_twice(spark, sf_dir):
    """Each of eight inputs is shuffled once by its key, and the joined rows twice more."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        plan = Q.QUERIES["q_feed"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert plan.count("Exchange hashpartitioning") <= 10
