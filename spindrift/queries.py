"""Registered queries: one for each family of operators, over the driver's tables.

The tables stand in for the roles of the data model; each query reads them whole.  The SQL
beside a query says the same in plain form and is what the driver holds the result against.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import classify, dates, hashing, links, text
from .operators import keyed, nested, ranged
from .plans import accounts, artists, exports, feed, imports, matching, resolution, runs, views
from .schemas import CANDIDATE, TRACK, duplicate_keys, exactly_one, violations
from .storage import Store, shared_root
from .streaming import gates, incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, in any session zone."""
    return (F.expr(f"cast(cast({ts} - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(20, 6))") * 1_000_000).cast("long")


def ntz(text_: str) -> Column:
    return F.lit(text_).cast("timestamp_ntz")


# -- scalar functions -----------------------------------------------------------------------

_NORMAL = r"trim(regexp_replace(replace(lower({}), '&', ' and '), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(f"SELECT doc_id, {_NORMAL.format('text')} AS normalized FROM documents")
def q_normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


@query("SELECT 'part' AS side, p_partkey AS key, regexp_replace(upper(p_brand || '-' || p_type), '[^A-Z0-9]', '', 'g') AS identifier FROM part UNION ALL SELECT 'customer', c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') FROM customer")
def q_normalize_identifier(spark, d):
    part = table(spark, d, "part").select(F.lit("part").alias("side"), F.col("p_partkey").alias("key"), text.normalize_identifier(F.concat_ws("-", "p_brand", "p_type")).alias("identifier"))
    customer = table(spark, d, "customer").select(F.lit("customer").alias("side"), F.col("c_custkey").alias("key"), text.normalize_identifier(F.col("c_name")).alias("identifier"))
    return part.unionByName(customer)


@query(r"""
WITH t AS (SELECT p_partkey, p_name || ' (' || CASE WHEN p_size < 10 THEN 'Extended-Mix' WHEN p_size < 20 THEN 'alive' WHEN p_size < 30 THEN 'Demons & more' ELSE p_type END || ')' AS title FROM part)
SELECT p_partkey, CASE WHEN contains(n, 'live') THEN 'live' WHEN contains(n, 'extended mix') THEN 'extended mix' WHEN contains(n, 'demo') THEN 'demo' END AS version, regexp_extract(title, '\(([^)]+)\)', 1) AS shown
FROM (SELECT *, trim(regexp_replace(replace(lower(title), '&', ' and '), '[^\p{L}\p{N}]+', ' ', 'g')) AS n FROM t)
""")
def q_extract_version(spark, d):
    size = F.col("p_size")
    mark = classify.ladder((size < 10, "Extended-Mix"), (size < 20, "alive"), (size < 30, "Demons & more"), otherwise=F.col("p_type"))
    title = F.concat(F.col("p_name"), F.lit(" ("), mark, F.lit(")"))
    return table(spark, d, "part").select("p_partkey", text.extract_version(title).alias("version"), text.first_parenthesised(title).alias("shown"))


_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus"]
_SQL_ORDER = ", ".join(_LINE_ORDER)


@query(f"""
WITH n AS (SELECT l_orderkey, l_returnflag || l_linestatus AS name, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SQL_ORDER}) AS i FROM lineitem)
SELECT l_orderkey, string_agg(CASE WHEN i = 1 THEN 'primary:' ELSE 'featured:' END || lower(name), '|' ORDER BY i) AS credits, string_agg(CASE WHEN i = 1 THEN name ELSE 'feat. ' || name END, ' ' ORDER BY i) AS artist
FROM n GROUP BY l_orderkey
""")
def q_credit_string(spark, d):
    lines = table(spark, d, "lineitem").withColumn("name", F.concat("l_returnflag", "l_linestatus"))
    rows = nested.ordered_children(lines, ["l_orderkey"], _LINE_ORDER, ["name"], "names")
    credits = F.transform("names", lambda n, i: F.struct(n["name"].alias("name"), F.when(i == 0, F.lit("primary")).otherwise(F.lit("featured")).alias("role")))
    rows = rows.withColumn("c", credits)
    return rows.select("l_orderkey", text.normalized_credits(F.col("c")).alias("credits"), text.credit_line(F.col("c")).alias("artist"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderpriority < '2' THEN strftime(o_orderdate, '%Y-01-01') WHEN o_orderpriority < '4' THEN strftime(o_orderdate, '%Y-%m-01') WHEN o_orderpriority < '5' THEN strftime(o_orderdate, '%Y-%m-%d') END AS date,
       CASE WHEN o_orderpriority < '2' THEN 'year' WHEN o_orderpriority < '4' THEN 'month' WHEN o_orderpriority < '5' THEN 'day' END AS precision,
       strftime(o_orderdate, '%m/%d/%Y') AS shown
FROM orders
""")
def q_partial_date(spark, d):
    p = F.col("o_orderpriority")
    given = classify.ladder((p < "2", F.date_format("o_orderdate", "yyyy")), (p < "4", F.date_format("o_orderdate", "yyyy-MM")), (p < "5", F.date_format("o_orderdate", "yyyy-MM-dd")), otherwise="soon")
    found = dates.partial_date(given)
    return table(spark, d, "orders").select("o_orderkey", found["date"].alias("date"), found["precision"].alias("precision"), dates.display_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("shown"))


@query("""
SELECT o_orderkey, o_orderdate > TIMESTAMP '1998-01-01 12:00:00' AS upcoming,
       CASE WHEN o_orderdate > TIMESTAMP '1998-01-01 12:00:00' THEN 'upcoming' WHEN o_orderstatus = 'P' THEN 'needs_review' ELSE 'new' END AS state,
       strftime(o_orderdate, '%Y-%m-%d') >= strftime(DATE '1998-01-01' - INTERVAL 60 DAY, '%Y-%m-%d') AS recent
FROM orders
""")
def q_upcoming_flag(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    upcoming = dates.is_upcoming(day, ntz("1998-01-01 12:00:00"))
    kind = F.when(F.col("o_orderstatus") == "P", F.lit("review")).otherwise(F.lit("new"))
    return table(spark, d, "orders").select("o_orderkey", upcoming.alias("upcoming"), classify.feed_state(upcoming, kind).alias("state"), (day >= dates.default_since(F.to_date(F.lit("1998-01-01"))).cast("string")).alias("recent"))


@query("""
SELECT p_partkey,
       CASE WHEN p_type = 'PROMO' THEN 'live' WHEN p_name LIKE 'red %' THEN 'compilation' WHEN p_type = 'SMALL' THEN 'single' WHEN p_type = 'LARGE' THEN 'album' ELSE 'other' END AS typed,
       CASE WHEN p_brand < 'Brand#2' THEN 'feature' WHEN contains(lower(p_name || ' ' || p_type), 'live') THEN 'live' WHEN p_type = 'SMALL' AND p_size > 1 THEN 'ep' WHEN p_type = 'SMALL' THEN 'single' WHEN p_type = 'LARGE' THEN 'album' ELSE 'other' END AS titled,
       CASE WHEN p_size < 10 THEN 'playable' WHEN p_size < 20 THEN 'blocked' ELSE 'unavailable' END AS availability, substr(p_brand, 1, 2) AS region
FROM part
""")
def q_classify(spark, d):
    kind, size = F.col("p_type"), F.col("p_size")
    primary = classify.ladder((kind == "SMALL", "Single"), (kind == "LARGE", "Album"))
    second = F.array_compact(F.array(F.when(F.startswith("p_name", F.lit("red ")), F.lit("Compilation")), F.when(kind == "PROMO", F.lit("Live"))))
    return table(spark, d, "part").select(
        "p_partkey",
        classify.typed_release(primary, second).alias("typed"),
        classify.titled_release(F.lower(primary), F.col("p_name"), kind, size, F.col("p_brand") >= "Brand#2").alias("titled"),
        classify.availability(size < 10, size < 20).alias("availability"),
        classify.region_code(F.col("p_brand")).alias("region"),
    )


@query(r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '') AS segments FROM pages),
e AS (SELECT *, CASE WHEN scheme <> 'https' THEN 'Example links must use HTTPS.' WHEN host <> 'example.com' AND NOT ends_with(host, '.example.com') THEN 'Only Example domains are allowed.' WHEN len(segments) < 2 OR lower(segments[1]) = 'search' THEN 'Enter an exact Example track URL.' END AS error FROM p)
SELECT page_id, error IS NULL AS valid, error, CASE WHEN error IS NULL THEN regexp_replace(url, '#.*$', '') END AS normalized_url, regexp_matches(url, '^https://([A-Za-z0-9-]+\.)*example[.]com(/|$)') AS allowed FROM e
""")
def q_url_validate(spark, d):
    checked = links.validate_link(F.col("url"), "track", "example.com", "Example")
    return table(spark, d, "pages").select("page_id", checked["valid"].alias("valid"), checked["error"].alias("error"), checked["normalized_url"].alias("normalized_url"), links.link_check(F.col("url"), "example.com").alias("allowed"))


@query("""
SELECT p_partkey, 'https://soundcloud.com/search/sounds?q=' || replace(replace(p_brand || ' ' || p_name || CASE WHEN p_size > 25 THEN ' ' || p_type ELSE '' END, '#', '%23'), ' ', '+') AS search_url,
       'https://open.spotify.com/album/' || replace(replace(p_brand || ' ' || p_name, '#', '%23'), ' ', '%20') AS release_url, '"' || p_brand || '" OR "' || p_name || '"' AS terms
FROM part
""")
def q_search_url(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        links.search_url(F.col("p_brand"), F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.lit(" "))).alias("search_url"),
        links.release_url(F.lit("spotify"), F.concat_ws(" ", "p_brand", "p_name"), F.lit("")).alias("release_url"),
        text.any_of_terms(F.array("p_brand", "p_name")).alias("terms"),
    )


@query("""SELECT p_partkey, sha256('{"p_name":"' || p_name || '","p_size":' || p_size || '}') AS payload_hash, p_brand || ':' || p_type || ':' || p_partkey AS dedupe_key FROM part""")
def q_payload_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", hashing.content_hash("p_name", "p_size", F.lit(None).cast("string").alias("absent")).alias("payload_hash"), hashing.dedupe_key("p_brand", "p_type", F.col("p_partkey").cast("string")).alias("dedupe_key"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, '[REDACTED]' AS user_token, '{"k":' || json_extract_string(props, '$.k') || ',"auth":{"Access_Token":"[REDACTED]","user":' || user_id || '}}' AS document FROM events""")
def q_redact(spark, d):
    fields = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("user_token"), F.col("user_id").cast("string")))
    document = F.concat(F.regexp_replace("props", r"\}\s*$", ""), F.lit(',"auth":{"Access_Token":"t","user":'), F.col("user_id").cast("string"), F.lit("}}"))
    shown = hashing.redact_map(fields)
    return table(spark, d, "events").select("event_id", shown["k"].alias("k"), shown["user_token"].alias("user_token"), hashing.redact_json(document).alias("document"))


@query("""
SELECT o_orderkey, replace(o_orderstatus || '_' || lower(o_orderpriority), '_', ' ') AS cased, upper(substr(o_orderpriority, 3, 2)) AS monogram, string_split(trim(lower(o_orderpriority)), ' ') AS scopes,
       CAST(floor(o_totalprice / 10 + 0.5) AS BIGINT) AS percent
FROM orders
""")
def q_text_display(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", text.title_case(F.concat_ws("_", "o_orderstatus", F.lower(p))).alias("cased"), text.monogram(F.substr(p, F.lit(3))).alias("monogram"), text.split_scopes(F.concat(F.lit(" "), F.lower(p), F.lit(" "))).alias("scopes"), F.floor(F.col("o_totalprice") / 10 + 0.5).alias("percent"))


# -- nested data, joins and keyed writes ------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') OR l_quantity > 40
""")
def q_flatten(spark, d):
    lines = table(spark, d, "lineitem")
    documents = nested.ordered_children(lines, ["l_orderkey"], _LINE_ORDER, ["l_linenumber", "l_partkey", "l_quantity", "l_returnflag"], "lines")
    rows = documents.withColumn("returned", F.exists("lines", lambda x: x["l_returnflag"] == "R"))
    return nested.child_rows(rows, "lines", "at", "l_orderkey", "returned").filter("returned OR l_quantity > 40").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT c_custkey AS mapping_id, c_name AS external_name, n_name AS artist_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
def q_confirmed_mapping(spark, d):
    mapped = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").withColumnRenamed("c_nationkey", "n_nationkey")
    return mapped.join(table(spark, d, "nation"), "n_nationkey").select(F.col("c_custkey").alias("mapping_id"), F.col("c_name").alias("external_name"), F.col("n_name").alias("artist_name"))


@query("SELECT o_orderkey, coalesce(c_name, 'unknown') AS release_title, CASE WHEN o_totalprice > 1000 THEN o_totalprice END AS price FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def q_track_release(spark, d):
    releases = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, d, "orders").join(releases, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("unknown")).alias("release_title"), F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice")).alias("price"))


@query("SELECT n_name, coalesce(string_agg(s_name, '|' ORDER BY s_name), '') AS aliases FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey, n_name")
def q_alias_arrays(spark, d):
    grouped = nested.ordered_children(table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), ["n_nationkey"], ["s_name"], ["s_name"], "aliases")
    return nested.with_children(table(spark, d, "nation"), grouped, ["n_nationkey"], "aliases").select("n_name", F.array_join(F.transform("aliases", lambda a: a["s_name"]), "|").alias("aliases"))


@query(f"SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY {_SQL_ORDER}) AS lines FROM lineitem GROUP BY l_orderkey")
def q_ordered_children(spark, d):
    rows = nested.ordered_children(table(spark, d, "lineitem"), ["l_orderkey"], _LINE_ORDER, ["l_linenumber", "l_partkey"], "lines")
    return rows.select("l_orderkey", F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("lines"))


@query("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned FROM orders")
def q_mark_join(spark, d):
    returned = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return keyed.mark_exists(table(spark, d, "orders").select("o_orderkey"), returned, ["o_orderkey"], "returned")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def q_anti_new(spark, d):
    known = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return keyed.insert_or_ignore(known, table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], "o_custkey")


@query("""
WITH a AS (SELECT p_brand, min(p_partkey) AS k FROM part WHERE p_size < 5 GROUP BY 1), b AS (SELECT p_type, min(p_partkey) AS k FROM part WHERE p_size > 45 GROUP BY 1)
SELECT p_partkey, coalesce(a.k, b.k) AS release FROM part LEFT JOIN a ON part.p_brand = a.p_brand AND p_size > 10 LEFT JOIN b ON part.p_type = b.p_type
""")
def q_fallback_lookup(spark, d):
    part = table(spark, d, "part")
    a = part.filter("p_size < 5").groupBy(F.col("p_brand").alias("_b")).agg(F.min("p_partkey").alias("_a"))
    b = part.filter("p_size > 45").groupBy("p_type").agg(F.min("p_partkey").alias("_c"))
    wanted = part.withColumn("_b", F.when(F.col("p_size") > 10, F.col("p_brand")))
    return wanted.join(a, "_b", "left").join(b, "p_type", "left").select("p_partkey", F.coalesce("_a", "_c").alias("release"))


@query("""
SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(value, (ts, event_id)) AS value, arg_max(props, (ts, event_id)) AS props FROM events GROUP BY user_id, event_type
""")
def q_upsert_last(spark, d):
    events = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    rows = events.select("user_id", "event_type", F.col("event_id").alias("first_event"), "value", "props", "at")
    return keyed.upsert(rows.drop("at").limit(0), rows, ["user_id", "event_type"], "at", ["value", "props"])


@query(f"""
SELECT doc_id, lang, normalized FROM (SELECT *, row_number() OVER (PARTITION BY normalized ORDER BY doc_id) AS i FROM (SELECT doc_id, lang, {_NORMAL.format('text')} AS normalized FROM documents)) WHERE i = 1
""")
def q_insert_ignore(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", text.normalize_text(F.col("text")).alias("normalized"))
    return keyed.insert_or_ignore(rows.limit(0), rows, ["normalized"], "doc_id")


@query("""
WITH old AS (SELECT user_id, min(event_id) AS first_event, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type = 'view' GROUP BY 1),
new AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT user_id, coalesce(old.first_event, new.first_event) AS first_event, coalesce(new.value, old.value) AS value FROM old FULL JOIN new USING (user_id)
""")
def q_ranged_upsert(spark, d):
    """Users known by their views, written over by all other events, in ranges of users."""
    events = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    known = events.filter("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("first_event"), F.max_by("value", "at").alias("value"))
    users = ranged.RangedTable.create(f"{shared_root(spark)}/users-{uuid.uuid4().hex}", known, ["user_id"], 16)
    users.upsert(events.filter("event_type <> 'view'").select("user_id", F.col("event_id").alias("first_event"), "value", "at"), "at", ["value"])
    return users.rows().select("user_id", "first_event", "value")


@query("""
WITH known AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT o_custkey, o_orderkey FROM known UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_custkey FROM known) GROUP BY 1
""")
def q_insert_into_filled(spark, d):
    """Customers with a filled target: the first other order of those that are not in it."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    known = keyed.first_by(orders.filter("o_orderstatus = 'F'"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")
    fresh = keyed.insert_or_ignore(known, orders.filter("o_orderstatus <> 'F'"), ["o_custkey"], "o_orderkey")
    return known.unionByName(fresh.select("o_custkey", "o_orderkey"))


@query("SELECT user_id, event_type, CAST(ts AS DATE) AS scheduled_for, min(event_id) AS first_event FROM events GROUP BY ALL")
def q_history(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("scheduled_for"), F.col("event_id").alias("first_event"))
    return keyed.first_by(rows, ["user_id", "event_type", "scheduled_for"], "first_event")


@query("SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice < 1000 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE NOT (o_orderpriority = '5-LOW')")
def q_update_delete(spark, d):
    orders = keyed.delete_where(table(spark, d, "orders"), F.col("o_orderpriority") == "5-LOW")
    overrides = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit("X").alias("o_orderstatus"))
    changed = keyed.apply_overrides(keyed.update_where(orders, F.col("o_totalprice") < 1000, o_totalprice=F.lit(0.0)), overrides, ["o_custkey"], "o_orderstatus")
    return changed.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' AND value < 50 GROUP BY user_id")
def q_consume_once(spark, d):
    rows = table(spark, d, "events")
    return keyed.consume_once(rows, "user_id", "event_id", (F.col("event_type") == "purchase") & (F.col("value") < 50)).select("user_id", "event_id")


@query("SELECT 'customer' AS source, c_custkey AS key, c_name AS name FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier")
def q_union_sources(spark, d):
    supplier = table(spark, d, "supplier")
    removed = supplier.filter("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"))
    kept = table(spark, d, "customer").join(removed, "c_nationkey", "left_anti").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    return kept.unionByName(supplier.select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))


@query("""
SELECT 'lineitem' AS side, 'repeated key' AS violation, CAST(count(*) AS BIGINT) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'part', 'size above 45', CAST(count(*) AS BIGINT) FROM part WHERE p_size > 45 HAVING count(*) > 0 UNION ALL SELECT 'part', 'name without ring', CAST(count(*) AS BIGINT) FROM part WHERE p_name NOT LIKE '%ring%' HAVING count(*) > 0
UNION ALL SELECT 'part', 'not one target', CAST(count(*) AS BIGINT) FROM part WHERE (p_size < 10)::INT + (p_type = 'PROMO')::INT <> 1 HAVING count(*) > 0
""")
def q_constraint_check(spark, d):
    repeated = duplicate_keys(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).select(F.lit("lineitem").alias("side"), F.lit("repeated key").alias("violation"), "n")
    part = table(spark, d, "part").withColumns({"a": F.when(F.col("p_size") < 10, 1), "b": F.when(F.col("p_type") == "PROMO", 1)})
    broken = violations({"size above 45": F.col("p_size") <= 45, "name without ring": F.contains("p_name", F.lit("ring")), "not one target": exactly_one("a", "b")})
    counted = part.select(F.explode(broken).alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))
    return repeated.unionByName(counted.select(F.lit("part").alias("side"), "violation", "n"))


# -- matching ---------------------------------------------------------------------------------


def part_tracks(part: DataFrame) -> DataFrame:
    """Parts in the role of canonical tracks."""
    size = F.col("p_size")
    return part.select(
        (F.col("p_partkey") - (1 << 40)).alias("ordinal"),
        F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("track_id"),
        F.col("p_name").alias("title"),
        F.array(F.struct(F.col("p_brand").alias("name"), F.lit("primary").alias("role"))).alias("credits"),
        F.when(size < 48, size * 1000).cast("int").alias("duration_ms"),
        F.when(size > 30, F.lit(2)).cast("int").alias("disc_number"),
        size.cast("int").alias("track_number"),
        F.when(size < 3, F.concat_ws("-", F.lit("i"), "p_brand", size.cast("string"))).alias("isrc"),
        F.when(size.between(5, 6), F.concat_ws("/", F.lit("u"), "p_type")).alias("upc"),
        F.when(size == 7, F.concat_ws("/", F.lit("U"), "p_type")).alias("ean"),
        F.when(size == 8, F.col("p_brand")).alias("musicbrainz_recording_id"),
        F.when(size == 9, F.col("p_type")).alias("musicbrainz_release_group_id"),
        F.when(F.col("p_type") == "SMALL", F.lit("remix")).alias("version"),
    )


def part_candidates(part: DataFrame) -> DataFrame:
    """The same parts, spelled otherwise, in the role of candidates."""
    size = F.col("p_size")
    return part.select(
        F.col("p_partkey").alias("ordinal"),
        F.when(F.col("p_type") == "PROMO", F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"))).otherwise(F.upper(F.replace("p_name", F.lit(" "), F.lit("--")))).alias("title"),
        F.array(F.struct(F.when(F.col("p_retailprice") < 1500, F.col("p_brand")).otherwise(F.lit("Brand#1")).alias("name"), F.lit("primary").alias("role"))).alias("credits"),
        F.when(size > 2, size * 1000 + 1500).cast("int").alias("duration_ms"),
        F.when(size > 30, F.lit(2)).cast("int").alias("disc_number"),
        size.cast("int").alias("track_number"),
        F.when(size < 4, F.concat_ws("", F.lit("I"), "p_brand", size.cast("string"))).alias("isrc"),
        F.when(size.between(5, 7), F.concat(F.lit("u"), F.col("p_type"))).alias("upc"),
        F.lit(None).cast("string").alias("ean"),
        F.when(size == 8, F.col("p_brand")).alias("musicbrainz_recording_id"),
        F.when(size == 9, F.col("p_type")).alias("musicbrainz_release_group_id"),
        F.when(F.col("p_type").isin("ECONOMY", "SMALL"), F.lit("live")).alias("version"),
    )


_ALNUM = r"regexp_replace(upper({}), '[^A-Z0-9]', '', 'g')"
_MATCH = rf"""
WITH t AS (
  SELECT p_partkey AS ord, p_name AS title, lower(replace(p_brand, '#', ' ')) AS credits, CASE WHEN p_size < 48 THEN p_size * 1000 END AS duration,
         CASE WHEN p_size < 3 THEN {_ALNUM.format("'i' || p_brand || p_size")} END AS isrc, CASE WHEN p_size BETWEEN 5 AND 7 THEN 'U' || p_type END AS barcode, p_size AS track, CASE WHEN p_size > 30 THEN 2 ELSE 1 END AS disc,
         CASE WHEN p_size = 8 THEN p_brand END AS rec, CASE WHEN p_size = 9 THEN p_type END AS grp, CASE WHEN p_type = 'SMALL' THEN 'remix' END AS version
  FROM part
), c AS (
  SELECT p_partkey AS ord, CASE WHEN p_type = 'PROMO' THEN p_name || ' ' || lower(replace(p_brand, '#', ' ')) ELSE p_name END AS title, CASE WHEN p_retailprice < 1500 THEN lower(replace(p_brand, '#', ' ')) ELSE 'brand 1' END AS credits,
         CASE WHEN p_size > 2 THEN p_size * 1000 + 1500 END AS duration, CASE WHEN p_size < 4 THEN {_ALNUM.format("'I' || p_brand || p_size")} END AS isrc, CASE WHEN p_size BETWEEN 5 AND 7 THEN 'U' || p_type END AS barcode, p_size AS track, CASE WHEN p_size > 30 THEN 2 ELSE 1 END AS disc,
         CASE WHEN p_size = 8 THEN p_brand END AS rec, CASE WHEN p_size = 9 THEN p_type END AS grp, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'live' END AS version
  FROM part
), e1 AS (SELECT c.ord, min(t.ord) AS k FROM c JOIN t USING (isrc) GROUP BY 1), e2 AS (SELECT c.ord, min(t.ord) AS k FROM c JOIN t USING (barcode, track, disc) GROUP BY 1),
e3 AS (SELECT ord, min(k) AS k FROM (SELECT c.ord, t.ord AS k FROM c JOIN t USING (rec) UNION ALL SELECT c.ord, t.ord FROM c JOIN t USING (grp)) GROUP BY 1),
s AS (
  SELECT c.ord, t.ord AS k, (c.credits = t.credits) AS same_credits, (c.version IS NOT DISTINCT FROM t.version) AS same_version, coalesce(abs(c.duration - t.duration) <= 2000, false) AS same_duration, coalesce(c.version <> t.version, false) AS conflict
  FROM c JOIN t USING (title)
), p AS (SELECT *, 45 + 30 * same_credits::INT + 15 * same_version::INT + 10 * same_duration::INT AS points FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY points DESC, k) AS i, count(*) OVER (PARTITION BY ord, points) AS n FROM p), b AS (SELECT *, points >= 93 AND n = 1 AND NOT conflict AS sure FROM r WHERE i = 1)
SELECT c.ord AS candidate,
       CASE WHEN e1.k IS NOT NULL OR e2.k IS NOT NULL OR e3.k IS NOT NULL OR b.sure THEN 'automatic' WHEN b.k IS NULL THEN 'new' ELSE 'review' END AS kind,
       CASE WHEN e1.k IS NOT NULL THEN 'exact_isrc' WHEN e2.k IS NOT NULL THEN 'exact_barcode_position' WHEN e3.k IS NOT NULL THEN 'exact_musicbrainz' WHEN b.k IS NULL THEN 'new_canonical' WHEN b.sure THEN 'metadata' ELSE 'manual_review' END AS rule,
       CAST(CASE WHEN e1.k IS NOT NULL THEN 100 WHEN e2.k IS NOT NULL THEN 99 WHEN e3.k IS NOT NULL THEN 98 WHEN b.k IS NULL THEN 100 ELSE points END AS INTEGER) AS points,
       'T' || coalesce(e1.k, e2.k, e3.k, b.k) AS track_id,
       CASE WHEN e1.k IS NOT NULL THEN 'ISRC ' || c.isrc || ' is identical' WHEN e2.k IS NOT NULL THEN 'Barcode, disc, and track position are identical' WHEN e3.k IS NOT NULL THEN 'MusicBrainz recording or release-group identifier is identical'
            WHEN b.k IS NULL THEN 'No existing canonical recording has comparable metadata'
            ELSE 'Normalized titles are identical' || CASE WHEN same_credits THEN '; Canonical artist credits are identical' ELSE '' END || CASE WHEN same_version THEN '; Version markers agree' ELSE '' END || CASE WHEN same_duration THEN '; Durations are within two seconds' ELSE '' END
                 || CASE WHEN sure THEN '' WHEN n > 1 THEN '; Multiple canonical tracks have the same score' ELSE '; Score is below 0.93' END || CASE WHEN NOT sure AND conflict THEN '; Version markers conflict' ELSE '' END END AS reasons
FROM c LEFT JOIN e1 USING (ord) LEFT JOIN e2 USING (ord) LEFT JOIN e3 USING (ord) LEFT JOIN b ON b.ord = c.ord
"""


@query(_MATCH)
def q_match_decide(spark, d):
    part = table(spark, d, "part")
    decided = matching.match(part_candidates(part), part_tracks(part))
    return decided.select(F.col("ordinal").alias("candidate"), "kind", "rule", "points", "track_id", F.array_join("reasons", "; ").alias("reasons"))


@query(f"SELECT kind, rule, classify.status AS match_status, CAST(count(*) AS BIGINT) AS n, CAST(sum(points) AS BIGINT) AS points FROM ({_MATCH}) m JOIN (VALUES ('review', 'needs_review'), ('new', 'new'), ('automatic', 'matched')) classify(k, status) ON m.kind = classify.k GROUP BY ALL")
def q_match_summary(spark, d):
    rows = q_match_decide(spark, d).groupBy("kind", "rule").agg(F.count("*").alias("n"), F.sum("points").alias("points"))
    return rows.withColumn("match_status", classify.match_status(F.col("kind")))


@query()
def q_resolve_batch(spark, d):
    """All parts as one batch over an empty store: each can match what the batch creates."""
    batch = part_candidates(table(spark, d, "part")).join(table(spark, d, "part").select(F.col("p_partkey").alias("ordinal"), "p_brand", "p_size"), "ordinal")
    batch = batch.withColumns({"provider": F.lit("mock"), "external_release_id": F.col("ordinal").cast("string"), "external_track_id": F.concat_ws("/", "p_brand", "p_size", F.floor(F.col("ordinal") / 400).cast("string"))}).drop("p_brand", "p_size")
    none = spark.createDataFrame([], TRACK)
    decided = resolution.decide(batch, none, none.select(F.lit("").alias("provider"), F.lit("").alias("external_track_id"), "track_id"))
    made = decided.filter("kind = 'new'").select("track_id", F.col("ordinal").alias("creator"))
    return decided.join(made, "track_id", "left").select("ordinal", "kind", "rule", "points", "creator")


def sized_candidates(part: DataFrame) -> DataFrame:
    """Parts as candidates of tracks by brand and type (one ISRC) on a release by brand."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    columns = {
        "ordinal": F.col("p_partkey"), "provider": F.lit("mock"), "external_release_id": F.col("p_brand"), "external_track_id": F.concat_ws("/", "p_brand", "p_type", "p_size"), "source_label": F.lit("parts"),
        "artist_external_id": F.col("p_type"), "artist_name": F.col("p_type"), "title": F.concat(F.lit("Part "), key), "release_title": F.concat(F.lit("Release "), key), "release_type": F.lit("single"),
        "release_date": F.concat(F.lit("2030-05-"), F.lpad((size % 28 + 1).cast("string"), 2, "0")), "release_date_precision": F.lit("day"), "first_seen_at": F.lit("2030-04-01 12:00:00").cast("timestamp"),
        "credits": F.array(F.struct(F.col("p_type").alias("name"), F.lit("primary").alias("role")), F.struct(F.col("p_brand").alias("name"), F.lit("featured").alias("role"))),
        "duration_ms": size * 1000, "track_number": size, "isrc": F.concat_ws("-", F.lit("i"), "p_brand", "p_type"), "region": F.lit("US"), "availability": F.when(size < 40, F.lit("playable")).otherwise(F.lit("blocked")),
        "provider_url": F.lit("https://example.test/p"), "evidence_url": F.lit("https://example.test/e"), "evidence_type": F.lit("parts"), "payload_hash": F.concat(F.lit("hash-"), key), "is_upcoming": size % 3 == 0,
    }
    return part.select(*(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CANDIDATE))


@query("""
WITH cand AS (SELECT *, row_number() OVER (ORDER BY batch, p_partkey) AS pos FROM (
  SELECT *, CASE WHEN p_size <= 25 THEN 0 ELSE 1 END AS batch, p_brand || '/' || p_type || '/' || p_size AS ext, 'Part ' || p_partkey AS title, 'Release ' || p_partkey AS release,
    '2030-05-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0') AS day, row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) AS copy FROM part) WHERE copy = 1),
d AS (SELECT *, first_value(title) OVER (PARTITION BY p_brand, p_type ORDER BY pos) AS track, first_value(release) OVER (PARTITION BY p_brand ORDER BY pos) AS of_release,
  row_number() OVER (PARTITION BY p_brand, p_type ORDER BY pos) = 1 AS fresh FROM cand),
norm AS (SELECT DISTINCT p_type AS name FROM d UNION SELECT p_brand FROM d)
SELECT 'tracks' AS tbl, CAST(row_number() OVER (ORDER BY pos) - 1 AS VARCHAR) AS a, title AS b, of_release AS c FROM d WHERE fresh
UNION ALL SELECT 'releases', release, day, '' FROM d WHERE release = of_release
UNION ALL SELECT 'release_candidates', ext, CASE WHEN fresh THEN 'new:new_canonical' ELSE 'matched:exact_isrc' END, track FROM d
UNION ALL SELECT 'track_external_ids', ext, track, '' FROM d
UNION ALL SELECT 'release_external_ids', p_brand, min(of_release), arg_max(day, pos) FROM d GROUP BY p_brand
UNION ALL SELECT 'announcements', p_brand, arg_min(release, pos), arg_max(day, pos) FROM d WHERE p_size % 3 = 0 GROUP BY p_brand
UNION ALL SELECT DISTINCT 'date_history', p_brand, day, '' FROM d WHERE p_size % 3 = 0
UNION ALL SELECT 'artists', name, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), '' FROM norm
UNION ALL SELECT DISTINCT 'artist_follows', p_type, '', '' FROM d
UNION ALL SELECT 'track_credits', title, '0:primary', p_type FROM d WHERE fresh
UNION ALL SELECT 'track_credits', title, '1:featured', p_brand FROM d WHERE fresh
UNION ALL SELECT 'feed_items', ext, CASE WHEN p_size % 3 = 0 THEN 'upcoming' ELSE 'new' END, track FROM d
UNION ALL SELECT 'source_evidence', ext, 'hash-' || p_partkey, '' FROM d
UNION ALL SELECT 'track_availabilities', ext, CASE WHEN p_size < 40 THEN 'playable' ELSE 'blocked' END, track FROM d
""")
def q_persist_tables(spark, d):
    """What two batches leave in the tables: parts of small sizes, then all, of which those
    known are passed over and the others meet stored tracks and releases.  Ids are shown as
    the titles of what they stand for."""
    rows, store = sized_candidates(table(spark, d, "part")), Store(spark, f"{shared_root(spark)}/persisted-{uuid.uuid4().hex}")
    for n, batch in enumerate((rows.filter("duration_ms <= 25000"), rows)):
        store.transact(lambda tables: resolution.persist(batch, tables, f"run-{n}")[0])  # noqa: B023
    t = store.tables()
    tracks, releases = t["tracks"].select("track_id", F.col("title").alias("track")), t["releases"].select("release_id", F.col("title").alias("release"))
    artists_ = t["artists"].select("artist_id", F.col("name").alias("artist"))
    known = t["release_candidates"].select("candidate_id", F.col("external_track_id").alias("ext"))
    none = F.lit("")
    shown = {
        "tracks": (t["tracks"].join(releases, "release_id", "left"), F.col("ordinal").cast("string"), "title", "release"),
        "releases": (t["releases"], "title", "release_date", F.coalesce("upc", none)),
        "release_candidates": (t["release_candidates"].join(tracks, "track_id", "left"), "external_track_id", F.concat_ws(":", "match_status", "match_rule"), "track"),
        "track_external_ids": (t["track_external_ids"].join(tracks, "track_id", "left"), "external_id", "track", none),
        "release_external_ids": (t["release_external_ids"].join(releases, "release_id", "left"), "external_id", "release", F.get_json_object("provider_fields", "$.releaseDate")),
        "announcements": (t["announcements"], "external_id", "title", "scheduled_for"),
        "date_history": (t["date_history"], "external_id", "scheduled_for", none),
        "artists": (t["artists"], "name", "normalized_name", none),
        "artist_follows": (t["artist_follows"].join(artists_, "artist_id", "left"), "artist", none, none),
        "track_credits": (t["track_credits"].join(tracks, "track_id", "left").join(artists_, "artist_id", "left"), "track", F.concat_ws(":", F.col("credit_order").cast("string"), "role"), "artist"),
        "feed_items": (t["feed_items"].join(known, "candidate_id", "left").join(tracks, "track_id", "left"), "ext", "state", "track"),
        "source_evidence": (t["source_evidence"].join(known, "candidate_id", "left"), "ext", "payload_hash", none),
        "track_availabilities": (t["track_availabilities"].join(tracks, "track_id", "left"), "provider_track_id", "state", "track"),
    }
    column = lambda c, name: (F.col(c) if isinstance(c, str) else c).alias(name)
    parts = [df.select(F.lit(name).alias("tbl"), column(a, "a"), column(b, "b"), column(c, "c")) for name, (df, a, b, c) in shown.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# -- artists and imports ------------------------------------------------------------------------

_SCORED = """
SELECT s_nationkey, s_suppkey, least(1000, CAST(floor((score * 9 + 1) / 2) AS BIGINT) + CASE WHEN exact THEN 400 ELSE 0 END + CASE WHEN by_alias THEN 100 ELSE 0 END + CASE WHEN s_acctbal > 5000 THEN 20 ELSE 0 END) AS millis
FROM (SELECT s_nationkey, s_suppkey, s_acctbal, CAST(floor(greatest(s_acctbal, 0) / 100) AS BIGINT) AS score, s_acctbal > 2000 AS exact, s_acctbal > 4000 AS by_alias FROM supplier)
"""


def _scored(spark, d) -> DataFrame:
    rows = table(spark, d, "supplier").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    balance = F.col("s_acctbal")
    found = F.when(balance > 2000, F.upper("n_name")).otherwise(F.col("s_name"))
    aliases = F.array(F.when(balance > 4000, F.concat(F.lit("the "), F.col("n_name"))).otherwise(F.col("s_name")))
    score = F.floor(F.greatest(balance, F.lit(0.0)) / 100)
    out = artists.artist_score(F.col("n_name"), F.array(F.concat(F.lit("The-"), F.col("n_name"))), found, aliases, score, F.when(balance > 5000, F.lit("known")))
    return rows.select("s_nationkey", "s_suppkey", out["millis"].alias("millis"), F.array_join(out["reasons"], "; ").alias("reasons"))


@query(_SCORED)
def q_artist_score(spark, d):
    return _scored(spark, d).select("s_nationkey", "s_suppkey", "millis")


@query(f"""
WITH r AS (SELECT *, row_number() OVER w AS i, lead(millis) OVER w AS next FROM ({_SCORED}) WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
m AS (SELECT *, max(CASE WHEN i = 1 AND millis >= 970 AND (next IS NULL OR millis - next >= 80) THEN 1 ELSE 0 END) OVER (PARTITION BY s_nationkey) AS mapped FROM r)
SELECT s_nationkey, s_suppkey, millis, CASE WHEN mapped = 1 THEN 'mapped' ELSE 'proposed' END AS outcome FROM m WHERE (mapped = 1 AND i = 1) OR (mapped = 0 AND i <= 5)
""")
def q_artist_map(spark, d):
    return artists.map_or_propose(_scored(spark, d).drop("reasons"), ["s_nationkey"], "s_suppkey", "millis")


def _preview(spark, d) -> DataFrame:
    part = table(spark, d, "part")
    imported = part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("provider_artist_id"), F.concat_ws(" & ", "p_name", "p_brand").alias("name"))
    known = part.filter("p_size < 25").select(F.col("p_partkey").cast("string").alias("artist_id"), F.concat_ws(" AND ", "p_name", "p_brand").alias("name"))
    aliases = part.filter("p_type = 'PROMO'").select(F.col("p_partkey").cast("string").alias("artist_id"), F.concat_ws(" and ", "p_name", "p_brand").alias("name"))
    return imports.import_preview(imported, known, aliases)


_PREVIEW = """
SELECT 'P' || p_partkey AS provider_artist_id, p_name || ' & ' || p_brand AS name, CASE WHEN n = 1 THEN one END AS existing_artist_id, CASE WHEN n = 1 THEN 'merge' WHEN n > 1 THEN 'review' ELSE 'create' END AS proposed_action, coalesce(n, 0) <= 1 AS selected
FROM part LEFT JOIN (SELECT p_name, p_brand, count(DISTINCT p_partkey) AS n, min(CAST(p_partkey AS VARCHAR)) AS one FROM part WHERE p_size < 25 OR p_type = 'PROMO' GROUP BY ALL) k USING (p_name, p_brand)
"""


@query(_PREVIEW)
def q_import_preview(spark, d):
    return _preview(spark, d)


@query(f"""
WITH v AS ({_PREVIEW}), d AS (SELECT 'P' || p_partkey AS id, CASE WHEN p_type = 'SMALL' THEN 'skip' WHEN p_type = 'LARGE' THEN 'create' ELSE 'merge' END AS decision, p_size > 5 AS chosen FROM part WHERE p_type IN ('SMALL', 'LARGE', 'MEDIUM')),
m AS (SELECT 'P' || p_partkey AS id, 'M' || p_partkey AS mapped FROM part WHERE p_size = 20),
o AS (SELECT v.*, mapped, CASE WHEN NOT coalesce(chosen, selected) OR coalesce(decision, CASE WHEN proposed_action = 'review' THEN 'skip' ELSE proposed_action END) = 'skip' THEN 'skipped' WHEN mapped IS NOT NULL THEN 'merged'
        WHEN coalesce(decision, proposed_action) = 'create' THEN 'created' WHEN existing_artist_id IS NOT NULL THEN 'merged' ELSE 'needs_review' END AS outcome FROM v LEFT JOIN d ON d.id = provider_artist_id LEFT JOIN m ON m.id = provider_artist_id)
SELECT provider_artist_id, outcome, CASE WHEN outcome = 'merged' THEN coalesce(mapped, existing_artist_id) WHEN outcome = 'created' THEN 'created' END AS artist FROM o
""")
def q_import_confirm(spark, d):
    part = table(spark, d, "part").withColumn("provider_artist_id", F.concat(F.lit("P"), F.col("p_partkey").cast("string")))
    kind = F.col("p_type")
    decisions = part.filter(kind.isin("SMALL", "LARGE", "MEDIUM")).select("provider_artist_id", classify.ladder((kind == "SMALL", "skip"), (kind == "LARGE", "create"), otherwise="merge").alias("decision"), (F.col("p_size") > 5).alias("selected"), F.lit(None).cast("string").alias("existing_artist_id"), F.lit(0).alias("ordinal"))
    mapped = part.filter("p_size = 20").select(F.col("provider_artist_id").alias("external_id"), F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("artist_id"))
    done = imports.import_confirm(_preview(spark, d), decisions, mapped)
    return done.select("provider_artist_id", "outcome", F.when(F.col("outcome") == "created", F.lit("created")).otherwise(F.col("artist_id")).alias("artist"))


# -- exports ------------------------------------------------------------------------------------

_PLAN = f"""
WITH i AS (SELECT l_partkey, l_orderkey * 8 + l_linenumber AS o, l_extendedprice AS x, l_returnflag AS f, l_discount AS c, l_linestatus AS s FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY o, x) AS i FROM i),
b AS (SELECT *, NOT ((f <> 'R' AND c <= 0.02) OR s = 'O') AS refused FROM r WHERE i = 1)
SELECT l_partkey AS provider_track_id, o AS ordinal, CASE WHEN refused THEN 'rejected' WHEN p_size < 10 THEN 'present' ELSE 'add' END AS bucket, CASE WHEN refused THEN '{exports.REFUSED}' END AS reason FROM b LEFT JOIN part ON l_partkey = p_partkey
"""


def _plan(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem")
    items = lines.select(
        F.col("l_partkey").alias("provider_track_id"),
        F.struct((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("o"), F.col("l_extendedprice").alias("x")).alias("place"),
        F.when(F.col("l_returnflag") == "R", F.lit("metadata")).otherwise(F.lit("exact_isrc")).alias("match_rule"),
        (1 - F.round("l_discount", 2)).cast("decimal(4,3)").alias("confidence"),
        (F.col("l_linestatus") == "O").alias("manually_confirmed"),
    )
    present = table(spark, d, "part").filter("p_size < 10").select(F.col("p_partkey").alias("provider_track_id"))
    return exports.export_plan(items, present, order="place").withColumn("ordinal", F.col("place.o"))


@query(_PLAN)
def q_export_plan(spark, d):
    return _plan(spark, d).select("provider_track_id", "ordinal", "bucket", "reason")


@query(f"SELECT provider_track_id, CAST((row_number() OVER (ORDER BY provider_track_id) - 1) // 100 AS BIGINT) AS batch FROM ({_PLAN}) WHERE bucket = 'add'")
def q_export_batches(spark, d):
    return exports.export_batches(_plan(spark, d), 100, "provider_track_id").select("provider_track_id", "batch")


@query(f"SELECT CAST(count(*) FILTER (WHERE bucket = 'add') AS BIGINT) AS n_add, CAST(count(*) FILTER (WHERE bucket = 'present') AS BIGINT) AS n_present, CAST(count(*) FILTER (WHERE bucket = 'rejected') AS BIGINT) AS n_rejected FROM ({_PLAN})")
def q_plan_sizes(spark, d):
    return exports.plan_sizes(_plan(spark, d))


@query("""
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Exported' WHEN 'SMALL' THEN 'Ready' WHEN 'LARGE' THEN 'Not available' ELSE 'Review required' END AS export_label,
       CASE WHEN p_size < 10 THEN 'not checked' WHEN p_size < 20 THEN 'search link available' WHEN p_size < 30 THEN 'link unverified' WHEN p_size < 40 THEN 'link verified' ELSE 'link rejected' END AS link_label
FROM part
""")
def q_labels(spark, d):
    kind, size = F.col("p_type"), F.col("p_size")
    status = classify.ladder((kind == "ECONOMY", "exported"), (kind == "SMALL", "eligible"), (kind == "LARGE", "blocked"), otherwise="review_required")
    link = classify.ladder(*((size < 10 * (k + 1), name) for k, name in enumerate(classify.LINK_LABELS)), otherwise="USER_LINK_REJECTED")
    return table(spark, d, "part").select("p_partkey", classify.label(status, classify.EXPORT_LABELS).alias("export_label"), classify.label(link, classify.LINK_LABELS).alias("link_label"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_pending FROM orders WHERE o_orderstatus = 'P'")
def q_pending_reviews(spark, d):
    return views.pending_reviews(table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", F.lit("pending")).otherwise(F.lit("decided")).alias("status")))


# Events in the role of writes: a user's events of one type are writes of one key.
_WRITES = "SELECT event_id AS ordinal, user_id, event_type, value, 'N' || (event_id % 7) AS name FROM events"


@query(f"SELECT 'u' || CAST(user_id AS VARCHAR) || '@x' AS email, CAST(min(ordinal) AS VARCHAR) AS user_id, arg_max(name, ordinal) AS display_name FROM ({_WRITES}) GROUP BY user_id")
def q_owner_upsert(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("user_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@x")).alias("email"), F.concat(F.lit("N"), (F.col("event_id") % 7).cast("string")).alias("display_name"), F.col("event_id").alias("ordinal"))
    return accounts.upsert_owners(rows.drop("ordinal").limit(0), rows).select("email", "user_id", "display_name")


@query(f"""
WITH w AS ({_WRITES}), a AS (SELECT user_id, arg_max(event_type, ordinal) AS scopes, arg_max(name, ordinal) FILTER (WHERE name <> 'N3') AS named FROM w GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS provider_account_id, scopes, coalesce(named, CASE WHEN user_id % 2 = 0 THEN 'old' END) AS display_name, false AS reconnect_required, true AS connected FROM a
""")
def q_account_upsert(spark, d):
    events = table(spark, d, "events")
    name = F.concat(F.lit("N"), (F.col("event_id") % 7).cast("string"))
    account = lambda df, display, scopes, off: df.select(F.lit("A").alias("account_id"), F.lit("U").alias("user_id"), F.lit("spotify").alias("provider"), F.col("user_id").cast("string").alias("provider_account_id"), display.alias("display_name"), F.lit(None).cast("string").alias("provider_user_id"), scopes.alias("scopes"), F.when(F.lit(off), F.lit("2024-01-01")).cast("timestamp").alias("disconnected_at"), F.lit(off).alias("reconnect_required"), *([F.col("event_id").alias("ordinal")] if "event_id" in df.columns else []))
    old = account(events.select("user_id").filter("user_id % 2 = 0").distinct(), F.lit("old"), F.lit("none"), True)
    rows = account(events, F.when(name != "N3", name), F.col("event_type"), True)
    return accounts.upsert_accounts(old, rows).select("provider_account_id", "scopes", "display_name", "reconnect_required", F.col("disconnected_at").isNull().alias("connected"))


@query(f"SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS provider, 'P' || max(ordinal) AS playlist_id, arg_max(name, ordinal) AS name, true AS enabled FROM ({_WRITES}) GROUP BY ALL")
def q_target_upsert(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("provider"), F.concat(F.lit("P"), F.col("event_id").cast("string")).alias("playlist_id"), F.concat(F.lit("N"), (F.col("event_id") % 7).cast("string")).alias("name"), F.lit(None).cast("string").alias("snapshot_id"), F.lit(False).alias("enabled"), F.col("event_id").alias("ordinal"))
    return accounts.upsert_targets(rows.drop("ordinal").limit(0), rows).select("user_id", "provider", "playlist_id", "name", "enabled")


@query(f"SELECT 'run' AS run_id, provider_artist_id, name AS provider_name, existing_artist_id, proposed_action, selected FROM ({_PREVIEW})")
def q_import_rows(spark, d):
    return accounts.import_rows(_preview(spark, d), "run")


@query(f"""
WITH v AS ({_PREVIEW}), o AS (SELECT provider_artist_id AS external_id, existing_artist_id AS artist_id FROM v WHERE proposed_action = 'merge'),
m AS (SELECT 'P' || p_partkey AS external_id, 'M' || p_partkey AS artist_id FROM part WHERE p_size = 20)
SELECT 'spotify' AS provider, external_id, coalesce(o.artist_id, m.artist_id) AS artist_id, o.artist_id IS NOT NULL AS confirmed, CASE WHEN o.artist_id IS NULL THEN 'manual' ELSE 'spotify_follow_import' END AS mapping_source,
       CAST(CASE WHEN m.artist_id IS NULL THEN 1.0 ELSE 0.5 END AS DOUBLE) AS match_score FROM o FULL JOIN m USING (external_id)
""")
def q_import_mappings(spark, d):
    part = table(spark, d, "part")
    known = part.filter("p_size = 20").select(F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("artist_id"), F.lit("spotify").alias("provider"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("external_id"), F.lit("").alias("provider_url"), F.lit(False).alias("confirmed"), F.lit(0.5).cast("decimal(4,3)").alias("match_score"), F.lit("manual").alias("mapping_source"))
    done = _preview(spark, d).select("provider_artist_id", F.when(F.col("proposed_action") == "merge", F.lit("merged")).otherwise(F.lit("skipped")).alias("outcome"), F.col("existing_artist_id").alias("artist_id"), F.lit(0).alias("ordinal"))
    return accounts.import_mappings(known, done).select("provider", "external_id", "artist_id", "confirmed", "mapping_source", F.col("match_score").cast("double").alias("match_score"))


@query(f"""
WITH v AS ({_PREVIEW}), n AS (SELECT DISTINCT u.user_id, existing_artist_id AS artist_id FROM v CROSS JOIN (VALUES ('one'), ('two')) u(user_id) WHERE proposed_action = 'merge'),
o AS (SELECT 'one' AS user_id, CAST(p_partkey AS VARCHAR) AS artist_id, p_size > 10 AS active FROM part WHERE p_size < 20)
SELECT user_id, artist_id, n.artist_id IS NOT NULL OR o.active AS active, CASE WHEN n.artist_id IS NULL THEN 'manual' ELSE 'spotify_follow_import' END AS source, CASE WHEN o.artist_id IS NULL THEN 'import' ELSE 'before' END AS since
FROM n FULL JOIN o USING (user_id, artist_id)
""")
def q_import_follows(spark, d):
    """Both users' follows after one import: the first has follows already, some given up."""
    part = table(spark, d, "part").filter("p_size < 20")
    known = part.select(F.lit("one").alias("user_id"), F.col("p_partkey").cast("string").alias("artist_id"), ntz("1998-01-01 00:00:00").alias("followed_at"), (F.col("p_size") > 10).alias("active"), F.lit("manual").alias("source"))
    done = _preview(spark, d).select(F.explode(F.array(F.lit("one"), F.lit("two"))).alias("user"), F.when(F.col("proposed_action") == "merge", F.lit("merged")).otherwise(F.lit("skipped")).alias("outcome"), F.col("existing_artist_id").alias("artist_id"), F.lit(0).alias("ordinal"))
    follows = accounts.import_follows(known, done, ntz("1999-01-01 00:00:00"), F.col("user"))
    return follows.select("user_id", "artist_id", "active", "source", F.when(F.col("followed_at") == ntz("1998-01-01 00:00:00"), F.lit("before")).otherwise(F.lit("import")).alias("since"))


@query(f"""
WITH r AS (SELECT *, row_number() OVER w AS i, lead(millis) OVER w AS next FROM ({_SCORED}) WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
m AS (SELECT *, max(CASE WHEN i = 1 AND millis >= 970 AND (next IS NULL OR millis - next >= 80) THEN 1 ELSE 0 END) OVER (PARTITION BY s_nationkey) AS mapped FROM r),
p AS (SELECT s_nationkey, s_suppkey, millis FROM m WHERE mapped = 0 AND i <= 5), o AS (SELECT s_nationkey, s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)
SELECT s_nationkey AS artist, s_suppkey AS proposed, CASE WHEN p.millis IS NULL THEN 'rejected' ELSE 'pending' END AS status, CAST(coalesce(p.millis, 0) AS DOUBLE) / 1000 AS score FROM p FULL JOIN o USING (s_nationkey, s_suppkey)
""")
def q_review_upsert(spark, d):
    ids = [F.col("s_nationkey").cast("string").alias("artist_id"), F.col("s_suppkey").cast("string").alias("external_id")]
    proposed = artists.map_or_propose(_scored(spark, d).drop("reasons"), ["s_nationkey"], "s_suppkey", "millis").filter("outcome = 'proposed'").select(*ids, F.lit("n").alias("name"), "millis", F.col("s_suppkey").alias("ordinal"))
    old = table(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(ids[0], F.lit("musicbrainz").alias("provider"), ids[1].alias("proposed_external_id"), F.lit("n").alias("provider_name"), F.lit(0).cast("decimal(4,3)").alias("match_score"), F.lit("rejected").alias("status"))
    out = accounts.proposed_reviews(old, proposed)
    return out.select(F.col("artist_id").cast("int").alias("artist"), F.col("proposed_external_id").cast("long").alias("proposed"), "status", F.col("match_score").cast("double").alias("score"))


@query(f"""
WITH r AS (SELECT *, row_number() OVER w AS i, lead(millis) OVER w AS next FROM ({_SCORED}) WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
m AS (SELECT s_nationkey, s_suppkey FROM r WHERE i = 1 AND millis >= 970 AND (next IS NULL OR millis - next >= 80))
SELECT n_nationkey AS artist, coalesce('S' || s_suppkey, 'old' || n_nationkey) AS external_id FROM nation LEFT JOIN m ON s_nationkey = n_nationkey WHERE s_suppkey IS NOT NULL OR n_nationkey % 2 = 0
""")
def q_mapping_upsert(spark, d):
    mapped = artists.map_or_propose(_scored(spark, d).drop("reasons"), ["s_nationkey"], "s_suppkey", "millis").filter("outcome = 'mapped'")
    rows = mapped.select(F.col("s_nationkey").cast("string").alias("artist_id"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("external_id"), "millis", F.col("s_suppkey").alias("ordinal"))
    key = F.col("n_nationkey").cast("string")
    old = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(key.alias("artist_id"), F.lit("musicbrainz").alias("provider"), F.concat(F.lit("old"), key).alias("external_id"), F.lit("").alias("provider_url"), F.lit(True).alias("confirmed"), F.lit(1).cast("decimal(4,3)").alias("match_score"), F.lit("manual").alias("mapping_source"))
    return accounts.sure_mappings(old, rows).select(F.col("artist_id").cast("int").alias("artist"), "external_id")


# -- the feed -----------------------------------------------------------------------------------


def _feed(spark, d) -> DataFrame:
    """Orders in the role of feed items: customers as candidates, parts as tracks and releases
    by way of the first line, lines as credits and evidence, suppliers as availability."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    state = classify.ladder((F.col("o_orderstatus") == "P", "needs_review"), (F.col("o_orderdate") > ntz("1998-01-01 00:00:00"), "upcoming"), otherwise="new")
    items = orders.select(
        F.col("o_orderkey").alias("feed_id"),
        F.col("o_custkey").alias("candidate_id"),
        F.col("o_orderkey").alias("track_id"),
        F.when(F.col("o_orderpriority") < "3", F.col("o_custkey")).alias("release_id"),
        state.alias("state"),
        F.col("o_orderdate").alias("first_seen_at"),
        F.col("o_orderkey").alias("position"),
    )
    customer = table(spark, d, "customer").filter("c_acctbal > 0")
    candidates = customer.select(F.col("c_custkey").alias("candidate_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("artist_external_id"), F.lit("2030-01-01").alias("release_date"), F.when(F.col("c_acctbal") > 5000, F.lit("exact_isrc")).otherwise(F.lit("metadata")).alias("match_rule"), F.when(F.col("c_acctbal") > 5000, F.lit("1.000")).otherwise(F.lit("0.900")).cast("decimal(4,3)").alias("match_confidence"), F.array(F.col("c_mktsegment"), F.lit("same")).alias("match_reasons"))
    tracks = orders.filter("o_totalprice > 100000").select(F.col("o_orderkey").alias("track_id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_custkey").alias("release_id"))
    releases = customer.select(F.col("c_custkey").alias("release_id"), F.col("c_mktsegment").alias("title"), F.lit("album").alias("release_type"), F.when(F.col("c_acctbal") > 8000, F.lit("year")).otherwise(F.lit("week")).alias("release_date_precision"))
    credits = lines.filter("l_quantity > 25").select(F.col("l_orderkey").alias("track_id"), F.struct(*_LINE_ORDER).alias("credit_order"), F.concat("l_returnflag", "l_linestatus").alias("credited_name"), F.when(F.col("l_tax") > 0.04, F.lit("featured")).otherwise(F.lit("primary")).alias("role"))
    evidence = customer.filter("c_nationkey < 10").select(F.col("c_custkey").alias("candidate_id"), F.lit("https://example.test/").alias("source_url"), F.when(F.col("c_nationkey") < 5, F.lit("spotify")).otherwise(F.lit("mock")).alias("provider"))
    places = lines.select(F.col("l_orderkey").alias("track_id"), F.when(F.col("l_linestatus") == "O", F.lit("spotify")).otherwise(F.lit("mock")).alias("provider"), F.col("l_suppkey").alias("provider_track_id"), F.col("l_returnflag").alias("region"), F.when(F.col("l_discount") < 0.06, F.lit("playable")).otherwise(F.lit("blocked")).alias("state"))
    sent = lines.filter("l_quantity > 49").select(F.col("l_orderkey").alias("track_id"), F.lit("exported").alias("status"))
    return feed.feed_rows(items, candidates, tracks, releases, credits, evidence, places, sent)


_FEED = f"""
SELECT o_orderkey AS id, state, coalesce(names, c_mktsegment) AS artist, CASE WHEN o_totalprice > 100000 THEN 'Order ' || o_orderkey ELSE c_name END AS title,
       CASE WHEN o_orderpriority < '3' OR o_totalprice > 100000 THEN c_mktsegment ELSE c_name END AS release_title, CASE WHEN o_orderpriority < '3' OR o_totalprice > 100000 THEN 'album' ELSE 'other' END AS release_type,
       CASE WHEN (o_orderpriority < '3' OR o_totalprice > 100000) AND c_acctbal > 8000 THEN 'year' ELSE 'day' END AS release_date_precision,
       CASE WHEN c_nationkey < 5 THEN 'Spotify' WHEN c_nationkey < 10 THEN 'Mock provider' ELSE '' END AS provider, coalesce(playing.s, 'unavailable') AS availability, CASE WHEN c_acctbal > 5000 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
       c_mktsegment || '; same' AS match_reason, coalesce(playing.r, anywhere.r, 'ZZ') AS region,
       CASE WHEN sent IS NOT NULL THEN 'exported' WHEN state = 'needs_review' THEN 'review_required' WHEN playing.s = 'playable' AND c_acctbal > 5000 THEN 'eligible' ELSE 'blocked' END AS export_status,
       ['coral', 'cyan', 'lime', 'gold'][o_orderkey % 4 + 1] AS accent, epoch_us(o_orderdate) AS first_seen_us, o_orderkey AS position
FROM (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'needs_review' WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN 'upcoming' ELSE 'new' END AS state FROM orders)
JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey
LEFT JOIN (SELECT l_orderkey AS k1, string_agg(CASE WHEN i > 1 AND l_tax > 0.04 THEN 'feat. ' ELSE '' END || l_returnflag || l_linestatus, ' ' ORDER BY i) AS names FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SQL_ORDER}) AS i FROM lineitem WHERE l_quantity > 25) GROUP BY 1) ON k1 = o_orderkey
LEFT JOIN (SELECT l_orderkey AS k2, min({{'p': l_suppkey, 'r': l_returnflag, 's': CASE WHEN l_discount < 0.06 THEN 'playable' ELSE 'blocked' END}}) AS playing FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) ON k2 = o_orderkey
LEFT JOIN (SELECT l_orderkey AS k3, min({{'a': CASE WHEN l_linestatus = 'O' THEN 'spotify' ELSE 'mock' END, 'p': l_suppkey, 'r': l_returnflag}}) AS anywhere FROM lineitem GROUP BY 1) ON k3 = o_orderkey
LEFT JOIN (SELECT DISTINCT l_orderkey AS sent FROM lineitem WHERE l_quantity > 49) ON sent = o_orderkey
"""
_SHOWN = ["id", "state", "artist", "title", "release_title", "release_type", "release_date_precision", "provider", "availability", "confidence", "match_reason", "region", "export_status", "accent", "first_seen_us", "position"]


@query(_FEED)
def q_feed(spark, d):
    return _feed(spark, d).withColumn("provider", F.array_join("sources.provider", ",")).withColumn("first_seen_us", micros("first_seen_at")).select(*_SHOWN)


@query(f"SELECT id, artist, title, availability, confidence FROM ({_FEED}) WHERE state IN ('new', 'upcoming') AND contains(lower(concat_ws(' ', artist, title, release_title)), 'order 1') AND confidence = 1 AND availability = 'playable' AND release_type = 'album'")
def q_feed_filter(spark, d):
    wanted = feed.feed_filter(("new", "upcoming"), " Order 1 ", True, True, "album", date_from="2029-12-01", date_to="2030-01-01")
    return _feed(spark, d).filter(wanted).select("id", "artist", "title", "availability", "confidence")


@query(f"SELECT id, CAST(row_number() OVER (ORDER BY first_seen_us DESC, position) - 1 AS BIGINT) AS place FROM ({_FEED})")
def q_feed_sort(spark, d):
    return keyed.numbered(_feed(spark, d).select("id", "release_date", "first_seen_at", "position"), feed.feed_order(), "place").select("id", "place")


@query(f"""
SELECT CAST(count(*) AS BIGINT) AS n_items, count(*) FILTER (state = 'needs_review') AS n_review, count(*) FILTER (export_status = 'eligible') AS n_eligible, count(*) FILTER (export_status = 'exported') AS n_exported,
       count(*) FILTER (export_status NOT IN ('eligible', 'exported')) AS n_blocked, 0::BIGINT AS n_saved, 0::BIGINT AS n_listened, count(*) FILTER (state = 'dismissed') AS n_dismissed
FROM (SELECT CASE WHEN c = 'keep_separate' THEN 'dismissed' WHEN c = 'confirm' THEN 'new' ELSE state END AS state, CASE WHEN c = 'keep_separate' THEN 'blocked' WHEN c = 'confirm' THEN CASE WHEN availability = 'playable' THEN 'eligible' ELSE 'blocked' END ELSE export_status END AS export_status
      FROM ({_FEED}) LEFT JOIN (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 300000 THEN 'confirm' ELSE 'keep_separate' END AS c FROM orders WHERE o_orderstatus = 'P') ON k = id)
""")
def q_feed_counts(spark, d):
    decisions = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") > 300000, F.lit("confirm")).otherwise(F.lit("keep_separate")).alias("decision"))
    return feed.feed_counts(feed.review_actions(_feed(spark, d), decisions))


@query(f"SELECT artist, max(first_seen_us) AS last_seen_us, count(*) AS n_rows, string_agg(DISTINCT nullif(provider, ''), ',' ORDER BY nullif(provider, '')) AS providers FROM ({_FEED}) GROUP BY artist")
def q_watchlist(spark, d):
    rows = feed.watchlist(_feed(spark, d))
    return rows.select("artist", micros("last_seen_at").alias("last_seen_us"), "n_rows", text.blank_to_null(F.array_join("providers", ",")).alias("providers"))


@query(f"""
WITH w AS (SELECT artist, max(first_seen_us) AS last_seen_us, count(*) AS n_rows FROM ({_FEED}) GROUP BY artist),
a AS (SELECT coalesce(w.artist, n.n_name) AS artist, last_seen_us, coalesce(n_rows, 0) AS n_rows FROM w FULL JOIN nation n ON w.artist = n.n_name)
SELECT artist, n_rows, CAST(row_number() OVER (ORDER BY last_seen_us DESC NULLS LAST, lower(artist)) - 1 AS BIGINT) AS added_place, CAST(row_number() OVER (ORDER BY lower(artist) DESC) - 1 AS BIGINT) AS name_place
FROM a WHERE artist NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1)
""")
def q_watchlist_ordered(spark, d):
    """The watchlist with artists that were added by hand and without those removed, with the
    places of two of its orders."""
    nation = table(spark, d, "nation")
    known, removed = nation.select(F.col("n_name").alias("artist")), nation.filter("n_regionkey = 1").select(F.col("n_name").alias("artist"))
    rows = feed.watchlist(_feed(spark, d), known, removed).select("artist", "n_rows", "last_seen_at")
    by_added = keyed.numbered(rows, feed.watchlist_order("added"), "added_place")
    return keyed.numbered(by_added, feed.watchlist_order("name", descending=True), "name_place").select("artist", "n_rows", "added_place", "name_place")


# -- views ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (7, 11)")
def q_owned_private(spark, d):
    status = F.col("o_orderstatus")
    playlists = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("owner_id"), F.when(status != "P", status != "F").alias("public"))
    return playlists.filter(views.owned_private(F.lit(7), F.lit(11))).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE lower(p_name || p_brand) IN (SELECT lower(p_name || p_brand) FROM part GROUP BY 1 HAVING count(*) > 1)")
def q_duplicate_names(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat("p_name", "p_brand").alias("name"))
    return views.duplicate_names(rows, "p_partkey", "name").select("p_partkey")


@query("""
SELECT o_orderkey AS candidate_id, l_partkey AS provider_track_id, CASE WHEN o_orderpriority < '3' THEN 'exact_isrc' ELSE 'metadata' END AS match_rule, coalesce(c_acctbal > 9000, false) AS manually_confirmed
FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linestatus = 'O' LEFT JOIN customer ON o_custkey = c_custkey
""")
def q_sync_items(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    rule = F.when(F.col("o_orderpriority") < "3", F.lit("exact_isrc")).otherwise(F.lit("metadata"))
    candidates = orders.select(F.col("o_orderkey").alias("candidate_id"), F.col("o_orderkey").alias("track_id"), rule.alias("match_rule"), F.lit(1).alias("match_confidence"))
    places = lines.select(F.col("l_orderkey").alias("track_id"), F.col("l_partkey").alias("provider_track_id"), F.lit("").alias("provider_url"), F.when(F.col("l_linestatus") == "O", F.lit("spotify")).otherwise(F.lit("mock")).alias("provider"))
    rich = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    decisions = orders.join(rich, "o_custkey").select(F.col("o_orderkey").alias("candidate_id"), F.lit("confirm").alias("decision"))
    return views.items_to_export(candidates, places, decisions).select("candidate_id", "provider_track_id", "match_rule", "manually_confirmed")


@query("""
SELECT o_orderkey AS link_id, coalesce(c_name, 'Unknown title') AS title, coalesce(c_mktsegment, 'Unknown artist') AS artist, CASE WHEN o_totalprice < 100000 THEN 'disabled' WHEN o_orderpriority < '3' THEN 'configured' ELSE 'missing' END AS status
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
""")
def q_link_rows(spark, d):
    links = table(spark, d, "orders").select(F.col("o_orderkey").alias("link_id"), F.col("o_custkey").alias("item_id"), F.when(F.col("o_orderstatus") == "F", F.lit("USER_LINKED_VERIFIED")).otherwise(F.lit("NOT_CHECKED")).alias("state"), views.status_label(F.col("o_totalprice") >= 100000, F.col("o_orderpriority") < "3").alias("status"))
    items = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("artist"))
    return views.link_rows(links, items).select("link_id", "title", "artist", "status")


@query("""
SELECT p_partkey, p_size < 25 OR p_type = 'PROMO' AS selected FROM part
UNION ALL SELECT s_suppkey + 1000000, true FROM supplier WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = s_suppkey + 1000000)
""")
def q_selection(spark, d):
    """Parts with a selection, and suppliers under numbers from 1,000,001 on, of which those
    that are a part's number already are not added again."""
    part = table(spark, d, "part").select("p_partkey", F.lit(True).alias("selected"))
    chosen = table(spark, d, "part").filter("p_size < 25 OR p_type = 'PROMO'").select("p_partkey", F.lit(True).alias("selected"))
    more = table(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000).alias("p_partkey"), F.lit(True).alias("selected"))
    return views.append_once(views.with_selection(part, False, chosen, "p_partkey"), more.unionByName(chosen), "p_partkey")


# -- runs and counters ----------------------------------------------------------------------------

_COUNTS = "SELECT o_orderpriority AS provider, count(*) AS discovered, count(*) FILTER (o_orderstatus <> 'F') AS inserted, count(*) FILTER (o_orderstatus = 'F') AS skipped, count(*) FILTER (o_orderstatus = 'P') AS needs_review FROM orders GROUP BY 1"


def _counters(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("provider"), (F.col("o_orderstatus") != "F").alias("fresh"), (F.col("o_orderstatus") == "P").alias("review"))
    return runs.run_counters(rows, ["provider"])


@query(_COUNTS)
def q_run_counters(spark, d):
    return _counters(spark, d)


@query(f"SELECT CAST(sum(discovered) AS BIGINT) AS discovered, CAST(sum(inserted) AS BIGINT) AS inserted, CAST(sum(skipped) AS BIGINT) AS skipped, CAST(sum(needs_review) AS BIGINT) AS needs_review FROM ({_COUNTS})")
def q_run_totals(spark, d):
    return runs.run_totals(_counters(spark, d))


@query("SELECT o_orderkey AS run_id, coalesce(nullif(o_orderpriority, '5-LOW'), 'all providers') || ': ' || o_orderstatus AS line FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def q_recent_runs(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("provider"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"), F.lit(None).cast("timestamp").alias("completed_at"))
    return runs.recent_runs(rows).select("run_id", "line")


# -- stateful gates and streams ---------------------------------------------------------------------

_MINUTE = 60_000_000


@query(f"""
WITH e AS (SELECT event_id, epoch_us(ts) AS t, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT event_id, CAST(max(t - i * {_MINUTE}) OVER (ORDER BY i) + i * {_MINUTE} AS BIGINT) AS start_us FROM e
""")
def q_rate_gate(spark, d):
    return gates.rate_gate(table(spark, d, "events").select("event_id", "ts"), micros("ts"), ["ts", "event_id"], _MINUTE).select("event_id", "start_us")


def _attempts(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("user_id"), micros("ts").alias("at_us"))


def _stepped(key: str, first: str, step: str) -> str:
    """Events of each key one after the other; `g` is the state after the one before."""
    return f"""
WITH RECURSIVE e AS (SELECT event_id, {key} AS k, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM events),
g(k, i, event_id, until, n, granted) AS (
  SELECT k, i, event_id, {first} FROM e WHERE i = 1
  UNION ALL
  SELECT e.k, e.i, e.event_id, {step} FROM g JOIN e ON e.k = g.k AND e.i = g.i + 1
)
SELECT event_id, granted FROM g
"""


_DAY = 24 * 60 * _MINUTE


@query(_stepped("user_id", f"t + {_DAY}, 1, true", f"CASE WHEN e.t < until THEN until ELSE e.t + {_DAY} END, CASE WHEN e.t < until THEN n + 1 ELSE 1 END, e.t >= until OR n < 3"))
def q_rate_limit(spark, d):
    rows = _attempts(spark, d)
    return gates.replay(rows, "user_id", "at_us", "event_id", "event_type", gates.WindowCounter(3, _DAY)).select("event_id", "granted")


@query(_stepped("event_type", f"t + {30 * _MINUTE}, 1, true", f"CASE WHEN e.t > until THEN e.t + {30 * _MINUTE} ELSE until END, 1, e.t > until"))
def q_lease(spark, d):
    rows = _attempts(spark, d)
    return gates.replay(rows, "event_type", "at_us", "event_id", "user_id", gates.Lease(30 * _MINUTE)).select("event_id", "granted")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events) WHERE i = 1")
def q_stream_dedupe(spark, d):
    import uuid

    from .storage import Store, shared_root

    root = f"{shared_root(spark)}/dedupe-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    schema = events.select("user_id", "event_type", "event_id").schema
    # A stream reads folders; the files of this one never change.
    source = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*").select("user_id", "event_type", "event_id")
    spark.createDataFrame([], schema).write.parquet(f"{root}/out/_batch=-1")
    written = T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])
    read = lambda: spark.read.schema(written).parquet(f"{root}/out")
    incremental.dedupe_stream(source, f"{root}/out", ["user_id", "event_type"], "event_id", f"{root}/checkpoint", read).awaitTermination()
    return read().select("user_id", "event_type", "event_id")

