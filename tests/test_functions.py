"""Scalar functions on small inline rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spindrift.functions import classify, dates, hashing, links, text


def values(spark, expression, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(expression).collect()]


def test_only_what_is_not_ascii_reaches_python(spark):
    sent = spark.createDataFrame([(None,), ("",), ("Plain & Simple",), ("ﬁne",), ("e\u0301",), ("\x7f",), ("\x80",)], "x string")
    assert values(spark, text.composed(F.col("x")), [r.x for r in sent.collect()]) == [None, "", "Plain & Simple", "fine", "é", "\x7f", "\x80"]
    kind = "c array<struct<name:string,role:string>>"
    rows = [([("A", "primary"), (None, "featured")],), ([("ﬁ", "primary"), (None, None), ("B", "featured")],), ([],), (None,), ([None],)]
    got = spark.createDataFrame(rows, kind).select(text.composed_credits(F.col("c")).alias("c")).collect()
    assert [r.c and [(x.name, x.role) for x in r.c] for r in got] == [[("A", "primary"), (None, "featured")], [("fi", "primary"), (None, None), ("B", "featured")], [], None, [(None, None)]]


def test_normalize_text(spark):
    given = ["  Rock & Roll!! ", "ﬁne ① Ａbc", "É—tude", "", None, "...", "a_b"]
    assert values(spark, text.normalize_text(F.col("x")), given) == ["rock and roll", "fine 1 abc", "é tude", "", None, "", "a b"]


def test_identifiers_versions_and_display(spark):
    assert values(spark, text.normalize_identifier(F.col("x")), ["us-mck-26-00001", "ß1", None]) == ["USMCK2600001", "SS1", None]
    assert values(spark, text.extract_version(F.col("x")), ["Alive", "Demons", "Live Remix", "Plain", "Radio-Edit"]) == ["live", "demo", "remix", None, "radio edit"]
    assert values(spark, text.first_parenthesised(F.col("x")), ["A (b) (c)", "A ()", "A"]) == ["b", None, None]
    assert values(spark, text.title_case(F.col("x")), ["needs_review", ""]) == ["Needs review", ""]
    assert values(spark, text.squeeze(F.col("x")), ["  a \n b "]) == ["a b"]
    assert values(spark, text.split_scopes(F.col("x")), [" a  b ", None]) == [["a", "b"], []]
    assert values(spark, text.quoted_term(F.col("x")), ['a "b" \\c']) == ['"a \\"b\\" \\\\c"']


def test_credits(spark):
    df = spark.createDataFrame([([("Ａ & B", "primary"), ("C", "featured")],), ([("C", "featured")],), ([],)], "c array<struct<name:string,role:string>>")
    assert [r[0] for r in df.select(text.normalized_credits(text.composed_credits(F.col("c")))).collect()] == ["primary:a and b|featured:c", "featured:c", ""]
    assert [r[0] for r in df.select(text.credit_line(F.col("c"))).collect()] == ["Ａ & B feat. C", "C", ""]


def test_partial_dates(spark):
    given = ["2030", "2030-02", "2030-02-31", "20301", "", None]
    assert [tuple(v) if v else None for v in values(spark, dates.partial_date(F.col("x")), given)] == [("2030-01-01", "year"), ("2030-02-01", "month"), ("2030-02-31", "day"), None, None, None]
    now = F.lit("2030-05-01 00:00:00").cast("timestamp_ntz")
    assert values(spark, dates.is_upcoming(F.col("x"), now), ["2030-05-01", "2030-05-02", "2030-02-31", None]) == [False, True, False, False]
    assert values(spark, dates.display_date(F.col("x")), ["2030-05-01"]) == ["05/01/2030"]
    assert values(spark, dates.retry_delay(F.col("x").cast("int"), F.lit(1.0), 100, 300), ["1", "2", "3"]) == [100, 200, 300]


def test_classification(spark):
    df = spark.createDataFrame([("Album", ["Live", "Remix"]), ("EP", ["DJ-mix"]), ("Single", None), (None, [])], "p string, s array<string>")
    assert [r[0] for r in df.select(classify.typed_release(F.col("p"), F.col("s"))).collect()] == ["remix", "dj_mix", "single", "other"]
    titled = lambda kind, title, n, primary: classify.titled_release(F.lit(kind), F.lit("Name"), F.lit(title), F.lit(n), F.lit(primary))
    one = spark.range(1)
    assert one.select(titled("single", "x", 1, True), titled("single", "x", 2, True), titled("album", "Alive", 9, True), titled("album", "x", 9, False), titled("compilation", "x", 9, True)).first()[:] == ("single", "ep", "live", "feature", "other")
    assert one.select(classify.exportable(F.lit("exact_isrc"), F.lit(0.98), F.lit(False)), classify.exportable(F.lit("exact_isrc"), F.lit(0.979), F.lit(False)), classify.exportable(F.lit("metadata"), F.lit(1.0), F.lit(True)), classify.exportable(F.lit(None).cast("string"), F.lit(1.0), F.lit(None).cast("boolean"))).first()[:] == (True, False, True, False)


@pytest.mark.parametrize(
    ("kind", "url", "error"),
    [
        ("profile", "https://soundcloud.com/artist", None),
        ("profile", "https://soundcloud.com/artist/track", "Enter a SoundCloud artist profile URL."),
        ("profile", " ", "Enter a SoundCloud URL."),
        ("profile", "soundcloud.com/artist", "Enter a valid absolute URL."),
        ("profile", "http://soundcloud.com/artist", "SoundCloud links must use HTTPS."),
        ("profile", "https://notsoundcloud.com/artist", "Only SoundCloud domains are allowed."),
        ("profile", "https://soundcloud.com.evil.test/artist", "Only SoundCloud domains are allowed."),
        ("profile", "https://u:p@soundcloud.com/artist", "SoundCloud links cannot contain credentials."),
        ("track", "https://m.soundcloud.com/artist/track#t=1", None),
        ("track", "https://soundcloud.com/Search/track", "Enter an exact SoundCloud track URL."),
        ("track", "https://soundcloud.com/artist", "Enter an exact SoundCloud track URL."),
    ],
)
def test_links(spark, kind, url, error):
    (out,) = values(spark, links.validate_link(F.col("x"), kind), [url])
    assert (out.valid, out.error) == (error is None, error)
    if out.valid:
        assert out.normalized_url == url.split("#")[0]


def test_search_url(spark):
    df = spark.createDataFrame([("A B", ["C", " "], "T&x", None)], "a string, f array<string>, t string, v string")
    assert df.select(links.search_url(F.col("a"), F.col("t"), F.col("v"), F.col("f"))).first()[0] == "https://soundcloud.com/search/sounds?q=A+B+C+T%26x"
    assert values(spark, links.release_url(F.lit("spotify"), F.col("x"), F.lit("e")), ["a b/c"]) == ["https://open.spotify.com/album/a%20b%2Fc"]


def test_hashing_and_redaction(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    same = df.select(hashing.content_hash("x", "y"), hashing.content_hash("x")).first()
    assert same[0] == same[1]
    out = values(spark, hashing.redact_json(F.col("x")), ['{"a":[{"accessToken":"t","b":1}],"zip_code":2}', "no json", None])
    assert out == ['{"a":[{"accessToken":"[REDACTED]","b":1}],"zip_code":"[REDACTED]"}', '"[REDACTED]"', None]


def test_display_instant(spark):
    df = spark.createDataFrame([(dt.datetime(2030, 5, 1, 15, 4),)], "t timestamp")
    assert df.select(dates.display_instant(F.col("t"))).first()[0].endswith("PM") and df.select(dates.display_instant(F.col("t"))).first()[0].startswith("May 1")
