"""Text normalisation, identifiers, version markers and credits, as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Markers of a version, in order of precedence.
VERSION_MARKERS = ("remix", "live", "radio edit", "extended mix", "clean", "explicit", "demo", "acoustic", "instrumental", "remaster")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no built-in for."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


def is_ascii(text: Column) -> Column:
    """As many bytes as characters; null for null."""
    return F.octet_length(text) == F.length(text)


def composed(text: Column) -> Column:
    """Compatibility form.  Plain ASCII is in it already, so Python is sent nulls for such
    rows and only the others' texts; the plan stays one scan, where a split by filter and
    union would run all that is below it twice."""
    return F.coalesce(nfkc(F.when(~is_ascii(text), text)), text)


def normalize_text(text: Column, compose: bool = True) -> Column:
    """Compatibility form, lower case, `&` as a word, and runs of other characters than
    letters and digits as one space.

    Only the composition leaves the JVM, for texts that are not plain ASCII; columns known to
    be composed can switch it off and then stay within generated code.
    """
    if compose:
        text = composed(text)
    spelled = F.replace(F.lower(text), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(spelled, r"[^\p{L}\p{N}]+", " "))


def normalize_identifier(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def extract_version(title: Column, markers: tuple[str, ...] = VERSION_MARKERS, compose: bool = True) -> Column:
    """The first marker that the normalised title contains, also within a word; else null."""
    return first_contained(normalize_text(title, compose), markers)


def first_contained(text: Column, markers: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(F.contains(text, F.lit(m)), F.lit(m)) for m in markers))


def normalized_credits(credits: Column) -> Column:
    """`role:name` of each credit, in order, names without composition (see `credit_names`)."""
    return F.array_join(F.transform(credits, lambda c: F.concat(c["role"], F.lit(":"), normalize_text(c["name"], compose=False))), "|")


def composed_credits(credits: Column) -> Column:
    """Credits with composed names: an array that is not plain ASCII travels as JSON through
    one Arrow function, so that no array element needs a Python call of its own; the others
    are neither written as JSON nor read from it."""
    plain = F.transform(credits, lambda c: F.struct(c["name"].alias("name"), c["role"].alias("role")))
    foreign = F.exists(credits, lambda c: ~is_ascii(F.concat_ws("", c["name"], c["role"])))
    return F.when(foreign, F.from_json(nfkc(F.when(foreign, F.to_json(plain))), "array<struct<name:string,role:string>>")).otherwise(plain)


def credit_line(credits: Column) -> Column:
    """Names in order joined by spaces; featured ones after the first are marked."""
    featured = lambda c, i: F.when((c["role"] == "featured") & (i > 0), F.concat(F.lit("feat. "), c["name"])).otherwise(c["name"])
    return F.array_join(F.transform(credits, featured), " ")


def first_parenthesised(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\(([^)]+)\)", 1), F.lit(""))


def title_case(text: Column) -> Column:
    """Underscores as spaces, and the first letter in upper case."""
    spaced = F.replace(text, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substr(spaced, F.lit(2)))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def monogram(name: Column) -> Column:
    return F.upper(F.left(name, F.lit(2)))


def split_scopes(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda s: s != "")


def quoted_term(text: Column) -> Column:
    """A search phrase in double quotes, with quotes and backslashes escaped."""
    return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))


def any_of_terms(terms: Column) -> Column:
    return F.array_join(F.transform(terms, quoted_term), " OR ")


def blank_to_null(text: Column) -> Column:
    """Null for null and the empty text: a value that counts as absent."""
    return F.nullif(text, F.lit(""))


def zero_to_null(number: Column) -> Column:
    return F.nullif(number, F.lit(0))
