"""Strict reading of candidate documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CANDIDATE, validated

_NAMES = {"musicbrainz_recording_id": "musicbrainzRecordingId", "musicbrainz_release_group_id": "musicbrainzReleaseGroupId"}


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


_FIELDS = ", ".join(f"`{_NAMES.get(f.name, camel(f.name))}` {f.dataType.simpleString()}" for f in CANDIDATE if f.name != "ordinal")
DOCUMENT = f"fixtureVersion int, candidates array<struct<{', '.join(x.replace('` ', '`: ') for x in _FIELDS.split(', '))}>>, nextCursor string"


def parse_documents(texts: DataFrame, column: str = "value") -> DataFrame:
    """Candidates of JSON documents, numbered in order within each; any malformed document
    or value fails the whole read, and unknown keys are dropped."""
    parsed = texts.select(F.from_json(column, DOCUMENT, {"mode": "FAILFAST"}).alias("d"))
    good = F.when(F.col("d.fixtureVersion") == 1, F.col("d.candidates")).otherwise(F.raise_error(F.lit("unknown fixture version")))
    rows = parsed.select(F.posexplode(good).alias("ordinal", "c"))
    flat = rows.select(*(F.col("ordinal").cast("long").alias("ordinal") if f.name == "ordinal" else F.col(f"c.{_NAMES.get(f.name, camel(f.name))}").cast(f.dataType).alias(f.name) for f in CANDIDATE))
    return validated(flat)


def fixture_source(spark: SparkSession, path: str, provider: str = "mock", artist_external_id: str | None = None) -> DataFrame:
    """Candidates of one provider in the documents at `path`, one document a file."""
    rows = parse_documents(spark.read.text(path, wholetext=True)).filter(F.col("provider") == provider)
    return rows if artist_external_id is None else rows.filter(F.col("artist_external_id") == artist_external_id)
