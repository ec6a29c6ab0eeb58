"""Schemas, enumerations and constraints of the data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The enumerations of the data model.
PROVIDERS = ("mock", "spotify", "musicbrainz", "youtube", "soundcloud", "apple_music", "tidal")
RELEASE_TYPES = ("single", "ep", "album", "compilation", "remix", "live", "mixtape", "dj_mix", "demo", "soundtrack", "feature", "upload", "other")
AVAILABILITIES = ("playable", "preview", "blocked", "unavailable")
PRECISIONS = ("day", "month", "year")
ROLES = ("primary", "featured", "remixer", "producer")
FEED_STATES = ("new", "upcoming", "saved", "dismissed", "listened", "needs_review")
MATCH_RULES = ("exact_provider_id", "exact_isrc", "exact_barcode_position", "exact_musicbrainz", "metadata", "new_canonical", "manual_review")

CREDITS = "array<struct<name:string,role:string>>"
_TYPES = {
    "string": T.StringType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "decimal(4,3)": T.DecimalType(4, 3),
    "array<string>": T.ArrayType(T.StringType()),
    CREDITS: T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("role", T.StringType())])),
}


def struct_of(columns: str) -> T.StructType:
    """A schema of "name type, name type": unlike a DDL string it needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in columns.split(", "))])


CANDIDATE = struct_of(
    "ordinal long, provider string, external_release_id string, external_track_id string, source_label string,"
    " artist_external_id string, artist_name string, title string, release_title string, release_type string,"
    f" release_date string, release_date_precision string, first_seen_at timestamp, credits {CREDITS},"
    " duration_ms int, disc_number int, track_number int, isrc string, upc string, ean string,"
    " musicbrainz_recording_id string, musicbrainz_release_group_id string, version string, region string,"
    " availability string, provider_url string, evidence_url string, evidence_type string, payload_hash string, is_upcoming boolean"
)
#: A canonical track as the matcher sees it; `ordinal` fixes what "first" means.
TRACK = struct_of(
    f"ordinal long, track_id string, title string, credits {CREDITS}, duration_ms int, disc_number int, track_number int,"
    " isrc string, upc string, ean string, musicbrainz_recording_id string, musicbrainz_release_group_id string, version string"
)

#: Tables of the store: columns, and the key that makes a write idempotent.
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "artists": ("artist_id string, name string, normalized_name string", ("artist_id",)),
    "artist_aliases": ("artist_id string, name string, normalized_name string, source string", ("artist_id", "normalized_name")),
    "artist_external_ids": ("artist_id string, provider string, external_id string, provider_url string, confirmed boolean, match_score decimal(4,3), mapping_source string", ("provider", "external_id")),
    "artist_follows": ("artist_id string, followed_at timestamp, active boolean", ("artist_id",)),
    "releases": ("release_id string, title string, normalized_title string, release_type string, release_date string, release_date_precision string, upc string, ean string, version string", ("release_id",)),
    "tracks": ("track_id string, ordinal long, release_id string, title string, normalized_title string, duration_ms int, isrc string, disc_number int, track_number int, musicbrainz_recording_id string, musicbrainz_release_group_id string, version string", ("track_id",)),
    # The matcher's keys of stored tracks, made when these are written.
    "match_index": ("p0 string, p1 string, p2 string, p3 string, p4 string, duration int, ordinal long, track_id string, version string", ("p0", "p1", "p2", "p3", "p4", "duration", "ordinal")),
    "track_credits": ("track_id string, credit_order int, artist_id string, role string, credited_name string", ("track_id", "credit_order")),
    "track_external_ids": ("provider string, external_id string, track_id string, provider_url string, provider_fields string", ("provider", "external_id")),
    "release_external_ids": ("provider string, external_id string, release_id string, provider_url string, provider_fields string", ("provider", "external_id")),
    "track_availabilities": ("provider string, provider_track_id string, region string, track_id string, state string, provider_url string", ("provider", "provider_track_id", "region")),
    "release_candidates": (
        "candidate_id string, run_id string, provider string, external_release_id string, external_track_id string, artist_external_id string, title string, normalized_title string, release_date string,"
        " payload_hash string, match_status string, track_id string, match_rule string, match_confidence decimal(4,3), match_reasons array<string>, algorithm string, first_seen_at timestamp",
        ("provider", "external_release_id", "external_track_id"),
    ),
    "source_evidence": ("candidate_id string, provider string, evidence_type string, external_id string, source_url string, payload_hash string, retrieved_at timestamp", ("provider", "evidence_type", "external_id", "payload_hash")),
    "announcements": ("provider string, external_id string, artist_id string, release_id string, title string, scheduled_for string, date_precision string, confidence decimal(4,3), evidence_url string, first_seen_at timestamp", ("provider", "external_id")),
    "date_history": ("provider string, external_id string, scheduled_for string, date_precision string", ("provider", "external_id", "scheduled_for", "date_precision")),
    "feed_items": ("feed_id string, candidate_id string, track_id string, release_id string, state string, dedupe_key string, first_seen_at timestamp, ordinal long", ("dedupe_key",)),
    "playlist_exports": ("target_id string, provider_track_id string, track_id string, status string, exported_at timestamp", ("target_id", "provider_track_id")),
    "scan_runs": ("run_id string, provider string, status string, started_at timestamp, completed_at timestamp, discovered long, inserted long, skipped long, needs_review long, error string", ("run_id",)),
    "cursors": ("provider string, scope string, scope_id string, value string", ("provider", "scope", "scope_id")),
}


def table_schema(name: str) -> T.StructType:
    return struct_of(TABLES[name][0])


def candidate_rules() -> dict[str, Column]:
    """What a valid candidate satisfies, by rule name; null counts as a violation of a
    required value and as none of an optional one."""
    c = F.col
    filled = ("external_release_id", "external_track_id", "source_label", "artist_external_id", "artist_name", "title", "release_title", "evidence_type")
    optional = lambda name, ok: c(name).isNull() | ok
    uuid = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    url = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$"
    rules = {f"{n} is filled": F.length(n) >= 1 for n in filled}
    rules |= {f"{n} is one of its values": c(n).isin(*vs) for n, vs in (("provider", PROVIDERS), ("release_type", RELEASE_TYPES), ("availability", AVAILABILITIES), ("release_date_precision", PRECISIONS))}
    rules |= {f"{n} is positive": optional(n, c(n) > 0) for n in ("duration_ms", "disc_number", "track_number")}
    rules |= {f"{n} has 5 characters": optional(n, F.length(n) >= 5) for n in ("isrc", "upc", "ean")}
    rules |= {f"{n} is a UUID": optional(n, c(n).rlike(uuid)) for n in ("musicbrainz_recording_id", "musicbrainz_release_group_id")}
    rules |= {f"{n} is a URL": c(n).rlike(url) for n in ("provider_url", "evidence_url")}
    return rules | {
        "version is filled": optional("version", F.length("version") >= 1),
        "region has 2 characters": F.length("region") == 2,
        "release_date is a date": c("release_date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date("release_date").isNotNull(),
        "first_seen_at is an instant": c("first_seen_at").isNotNull(),
        "payload_hash has 8 characters": F.length("payload_hash") >= 8,
        "credits has one": (F.size("credits") >= 1) & F.forall("credits", lambda x: (F.length(x["name"]) >= 1) & x["role"].isin(*ROLES)),
    }


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks."""
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda r: r.isNotNull())


def validated(candidates: DataFrame) -> DataFrame:
    """The candidates; one that breaks a rule fails the whole batch."""
    broken = violations(candidate_rules())
    checked = F.when(F.size(broken) > 0, F.raise_error(F.concat(F.lit("invalid candidate: "), F.array_join(broken, "; ")))).otherwise(F.col("provider"))
    return candidates.withColumn("provider", checked)


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys without nulls that more than one row has: empty where a unique index would hold."""
    filled = df.dropna(subset=list(key))
    return filled.groupBy(*key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def exactly_one(*columns: str) -> Column:
    """Whether just one of the columns is set."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int")) == 1
