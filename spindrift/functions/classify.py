"""Classification and label columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_text

# Secondary types in order of precedence, and the type each gives.
SECONDARY_TYPES = (("remix", "remix"), ("live", "live"), ("compilation", "compilation"), ("mixtape street", "mixtape"), ("dj mix", "dj_mix"), ("demo", "demo"), ("soundtrack", "soundtrack"))
PRIMARY_TYPES = ("single", "ep", "album")
# Labels shown for states.
EXPORT_LABELS = {"eligible": "Ready", "exported": "Exported", "blocked": "Not available", "review_required": "Review required"}
LINK_LABELS = {
    "NOT_CHECKED": "not checked",
    "SEARCH_LINK_AVAILABLE": "search link available",
    "USER_LINKED_UNVERIFIED": "link unverified",
    "USER_LINKED_VERIFIED": "link verified",
    "USER_LINK_REJECTED": "link rejected",
}
PROVIDER_LABELS = {"musicbrainz": "MusicBrainz", "spotify": "Spotify"}
ACCENTS = ("coral", "cyan", "lime", "gold")


def ladder(*steps: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    return F.coalesce(*(F.when(c, F.lit(v) if not isinstance(v, Column) else v) for c, v in steps), otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def label(key: Column, labels: dict[str, str], otherwise: str | None = None) -> Column:
    return ladder(*((key == k, v) for k, v in labels.items()), otherwise=otherwise)


def typed_release(primary: Column, secondary: Column, compose: bool = True) -> Column:
    """Type of a release that lists one primary type and any secondary ones."""
    kinds = F.transform(F.coalesce(secondary, F.array().cast("array<string>")), lambda s: normalize_text(s, compose=False))
    first = normalize_text(F.coalesce(primary, F.lit("")), compose)
    return ladder(*((F.array_contains(kinds, name), kind) for name, kind in SECONDARY_TYPES), *((first == p, p) for p in PRIMARY_TYPES), otherwise="other")


def titled_release(album_type: Column, album_title: Column, track_title: Column, total_tracks: Column, primary: Column, compose: bool = True) -> Column:
    """Type of a release told by its titles, unless the watched artist is not the primary."""
    text = normalize_text(F.concat_ws(" ", album_title, track_title), compose)
    return ladder(
        (~primary, "feature"),
        (F.contains(text, F.lit("remix")), "remix"),
        (F.contains(text, F.lit("live")), "live"),
        ((album_type == "single") & (total_tracks > 1), "ep"),
        (album_type == "single", "single"),
        (album_type == "album", "album"),
        otherwise="other",
    )


def feature_override(credits: Column, kind: Column) -> Column:
    return F.when(F.exists(credits, lambda c: c["role"] == "featured"), F.lit("feature")).otherwise(kind)


def availability(is_playable: Column, restricted: Column) -> Column:
    return ladder((is_playable, "playable"), (restricted, "blocked"), otherwise="unavailable")


def region_code(country: Column) -> Column:
    return F.coalesce(F.substring(country, 1, 2), F.lit("ZZ"))


def positional_roles(artists: Column, watched: Column) -> Column:
    """Credits of artists (id, name): the watched one is featured unless it comes first."""
    role = lambda a, i: F.when((a["id"] == watched) & (i > 0), F.lit("featured")).otherwise(F.lit("primary"))
    return F.transform(artists, lambda a, i: F.struct(a["name"].alias("name"), role(a, i).alias("role")))


def match_status(kind: Column) -> Column:
    return ladder((kind == "review", "needs_review"), (kind == "new", "new"), otherwise="matched")


def feed_state(upcoming: Column, kind: Column) -> Column:
    """An upcoming release stays upcoming even while under review."""
    return ladder((F.coalesce(upcoming, F.lit(False)), "upcoming"), (kind == "review", "needs_review"), otherwise="new")


def export_status(exported: Column, state: Column, availability_state: Column, match_rule: Column) -> Column:
    return ladder(
        (exported, "exported"),
        (state == "needs_review", "review_required"),
        ((availability_state == "playable") & match_rule.startswith("exact_"), "eligible"),
        otherwise="blocked",
    )


def exportable(match_rule: Column, confidence: Column, confirmed: Column) -> Column:
    exact = match_rule.startswith("exact_") & (confidence.cast("decimal(4,3)") >= F.lit("0.98").cast("decimal(4,3)"))
    return F.coalesce(exact, F.lit(False)) | F.coalesce(confirmed, F.lit(False))


def cyclic_accent(position: Column) -> Column:
    """A colour by position from 0."""
    return F.element_at(F.array(*map(F.lit, ACCENTS)), (F.pmod(position, F.lit(len(ACCENTS))) + 1).cast("int"))


def announcement_confidence(provider: Column) -> Column:
    return F.when(provider == "musicbrainz", F.lit("0.700")).otherwise(F.lit("0.850")).cast("decimal(4,3)")
