"""URL checks and URL building."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import ladder

LINK_HOST = "soundcloud.com"
#: Scheme, optional user information, host, optional port, path, query; the fragment is dropped.
_ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:@]+)(:\d+)?([^?#]*)(\?[^#]*)?(?:#.*)?$"
_CREDENTIALS = r"^[^:/?#]+://[^/?#]*@"


def percent_encoded(text: Column) -> Column:
    """URI component encoding: a space is %20, and !'()*~ stay."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def release_url(provider: Column, release_id: Column, evidence_url: Column) -> Column:
    return ladder(
        (provider == "spotify", F.concat(F.lit("https://open.spotify.com/album/"), percent_encoded(release_id))),
        (provider == "musicbrainz", F.concat(F.lit("https://musicbrainz.org/release/"), percent_encoded(release_id))),
        otherwise=evidence_url,
    )


def validate_link(text: Column, kind: str, host: str = LINK_HOST, name: str = "SoundCloud") -> Column:
    """(valid, error, normalized_url) of a link to a profile (one path segment) or a track.

    The checks come in a fixed order and the first failure is reported.
    """
    if kind not in ("profile", "track"):
        raise ValueError("kind must be profile or track")
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    part = lambda k: F.regexp_extract(trimmed, _ABSOLUTE, k)
    where = F.lower(part(3))
    segments = F.filter(F.split(part(5), "/"), lambda s: s != "")
    wrong = (F.size(segments) != 1) if kind == "profile" else (F.size(segments) < 2) | (F.lower(F.get(segments, F.lit(0))) == "search")
    error = ladder(
        (trimmed == "", f"Enter a {name} URL."),
        (~trimmed.rlike(_ABSOLUTE), "Enter a valid absolute URL."),
        (F.lower(part(1)) != "https", f"{name} links must use HTTPS."),
        ((where != host) & ~F.endswith(where, F.lit(f".{host}")), f"Only {name} domains are allowed."),
        (trimmed.rlike(_CREDENTIALS), f"{name} links cannot contain credentials."),
        (wrong, f"Enter a {name} artist profile URL." if kind == "profile" else f"Enter an exact {name} track URL."),
    )
    port = F.when(part(4) == ":443", F.lit("")).otherwise(part(4))
    path = F.when(part(5) == "", F.lit("/")).otherwise(part(5))
    clean = F.concat(F.lower(part(1)), F.lit("://"), where, port, path, part(6))
    return F.struct(error.isNull().alias("valid"), error.alias("error"), F.when(error.isNull(), clean).alias("normalized_url"))


def link_check(url: Column, host: str = LINK_HOST) -> Column:
    """The table constraint on stored links: https, the host or a subdomain, any path."""
    return url.rlike(rf"^https://([A-Za-z0-9-]+\.)*{host.replace('.', '[.]')}(/|$)")


def search_url(artist: Column, title: Column, version: Column | None = None, featured: Column | None = None) -> Column:
    """A search link of the non-blank parts in order."""
    shown = lambda c: F.when(F.trim(c) != "", c)
    names = F.filter(F.coalesce(featured, F.array().cast("array<string>")), lambda s: F.trim(s) != "") if featured is not None else F.array().cast("array<string>")
    parts = F.concat(F.array(shown(artist)), names, F.array(shown(title)), F.array(shown(version) if version is not None else F.lit(None).cast("string")))
    return F.concat(F.lit(f"https://{LINK_HOST}/search/sounds?q="), F.url_encode(F.array_join(F.filter(parts, lambda p: p.isNotNull()), " ")))
