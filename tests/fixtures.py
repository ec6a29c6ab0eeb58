"""Small inputs for the tests of the data-integration operators."""

from spindrift.schemas import CANDIDATE


def candidate(ordinal, **values):
    """A valid candidate row, with some values replaced."""
    row = {
        "ordinal": ordinal, "provider": "mock", "external_release_id": f"release-{ordinal}", "external_track_id": f"track-{ordinal}", "source_label": "fixture",
        "artist_external_id": "artist-a", "artist_name": "Artist A", "title": f"Title {ordinal}", "release_title": f"Release {ordinal}", "release_type": "single",
        "release_date": "2030-05-01", "release_date_precision": "day", "credits": [{"name": "Artist A", "role": "primary"}], "region": "US", "availability": "playable",
        "provider_url": "https://example.test/p", "evidence_url": "https://example.test/e", "evidence_type": "fixture", "payload_hash": f"hash-{ordinal:05d}",
    } | values
    import datetime

    row.setdefault("first_seen_at", datetime.datetime(2030, 4, 1, 12, ordinal % 60))
    return tuple(row.get(f.name) for f in CANDIDATE)


def five_candidates():
    """A first sighting, the same recording in other spelling of its ISRC, a title without
    identifiers, the same with another length, and an announcement."""
    return [
        candidate(0, artist_external_id="lf", artist_name="Lumen F", title="Glass H", credits=[("Lumen F", "primary")], duration_ms=218400, isrc="USMCK2600001"),
        candidate(1, artist_external_id="lf", artist_name="Lumen F", title="Glass H", credits=[("Lumen F", "primary")], duration_ms=218900, isrc="US-MCK-26-00001"),
        candidate(2, artist_external_id="oe", artist_name="Oxide E", title="Static B", credits=[("Oxide E", "primary")], duration_ms=194000),
        candidate(3, artist_external_id="oe", artist_name="Oxide E", title="Static B", credits=[("Oxide E", "primary")], duration_ms=203000, availability="unavailable"),
        candidate(4, artist_external_id="jv", artist_name="Juniper V", title="After I", credits=[("Juniper V", "primary")], duration_ms=241000, release_type="ep", is_upcoming=True),
    ]
