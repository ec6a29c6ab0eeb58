"""Options, configuration and the choice of sources."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from ..plans.runs import Options
from ..schemas import PROVIDERS

#: Sources that a scan can use; the other providers are known by name only.
AVAILABLE = ("mock", "spotify", "musicbrainz")
#: What makes a source configured.
REQUIRED = {"spotify": ("SPOTIFY_CLIENT_ID", "SPOTIFY_CLIENT_SECRET", "APP_ENCRYPTION_KEY"), "musicbrainz": ("MUSICBRAINZ_CONTACT_EMAIL",)}


def parse_options(args: list[str], now: dt.datetime) -> Options:
    """Flags to options; an unknown flag or a missing value is an error."""
    out, rest = Options(now=now), [a for a in args if a != "--"]
    while rest:
        flag = rest.pop(0)
        if flag == "--dry-run":
            out.dry_run = True
        elif flag == "--full":
            out.full = True
        elif flag in ("--artist", "--since", "--provider"):
            value = rest.pop(0) if rest else ""
            if flag == "--artist":
                if not value:
                    raise ValueError("--artist requires an internal artist ID")
                out.artist_id = value
            elif flag == "--since":
                try:
                    out.since = dt.datetime.fromisoformat(value).date().isoformat()
                except ValueError:
                    raise ValueError("--since requires a valid ISO date") from None
            elif value not in PROVIDERS:
                raise ValueError(f"--provider must be one of: {', '.join(PROVIDERS)}")
            else:
                out.provider = value
        else:
            raise ValueError(f"Unknown argument: {flag}")
    return out


def configured(environment: Mapping[str, str]) -> dict[str, bool]:
    """Sources that are not switched off and have all they need."""
    out = {}
    for name, keys in REQUIRED.items():
        flag = environment.get(f"{name.upper()}_ENABLED", "true")
        if flag not in ("true", "false"):
            raise ValueError(f"{name.upper()}_ENABLED must be true or false")
        out[name] = flag == "true" and all(environment.get(k) for k in keys)
    return out


def backfill_days(environment: Mapping[str, str], default: int = 60) -> int:
    days = int(environment.get("INITIAL_BACKFILL_DAYS") or default)
    if not 1 <= days <= 3650:
        raise ValueError("INITIAL_BACKFILL_DAYS must be from 1 to 3650")
    return days


def select_sources(requested: str | None, environment: Mapping[str, str]) -> list[str]:
    """The requested source, else every configured one, else the fixture."""
    if requested is not None:
        if requested not in AVAILABLE:
            raise ValueError(f"Provider {requested} is excluded from the current milestone")
        return [requested]
    return [name for name, ok in configured(environment).items() if ok] or ["mock"]


class NotAvailable:
    """A source that is known by its interface only."""

    def __init__(self, name: str):
        self.name = name

    def __call__(self, *_: object) -> None:
        raise NotImplementedError(f"{self.name} has no source yet")
