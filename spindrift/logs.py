"""Structured log lines: one JSON object for each event, with sensitive fields replaced.

Events are written by the driver, a few for each source of a run; tasks write none, so a
retried task says nothing twice.
"""

from __future__ import annotations

import datetime as dt
import json
import logging
import sys
from typing import TextIO

from .functions.hashing import redacted_json

LEVELS = {"info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR}
_NAMES = {number: name for name, number in LEVELS.items()}


def event(log: logging.Logger, level: str, name: str, **fields: object) -> None:
    """Log an event with its fields; what JSON has no form for is shown as text."""
    log.log(LEVELS[level], name, extra={"fields": fields})


class JsonLine(logging.Formatter):
    """timestamp, level and event, then the fields of `event`, redacted at any depth."""

    def format(self, record: logging.LogRecord) -> str:
        at = dt.datetime.fromtimestamp(record.created, dt.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        head = {"timestamp": at, "level": _NAMES.get(record.levelno, record.levelname.lower()), "event": record.getMessage()}
        fields = json.loads(redacted_json(json.dumps(getattr(record, "fields", {}), default=str)))
        return json.dumps(head | fields, ensure_ascii=False, separators=(",", ":"))


def log_to(out: TextIO | None = None, errors: TextIO | None = None, name: str = "spindrift") -> logging.Logger:
    """Send this library's events as JSON lines to `out`, errors to `errors` instead."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    log.propagate = False
    for handler in log.handlers[:]:
        log.removeHandler(handler)
    for stream, wanted in ((out or sys.stdout, lambda r: r.levelno < logging.ERROR), (errors or sys.stderr, lambda r: r.levelno >= logging.ERROR)):
        handler = logging.StreamHandler(stream)
        handler.setFormatter(JsonLine())
        handler.addFilter(wanted)
        log.addHandler(handler)
    return log
