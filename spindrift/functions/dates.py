"""Partial dates, upcoming flags and display forms.  Whatever depends on time takes `now`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_YEAR, _MONTH, _DAY = r"^\d{4}$", r"^\d{4}-\d{2}$", r"^\d{4}-\d{2}-\d{2}$"


def padded_date(text: Column) -> Column:
    """A year or month as the text of its first day; any other text as it is."""
    return F.when(text.rlike(_YEAR), F.concat(text, F.lit("-01-01"))).when(text.rlike(_MONTH), F.concat(text, F.lit("-01"))).otherwise(text)


def date_precision(text: Column) -> Column:
    """day, month or year; null for a text that is no partial date."""
    return F.when(text.rlike(_YEAR), F.lit("year")).when(text.rlike(_MONTH), F.lit("month")).when(text.rlike(_DAY), F.lit("day"))


def partial_date(text: Column) -> Column:
    """(date text, precision) of yyyy, yyyy-MM or yyyy-MM-dd, else null.  The calendar is
    not checked: `to_date` on the result is the caller's choice."""
    return F.when(date_precision(text).isNotNull(), F.struct(padded_date(text).alias("date"), date_precision(text).alias("precision")))


def is_upcoming(date: Column, now: Column) -> Column:
    """Whether the day's midnight lies strictly after `now`."""
    return F.coalesce(F.try_to_timestamp(date.cast("string")).cast("timestamp_ntz") > now.cast("timestamp_ntz"), F.lit(False))


def default_since(today: Column, backfill_days: int = 60) -> Column:
    return F.date_sub(today, backfill_days)


def display_date(iso: Column) -> Column:
    """MM/DD/YYYY of yyyy-MM-dd."""
    part = lambda k: F.get(F.split(iso, "-"), F.lit(k))
    return F.concat_ws("/", part(1), part(2), part(0))


def display_instant(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, h:mm a")


def iso_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def retry_delay(attempt: Column, jitter: Column, base_ms: int = 250, max_ms: int = 4000, retry_after_ms: Column | None = None) -> Column:
    """Exponential back-off with half to full jitter; a server's own wait goes first."""
    own = F.floor(F.least(F.lit(float(max_ms)), base_ms * F.pow(F.lit(2.0), attempt - 1)) * (0.5 + jitter / 2))
    return own if retry_after_ms is None else F.coalesce(retry_after_ms, own)
