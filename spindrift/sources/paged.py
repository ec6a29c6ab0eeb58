"""Paged services as distributed sources.

A page chain is sequential, so it is the unit of work: one chain for each key (an artist, an
album, a query), and keys are spread over tasks.  The client is given as a function, which
tests replace by canned answers.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: (key, position) to a page; the position is an offset or a cursor, None for the first page.
Fetch = Callable[[str, object], dict]


class Transient(Exception):
    """A failure worth another attempt; `after_ms` is the service's own wish."""

    def __init__(self, message: str, after_ms: int | None = None):
        super().__init__(message)
        self.after_ms = after_ms


@dataclass(frozen=True)
class Paging:
    """How a service pages: by cursor (`after`), or by offset until `next` is missing, or by
    offset until the total is reached."""

    style: str  # cursor | next | total
    items: str = "items"
    attempts: int = 3
    base_ms: int = 250
    max_ms: int = 4000


def fetch_page(fetch: Fetch, key: str, position: object, paging: Paging, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = lambda: 0.5) -> dict:
    """One page, tried again after transient failures with growing waits."""
    for attempt in range(1, paging.attempts + 1):
        try:
            return fetch(key, position)
        except Transient as e:
            if attempt == paging.attempts:
                raise
            own = min(paging.max_ms, paging.base_ms * 2 ** (attempt - 1)) * (0.5 + jitter() / 2)
            sleep((e.after_ms if e.after_ms is not None else int(own)) / 1000)
    raise AssertionError


def chain(fetch: Fetch, key: str, paging: Paging, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Items of one key's pages in order."""
    position: object = None if paging.style == "cursor" else 0
    while True:
        page = fetch_page(fetch, key, position, paging, sleep)
        items = page.get(paging.items) or []
        yield from items
        if paging.style == "cursor":
            position = (page.get("cursors") or {}).get("after")
            if not position or not page.get("next"):
                return
        else:
            position += len(items)  # by what came, not by what was asked for
            if not items or (paging.style == "next" and not page.get("next")) or (paging.style == "total" and position >= page.get("total", 0)):
                return


#: Columns of metered rows: calls, those that failed for a while, and the time waited for them.
METER = {"requests": "long", "failures": "long", "wait_ms": "long"}


class Calls:
    """Calls of one task since they were last taken."""

    def __init__(self, fetch: Callable):
        self.fetch, self.counts = fetch, dict.fromkeys(METER, 0)

    def __call__(self, *args: object) -> dict | None:
        self.counts["requests"] += 1
        try:
            return self.fetch(*args)
        except Transient:
            self.counts["failures"] += 1
            raise

    def sleep(self, seconds: float) -> None:
        self.counts["wait_ms"] += round(seconds * 1000)
        time.sleep(seconds)

    def taken(self) -> dict[str, int]:
        out, self.counts = self.counts, dict.fromkeys(METER, 0)
        return out


def _metered(rows: dict[str, list], calls: Calls) -> pd.DataFrame:
    """`rows` with the calls since the last ones, all on the first row."""
    n = len(next(iter(rows.values())))
    return pd.DataFrame(rows | {c: [v] + [0] * (n - 1) for c, v in calls.taken().items()})


def observed(rows: DataFrame, name: str = "calls") -> tuple[DataFrame, Observation]:
    """Metered rows without their counters, and the sums of these once an action has run.

    Counters are columns, not accumulators, so the rows of a task and its counts go the same
    way: an attempt that failed gives neither.  Only if a finished shuffle stage is computed
    again, after its executor was lost, can an observation see a row twice; where counts must
    hold then too, write the metered rows first and sum what was written.
    """
    seen = Observation(name)
    counted = rows.observe(seen, *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in METER))
    return counted.filter("item IS NOT NULL").drop(*METER), seen


def counts_of(seen: Observation, seconds: float = 30) -> dict[str, int]:
    """What was observed; nothing where no action has read the rows, as an observation would
    be waited for without end."""
    out: dict[str, int] = {}
    waiting = threading.Thread(target=lambda: out.update(seen.get), daemon=True)
    waiting.start()
    waiting.join(seconds)
    return dict(out)


def fetched(keys: DataFrame, key: str, fetch: Fetch, paging: Paging, width: int | None = None, metered: bool = False) -> DataFrame:
    """(key, position, item) of all pages of distinct keys, items as JSON.

    Keys are made distinct first, so no chain is fetched twice; `width` bounds how many
    chains run at once.  Rows are sent on as they come: no chain is held in memory.  Metered
    rows have the columns of `METER` as well; calls after the last item of a key, or of a
    key without items, stand on a row without position and item (see `observed`).
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = Calls(fetch)
        for rows in batches:
            for k in rows[key]:
                held: list[str] = []
                at = 0
                block = lambda: {key: [k] * len(held), "position": list(range(at, at + len(held))), "item": held}  # noqa: B023, E731
                for item in chain(calls, k, paging, calls.sleep):
                    held.append(json.dumps(item))
                    if len(held) == 500:
                        yield _metered(block(), calls) if metered else pd.DataFrame(block())
                        at, held = at + len(held), []
                if held:
                    yield _metered(block(), calls) if metered else pd.DataFrame(block())
                if metered and calls.counts["requests"]:
                    yield _metered({key: [k], "position": [None], "item": [None]}, calls)

    distinct = keys.select(key).dropna().distinct()
    schema = f"{key} string, position long, item string" + "".join(f", {c} {t}" for c, t in METER.items() if metered)
    return (distinct.repartition(width, key) if width else distinct).mapInPandas(read, schema)


def looked_up(keys: DataFrame, key: str, get: Callable[[str], dict | None], width: int | None = 16, metered: bool = False) -> DataFrame:
    """(key, item) of one record each; keys that the service does not know are left out, but
    where metered have a row without item.  At most `width` records are asked for at once."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls = Calls(get)
        for rows in batches:
            found = [(k, None if item is None else json.dumps(item)) for k in rows[key] if (item := calls(k)) is not None or metered]
            if metered and found:
                yield _metered({key: [k for k, _ in found], "item": [item for _, item in found]}, calls)
            elif not metered:
                yield pd.DataFrame(found, columns=[key, "item"])

    distinct = keys.select(key).dropna().distinct()
    schema = f"{key} string, item string" + "".join(f", {c} {t}" for c, t in METER.items() if metered)
    return (distinct.repartition(width, key) if width else distinct).mapInPandas(read, schema)


@dataclass
class _Key(InputPartition):
    value: str


class _Reader(DataSourceReader):
    def __init__(self, keys: list[str], fetch: Fetch, paging: Paging):
        self.keys, self.fetch, self.paging = keys, fetch, paging

    def partitions(self) -> list[_Key]:
        return [_Key(k) for k in self.keys]

    def read(self, partition: _Key) -> Iterator[tuple]:
        for at, item in enumerate(chain(self.fetch, partition.value, self.paging)):
            yield partition.value, at, json.dumps(item)


def paged_source(short_name: str, fetch: Fetch, paging: Paging) -> type[DataSource]:
    """A data source to register: `spark.read.format(short_name).option("keys", "a,b").load()`
    gives (key, position, item), a partition for each key."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return short_name

        def schema(self) -> str:
            return "key string, position long, item string"

        def reader(self, schema) -> DataSourceReader:
            return _Reader([k for k in self.options.get("keys", "").split(",") if k], fetch, paging)

    return Paged
