"""A paged service as a data source that sees filters before it fetches, and as a stream.

`spark.read.format(name).option("keys", "a,b").load().filter("released >= '2030-01-01'")`
asks the service for what is new since that date, as the filter is pushed into the reader
(with `spark.sql.python.filterPushdown.enabled`); filters on the key leave out whole chains.
As a stream each key's offset is the number of its items that were read, so a restarted
query goes on from its checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

from .paged import Fetch, Paging, chain, fetch_page

#: The client for items since a date, or for all.
FetchSince = Callable[[str | None], Fetch]
COLUMNS = "key string, position long, released string, item string"


@dataclass
class Chain(InputPartition):
    """One key's chain, from an item on and up to another in a stream."""

    key: str
    start: int = 0
    end: int | None = None


class DatedReader(DataSourceReader):
    """A batch: a partition for each key that the filters leave."""

    def __init__(self, keys: list[str], fetch_since: FetchSince, paging: Paging, date_of: Callable[[dict], str | None]):
        self.keys, self.fetch_since, self.paging, self.date_of = keys, fetch_since, paging, date_of
        self.since: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take what the service can use; Spark checks all rows once more, as a service may
        answer by day where the filter is finer."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("key",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = [k for k in self.keys if k in wanted]
            if isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("released",):
                self.since = max(self.since or f.value, f.value)
            yield f

    def partitions(self) -> list[Chain]:
        return [Chain(k) for k in dict.fromkeys(self.keys)] or [Chain("", 0, 0)]

    def read(self, partition: Chain) -> Iterator[tuple]:
        if partition.end == 0:
            return
        for at, item in enumerate(chain(self.fetch_since(self.since), partition.key, self.paging)):
            yield partition.key, at, self.date_of(item), json.dumps(item)


class DatedStream(DataSourceStreamReader):
    """A stream: what came since the last batch, a partition for each key that has news."""

    def __init__(self, keys: list[str], fetch: Fetch, paging: Paging, date_of: Callable[[dict], str | None], count: Callable[[str], int]):
        self.keys, self.fetch, self.paging, self.date_of, self.count = keys, fetch, paging, date_of, count

    def initialOffset(self) -> dict:
        return {k: 0 for k in self.keys}

    def latestOffset(self) -> dict:
        return {k: self.count(k) for k in self.keys}

    def partitions(self, start: dict, end: dict) -> list[Chain]:
        return [Chain(k, start.get(k, 0), n) for k, n in end.items() if n > start.get(k, 0)]

    def read(self, partition: Chain) -> Iterator[tuple]:
        at = partition.start
        while at < partition.end:
            items = fetch_page(self.fetch, partition.key, at, self.paging).get(self.paging.items) or []
            if not items:
                raise EOFError(f"{partition.key} has {at} items of {partition.end} that it told of")
            for item in items[: partition.end - at]:
                yield partition.key, at, self.date_of(item), json.dumps(item)
                at += 1


def dated_source(short_name: str, fetch_since: FetchSince, paging: Paging, date_of: Callable[[dict], str | None], count: Callable[[str], int] | None = None) -> type[DataSource]:
    """A data source to register.  `date_of` gives an item's date; `count`, which a stream
    needs, tells how many items a key has by now, and paging is by offset there."""

    class Dated(DataSource):
        @classmethod
        def name(cls) -> str:
            return short_name

        def schema(self) -> str:
            return COLUMNS

        def _keys(self) -> list[str]:
            return [k for k in self.options.get("keys", "").split(",") if k]

        def reader(self, schema) -> DataSourceReader:
            return DatedReader(self._keys(), fetch_since, paging, date_of)

        def streamReader(self, schema) -> DataSourceStreamReader:
            if count is None or paging.style == "cursor":
                raise ValueError("a stream needs counts and paging by offset")
            return DatedStream(self._keys(), fetch_since(self.options.get("since")), paging, date_of, count)

    return Dated
