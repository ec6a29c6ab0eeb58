"""Stateful gates: serial spacing, counters over windows that events open, and leases.

Each gate is a small state machine for a key.  As a stream it runs in
`applyInPandasWithState`; over a table of past events the same step function is replayed,
or a closed form takes its place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.keyed import numbered


def rate_gate(events: DataFrame, at: Column, order: list[Column | str], interval_us: int, by: list[str] | None = None) -> DataFrame:
    """`events` with `start_us`, the instant at which a serial gate lets each one through:
    not before it arrives, nor less than the interval after the one before.

    The recurrence start(i) = max(arrival(i), start(i-1) + d) equals the running maximum of
    arrival(j) - j d, plus i d.  Within keys that is one window.  Over the whole table the
    maxima of range partitions are combined, of which there are few, so no task sorts all.
    """
    placed = numbered(events.withColumn("_at", at), order, "_i", by).withColumn("_lag", F.col("_at") - F.col("_i") * interval_us)
    if by is not None:
        w = Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        return placed.withColumn("start_us", F.max("_lag").over(w) + F.col("_i") * interval_us).drop("_at", "_i", "_lag")
    # Positions are dense, so blocks of positions cut the table evenly.
    size = 1 << 16
    blocked = placed.withColumn("_block", F.floor(F.col("_i") / size).cast("long"))
    tops = blocked.groupBy("_block").agg(F.max("_lag").alias("_top"))
    earlier = tops.select("_block", F.max("_top").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.max("_lag").over(Window.partitionBy("_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    out = blocked.withColumn("_own", own).join(earlier, "_block")
    return out.withColumn("start_us", F.greatest("_own", "_before") + F.col("_i") * interval_us).select(*events.columns, "start_us")


class WindowCounter:
    """Allows `limit` events in each window; a window opens at the first event after the last
    one has ended, so windows are not aligned to anything.  State: (end of window, count)."""

    state = T.StructType([T.StructField("until", T.LongType()), T.StructField("n", T.LongType())])

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def __call__(self, state: tuple[int, int] | None, at: int, holder: str) -> tuple[tuple[int, int], bool]:
        until, n = state if state is not None and at < state[0] else (at + self.window_us, 0)
        return (until, n + 1), n < self.limit


class Lease:
    """Grants a lease to the first owner who asks, until it ends; another owner is refused
    while it lasts, and so is the owner: a lease is not extended.  State: (end, owner)."""

    state = T.StructType([T.StructField("until", T.LongType()), T.StructField("owner", T.StringType())])

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def __call__(self, state: tuple[int, str] | None, at: int, holder: str) -> tuple[tuple[int, str], bool]:
        if state is None or at > state[0]:
            return (at + self.ttl_us, holder), True
        return state, False


def replay(events: DataFrame, key: str, at_us: str, order: str, holder: str, step: Callable, name: str = "granted") -> DataFrame:
    """`events` with the gate's answer to each, in (`at_us`, `order`) order within keys.

    Rows come sorted by key and time and the state is one tuple a key, so memory does not
    grow with a key's events: partitions are read batch by batch, never as whole groups.
    """
    schema = T.StructType([*events.schema.fields, T.StructField(name, T.BooleanType())])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state = object(), None
        for rows in batches:
            answers = []
            for k, at, h in zip(rows[key], rows[at_us], rows[holder]):
                if k != own:
                    own, state = k, None
                state, granted = step(state, int(at), str(h))
                answers.append(granted)
            yield rows.assign(**{name: pd.Series(answers, index=rows.index, dtype=bool)})

    return events.repartition(key).sortWithinPartitions(key, at_us, order).mapInPandas(walk, schema)


def gate_stream(events: DataFrame, key: str, at_us: str, order: str, holder: str, step, name: str = "granted") -> DataFrame:
    """The same as a stream: state is kept for each key across micro-batches."""
    out = T.StructType([events.schema[key], events.schema[at_us], events.schema[order], T.StructField(name, T.BooleanType())])

    def update(k: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else None
        rows = pd.concat(groups).sort_values([at_us, order])
        answers = []
        for at, h in zip(rows[at_us], rows[holder]):
            now, granted = step(now, int(at), str(h))
            answers.append(granted)
        state.update(now)
        yield rows[[key, at_us, order]].assign(**{name: answers})

    return events.groupBy(key).applyInPandasWithState(update, out, step.state, "append", GroupStateTimeout.NoTimeout)
