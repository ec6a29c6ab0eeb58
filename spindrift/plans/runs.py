"""Scan runs: source by source, with fault isolation, a lease, counters and history."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..logs import event
from ..operators.keyed import upsert
from ..schemas import struct_of, validated
from ..sources.paged import counts_of
from ..storage import Added, Store, discard, settled
from .resolution import persist

log = logging.getLogger(__name__)


@dataclass
class Options:
    """What to scan.  `now` is given, so that a run can be repeated."""

    now: dt.datetime
    provider: str | None = None
    artist_id: str | None = None
    since: str | None = None
    full: bool = False
    dry_run: bool = False
    backfill_days: int = 60

    def since_date(self) -> str | None:
        if self.full:
            return None
        return self.since or (self.now - dt.timedelta(days=self.backfill_days)).date().isoformat()


@dataclass
class Summary:
    discovered: int = 0
    inserted: int = 0
    skipped: int = 0
    needs_review: int = 0
    dry_run: bool = False
    errors: dict[str, str] = field(default_factory=dict)
    by_provider: dict[str, dict[str, int]] = field(default_factory=dict)


Source = Callable[[SparkSession, Options], DataFrame]


def run_scan(store: Store, sources: dict[str, Source], options: Options) -> Summary:
    """Scan each source, resolve what it gives and publish all tables of a source at once.

    What a source gives is written once and then counted and resolved, so that a service is
    asked once.  A run is in the history as running until it is completed or failed.  A source is
    scanned under a lease, and its `next_cursor`, if it has one, is stored.  What its `calls`,
    an observation of the rows it gives, has counted is logged when the run is complete.  A
    source that fails is recorded and the others go on; the run fails if the requested one
    fails or all do.  A dry run counts and writes nothing.
    """
    spark, out = store.spark, Summary(dry_run=options.dry_run)
    for name, source in sources.items():
        run_id, candidates = f"{name}-{options.now.isoformat()}", None
        try:
            if not options.dry_run:
                store.transact(lambda tables: {"scan_runs": with_run(tables["scan_runs"], run_row(spark, run_id, name, "running", options.now, {}))})  # noqa: B023
            event(log, "info", "scan.started", provider=name, run_id=run_id, dry_run=options.dry_run)
            candidates = settled(validated(source(spark, options)), "candidates")
            discovered = candidates.count()
            counts = {"discovered": discovered, "inserted": 0, "skipped": 0, "needs_review": 0}
            if not options.dry_run:

                def step(tables: dict[str, DataFrame]) -> dict[str, DataFrame | Added]:
                    changed, decided = persist(candidates, tables, run_id)  # noqa: B023
                    n = decided.agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "review").alias("review")).first()
                    counts.update(inserted=n.n, skipped=discovered - n.n, needs_review=n.review)  # noqa: B023
                    changed["scan_runs"] = with_run(tables["scan_runs"], run_row(spark, run_id, name, "completed", options.now, counts))  # noqa: B023
                    cursor = getattr(source, "next_cursor", None)  # noqa: B023
                    if cursor:
                        changed["cursors"] = with_cursor(tables["cursors"], name, cursor)  # noqa: B023
                    return changed

                with store.lease(name, run_id, options.now):
                    store.transact(step)
            calls = getattr(source, "calls", None)
            event(log, "info", "scan.completed", provider=name, run_id=run_id, **counts, **(counts_of(calls) if calls is not None else {}))
            out.by_provider[name] = counts
            for k, v in counts.items():
                setattr(out, k, getattr(out, k) + v)
        except Exception as e:
            event(log, "error" if options.provider == name else "warn", "scan.failed", provider=name, run_id=run_id, kind=type(e).__name__)
            out.errors[name] = str(e).splitlines()[0][:500]
            if not options.dry_run:
                store.transact(lambda tables: {"scan_runs": with_run(tables["scan_runs"], run_row(spark, run_id, name, "failed", options.now, {}, out.errors[name]))})  # noqa: B023
            if options.provider == name:
                raise
        finally:
            discard(candidates)
    if sources and len(out.errors) == len(sources):
        raise RuntimeError("every source failed: " + "; ".join(f"{k}: {v}" for k, v in out.errors.items()))
    return out


def run_row(spark: SparkSession, run_id: str, provider: str, status: str, now: dt.datetime, counts: dict[str, int], error: str | None = None) -> DataFrame:
    schema = struct_of("run_id string, provider string, status string, started_at timestamp, completed_at timestamp, discovered long, inserted long, skipped long, needs_review long, error string")
    return spark.createDataFrame([(run_id, provider, status, now, None if status == "running" else now, *(counts.get(k) for k in ("discovered", "inserted", "skipped", "needs_review")), error)], schema)


def with_run(runs: DataFrame, row: DataFrame) -> DataFrame:
    """The history after a run was added, or changed its state."""
    return runs.join(row.select("run_id"), "run_id", "left_anti").select(*runs.columns).unionByName(row)


def with_cursor(cursors: DataFrame, provider: str, value: str, scope: str = "global", scope_id: str = "default") -> DataFrame:
    """The cursors after the last value of a scope was set."""
    row = cursors.sparkSession.createDataFrame([(provider, scope, scope_id, value, 1)], "provider string, scope string, scope_id string, value string, at int")
    return upsert(cursors, row, ["provider", "scope", "scope_id"], "at", ["value"])


def run_counters(decided: DataFrame, by: list[str]) -> DataFrame:
    """Counters of each source; a total is their sum (see `run_totals`)."""
    return decided.groupBy(*by).agg(F.count("*").alias("discovered"), F.count_if("fresh").alias("inserted"), F.count_if(~F.col("fresh")).alias("skipped"), F.count_if(F.col("fresh") & F.col("review")).alias("needs_review"))


def run_totals(counters: DataFrame) -> DataFrame:
    return counters.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("discovered", "inserted", "skipped", "needs_review")))


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """The last runs as shown in the history."""
    shown = F.concat(F.coalesce("provider", F.lit("all providers")), F.lit(": "), F.col("status"))
    ended = F.coalesce(F.date_format("completed_at", "MMM d, h:mm a"), F.lit("running"))
    return runs.orderBy(F.col("started_at").desc(), "run_id").limit(n).withColumns({"line": shown, "ended": ended})
