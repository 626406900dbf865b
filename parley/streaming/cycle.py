"""A poll cycle over several sources, imports in batches within a time budget, and restarts of those that end early or fail."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import iso_text
from ..operators.imports import api_rows, candidates, import_stats
from ..operators.summaries import SHOWN_TITLES, change_notes
from ..sources.snapshots import SnapshotTable
from .ingest import BOOTSTRAP_DAYS, INTERVAL_SECONDS, OVERLAP_MINUTES, STATE, advance, bounds, merge_batch
from .notices import push_changes
from .worklist import WorkList

log = logging.getLogger(__name__)
COUNTS = ("inserted", "updated", "unchanged", "failed", "retries", "superseded")
BATCH_ROWS = 10
DONE, STOPPED_EARLY, OUT_OF_TIME, GAVE_UP = "done", "stopped early", "out of time", "gave up"


@dataclass(frozen=True)
class Source:
    """listing(after, as ISO text) gives rows (pos, id, title, model, created_at, updated_at); details(rows) gives (id, raw_json, attempts) of each id, null where it could not be fetched."""

    name: str
    listing: Callable[[str | None], DataFrame]
    details: Callable[[DataFrame], DataFrame]


@dataclass
class Stats:
    """What an import did: counts, the first titles of what is new or changed, whether the time budget ended it."""

    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTS, 0))
    inserted_titles: list[str] = field(default_factory=list)
    updated_titles: list[str] = field(default_factory=list)
    stopped_early: bool = False


def state_table(spark: SparkSession, folder: str) -> SnapshotTable:
    """The table of watermarks, one row a source."""
    from pyspark.sql.types import StructType

    return SnapshotTable(spark, folder, StructType.fromDDL(STATE), ("source",), 1)


def run_import(table: SnapshotTable, chosen: DataFrame, source: Source, batch_rows: int = BATCH_ROWS, budget_seconds: float | None = None, clock: Callable[[], float] = time.monotonic, on_batch: Callable[[Stats], object] | None = None) -> Stats:
    """Fetches, merges and commits the chosen rows of a listing in batches, each a commit of its own, until none is left or the budget, which is looked at before every batch, is used up.

    The listing is evaluated once: it becomes a work list beside the table, and batches claim from that. Details are written down before they are merged, so each
    is fetched once. What is committed stays; a run after one that ended early leaves out what that has done at the same listed time."""
    spark, stats, began = table.spark, Stats(), clock()
    work = WorkList(spark, f"{table.folder}/_work/{source.name}")
    work.begin(chosen)
    while True:
        if budget_seconds is not None and clock() - began >= budget_seconds:
            stats.stopped_early = bool(work.pending().limit(1).count())
            break
        batch = work.claim(batch_rows)
        if batch is None:
            break
        details = work.fetched(source.details(batch))
        rows = api_rows(batch, details, source.name).persist()
        try:
            outcomes, gone = merge_batch(table, rows, "pos")
            found = import_stats(outcomes, gone, batch, details).first()
        finally:
            rows.unpersist()
        work.settle(batch, spark.createDataFrame([(i,) for i in found["failed_ids"]], "id string"))
        own = Stats({c: found[c] or 0 for c in COUNTS}, found["inserted_titles"], found["updated_titles"])
        if on_batch:
            on_batch(own)
        for c in COUNTS:
            stats.counts[c] += own.counts[c]
        for kept, new in ((stats.inserted_titles, own.inserted_titles), (stats.updated_titles, own.updated_titles)):
            kept += new[: SHOWN_TITLES - len(kept)]
    return stats


def send_notes(spark: SparkSession, send: Callable[[str, str], None] | None, source: str, stats: Stats) -> int:
    """Sends what a run did, a notice for each kind of change; returns how many were sent."""
    kinds = [(source, verb, stats.counts[kind], titles) for verb, kind, titles in (("new", "inserted", stats.inserted_titles), ("updated", "updated", stats.updated_titles))]
    return push_changes(send, change_notes(spark.createDataFrame(kinds, "source string, verb string, n int, titles array<string>"), total="n"))


def poll_cycle(table: SnapshotTable, state: SnapshotTable, sources: list[Source], now: Column | None = None, send: Callable[[str, str], None] | None = None, overlap_minutes: int = OVERLAP_MINUTES, bootstrap_days: int = BOOTSTRAP_DAYS, limit: int = 0, **batches) -> dict[str, Stats | str]:
    """One cycle: for each source its bound, its listing from there on, the import, the notices; then the new state in one step. Returns each source's stats, or its error.

    A source whose listing fails sits the cycle out and keeps its error; one with failed items keeps its bound, so that the next cycle tries the same window again."""
    spark = table.spark
    started = now if now is not None else F.lit(spark.range(1).select(F.current_timestamp()).first()[0])
    names = spark.createDataFrame([(s.name,) for s in sources], "source string")
    found = bounds(state.read(), table.counts(), names, started, overlap_minutes, bootstrap_days)
    after = {r.source: r.after for r in found.select("source", iso_text("after").alias("after")).collect()}
    out: dict[str, Stats | str] = {}
    for source in sources:
        try:
            chosen = candidates(source.listing(after[source.name]), source.name, table.read(), after=after[source.name], limit=limit)
            out[source.name] = stats = run_import(table, chosen, source, **batches)
            send_notes(spark, send, source.name, stats)
        except Exception as e:  # whatever a source raises is its error, and the others go on
            log.warning("%s: the cycle failed: %s", source.name, e)
            out[source.name] = str(e) or type(e).__name__
    rows = [(n, None, r) if isinstance(r, str) else (n, r.counts["failed"] + int(r.stopped_early), None) for n, r in out.items()]
    version = state.version()
    state.replace(advance(state.read(), spark.createDataFrame(rows, "source string, failed int, error string"), started), expected=version)
    return out


def poll(cycle: Callable[[], None], interval: float = INTERVAL_SECONDS, cycles: int | None = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> int:
    """Runs ``cycle`` again and again, beginning every ``interval`` seconds, or at once after one that took longer; so many times, or for ever. One that raises is logged, and the next one is run. Returns how many raised."""
    failed = done = 0
    while cycles is None or done < cycles:
        began = clock()
        try:
            cycle()
        except Exception as e:  # the next cycle tries the same window again
            log.warning("the cycle failed: %s", e)
            failed += 1
        done += 1
        if cycles is None or done < cycles:
            sleep(max(0.0, interval - (clock() - began)))
    return failed


def supervise(run: Callable[[float], str], chunk_seconds: float = 900, total_seconds: float = 14_400, cooldown: float = 30, crash_cooldown: float = 120, most_failures: int = 5, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> tuple[str, int]:
    """(how it ended, chunks): runs ``run(budget)`` again until it is done. It may stop early, which clears the count of failures, or raise, and so many failures in a row end it, as does the whole time."""
    deadline, failures, chunks = clock() + total_seconds, 0, 0
    while (left := deadline - clock()) > 0:
        chunks += 1
        try:
            if run(min(chunk_seconds, left)) == DONE:
                return DONE, chunks
            failures, wait = 0, cooldown
        except Exception as e:  # a crash of a chunk is what this is for
            failures, wait = failures + 1, crash_cooldown
            log.warning("chunk %d failed, %d in a row: %s", chunks, failures, e)
            if failures >= most_failures:
                return GAVE_UP, chunks
        sleep(wait)
    return OUT_OF_TIME, chunks
