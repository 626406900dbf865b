"""Incremental catch-up, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.filters import accepted_updates, next_offset
from ..operators.merge import KEY, merge, split_valid, superseded
from ..sources.snapshots import SnapshotTable
from .notices import BEAT_SECONDS, beating

OVERLAP_MINUTES, BOOTSTRAP_DAYS, INTERVAL_SECONDS = 2, 7, 60
#: Of versions of a conversation in one batch: the last to change, then to be read; the hash settles ties.
NEWEST = ("updated_at", "imported_at", "content_hash")
STATE = "source string, last_success_at timestamp, last_error string"
MESSAGE = "update_id long, chat_id long, text string"


def catchup_bound(last_success: Column, stored_newest: Column, now: Column, overlap_minutes: int = OVERLAP_MINUTES, bootstrap_days: int = BOOTSTRAP_DAYS) -> Column:
    """From when on to read: the last success, but always some minutes back; without one the newest stored time; without that some days back."""
    back = lambda d, h, m: now - F.make_dt_interval(F.lit(d), F.lit(h), F.lit(m))
    return F.coalesce(F.when(last_success.isNotNull(), F.least(last_success, back(0, 0, overlap_minutes))), stored_newest, back(bootstrap_days, 0, 0))


def bounds(state: DataFrame, newest: DataFrame, sources: DataFrame, now: Column, overlap_minutes: int = OVERLAP_MINUTES, bootstrap_days: int = BOOTSTRAP_DAYS) -> DataFrame:
    """(source, after) for each source, independent of the others. newest: (source, newest) of what is stored, as a table's ``counts`` has it without reading rows."""
    known = newest.select("source", F.col("newest").alias("newest_"))
    joined = sources.select("source").join(state.select("source", "last_success_at"), "source", "left").join(known, "source", "left")
    return joined.select("source", catchup_bound(F.col("last_success_at"), F.col("newest_"), now, overlap_minutes, bootstrap_days).alias("after"))


def advance(state: DataFrame, cycle: DataFrame, started: Column) -> DataFrame:
    """The state after a cycle with (source, failed, error): success moves to the cycle's start where nothing failed, and stays where something did; the error
    is the cycle's own. Sources that weren't part of it keep their row."""
    c = cycle.select("source", "failed", "error", F.lit(True).alias("ran_"))
    j = state.join(c, "source", "full_outer")
    clean = F.col("ran_").isNotNull() & (F.coalesce("failed", F.lit(0)) == 0) & F.col("error").isNull()
    return j.select("source", F.when(clean, started).otherwise(F.col("last_success_at")).alias("last_success_at"), F.when(F.col("ran_").isNotNull(), F.col("error")).otherwise(F.col("last_error")).alias("last_error"))


def merge_batch(table: SnapshotTable, batch: DataFrame, order: str | tuple[str, ...] | None = None, properties: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Merges a batch into the table: (outcomes (source, conversation_id, title, outcome), superseded rows). Of rows with one key the last by ``order``, else the newest counts.

    Read and joined are only the buckets of the batch's keys and of rows that it supersedes, which are looked for where the manifest has rebuilt rows; written
    are only those in which something changes. A batch seen before changes nothing, so a repeated one is harmless. A writer that was slower than another fails
    and must begin again."""
    version = table.current()
    good, _ = split_valid(batch)
    keys, rebuilt = good.select(*KEY), table.with_rebuilt(version)
    if rebuilt:
        keys = keys.unionByName(superseded(table.read(rebuilt, version), good).select(*KEY))
    touched = table.touched(keys, version)
    merged, refused, gone = merge(table.read(touched, version), batch, order or NEWEST)
    found = merged.where("outcome <> 'kept'").select(*KEY, "title", "outcome")
    changes = found.where("outcome in ('inserted', 'updated')").select(*KEY).unionByName(gone.select(*KEY))
    changed = table.touched(changes, version)
    if changed or properties:
        table.update(changed, merged.where(table.bucket(version).isin(changed)), version.name, properties)
    return found.unionByName(refused.select(*KEY, "title", F.lit("failed").alias("outcome"))), gone


def start_merge(stream: DataFrame, table: SnapshotTable, checkpoint: str, once: bool = True, seconds: int = INTERVAL_SECONDS, on_batch: Callable[[DataFrame, int], None] | None = None, send: Callable[[str, str], None] | None = None, beat_seconds: float = BEAT_SECONDS) -> StreamingQuery:
    """Merges each micro-batch into the table, with a notice now and then while it is busy. Offsets are committed after the merge, so input is read at least once and takes effect once. No watermark: late conversations are never dropped."""

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            with beating(send, "merging", f"batch {number}", beat_seconds):
                found, _ = merge_batch(table, batch)
            if on_batch:
                on_batch(found, number)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def consume_updates(updates: DataFrame, offset: int, chat_id: int) -> tuple[DataFrame, DataFrame]:
    """Accepted updates from an offset on, and the next offset, which ignored ones move too."""
    return accepted_updates(updates, chat_id, offset), next_offset(updates.where(F.col("update_id") >= offset), offset)


def skip_backlog(updates: DataFrame) -> DataFrame:
    """The offset after everything there is, to start from."""
    return next_offset(updates, 0)


class Inbox:
    """Messages of one chat taken from a feed of updates, each once, over any number of restarts: the offset after a batch is committed in one step with the batch's messages, so neither can be there without the other.

    Without an offset so far it begins after whatever there is, if skip_backlog is set, else at the start."""

    def __init__(self, spark: SparkSession, folder: str, chat_id: int, skip_backlog: bool = True):
        self.chat_id, self.skip = chat_id, skip_backlog
        self.table = SnapshotTable(spark, folder, StructType.fromDDL(MESSAGE), ("update_id",))

    @property
    def offset(self) -> int | None:
        return self.table.properties().get("offset")

    def take(self, updates: DataFrame) -> DataFrame:
        """The new messages (update_id, chat_id, text) of a batch of updates, which may hold ones seen before. Ignored updates move the offset too."""
        version = self.table.current()
        offset = version.properties.get("offset")
        if offset is None and self.skip:
            self.table.update([], updates, version.name, {"offset": skip_backlog(updates).first().offset})
            return self.table.read([], version)
        accepted, after = consume_updates(updates, offset or 0, self.chat_id)
        new = accepted.select("update_id", F.col("message.chat.id").alias("chat_id"), F.col("message.text").alias("text")).dropDuplicates(["update_id"])
        touched = self.table.touched(new, version)
        self.table.update(touched, self.table.read(touched, version).unionByName(new), version.name, {"offset": after.first().offset})
        return self.table.read(touched).where(F.col("update_id") >= (offset or 0))

    def start(self, stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
        """Takes each micro-batch. ``handle`` gets the new messages once they are committed; after a crash before it has ended the same messages aren't given to it again."""

        def step(batch: DataFrame, _: int) -> None:
            batch = batch.persist()
            try:
                found = self.take(batch)
                if handle:
                    handle(found)
            finally:
                batch.unpersist()

        return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
