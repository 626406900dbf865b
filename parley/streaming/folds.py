"""Stateful folds of event streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FOLD = "key string, text string, limit string, events long, ended boolean"
#: State as lists and values of their own is kept by this store only.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def parse_events(lines: DataFrame, key: str = "key", order: str = "seq", line: str = "value") -> DataFrame:
    """(key, seq, replaces, text, limit, ended) of 'data: {...}' lines and of the end mark, which has ended set and no text; other lines and bad JSON are left out."""
    body = F.regexp_extract(line, r"^data:\s*(.*)$", 1)
    event = F.from_json(body, "type string, delta struct<type:string,text:string>, completion string, message_limit string")
    e = lines.where(F.startswith(line, F.lit("data:"))).select(F.col(key).cast("string").alias("key"), F.col(order).alias("seq"), event.alias("e"), (body == "[DONE]").alias("ended"))
    appended = F.when((F.col("e.type") == "content_block_delta") & (F.col("e.delta.type") == "text_delta"), F.col("e.delta.text"))
    kept = e.select("key", "seq", F.col("e.completion").isNotNull().alias("replaces"), F.coalesce("e.completion", appended).alias("text"), F.when(F.col("e.type") == "message_limit", F.coalesce("e.message_limit", F.lit("message_limit"))).alias("limit"), "ended")
    return kept.where(F.col("text").isNotNull() | F.col("limit").isNotNull() | F.col("ended"))


class Fold(StatefulProcessor):
    """Keeps the pieces of each key's text as a list, to which a batch is appended without reading it; they are put together when the text is due: at its end mark, after an idle time, or, if asked for, after every batch.

    Pieces are ordered by seq when they are put together, so they may come in any order. Those before the last one that replaces all before it don't count; a
    batch that has such a piece shortens the list."""

    def __init__(self, every_batch: bool, idle_seconds: float | None):
        self.every_batch, self.idle_ms = every_batch, None if idle_seconds is None else int(idle_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "seq long, text string")
        self.about = handle.getValueState("about", "limit string, limit_seq long, events long, floor long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(rows).sort_values("seq", kind="stable")
        limit, limit_seq, events, floor = self.about.get() if self.about.exists() else (None, None, 0, None)
        ended = bool(new["ended"].any())
        for r in new[new["limit"].notna()].itertuples():
            if limit_seq is None or r.seq >= limit_seq:
                limit, limit_seq = r.limit, int(r.seq)
        texts = new[new["text"].notna()]
        replacing = texts[texts["replaces"]]
        if len(replacing) and (floor is None or replacing["seq"].iloc[-1] > floor):
            floor = int(replacing["seq"].iloc[-1])
            held = [(int(s), t) for s, t in self.pieces.get() if s >= floor] if self.pieces.exists() else []
            self.pieces.clear()
            if held:
                self.pieces.put(held)
        kept = texts if floor is None else texts[(texts["seq"] > floor) | texts["replaces"] & (texts["seq"] == floor)]
        if len(kept):
            self.pieces.appendList([(int(r.seq), r.text) for r in kept.itertuples()])
        self.about.update((limit, limit_seq, events + int((~new["ended"]).sum()), floor))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if ended or self.every_batch:
            yield self.whole(key, ended)
        if ended:
            self.clear()
        elif self.idle_ms is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.whole(key, False)

    def whole(self, key, ended: bool) -> pd.DataFrame:
        limit, _, events, _ = self.about.get()
        pieces = sorted(self.pieces.get(), key=lambda p: p[0]) if self.pieces.exists() else []
        return pd.DataFrame([(key[0], "".join(t for _, t in pieces), limit, events, ended)], columns=["key", "text", "limit", "events", "ended"])

    def clear(self) -> None:
        self.pieces.clear()
        self.about.clear()

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, every_batch: bool = False, idle_seconds: float | None = None) -> DataFrame:
    """(key, text, limit, events, ended) of parsed events, when ``Fold`` says: the text of each key so far, appended to or replaced. After its end mark a key begins anew. With an idle time a key's text also comes once that has passed without a piece; such a query runs until it is stopped, as it waits for timers. Sets the session's state store to the one that can hold lists."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return events.groupBy("key").transformWithStateInPandas(Fold(every_batch, idle_seconds), FOLD, "append", "None" if idle_seconds is None else "ProcessingTime")


def completions(results: DataFrame, column: str = "result") -> DataFrame:
    """``results`` with text and message_limit of a completion that may come as JSON text or as a struct already; text that isn't JSON gives nulls."""
    if dict(results.dtypes)[column] == "string":
        results = results.withColumn(column, F.from_json(column, "text string, messageLimit string"))
    return results.select("*", F.col(f"{column}.text").alias("text"), F.col(f"{column}.messageLimit").alias("message_limit"))


def dumps(event: dict) -> str:
    """An event as a stream line."""
    return "data: " + json.dumps(event)
