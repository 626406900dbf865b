"""A paged listing as a data source: pages newest first, with an early stop by time.

The pages come from a function ``fetch(offset, limit) -> (rows, has_more)``; has_more may be None where the listing doesn't say, and a short page then ends it.
The function is given by name (module:function), so that executors find it."""

from __future__ import annotations

import importlib
import json
import os
import sys
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.times import parse_timestamp
from ..operators.filters import between_or_null

FORMAT = "paged_listing"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
ROW = "id string, title string, model string, created_at string, updated_at string"
TRIES, WAIT = 4, 10.0


def moment(value) -> datetime | None:
    """A listed time, ISO text or epoch seconds, in UTC where it names no zone; None for none and for what can't be read."""
    try:
        if isinstance(value, (int, float)) or str(value).replace(".", "", 1).isdigit():
            return datetime.fromtimestamp(float(value), UTC)
        found = datetime.fromisoformat(str(value))
    except (ValueError, OverflowError, OSError):
        return None
    return found if found.tzinfo else found.replace(tzinfo=UTC)


class EmptyListing(RuntimeError):
    """The first page stayed empty: a failed listing, not an empty one."""


def walk_pages(fetch, after: str | None = None, size: int = 100, most: int | None = None, retry_empty: bool = False, wait: float = WAIT, sleep=time.sleep) -> Iterator[dict]:
    """Rows page by page. Ends after the first page whose last row is before ``after`` (times are compared, not their texts; that page is kept whole; a last row without time goes on), after
    ``most`` rows, at has_more false or a short page. An empty page is tried again where retry_empty is set: at the start it then raises, later it ends the listing."""
    offset, given = 0, 0
    bound = moment(after) if after is not None else None
    if after is not None and bound is None:
        raise ValueError(f"not a date: {after}")
    while most is None or given < most:
        rows, more = fetch(offset, size)
        if not rows and retry_empty:
            for attempt in range(1, TRIES):
                sleep(wait * attempt)
                rows, more = fetch(offset, size)
                if rows:
                    break
            if not rows and offset == 0:
                raise EmptyListing("the first page is empty")
        for row in rows:
            if most is not None and given >= most:
                return
            given += 1
            yield row
        last = moment(rows[-1].get("updated_at")) if rows else None
        if not rows or more is False or more is None and len(rows) < size or bound and last and last < bound:
            return
        offset += len(rows)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [InputPartition(0)]  # an early stop needs the pages in order

    def read(self, partition):
        o = self.options
        for r in walk_pages(_pages(o), o.get("after"), int(o.get("size", 100)), int(o["most"]) if o.get("most") else None, o.get("retryempty", "false") == "true", float(o.get("wait", WAIT))):
            yield _cells(r)


def function(text: str):
    """The function named by module:name or module:name?argument; that argument it gets first."""
    name, _, argument = text.partition("?")
    module, _, name = name.partition(":")
    found = getattr(importlib.import_module(module), name)
    return partial(found, argument) if argument else found


def _pages(options: dict):
    if options.get("root") and options["root"] not in sys.path:  # workers of data sources don't get the session's path
        sys.path.append(options["root"])
    return function(options["fetch"])


def _cells(row: dict) -> tuple:
    return tuple(None if row.get(k) is None else str(row[k]) for k in ("id", "title", "model", "created_at", "updated_at"))


def timed(rows: Iterator[dict]) -> Iterator[tuple[float | None, dict]]:
    """(time in seconds, row) of a listing, newest first. A row without a time that can be read has that of the row before it; None before the first that has one."""
    last = None
    for row in rows:
        at = moment(row.get("updated_at"))
        last = at.timestamp() if at else last
        yield last, row


@dataclass
class Span(InputPartition):
    start: dict
    end: dict


class PagedStream(DataSourceStreamReader):
    """The listing as a stream of what is new or changed since the last batch. An offset is the newest time of the listing and the ids that have it, so rows of that same time that come later are told from those that were read.

    A batch is read by one task, from the top of the listing down to the start of its span: what came after the end of the span is left to the next batch. Rows
    that were read are read again only if their time has moved on; rows without a time also if that of the row before them has, so they come at least once."""

    def __init__(self, options: dict):
        self.options = options

    def _walk(self, after: float | None) -> Iterator[tuple[float | None, dict]]:
        o = self.options
        bound = None if after is None else datetime.fromtimestamp(after, UTC).isoformat()
        return timed(walk_pages(_pages(o), bound, int(o.get("size", 100)), None, o.get("retryempty", "false") == "true", float(o.get("wait", WAIT))))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"newest": None, "ids": []}

    def latestOffset(self) -> dict:  # noqa: N802
        newest, ids = None, []
        for at, row in self._walk(None):
            if at is None:
                continue
            if newest is not None and at < newest:
                break
            newest = at
            ids.append(str(row.get("id")))
        return {"newest": newest, "ids": sorted(ids)}

    def partitions(self, start: dict, end: dict):
        return [Span(start, end)] if start != end else []

    def read(self, partition: Span) -> Iterator[tuple]:
        start, end = partition.start, partition.end
        for at, row in self._walk(start["newest"]):
            name = str(row.get("id"))
            place = end["newest"] if at is None else at
            if place is None or place > end["newest"] or place == end["newest"] and at is not None and name not in end["ids"]:
                continue
            if start["newest"] is not None and (place < start["newest"] or place == start["newest"] and name in start["ids"]):
                continue
            yield _cells(row)

    def commit(self, end: dict) -> None:
        pass


class PagedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return PagedStream(dict(self.options))


def read_listing(spark: SparkSession, fetch: str, after: str | None = None, **options) -> DataFrame:
    """A listing as a DataFrame; the reader stops early by the bound, and rows before it are left out. Rows without a time that can be read stay."""
    spark.dataSource.register(PagedListing)
    reader = spark.read.format(FORMAT).option("fetch", fetch).option("root", ROOT).options(**{k: str(v) for k, v in options.items()})
    if after is None:
        return reader.load()
    return reader.option("after", after).load().where(between_or_null(parse_timestamp("updated_at"), after))


def stream_listing(spark: SparkSession, fetch: str, **options) -> DataFrame:
    """A listing as a stream; the offsets in the query's checkpoint say over restarts what was read."""
    spark.dataSource.register(PagedListing)
    return spark.readStream.format(FORMAT).option("fetch", fetch).option("root", ROOT).options(**{k: str(v) for k, v in options.items()}).load()


def fetch_details(ids: DataFrame, fetch: str, id_col: str = "id", wait: float = WAIT) -> DataFrame:
    """(id, raw_json, attempts, error) of each id: one request each, tried up to four times with waits of once, twice, three times ``wait`` seconds, spread over the executors."""

    def run(batches):
        import pandas as pd

        get = function(fetch)
        for pdf in batches:
            rows = []
            for i in pdf[id_col]:
                raw, error, n = None, None, 0
                for n in range(1, TRIES + 1):
                    try:
                        found = get(i)
                        raw, error = found if isinstance(found, str) else json.dumps(found, ensure_ascii=False), None
                        break
                    except Exception as e:  # whatever a request raises is the row's error
                        error = str(e)
                        if n < TRIES:
                            time.sleep(wait * n)
                rows.append((i, raw, n, error))
            yield pd.DataFrame(rows, columns=["id", "raw_json", "attempts", "error"])

    return ids.select(id_col).mapInPandas(run, "id string, raw_json string, attempts int, error string")
