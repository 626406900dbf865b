"""Paging, snapshots, catch-up, streams, summaries."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_conversations import LIST, stored

from parley.operators import render, summaries
from parley.sources import files, paged
from parley.sources.snapshots import Conflict, RunLock, SnapshotTable
from parley.streaming import folds, ingest, notices

NOW = datetime(2025, 1, 10)


def listing(n=15, more=True, empty_first=0):
    calls = []
    rows = [{"id": str(i), "updated_at": f"2025-01-{30 - i:02d}"} for i in range(n)]

    def fetch(offset, limit):
        calls.append(offset)
        if len(calls) <= empty_first:
            return [], None
        return rows[offset : offset + limit], (offset + limit < n if more else None)

    return fetch, calls


def test_early_stop_keeps_the_whole_page():
    for more, retry in ((True, False), (False, True)):
        fetch, calls = listing(more=more)
        assert len(list(paged.walk_pages(fetch, "2025-01-25", 5, retry_empty=retry, sleep=lambda _: None))) == 10 and len(calls) == 2


@pytest.mark.parametrize("times", [["2024-01-15T00:00:03.500Z", "2024-01-15T00:00:02Z", "2024-01-15T00:00:01.200Z", "2024-01-15T00:00:00Z"], [1705276803.5, 1705276802, "1705276801.2", 1705276800], ["2024-01-15T02:00:03+02:00", "2024-01-15T00:00:02", "2024-01-14T19:00:01-05:00", "2024-01-15T00:00:00+00:00"]])
@pytest.mark.parametrize("size", [1, 2])
def test_listed_times_are_compared_as_times(times, size):
    rows = [{"id": i, "updated_at": t} for i, t in enumerate([*times, None, "2024-01-14T23:59:59.9Z", "2024-01-10"])]
    walk = lambda after: [r["id"] for r in paged.walk_pages(lambda o, n: (rows[o : o + n], o + n < len(rows)), after, size)]
    assert walk("2024-01-15T00:00:00Z") == list(range(6)) and walk("2024-01-15") == list(range(6)) and walk(None) == list(range(7))
    with pytest.raises(ValueError):
        walk("soon")


def test_full_walks():
    fetch, calls = listing()
    assert len(list(paged.walk_pages(fetch, None, 5))) == 15 and len(calls) == 3
    fetch, calls = listing(more=False)
    waits = []
    assert len(list(paged.walk_pages(fetch, None, 5, retry_empty=True, sleep=waits.append))) == 15 and len(calls) == 7 and waits == [10, 20, 30]
    fetch, _ = listing()
    assert len(list(paged.walk_pages(fetch, None, 5, most=7))) == 7


def test_empty_first_page():
    fetch, _ = listing(more=False, empty_first=9)
    with pytest.raises(paged.EmptyListing):
        list(paged.walk_pages(fetch, None, 5, retry_empty=True, sleep=lambda _: None))
    fetch, _ = listing(more=False, empty_first=2)
    assert len(list(paged.walk_pages(fetch, None, 5, retry_empty=True, sleep=lambda _: None))) == 15


def test_details(spark):
    found = {r.id: r for r in paged.fetch_details(spark.createDataFrame([("1",), ("x",)], "id string"), "builtins:int", wait=0).collect()}
    assert found["1"].attempts == 1 and found["1"].error is None and found["x"].attempts == 4 and "invalid literal" in found["x"].error


def test_snapshots(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    assert table.version() is None and table.read().count() == 0
    rows = stored(spark, ("claude", "a", LIST), ("chatgpt", "b", LIST)).withColumn("imported_at", F.current_timestamp())
    first = table.replace(rows)
    assert table.lookup("claude", "a").count() == 1 and table.read().count() == 2
    held = table.read()
    table.replace(rows.limit(0))
    assert held.count() == 2 and table.read().count() == 0
    with pytest.raises(RuntimeError):
        table.replace(rows, expected=first)


def keyed(spark, *ids, **columns):
    return stored(spark, *(("claude", i, LIST, columns) for i in ids)).withColumn("imported_at", F.lit(NOW))


def test_pointers_survive_crashes(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    table.replace(keyed(spark, "a"))
    # A writer that died after it wrote its rows and its manifest, and one that died before its pointer had its name.
    table._written(keyed(spark, "dead"), table.current())
    table._put("m-dead", "")
    table._put("_pointers/.dead", "{")
    assert table.read().count() == 1
    table.replace(keyed(spark, "a", "b"), expected=table.version())
    assert table.read().count() == 2 and sorted(x.name for x in (tmp_path / "t" / "_pointers").iterdir() if x.name.isdigit())[-1] == "000000000002"
    assert table.drop_old() == 1 and table.read().count() == 2
    for f in (tmp_path / "t" / "_pointers").iterdir():
        f.unlink()
    (tmp_path / "t" / "_pointers").rmdir()
    with pytest.raises(RuntimeError):
        table.read()


STEPS = ("current", "_written", "_put", "_publish")


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("after", [False, True])
def test_a_writer_held_up_anywhere(spark, tmp_path, monkeypatch, step, after):
    """Another writer begins and ends while one is stopped before or after each of its steps: never do both succeed from one version, and no rows go without an error."""
    slow, quick = (SnapshotTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    base = slow.replace(keyed(spark, "a"))
    real, ran = getattr(slow, step), []

    def other():
        if not ran:
            ran.append(1)
            quick.replace(keyed(spark, "a", "quick"), expected=quick.version())

    def held(*args):
        if not after:
            other()
        found = real(*args)
        if after:
            other()
        return found

    monkeypatch.setattr(slow, step, held)
    try:
        slow.replace(keyed(spark, "a", "slow"), expected=base)
        won = True
    except Conflict:
        won = False
    rows = {r.conversation_id for r in quick.read().collect()}
    assert rows == {"a", "quick"}
    # The quick one began from the slow one's version only where that was published already.
    assert won == (step == "_publish" and after)
    assert len([x for x in (tmp_path / "t" / "_pointers").iterdir() if not x.name.startswith(".")]) == 2 + won


def test_many_writers_of_one_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    table = SnapshotTable(spark, f"file://{tmp_path}/t", buckets=2)
    base = table.replace(keyed(spark, "a"))

    def write(i):
        try:
            return SnapshotTable(spark, f"file://{tmp_path}/t").replace(keyed(spark, "a", f"w{i}"), expected=base)
        except Conflict:
            return None

    with ThreadPoolExecutor(6) as pool:
        won = [v for v in pool.map(write, range(6)) if v]
    assert won == [table.version()] and table.read().count() == 2


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t", buckets=64)
    table.replace(keyed(spark, *(f"k{i}" for i in range(400)), content_hash="h"))
    before = table.current().buckets
    batch = keyed(spark, *(f"k{i}" for i in range(9)), "new", content_hash="h2")
    ingest.merge_batch(table, batch)
    after = table.current().buckets
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 10 and changed == set(table.touched(batch))
    assert table.read().count() == 401 and table.read().where("content_hash = 'h2'").count() == 10
    # A batch that changes nothing writes nothing, and one of which one row changes one bucket.
    ingest.merge_batch(table, batch)
    assert table.current().buckets == after
    ingest.merge_batch(table, batch.withColumn("content_hash", F.when(F.col("conversation_id") == "new", "h3").otherwise(F.col("content_hash"))))
    assert len([b for b, e in table.current().buckets.items() if e != after[b]]) == 1
    with pytest.raises(ValueError):
        table.update([b for b in range(64) if b not in changed], batch, table.version())
    assert SnapshotTable(spark, f"file://{tmp_path}/t", buckets=3).lookup("claude", "new").first().content_hash == "h3"


def test_counts_come_from_the_manifest(spark, tmp_path, monkeypatch):
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    at = lambda day: {"updated_at": datetime(2025, 1, day), "content_hash": f"h{day}"}
    table.replace(stored(spark, ("claude", "a", LIST, at(2)), ("claude", "b", LIST, at(5)), ("chatgpt", "c", LIST, {"updated_at": None})).withColumn("imported_at", F.lit(NOW)))
    ingest.merge_batch(table, stored(spark, ("claude", "a", LIST, at(7))).withColumn("imported_at", F.lit(NOW)))
    monkeypatch.setattr(table, "read", None)
    assert [(r.source, r.n, r.rebuilt, r.newest) for r in table.counts().collect()] == [("chatgpt", 1, 0, None), ("claude", 2, 0, datetime(2025, 1, 7))]


def test_superseded_rows_of_other_buckets(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t", buckets=32)
    when = {"title": "T", "created_at": NOW}
    old = stored(spark, *(("claude", f"old{i}", {"messages": []}, when | {"raw_source": "markdown_reconstructed", "title": f"T{i}"}) for i in range(20))).withColumn("imported_at", F.lit(NOW))
    table.replace(old)
    assert len(table.with_rebuilt()) > 1
    _, gone = ingest.merge_batch(table, keyed(spark, "new", title="T3", created_at=NOW))
    assert [r.conversation_id for r in gone.collect()] == ["old3"]
    assert {r.conversation_id for r in table.read().collect()} == {"new"} | {f"old{i}" for i in range(20) if i != 3}


def test_beats_while_busy():
    sent = []
    with notices.beating(lambda *x: sent.append(x), "busy", "b", 0.2):
        time.sleep(0.5)
    assert sent == [("busy", "b")] * 2
    with pytest.raises(OSError), notices.beating(lambda *x: sent.append(x), "busy", "b", 0.1):
        raise OSError
    time.sleep(0.3)
    assert len(sent) == 2
    with notices.beating(None, "busy", "b", 0.01):
        time.sleep(0.05)


def test_beats_while_a_batch_runs(spark, tmp_path, monkeypatch):
    rows = keyed(spark, "a")
    rows.write.parquet(f"{tmp_path}/in")
    table, sent = SnapshotTable(spark, f"file://{tmp_path}/t"), []
    slow = ingest.merge_batch
    monkeypatch.setattr(ingest, "merge_batch", lambda *a: time.sleep(0.7) or slow(*a))
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    ingest.start_merge(stream, table, f"{tmp_path}/c", send=lambda title, text: sent.append(text), beat_seconds=0.25).awaitTermination()
    assert len(sent) >= 2 and set(sent) == {"batch 0"} and table.read().count() == 1


UPDATE = "update_id long, message struct<message_id:long,chat:struct<id:long>,text:string>"


def test_an_inbox_over_crashes(spark, tmp_path):
    feed = lambda *ids: spark.createDataFrame([(i, (i, (7 if i % 4 else 8,), f"m{i}")) for i in ids], UPDATE)
    inbox = lambda: ingest.Inbox(spark, f"file://{tmp_path}/inbox", 7)
    assert inbox().offset is None and inbox().take(feed(1, 2)).count() == 0 and inbox().offset == 3
    assert sorted(r.update_id for r in inbox().take(feed(2, 3, 4, 5)).collect()) == [3, 5] and inbox().offset == 6
    # A crash after the commit: the same updates come again, and have no effect. One before it: nothing is there, and they count.
    assert inbox().take(feed(2, 3, 4, 5)).count() == 0 and inbox().offset == 6
    broken = inbox()
    broken.table._publish = lambda *a: 1 / 0
    with pytest.raises(ZeroDivisionError):
        broken.take(feed(6, 7, 7))
    assert inbox().offset == 6 and inbox().table.read().count() == 2
    assert sorted(r.update_id for r in inbox().take(feed(6, 7, 7)).collect()) == [6, 7]
    feed(8, 9).write.parquet(f"{tmp_path}/in")
    got = []
    for k in range(2):  # two readers with offsets of their own: the inbox knows what it has
        stream = spark.readStream.schema(UPDATE).parquet(f"{tmp_path}/in")
        inbox().start(stream, f"{tmp_path}/c{k}", lambda new: got.append(sorted(r.update_id for r in new.collect()))).awaitTermination()
    assert got == [[9], []] and inbox().offset == 10
    whole = ingest.Inbox(spark, f"file://{tmp_path}/whole", 7, skip_backlog=False)
    assert whole.take(feed(1, 4)).count() == 1


def test_one_of_two_writers_wins(spark, tmp_path):
    one, two = (SnapshotTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    rows = stored(spark, ("claude", "a", LIST)).withColumn("imported_at", F.current_timestamp())
    seen = two.version()
    one.replace(rows, expected=one.version())
    with pytest.raises(RuntimeError):
        two.replace(rows.limit(0), expected=seen)
    with pytest.raises(ValueError):
        one.replace(rows.union(rows))
    assert two.read().count() == 1


def test_lock(spark, tmp_path):
    path = f"file://{tmp_path}/lock"
    with RunLock(spark, path):
        with pytest.raises(RuntimeError):
            RunLock(spark, path).__enter__()
    with RunLock(spark, path):
        pass


@pytest.mark.parametrize(("success", "newest", "expected"), [(None, None, NOW - timedelta(days=7)), (None, datetime(2025, 1, 5), datetime(2025, 1, 5)), (NOW - timedelta(seconds=90), None, NOW - timedelta(minutes=2)), (NOW - timedelta(days=3), datetime(2025, 1, 9), NOW - timedelta(days=3))])
def test_catchup(spark, success, newest, expected):
    df = spark.createDataFrame([(success, newest)], "s timestamp, n timestamp")
    assert df.select(ingest.catchup_bound(F.col("s"), F.col("n"), F.lit(NOW)).alias("v")).first().v == expected


def test_advance(spark):
    old = datetime(2025, 1, 1)
    state = spark.createDataFrame([("a", old, "x"), ("b", old, None), ("c", old, "kept"), ("e", old, None)], ingest.STATE)
    cycle = spark.createDataFrame([("a", 0, None), ("b", 2, None), ("d", 0, None), ("e", 0, "down")], "source string, failed int, error string")
    found = {r.source: (r.last_success_at, r.last_error) for r in ingest.advance(state, cycle, F.lit(NOW)).collect()}
    assert found == {"a": (NOW, None), "b": (old, None), "c": (old, "kept"), "d": (NOW, None), "e": (old, "down")}


def test_bounds_by_source(spark):
    state = spark.createDataFrame([("claude", NOW - timedelta(days=1), None)], ingest.STATE)
    sources = spark.createDataFrame([("claude",), ("chatgpt",)], "source string")
    found = {r.source: r.after for r in ingest.bounds(state, spark.createDataFrame([("claude", NOW)], "source string, newest timestamp"), sources, F.lit(NOW)).collect()}
    assert found == {"claude": NOW - timedelta(days=1), "chatgpt": NOW - timedelta(days=7)}


def test_stream_takes_effect_once(spark, tmp_path):
    rows = stored(spark, ("claude", "a", LIST), ("claude", "b", "{}")).withColumn("imported_at", F.current_timestamp())
    rows.write.parquet(f"{tmp_path}/in")
    table, seen = SnapshotTable(spark, f"file://{tmp_path}/t"), []
    for k in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        ingest.start_merge(stream, table, f"{tmp_path}/c{k}", on_batch=lambda found, _: seen.append(sorted((r.conversation_id, r.outcome) for r in found.collect()))).awaitTermination()
    assert table.read().count() == 1
    assert seen == [[("a", "inserted"), ("b", "failed")], [("a", "unchanged"), ("b", "failed")]]


def test_newest_version_in_a_batch_counts(spark, tmp_path):
    at = lambda day: {"updated_at": datetime(2025, 1, day) if day else None, "title": f"t{day}", "content_hash": f"h{day}"}
    rows = stored(spark, ("claude", "a", LIST, at(2)), ("claude", "a", LIST, at(3)), ("claude", "a", LIST, at(0)), ("claude", "b", LIST, at(0))).withColumn("imported_at", F.lit(NOW))
    rows.write.parquet(f"{tmp_path}/in")
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    for k in range(2):
        ingest.start_merge(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), table, f"{tmp_path}/c{k}").awaitTermination()
        assert sorted((r.conversation_id, r.title) for r in table.read().collect()) == [("a", "t3"), ("b", "t0")]


def test_updates(spark):
    u = spark.createDataFrame([(1, (1, (7,), "old")), (5, (2, (7,), "hi")), (6, (3, (8,), "other")), (7, (4, (7,), None))], "update_id long, message struct<message_id:long,chat:struct<id:long>,text:string>")
    got, offset = ingest.consume_updates(u, 2, 7)
    assert [r.update_id for r in got.collect()] == [5] and offset.first().offset == 8
    assert ingest.consume_updates(u, 9, 7)[1].first().offset == 9 and ingest.skip_backlog(u).first().offset == 8


EVENTS = [{"type": "content_block_delta", "delta": {"type": "text_delta", "text": "a"}}, {"type": "content_block_delta", "delta": {"type": "other", "text": "no"}}, {"completion": "B"}, {"type": "message_limit", "message_limit": "few"}, {"type": "content_block_delta", "delta": {"type": "text_delta", "text": "c"}}]


def test_token_stream(spark, tmp_path):
    lines = [("k", i, folds.dumps(e)) for i, e in enumerate(EVENTS)] + [("k", 9, "data: [DONE]"), ("k", 10, "data: {bad"), ("k", 11, "event: x")]
    df = spark.createDataFrame(lines, "key string, seq long, value string")
    parsed = folds.parse_events(df)
    assert summaries.fold_events(parsed.where("text is not null"), "key", "seq", F.col("replaces"), F.col("text")).first().text == "Bc"
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    found = folded(spark, tmp_path, df.schema)
    assert found == [("k", "Bc", "few", 4, True)]


def folded(spark, tmp_path, schema, **options):
    """The rows of a stream over one file a batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = folds.fold_stream(folds.parse_events(stream), **options).writeStream.outputMode("append").format("memory").queryName("folded").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(map(tuple, spark.table("folded").collect()))


def piece(i):
    return {"completion": f"<{i}>"} if i in (400, 700) else {"type": "content_block_delta", "delta": {"type": "text_delta", "text": f"{i},"}}


def test_pieces_in_any_order_over_batches(spark, tmp_path):
    """Equal to the fold of the whole, whichever batch a piece comes in; the end mark last."""
    rng = random.Random(6)
    lines = [(k, i, folds.dumps(piece(i))) for k in "ab" for i in range(1000)]
    rng.shuffle(lines)
    schema = "key string, seq long, value string"
    for n in range(4):
        part = lines[n::4] + ([("a", 1000, "data: [DONE]")] if n == 3 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    df = spark.createDataFrame(lines, schema)
    parsed = folds.parse_events(df)
    whole = {r.key: r.text for r in summaries.fold_events(parsed, "key", "seq", F.col("replaces"), F.col("text")).collect()}
    assert whole["a"] == "<700>" + "".join(f"{i}," for i in range(701, 1000))
    found = folded(spark, tmp_path, df.schema)
    assert found == [("a", whole["a"], None, 1000, True)]  # b has no end yet


def test_running_and_idle_texts(spark, tmp_path):
    schema = "key string, seq long, value string"
    for n in range(2):
        spark.createDataFrame([("k", n, folds.dumps(piece(n)))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    df = spark.createDataFrame([], schema)
    assert sorted(r[1] for r in folded(spark, tmp_path, df.schema, every_batch=True))[-1] == "0,1,"
    q = folds.fold_stream(folds.parse_events(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")), idle_seconds=1).writeStream.outputMode("append").format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/i").trigger(processingTime="1 second").start()
    try:
        until = time.monotonic() + 60
        while time.monotonic() < until and not spark.table("idle").count():
            time.sleep(0.5)
    finally:
        q.stop()
    assert [tuple(r)[1:] for r in spark.table("idle").collect()] == [("0,1,", None, 2, False)]


def test_a_hundred_thousand_pieces(spark, tmp_path):
    """Appended in time by their number: no batch reads what is there."""
    schema = "key string, seq long, value string"
    text = F.concat(F.lit('data: {"completion": null, "type": "content_block_delta", "delta": {"type": "text_delta", "text": "'), F.col("id").cast("string"), F.lit(',"}}'))
    for n in range(4):
        spark.range(n * 25_000, (n + 1) * 25_000, 1, 1).select(F.lit("k").alias("key"), F.col("id").alias("seq"), text.alias("value")).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("k", 100_000, "data: [DONE]")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    began = time.monotonic()
    found = folded(spark, tmp_path, spark.createDataFrame([], schema).schema)
    assert [(r[3], r[4]) for r in found] == [(100_000, True)] and found[0][1] == "".join(f"{i}," for i in range(100_000))
    assert time.monotonic() - began < 120


@pytest.mark.parametrize(("lines", "passed", "beats"), [(["Question: q", "[heartbeat] ping sent", "Sent reply to Telegram. Bye"], True, 1), (["Question: q", "Sent reply to Telegram.", "Council failed: x"], False, 0), (["Sent reply to Telegram."], False, 0), (["Question: q", "Sent reply to it"], False, 0), (["Question: q"], False, 0)])
def test_verdicts(spark, lines, passed, beats):
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(lines)], "key string, seq int, value string")
    row = summaries.verdicts(df, "key", "seq").first()
    assert (row.passed, row.beats) == (passed, beats)


def test_change_notes(spark):
    df = spark.createDataFrame([("s", "new", 15, [f"t{i}" for i in range(15)]), ("s", "updated", 1, None), ("x", "new", 0, ["a"])], "source string, verb string, n int, titles array<string>")
    notes = [r.note for r in summaries.change_notes(df).orderBy("verb").collect()]
    assert notes[0].startswith("15 new s conversations:\n- t0\n") and notes[0].endswith("- t9\n- (+5 more)") and notes[1] == "1 updated s conversation stored"


def test_change_notes_of_first_titles(spark):
    df = spark.createDataFrame([("s", "new", 15, [f"t{i}" for i in range(10)]), ("t", "new", 10, [f"t{i}" for i in range(10)])], "source string, verb string, n long, titles array<string>")
    notes = [r.note for r in summaries.change_notes(df, total="n").orderBy("source").collect()]
    assert notes[0].endswith("- t9\n- (+5 more)") and notes[1].endswith("- t9")


def test_run_stats(spark):
    df = spark.createDataFrame([(2, "inserted", ""), (1, "inserted", "one"), (3, "failed", "x")], "pos int, outcome string, title string")
    row = summaries.run_stats(df).first()
    assert (row.inserted, row.failed, row.inserted_titles, row.updated_titles) == (2, 1, ["one", "(untitled)"], [])


def test_files(spark, tmp_path):
    d = tmp_path / "exports_1"
    d.mkdir()
    (d / "claude-a.md").write_text("# A")
    (d / "b.txt").write_text("B")
    assert [r.file_name for r in files.markdown_exports(spark, str(tmp_path)).collect()] == ["claude-a.md"]
    row = files.context(spark, str(tmp_path)).first()
    assert row.parts == 2 and row.content.startswith("=== ") and row.content.endswith("# A")
    log = tmp_path / "log"
    assert files.tail(spark, str(log), 3) == ("", 3)
    log.write_bytes("abcé".encode())
    assert files.tail(spark, str(log), 2) == ("cé", 5)


def test_catalog(spark):
    spark.range(3).createOrReplaceTempView("some_rows")
    assert "some_rows" in [r.table_name for r in summaries.list_tables(spark).collect()]
    assert summaries.browse(spark, "some_rows").count() == 3
    with pytest.raises(LookupError):
        summaries.browse(spark, "no_such_rows")


def test_listing_lines(spark):
    df = spark.createDataFrame([(0, "a", "T"), (1, "b", None), (2, "c", "U")], "pos int, conversation_id string, title string")
    assert [r.line for r in summaries.listing_lines(df, df.where("pos < 2")).collect()] == ["a  T", "b  (untitled)", "2 of 3"]


def test_json_lines_are_plain():
    assert json.loads(folds.dumps({"a": 1}).removeprefix("data: ")) == {"a": 1}


def test_notices(spark):
    sent = []
    assert notices.push(lambda *x: sent.append(x), "t", "m") and sent == [("t", "m")]
    assert not notices.push(None, "t", "m") and not notices.push(lambda *_: 1 / 0, "t", "m")
    notes = summaries.change_notes(spark.createDataFrame([("s", "new", 1, ["a"])], "source string, verb string, n int, titles array<string>"))
    assert notices.push_changes(lambda *x: sent.append(x), notes) == 1 and sent[-1] == ("1 new s conversation", "1 new s conversation:\n- a")
    assert isinstance(notices.Heartbeat(None), notices.StreamingQueryListener)


def test_completions(spark):
    df = spark.createDataFrame([('{"text": "a", "messageLimit": null}',), ("bad",)], "result string")
    assert [r.text for r in folds.completions(df).collect()] == ["a", None]
    df = spark.createDataFrame([(("b", "few"),)], "result struct<text:string,messageLimit:string>")
    assert folds.completions(df).first().message_limit == "few"


def test_random_context(spark):
    rows = stored(spark, ("claude", "a", LIST), ("claude", "b", LIST, {"raw_source": "markdown_reconstructed"}))
    assert [r.conversation_id for r in render.random_context(rows).collect()] == ["a"]
    assert render.random_context(rows.limit(0)).count() == 0


def test_table_columns(spark):
    spark.range(1).createOrReplaceTempView("one_row")
    assert [tuple(r) for r in summaries.table_columns(spark, "one_row").collect()] == [(0, "id", "bigint")]
