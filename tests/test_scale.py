"""Long branches, hot keys: equal to plain versions, in time and memory that grow with the rows."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_conversations import LIST, TREE, msg, node, stored

from parley.operators import branch, imports, render, segments, summaries


def test_a_conversation_of_100000_messages(spark):
    n = 100_000
    messages = [msg(f"m{i}", f"m{i - 1}" if i else None, "human", f"t{i}") for i in range(n)]
    nodes = {"root": node("root", None)} | {f"n{i}": node(f"n{i}", f"n{i - 1}" if i else "root", "user", [f"t{i}"]) for i in range(n)}
    rows = stored(spark, ("claude", "a", LIST | {"chat_messages": messages, "current_leaf_message_uuid": f"m{n - 1}"}), ("chatgpt", "b", TREE | {"mapping": nodes, "current_node": f"n{n - 1}"}))
    began = time.monotonic()
    found = branch.active_branch(rows).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"), F.count_if(F.concat(F.lit("t"), "pos") == F.col("text")).alias("right")).collect()
    assert {tuple(r) for r in found} == {("claude", n, n - 1, n), ("chatgpt", n, n - 1, n)}
    assert time.monotonic() - began < 60


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 12).flatmap(lambda n: st.tuples(st.lists(st.sampled_from([*"abcdefgh", None]), min_size=n, max_size=n), st.lists(st.sampled_from([*"abcdefghx", None]), min_size=n, max_size=n), st.sampled_from([*"abcdefghx", None]), st.booleans())))
def test_the_way_up(case):
    ids, parents, start, rootless = case
    way = []
    while start is not None and start in ids and start not in [w[0] for w in way]:
        at = max(k for k, i in enumerate(ids) if i == start)
        way.append((start, at))
        start = parents[at]
    if rootless:
        way = [w for w in way if parents[w[1]] is not None]
    expected = [None] * len(ids)
    for place, (_, at) in enumerate(reversed(way)):
        expected[at] = place
    assert branch.on_path(case[2], ids, parents, rootless) == expected


ROWS = "key string, at long, day timestamp, retries int, failed boolean, name string"


def hot(seed=1, n=3000):
    """Nine tenths of the rows are of one key, some orders repeat, and some keys are null."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None])
        rows.append((key, i, datetime(2024, 1, 1) + timedelta(minutes=i), rng.randint(0, 5), rng.random() < 0.8, f"x{i}"))
    rng.shuffle(rows)
    return rows


@pytest.fixture
def cut_small(monkeypatch):
    monkeypatch.setattr(segments, "PIECE_ROWS", 100)


def plain(rows, key):
    return sorted((r for r in rows if r[0] == key), key=lambda r: r[1])


@pytest.mark.parametrize("order", ["at", "day"])
def test_windows_over_a_hot_key(spark, cut_small, order):
    rows = hot()
    df = spark.createDataFrame(rows, ROWS)
    pieces = segments.Pieces(df, "key", order)
    sizes = [r["count"] for r in pieces.rows.where("key = 'hot'").groupBy(segments.PIECE).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 300
    pace = {r.name: r.pace for r in summaries.adaptive_pace(df, "key", order, "retries").collect()}
    progress = {r.name: (r.i, r.n) for r in summaries.progress(df, "key", order, F.col("at").cast("double")).collect()}
    runs = {(r.key, r.first): r.n for r in summaries.failure_runs(df, "key", "at", F.col("failed"), 3).collect()}
    expected_runs = {}
    for key in ("hot", "a", "b", None):
        own, run = plain(rows, key), []
        for i, r in enumerate(own):
            mean = sum(x[3] for x in own[max(0, i - 9) : i + 1]) / min(10, i + 1)
            assert pace[r[5]] == (20 if mean >= 2.25 else 5 if mean >= 1.2 else 0.5)
            assert progress[r[5]] == (i + 1, len(own))
        for r in [*own, (key, None, None, None, False, None)]:
            if r[4]:
                run.append(r[1])
            else:
                if len(run) >= 3:
                    expected_runs[key, run[0]] = len(run)
                run = []
    assert runs == expected_runs and len(pace) == len(progress) == len(rows)


def test_pieces_shorter_than_what_is_looked_back(spark, monkeypatch):
    monkeypatch.setattr(segments, "PIECE_ROWS", 4)
    rows = [("k", i, datetime(2024, 1, 1), i % 7, False, f"x{i}") for i in range(200)]
    pace = {r.name: r.pace for r in summaries.adaptive_pace(spark.createDataFrame(rows, ROWS), "key", "at", "retries").collect()}
    for i, r in enumerate(rows):
        mean = sum(x[3] for x in rows[max(0, i - 9) : i + 1]) / min(10, i + 1)
        assert pace[r[5]] == (20 if mean >= 2.25 else 5 if mean >= 1.2 else 0.5)


def test_text_orders_and_no_rows_are_not_cut(spark, cut_small):
    df = spark.createDataFrame(hot(n=300), ROWS)
    assert segments.Pieces(df, "key", "name").whole and segments.Pieces(df.limit(0), "key", "at").whole
    assert summaries.progress(df.limit(0), "key", "at", F.lit(1.0)).count() == 0


def test_backfill_export_backfill(spark):
    rows = stored(spark, ("claude", "k1", LIST, {"title": "One"}), ("chatgpt", "k2", TREE, {"title": "Two"})).withColumn("imported_at", F.current_timestamp())
    files = spark.createDataFrame([(f"{r.source}-{r.conversation_id}.md", r.content) for r in render.render(rows, "markdown").collect()] + [("claude-bare.md", "# My title\n\n\n---\n\n**You**:\n\nhi\n\n---\n\n")], "file_name string, value string")
    rebuilt, refused, counts = imports.backfill(rows.limit(0), files)
    assert refused.count() == 0 and counts.first().inserted == 3
    again = spark.createDataFrame([(f"{r.source}-{r.conversation_id}.md", r.content) for r in render.render(rebuilt, "markdown").collect()], files.schema)
    in_utc = lambda rows: sorted((n, t.replace("00Z\n", "00+00:00\n")) for n, t in rows.collect())
    assert in_utc(again) == in_utc(files)
    assert imports.backfill(rebuilt, again)[2].first().unchanged == 3
    text = {r.conversation_id: r.content for r in render.render(rebuilt, "text").collect()}
    assert text["bare"] == "My title\n\n---\n\nHuman: hi"
    assert json.loads(render.render(rebuilt.where("conversation_id = 'bare'"), "json").first().content)["title"] == "My title"
