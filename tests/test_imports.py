"""An import from listing to stats, and the files written from it."""

import json

from test_conversations import LIST, TREE, stored

from parley.operators import imports, merge, render
from parley.sources import exports

ID = ["%08d-0000-0000-0000-000000000000" % i for i in range(8)]


def listing(spark, rows):
    return spark.createDataFrame(rows, "pos int, id string, title string, model string, created_at string, updated_at string")


def test_tree_import(spark):
    old = stored(spark, ("chatgpt", ID[0], TREE, {"updated_text": "2025-06-02T00:00:00+00:00"}), ("chatgpt", ID[1], TREE, {"content_hash": "other", "updated_text": "2020-01-01T00:00:00+00:00"}))
    rows = listing(spark, [(0, ID[0], "same", None, "1", "2025-06-02T00:00:00Z"), (1, ID[1], "changed", None, "1", "1748779200.5"), (2, ID[2], "fresh", None, "1", None), (3, "bad id", "x", None, "1", None), (4, ID[4], "empty", None, "1", "2025-06-02T00:00:00Z"), (5, ID[5], "down", None, "1", "2025-06-02T00:00:00Z")])
    chosen = imports.candidates(rows, "chatgpt", old)
    assert sorted(r.pos for r in chosen.collect()) == [1, 2, 4, 5]
    untitled = TREE | {"title": None}
    details = spark.createDataFrame([(ID[1], json.dumps(TREE), 1), (ID[2], json.dumps(untitled), 3), (ID[4], '{"mapping": {}}', 1), (ID[5], None, 4)], "id string, raw_json string, attempts int")
    merged, stats = imports.import_run(old, chosen, details, "chatgpt")
    found = {r.conversation_id: (r.outcome, r.title, r.model) for r in merged.collect()}
    assert found == {ID[0]: ("kept", ID[0], None), ID[1]: ("updated", "Tree", "gone-model"), ID[2]: ("inserted", "fresh", "gone-model")}
    s = stats.first()
    assert (s.inserted, s.updated, s.unchanged, s.failed, s.retries, s.superseded, s.inserted_titles, s.updated_titles) == (1, 1, 0, 2, 5, 0, ["fresh"], ["Tree"])


def test_list_import(spark):
    rows = listing(spark, [(0, ID[0], "T", "m1", "2025-01-01T00:00:00Z", "2025-01-01T00:00:00Z"), (1, ID[1], "Council: q", "m1", None, None), (2, ID[2], "U", "m2", None, None)])
    chosen = imports.candidates(rows, "claude", model="m1")
    assert [r.id for r in chosen.collect()] == [ID[0]]
    assert imports.candidates(rows, "claude", after="2025-02-01").count() == 1
    made = imports.api_rows(chosen, spark.createDataFrame([(ID[0], json.dumps(LIST | {"uuid": ID[0]}), 1)], "id string, raw_json string, attempts int"), "claude").first()
    assert (made.conversation_id, made.title, made.model, made.created_text, made.updated_at) == (ID[0], "Talk", "m1", "2025-06-01T00:00:00+00:00", None)
    again = imports.api_rows(chosen, spark.createDataFrame([(ID[0], json.dumps(dict(reversed(list((LIST | {"uuid": ID[0]}).items())))), 1)], "id string, raw_json string, attempts int"), "claude").first()
    assert made.content_hash == again.content_hash


def test_export_files(spark, tmp_path):
    rows = stored(spark, ("claude", "k1", LIST, {"title": "a/b"}), ("chatgpt", "k2", TREE, {"title": None}))
    written = exports.write_exports(render.export_files(rows), f"file://{tmp_path}/out").collect()
    assert {r.file_name for r in written} == {"claude-a_b.md", "chatgpt-k2.md"}
    assert (tmp_path / "out" / "claude-a_b.md").read_text().startswith("# Talk")
    as_json = exports.write_exports(render.export_files(rows, "json"), f"file://{tmp_path}/json").collect()
    assert {r.file_name for r in as_json} == {"claude-a_b.json", "chatgpt-k2.json"}


def test_parts_and_settings(spark, tmp_path):
    parts = exports.message_parts(spark.createDataFrame([(1, "x" * 8500), (2, "")], "id int, text string")).collect()
    assert [(r.id, r.part, len(r.chunk)) for r in parts] == [(1, 0, 4000), (1, 1, 4000), (1, 2, 500)]
    (tmp_path / "env").write_text("# no\nA = 1\nA=2\nbad\nB=x=y\n")
    assert exports.settings(spark, str(tmp_path / "env")) == {"A": "1", "B": "x=y"}


def test_merge_of_nothing(spark):
    assert merge.merge(stored(spark, ("claude", "k", LIST)).limit(0), stored(spark, ("claude", "k", LIST)).limit(0))[0].count() == 0
