"""Branches, transcripts, parsing, filters and merges over payloads written by hand."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley import schema
from parley.operators import branch, filters, merge, parse, render


def stored(spark, *rows):
    """rows: (source, id, payload dict or text, more columns)."""
    full = []
    for source, name, payload, *more in rows:
        text = payload if isinstance(payload, str) else json.dumps(payload, ensure_ascii=False)
        row = {f.name: None for f in schema.CONVERSATIONS.fields} | {"source": source, "conversation_id": name, "raw_json": text, "raw_source": schema.API, "content_hash": "h", "title": name} | (more[0] if more else {})
        full.append(tuple(row[f.name] for f in schema.CONVERSATIONS.fields))
    loose = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.CONVERSATIONS.fields)
    return spark.createDataFrame(full, loose)


def msg(uuid, parent, sender, text=None, content=None):
    return {"uuid": uuid, "parent_message_uuid": parent, "sender": sender, "text": text, "content": content}


LIST = {
    "uuid": "u", "name": "Talk", "model": "m1", "created_at": "2025-06-01T00:00:00Z", "updated_at": None, "current_leaf_message_uuid": "c",
    "chat_messages": [msg("a", None, "human", "hi"), msg("x", "a", "assistant", "left behind"), msg("b", "a", "assistant", content=[{"text": "he"}, {"text": ""}, {"text": "llo"}]), msg("c", "b", "human", "bye")],
}


def node(name, parent, role=None, parts=None, children=(), kind="text", slug=None, **more):
    message = None if role is None else {"author": {"role": role}, "content": {"content_type": kind, "parts": parts} | more, "metadata": {"model_slug": slug}}
    return {"id": name, "parent": parent, "children": list(children), "message": message}


TREE = {
    "id": "t", "title": "Tree", "create_time": 1748779200.5, "update_time": "2025-06-02T00:00:00Z", "current_node": "n4",
    "mapping": {
        "root": node("root", None, children=["n0"]),
        "n0": node("n0", "root", "system", ["hidden"]),
        "n1": node("n1", "n0", "user", ["one", {"image": 1}, "two"]),
        "ctx": node("ctx", "n1", "user", ["ctx"], kind="user_editable_context"),
        "n2": node("n2", "ctx", "assistant", [""]),
        "off": node("off", "n2", "assistant", ["off"], slug="gone-model"),
        "n3": node("n3", "n2", "tool", ["used"], slug="late-model"),
        "n4": node("n4", "n3", "assistant", None, text="by text"),
    },
}


def ids(spark, source, payload):
    found = branch.active_branch(stored(spark, (source, "k", payload))).orderBy("pos").collect()
    return [r.node_id for r in found]


def test_list_branch_has_its_root_and_leaves_others_behind(spark):
    rows = branch.active_branch(stored(spark, ("claude", "k", LIST))).orderBy("pos").collect()
    assert [(r.node_id, r.pos, r.text) for r in rows] == [("a", 0, "hi"), ("b", 1, "hello"), ("c", 2, "bye")]


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({"current_leaf_message_uuid": None}, []),
        ({"current_leaf_message_uuid": "zz"}, []),
        ({"chat_messages": []}, []),
        ({"chat_messages": [msg("a", "b", "human"), msg("b", "a", "human")], "current_leaf_message_uuid": "a"}, ["b", "a"]),
        ({"chat_messages": [msg("a", None, "human", "old"), msg("a", "zz", "human", "new")], "current_leaf_message_uuid": "a"}, ["a"]),
    ],
)
def test_list_branch_edges(spark, change, expected):
    assert ids(spark, "claude", LIST | change) == expected


def test_last_of_equal_ids_counts(spark):
    found = branch.active_branch(stored(spark, ("claude", "k", LIST | {"chat_messages": [msg("a", None, "human", "old"), msg("a", None, "human", "new")], "current_leaf_message_uuid": "a"})))
    assert [r.text for r in found.collect()] == ["new"]


def test_tree_branch_skips_root_and_hidden_messages(spark):
    rows = branch.active_branch(stored(spark, ("chatgpt", "k", TREE))).orderBy("pos").collect()
    assert [(r.node_id, r.role, r.text) for r in rows] == [("n1", "user", "one\ntwo"), ("n2", "assistant", ""), ("n3", "tool", "used"), ("n4", "assistant", "by text")]


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({"current_node": None}, ["n1", "ctx"][:1]),
        ({"current_node": "zz"}, []),
        ({"mapping": {}}, []),
        ({"current_node": "b", "mapping": {"b": node("b", "gone", "user", ["x"])}}, ["b"]),
        ({"current_node": "a", "mapping": {"a": node("a", "b", "user", ["x"]), "b": node("b", "a", "user", ["y"])}}, ["b", "a"]),
        ({"current_node": "a", "mapping": {"a": node("a", None, "user", ["x"])}}, []),
    ],
)
def test_tree_branch_edges(spark, change, expected):
    payload = TREE | change
    if change == {"current_node": None}:  # the first node of the map without children
        payload = payload | {"mapping": {"z": node("z", "r", "user", ["z"]), "a": node("a", "z", "user", ["a"]), "r": node("r", None, children=["z"])}}
        expected = ["z"]
    assert ids(spark, "chatgpt", payload) == expected


def test_null_author_is_an_unknown_role(spark):
    payload = TREE | {"current_node": "a", "mapping": {"r": node("r", None), "a": {"id": "a", "parent": "r", "children": [], "message": {"author": None, "content": {"content_type": "text", "parts": ["x"]}}}}}
    assert "**unknown**:\n\nx" in render.render(stored(spark, ("chatgpt", "k", payload))).first().content


def test_first_model_comes_in_map_order_from_anywhere(spark):
    assert stored(spark, ("chatgpt", "k", TREE)).select(branch.first_model().alias("m")).first().m == "gone-model"


def test_list_markdown_and_text(spark):
    rows = stored(spark, ("claude", "k", LIST))
    assert render.render(rows).first().content == "# Talk\n\n**Created:** 2025-06-01T00:00:00Z\n**Updated:** None\n**Model:** m1\n\n---\n\n**You**:\n\nhi\n\n---\n\n**Claude**:\n\nhello\n\n---\n\n**You**:\n\nbye\n\n---\n\n"
    assert render.render(rows, "text").first().content == "Talk\nModel: m1\n\n---\n\nHuman: hi\n\nAssistant: hello\n\nH: bye"
    assert render.render(rows, "text", False).first().content.startswith("Human: hi")
    assert json.loads(render.render(rows, "json").first().content) == LIST


def test_tree_markdown_and_text(spark):
    rows = stored(spark, ("chatgpt", "k", TREE))
    assert render.render(rows).first().content == "# Tree\n\n**Created:** 2025-06-01T12:00:00.500000+00:00\n**Updated:** 2025-06-02T00:00:00+00:00\n\n---\n\n**You**:\n\none\ntwo\n\n---\n\n**tool**:\n\nused\n\n---\n\n**ChatGPT**:\n\nby text\n\n---\n\n"
    assert render.render(rows, "text").first().content == "Tree\n\n---\n\nHuman: one\ntwo\n\ntool: used\n\nAssistant: by text"


def test_untitled_and_empty(spark):
    assert render.render(stored(spark, ("claude", "k", {"chat_messages": []}))).first().content.startswith("# Untitled Conversation\n\n")
    assert render.render(stored(spark, ("chatgpt", "k", {"title": "", "mapping": {}}))).first().content == "# ChatGPT Conversation\n\n**Created:** unknown\n**Updated:** unknown\n\n---\n\n"


def test_equal_titles_overwrite_in_order(spark):
    rows = stored(spark, ("claude", "k1", LIST, {"title": "Same"}), ("claude", "k2", LIST | {"name": "Second"}, {"title": "Same"}))
    found = render.export_files(rows).collect()
    assert [r.file_name for r in found] == ["claude-Same.md"] and found[0].content.startswith("# Second")


def files(spark, *texts, source="claude"):
    return spark.createDataFrame([(t, source) for t in texts], "value string, source string")


def test_parse_is_the_inverse_of_render(spark):
    text = render.render(stored(spark, ("claude", "k", LIST))).first().content
    row = parse.parse_markdown(files(spark, text)).first()
    assert row.error is None and (row.title, row.created, row.model) == ("Talk", "2025-06-01T00:00:00Z", "m1")
    assert [(m.role, m.text) for m in row.messages] == [("human", "hi"), ("assistant", "hello"), ("human", "bye")]


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("Talk", "does not start"),
        ("# Talk\n\nno rule", "no rule after the header"),
        ("# T\n\n\n---\n\nno sender\n\n---\n\n", "no sender"),
        ("# T\n\n**Model:** m\n\n---\n\n**You**:\n\nhi", "a message has no rule"),
        ("# T\n\n**Extra:** m\n\n---\n\n**You**:\n\nhi\n\n---\n\n", "differs at offset 5"),
        (None, "does not start"),
    ],
)
def test_refused_files(spark, text, error):
    assert error in parse.parse_markdown(files(spark, text)).first().error


def test_a_rule_inside_a_message(spark):
    text = "# T\n\n**Created:** a\n\n---\n\n**You**:\n\none\n\n---\n\ntwo\n\n---\n\n**Claude**:\n\n\n\n---\n\n"
    row = parse.parse_markdown(files(spark, text)).first()
    assert row.error is None and [m.text for m in row.messages] == ["one\n\n---\n\ntwo", ""]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.text("ab*-\n #:You", max_size=12), min_size=1, max_size=3), min_size=1, max_size=6))
def test_what_is_parsed_renders_as_it_was(spark, all_texts):
    made = ["# T\n\n**Model:** m\n\n---\n\n" + "".join(f"**{'Claude' if i % 2 else 'You'}**:\n\n{t}\n\n---\n\n" for i, t in enumerate(texts)) for texts in all_texts]
    for row in parse.parse_markdown(files(spark, *made)).collect():
        if row.error is None:
            assert "# T\n\n**Model:** m\n\n---\n\n" + "".join(f"**{m.label}**:\n\n{m.text}\n\n---\n\n" for m in row.messages) == row.value


def test_markdown_rows(spark):
    text = render.render(stored(spark, ("claude", "k", LIST))).first().content
    named = spark.createDataFrame([("claude-Talk.md", text), ("other.md", text), ("claude-bad.md", "x")], "file_name string, value string")
    rows, refused = parse.markdown_rows(named)
    row = rows.first()
    assert (row.source, row.conversation_id, row.message_count, row.created_text, row.updated_text, row.updated_at) == ("claude", "Talk", 3, "2025-06-01T00:00:00+00:00", "None", None)
    assert json.loads(row.raw_json)["messages"][0] == {"role": "human", "text": "hi"}
    assert {r.file_name for r in refused.collect()} == {"other.md", "claude-bad.md"}
    assert branch.messages(rows.withColumn("imported_at", F.current_timestamp())).count() == 3


def test_filters(spark):
    rows = spark.createDataFrame([("a", "2025-01-01T00:00:00Z", "m"), ("b", "2025-06-01T00:00:00Z", None), ("c", None, "m"), ("d", "1735689600", "m")], "id string, updated_at string, model string")
    pick = lambda **k: sorted(r.id for r in filters.select_conversations(rows, **k).collect())
    assert pick(after="2025-01-01", before="2025-01-01") == ["a", "c", "d"]
    assert pick(after="2025-01-02") == ["b", "c"]
    assert pick(model="m") == ["a", "c", "d"]
    assert len(pick(limit=2)) == 2


@pytest.mark.parametrize(("source", "name", "ok"), [("claude", "ABCDEF01-2345-6789-abcd-ef0123456789", True), ("claude", "abc", False), ("chatgpt", "a" * 20, True), ("chatgpt", "a" * 41, False), ("chatgpt", None, False)])
def test_id_guard(spark, source, name, ok):
    assert spark.range(1).select(filters.valid_id(F.lit(source), F.lit(name).cast("string")).alias("v")).first().v is ok


@pytest.mark.parametrize(("source", "title", "kept"), [("claude", "Council: x", False), ("claude", "council: x", True), ("chatgpt", "Council: x", True), ("claude", None, True), (None, "x", True)])
def test_scratch_titles(spark, source, title, kept):
    assert spark.createDataFrame([(source, title)], "source string, title string").where(filters.not_scratch()).count() == int(kept)


@pytest.mark.parametrize(("source", "raw", "ok"), [("claude", LIST, True), ("claude", "{}", False), ("claude", '{"chat_messages": []}', False), ("chatgpt", TREE, True), ("chatgpt", '{"mapping": {}}', False), ("claude", "[]", False), ("claude", "", False), ("else", '{"a": 1}', True), ("else", "{}", False)])
def test_payload_validity(spark, source, raw, ok):
    assert stored(spark, (source, "k", raw)).select(filters.valid_payload().alias("v")).first().v is ok


def test_constraints(spark):
    assert schema.checked(stored(spark, ("claude", "k", LIST))).count() == 1
    with pytest.raises(Exception, match="source is not allowed"):
        schema.checked(stored(spark, ("elsewhere", "k", LIST))).collect()


def test_merge_outcomes(spark):
    old = stored(spark, ("claude", "same", LIST, {"content_hash": "1", "model": "old"}), ("claude", "changed", LIST, {"content_hash": "1"}), ("claude", "rest", LIST))
    new = stored(spark, ("claude", "same", LIST, {"content_hash": "1", "model": "new"}), ("claude", "changed", LIST, {"content_hash": "2", "model": "new"}), ("claude", "fresh", LIST), ("claude", "rest", "{}"))
    merged, refused, _ = merge.merge(old, new)
    found = {r.conversation_id: (r.outcome, r.model) for r in merged.collect()}
    assert found == {"same": ("unchanged", "old"), "changed": ("updated", "new"), "fresh": ("inserted", None), "rest": ("kept", None)}
    assert [r.conversation_id for r in refused.collect()] == ["rest"]
    assert {r.outcome: r.n for r in merge.outcome_counts(merged).collect()} == {"unchanged": 1, "updated": 1, "inserted": 1}


def test_supersede(spark):
    from datetime import datetime

    when = datetime(2025, 1, 1)
    old = stored(spark, *[("claude", n, LIST, {"title": t, "created_at": c, "raw_source": s}) for n, t, c, s in (("md", "T", when, schema.REBUILT), ("api-1", "T", when, schema.API), ("null", None, when, schema.REBUILT), ("notime", "T", None, schema.REBUILT), ("new", "T", when, schema.REBUILT))])
    new = stored(spark, ("claude", "new", LIST, {"title": "T", "created_at": when, "content_hash": "z"}), ("claude", "n2", LIST, {"title": None, "created_at": when}))
    merged, _, gone = merge.merge(old, new)
    assert [r.conversation_id for r in gone.collect()] == ["md"]
    assert "md" not in {r.conversation_id for r in merged.collect()}


def test_rebuilt_rows_never_replace_api_rows(spark):
    old = stored(spark, ("claude", "k", LIST, {"content_hash": "1"}))
    new = stored(spark, ("claude", "k", LIST, {"content_hash": "2", "raw_source": schema.REBUILT}))
    assert merge.outcomes(old, new).first().outcome == "unchanged"
    assert merge.outcomes(old, new, downgrade=True).first().outcome == "updated"


def test_last_state_of_a_batch_counts(spark):
    rows = stored(spark, ("claude", "k", LIST, {"model": "a"}), ("claude", "k", LIST, {"model": "b"})).withColumn("pos", F.when(F.col("model") == "a", 1).otherwise(0))
    assert merge.last_per_key(rows).first().model == "a"


def test_rehash(spark):
    rows = stored(spark, ("claude", "k", LIST), ("claude", "l", LIST))
    once = merge.rehash(rows)
    assert merge.rehash_report(once).first().asDict() == {"changed": 2, "total": 2}
    assert merge.rehash_report(merge.rehash(once.drop("changed"))).first().changed == 0


def test_first_tab(spark):
    tabs = spark.createDataFrame([(2, "page", "https://a/2"), (1, "page", "https://a/1"), (0, "worker", "https://a/0"), (3, "page", "https://b")], "pos int, type string, url string")
    assert filters.first_tab(tabs, "https://a").first().url == "https://a/1" and filters.first_tab(tabs, "x").count() == 0
    assert filters.next_offset(spark.createDataFrame([(4,), (9,)], "update_id long")).first().offset == 10
