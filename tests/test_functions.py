import hashlib
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parley.functions import canonical, texts, times


def value(spark, column, **row):
    return spark.createDataFrame([row or {"x": 1}], ", ".join(f"{k} string" for k in row) or "x int").select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2025-06-01T12:34:56.789012Z", "2025-06-01T12:34:56.789012+00:00"),
        ("2025-06-01T14:34:56+02:00", "2025-06-01T12:34:56+00:00"),
        ("1754410000.5", "2025-08-05T16:06:40.500000+00:00"),
        ("0", "1970-01-01T00:00:00+00:00"),
        ("unknown", None),
        (None, None),
    ],
)
def test_timestamps(spark, text, expected):
    assert value(spark, times.iso_text(times.parse_timestamp("x")), x=text) == expected


def test_lenient_text_keeps_what_it_cannot_read(spark):
    assert value(spark, times.lenient_text("x"), x="None") == "None"
    assert value(spark, times.lenient_text("x"), x="2025-06-01T12:00:00Z") == "2025-06-01T12:00:00+00:00"
    assert value(spark, times.lenient_text("x"), x="") is None


def test_bound(spark):
    assert value(spark, times.iso_text(times.parse_bound("2025-06-01"))) == "2025-06-01T00:00:00+00:00"
    with pytest.raises(Exception, match="not a date"):
        value(spark, times.parse_bound("someday"))


@pytest.mark.parametrize(("name", "expected"), [('a/b:c*d?"e"<f>|g\\h', "a_b_c_d__e__f__g_h"), ("x" * 200, "x" * 150), ("", "untitled"), (None, "untitled")])
def test_safe_filename(spark, name, expected):
    assert value(spark, texts.safe_filename("x"), x=name) == expected


def test_ids_and_sources_of_file_names(spark):
    assert value(spark, texts.id_from_filename("x", F.lit("claude")), x="claude-my chat.v2.md") == "my chat.v2"
    assert value(spark, texts.id_from_filename("x", F.lit("claude")), x="other.md") == "other"
    assert value(spark, texts.source_from_filename("x"), x="chatgpt-a.md") == "chatgpt"
    assert value(spark, texts.source_from_filename("x"), x="a.md") is None


def test_chunks(spark):
    found = value(spark, texts.chunks("x"), x="a" * 8500)
    assert [len(c) for c in found] == [4000, 4000, 500]
    assert value(spark, texts.chunks("x"), x="") == [] == value(spark, texts.chunks("x"), x=None)


@pytest.mark.parametrize(("text", "expected"), [("a THE CALL: do it \n", "THE CALL: do it"), ("**THE CALL:** do it", "THE CALL: do it"), (" no label ", "no label"), ("THE CALL** x", "THE CALL x")])
def test_final_call(spark, text, expected):
    assert value(spark, texts.final_call("x"), x=text) == expected


def test_small_texts(spark):
    assert value(spark, texts.excerpt("x"), x="a" * 301) == "a" * 300 + "..."
    assert value(spark, texts.excerpt("x"), x="a" * 300) == "a" * 300
    assert value(spark, texts.one_line("x", "> "), x=" a \n b ") == "> a b"
    assert value(spark, texts.html_escape("x"), x="<a href='x'>&\"") == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"
    assert value(spark, texts.backoff(F.lit(3))) == 30.0


@pytest.mark.parametrize(("source", "role", "label"), [("claude", "human", "You"), ("claude", "assistant", "Claude"), ("claude", None, "Claude"), ("chatgpt", "user", "You"), ("chatgpt", "assistant", "ChatGPT"), ("chatgpt", "tool", "tool"), ("chatgpt", None, "unknown")])
def test_sender_labels(spark, source, role, label):
    assert value(spark, texts.sender_label("s", "r"), s=source, r=role) == label


def test_roles_of_labels(spark):
    assert value(spark, texts.role_of_label("s", "l"), s="claude", l="You") == "human"
    assert value(spark, texts.role_of_label("s", "l"), s="chatgpt", l="You") == "user"
    assert value(spark, texts.role_of_label("s", "l"), s="chatgpt", l="tool") is None


JSON = st.recursive(st.none() | st.booleans() | st.integers(-5, 5) | st.floats(-5, 5) | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=2), x, max_size=3), max_leaves=8)


@given(JSON)
def test_canonical_is_stable(v):
    once = canonical.canonical_text(json.dumps(v))
    assert canonical.canonical_text(once) == once


@given(st.lists(st.integers() | st.text(max_size=3) | st.none(), max_size=5), st.randoms())
def test_scalar_lists_lose_their_order(xs, r):
    ys = xs[:]
    r.shuffle(ys)
    assert canonical.canonical_text(json.dumps({"a": xs})) == canonical.canonical_text(json.dumps({"a": ys}))


def test_other_lists_keep_their_order():
    assert canonical.canonical_text('[{"a": 1}, {"a": 2}]') != canonical.canonical_text('[{"a": 2}, {"a": 1}]')
    assert canonical.canonical_text('{"b": 1, "a": "é"}') == '{"a": "é", "b": 1}'
    assert canonical.canonical_text("no json") is None


def test_content_hash(spark):
    text = '{"a": [1, 2.0, "x", null, true]}'
    assert value(spark, canonical.content_hash("x"), x=text) == hashlib.sha256(canonical.canonical_text(text).encode()).hexdigest()
    assert value(spark, canonical.content_hash("x"), x=None) is None




@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_don_t_depend_on_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["1700000000", "1700000000.25", "2023-11-14T22:13:20Z", "2023-11-14T22:13:20", "2023-11-14 22:13:20", "2023-11-15T00:13:20+02:00", "2024-03-10T02:30:00", "2023-11-14", "1969-12-31T23:59:59.5Z", "soon", None]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        found = [r.v for r in df.select(times.iso_text(times.parse_timestamp("t")).alias("v")).collect()]
        evening = "2023-11-14T22:13:20+00:00"
        assert found == [evening, "2023-11-14T22:13:20.250000+00:00", evening, evening, evening, evening, "2024-03-10T02:30:00+00:00", "2023-11-14T00:00:00+00:00", "1969-12-31T23:59:59.500000+00:00", None, None]
        assert spark.range(1).select(F.unix_micros(times.parse_bound("2023-11-14")).alias("v")).first().v == 1699920000000000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
