"""Matroska files and ZIP-packed WARC files."""

import hashlib
import io
import os
import struct
import zipfile
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parley.llm import matroska as m
from parley.llm import warczip as w
from parley.llm.common import new_folder


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000))
def test_samples_come_back(data):
    payload = m.pad(data)
    assert len(payload) % 576 == 0 and payload.startswith(data) and set(payload[len(data) :]) <= {255}
    stored = m.write_samples(payload)
    back, media = m.read_samples(stored)
    assert back == payload
    assert [p[1] for p in media.packets] == [i * 72_000_000 for i in range(len(payload) // 576)]
    assert len(media.cues) == len(media.clusters)


def test_sizes_of_texts():
    assert len(m.pad(b"")) == 576 and len(m.pad(b"x" * 576)) == 576 and len(m.pad(b"x" * 577)) == 1152


@pytest.mark.parametrize("kind", [0, 1, 2, 3])
def test_lacing(kind):
    frames = {0: [b"a" * 700], 1: [b"a" * 255, b"b" * 600, b"", b"c"], 2: [b"ab", b"cd", b"ef"], 3: [b"a" * 800, b"b" * 500, b"c" * 501, b"d"]}[kind]
    body = m.lace(frames, kind)
    sizes, at = m.lace_sizes(body, 0, len(body), kind)
    assert sizes == [len(f) for f in frames] and body[at:] == b"".join(frames)


def unknown(kind, body):
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + b"\x01" + b"\xff" * 7 + body


def test_unknown_sizes_groups_and_two_tracks():
    track = lambda n: m.element(m.TRACK_ENTRY, m.number(m.TRACK_NUMBER, n) + m.number(m.DEFAULT_DURATION, 1000))
    block = lambda t, ms, data, flags=0: bytes([0x80 | t]) + struct.pack(">hB", ms, flags) + data
    first = m.number(m.CLUSTER_TIMESTAMP, 5) + m.element(m.SIMPLE_BLOCK, block(1, -2, b"aa", 0x80)) + m.element(0xEC, b"void")
    second = m.number(m.CLUSTER_TIMESTAMP, 9) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block(2, 0, b"bb")) + m.number(m.REFERENCE_BLOCK, 1))
    data = m.HEADER + unknown(m.SEGMENT, m.element(m.TRACKS, track(1) + track(2)) + unknown(m.CLUSTER, first) + unknown(m.CLUSTER, second))
    media = m.parse(data)
    assert [(p[0], p[1], data[p[2] : p[2] + p[3]], p[4]) for p in media.packets] == [(1, 3_000_000, b"aa", True), (2, 9_000_000, b"bb", False)]
    assert len(media.clusters) == 2


@pytest.mark.parametrize("cut", [0, 3, 50, 200, 700])
def test_cut_off_files_are_refused(cut):
    with pytest.raises((m.MatroskaError, struct.error)):
        m.parse(m.write_samples(m.pad(b"x" * 1000))[:cut])


def test_packet_table(spark):
    good = m.write_samples(m.pad(b"hello" * 300))
    df = spark.createDataFrame([(1, good), (2, b"no"), (3, None), (4, b"")], "doc_id long, media binary")
    rows = m.packet_table(df).collect()
    assert b"".join(good[r.offset : r.offset + r.size] for r in rows if r.id == 1) == m.pad(b"hello" * 300)
    assert sorted(r.id for r in rows if r.error) == [2, 3, 4]
    assert m.packet_table(df.limit(0)).count() == 0


def documents(spark, tmp_path, rows, schema="doc_id long, text string, score double, media string"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_op1(spark, tmp_path):
    long = "é" * 100_000
    d = documents(spark, tmp_path, [(1, "a", 0.0, "x"), (2, None, 0.0, "x"), (2, "", 0.0, "x"), (None, long, 0.0, "x"), (1, "a", 0.0, "x")])
    rows = m.op1_matroska(spark, d).collect()
    assert len(rows) == 5
    for r in rows:
        text = {1: b"a", 2: b"", None: long.encode()}[r.doc_id]
        payload = m.pad(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert len({(r.media_sha256, r.feature) for r in rows}) == 3
    assert m.op1_matroska(spark, documents(spark, tmp_path, [])).count() == 0


# ZIP and WARC


def members(data):
    return w.central_directory(len(data), lambda at, n: data[at : at + n])


def test_directory_finds_stored_members():
    out = io.BytesIO(b"junk before")
    out.seek(0, 2)
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("a/one", b"first", zipfile.ZIP_STORED)
        z.writestr("packed", b"x" * 1000, zipfile.ZIP_DEFLATED)
        z.writestr("é", b"second")
        z.comment = b"PK\x05\x06 in a comment"
    data = out.getvalue()
    assert [(n, data[at : at + size]) for n, at, size in members(data)] == [("a/one", b"first"), ("é", b"second")]


def zip64(name, body):
    """A file whose directory keeps every size in ZIP64 fields."""
    big = 0xFFFFFFFF
    extra = struct.pack("<HHQQ", 1, 16, len(body), len(body))
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, zlib.crc32(body), big, big, len(name), len(extra)) + name + extra + body
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, zlib.crc32(body), big, big, len(name), len(extra), 0, 0, 0, 0, big) + name + extra
    end = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, len(local) + len(entry), 1)
    return local + entry + end + locator + struct.pack("<4sHHHHIIH", b"PK\5\6", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, big, big, 0)


def test_zip64_directory():
    data = zip64(b"big.warc", b"payload")
    (name, at, size), = members(data)
    assert name == "big.warc" and data[at : at + size] == b"payload"


@pytest.mark.parametrize("data", [b"", b"no zip", zip64(b"a", b"b")[:-30]])
def test_broken_zip(data):
    with pytest.raises((w.ZipError, struct.error)):
        members(data)


def test_records_come_back():
    warc, http, payload = w.parse_record(w.record("response", "urn:page:1", "http://x/", "d", b"a\r\n\r\nb", 6))
    assert (warc["warc-type"], http["content-length"], payload) == ("response", "6", b"a\r\n\r\nb")
    with pytest.raises(w.WarcError):
        w.parse_record(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort")


def test_archives_read_back_by_ranges(spark):
    rows = spark.createDataFrame([(i, f"http://h/{i} ü\n", b"p%d" % i * 50, "", None) for i in range(40)], "page_id long, url string, payload binary, digest string, refers_to long")
    rows = rows.selectExpr("page_id", "url", "payload", "sha1(payload) AS digest", "refers_to")
    folder = new_folder(spark, "warc")
    os.makedirs(folder.removeprefix("file://"))
    files = w.write_archives(rows.coalesce(2), folder, file_bytes=2000)
    assert files.count() > 2
    found = {r.record_id: bytes(r.payload) for r in w.read_records(w.index_ranges(files, range_bytes=300)).collect()}
    assert found == {f"urn:page:{i}": b"p%d" % i * 50 for i in range(40)}


def test_op9(spark, tmp_path):
    big, other = "x" * 1000, "é" * 500
    rows = [(1, "u", big), (5, None, big), (3, "u", big), (2, "u", "x" * 999), (4, "u", "x" * 999), (6, "u", None), (7, "u", ""), (None, "u", big), (8, "u", other), (5, "u", big), (None, "u", other + "z")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = w.op9_warc(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    digest = lambda s: hashlib.sha1(s.encode()).hexdigest()
    by = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in found}
    assert by == {(1, "revisit", 5, 1000, digest(big)), (5, "response", None, 1000, digest(big)), (3, "revisit", 5, 1000, digest(big)), (None, "revisit", 5, 1000, digest(big)), (2, "response", None, 999, digest("x" * 999)), (4, "response", None, 999, digest("x" * 999)), (6, "response", None, 0, digest("")), (7, "response", None, 0, digest("")), (8, "response", None, 1000, digest(other)), (None, "response", None, 1001, digest(other + "z"))}


def test_op9_of_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert w.op9_warc(spark, str(tmp_path)).count() == 0


def test_op9_very_long_pages_and_clashing_columns(spark, tmp_path):
    long = "<p>é</p>" * 400_000
    rows = [(1, "u", long, "x", 1, b"p"), (2, "u", long, "x", 1, b"p"), (3, "u", long + "!", None, None, None), (4, None, "", "x", 1, b"p"), (None, "u", long, "x", 1, b"p")]
    spark.createDataFrame(rows, "page_id long, url string, html string, digest string, kept int, payload binary").write.parquet(f"{tmp_path}/pages.parquet")
    found = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in w.op9_warc(spark, str(tmp_path)).collect()}
    n = len(long.encode())
    assert found == {(1, n, "revisit", 2), (2, n, "response", None), (3, n + 1, "response", None), (4, 0, "response", None), (None, n, "revisit", 2)}


def test_op1_takes_any_integer_id(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (None, "a")], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = m.op1_matroska(spark, str(tmp_path))
    assert dict(found.dtypes)["doc_id"] == "bigint" and len({r.media_sha256 for r in found.collect()}) == 1
