"""Web archives packed in ZIP files: WARC records in stored members, found by central (and ZIP64) directories and read by byte range without extraction."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, dealt, new_folder, texts_to_python, whole_text
from .files import Reader, opened

#: Payloads of at least so many bytes are stored once. Bytes of records after which another ZIP file begins. Bytes that one range read fetches at most, if a record isn't longer.
REVISIT_BYTES = 1000
FILE_BYTES = 32 << 20
RANGE_BYTES = 4 << 20
#: ZIP directories that a task parses, and records that one reads.
FILES_A_TASK, RECORDS_A_TASK = 8, 5000
MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class ZipError(ValueError):
    """Not a ZIP file, or one whose members can't be read in place."""


class WarcError(ValueError):
    """Not a WARC record."""


# ZIP directories


def central_directory(size: int, read) -> list[tuple[str, int, int]]:
    """(name, offset of the data, length) of the stored members; read(offset, length) gives bytes. Compressed or encrypted members are left out: they have no ranges."""
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ZipError("no end of central directory")
    _, disk, _, _, count, length, offset, _ = struct.unpack_from("<IHHHHIIH", tail, at)
    end = tail_at + at
    if disk not in (0, 0xFFFF):
        raise ZipError("it is a part of several")
    if end >= 20 and (locator := read(end - 20, 20))[:4] == b"PK\x06\x07":
        where = struct.unpack_from("<Q", locator, 8)[0]
        record = read(where, 56)
        if record[:4] != b"PK\x06\x06":
            raise ZipError("its ZIP64 locator points to no ZIP64 record")
        count, length, offset = struct.unpack_from("<QQQ", record, 32)
        end = where
    moved = end - length - offset  # bytes before the archive
    if moved < 0:
        raise ZipError("its central directory is cut off")
    data, at, out = read(offset + moved, length), 0, []
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ZipError(f"no directory entry at {at}")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, i = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while i + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, i)
            if kind == 1:  # ZIP64: only what is all ones before, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, i + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            i += 4 + n
        at += 46 + n_name + n_extra + n_comment
        if method == 0 and not flags & 1 and not name.endswith("/"):
            local = read(header + moved, 30)
            if local[:4] != b"PK\x03\x04":
                raise ZipError(f"no member at {header}")
            n_name, n_extra = struct.unpack_from("<HH", local, 26)
            out.append((name, header + moved + 30 + n_name + n_extra, packed))
    return out


# WARC records


def record(kind: str, name: str, uri: str, digest: str, payload: bytes, length: int, refers_to: str = "") -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    more = f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{refers_to}>\r\n" if kind == "revisit" else ""
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {uri}\r\nWARC-Payload-Digest: sha1:{digest}\r\n{more}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + len(payload)}\r\n\r\n"
    return head.encode() + http + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The WARC headers and the HTTP headers, names in lower case, and the payload."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/1."):
        raise WarcError(f"it starts with {data[:16]!r}")
    fields = lambda rows: {k.strip().lower(): v.strip() for k, _, v in (r.decode("utf-8", "replace").partition(":") for r in rows)}
    warc = fields(lines[1:])
    length = int(warc.get("content-length", -1))
    if length < 0 or length > len(rest):
        raise WarcError("its block is cut off")
    http, _, payload = rest[:length].partition(b"\r\n\r\n")
    return warc, fields(http.split(b"\r\n")[1:]), payload


def pack(records: list[bytes], names: list[str]) -> bytes:
    """A ZIP file: one stored member of records, each compressed on its own, and an index with each record's range in it."""
    out, parts, lines, at = io.BytesIO(), [], [], 0
    for name, data in zip(names, records):
        squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
        part = squeeze.compress(data) + squeeze.flush()
        parts.append(part)
        lines.append(json.dumps({"id": name, "filename": MEMBER, "offset": at, "length": len(part)}))
        at += len(part)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        z.writestr(zipfile.ZipInfo(MEMBER, (2024, 1, 1, 0, 0, 0)), b"".join(parts))
        z.writestr(zipfile.ZipInfo(INDEX, (2024, 1, 1, 0, 0, 0)), "".join(x + "\n" for x in lines))
    return out.getvalue()


# Frames


def with_revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the largest page_id with an equal payload of at least ``least_bytes``, and null on that row, on
    shorter payloads and where no such row has a page_id. Rows that repeat that page_id are all responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", whole_text("html").alias("payload")).withColumn("digest", F.sha1("payload"))
    counted = pages.select(F.col("page_id").cast("long").alias("page_id"), whole_text("html").alias("payload")).where(F.octet_length("payload") >= least_bytes)
    kept = counted.groupBy(F.sha1("payload").alias("kept_digest")).agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1 and kept is not null").select("kept_digest", "kept")
    joined = rows.join(kept, (rows["digest"] == kept["kept_digest"]) & (F.octet_length("payload") >= least_bytes), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("kept").eqNullSafe(F.col("page_id")), F.col("kept")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(uri, n): the ZIP files written from (page_id, url, payload, digest, refers_to). Task attempts write names of their own; only those in the returned, written table count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(folder)
        records, names, held, done = [], [], 0, []

        def flush() -> None:
            nonlocal records, names, held
            name = f"{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(f"{top}/{name}") as f:
                f.write(pack(records, names))
            done.append((f"{folder}/{name}", len(records)))
            records, names, held = [], [], 0

        for batch in batches:
            for page, url, payload, digest, refers in zip(*batch.columns):
                page, payload, refers = page.as_py(), payload.as_py(), refers.as_py()
                uri = quote(url.as_py() or "urn:page:unknown", safe=":/?#[]@!$&'()*+,;=%~-._")
                name = f"urn:page:{'' if page is None else page}"
                kind = "response" if refers is None else "revisit"
                records.append(record(kind, name, uri, digest.as_py(), payload if refers is None else b"", len(payload), f"urn:page:{refers}"))
                names.append(name)
                held += len(records[-1])
                if held >= file_bytes:
                    flush()
        if records:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["uri", "n"])

    return cut(texts_to_python(rows).mapInArrow(run, "uri string, n long"), "archives")


RECORDS = "uri string, record_id string, record_type string, target_uri string, refers_to string, declared_digest string, payload_bytes long, payload binary"


def index_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(uri, start, offsets, lengths): runs of records in the stored members of the ZIP files in column uri, each at most ``range_bytes`` or one record long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                members = {name: (at, length) for name, at, length in central_directory(reader.size(uri), lambda at, n: reader.at(uri, at, n))}
                runs: list[tuple[int, list[int], list[int]]] = []
                for name, (at, length) in members.items():
                    if not name.endswith(".cdxj"):
                        continue
                    for line in reader.at(uri, at, length).splitlines():
                        entry = json.loads(line)
                        where = members[entry["filename"]][0] + entry["offset"]
                        if not runs or where != runs[-1][0] + runs[-1][1][-1] + runs[-1][2][-1] or runs[-1][1][-1] + runs[-1][2][-1] + entry["length"] > range_bytes:
                            runs.append((where, [], []))
                        runs[-1][1].append(where - runs[-1][0])
                        runs[-1][2].append(entry["length"])
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(runs), pa.string()), *(pa.array([r[i] for r in runs], k) for i, k in enumerate(kinds))], names=["uri", "start", "offsets", "lengths"])

    return files.select("uri").mapInArrow(run, "uri string, start long, offsets array<long>, lengths array<long>")


def read_records(ranges: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of the ranges; the payload's length is the one that its HTTP header gives, which revisits keep too."""
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for uri, start, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                data, rows = reader.at(uri, start, offsets[-1] + lengths[-1]), []
                for at, n in zip(offsets, lengths):
                    warc, http, payload = parse_record(zlib.decompress(data[at : at + n], 31))
                    digest = warc["warc-payload-digest"].removeprefix("sha1:")
                    if warc["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise WarcError(f"{warc['warc-record-id']}: its payload's digest is not the one declared")
                    rows.append((uri, warc["warc-record-id"].strip("<>"), warc["warc-type"], warc.get("warc-target-uri"), warc.get("warc-refers-to", "").strip("<>") or None, digest, int(http.get("content-length", len(payload))), payload if payloads else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])

    return ranges.mapInArrow(run, RECORDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html is an empty payload; a null page_id stays null and is never referred to; repeated rows repeat; an empty table writes no archive."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = new_folder(spark, "warc")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    written = write_archives(with_revisits(pages), folder)
    ranges = index_ranges(dealt(written, FILES_A_TASK, "uri"))
    tasks = max(1, (written.agg(F.sum("n")).first()[0] or 0) // RECORDS_A_TASK)
    number = lambda c: F.expr(f"try_cast(nullif(substr({c}, 10), '') as bigint)")
    return read_records(ranges.repartition(tasks, "uri", "start"), payloads=False).select(number("record_id").alias("page_id"), "payload_bytes", F.col("declared_digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
