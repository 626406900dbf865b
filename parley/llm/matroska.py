"""Matroska media columns: write samples as laced blocks, parse files into packet tables.

Only what packet tables need is parsed: variable-length integers, element headers (known and unknown sizes), Info, Tracks, Clusters with SimpleBlock and
BlockGroup, the three lacings, and Cues. Void, CRC-32 and other elements are stepped over."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_to_python, whole_text

# Element ids of the public EBML and Matroska specifications.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
LACINGS = ("none", "xiph", "fixed", "ebml")  # by the two bits of a block's flags
TOP_LEVEL = frozenset((SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS))

FRAME, FRAMES_A_BLOCK, BLOCKS_A_CLUSTER, RATE, FILL = 576, 8, 32, 8000, 255


class MatroskaError(ValueError):
    """The bytes are not a Matroska file, or end too early."""


# Writing


def vint(value: int, width: int = 0) -> bytes:
    """A size: the least number of bytes that hold it, or ``width``. All ones are kept for the unknown size."""
    width = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def real(kind: int, value: float) -> bytes:
    return element(kind, struct.pack(">d", value))


HEADER = element(EBML, number(EBML_VERSION, 1) + number(EBML_READ_VERSION, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))


def lace(frames: list[bytes], kind: int) -> bytes:
    """What follows a block's flags."""
    if kind == 0:
        return frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3:
        head += vint(sizes[0])
        for was, n in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(n - was) < (1 << 7 * w - 1) - 1)
            head += vint(n - was + (1 << 7 * width - 1) - 1, width)
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return head + b"".join(frames)


def write_samples(payload: bytes, rate: int = RATE, frame: int = FRAME, frames_a_block: int = FRAMES_A_BLOCK, blocks_a_cluster: int = BLOCKS_A_CLUSTER) -> bytes:
    """A file with one track of unsigned 8-bit mono samples. Blocks take the three lacings in turn; a block of one frame has none."""
    ms = lambda first: first * frame * 1000 // rate
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + real(DURATION, len(payload) * 1000 / rate) + element(MUXING_APP, b"parley") + element(WRITING_APP, b"parley"))
    audio = element(AUDIO, real(SAMPLING_FREQUENCY, float(rate)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, frame * 1_000_000_000 // rate) + audio))
    clusters, cues, at = [], [], len(info) + len(tracks)
    step = frames_a_block * blocks_a_cluster
    for first in range(0, len(frames), step):
        start, blocks = ms(first), []
        for k, i in enumerate(range(first, min(first + step, len(frames)), frames_a_block)):
            part = frames[i : i + frames_a_block]
            kind = (2, 1, 3)[k % 3] if len(part) > 1 else 0
            if kind == 2 and len(part[-1]) != len(part[0]):
                kind = 3
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", ms(i) - start, 0x80 | kind << 1) + lace(part, kind)))
        clusters.append(element(CLUSTER, number(CLUSTER_TIMESTAMP, start) + b"".join(blocks)))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        at += len(clusters[-1])
    return HEADER + element(SEGMENT, info + tracks + b"".join(clusters) + element(CUES, b"".join(cues)))


# Reading


def read_vint(data: bytes, at: int, end: int, marked: bool = False) -> tuple[int, int]:
    """The value and where it ends; -1 for the unknown size. marked: with the length marker, as in element ids."""
    if at >= end or not data[at]:
        raise MatroskaError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise MatroskaError(f"an integer at {at} is cut off")
    value = int.from_bytes(data[at : at + width], "big")
    if marked:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start and end of its body) for the elements from ``at``."""
    while at < end:
        start = at
        kind, at = read_vint(data, at, end, True)
        length, at = read_vint(data, at, end)
        close = at + length if length >= 0 else end_of_cluster(data, at, end) if kind == CLUSTER else end
        if close > end:
            raise MatroskaError(f"element {kind:x} at {start} ends at {close}, its parent at {end}")
        yield kind, start, at, close
        at = close


def end_of_cluster(data: bytes, at: int, end: int) -> int:
    """A cluster of unknown size goes up to the next element of its parent."""
    while at < end:
        kind, body = read_vint(data, at, end, True)
        if kind in TOP_LEVEL:
            return at
        length, body = read_vint(data, body, end)
        if length < 0:
            raise MatroskaError(f"element {kind:x} at {at} has no size")
        at = body + length
    return end


def uint(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def lace_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """The frames' sizes and where the first one starts."""
    if kind == 0:
        return [end - at], at
    if at >= end:
        raise MatroskaError(f"a lace at {at} is cut off")
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise MatroskaError(f"a lace at {at} is cut off")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    elif kind == 3:
        for i in range(n - 1):
            start = at
            value, at = read_vint(data, at, end)
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << 7 * (at - start) - 1) - 1))
    else:
        if (end - at) % n:
            raise MatroskaError(f"{end - at} bytes in {n} frames of one size")
        sizes = [(end - at) // n] * (n - 1)
    rest = end - at - sum(sizes)
    if rest < 0 or min(sizes, default=0) < 0:
        raise MatroskaError(f"the frames of a lace at {at} are longer than their block")
    return [*sizes, rest], at


@dataclass
class Media:
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, timestamp in ns, offset, size, keyframe, lacing, offset of the cluster)
    packets: list[tuple[int, int, int, int, bool, str, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    #: (time in ns, track, offset of the cluster)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    blocks: int = 0


def parse(data: bytes) -> Media:
    """The packet table of one file. Raises MatroskaError for what isn't one, or is cut off."""
    out = Media()
    top = list(children(data, 0, len(data)))
    if not top or top[0][0] != EBML or not any(k == SEGMENT for k, *_ in top):
        raise MatroskaError("no EBML header or no segment")
    for _, _, at, end in (x for x in top if x[0] == SEGMENT):
        base = at
        for kind, start, a, e in children(data, at, end):
            if kind == INFO:
                for k, _, x, y in children(data, a, e):
                    if k == TIMESTAMP_SCALE:
                        out.scale = uint(data, x, y)
                    elif k == DURATION:
                        out.duration = struct.unpack(">d" if y - x == 8 else ">f", data[x:y])[0]
            elif kind == TRACKS:
                for k, _, x, y in children(data, a, e):
                    if k == TRACK_ENTRY:
                        own = {"type": 0, "codec": "", "default": 0, "rate": 0.0, "bits": 0}
                        for k2, _, x2, y2 in children(data, x, y):
                            if k2 == TRACK_NUMBER:
                                out.tracks[uint(data, x2, y2)] = own
                            elif k2 == TRACK_TYPE:
                                own["type"] = uint(data, x2, y2)
                            elif k2 == CODEC_ID:
                                own["codec"] = data[x2:y2].rstrip(b"\0").decode("ascii", "replace")
                            elif k2 == DEFAULT_DURATION:
                                own["default"] = uint(data, x2, y2)
                            elif k2 == AUDIO:
                                for k3, _, x3, y3 in children(data, x2, y2):
                                    if k3 == SAMPLING_FREQUENCY:
                                        own["rate"] = struct.unpack(">d" if y3 - x3 == 8 else ">f", data[x3:y3])[0]
                                    elif k3 == BIT_DEPTH:
                                        own["bits"] = uint(data, x3, y3)
            elif kind == CLUSTER:
                out.clusters.append(start)
                time = 0
                for k, _, x, y in children(data, a, e):
                    if k == CLUSTER_TIMESTAMP:
                        time = uint(data, x, y)
                    elif k == SIMPLE_BLOCK:
                        _block(out, data, x, y, time, start, None)
                    elif k == BLOCK_GROUP:
                        parts = list(children(data, x, y))
                        key = not any(k2 == REFERENCE_BLOCK for k2, *_ in parts)
                        for k2, _, x2, y2 in parts:
                            if k2 == BLOCK:
                                _block(out, data, x2, y2, time, start, key)
            elif kind == CUES:
                for k, _, x, y in children(data, a, e):
                    if k == CUE_POINT:
                        when, found = 0, []
                        for k2, _, x2, y2 in children(data, x, y):
                            if k2 == CUE_TIME:
                                when = uint(data, x2, y2)
                            elif k2 == CUE_TRACK_POSITIONS:
                                own = {k3: uint(data, x3, y3) for k3, _, x3, y3 in children(data, x2, y2)}
                                found.append((own.get(CUE_TRACK, 0), base + own.get(CUE_CLUSTER_POSITION, 0)))
                        out.cues += [(when * out.scale, t, p) for t, p in found]
    return out


def _block(out: Media, data: bytes, at: int, end: int, time: int, cluster: int, key: bool | None) -> None:
    track, at = read_vint(data, at, end)
    if at + 3 > end:
        raise MatroskaError(f"a block at {at} is cut off")
    shift, flags = struct.unpack_from(">hB", data, at)
    kind = flags >> 1 & 3
    sizes, at = lace_sizes(data, at + 3, end, kind)
    when, each = (time + shift) * out.scale, out.tracks.get(track, {}).get("default", 0)
    out.blocks += 1
    for i, size in enumerate(sizes):
        out.packets.append((track, when + i * each, at, size, bool(flags & 0x80) if key is None else key, LACINGS[kind], cluster))
        at += size


def read_samples(data: bytes, track: int = 1) -> tuple[bytes, Media]:
    """A track's samples in the order of its packets, and the packet table. Cues must point to clusters."""
    media = parse(data)
    if not {p for _, _, p in media.cues} <= set(media.clusters):
        raise MatroskaError("a cue points to no cluster")
    return b"".join(data[at : at + size] for t, _, at, size, *_ in media.packets if t == track), media


def features(samples: bytes, media: Media) -> str:
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    kinds = {k: 0 for k in LACINGS}
    for p in media.packets:
        kinds[p[5]] += 1
    signs = x >= 128
    return ";".join(f"{k}={v}" for k, v in {"tracks": len(media.tracks), "packets": len(media.packets), "blocks": media.blocks, "clusters": len(media.clusters), "cues": len(media.cues), **kinds, "ms": round(media.duration), "sum": int(x.sum()), "energy": int((x * x).sum()), "crossings": int((signs[1:] != signs[:-1]).sum()), "peak": int(x.max(initial=0))}.items())


def pad(data: bytes, unit: int = FRAME) -> bytes:
    """``data`` and as many bytes 255 as make a positive multiple of ``unit``."""
    return data + bytes([FILL]) * (max(1, -(-len(data) // unit)) * unit - len(data))


# Frames


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes as one Matroska file. A null text is an empty one; repeated rows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array((write_samples(pad(t)) for t in texts), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return texts_to_python(docs).select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


PACKETS = "id long, track long, timestamp_ns long, offset long, size long, keyframe boolean, lacing string, cluster long, error string"


def packet_table(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet of each file, with its byte range. A file that can't be parsed (null, empty or cut off too) gives one row with only the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                try:
                    rows = [(name.as_py(), *p, None) for p in parse(data.as_py() or b"").packets]
                except (MatroskaError, struct.error) as e:
                    rows = [(name.as_py(), *[None] * 7, str(e))]
                for i in range(0, len(rows), 10_000):
                    columns = zip(*rows[i : i + 10_000])
                    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in PACKETS.split(", ")])

    return texts_to_python(files).select(F.col(id_col).cast("long"), F.col(media_col)).mapInArrow(run, PACKETS)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(files: DataFrame) -> DataFrame:
    """What reading (doc_id, n_bytes, media) back gives."""
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, n, data in zip(*batch.columns):
                data = data.as_py()
                samples, media = read_samples(data)
                rows.append((name.as_py(), n.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(samples, media)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return texts_to_python(files).mapInArrow(run, DIGEST)


def op1_matroska(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` written as a file and read back. A null text is an empty one and has one packet; a null doc_id stays null; repeated rows repeat; an
    empty table gives no rows; other columns aren't read."""
    return digests(media_column(spark.read.parquet(f"{sf_dir}/documents.parquet")))
