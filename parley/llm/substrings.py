"""Repeated passages across documents: join on winnowed anchors, extend the matches both ways, cut maximal repeats."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_tables, fresh, texts_to_python, whole_text

WINDOW = 13
ANCHOR_WORDS = 5
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]))
        for i, x in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return [p[:n] for p in _powers]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Runs:
    """Hashes of runs of words, of any length, from one cumulated sum: a run's hash depends on its words alone, not on where it stands."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(word_hashes(words) * up[:n], out=self.sums[1:])

    def of(self, k: int) -> np.ndarray:
        """By where they start."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)

    def anchors(self, window: int, k: int) -> np.ndarray:
        """The distinct anchors of the windows, which are the least hashes of their runs of k words."""
        if len(self.sums) <= window:
            return np.empty(0, np.uint64)
        least, have, want = self.of(k), 1, window - k + 1
        while have < want:
            step = min(have, want - have)
            least = np.minimum(least[: len(least) - step], least[step:])
            have += step
        return np.unique(least[np.concatenate(([True], least[1:] != least[:-1]))])

    def picks(self, window: int, k: int) -> np.ndarray:
        """For each window where its anchor starts: the first of its runs of k words with the least hash. That depends on the window's words alone, so equal windows pick equal places."""
        if len(self.sums) <= window:
            return np.empty(0, np.int64)
        least, have, want = self.of(k), 1, window - k + 1
        at = np.arange(len(least))
        while have < want:
            step = min(have, want - have)
            later = least[step:] < least[: len(least) - step]
            at = np.where(later, at[step:], at[: len(at) - step])
            least = np.where(later, least[step:], least[: len(least) - step])
            have += step
        return at

    def seeds(self, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, place, first window, number of windows) of each anchor: the windows that pick one place follow each other."""
        picks = self.picks(window, k)
        if not len(picks):
            return (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
        first = np.flatnonzero(np.concatenate(([True], picks[1:] != picks[:-1])))
        return self.of(k)[picks[first]], picks[first], first, np.diff(np.append(first, len(picks)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, text): the rows that have an id; rows of equal id and text share a key."""
    text = whole_text(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col), text).alias("row_key"), text.alias("text")).where("doc_id is not null")


def row_key(doc_id, text):
    return F.xxhash64(doc_id.cast("long"), text)


def anchors(rows: DataFrame, window: int, k: int) -> DataFrame:
    """(anchor, doc_id, row_key): the distinct anchors of each of ``rows`` (doc_id, row_key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts, held, start = [], [], 0, 0
            for i, text in enumerate(batch.column(2)):
                own = Runs(text.as_py().split()).anchors(window, k)
                found.append(own)
                counts.append(len(own))
                held += len(own)
                if held > 200_000 or i == batch.num_rows - 1:
                    at = pa.array(np.repeat(np.arange(start, i + 1), counts))
                    yield pa.RecordBatch.from_arrays([_signed(np.concatenate(found)), batch.column(0).take(at), batch.column(1).take(at)], names=["anchor", "doc_id", "row_key"])
                    found, counts, held, start = [], [], 0, i + 1

    return texts_to_python(rows).select("doc_id", "row_key", "text").mapInArrow(run, "anchor long, doc_id long, row_key long")


CONTEXT = "anchor long, doc_id long, row_key long, hub boolean, first int, lead int, windows int, words binary"


def contexts(rows: DataFrame, window: int, k: int) -> DataFrame:
    """A row for each place of a shared anchor in ``rows`` (doc_id, row_key, text, anchors: array of (anchor, least document)): the words of all windows that pick it,
    the first of them and how many words of theirs stand before the anchor. hub: it is the first place of its text, in the least document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                parts: list[list[np.ndarray]] = []
                lines: list[bytes] = []
                for doc, key, text, shared in zip(*(c.slice(i, 200) for c in batch.columns)):
                    words = text.as_py().split()
                    hashes, places, firsts, counts = Runs(words).seeds(window, k)
                    pairs = shared.values
                    known, least = pairs.field("anchor").to_numpy(zero_copy_only=False).view(np.uint64), pairs.field("least").to_numpy(zero_copy_only=False)
                    order = np.argsort(known)
                    at = np.minimum(np.searchsorted(known, hashes, sorter=order), len(known) - 1)
                    hit = np.flatnonzero(known[order[at]] == hashes)
                    line = b" ".join(words)
                    starts = np.zeros(len(words) + 1, np.int64)
                    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
                    h, f, n = hashes.view(np.int64)[hit], firsts[hit], counts[hit]
                    hub = np.zeros(len(hit), bool)
                    hub[np.unique(h, return_index=True)[1]] = True
                    hub &= least[order[at[hit]]] == doc.as_py()
                    lines += [line[a:b] for a, b in zip(starts[f].tolist(), (starts[f + n + window - 1] - 1).tolist())]
                    own = [np.full(len(hit), x.as_py()) for x in (doc, key)]
                    parts.append([h, *own, hub, f, places[hit] - f, n])
                    if len(lines) > 50_000:
                        yield _contexts(parts, lines)
                        parts, lines = [], []
                if lines:
                    yield _contexts(parts, lines)

    return texts_to_python(rows).select("doc_id", "row_key", "text", "anchors").mapInArrow(run, CONTEXT)


def _contexts(parts: list[list[np.ndarray]], lines: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*parts), (*[pa.int64()] * 3, pa.bool_(), *[pa.int32()] * 3))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.binary())], names=[c.split(" ")[0] for c in CONTEXT.split(", ")])


HASHES = pa.struct([("high", pa.int64()), ("low", pa.int64())])
KINDS = {"array<struct<high:long,low:long>>": pa.list_(HASHES), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split(" ") for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[t]) for c, t in zip(zip(*rows) if rows else [()] * len(names), kinds)], names=list(names))


def extended(words: list[bytes], lead: int, hub: list[bytes], hub_lead: int) -> tuple[int, int]:
    """How far the match of an anchor at ``lead`` and one at ``hub_lead`` reaches, word by word to the left and to the right, as (first, end) of ``words``."""
    left = 0
    while left < lead and left < hub_lead and words[lead - left - 1] == hub[hub_lead - left - 1]:
        left += 1
    right, most = 0, min(len(words) - lead, len(hub) - hub_lead)
    while right < most and words[lead + right] == hub[hub_lead + right]:
        right += 1
    return lead - left, lead + right


MATCH = "doc_id long, row_key long, first int, end int, high long, low long, windows array<struct<high:long,low:long>>"


def halves(words: list[bytes]) -> tuple[int, int]:
    """128 bits of hash of some words, as two longs."""
    return struct.unpack(">qq", xxhash.xxh3_128_digest(b" ".join(words)))


def matches(seeds: DataFrame, window: int) -> DataFrame:
    """For ``seeds`` (a context with its hub's hub_doc, hub_lead, hub_words): the (first, end) words that the seed extends to in a smaller document; and each run of windows
    beyond that extent, which other documents may have, with 128 bits of hash of its words and of those of each of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key, first, lead, windows, words, hub_doc, hub_lead, hub_words = batch.columns
            same = pc.and_(pc.equal(words, hub_words), pc.equal(lead, hub_lead))
            gone = pc.and_(same, pc.less(hub_doc, doc))
            ends = pc.add(pc.add(first, windows), pa.scalar(window - 1, pa.int32()))
            found = pa.RecordBatch.from_arrays([doc, key, first, ends, *(pa.nulls(len(doc), t) for t in (pa.int64(), pa.int64(), pa.list_(HASHES)))], names=["doc_id", "row_key", "first", "end", "high", "low", "windows"])
            yield found.filter(gone)
            out: list[tuple] = []
            for doc_id, row_key, first, lead, windows, words, hub_doc, hub_lead, hub_words in zip(*(c.to_pylist() for c in batch.filter(pc.invert(same)).columns)):
                own = words.split(b" ")
                begin, end = extended(own, lead, hub_words.split(b" "), hub_lead)
                last = min(windows - 1, end - window)
                if last >= begin and hub_doc < doc_id:
                    out.append((doc_id, row_key, first + begin, first + last + window, None, None, None))
                for i, j in ((0, begin), (last + 1, windows)) if last >= begin else ((0, windows),):
                    if i < j:
                        out.append((doc_id, row_key, first + i, first + j - 1 + window, *halves(own[i : j - 1 + window]), [halves(own[x : x + window]) for x in range(i, j)]))
                if len(out) > 100_000:
                    yield _batch(out, MATCH)
                    out = []
            yield _batch(out, MATCH)

    columns = ("doc_id", "row_key", "first", "lead", "windows", "words", "hub_doc", "hub_lead", "hub_words")
    return seeds.select(*columns).mapInArrow(run, MATCH)


def shared(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, least): the keys that more than one document has, with the least of these. Combined before the shuffle, so a key that a third of all documents share costs a row a task."""
    return pairs.groupBy(*keys).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(*keys, "least")


def repeated_passages(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, extents): for each text the (first, end) words of the matches, of at least ``window`` words, with documents of smaller ids.

    Every window has one anchor, a run of k words picked by winnowing; equal windows have equal anchors. Documents are joined on anchors: each place of a shared
    anchor is a seed, and is extended both ways, word by word, against one place in the least document that has it, its hub. An extent in a smaller document
    settles its windows, and so it does in every document, as all are compared with the same hub. The few windows beyond the extents may still be shared by
    documents that differ from the hub, and if the hub itself was edited, by a whole crowd of them. First whole runs of such windows are joined on 128 bits of hash of their words
    (among 10^13 windows two differing ones are equal with a probability of 10^-13): what a smaller document has as well is settled in one row. Then the windows of the least
    documents' runs are joined in the same way; the least document of a window is among those. So pairs of documents are never listed, and nothing is missed."""
    rows = keyed(docs, id_col, text_col)
    found = cut(anchors(rows, window, k), "anchors")
    seeds = cut(shared(found, "anchor"), "seeds")
    lists = cut(found.join(seeds, "anchor").groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("anchor", "least")).alias("anchors")), "seeded")
    drop_tables(found, seeds)
    places = cut(contexts(rows.join(lists, ["doc_id", "row_key"]), window, k), "contexts")
    drop_tables(lists)
    hub = F.min(F.struct("doc_id", "row_key", "lead", "words")).alias("h")
    hubs = cut(places.where("hub").groupBy("anchor").agg(hub).select("anchor", F.col("h.doc_id").alias("hub_doc"), F.col("h.lead").alias("hub_lead"), F.col("h.words").alias("hub_words")), "hubs")
    found = cut(matches(places.join(hubs, "anchor"), window), "matches")
    drop_tables(places, hubs)
    runs = found.where("high is not null")
    first_runs = cut(shared(runs, "high", "low"), "firsts")
    marked = cut(runs.join(first_runs, ["high", "low"], "left"), "runs")
    place = F.posexplode("windows").alias("at", "window")
    rest = marked.where("least is null or least = doc_id").select("doc_id", "row_key", "first", place).select("doc_id", "row_key", (F.col("first") + F.col("at")).alias("first"), "window.high", "window.low")
    firsts = cut(shared(rest, "high", "low"), "firsts")
    late = rest.join(firsts, ["high", "low"]).where("least < doc_id").select("doc_id", "row_key", "first", (F.col("first") + window).alias("end"))
    settled = found.where("high is null").union(marked.where("least < doc_id").select(found.columns))
    every = settled.select("doc_id", "row_key", "first", "end").union(late)
    out = cut(every.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("first", "end")).alias("extents")), "repeats")
    drop_tables(found, first_runs, marked, firsts)
    return out


def covered(n: int, extents: pa.StructArray) -> np.ndarray:
    """Whether each of n words is in one of the extents."""
    out = np.zeros(n + 1, np.int64)
    np.add.at(out, extents.field("first").to_numpy(zero_copy_only=False), 1)
    np.add.at(out, extents.field("end").to_numpy(zero_copy_only=False), -1)
    return np.cumsum(out[:-1]) > 0


def spans(gone: np.ndarray) -> list[tuple[int, int]]:
    """The maximal repeats: runs of removed words, as (first, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def without(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the removed words; what stays keeps its own spacing, runs are joined by a space."""
    at = [m.span() for m in WORD.finditer(text)]
    return b" ".join(text[at[a][0] : at[b - 1][1]] for a, b in spans(~gone))


def _attach(docs: DataFrame, repeats: DataFrame, names: list[str]):
    """``docs`` with the extents of each row (null: none) in one more column, whose name is also returned."""
    taken, columns = list(names), []
    for c in ("repeat_id", "repeat_key", "repeat_extents"):
        columns.append(fresh(taken, c))
        taken.append(columns[-1])
    key, other, own = columns
    right = repeats.select(F.col("doc_id").alias(key), F.col("row_key").alias(other), F.col("extents").alias(own))
    on = (docs["doc_id"].cast("long") == right[key]) & (row_key(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).cast("binary")) == right[other])
    return docs.join(right, on, "left").select(*(docs[c] for c in names), own), own


REPEATS = "doc_id long, n_words long, n_removed long, kept_sha256 string, repeats array<struct<first:int,end:int>>"


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row how many words it has, how many of them repeated passages cover, the SHA-256 of the rest joined by spaces, and the maximal repeats as (first, end) words.

    Null texts have no words. A row without doc_id loses none and takes none; rows that repeat a doc_id are judged each by its own text against smaller ids; an
    empty table gives no rows; other columns aren't read."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined, own = _attach(docs, repeated_passages(docs, window), ["doc_id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1), batch.column(2)):
                words = text.as_py().split()
                gone = covered(len(words), found.values) if found.is_valid else np.zeros(len(words), bool)
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if found.is_valid else words
                rows.append((len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"first": a, "end": b} for a, b in spans(gone)]))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "repeats"])

    return texts_to_python(joined).select("doc_id", whole_text().alias("text"), own).mapInArrow(run, REPEATS)


def op7_substrings(spark, sf_dir: str, window: int = WINDOW) -> DataFrame:
    """Null texts have no words. A row without doc_id loses none and takes none; rows that repeat a doc_id are judged each by its own text against smaller ids."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), window).drop("repeats")


def oracle(window: int = WINDOW) -> str:
    """The same in DuckDB SQL, window by window."""
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - {window - 2})) AS i FROM d WHERE len(ws) >= {window}),
w AS (SELECT rid, doc_id, i, array_to_string(ws[i:i + {window - 1}], ' ') AS win FROM g),
m AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM w) WHERE least < doc_id),
gone AS (SELECT DISTINCT rid, i + o AS i FROM m, (SELECT unnest(range(0, {window})) AS o)),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid),
word AS (SELECT rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS k FROM word ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)"""


def cut_repeats(spark, docs: DataFrame, sf_dir: str, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated passages cut out of their texts and n_chars counted anew. No row goes; a text without repeats (a null one too) stays as it is."""
    names = docs.columns
    joined, own = _attach(docs, repeated_passages(docs, window), names)

    @F.arrow_udf("string")
    def edit(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for t, f in zip(texts, found):
            if t.is_valid and f.is_valid:
                data = t.as_py().encode()
                out.append(without(data, covered(len(data.split()), f.values)).decode())
            else:
                out.append(t.as_py())
        return pa.array(out, pa.string())

    edited = texts_to_python(joined).withColumn("text", edit("text", own))
    if "n_chars" in names:
        edited = edited.withColumn("n_chars", F.when(F.col(own).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return edited.select(*names)
