"""Importance resampling towards a target distribution, by hashed word n-grams.

Each partition keeps a trie of words: a node for each word and, below it, for each word that follows. A node holds how often its path was seen and the CRC-32
of the path's bytes, which its children's continue; so each feature is hashed once a partition, and only totals by bucket leave it."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_tables, read, texts_to_python, whole_text

BUCKETS = 10_000
#: So many hundredths of the documents that may be drawn are drawn; they have so many words at least.
SHARE, LEAST_WORDS = 25, 20
#: Begins the text whose hash draws a document's chance.
SEED = "7:"
#: Nodes that a trie holds before it is counted off and begun anew, and bytes of a text that are cut into words at once. They bound memory and change no result.
WORD_NODES, PAIR_NODES, PIECE = 300_000, 600_000, 1 << 20
#: ``bytes.translate`` table: A-Z in lower case, what belongs to no word as a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(data: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, some at a time."""
    data, at = data.translate(_WORDS), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Level(dict):
    """Nodes of one depth by key, made when first asked for."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key) -> int:
        node = self[key] = self.make(key)
        return node


class Trie:
    """Words and pairs of words with the CRC-32 of their bytes. Pairs have the key (first node << 32) + second node."""

    def __init__(self):
        self.words, self.pairs = Level(self._word), Level(self._pair)
        self.clear()

    def clear(self) -> None:
        self.words.clear()
        self.pairs.clear()
        self.next, self.word_crc, self.pair_crc = [], array("L"), array("L")

    def _word(self, word: bytes) -> int:
        self.word_crc.append(zlib.crc32(word))
        self.next.append(b" " + word)
        return len(self.next) - 1

    def _pair(self, key: int) -> int:
        self.pair_crc.append(zlib.crc32(self.next[key & 0xFFFFFFFF], self.word_crc[key >> 32]))
        return len(self.pair_crc) - 1

    def walk(self, words: list[bytes], before: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of words in a row, and of the pairs that end with them; ``before``: the word before the first."""
        nodes = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        all_ = nodes if before is None else np.r_[self.words[before], nodes]
        keys = ((all_[:-1] << 32) + all_[1:]).tolist()
        return nodes, np.fromiter(map(self.pairs.__getitem__, keys), np.int64, len(keys))

    @property
    def full(self) -> bool:
        return len(self.word_crc) >= WORD_NODES or len(self.pair_crc) >= PAIR_NODES


def buckets_of(crc: array, start: int = 0) -> np.ndarray:
    return (np.array(crc[start:], np.uint64) % np.uint64(BUCKETS)).astype(np.int64)


class Counts:
    """How often the nodes of a trie were seen, and the totals by bucket of tries counted off before."""

    def __init__(self):
        self.trie, self.totals, self.seen, self.n = Trie(), np.zeros(BUCKETS, np.int64), [], 0
        self.at_node = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def add(self, data: bytes) -> None:
        before = None
        for words in pieces(data):
            if words:
                found = self.trie.walk(words, before)
                self.seen.append(found)
                self.n, before = self.n + len(words), words[-1]
            if self.n > 200_000 or self.trie.full:
                self.count()

    def count(self, last: bool = False) -> None:
        """Adds what was seen to the nodes' counts, and those to the totals once the trie is full."""
        for depth, crc in enumerate((self.trie.word_crc, self.trie.pair_crc)):
            found = np.bincount(np.concatenate([s[depth] for s in self.seen] or [np.zeros(0, np.int64)]), minlength=len(crc))
            found[: len(self.at_node[depth])] += self.at_node[depth]
            self.at_node[depth] = found
            if last or self.trie.full:
                np.add.at(self.totals, buckets_of(crc), found)
        if last or self.trie.full:
            self.trie.clear()
            self.at_node = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.seen, self.n = [], 0


def bucket_totals(texts: DataFrame) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            for t in batch.column(0):
                counts.add(t.as_py())
        counts.count(last=True)
        found = np.flatnonzero(counts.totals)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts.totals[found])], names=["bucket", "n"])

    parts = texts_to_python(texts).select(whole_text().alias("text")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, in thousandths of its log ratio of smoothed shares, rounded down. At most BUCKETS rows of each side come to the driver."""
    totals = np.zeros((2, BUCKETS))
    for i, texts in enumerate((documents, target)):
        for bucket, n in bucket_totals(texts).collect():
            totals[i, bucket] = n
    (s, t), (all_s, all_t) = totals, totals.sum(axis=1)
    return np.floor(1000 * np.log((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS)))).astype(np.int64)


class Gains:
    """A trie with the gain of each node attached."""

    def __init__(self, by_bucket: np.ndarray):
        self.by_bucket, self.trie = by_bucket, Trie()
        self.at_node = [np.zeros(WORD_NODES, np.int64), np.zeros(PAIR_NODES, np.int64)]
        self.known = [0, 0]

    def of(self, data: bytes) -> tuple[int, int]:
        """(words, sum of gains) of a text."""
        n, total, before = 0, 0, None
        for words in pieces(data):
            if self.trie.full:
                self.trie.clear()
                self.known = [0, 0]
            if not words:
                continue
            found = self.trie.walk(words, before)
            n, before = n + len(words), words[-1]
            for depth, crc in enumerate((self.trie.word_crc, self.trie.pair_crc)):
                if self.known[depth] < len(crc):
                    new = self.by_bucket[buckets_of(crc, self.known[depth])]
                    if len(crc) > len(self.at_node[depth]):
                        self.at_node[depth] = np.concatenate([self.at_node[depth], np.zeros(len(crc), np.int64)])
                    self.at_node[depth][self.known[depth] : len(crc)] = new
                    self.known[depth] = len(crc)
                total += int(self.at_node[depth][found[depth]].sum())
        return n, total


def weights(documents: DataFrame, by_bucket: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row: the mean gain of its features, rounded down; 0 without features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Gains(by_bucket)
        for batch in batches:
            found = [trie.of(t.as_py()) for t in batch.column(1)]
            words = np.array([n for n, _ in found], np.int64)
            features = np.maximum(2 * words - 1, 0)
            means = [total // max(2 * n - 1, 1) for n, total in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(means, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    rows = texts_to_python(documents).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def chance(doc_id: str = "doc_id") -> Column:
    """A document's Gumbel draw, in thousandths, rounded down: of its id alone. A row without id draws by the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with rank: 1, 2, 3 and so on for the highest scores of rows with enough words, as many as their share, ties to smaller ids, rows without id last; null for others.

    Scores are whole numbers in a bounded range: their counts say how many rows are above each, and only rows of one score are put in order, so no task sees all.
    Scores of which no row can be drawn aren't ordered."""
    able = F.col("n_words") >= least_words
    counts = scored.where(able).groupBy(F.col("score").alias("level")).agg(F.count(F.lit(1)).alias("m"))
    above = F.sum("m").over(Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m")
    drawn = F.floor(F.sum("m").over(Window.partitionBy()) * share / 100).cast("long")
    levels = cut(counts.select("level", above.alias("above"), drawn.alias("drawn")), "levels")
    joined = scored.join(levels.where("above < drawn"), able & (F.col("score") == F.col("level")), "left")
    place = F.col("above") + F.row_number().over(Window.partitionBy("level").orderBy(F.col("doc_id").isNull(), "doc_id", "n_features"))
    ordered = joined.where("level is not null").withColumn("rank", place)
    ordered = ordered.withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).cast("long"))
    others = joined.where("level is null").withColumn("rank", F.lit(None).cast("long"))
    return ordered.unionByName(others).drop("level", "above", "drawn")


def resample(documents: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of ``documents``, drawn to be like the texts of ``target``.

    Null texts have no words: no features, weight 0. Rows that repeat an id are each weighed by their own text, with the same chance. An empty target leaves all
    buckets with the same share of it; an empty table of documents gives no rows. Other columns are not read."""
    scored = weights(documents, gains(documents, target)).withColumn("score", F.col("weight") + chance())
    return ranked(cut(scored, "scored"), share, least_words)


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    """``resample`` for all of ``documents`` towards ``benchmark``; it says what nulls, ties, repeated rows and empty tables give."""
    found = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def oracle() -> str:
    """The same in DuckDB SQL, with CRC-32 byte by byte over each distinct feature."""
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{az}', '{az.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""WITH RECURSIVE t(n, c, k) AS (SELECT n, n, 0 FROM (SELECT CAST(unnest(range(0, 256)) AS BIGINT) AS n) UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM t WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS crcs FROM t WHERE k = 8),
w AS (SELECT 'd' AS side, row_number() OVER () AS rid, {words} AS ws FROM documents UNION ALL SELECT 'b', row_number() OVER (), {words} FROM benchmark),
f AS (SELECT side, rid, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS f FROM w WHERE len(ws) > 0),
c AS (SELECT side, rid, f, count(*) AS n FROM f GROUP BY ALL),
u AS (SELECT DISTINCT f FROM c),
h AS (SELECT f, hex(encode(f)) AS x FROM u),
b AS (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(x) // 2), lambda i: CAST(('0x' || x[2 * i + 1:2 * i + 2]) AS BIGINT))), lambda s, v: xor(s // 256, crcs[xor(s % 256, v) + 1])), 4294967295) % {BUCKETS} AS bucket FROM h, crc),
n AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM c JOIN b USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * ((SELECT sum(s) FROM n) + {BUCKETS}) / (CAST(s + 1 AS DOUBLE) * ((SELECT sum(t) FROM n) + {BUCKETS})))) AS BIGINT) AS gain FROM n),
m AS (SELECT rid, sum(n) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM c JOIN b USING (f) JOIN g USING (bucket) WHERE side = 'd' GROUP BY rid),
d AS (SELECT row_number() OVER () AS rid, doc_id, CAST(('0x' || substr(sha256('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h FROM documents),
s AS (SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM d LEFT JOIN m USING (rid)),
a AS (SELECT *, n_features >= {2 * LEAST_WORDS - 1} AS able FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS all_ FROM a)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= {SHARE} * all_ // 100 THEN place END AS rank FROM r"""
