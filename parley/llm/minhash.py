"""MinHash near-duplicates: candidates by bands, b-bit signatures to sift them, full sets to confirm them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, bitmap, components, cut, drop_tables, read, texts_to_python, whole_text

SHINGLE_WORDS = 3
#: Texts are linked whose sets share at least LEAST of ALL parts of their union.
LEAST, ALL = 85, 100
#: Bands, and the orders of each, by level. At similarity 0.85 a pair shares no band of the first level with probability (1 - 0.85^6)^40 = 6e-9; none of the second, which
#: only members of crowded bands reach, with probability (1 - 0.85^16)^220 = 4e-8.
LEVELS = ((40, 6), (220, 16))
#: Low bits of each minimum, and minima, of a signature, by level; they are packed into longs. Single bits tell most for their size, but need many minima; only members of
#: crowded bands, whose bands are made of as many, have such. The least estimate that a pair at 0.85 may have is 0.70 by the first, 0.79 by the second.
SIGNATURES = ((4, 256), (1, 3520))
#: Behind its minima a signature has a bitmap of the set's hashes, in so many bits: what differs in two bitmaps differs in the sets, so it rules pairs out for certain, and most of those just below the threshold if sets have up to about as many shingles.
SKETCH_BITS = 2048
#: Standard deviations that the estimate for a similar pair may fall short: beyond this many with probability 1e-10.
MARGIN = 6.4
#: Rounds of comparisons with one hub a band, before pairs; bands of more unsettled members than CROWD go to the next level instead of to pairs.
HUB_ROUNDS, CROWD = 2, 64

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ORDERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def minima(hashes: np.ndarray, n: int) -> np.ndarray:
    """The least of a set's hashes, by their upper 32 bits, in each of ``n`` orders. Two sets share that of an order with a probability equal to their similarity, or little more, as 32 bits of different hashes may be equal."""
    if n not in _ORDERS:
        _ORDERS[n] = tuple(np.array([xxhash.xxh32_intdigest(b"order %d" % i, k) | k for i in range(n)], np.uint32) for k in (0, 1))
    seeds, factors = _ORDERS[n]
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(n, ~np.uint32(0))
    step = max(1, (1 << 17) // n)
    space = np.empty((min(step, len(short)), n), np.uint32)
    for i in range(0, len(short), step):
        part = short[i : i + step, None]
        ordered = np.bitwise_xor(part, seeds, out=space[: len(part)])
        np.multiply(ordered, factors, out=ordered)
        np.minimum(least, ordered.min(axis=0), out=least)
    return least


def packed(least: np.ndarray, level: int = 0) -> np.ndarray:
    """The signature of a level: the low bits of as many mixed minima as it asks for, side by side in longs."""
    bits, n = SIGNATURES[level]
    low = ((least[:n].astype(np.uint64) * _MIX) >> np.uint64(64 - bits)).reshape(-1, 64 // bits)
    return np.bitwise_or.reduce(low << (np.arange(64 // bits, dtype=np.uint64) * np.uint64(bits)), axis=1).view(np.int64)


def signature(hashes: np.ndarray, least: np.ndarray, level: int = 0) -> np.ndarray:
    """The packed minima of a set, then its bitmap."""
    return np.concatenate([packed(least, level), bitmap(hashes, SKETCH_BITS)])


def band_keys(least: np.ndarray, level: int) -> np.ndarray:
    """One key for each band of a level: a hash of the minima of the band's orders."""
    bands, orders = LEVELS[level]
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), band) for band, x in enumerate(least[: bands * orders].reshape(bands, orders))], np.uint64).view(np.int64)


def orders_of(level: int) -> int:
    """The orders that a level's bands and signatures need."""
    bands, orders = LEVELS[level]
    return max(SIGNATURES[level][1], bands * orders)


def shingle_set(data: bytes, shingle_words: int) -> np.ndarray:
    """A text's set of lower-cased word shingles, as sorted 64-bit hashes made of those of the words. A text of fewer words is one shingle; one without words has none."""
    words = data.translate(LOWER_AZ).split()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(shingle_words, len(words))
    if not size:
        return hashes
    mixed = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX + hashes[i : len(words) - size + 1 + i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= _MIX
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def sketches(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, text_hash, k1, k2, n, bands, signature) of each row: 128 bits that name its set, the set's size, band keys and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = orders_of(0)
        for batch in batches:
            keys, sizes, bands, signatures = [], [], [], []
            for t in batch.column(2):
                s = shingle_set(t.as_py(), shingle_words)
                least = minima(s, orders)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                bands.append(band_keys(least, 0) if len(s) else None)
                signatures.append(signature(s, least))
            halves = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            columns = [batch.column(0), batch.column(1), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "k1", "k2", "n", "bands", "signature"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), whole_text().alias("text"))
    return texts_to_python(rows).mapInArrow(run, "doc_id long, text_hash long, k1 long, k2 long, n long, bands array<long>, signature array<long>")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def matches(a: Column, b: Column, level: int = 0) -> Column:
    """How many of the minima behind two signatures agree in their low bits: the groups of bits in which nothing differs, counted by bits."""
    bits, n = SIGNATURES[level]
    ones = sum(1 << (bits * i) for i in range(64 // bits))
    ones = F.lit(ones - (1 << 64) if ones >> 63 else ones).cast("long")

    def differing(i: int) -> Column:
        x = a[i].bitwiseXOR(b[i])
        return F.bit_count(reduce(Column.bitwiseOR, [F.shiftrightunsigned(x, k) for k in range(bits)]).bitwiseAND(ones))

    return F.lit(n) - reduce(Column.__add__, [differing(i) for i in range(n * bits // 64)])


def estimate(a: Column, b: Column, level: int = 0) -> Column:
    """The similarity that two signatures tell of: minima that differ agree by chance in one of 2^bits cases, which is taken off."""
    bits, n = SIGNATURES[level]
    chance = 2.0**-bits
    return (matches(a, b, level) / F.lit(float(n)) - chance) / (1 - chance)


def lowest_estimate(similarity: float, level: int = 0) -> float:
    """Pairs of this similarity are estimated lower with probability 1e-10 only."""
    bits, n = SIGNATURES[level]
    chance = 2.0**-bits
    p = similarity + (1 - similarity) * chance
    return similarity - MARGIN * (p * (1 - p) / n) ** 0.5 / (1 - chance)


def may_be_linked(least: int, all_: int, level: int) -> Column:
    """Of columns a_n, a_signature, b_n, b_signature: false only for pairs that sizes or bitmaps rule out, or estimates but for that probability. A signature may lack its bitmap."""
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    bits, n = SIGNATURES[level]
    differing = [F.bit_count(F.get("a_signature", F.lit(i)).bitwiseXOR(F.get("b_signature", F.lit(i)))) for i in range(n * bits // 64, (n * bits + SKETCH_BITS) // 64)]
    # of a + b hashes, twice those shared are what doesn't differ
    close = F.coalesce(reduce(Column.__add__, differing) * (all_ + least) <= (small + large) * (all_ - least), F.lit(True))
    return (small * all_ >= large * least) & close & (estimate(F.col("a_signature"), F.col("b_signature"), level) >= lowest_estimate(least / all_, level))


class Search:
    """Looks for links between the classes (cid, n, signature, own_id, own_hash) of equal sets, whose texts are in ``docs``; ``roots`` (node, root) is what those found so far join."""

    def __init__(self, docs: DataFrame, classes: DataFrame, shingle_words: int, least: int, all_: int):
        self.docs, self.classes, self.shingle_words, self.least, self.all_ = docs, classes, shingle_words, least, all_
        self.roots = docs.sparkSession.createDataFrame([], "node long, root long")

    def texts(self, cids: DataFrame) -> DataFrame:
        """(cid, text): the text of each of some classes, from the row that stands for it. Of rows that repeat it one is taken."""
        own = self.classes.join(cids, self.classes["cid"] == cids[cids.columns[0]], "left_semi").select("cid", "own_id", "own_hash")
        rows = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), whole_text().alias("text"))
        found = rows.join(own, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")))
        return cut(found.groupBy("cid").agg(F.first("text").alias("text")), "texts")

    def sifted(self, pairs: DataFrame, known: DataFrame, level: int) -> DataFrame:
        """The (a, b) of ``pairs`` that sizes and signatures, from ``known`` (cid, n, signature), don't rule out. What is known of an a is joined once for all its pairs."""
        of_a, of_b = (known.select(F.col("cid").alias(side), F.col("n").alias(f"{side}_n"), F.col("signature").alias(f"{side}_signature")) for side in "ab")
        tried = pairs.groupBy("a").agg(F.collect_list("b").alias("bs")).join(of_a, "a").select("a", "a_n", "a_signature", F.explode("bs").alias("b"))
        return tried.join(of_b, "b").where(may_be_linked(self.least, self.all_, level)).select("a", "b")

    def confirm(self, pairs: DataFrame) -> None:
        """Joins the components of those (a, b) of ``pairs`` whose full sets are similar enough."""
        likely = cut(pairs, "likely")
        if not likely.limit(1).count():
            return
        texts = self.texts(likely.select(F.explode(F.array("a", "b")).alias("needed")).distinct())
        words, least, all_ = self.shingle_words, self.least, self.all_

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hub, hubs = None, np.zeros(0, np.uint64)
            for batch in batches:
                good = []
                for i, (b, x, y) in enumerate(zip(batch.column(1), batch.column(2), batch.column(3))):
                    if b.as_py() != hub:  # rows come by hub, mostly
                        hub, hubs = b.as_py(), shingle_set(y.as_py(), words)
                    s = shingle_set(x.as_py(), words)
                    both = len(np.intersect1d(s, hubs, assume_unique=True))
                    if both and both * all_ >= (len(s) + len(hubs) - both) * least:
                        good.append(i)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in (0, 1)], names=["a", "b"])

        both = likely.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("a_text")), "a").join(texts.select(F.col("cid").alias("b"), F.col("text").alias("b_text")), "b")
        found = cut(texts_to_python(both).select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long").distinct(), "links")
        drop_tables(likely, texts)
        if not found.limit(1).count():
            return
        stars = self.roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        self.roots = components(found.union(stars))

    def settle(self, known: DataFrame, level: int = 0) -> None:
        """Finds the links between classes ``known`` (cid, n, bands, signature) that share a band.

        In each round every band's members are compared with one of them, its hub, and the hub, whose links are then known, leaves the band; so a group of
        near copies becomes a star and not its pairs. What is in one component with its hub already, by an earlier round or level, isn't compared with it. Hubs are the first in one order of all classes, so that a group has few of them over its bands. Bands whose members are joined to each other by then are settled. Of others, those with up to CROWD
        members are tried by pairs, so a member has CROWD pairs a band at most; members of larger ones are banded again by more orders, where what is only
        somewhat similar seldom meets, and get longer signatures, which tell better what is just below the threshold. Pairs are tried inside the join, and only those that sizes and signatures don't rule out come out of it."""
        roots = self.roots
        banded = known.join(roots, known["cid"] == roots["node"], "left").select(F.explode("bands").alias("band"), "cid", F.coalesce("root", "cid").alias("root"))
        members, done = banded, []
        for round_ in range(HUB_ROUNDS):
            hubs = members.groupBy("band").agg(F.min_by(F.struct("cid", "root"), F.xxhash64("cid", F.lit(round_))).alias("hub"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band", F.col("hub.cid").alias("hub"), F.col("hub.root").alias("hub_root"))
            tied = cut(members.join(hubs, "band").where("cid <> hub"), "tied")
            pairs = tied.where("root <> hub_root").select(F.greatest("cid", "hub").alias("a"), F.least("cid", "hub").alias("b")).distinct()
            self.confirm(self.sifted(reduce(lambda p, d: p.join(d, ["a", "b"], "left_anti"), done, pairs), known, level))
            done.append(pairs)
            members, before = cut(self.unsettled(tied.select("band", "cid")), "members"), members
            if before is not banded:
                drop_tables(before)
            if not members.limit(1).count():
                return
        crowded = cut(members.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > CROWD).select("band"), "crowded")
        deeper = level + 1 < len(LEVELS) and crowded.limit(1).count()
        if deeper:
            again = cut(members.join(crowded, "band", "left_semi").select("cid").distinct(), "again")
            members = members.join(crowded, "band", "left_anti")
        rooted = cut(self.rooted(members).join(known.select("cid", "n", "signature"), "cid"), "rooted")
        a, b = (rooted.select(F.col("cid").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("band", "root", "n", "signature"))) for k in "ab")
        likely = a.join(b, (F.col("a_band") == F.col("b_band")) & (F.col("a") > F.col("b")) & (F.col("a_root") != F.col("b_root")) & may_be_linked(self.least, self.all_, level)).select("a", "b").distinct()
        self.confirm(reduce(lambda p, d: p.join(d, ["a", "b"], "left_anti"), done, likely))
        drop_tables(rooted, members)
        if deeper:
            further = self.banded_again(again, level + 1)
            self.settle(further, level + 1)
            drop_tables(again, further)

    def rooted(self, members: DataFrame) -> DataFrame:
        roots, members = self.roots, members.select("band", "cid")
        return members.join(roots, members["cid"] == roots["node"], "left").select("band", "cid", F.coalesce("root", "cid").alias("root"))

    def unsettled(self, members: DataFrame) -> DataFrame:
        """The members of bands that hold more than one component."""
        rooted = self.rooted(members)
        mixed = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
        return rooted.join(mixed, "band").select("band", "cid", "root")

    def banded_again(self, cids: DataFrame, level: int) -> DataFrame:
        """(cid, n, bands, signature) by the orders of a further level, one row a class."""
        words = self.shingle_words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, bands, signatures = [], [], []
                for text in batch.column(1):
                    s = shingle_set(text.as_py(), words)
                    least = minima(s, orders_of(level))
                    sizes.append(len(s))
                    bands.append(band_keys(least, level))
                    signatures.append(signature(s, least, level))
                columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["cid", "n", "bands", "signature"])

        return cut(texts_to_python(self.texts(cids)).mapInArrow(run, "cid long, n long, bands array<long>, signature array<long>"), "banded")


def groups(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, least: int = LEAST, all_: int = ALL, link_empty: bool = False) -> DataFrame:
    """(doc_id, k1, k2, n, component_id): each row of ``docs`` with the name and size of its set and the smallest doc_id that links between similar sets lead to.

    Null texts are empty texts. Texts without words are linked with nothing, or with each other where link_empty is set. Equal sets are one class from the start.
    A row without doc_id passes links on but names no component; a component without any id has a null component_id. Rows that repeat a doc_id are each judged
    by their own text. An empty table gives an empty result. Other columns are not read."""
    rows = cut(sketches(docs, shingle_words), "minhash")
    one = F.min_by(F.struct("text_hash", "n", "bands", "signature"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("own_id"), one.alias("one")).select("k1", "k2", "own_id", F.col("one.text_hash").alias("own_hash"), "one.n", "one.bands", "one.signature")
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    search = Search(docs, classes, shingle_words, least, all_)
    search.settle(classes.select("cid", "n", "bands", "signature"))
    roots = search.roots
    rooted = classes.join(roots, classes["cid"] == roots["node"], "left").select("k1", "k2", "own_id", F.coalesce("root", "cid").alias("root"))
    best = rooted.groupBy("root").agg(F.min("own_id").alias("component_id"))
    named = cut(rooted.join(best, "root").select("k1", "k2", "component_id"), "named")
    light = rows.select("doc_id", "k1", "k2", "n")
    linked = light.where("n > 0").join(named, ["k1", "k2"]).select(*light.columns, "component_id")
    alone = light.where("n = 0")
    if link_empty:
        return linked.unionByName(alone.crossJoin(F.broadcast(alone.agg(F.min("doc_id").alias("component_id")))))
    return linked.unionByName(alone.withColumn("component_id", F.col("doc_id")))


def op13_minhash(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the size of its set of three-word shingles, its component, and whether it stands for it. ``groups`` says what nulls, empty texts,
    repeated rows and empty tables give; a row without doc_id is kept where its component has no id."""
    found = groups(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def oracle(least: int = LEAST, all_: int = ALL) -> str:
    """The same in DuckDB SQL, on the shingles themselves."""
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{az}', '{az.lower()}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE_WORDS} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {SHINGLE_WORDS - 2}), lambda i: array_to_string(ws[i:i + {SHINGLE_WORDS - 1}], ' ')) END) AS g FROM d),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
k AS (SELECT g, row_number() OVER () AS k FROM s GROUP BY g HAVING count(*) > 1),
c AS (SELECT rid, k FROM s JOIN k USING (g)),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared FROM c a JOIN c b ON a.k = b.k AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE {all_} * shared >= {least} * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS rid, b AS other FROM e UNION SELECT r.rid, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT r.rid, min(o.doc_id) AS least FROM r JOIN d o ON o.rid = r.other GROUP BY r.rid)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(least, doc_id), least, doc_id) AS component_id, doc_id IS NOT DISTINCT FROM coalesce(least(least, doc_id), least, doc_id) AS kept FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)"""
