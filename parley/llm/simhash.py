"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_AZ, bitmap, components, cut, drop_tables, fresh, texts_to_python, whole_text

SHINGLE_WORDS = 3
RADIUS = 2
#: The pipeline's stage links texts whose sets of five-word shingles have at least this Jaccard similarity. Smaller sets than LEAST_SET are similar to equal ones only.
STAGE_WORDS, SIMILARITY, LEAST_SET = 5, 0.8, 4
#: Its fingerprint has so many blocks of 32 bits. Around each block the ball over its LOOSE bits of least majority is walked, 2^LOOSE variants, and two texts are candidates
#: if their balls meet in a block: if every differing bit is loose in one of the two. At similarity 0.8 a block is met with probability 0.144, and none of all with (1 - 0.144)^74 = 1e-5.
BLOCKS, LOOSE = 74, 4
#: Blocks are walked in waves, so that the variants of all aren't on disk at once; what the first wave links drops out of the others.
WAVES = (8, 22, 22, 22)
#: Sets of up to so many shingles vote with weights instead of single votes, as few votes often tie. From SIMILARITY of that many on they have single votes, too, so sets that may be similar share a kind.
WEIGHTED = 64
SKETCH_BITS = 1024
_SEEDS = np.array([xxhash.xxh64_intdigest(b"block %d" % i) for i in range(BLOCKS * 4)], np.uint64)
#: The bits of a byte, each in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def shingle_hashes(data: bytes, shingle_words: int) -> np.ndarray:
    """64-bit hashes of a text's lower-cased word shingles, repeats included. A text of fewer words is one shingle; one without words has none."""
    words = data.translate(LOWER_AZ).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64)


def fingerprint(data: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text's shingles. A text without words gives 0."""
    hashes = shingle_hashes(data, shingle_words)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i : i + 8192]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``; fp holds the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle_words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return texts_to_python(docs).select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that join all fingerprints within ``radius`` bits of each other into the same components; ``classes`` has each fp once.

    Every fingerprint emits all variants within half the radius of itself. Two fingerprints are within the radius exactly if they share a variant, so any
    two of one variant are. Each variant therefore ties its fingerprints to the least of them: as many rows as members, not as pairs. A variant has no more
    fingerprints than the half ball (65 for radius 2), as equal ones were merged before. The distance is checked again on the colliding pairs."""
    if radius < 0 or radius % 2:
        raise ValueError("an even radius is needed: half of it is walked from either side")
    masks = [sum(1 << i for i in bits) for k in range(radius // 2 + 1) for bits in combinations(range(64), k)]
    flips = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    variants = classes.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "fp")
    tied = variants.select("fp", F.min("fp").over(Window.partitionBy("variant")).alias("hub"))
    return tied.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))).between(1, radius)).select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, component_id): each row of ``docs`` with the smallest doc_id that links lead to.

    Null texts are empty texts. A row whose doc_id is null passes its links on, but names no component; a component without any id has a null component_id.
    Repeated rows and equal texts share a component. An empty table gives an empty result. Other columns are not read."""
    spark = docs.sparkSession
    fps = cut(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"), radius))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(best, "root").select("fp", "component_id"), "components")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its fingerprint and component, by ``near_duplicates``, which says what nulls, repeated rows and empty tables give."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def set_key(hashes: np.ndarray) -> int:
    """One number for a set of shingles, given sorted and without repeats."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), 42)


def mixed(hashes: np.ndarray, n: int) -> np.ndarray:
    """``n`` further 64-bit hashes of each hash, as bytes: a row of 8 n."""
    x = (hashes[:, None] ^ _SEEDS[:n]) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x.astype("<u8", copy=False).view(np.uint8)


def votes(hashes: np.ndarray, weighted: bool) -> np.ndarray:
    """The majority of each bit of all blocks among a set's shingles: above zero, the bit is 1."""
    total = np.zeros(BLOCKS * 32, np.int64)
    if weighted:
        for i in range(0, len(hashes), 32):
            total += mixed(hashes[i : i + 32], BLOCKS * 4).sum(axis=0, dtype=np.int64)
        return 2 * total - 255 * len(hashes)
    for i in range(0, len(hashes), 255):  # so many fit a byte
        total += _SPREAD[mixed(hashes[i : i + 255], BLOCKS // 2)].sum(axis=0).astype("<u8", copy=False).view(np.uint8)
    return 2 * total - len(hashes)


def blocks(hashes: np.ndarray, weighted: bool) -> np.ndarray:
    """A row for each block of a set's fingerprint: its 32 bits, and its loose bits, as masks."""
    majority = votes(hashes, weighted).reshape(BLOCKS, 32)
    words = np.packbits(majority > 0, axis=1, bitorder="little").view("<u4")
    loose = np.argpartition(np.abs(majority), LOOSE, axis=1)[:, :LOOSE]
    return np.concatenate([words, np.uint32(1) << loose.astype(np.uint32)], axis=1)


def kinds(n: int) -> list[bool]:
    """Whether a set of ``n`` shingles has blocks of weighted votes, of single ones, or both."""
    return [weighted for weighted in (True, False) if n >= LEAST_SET and (n <= WEIGHTED if weighted else n >= int(WEIGHTED * SIMILARITY))]


def balls(found: np.ndarray) -> np.ndarray:
    """Of (..., 1 + LOOSE) blocks and their masks, the (..., 2^LOOSE) variants in the ball of each."""
    variants = found[..., :1]
    for i in range(1, found.shape[-1]):
        variants = np.concatenate([variants, variants ^ found[..., i : i + 1]], axis=-1)
    return variants


def jaccard(a: bytes, b: bytes) -> float:
    """The similarity of two sets of 64-bit hashes; two empty ones are equal."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    either = len(x) + len(y) - both
    return both / either if either else 1.0


def set_of(data: bytes) -> np.ndarray:
    """A text's five-word shingles, as sorted hashes without repeats."""
    return np.unique(shingle_hashes(data, STAGE_WORDS))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, n, bits, weighted, single): the number, size and sketch of each row's set of five-word shingles, and its blocks of either kind; the sets themselves, which are larger than the texts, aren't kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, sizes, bits, made = [], [], [], {True: [], False: []}
            for t in batch.column(1):
                x = set_of(t.as_py())
                fps.append(set_key(x))
                sizes.append(len(x))
                bits.append(bitmap(x, SKETCH_BITS))
                for weighted, column in made.items():
                    column.append(blocks(x, weighted).tobytes() if weighted in kinds(len(x)) else None)
            columns = [batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bits, pa.list_(pa.int64())), *(pa.array(made[k], pa.binary()) for k in (True, False))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "n", "bits", "weighted", "single"])

    return texts_to_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, fp long, n long, bits array<long>, weighted binary, single binary")


def variants(known: DataFrame, first: int, end: int) -> DataFrame:
    """(variant, fp, root) of ``known`` (fp, root, weighted, single): the balls around the blocks from ``first`` to before ``end``. A variant names its block and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind in (0, 1):
                have = batch.filter(batch.column(2 + kind).is_valid())
                if have.num_rows:
                    found = np.frombuffer(b"".join(have.column(2 + kind).to_pylist()), np.uint32).reshape(have.num_rows, BLOCKS, 1 + LOOSE)[:, first:end]
                    places = (np.arange(first, end) + kind * BLOCKS)[None, :, None] << 32
                    keys = (balls(found).astype(np.int64) | places).reshape(-1)
                    each = len(keys) // have.num_rows
                    owners = (pa.array(np.repeat(have.column(c).to_numpy(), each)) for c in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *owners], names=["variant", "fp", "root"])

    return texts_to_python(known).select("fp", "root", "weighted", "single").mapInArrow(run, "variant long, fp long, root long")


def sets_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(fp, hashes) of ``classes`` (fp, least), whose sets are made again from the texts of the rows whose doc_id is ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                sets = [set_of(t.as_py()) for t in batch.column(0).slice(i, 100)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([set_key(x) for x in sets], np.uint64).view(np.int64)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["fp", "hashes"])

    ids = classes.select(F.col("least").alias("own_id")).distinct()
    texts = texts_to_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    made = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("own_id")), "left_semi").select("text").mapInArrow(run, "fp long, hashes binary")
    return made.join(classes.select("fp"), "fp", "left_semi").dropDuplicates(["fp"])


def may_be_similar(a: str, b: str):
    """False only for sets whose sizes and sketches (columns a_n, a_bits, b_n, b_bits) rule out the similarity asked for."""
    alone = lambda x, y: sum((F.bit_count(F.col(f"{x}_bits")[i].bitwiseAND(F.bitwise_not(F.col(f"{y}_bits")[i]))) for i in range(1, SKETCH_BITS // 64)), F.bit_count(F.col(f"{x}_bits")[0].bitwiseAND(F.bitwise_not(F.col(f"{y}_bits")[0]))))
    shared = F.least(F.col(f"{a}_n") - alone(a, b), F.col(f"{b}_n") - alone(b, a))
    return shared * F.lit(1 + SIMILARITY) >= (F.col(f"{a}_n") + F.col(f"{b}_n")) * F.lit(SIMILARITY) - F.lit(1e-6)


def side(sets: DataFrame, key: str, *columns: str) -> DataFrame:
    return sets.select(F.col("fp").alias(key), *(F.col(c).alias(f"{key}_{c}") for c in columns))


def compared(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that sizes and sketches, from ``known`` (fp, n, bits), don't rule out. What is known of an a is joined once for all its pairs."""
    of_a = pairs.groupBy("a").agg(F.collect_list("b").alias("bs")).join(side(known, "a", "n", "bits"), "a")
    return of_a.select("a", "a_n", "a_bits", F.explode("bs").alias("b")).join(side(known, "b", "n", "bits"), "b").where(may_be_similar("a", "b")).select("a", "b")


def similar(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets have at least the similarity asked for."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y) >= SIMILARITY for x, y in zip(a, b)], dtype=bool)

    needed = pairs.select(F.explode(F.array("a", "b")).alias("needed")).distinct()
    sets = cut(sets_of(docs, cut(classes.join(needed, F.col("fp") == F.col("needed"), "left_semi"), "needed")), "sets")
    both = pairs.join(side(sets, "a", "hashes"), "a").join(side(sets, "b", "hashes"), "b")
    found = cut(both.where(near("a_hashes", "b_hashes")).select("a", "b"), "links")
    drop_tables(sets)
    return found


def merged(members: DataFrame) -> DataFrame:
    """(hub, fp): groups that hold together what ``members`` (hub, fp) hold together. A hub that is itself a member gives its own to the least hub that it is a member of, so that a crowd
    whose variants have many hubs becomes a few groups and not as many overlapping ones."""
    pairs = members.distinct()
    over = pairs.groupBy("fp").agg(F.min("hub").alias("over")).select(F.col("fp").alias("hub"), F.lit(None).cast("long").alias("fp"), "over")
    looked_up = F.least("hub", F.min("over").over(Window.partitionBy("hub")))
    return pairs.withColumn("over", F.lit(None).cast("long")).union(over).select(looked_up.alias("hub"), "fp").where("fp is not null").distinct()


def untried(members: DataFrame, roots: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b), a above b: what shares a group of ``members`` (hub, fp) but no component, and isn't ruled out by sizes and sketches, from ``known`` (fp, n, bits).

    The component with the most members of a group is on one side of its pairs only, so a large group that is linked but for a few isn't paired with itself."""
    rooted = members.join(roots, members.fp == roots.node, "left").select("hub", "fp", F.coalesce("root", "fp").alias("root"))
    tops = rooted.groupBy("hub", "root").count().groupBy("hub").agg(F.max_by("root", F.struct("count", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("hub", "top")
    rest = cut(rooted.join(tops, "hub").join(known, "fp"), "unsettled")
    a, b = (rest.select(F.col("fp").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("hub", "root", "top", "n", "bits"))) for k in ("a", "b"))
    once = F.expr("a_root <> b_root and (b_root = b_top or a > b)")
    return a.where("a_root <> a_top").join(b, (F.col("a_hub") == F.col("b_hub")) & once & may_be_similar("a", "b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): each row of ``docs`` with the smallest doc_id that links between similar texts lead to; ids as in ``near_duplicates``.

    Texts whose balls meet are compared by their full sets, unless they are linked already or their sketches rule the similarity out. In each wave of blocks those that meet
    in a variant are compared with the least of them, its hub, which is then done with; after the last, what still shares a variant but not yet a component is compared by pairs,
    in groups of all variants of a hub. So a large group of copies of one text is settled without its pairs. Sets are made only for texts that are compared."""
    rows = cut(sketches(docs), "sketches")
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    blocked = cut(rows.dropDuplicates(["fp"]).select("fp", "n", "bits", "weighted", "single"), "blocks")
    known = blocked.select("fp", "n", "bits")
    linked = tried = rows.sparkSession.createDataFrame([], "a long, b long")
    roots, members, end = rows.sparkSession.createDataFrame([], "node long, root long"), [], 0
    for size in WAVES:
        first, end = end, end + size
        rooted = blocked.join(roots, blocked.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "weighted", "single")
        group = Window.partitionBy("variant")
        met = variants(rooted, first, end).select("variant", "fp", "root", F.min(F.struct("fp", "root")).over(group).alias("hub"), F.min("root").over(group).alias("low"), F.max("root").over(group).alias("high"))
        other = F.when(F.col("fp") != F.col("hub.fp"), F.col("root"))
        met = cut(met.where("low < high").select("fp", "root", "hub", (F.min(other).over(group) < F.max(other).over(group)).alias("open")), "met")
        members.append(cut(met.where("open and fp <> hub.fp").select(F.col("hub.fp").alias("hub"), "fp").distinct(), "members"))
        tied = met.where("root <> hub.root").select(F.col("fp").alias("a"), F.col("hub.fp").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        likely = cut(compared(tied, known), "pairs")
        drop_tables(met)
        if likely.limit(1).count():
            tried, linked = tried.union(likely), linked.union(similar(likely, docs, classes))
            roots = components(linked)
    likely = cut(untried(merged(reduce(DataFrame.union, members)), roots, known).join(tried, ["a", "b"], "left_anti"), "pairs")
    if likely.limit(1).count():
        roots = components(linked.union(similar(likely, docs, classes)))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(best, "root").select("fp", "component_id"), "components")
    found = cut(rows.select("doc_id", "fp").join(named, "fp").select("doc_id", "fp", "component_id"), "groups")
    drop_tables(rows, blocked, *members, likely, named)
    return found


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` whose document is the least of its group of similar texts. Rows that repeat a doc_id are one document and stay together; a row
    without doc_id stays if no row of its group has one. Whichever texts repeat an id, the row's own text decides."""
    found = similar_groups(docs).where("not (doc_id <=> component_id)").select("doc_id", "fp").distinct()
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count()  # null ids repeat each other
    names = docs.columns
    if not repeated:
        gone = cut(found.select(F.col("doc_id").alias(fresh(names, "gone_id"))).distinct(), "gone")
        return docs.join(gone, docs["doc_id"].eqNullSafe(gone[gone.columns[0]]), "left_anti").select(*names)
    gone = cut(found.select(F.col("doc_id").alias(fresh(names, "gone_id")), F.col("fp").alias(fresh(names, "gone_fp"))), "gone")
    own = fresh(names, "own_fp")
    marked = with_fingerprint(docs, own)
    return marked.join(gone, marked["doc_id"].eqNullSafe(gone[gone.columns[0]]) & (marked[own] == gone[gone.columns[1]]), "left_anti").select(*names)


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the numbers of its rows' sets of five-word shingles in one more column."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([set_key(set_of(t)) for t in texts], np.uint64).view(np.int64))

    return texts_to_python(docs).withColumn(name, fp(whole_text(text_col)))
