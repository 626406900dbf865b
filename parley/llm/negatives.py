"""Hard negatives by blocked dense products: anchors in bounded blocks against all rows, first for positives, then for negatives in a window below them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_tables, read

POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between so many hundredths of its positive's.
LOW, HIGH = 30, 90
#: Components are multiplied by this and rounded down.
SCALE = 256
#: Numbers of the anchors that one pass broadcasts (64 MB), whatever the table's size; of anchors in a product; and of rows in one.
WAVE_NUMBERS, ANCHOR_BLOCK, ROW_BLOCK = 1 << 23, 512, 2048
#: Integers up to here are exact as doubles.
EXACT = 1 << 53
#: Below all scores.
NONE = np.iinfo(np.int64).min


def vectors(embeddings: DataFrame) -> DataFrame:
    """(id, label, vector, mark) of the rows that take part: mark is a hash that tells rows apart; labels of ids divisible by 7 moved on by one, modulo 10; components as doubles, not yet scaled. Rows without an id, a label or a vector, or with a component that is null or not finite, are left out."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    i, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    rows = rows.select(i.alias("id"), F.when(i % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), v.alias("vector"))
    return rows.withColumn("mark", F.xxhash64("label", "vector"))


def by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, scaled components) of the vectors of each length, as a matrix of whole numbers."""
    ends = vectors.offsets.to_numpy()
    sizes = np.diff(ends)
    flat = vectors.values.to_numpy()
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, np.floor(SCALE * flat[ends[at][:, None] + np.arange(n)])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exact: in doubles where every partial sum stays below 2^53, in Python's integers where not. NONE stands for what is no long."""
    most = lambda x: float(np.abs(x).max()) if x.size else 0.0
    if a.shape[1] * most(a) * most(b) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    found = whole(a) @ whole(b).T
    return np.where((found < 1 << 63) & (found > NONE), found, NONE).astype(np.int64)


def first(scores: np.ndarray, allowed: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, columns) of the ``most`` highest allowed scores of each row that has any; of equal ones the first columns count."""
    masked = np.where(allowed, scores, NONE)
    bar = np.partition(masked, -most, axis=1)[:, -most] if masked.shape[1] > most else np.full(len(masked), NONE)
    for row in np.flatnonzero(masked.max(axis=1, initial=NONE) > NONE):
        above = np.flatnonzero(masked[row] > bar[row])
        equal = np.flatnonzero(masked[row] == bar[row])[: most - len(above)] if bar[row] > NONE else above[:0]
        yield row, np.concatenate([above, equal])


class Best:
    """The first rows found so far for each of some lists, merged when many have gathered."""

    def __init__(self, most: int):
        self.most, self.parts, self.waiting = most, [], 0

    def add(self, name: int, scores: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> None:
        self.parts.append(np.stack([np.full(len(ids), name), scores, ids, marks]))
        self.waiting += len(ids)
        if self.waiting > 200_000:
            self.merge()

    def merge(self) -> np.ndarray:
        """Columns of list, score, id and mark; rows equal in all of them count once."""
        if not self.parts:
            return np.zeros((4, 0), np.int64)
        rows = np.concatenate(self.parts, axis=1)
        lists, scores, ids, marks = rows
        rows = rows[:, np.lexsort([marks, ids, ~scores, lists])]
        rows = rows[:, np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)]]
        starts = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
        rank = np.arange(rows.shape[1]) - np.repeat(starts, np.diff(np.r_[starts, rows.shape[1]]))
        rows, self.waiting = rows[:, rank < self.most], 0
        self.parts = [rows]
        return rows


class Anchors:
    """A wave's anchors, by length of vector: ids, labels, components, and their positives' scores once these are known."""

    def __init__(self, rows: pa.Table):
        at = rows.combine_chunks()
        column = lambda c: at[c].to_numpy().astype(np.int64)
        vector = at["vector"].chunk(0) if at.num_rows else pa.array([], pa.list_(pa.float64()))
        self.id, self.label = column("id"), column("label")
        self.groups = {m.shape[1]: (places, m) for places, m in by_length(vector)} if at.num_rows else {}
        self.positive: np.ndarray | None = None  # (anchor's place, score) of each list

    def blocks(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        places, matrix = self.groups.get(n, (np.zeros(0, np.int64), None))
        for i in range(0, len(places), ANCHOR_BLOCK):
            yield places[i : i + ANCHOR_BLOCK], matrix[i : i + ANCHOR_BLOCK]


def scored(rows: DataFrame, wave, most: int, lists) -> DataFrame:
    """(list, score, id, mark): each task's first ``most`` rows of every list of a broadcast wave. ``lists(anchors, places, labels, ids, scores)`` gives (list numbers, scores, allowed) for a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, best = wave.value, Best(most)
        for batch in batches:
            ids, labels, marks = (batch.column(c).to_numpy() for c in (0, 1, 2))
            for at, matrix in by_length(batch.column(3)):
                order = np.lexsort([marks[at], ids[at]])
                at, matrix = at[order], matrix[order]
                new = np.r_[True, (np.diff(ids[at]) != 0) | (np.diff(marks[at]) != 0)]
                at, matrix = at[new], matrix[new]
                for i in range(0, len(at), ROW_BLOCK):
                    own, part = at[i : i + ROW_BLOCK], matrix[i : i + ROW_BLOCK]
                    for places, block in anchors.blocks(matrix.shape[1]):
                        for names, scores, allowed in lists(anchors, places, labels[own], ids[own], products(block, part)):
                            for row, columns in first(scores, allowed, most):
                                best.add(names[row], scores[row][columns], ids[own][columns], marks[own][columns])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.merge()], names=["list", "score", "id", "mark"])

    return rows.select("id", "label", "mark", "vector").mapInArrow(run, "list long, score long, id long, mark long")


def _positive_lists(anchors, places, labels, ids, scores):
    yield places, scores, (anchors.label[places][:, None] == labels) & (anchors.id[places][:, None] != ids)


def _negative_lists(anchors, places, labels, ids, scores):
    """One list for each positive of an anchor: numbers are places in ``anchors.positive``."""
    other = anchors.label[places][:, None] != labels
    of, goals = anchors.positive
    starts, ends = (np.searchsorted(of, places, side=s) for s in ("left", "right"))
    kind = np.int64 if max(np.abs(x.astype(float)).max(initial=0) for x in (scores, goals)) < 1e16 else object
    for k in range(int((ends - starts).max(initial=0))):
        rows = np.flatnonzero(starts + k < ends)
        names = starts[rows] + k
        goal, hundred = goals[names].astype(kind)[:, None], scores[rows].astype(kind) * 100
        yield names, scores[rows], other[rows] & ((LOW * goal <= hundred) & (hundred <= HIGH * goal)).astype(bool)


def firsts(found: DataFrame, most: int) -> DataFrame:
    """Of the tasks' lists each list's first ``most`` rows, with their rank."""
    w = Window.partitionBy("list").orderBy(F.desc("score"), "id", "mark")
    return found.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows whose vec_id is divisible by ``every``.

    Anchors go to the executors in waves of bounded size; each wave passes over all rows twice, and each task gives its first rows of every list, which merge.
    Vectors of different lengths aren't compared, nor are those whose score is no long. Rows equal in all that counts are one, so repeated rows don't repeat;
    rows that share only an id count each, and so do such anchors. An anchor without positives, or without negatives in the window (there are none below a
    negative score), gives no rows; an empty table gives an empty result. Other columns are not read."""
    spark = embeddings.sparkSession
    rows = vectors(embeddings)
    chosen = rows.where(F.col("id") % every == 0).distinct()
    chosen = cut(chosen.withColumn("number", F.monotonically_increasing_id()), "anchors")
    part = F.shiftright("number", 33)  # the task that numbered it
    upto = chosen.select("number", part.alias("part"), F.sum(F.size("vector") + 4).over(Window.partitionBy(part).orderBy("number")).alias("upto"))
    before = upto.groupBy(F.col("part").alias("of")).agg(F.max("upto").alias("size")).withColumn("before", F.sum("size").over(Window.orderBy("of")) - F.col("size"))
    waves = cut(upto.join(before, F.col("part") == F.col("of")).select("number", F.floor((F.col("upto") + F.col("before")) / WAVE_NUMBERS).alias("wave")), "waves")
    found = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for (wave,) in waves.select("wave").distinct().orderBy("wave").toLocalIterator():
        numbers = waves.where(F.col("wave") == wave).select("number")
        found = found.union(_wave(spark, rows, Anchors(chosen.join(numbers, "number").orderBy("number").toArrow()), positives, negatives))
    drop_tables(chosen, waves)
    return found


def _wave(spark: SparkSession, rows: DataFrame, anchors: Anchors, positives: int, negatives: int) -> DataFrame:
    """The rows of one wave, written down."""
    sent = spark.sparkContext.broadcast(anchors)
    near = firsts(scored(rows, sent, positives, _positive_lists), positives).select(F.col("list").alias("anchor"), "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    got = near.orderBy("anchor", "rank").toArrow()
    anchors.positive = np.stack([got[c].to_numpy().astype(np.int64) for c in ("anchor", "positive_score")])
    ids = anchors.id[anchors.positive[0]]
    again = spark.sparkContext.broadcast(anchors)
    named = spark.createDataFrame(pa.table({"list": np.arange(len(ids)), "anchor_id": ids, "positive_id": got["positive_id"], "positive_score": got["positive_score"]}))
    found = firsts(scored(rows, again, negatives, _negative_lists), negatives).join(named, "list")
    out = cut(found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    sent.destroy()
    again.destroy()
    return out


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    """``hard_negatives`` over all of ``embeddings``, which says what nulls, ties, repeated rows and empty tables give."""
    return hard_negatives(read(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """The same in DuckDB SQL."""
    return f"""WITH r AS (SELECT DISTINCT CAST(vec_id AS BIGINT) AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = len(embedding)),
s AS (SELECT a.id AS anchor_id, a.label = c.label AS same, c.id, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM r a JOIN r c ON a.id % 100 = 0 AND a.id <> c.id AND len(a.v) = len(c.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.id) AS rank FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
