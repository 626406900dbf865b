"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_tables, fresh, held_out, texts_to_python

#: The classifier is fitted on at most so many confirmed toxic documents and so many unlabelled ones, of the training folds, those with the least hashes of their ids.
POSITIVES, UNLABELLED = 4_000, 12_000
BITS = 23
#: Beginnings of words count too, by characters, if the rule says so. Five and the levels below have the least risk in three folds of the training documents of the 0.1 scale (0.0088, of eight pairs
#: tried: without levels, with none, 5, 4 and 6, or 4 to 7 characters, 0.018 to 0.030; with levels 0.017, 0.009, 0.012 and 0.018); no label of a held-out document was read for it.
PREFIXES = (5,)
PREFIX = 1 << BITS - 3
STRIP = ".,;:!?\"()[]{}*|%&$#<>'-"
#: Levels of a feature: it occurs once, twice, three times or more, or twice or more and in at least so large a share of the words.
COUNTS, DENSE = (1, 2, 3), 0.01
#: A feature counts if at least so many positives have it, and if it is so many times as frequent in them as in unlabelled text.
LEAST_POSITIVES, LEAST_RATIO = 3, 4.0


class Rule(NamedTuple):
    """Which features are learned from: those that at least a share of the positives have, that are more frequent in them than in unlabelled text by so many standard errors, of the levels given, of beginnings of words or of words alone."""

    share: float
    errors: float
    levels: tuple[int, ...]
    beginnings: bool = True


#: Rules tried, the strictest first, in so many folds of the training sample, with so many steps.
RULES = tuple(Rule(s, e, v, b) for b in (False, True) for v in ((0,), (0, 1, 2, 3)) for s in (0.03, 0.01) for e in (4.0, 2.0))
FOLDS, FOLD_STEPS = 3, 150
STEPS, RATE, DECAY = 400, 0.05, 1e-5


def stems(token: str) -> list[int]:
    """Hashes of a lower-cased token without the signs around it, and of its beginnings, which inflected words share."""
    word = token.strip(STRIP)
    if not word:
        return []
    mask = PREFIX - 1
    return [zlib.crc32(word.encode()) & mask, *(zlib.crc32(word[:k].encode(), 1) & mask | PREFIX for k in PREFIXES if len(word) > k)]


def levels(count: int, total: int) -> list[int]:
    return [k for k, least in enumerate(COUNTS) if count >= least] + [len(COUNTS)] * (count >= 2 and count >= DENSE * total)


def feature(stem: int, level: int) -> int:
    return stem << 2 | level


def features(text: str) -> np.ndarray:
    """The distinct features of a whole text."""
    tokens = text.lower().split()
    counts: Counter = Counter()
    for t, n in Counter(tokens).items():
        for s in stems(t):
            counts[s] += n
    return np.unique(np.array([feature(s, k) for s, n in counts.items() for k in levels(n, len(tokens))], np.int32))


class Classifier:
    """A sparse linear classifier: weights by feature, and a bias."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.stems = {f >> 2 for f in weights}
        self._known: dict[str, tuple[int, ...]] = {}

    def _look_up(self, token: str) -> tuple[int, ...]:
        found = tuple(s for s in stems(token) if s in self.stems)
        if len(self._known) > 150_000:  # bounds memory, not results
            self._known.clear()
        if len(token) < 64:
            self._known[token] = found
        return found

    def score(self, text: str) -> float:
        """The probability of label 1. Every feature of the text counts once."""
        tokens, known, counts = text.lower().split(), self._known.get, Counter()
        for t, n in Counter(tokens).items():
            found = known(t)
            if found is None:
                found = self._look_up(t)
            for s in found:
                counts[s] += n
        hit = sorted(f for s, n in counts.items() for k in levels(n, len(tokens)) if (f := feature(s, k)) in self.weights)
        z = self.bias + sum(self.weights[f] for f in hit)
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def least_positives(n_p: int, share: float) -> float:
    return max(min(LEAST_POSITIVES, n_p), share * n_p)


def choose(seen: np.ndarray, in_p: np.ndarray, in_u: np.ndarray, n_p: int, n_u: int, prior: float, rule: Rule) -> np.ndarray:
    """Which of the features ``seen`` to learn from, by the rule; in_p of n_p positives and in_u of n_u unlabelled texts have them."""
    f_p, f_u = in_p / n_p, in_u / n_u
    error = np.sqrt(f_p * (1 - f_p) / n_p + (f_u * (1 - f_u) + 1 / n_u) / n_u)
    # A feature of toxic text alone is 1/prior times as frequent in positives, so less than this is asked where toxic text is common.
    least = min(LEAST_RATIO, 0.5 / max(prior, 1e-6))
    return np.isin(seen & 3, rule.levels) & (rule.beginnings | (seen >> 2 & PREFIX == 0)) & (in_p >= least_positives(n_p, rule.share)) & (f_p - f_u > rule.errors * error) & (f_p > least * f_u)


def start_bias(prior: float) -> float:
    return float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Sample:
    """Texts as rows of a sparse matrix whose columns are features."""

    def __init__(self, features: np.ndarray, texts: list[np.ndarray]):
        self.n, self.k = len(texts), len(features)
        own = [np.searchsorted(features, x) for x in texts]
        self.cols, self.rows = np.concatenate([*own, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(self.n), [len(x) for x in own])

    def part(self, rows: np.ndarray, cols: np.ndarray) -> Sample:
        """Of the rows and columns marked."""
        out, kept = object.__new__(Sample), rows[self.rows] & cols[self.cols]
        out.n, out.k = int(rows.sum()), int(cols.sum())
        out.rows, out.cols = (np.cumsum(rows) - 1)[self.rows[kept]], (np.cumsum(cols) - 1)[self.cols[kept]]
        return out

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """How many of the rows marked have each column."""
        return np.bincount(self.cols[rows[self.rows]], minlength=self.k)

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.cols], minlength=self.n) + w[self.k]

    def back(self, by_row: np.ndarray) -> np.ndarray:
        """The gradient by column, and by the bias, of one by row."""
        return np.append(np.bincount(self.cols, weights=by_row[self.rows], minlength=self.k), by_row.sum())


def minimised(p: Sample, u: Sample, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> np.ndarray:
    """Weights by column, and the bias, that minimise the non-negative risk estimate over positives ``p`` and unlabelled texts ``u``.

    With the class prior q, losses l+ and l- and means over P and U: risk = q P[l+] + max(0, U[l-] - q P[l-]). The second term stands for the negatives, which
    nobody labelled; where it falls below zero the fit has begun to learn the sample by heart, and the step goes the other way."""
    w = np.zeros(p.k + 1)
    w[-1] = start_bias(prior)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z_p, z_u = p.scores(w), u.scores(w)
        negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        d_plus, d_minus_p, d_minus_u = -prior * sigmoid(-z_p) / p.n, prior * sigmoid(z_p) / p.n, sigmoid(z_u) / u.n
        g_p, g_u = (d_plus - d_minus_p, d_minus_u) if negative >= 0 else (d_minus_p, -d_minus_u)
        g = p.back(g_p) + u.back(g_u)
        g[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def risk_of(z_p: np.ndarray, z_u: np.ndarray, prior: float) -> float:
    """The estimate for the loss that counts wrong answers."""
    return prior * (z_p < 0).mean() + max(0.0, (z_u >= 0).mean() - prior * (z_p >= 0).mean())


def chosen_columns(features: np.ndarray, p: Sample, u: Sample, in_p: np.ndarray, in_u: np.ndarray, prior: float, rule: Rule) -> np.ndarray:
    return choose(features, p.counts(in_p), u.counts(in_u), int(in_p.sum()), int(in_u.sum()), prior, rule)


def fold_risk(features: np.ndarray, p: Sample, u: Sample, prior: float, rule: Rule, fold: int, folds: int) -> float:
    """The risk in one fold of what the others teach by a rule."""
    own_p, own_u = np.arange(p.n) % folds == fold, np.arange(u.n) % folds == fold
    cols = chosen_columns(features, p, u, ~own_p, ~own_u, prior, rule)
    w = minimised(p.part(~own_p, cols), u.part(~own_u, cols), prior, FOLD_STEPS)
    return risk_of(p.part(own_p, cols).scores(w), u.part(own_u, cols).scores(w), prior)


def fit(features: np.ndarray, positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rules: tuple[Rule, ...] = RULES, folds: int = FOLDS, spark: SparkSession | None = None) -> Classifier:
    """A classifier over texts given by those of their features that are in ``features``, which is sorted. The rule is the one with the least risk over the folds, each
    scored by what the others teach; of equals the first. Without positives or without unlabelled text everything scores the prior. With a session rules and folds
    are tried as its tasks, which get the sample, bounded as it is, as a broadcast."""
    if not positives or not unlabelled:
        return Classifier({}, start_bias(prior))
    p, u = Sample(features, positives), Sample(features, unlabelled)
    best = rules[0]
    if len(rules) > 1 and min(p.n, u.n) >= 2 * folds:
        tried = [(r, f) for r in range(len(rules)) for f in range(folds)]
        risks = in_tasks(spark, (features, p, u, prior, rules, folds), tried) if spark else [fold_risk(features, p, u, prior, rules[r], f, folds) for r, f in tried]
        best = min(enumerate(rules), key=lambda x: sum(risk for (r, _), risk in zip(tried, risks) if r == x[0]))[1]
    all_p, all_u = np.ones(p.n, bool), np.ones(u.n, bool)
    cols = chosen_columns(features, p, u, all_p, all_u, prior, best)
    w = minimised(p.part(all_p, cols), u.part(all_u, cols), prior)
    return Classifier({int(c): float(x) for c, x in zip(features[cols], w)}, float(w[-1]))


def in_tasks(spark: SparkSession, sample: tuple, tried: list[tuple[int, int]]) -> list[float]:
    """The risk of each (rule, fold), one task each."""
    held = spark.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, p, u, prior, rules, folds = held.value
        for batch in batches:
            at = batch.column(0).to_pylist()
            risks = [float(fold_risk(features, p, u, prior, rules[tried[i][0]], tried[i][1], folds)) for i in at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(risks, pa.float64())], names=["id", "risk"])

    found = {r.id: r.risk for r in spark.range(0, len(tried), 1, len(tried)).mapInArrow(run, "id long, risk double").collect()}
    held.destroy()
    return [found[i] for i in range(len(tried))]


def sample_features(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(toxic, features) of the documents in ``chosen`` (chosen_id, toxic), one row each, whose number the sample's bounds limit. Of texts that share an id the least counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((features(x.as_py()) for x in batch.column(1)), pa.list_(pa.int32()))], names=["toxic", "features"])

    joined = texts_to_python(docs).join(F.broadcast(chosen), docs["doc_id"] == chosen["chosen_id"])
    one = joined.groupBy("chosen_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return one.select("toxic", "text").mapInArrow(run, "toxic int, features array<int>")


def feature_counts(sample: DataFrame) -> DataFrame:
    """(feature, in_p, in_u): how many positives and unlabelled texts of ``sample`` (toxic, features) have each feature of a positive. Tasks count in arrays of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_p, in_u = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
        for batch in batches:
            for toxic, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                (in_p if toxic else in_u)[x.values.to_numpy()] += 1
        seen = np.flatnonzero(in_p | in_u).astype(np.int32)
        for i in range(0, len(seen), 100_000):
            k = seen[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(in_p[k]), pa.array(in_u[k])], names=["feature", "in_p", "in_u"])

    return texts_to_python(sample).select("toxic", "features").mapInArrow(run, "feature int, in_p int, in_u int").groupBy("feature").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u")).where("in_p > 0")


def chosen_only(sample: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(toxic, features, n, crc, total) of ``sample``: the chosen ones of each text's features, and the number, checksum and sum of all."""
    held = sample.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.values.to_numpy() for x in batch.column(1)]
            numbers = [pa.array([f(x) for x in rows], pa.int64()) for f in (len, zlib.crc32, lambda x: int(x.sum(dtype=np.int64)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[np.isin(x, held.value)] for x in rows], pa.list_(pa.int32())), *numbers], names=["toxic", "features", "n", "crc", "total"])

    return texts_to_python(sample).mapInArrow(run, "toxic int, features array<int>, n long, crc long, total long")


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier:
    """A classifier from the confirmed toxic documents of the training folds and a sample of all documents of those folds, labelled or not, whose labels are not looked at.

    Only labels of the training folds give the positives and the class prior; a document labelled more than once is toxic if any label says so; null labels and
    ids are left out. Without labels everything scores near 0."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy(F.col("doc_id").alias("chosen_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    prior = (total[1] or 0) / total[0] if total[0] else 0.0
    pick = lambda rows, n: rows.orderBy(F.xxhash64("chosen_id"), "chosen_id").limit(n).select("chosen_id")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").where(~held_out()).select(F.col("doc_id").alias("chosen_id")).distinct()
    chosen = cut(pick(known.where("toxic = 1"), positives).withColumn("toxic", F.lit(1)).union(pick(every, unlabelled).withColumn("toxic", F.lit(0))), "sample")
    sample = cut(sample_features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), chosen), "features")
    n_p, n_u = (int(x or 0) for x in sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    if not n_p or not n_u:
        return Classifier({}, start_bias(prior))
    # What a rule could choose in two of three folds: no more rows than features have numbers.
    least = min(r.share for r in RULES) * n_p * (FOLDS - 1) / FOLDS
    counts = feature_counts(sample).where((F.col("in_p") >= min(LEAST_POSITIVES, n_p)) & (F.col("in_p") >= least) & (F.col("in_p") / n_p > F.col("in_u") / n_u)).select("feature").orderBy("feature").toArrow()
    seen = counts.column("feature").to_numpy()
    found = chosen_only(sample, seen).toArrow()
    marks, rows = found.column("toxic").to_numpy(), [x.values.to_numpy() for x in found.column("features")]
    keys = list(zip(*(found.column(c).to_pylist() for c in ("n", "crc", "total"))))
    order = sorted(range(len(rows)), key=keys.__getitem__)  # the order that rows arrive in must not matter
    drop_tables(sample, chosen)
    return fit(seen, [rows[i] for i in order if marks[i] == 1], [rows[i] for i in order if marks[i] == 0], prior, spark=docs.sparkSession)


def scores(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # as many weights as features chosen from the bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(*held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((own.score(x.as_py()) for x in batch.column(1)), pa.float64())], names=["doc_id", "score"])

    return texts_to_python(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty and score by the bias alone. Repeated rows repeat, null ids stay null and count as held out. Without any labels everything scores near 0; an empty table gives no rows."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scores(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that don't score as toxic; texts are scored in place, so nothing is shuffled."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = spark.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Classifier(*held.value)
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype=float)

    own = fresh(docs.columns, "toxic_score")
    return texts_to_python(docs).withColumn(own, score(F.coalesce("text", F.lit("")))).where(F.col(own) < 0.5).select(*docs.columns)
