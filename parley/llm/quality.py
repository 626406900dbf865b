"""Quality rules whose cutoffs limit false rejection: exact binomial tests on labelled documents, per stratum. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

SYMBOLS = "#*$%&|<>"
REPEAT_WORDS = 8
#: The share of good documents that all rules together may reject in a stratum, and the probability that any cutoff of any stratum breaks its part of it.
FALSE_REJECTION, ERROR = 0.04, 0.1
# The cutoffs tried for each rule, the most lenient first.
RULES = {
    "symbols": (2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1),
    "duplicate_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "repeats": (0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.02),
    "shouts": (2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2, 0.15, 0.1),
}
#: Tables of strata counted to have no more rows than this are broadcast.
BROADCAST_ROWS = 10_000
UNKNOWN = "unknown"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def repeat_words(words: Column, size: int = REPEAT_WORDS) -> Column:
    """How many words stand in windows of ``size`` words that the text has twice or more.

    Windows are compared by 64-bit hashes. Where all differ, that is all; else they are sorted with their places, those with an equal neighbour are taken in
    the order of their places, and each covers the words up to the next. Time grows as n log n."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))

    def cover(places: Column) -> Column:
        steps = F.zip_with(F.slice(places, F.lit(2), F.size(places) - 1), F.slice(places, F.lit(1), F.size(places) - 1), lambda b, a: F.least(F.lit(size), b - a))
        return F.aggregate(steps, F.lit(size), lambda acc, x: acc + x)

    def equal_neighbours(s: Column) -> Column:
        h = lambda j: F.get(s, j)["h"]
        hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: F.coalesce(h(j) == h(j - 1), F.lit(False)) | F.coalesce(h(j) == h(j + 1), F.lit(False)))
        return let(F.sort_array(F.transform(hit, lambda j: F.get(s, j)["i"])), cover)

    def count(hs: Column) -> Column:
        some = F.size(F.array_distinct(hs)) < F.size(hs)
        return F.when(some, let(F.sort_array(F.transform(hs, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), equal_neighbours)).otherwise(0)

    return F.when(F.size(words) > size, let(hashes, count)).otherwise(0).cast("long")


def removed(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, counts) of each row's whole text; a null text has no words, a null language is the stratum 'unknown'."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    found = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("stratum"),
        found.alias("found"),
        by_line.alias("by_line"),
        F.length(removed(text, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        (F.octet_length(text) - F.octet_length(removed(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.octet_length(text) - F.octet_length(removed(text, "!"))).cast("long").alias("n_shouts"),
    ).select("doc_id", "stratum", "found.*", "by_line.*", "word_chars", "n_symbols", "n_shouts")


def with_rules(measured: DataFrame) -> DataFrame:
    """One column a rule: the larger, the worse. Texts without words have 0."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = {"symbols": share("n_symbols", "n_words"), "duplicate_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "shouts": share("n_shouts", "n_words")}
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.withColumns(out | {"base_failed": failed})


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n draws with probability p, exactly, summed in logarithms term by term. Beyond the mean it is not small, and 1 stands for it."""
    first = n * F.log1p(F.lit(-p))
    odds = F.log(F.lit(p)) - F.log1p(F.lit(-p))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(-F.abs(acc["total"] - term)))).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), F.struct(first.alias("term"), first.alias("total")), add)["total"]
    return F.when(k > n * p, F.lit(1.0)).when(k <= 0, F.exp(first)).otherwise(F.exp(total))


def cutoffs(ruled: DataFrame, labels: DataFrame, false_rejection: float = FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """(stratum, one cutoff a rule, null where none is safe).

    A rule with cutoff t rejects a document of more than t. Among the n good labelled documents of a stratum it rejects k; if its true rate were above its
    part of the allowed one, so few would be seen with at most the binomial probability P(X <= k). Cutoffs are tried from the most lenient on and the last
    before the first failure is taken, so that a rule costs one error (fixed sequence); the error is divided by rules times strata, the rate by rules. A document
    counts once in a stratum, by its worst values, however often its row is repeated: copies of one draw tell no more than the draw."""
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("good_id")).agg(F.min("quality").alias("q")).where("q = 1").select("good_id")
    labelled = ruled.join(good, ruled["doc_id"] == good["good_id"], "left_semi").groupBy("stratum", "doc_id").agg(*(F.max(r).alias(r) for r in RULES))
    cells = [(r, t) for r, ts in RULES.items() for t in ts]
    counted = labelled.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(r) > t).alias(f"k{i}") for i, (r, t) in enumerate(cells)))
    strata = ruled.agg(F.count_distinct("stratum")).first()[0]
    long = counted.select("stratum", "n", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(t).alias("t"), F.col(f"k{i}").alias("k")) for i, (r, t) in enumerate(cells)))).alias("c")).select("stratum", "n", "c.*")
    tested = long.withColumn("safe", (binomial_tail(F.col("k"), F.col("n"), false_rejection / len(RULES)) <= error / len(RULES) / max(strata, 1)).cast("int"))
    passed = tested.withColumn("safe", F.min("safe").over(Window.partitionBy("stratum", "rule").orderBy(F.desc("t")))).where("safe = 1")
    return passed.groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == r, F.col("t"))).alias(f"cut_{r}") for r in RULES))


def judged(docs: DataFrame, labels: DataFrame, false_rejection: float = FALSE_REJECTION, error: float = ERROR) -> DataFrame:
    """Each row's counts, base_failed, kept, and the rules that reject it. Without enough labels no rule rejects; an empty table gives none."""
    ruled = cut(with_rules(measures(docs)), "measures")
    safe = cut(cutoffs(ruled, labels, false_rejection, error), "cutoffs")
    safe = safe.withColumnRenamed("stratum", "of")
    joined = ruled.join(F.broadcast(safe) if safe.count() <= BROADCAST_ROWS else safe, F.col("stratum") == F.col("of"), "left")
    reasons = F.array_compact(F.array(*(F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES)))
    return joined.withColumn("reasons", reasons).withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))


COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its counts and verdict. Null texts have no words and fail the base rules; a null language is a stratum of its own; labels without
    id or quality, and of unknown documents, don't count; repeated rows repeat; an empty table gives no rows; other columns aren't read."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judged(docs, labels).select(*COLUMNS)


def oracle(false_rejection: float = FALSE_REJECTION, error: float = ERROR) -> str:
    """The same in DuckDB SQL."""
    p, word, space = false_rejection / len(RULES), r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
    grid = ", ".join(f"('{r}', {t})" for r, ts in RULES.items() for t in ts)
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in RULES) + " END"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, 'unknown') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{word}') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT rid, unnest(range(1, len(ws) - {REPEAT_WORDS - 2})) AS i, ws FROM w WHERE len(ws) > {REPEAT_WORDS}),
g AS (SELECT rid, i, array_to_string(ws[i:i + {REPEAT_WORDS - 1}], ' ') AS win FROM p),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + o) AS n_repeat_words FROM r, (SELECT unnest(range(0, {REPEAT_WORDS})) AS o) GROUP BY rid),
m AS (SELECT doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{space}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_shouts, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (rid)),
s AS (SELECT *, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS duplicate_lines, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeats, CASE WHEN n_words > 0 THEN n_shouts / n_words ELSE 0 END AS shouts,
 n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
l AS (SELECT stratum, doc_id, {", ".join(f"max({r}) AS {r}" for r in RULES)} FROM s SEMI JOIN good USING (doc_id) GROUP BY stratum, doc_id),
k AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER ({value} > cutoff) AS k FROM l CROSS JOIN (VALUES {grid}) AS v(rule, cutoff) GROUP BY ALL),
b AS (SELECT *, CASE WHEN k > n * {p} THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))) FROM (SELECT unnest(range(0, k + 1)) AS i)) END AS tail FROM k),
f AS (SELECT stratum, rule, cutoff, bool_and(tail <= {error} / {len(RULES)} / (SELECT count(DISTINCT stratum) FROM s)) OVER (PARTITION BY stratum, rule ORDER BY cutoff DESC) AS safe FROM b),
t AS (SELECT stratum, {", ".join(f"min(cutoff) FILTER (rule = '{r}') AS cut_{r}" for r in RULES)} FROM f WHERE safe GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(f"NOT coalesce({r} > cut_{r}, false)" for r in RULES)} AS kept FROM s LEFT JOIN t USING (stratum)"""
