"""Mixing sources to target weights by iterative proportional fitting. DataFrame functions only."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_tables, fresh

#: The share of all tokens that the sample should have; how far marginals move from their natural shares (1) to equal ones (0).
KEEP, TEMPER = 0.6, 0.7
#: Raking goes on by so many rounds until each category has its target to within this share of all tokens, or so many times.
ROUNDS, TOLERANCE, MOST_TIMES = 8, 1e-4, 5
#: Tables of cells and targets counted to have no more rows than this are raked in one task and broadcast; larger ones are joined by key.
BROADCAST_ROWS = 10_000
UNKNOWN = "unknown"
DIMENSIONS = ("source", "lang", "topic")
# Topics and the strings that speak for them.
TOPICS = (
    ("legal", ("license", "License", "licence", "Licence", "copyright", "Copyright", "rights reserved", "warrant")),
    ("contact", ("@", "http://", "https://", "www.", "tel:")),
    ("table", (" | ", "\t")),
    ("credential", ("password", "passwd", "api_key", "secret", "token=")),
    ("shout", ("!!",)),
)


def hits(text: Column, marks: Sequence[str]) -> Column:
    """How often the whole text has any of the marks, which are ASCII."""
    return sum(((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(m), F.lit("")))) / F.lit(len(m)) for m in marks[1:]), (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(marks[0]), F.lit("")))) / F.lit(len(marks[0])))


def topic_of(text: Column) -> Column:
    """The topic whose marks the whole text has most often, the first of equal ones; 'prose' without any."""
    counted = F.array(*(F.struct(hits(text, marks).alias("n"), F.lit(-i).alias("place"), F.lit(name).alias("topic")) for i, (name, marks) in enumerate(TOPICS)), F.struct(F.lit(0.0).alias("n"), F.lit(1).alias("place"), F.lit("prose").alias("topic")))
    return F.array_max(counted)["topic"]


def tokens_of(text: Column) -> Column:
    """Words of the whole text, between spaces of any kind."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.size(F.array_remove(F.split(text, " "), "")).cast("long")


def drawn_by(doc_id: Column, text: Column) -> Column:
    """What decides whether a row is drawn: its id, or without one its text."""
    return F.coalesce(doc_id.cast("long").cast("string"), F.md5(text))


def uniform(key: Column, seed: str = "mix") -> Column:
    """A number from 0 to 1, the same for a key on every run, from the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def target_shares(cells: DataFrame, dimension: str, temper: float = TEMPER) -> DataFrame:
    """(dimension, share): each category's share of the tokens, raised to the power ``temper`` and made to add up to 1."""
    own = cells.groupBy(dimension).agg(F.sum("base").alias("mass")).where("mass > 0").withColumn("mass", F.pow(F.col("mass") / 1e6, F.lit(temper)))
    return own.select(dimension, (F.col("mass") / own.agg(F.sum("mass")).scalar()).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP, rounds: int = ROUNDS, one_task_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``cells`` (dimensions, base) with w: the tokens to take from each cell. Cells that have a w already are raked on from there.

    Each step multiplies the cells of a category by its target over its present sum, and bounds each cell by the tokens that it has, so that w / base is a
    probability. Up to ``one_task_rows`` cells and targets are counted first and then raked in one task, without an exchange. More of them are raked by grouped
    sums, combined before the shuffle and joined back by key, each step written to the shared folder. Both give the same weights."""
    whole = float(cells.agg(F.sum("base")).first()[0] or 0)
    columns = [c for c in cells.columns if c != "w"]
    small = cells.count() <= one_task_rows and all(t.count() <= one_task_rows for t in targets.values())

    def scaled(step: DataFrame, share: str, sum_w: Column, *kept: str) -> DataFrame:
        factor = F.when(sum_w > 0, F.col(share) * F.lit(float(keep) * whole) / sum_w).otherwise(0.0)
        return step.select(*columns, *kept, F.least(F.col("w") * factor, F.col("base").cast("double")).alias("w"))

    now = cells if "w" in cells.columns else cells.withColumn("w", F.col("base").cast("double") * F.lit(float(keep)))
    if small:
        # Targets are looked up once: a join in every step makes the driver plan and keep a stage for each.
        shares = {d: fresh(now.columns, f"share_{d}") for d in targets}
        now = now.repartition(1)
        for d, target in targets.items():
            now = now.join(F.broadcast(target.withColumnRenamed("share", shares[d])), d, "left")
        for _ in range(rounds):
            for d, share in shares.items():
                now = scaled(now.where(F.col(share).isNotNull()), share, F.sum("w").over(Window.partitionBy(d)), *shares.values())
        return cut(now.select(*columns, "w"), "cells")
    now = cut(now, "cells")
    for _ in range(rounds):
        for d, target in targets.items():
            sums = now.groupBy(d).agg(F.sum("w").alias("sum_w")).join(target, d)
            after = cut(scaled(now.join(sums, d), "share", F.col("sum_w")), "cells")
            drop_tables(now)
            now = after
    return now


def feasible_shares(cells: DataFrame, dimension: str, target: DataFrame, keep: float = KEEP) -> DataFrame:
    """``target`` (dimension, share) with no category asked for more than it has: what one lacks is asked of those that have more, in proportion to their shares."""
    want = float(keep) * float(cells.agg(F.sum("base")).first()[0] or 0)
    has = cut(target.join(cells.groupBy(dimension).agg(F.sum("base").cast("double").alias("has")), dimension), "has")
    scale, was = want, None
    while True:
        short = F.col("share") * F.lit(scale) >= F.col("has")
        n, full, free = has.agg(F.count_if(short), F.sum(F.when(short, F.col("has"))), F.sum(F.when(~short, F.col("share")))).first()
        if n == was or not free:
            return has.select(dimension, (F.least(F.col("share") * F.lit(scale), F.col("has")) / F.lit(want or 1.0)).alias("share"))
        scale, was = (want - (full or 0.0)) / free, n


def marginals(raked: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP) -> DataFrame:
    """(dimension, category, wanted, got): each category's target and what ``raked`` takes of it, as shares of all tokens."""
    whole = float(raked.agg(F.sum("base")).first()[0] or 0) or 1.0
    out = None
    for d, target in targets.items():
        got = raked.groupBy(d).agg(F.sum("w").alias("sum_w"))
        one = target.join(got, d, "left").select(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("category"), (F.col("share") * F.lit(float(keep))).alias("wanted"), (F.coalesce("sum_w", F.lit(0.0)) / F.lit(whole)).alias("got"))
        out = one if out is None else out.union(one)
    return out


def residual(raked: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP) -> float:
    """How far the category that is furthest from its target is, as a share of all tokens."""
    return marginals(raked, targets, keep).agg(F.max(F.abs(F.col("wanted") - F.col("got")))).first()[0] or 0.0


def rake_to_targets(cells: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """``rake`` until each category has its target to within ``TOLERANCE``. How far the marginals are off is logged; single cells may have too few tokens for targets that each dimension could meet."""
    now = rake(cells, targets, keep, rounds)
    for i in range(1, MOST_TIMES + 1):
        off = residual(now, targets, keep)
        if off <= TOLERANCE or i == MOST_TIMES:
            logging.getLogger(__name__).log(logging.INFO if off <= TOLERANCE else logging.WARNING, "after %d rounds no category is further than %.2g of all tokens from its target", i * rounds, off)
            return now
        after = rake(now, targets, keep, rounds)
        drop_tables(now)
        now = after


def with_cells(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, drawn_by) of each row; null categories are 'unknown', null texts are empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.coalesce(F.col(c), F.lit(UNKNOWN)).alias(c) for c in ("source", "lang")), topic_of(text).alias("topic"), tokens_of(text).alias("n_tokens"), drawn_by(F.col("doc_id"), text).alias("drawn_by"))


def probabilities(rows: DataFrame, dimensions: Sequence[str] = DIMENSIONS, keep: float = KEEP, temper: float = TEMPER, rounds: int = ROUNDS, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """(dimensions, base, w, prob): what to sample each cell's documents with. targets: (dimension, share) tables; else tempered natural shares. A cell without tokens is kept whole.

    Targets that a category can't fill are made feasible first, and raking goes on until they are met."""
    dimensions = list(dimensions)
    cells = cut(rows.groupBy(*dimensions).agg(F.sum("n_tokens").alias("base")), "cells")
    targets = targets or {d: cut(target_shares(cells, d, temper), "shares") for d in dimensions}
    full = cells.where("base > 0")
    targets = {d: cut(feasible_shares(full, d, t, keep), "shares") for d, t in targets.items()}
    raked = rake_to_targets(full, targets, keep, rounds).select(*dimensions, "base", "w", (F.col("w") / F.col("base")).alias("prob"))
    return raked.union(cells.where("base = 0").select(*dimensions, "base", F.lit(0.0), F.lit(1.0)))


def sample(rows: DataFrame, dimensions: Sequence[str] = DIMENSIONS, **how) -> DataFrame:
    """``rows`` (doc_id, dimensions, n_tokens, drawn_by) with prob and kept. Rows of a cell that repeat a doc_id stay or go together; of rows without one, those of equal text do."""
    raked = cut(probabilities(rows, dimensions, **how), "raked")
    few = raked.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(raked.drop("base", "w")) if few else raked.drop("base", "w"), list(dimensions))
    return joined.withColumn("kept", uniform(F.col("drawn_by")) < F.col("prob"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its cell, its words, what its cell is sampled with and whether it is kept. Null texts have no words and null categories are
    'unknown'; a cell without words is kept whole; an empty table gives no rows; other columns aren't read."""
    rows = cut(with_cells(spark.read.parquet(f"{sf_dir}/documents.parquet")), "tokens")
    return sample(rows).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("prob", 6).alias("prob"), "kept")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that the sample keeps. The probability is looked up by the row's own categories, so texts aren't shuffled where the table of cells is small."""
    names = docs.columns
    tokens = cut(with_cells(docs), "tokens")
    raked = cut(probabilities(tokens), "raked")
    drop_tables(tokens)
    keys = {d: fresh(names, f"cell_{d}") for d in DIMENSIONS}
    prob = fresh(names, "cell_prob")
    right = raked.select(*(F.col(d).alias(k) for d, k in keys.items()), F.col("prob").alias(prob))
    right = F.broadcast(right) if raked.count() <= BROADCAST_ROWS else right
    text = F.coalesce(docs["text"], F.lit(""))
    on = (F.coalesce(docs["source"], F.lit(UNKNOWN)) == right[keys["source"]]) & (F.coalesce(docs["lang"], F.lit(UNKNOWN)) == right[keys["lang"]]) & (topic_of(text) == right[keys["topic"]])
    return docs.join(right, on).where(uniform(drawn_by(docs["doc_id"], text)) < F.col(prob)).select(*names)


def oracle(keep: float = KEEP, temper: float = TEMPER, rounds: int = ROUNDS, times: int = MOST_TIMES) -> str:
    """The same in DuckDB SQL, with all rounds written out; the first weights that are within the tolerance count."""
    count = lambda marks: " + ".join(f"(strlen(t) - strlen(replace(t, {m}, ''))) / {n}" for m, n in ((f"chr(9)" if m == "\t" else f"'{m}'", len(m)) for m in marks))
    counts = ", ".join(f"{count(marks)} AS n{i}" for i, (_, marks) in enumerate(TOPICS))
    most = f"greatest({', '.join(f'n{i}' for i in range(len(TOPICS)))})"
    cases = " ".join(f"WHEN n{i} = {most} THEN '{name}'" for i, (name, _) in enumerate(TOPICS))
    sql = [
        f"d0 AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, coalesce(text, '') AS t, {counts.replace('(t', '(coalesce(text, {0})').replace('{0}', chr(39) * 2)} FROM documents)",
        f"d AS (SELECT doc_id, source, lang, CASE WHEN {most} = 0 THEN 'prose' {cases} END AS topic, CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens, coalesce(CAST(doc_id AS VARCHAR), md5(t)) AS drawn_by FROM d0)",
        "cells AS (SELECT source, lang, topic, sum(n_tokens) AS base FROM d GROUP BY ALL)",
        f"total AS (SELECT CAST(sum(base) AS DOUBLE) AS n, CAST(sum(base) AS DOUBLE) * {keep} AS want FROM cells)",
    ]
    for x in DIMENSIONS:  # categories full by the order of has / share; the first that isn't sets the scale for the rest
        sql += [
            f"m_{x} AS (SELECT {x}, CAST(sum(base) AS DOUBLE) AS has, pow(sum(base) / 1e6, {temper}) AS mass FROM cells GROUP BY {x} HAVING sum(base) > 0)",
            f"s_{x} AS (SELECT {x}, has, mass / (SELECT sum(mass) FROM m_{x}) AS share FROM m_{x})",
            f"o_{x} AS (SELECT has / share AS full_at, ((SELECT want FROM total) - coalesce(sum(has) OVER (ORDER BY has / share, {x} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(share) OVER (ORDER BY has / share, {x} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM s_{x})",
            f"t_{x} AS MATERIALIZED (SELECT {x}, least(share * (SELECT min_by(scale, full_at) FROM o_{x} WHERE scale <= full_at), has) / (SELECT want FROM total) AS share FROM s_{x})",
        ]
    sql.append(f"w0 AS MATERIALIZED (SELECT source, lang, topic, base, CAST(base AS DOUBLE) * {keep} AS w FROM cells WHERE base > 0)")
    k, taken, earlier = 0, [], ""
    for i in range(times):
        for _ in range(rounds):
            for x in DIMENSIONS:
                sql.append(f"w{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.base, least(c.w * (t.share * (SELECT want FROM total) / s.sum_w), CAST(c.base AS DOUBLE)) AS w FROM w{k} c JOIN (SELECT {x}, sum(w) AS sum_w FROM w{k} GROUP BY {x}) s USING ({x}) JOIN t_{x} t USING ({x}))")
                k += 1
        off = " UNION ALL ".join(f"SELECT abs(t.share * {keep} - s.sum_w / (SELECT n FROM total)) AS off FROM t_{x} t JOIN (SELECT {x}, sum(w) AS sum_w FROM w{k} GROUP BY {x}) s USING ({x})" for x in DIMENSIONS)
        sql.append(f"r{i} AS MATERIALIZED (SELECT max(off) AS off FROM ({off}))")
        enough = "true" if i == times - 1 else f"(SELECT off FROM r{i}) <= {TOLERANCE}"
        taken.append(f"SELECT source, lang, topic, w / base AS prob FROM w{k} WHERE {earlier}{enough}")
        earlier += f"(SELECT off FROM r{i}) > {TOLERANCE} AND "
    sql.append(f"p AS ({' UNION ALL '.join(taken)} UNION ALL SELECT source, lang, topic, 1.0 FROM cells WHERE base = 0)")
    draw = "CAST(('0x' || substr(md5('mix' || drawn_by), 1, 8)) AS BIGINT) / 4294967296.0"
    return "WITH " + ",\n".join(sql) + f"\nSELECT doc_id, source, lang, topic, n_tokens, round(prob, 6) AS prob, {draw} < prob AS kept FROM d JOIN p USING (source, lang, topic)"
