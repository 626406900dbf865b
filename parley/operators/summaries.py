"""Counts, firsts, folds and windows over listings, imports and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .segments import BEFORE, CARRY, Pieces

SHOWN_TITLES, RECENT, GIVE_UP = 10, 10, 5
# Mean retries of the last items from which an import waits so many seconds; below all, it waits the base.
PACE_BASE, PACES = 0.5, ((2.25, 20.0), (1.2, 5.0))
# Fixed value: how a log says that the reply was sent.
SENT = "Sent reply to Telegram."


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table."""
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()])


def newest(rows: DataFrame, key: str, time: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(time).alias("newest"))


def first_non_empty(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first value in order that is neither null nor empty; none where there is none."""
    return rows.where(F.length(F.col(value).cast("string")) > 0).groupBy(key).agg(F.min_by(value, order).alias("first_value"))


def top_titles(rows: DataFrame, key: str, title: str, order: str, shown: int = SHOWN_TITLES) -> DataFrame:
    """The first titles of each key in order, and how many more there are. Ranks are cut off before the shuffle and totals are summed before theirs, so a key with most of the rows is no more work than others."""
    ranked = rows.select(key, title, F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("rn")).where(F.col("rn") <= shown)
    totals = rows.groupBy(F.col(key).alias("of_")).agg(F.count(F.lit(1)).alias("total"))
    joined = ranked.join(totals, F.col(key).eqNullSafe(F.col("of_")))
    return joined.select(key, title, "rn", "total", F.greatest(F.col("total") - shown, F.lit(0)).alias("more"))


def change_notes(stats: DataFrame, shown: int = SHOWN_TITLES, total: str | None = None) -> DataFrame:
    """(source, verb, note) of (source, verb, n, titles): what was new or updated, the first titles by line and how many more; nothing for no change.

    ``total``: the column that counts the titles, where ``titles`` holds only the first ones."""
    titles = F.coalesce("titles", F.array().cast("array<string>"))
    head = F.concat(F.col("n").cast("string"), F.lit(" "), "verb", F.lit(" "), "source", F.lit(" conversation"), F.when(F.col("n") != 1, "s").otherwise(""))
    lines = F.array_join(F.transform(F.slice(titles, 1, shown), lambda t: F.concat(F.lit("- "), t)), "\n")
    count = F.col(total) if total else F.size(titles)
    more = F.when(count > shown, F.concat(F.lit("\n- (+"), (count - shown).cast("string"), F.lit(" more)"))).otherwise("")
    note = F.when(F.size(titles) > 0, F.concat(head, F.lit(":\n"), lines, more)).otherwise(F.concat(head, F.lit(" stored")))
    return stats.where(F.col("n") > 0).select("source", "verb", note.alias("note"))


def run_stats(outcomes: DataFrame, position: str = "pos", shown: int = SHOWN_TITLES) -> DataFrame:
    """One row: how many conversations were inserted, updated, unchanged and failed, and the first titles of what was inserted and updated, in order. Ranks are cut off before anything meets, so no task sees all titles."""
    kinds = ("inserted", "updated")
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)"))
    rank = F.row_number().over(Window.partitionBy("outcome").orderBy(F.asc_nulls_first(position), title))
    first = outcomes.where(F.col("outcome").isin(*kinds)).select("outcome", F.col(position).alias("p"), title.alias("t"), rank.alias("rank")).where(F.col("rank") <= shown)
    named = lambda o: F.transform(F.array_sort(F.collect_list(F.when(F.col("outcome") == o, F.struct("rank", "t")))), lambda x: x["t"])
    counts = outcomes.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in (*kinds, "unchanged", "failed")))
    return counts.crossJoin(first.agg(*(named(o).alias(f"{o}_titles") for o in kinds)))


def adaptive_pace(rows: DataFrame, key: str, order: str, retries: str, recent: int = RECENT) -> DataFrame:
    """``rows`` with pace: what to wait after each, from the mean retries of the last items up to it. A key with many rows is cut into pieces, each of which gets the rows just before it."""
    cut = Pieces(rows, key, order)
    w = cut.window().rowsBetween(1 - recent, 0)
    pace = F.lit(PACE_BASE)
    for least, seconds in reversed(PACES):
        pace = F.when(F.col("mean_") >= least, seconds).otherwise(pace)
    known = cut.with_rows_before(recent - 1, retries).withColumn("mean_", F.avg(retries).over(w)).where(~F.col(BEFORE))
    return known.withColumn("pace", pace).select(*rows.columns, "pace")


def failure_runs(rows: DataFrame, key: str, order: str, failed: Column, least: int = GIVE_UP) -> DataFrame:
    """(key, run, n, first, last): runs of failures that no success breaks, of ``least`` or more. A key with many rows is cut into pieces, which carry how many successes came before."""
    cut = Pieces(rows.withColumn("failed_", failed), key, order)
    success = F.when(~F.col("failed_"), 1).otherwise(0)
    islands = cut.with_carry(F.sum(success)).withColumn("run", F.col(CARRY) + F.sum(success).over(cut.window()))
    return islands.where("failed_").groupBy(key, "run").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("last")).where(F.col("n") >= least)


def progress(rows: DataFrame, key: str, order: str, minutes: Column) -> DataFrame:
    """``rows`` with i, n, rate (items a minute, 0 while no time has passed) and eta (minutes left, null at rate 0). A key with many rows is cut into pieces, which carry how many rows came before."""
    cut = Pieces(rows, key, order)
    out = cut.with_carry(F.count(F.lit(1))).withColumn("i", F.col(CARRY) + F.row_number().over(cut.window()))
    out = out.join(rows.groupBy(F.col(key).alias("of_")).agg(F.count(F.lit(1)).alias("n")), F.col(key).eqNullSafe(F.col("of_")))
    out = out.withColumn("rate", F.when(minutes > 0, F.col("i") / minutes).otherwise(0.0))
    return out.withColumn("eta", F.try_divide(F.col("n") - F.col("i"), F.nullif("rate", F.lit(0.0)))).select(*rows.columns, "i", "n", "rate", "eta")


def pages(rows: DataFrame, order: list[Column], size: int, coarse: Column, descending: bool = True) -> DataFrame:
    """``rows`` with page, by place in the whole order.

    coarse: a coarse form of what comes first in the order, such as a day. Rows are numbered within each coarse value, after the number of rows of those
    before it, so that only the counts by coarse value meet in one task."""
    tagged = rows.withColumn("coarse_", coarse)
    first = F.desc_nulls_last("coarse_") if descending else F.asc_nulls_last("coarse_")
    counts = tagged.groupBy("coarse_").agg(F.count(F.lit(1)).alias("n_"))
    before = counts.select(F.col("coarse_").alias("of_"), F.coalesce(F.sum("n_").over(Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    own = tagged.withColumn("own_", F.row_number().over(Window.partitionBy("coarse_").orderBy(*order)))
    joined = own.join(before, own["coarse_"].eqNullSafe(before["of_"]))
    return joined.withColumn("page", F.floor((F.col("before_") + F.col("own_") - 1) / size).cast("long")).drop("coarse_", "of_", "own_", "before_")


def early_stop(paged: DataFrame, time: str, after: Column) -> DataFrame:
    """The pages up to and with the first whose last, oldest row is before ``after``. A page with a null time goes on."""
    ends = paged.groupBy("page").agg(F.min(time).alias("oldest"))
    stop = ends.where(F.col("oldest") < after).agg(F.min("page").alias("stop"))
    return paged.where(F.col("page") <= F.coalesce(stop.scalar(), F.lit((1 << 63) - 1)))


def fold_events(events: DataFrame, key: str, order: str, replaces: Column, text: Column) -> DataFrame:
    """(key, text): the last text that replaces all before it, and what was appended since. Found by the order of the last replacement, so no whole stream is folded in one value."""
    marked = events.select(key, F.col(order).alias("o_"), replaces.alias("r_"), text.alias("t_"))
    last = marked.where("r_").groupBy(F.col(key).alias("of_")).agg(F.max("o_").alias("last_"))
    kept = marked.join(last, F.col(key).eqNullSafe(F.col("of_")), "left").where(F.col("last_").isNull() | (F.col("o_") >= F.col("last_")))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_", F.coalesce("t_", F.lit("")).alias("t_")))), lambda x: x["t_"]), "").alias("text"))


def verdicts(lines: DataFrame, key: str, order: str, text: str = "value") -> DataFrame:
    """(key, got_question, beats, outcome, passed): what a bot's log says of each round trip; the last outcome counts."""
    v = F.col(text)
    outcome = F.when(F.startswith(v, F.lit(SENT)), "sent").when(F.startswith(v, F.lit("Council failed:")), "failed")
    out = lines.withColumn("o_", outcome).groupBy(key).agg(F.max(F.startswith(v, F.lit("Question:"))).alias("got_question"), F.count_if(F.startswith(v, F.lit("[heartbeat] ping sent"))).alias("beats"), F.max_by("o_", F.when(F.col("o_").isNotNull(), F.col(order))).alias("outcome"))
    return out.withColumn("passed", F.col("got_question") & F.coalesce(F.col("outcome") == "sent", F.lit(False)))


def random_one(rows: DataFrame, seed: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row at random; with ``by`` that whose hash of these columns is the least: the same one in every run, however the rows are dealt out."""
    if by:
        return rows.orderBy(F.sha2(F.concat_ws("-", *(F.col(c).cast("string") for c in by)), 256), *by).limit(1)
    return rows.orderBy(F.rand(seed) if seed is not None else F.rand()).limit(1)


def field_sum(rows: DataFrame, key: str, raw_json: str, path: str) -> DataFrame:
    """(key, total): the sum of a whole number in JSON by key; what isn't there or is no number counts nothing."""
    return rows.groupBy(key).agg(F.sum(F.get_json_object(raw_json, path).try_cast("long")).alias("total"))


def list_tables(spark: SparkSession) -> DataFrame:
    """(table_name) of the catalog, sorted."""
    names = sorted(t.name for t in spark.catalog.listTables())
    return spark.createDataFrame([(n,) for n in names], "table_name string")


def browse(spark: SparkSession, name: str) -> DataFrame:
    """All of a table of the catalog; another name is refused before it is read."""
    if not spark.catalog.tableExists(name):
        raise LookupError(f"no table {name}")
    return spark.table(name)


def table_columns(spark: SparkSession, name: str) -> DataFrame:
    """(pos, column_name, data_type) of a table of the catalog."""
    return spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(browse(spark, name).dtypes)], "pos int, column_name string, data_type string")


def newest_first(conversations: DataFrame, limit: int | None = None) -> DataFrame:
    """The list view: no payloads, newest first, unknown times last."""
    out = conversations.select("source", "conversation_id", "title", "created_at").orderBy(F.desc_nulls_last("created_at"), "source", "conversation_id")
    return out.limit(limit) if limit else out


def newest_imports(conversations: DataFrame, limit: int = 8) -> DataFrame:
    """What was stored last."""
    return conversations.select("source", "title", "created_at", "imported_at", "raw_source").orderBy(F.desc_nulls_last("imported_at"), "source", "conversation_id").limit(limit)


def listing_lines(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """(line) of a printed listing: id and title of the selected rows in order, then how many of all they are."""
    line = F.concat_ws("  ", "conversation_id", F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)")))
    total = rows.agg(F.count(F.lit(1))).scalar().cast("string")
    of = selected.agg(F.count(F.lit(1)).alias("n")).select(F.lit(1).alias("k"), F.lit(None).cast("int").alias("pos"), F.concat(F.col("n").cast("string"), F.lit(" of "), total).alias("line"))
    return selected.select(F.lit(0).alias("k"), F.col("pos").cast("int").alias("pos"), line.alias("line")).unionByName(of).orderBy("k", "pos").select("line")
