"""From a listing and fetched details to rows to store, and an import run as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import content_hash
from ..functions.texts import or_else
from ..functions.times import iso_text, parse_timestamp
from ..schema import API, LIST_PAYLOAD, LIST_SOURCE, TREE_PAYLOAD
from .branch import first_model
from .filters import not_scratch, select_conversations, unchanged_skip, valid_id
from .merge import last_per_key, merge, outcomes
from .parse import markdown_rows
from .summaries import run_stats


def candidates(listing: DataFrame, source: str, stored: DataFrame | None = None, after=None, before=None, date_field: str = "updated", model: str | None = None, limit: int = 0) -> DataFrame:
    """The rows of a listing (pos, id, title, model, created_at, updated_at as text) to fetch: by time, with a proper id, no scratch titles of the list source;
    of the tree source those whose stored time is the listed one are left out, which saves their fetch."""
    rows = select_conversations(listing.withColumn("source", F.lit(source)), after, before, date_field, model if source == LIST_SOURCE else None, limit=limit)
    rows = rows.where(valid_id("source", "id")).where(not_scratch())
    if source != LIST_SOURCE and stored is not None:
        rows = rows.withColumn("listed_time_", iso_text(parse_timestamp("updated_at")))
        known = stored.where(F.col("source") == source).select(F.col("conversation_id").alias("id"), F.col("updated_text"))
        rows = unchanged_skip(rows, known, ["id"], "listed_time_", "updated_text").drop("listed_time_")
    return rows


def api_rows(chosen: DataFrame, details: DataFrame, source: str, now=None) -> DataFrame:
    """Rows to store from the chosen listing rows and their details (id, raw_json). The list source is taken as its payload says; the tree source takes its id
    from the listing, its title from the payload or else the listing, and its model from the first node that names one."""
    j = chosen.select("pos", "id", F.col("title").alias("listed_title")).join(details.where("raw_json is not null").select("id", "raw_json"), "id")
    if source == LIST_SOURCE:
        j = j.withColumn("p", F.from_json("raw_json", LIST_PAYLOAD))
        head = [F.coalesce("p.uuid", "id").alias("conversation_id"), F.col("p.name").alias("title"), F.col("p.model").alias("model")]
        created, updated = F.col("p.created_at"), F.col("p.updated_at")
    else:
        j = j.withColumn("p", F.from_json("raw_json", TREE_PAYLOAD))
        head = [F.col("id").alias("conversation_id"), or_else("p.title", F.col("listed_title")).alias("title"), first_model().alias("model")]
        created, updated = F.col("p.create_time"), F.col("p.update_time")
    times = [parse_timestamp(created).alias("created_at"), parse_timestamp(updated).alias("updated_at"), iso_text(parse_timestamp(created)).alias("created_text"), iso_text(parse_timestamp(updated)).alias("updated_text")]
    return j.select("pos", F.lit(source).alias("source"), *head, *times, "raw_json", F.lit(API).alias("raw_source"), content_hash("raw_json").alias("content_hash"), (now if now is not None else F.current_timestamp()).alias("imported_at"))


def import_run(stored: DataFrame, chosen: DataFrame, details: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(next snapshot with outcome, one row of stats) of one source's import as one plan."""
    merged, refused, gone = merge(stored, api_rows(chosen, details, source), order="pos")
    outcomes = merged.where("outcome <> 'kept'").select("conversation_id", "title", "outcome").unionByName(refused.select("conversation_id", "title", F.lit("failed").alias("outcome")))
    return merged, import_stats(outcomes, gone, chosen, details)


def import_stats(outcomes: DataFrame, gone: DataFrame, chosen: DataFrame, details: DataFrame) -> DataFrame:
    """One row of stats: counts, the first titles, retries, how many rows were superseded, and failed_ids. What could not be fetched or holds no messages counts as failed."""
    places = chosen.select(F.col("id").alias("conversation_id"), "pos", F.col("title").alias("listed"))
    missed = details.where("raw_json is null").select(F.col("id").alias("conversation_id"), F.lit(None).cast("string").alias("title"), F.lit("failed").alias("outcome"))
    all_ = outcomes.select("conversation_id", "title", "outcome").unionByName(missed).join(places, "conversation_id", "left")
    all_ = all_.withColumn("title", F.when(F.col("outcome") == "failed", F.col("listed")).otherwise(F.col("title")))
    retries = details.agg(F.coalesce(F.sum(F.col("attempts") - 1), F.lit(0)).cast("long")).scalar()
    stats = run_stats(all_).withColumn("retries", retries).withColumn("superseded", gone.agg(F.count(F.lit(1))).scalar())
    return stats.withColumn("failed_ids", all_.where("outcome = 'failed'").agg(F.collect_set("conversation_id")).scalar())


def backfill(stored: DataFrame, files: DataFrame, name: str = "file_name", text: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(next snapshot with outcome, refused files, one row of counts) of Markdown files (file_name, value). A file replaces a stored row of its key whose hash differs,
    also one from the API; of files with one key the last by name counts. Nothing is written: without a replace it is a dry run."""
    rows, refused = markdown_rows(files, name, text)
    rows = last_per_key(rows.withColumn("imported_at", F.current_timestamp()), "raw_json")
    merged = outcomes(stored, rows, downgrade=True)
    counts = merged.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("inserted", "updated", "unchanged")), F.count(F.lit(1)).alias("total"))
    return merged, refused, counts.withColumn("refused", refused.agg(F.count(F.lit(1))).scalar())
