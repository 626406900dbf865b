"""Set maintenance: validate, supersede, upsert into a versioned snapshot.

Plain Parquet tables have no MERGE, so a batch and the stored table become the next snapshot by one full outer join on (source, conversation_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import content_hash
from ..schema import API, REBUILT
from .filters import valid_payload

KEY = ("source", "conversation_id")
PAYLOAD = ("title", "model", "created_at", "updated_at", "created_text", "updated_text", "raw_json", "raw_source", "content_hash", "imported_at")


def split_valid(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may be written, and the others: an empty payload must never replace a stored one."""
    marked = incoming.withColumn("valid_", valid_payload())
    return marked.where("valid_").drop("valid_"), marked.where(~F.col("valid_")).drop("valid_")


def last_per_key(incoming: DataFrame, *order: str) -> DataFrame:
    """One row a key: the last in processing order, nulls first. States in between collapse."""
    place = F.struct(*(F.struct(F.col(c).isNotNull().alias("known"), F.col(c).alias("value")) for c in order or ("pos",)))
    return incoming.groupBy(*KEY).agg(F.max_by(F.struct(*incoming.columns), place).alias("r")).select("r.*")


def superseded(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rebuilt rows of a conversation that now comes from the API: equal source, title and creation time, another id. Nulls are equal to nothing."""
    api = incoming.select(*(F.col(c).alias(f"new_{c}") for c in ("source", "title", "created_at", "conversation_id")))
    on = (F.col("source") == F.col("new_source")) & (F.col("title") == F.col("new_title")) & (F.col("created_at") == F.col("new_created_at")) & (F.col("conversation_id") != F.col("new_conversation_id"))
    return stored.where(F.col("raw_source") == REBUILT).join(api, on, "left_semi")


def without_superseded(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    gone = superseded(stored, incoming).select(*(F.col(k).alias(f"gone_{k}") for k in KEY))
    return stored.join(gone, (F.col("source") == F.col("gone_source")) & (F.col("conversation_id") == F.col("gone_conversation_id")), "left_anti")


def outcomes(stored: DataFrame, incoming: DataFrame, touch: bool = False, downgrade: bool = False) -> DataFrame:
    """The full outer join with an outcome: inserted, updated, unchanged for incoming rows, kept for the rest; ``now`` says which side's columns count.

    An unchanged row keeps every stored column (touch: takes the new updated_at). A rebuilt row never replaces one from the API unless downgrade is set."""
    s = stored.select(*KEY, *(F.col(c).alias(f"old_{c}") for c in PAYLOAD), F.lit(True).alias("stored_"))
    n = incoming.select(*KEY, *(F.col(c).alias(f"new_{c}") for c in PAYLOAD), F.lit(True).alias("incoming_"))
    j = s.join(n, list(KEY), "full_outer")
    held = F.lit(False) if downgrade else (F.col("new_raw_source") == REBUILT) & (F.col("old_raw_source") == API)
    outcome = F.when(F.col("incoming_").isNull(), "kept").when(F.col("stored_").isNull(), "inserted").when((F.col("old_content_hash") == F.col("new_content_hash")) | held, "unchanged").otherwise("updated")
    j = j.withColumn("outcome", outcome)
    fresh = F.col("outcome").isin("inserted", "updated")
    newer = (F.col("outcome") == "unchanged") & F.lit(touch)
    columns = [F.when(fresh | (newer if c in ("updated_at", "updated_text") else F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in PAYLOAD]
    return j.select(*KEY, *columns, "outcome")


def merge(stored: DataFrame, incoming: DataFrame, order: str | tuple[str, ...] | None = None, touch: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(next snapshot with outcome, refused rows, superseded rows) of a batch of API rows with content_hash."""
    good, refused = split_valid(incoming)
    good = last_per_key(good, *((order,) if isinstance(order, str) else order)) if order else good
    gone = superseded(stored, good)
    return outcomes(without_superseded(stored, good), good, touch), refused, gone


def outcome_counts(merged: DataFrame) -> DataFrame:
    return merged.where(F.col("outcome") != "kept").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def rehash(stored: DataFrame) -> DataFrame:
    """``stored`` with hashes made anew from its documents, and whether they changed; nothing else is touched."""
    new = F.coalesce(content_hash("raw_json"), F.col("content_hash"))
    return stored.withColumn("new_hash_", new).withColumn("changed", F.col("new_hash_") != F.col("content_hash")).withColumn("content_hash", F.col("new_hash_")).drop("new_hash_")


def rehash_report(rehashed: DataFrame) -> DataFrame:
    return rehashed.agg(F.count_if("changed").alias("changed"), F.count(F.lit(1)).alias("total"))
