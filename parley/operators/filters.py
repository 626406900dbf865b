"""Filters over listings, payloads and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import parse_bound, parse_timestamp
from ..schema import API, LIST_PAYLOAD, LIST_SOURCE, SKIP_CONTENT_TYPES, SKIP_ROLES, TREE_PAYLOAD, TREE_SOURCE

# How scratch titles begin, and the two forms of ids.
SCRATCH_PREFIX = "Council: "
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
NODE_ID = r"^[0-9a-f-]{20,40}$"


def _bound(x):
    return parse_bound(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def between_or_null(column: str | Column, after=None, before=None) -> Column:
    """Both ends belong to the range; a null passes."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(True)
    if after is not None:
        out = out & (c >= _bound(after))
    if before is not None:
        out = out & (c <= _bound(before))
    return c.isNull() | out


def select_conversations(listing: DataFrame, after=None, before=None, date_field: str = "updated", model: str | None = None, created: str = "created_at", updated: str = "updated_at", limit: int = 0) -> DataFrame:
    """Rows of a listing by time (text, numbers or timestamps; null or unreadable passes), and by exact model: a null model fails where one is asked for. limit: so many
    rows, the first of the listing by its column pos, or newest first where it has none; 0 means all."""
    field = created if date_field == "created" else updated
    kind = dict(listing.dtypes)[field]
    value = F.col(field) if kind.startswith("timestamp") else parse_timestamp(field)
    out = listing.where(between_or_null(value, after, before))
    if model:
        out = out.where(F.col("model") == model)
    if not limit:
        return out
    return out.orderBy("pos" if "pos" in listing.columns else F.desc_nulls_last(value)).limit(limit)


def valid_id(source, column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    s = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.when(s == LIST_SOURCE, c.rlike("(?i)" + UUID)).otherwise(c.rlike("(?i)" + NODE_ID)), F.lit(False))


def not_scratch(title: str = "title", source: str = "source", prefix: str = SCRATCH_PREFIX) -> Column:
    """Of the list source, titles with the prefix of scratch conversations go; null titles stay."""
    return (F.coalesce(F.col(source) != LIST_SOURCE, F.lit(True))) | ~F.coalesce(F.startswith(F.col(title), F.lit(prefix)), F.lit(False))


def valid_payload(source: str = "source", raw_json: str = "raw_json") -> Column:
    """A non-empty JSON object with messages, by the source's shape; of another source a non-empty object is enough."""
    raw = F.col(raw_json)
    filled = F.coalesce(F.size(F.json_object_keys(raw)) > 0, F.lit(False))
    messages = F.coalesce(F.size(F.from_json(raw, LIST_PAYLOAD)["chat_messages"]) > 0, F.lit(False))
    nodes = F.coalesce(F.size(F.from_json(raw, TREE_PAYLOAD)["mapping"]) > 0, F.lit(False))
    return filled & F.when(F.col(source) == LIST_SOURCE, messages).when(F.col(source) == TREE_SOURCE, nodes).otherwise(True)


def from_api(conversations: DataFrame) -> DataFrame:
    return conversations.where(F.col("raw_source") == API)


def shown_message(role: str = "role", content_type: str = "content_type") -> Column:
    """Neither of a hidden role nor of a hidden content type; null is neither."""
    return ~F.coalesce(F.col(role).isin(*SKIP_ROLES), F.lit(False)) & ~F.coalesce(F.col(content_type).isin(*SKIP_CONTENT_TYPES), F.lit(False))


def not_empty(source: str = "source", text: str = "text") -> Column:
    """Messages without text stay in the list shape only."""
    return (F.col(source) == LIST_SOURCE) | (F.coalesce(F.length(text), F.lit(0)) > 0)


def accepted_updates(updates: DataFrame, chat_id: int, offset: int = 0) -> DataFrame:
    """Updates at or after an offset from one chat, with text."""
    return updates.where((F.col("update_id") >= offset) & (F.col("message.chat.id") == chat_id) & (F.length("message.text") > 0))


def next_offset(updates: DataFrame, offset: int = 0) -> DataFrame:
    """The offset after all updates, ignored ones too; the one given where there are none."""
    return updates.agg(F.coalesce(F.max("update_id") + 1, F.lit(offset)).cast("long").alias("offset"))


def first_tab(tabs: DataFrame, prefix: str) -> DataFrame:
    """The first page, in order of pos, whose address has a prefix."""
    return tabs.where((F.col("type") == "page") & F.startswith("url", F.lit(prefix))).orderBy("pos").limit(1)


def unchanged_skip(listing: DataFrame, stored: DataFrame, key: list[str], listed_time: str, stored_time: str) -> DataFrame:
    """Rows of the listing that the store doesn't have with the same time. Spark broadcasts the stored keys where their size allows."""
    right = stored.select(*[F.col(k).alias(f"stored_{k}") for k in key], F.col(stored_time).alias("stored_time_"))
    on = F.col(listed_time) == F.col("stored_time_")
    for k in key:
        on = on & (F.col(k) == F.col(f"stored_{k}"))
    return listing.join(right, on, "left_anti")
