"""Transcripts: Markdown, plain text and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import indented_json
from ..functions.texts import export_filename, or_else, sender_label, strip
from ..functions.times import iso_text, parse_timestamp
from ..schema import API, FLAT_PAYLOAD, LIST_PAYLOAD, LIST_SOURCE, REBUILT, TREE_PAYLOAD, TREE_SOURCE
from .branch import active_branch
from .filters import not_empty

RULE = "\n\n---\n\n"


def joined_in_order(value: Column, order: Column | str = "pos") -> Column:
    """An aggregate: the values in one text, by order."""
    order = F.col(order) if isinstance(order, str) else order
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), "")


def with_labels(branch: DataFrame) -> DataFrame:
    """``branch`` with label: the first message of a side in full, later ones by its letter; other roles name themselves. Of the list shape all but the human are one side."""
    side = F.when(F.col("source") == LIST_SOURCE, F.when(F.col("role") == "human", "H").otherwise("A")).otherwise(F.when(F.col("role") == "user", "H").when(F.col("role") == "assistant", "A").otherwise(F.coalesce(F.col("role"), F.lit("unknown"))))
    known = side.isin("H", "A") & (F.col("role").isin("user", "assistant") | (F.col("source") == LIST_SOURCE))
    nth = F.row_number().over(Window.partitionBy("source", "conversation_id", "side_").orderBy("pos"))
    full = F.when(side == "H", "Human").otherwise("Assistant")
    return branch.withColumn("side_", side).withColumn("label", F.when(known, F.when(nth == 1, full).otherwise(side)).otherwise(side)).drop("side_")


def heads(conversations: DataFrame) -> DataFrame:
    """(source, conversation_id, title_, markdown_head, text_head). Heads of rebuilt payloads have a line for each thing that is known, as the files that they came from."""
    conversations, rebuilt = conversations.where(F.col("raw_source") != REBUILT), conversations.where(F.col("raw_source") == REBUILT)
    lists = conversations.where(F.col("source") == LIST_SOURCE).withColumn("p", F.from_json("raw_json", LIST_PAYLOAD))
    none = lambda c: F.coalesce(F.col(c), F.lit("None"))
    title = or_else("p.name", "Untitled Conversation")
    lists = lists.select("source", "conversation_id", title.alias("title_"), F.concat(F.lit("**Created:** "), none("p.created_at"), F.lit("\n**Updated:** "), none("p.updated_at"), F.lit("\n**Model:** "), none("p.model"), F.lit(RULE)).alias("markdown_head"), F.concat(title, F.lit("\nModel: "), none("p.model"), F.lit(RULE)).alias("text_head"))
    trees = conversations.where(F.col("source") == TREE_SOURCE).withColumn("p", F.from_json("raw_json", TREE_PAYLOAD))
    when = lambda c: F.coalesce(iso_text(parse_timestamp(c)), F.lit("unknown"))
    title = or_else("p.title", "ChatGPT Conversation")
    trees = trees.select("source", "conversation_id", title.alias("title_"), F.concat(F.lit("**Created:** "), when("p.create_time"), F.lit("\n**Updated:** "), when("p.update_time"), F.lit("\n\n---\n\n")).alias("markdown_head"), F.concat(title, F.lit(RULE)).alias("text_head"))
    flat = rebuilt.withColumn("p", F.from_json("raw_json", FLAT_PAYLOAD))
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"**{name}:** "), c, F.lit("\n")), F.lit(""))
    title = F.coalesce("p.title", F.lit(""))
    model = F.coalesce(F.concat(F.lit("\nModel: "), "p.model"), F.lit(""))
    flat = flat.select("source", "conversation_id", title.alias("title_"), F.concat(line("Created", "p.created_at"), line("Updated", "p.updated_at"), line("Model", "p.model"), F.lit("\n---\n\n")).alias("markdown_head"), F.concat(title, model, F.lit(RULE)).alias("text_head"))
    return lists.unionByName(trees).unionByName(flat)


def render(conversations: DataFrame, fmt: str = "markdown", metadata: bool = True) -> DataFrame:
    """(source, conversation_id, content) of stored rows; any other format than markdown and text is the JSON, indented by two."""
    if fmt not in ("markdown", "text"):
        return conversations.select("source", "conversation_id", indented_json("raw_json").alias("content"))
    keys = ["source", "conversation_id"]
    shown = active_branch(conversations.where(F.col("raw_source") != REBUILT)).where(not_empty()).unionByName(active_branch(conversations.where(F.col("raw_source") == REBUILT)))
    if fmt == "markdown":
        part = F.concat(F.lit("**"), sender_label("source", "role"), F.lit("**:\n\n"), F.col("text"), F.lit(RULE))
        bodies = shown.groupBy(*keys).agg(joined_in_order(part).alias("body"))
        head = F.concat(F.lit("# "), F.col("title_"), F.lit("\n\n"), F.col("markdown_head") if metadata else F.lit(""))
        return heads(conversations).join(bodies, keys, "left").select(*keys, F.concat(head, F.coalesce("body", F.lit(""))).alias("content"))
    bodies = with_labels(shown).groupBy(*keys).agg(joined_in_order(F.concat("label", F.lit(": "), "text", F.lit("\n\n"))).alias("body"))
    return heads(conversations).join(bodies, keys, "left").select(*keys, strip(F.concat(F.col("text_head") if metadata else F.lit(""), F.coalesce("body", F.lit("")))).alias("content"))


def export_files(conversations: DataFrame, fmt: str = "markdown", metadata: bool = True) -> DataFrame:
    """(file_name, content): names come from titles, else ids; of equal names the last row, by processing order ``pos`` if there is one, else by id, wins."""
    extension = {"markdown": "md", "text": "txt"}.get(fmt, "json")
    name = or_else("title", F.col("conversation_id"))
    order = F.col("pos") if "pos" in conversations.columns else F.col("conversation_id")
    named = conversations.select("source", "conversation_id", order.alias("order_"), F.when(F.col("source") == LIST_SOURCE, export_filename(LIST_SOURCE, name, extension)).otherwise(export_filename(TREE_SOURCE, name, extension)).alias("file_name"))
    last = named.groupBy("file_name").agg(F.max_by(F.struct("source", "conversation_id"), "order_").alias("k")).select("file_name", "k.*")
    return render(conversations, fmt, metadata).join(last, ["source", "conversation_id"]).select("file_name", "content")


def last_per_name(rows: DataFrame, name: str | list[str], order: str) -> DataFrame:
    """Of rows with equal names the last by order."""
    names = [name] if isinstance(name, str) else name
    rn = F.row_number().over(Window.partitionBy(*names).orderBy(F.desc(order)))
    return rows.withColumn("rn_", rn).where("rn_ = 1").drop("rn_")


def random_context(conversations: DataFrame, seed: int | None = None) -> DataFrame:
    """The Markdown of one API row at random; none where there is none."""
    api = conversations.where(F.col("raw_source") == API)
    one = api.select("source", "conversation_id").orderBy(F.rand(seed) if seed is not None else F.rand()).limit(1)
    keys = one.select(*(F.col(c).alias(f"one_{c}") for c in one.columns))
    return render(api.join(keys, (F.col("source") == F.col("one_source")) & (F.col("conversation_id") == F.col("one_conversation_id")), "left_semi"))
