"""Payloads to messages, and the active branch of a message tree.

A branch is walked inside one row over a hash map of the payload's own ids, in a function that gets the ids alone: no join, no recursion, time and memory in
proportion to the messages, and a step already taken ends the walk, so a cycle can't run on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FLAT_PAYLOAD, LIST_PAYLOAD, LIST_SOURCE, REBUILT, TREE_PAYLOAD, TREE_SOURCE
from .filters import shown_message

MESSAGES = ("source", "conversation_id", "pos", "node_id", "parent_id", "role", "content_type", "text", "on_branch")


def on_path(start: str | None, ids: list[str | None], parents: list[str | None], rootless: bool = False) -> list[int | None]:
    """For each id its place on the way from the top down to ``start``, or None: the way up ends at an id that isn't known or was passed before. Of equal ids the last counts. rootless: an id without parent isn't of the way."""
    at = {i: k for k, i in enumerate(ids) if i is not None}
    way: list[int] = []
    passed = set()
    while start in at and start not in passed:
        passed.add(start)
        way.append(at[start])
        start = parents[way[-1]]
    if rootless and way and parents[way[-1]] is None:
        way.pop()
    out: list[int | None] = [None] * len(ids)
    for k, place in enumerate(way):
        out[place] = len(way) - 1 - k
    return out


def places(start: Column, ids: Column, parents: Column, rootless: bool = False) -> Column:
    """``on_path`` of each row's arrays, ids and parents in step."""

    @F.arrow_udf("array<int>")
    def run(starts: pa.Array, ids: pa.Array, parents: pa.Array) -> pa.Array:
        found = [on_path(s, i, p, rootless) if i is not None else None for s, i, p in zip(starts.to_pylist(), ids.to_pylist(), parents.to_pylist())]
        return pa.array(found, pa.list_(pa.int32()))

    return run(start.cast("string"), ids, parents)


def list_text(message: Column) -> Column:
    """Of content parts their texts in one, else the message's own text."""
    parts = F.filter(F.transform(message["content"], lambda c: c["text"]), lambda t: F.length(t) > 0)
    return F.when(F.size(message["content"]) > 0, F.concat_ws("", parts)).otherwise(F.coalesce(message["text"], F.lit("")))


def tree_text(node: Column) -> Column:
    """Of content parts the strings, each on its line, else the content's own text."""
    content = node["message"]["content"]
    parts = F.try_variant_get(content["parts"], "$", "array<variant>")
    strings = F.filter(F.transform(parts, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda p: p.isNotNull())
    return F.when(F.size(parts) > 0, F.concat_ws("\n", strings)).otherwise(F.coalesce(content["text"], F.lit("")))


def list_messages(conversations: DataFrame, id_col: str = "conversation_id", raw: str = "raw_json") -> DataFrame:
    """Every message of list payloads; on the branch are those from the leaf up to and with the root, at their place from the top."""
    p = conversations.select(F.col(id_col).alias("conversation_id"), F.from_json(raw, LIST_PAYLOAD).alias("p")).where(F.size("p.chat_messages") > 0)
    p = p.withColumn("places", places(F.nullif(F.col("p.current_leaf_message_uuid"), F.lit("")), F.col("p.chat_messages.uuid"), F.col("p.chat_messages.parent_message_uuid")))
    m = p.select("conversation_id", F.posexplode(F.zip_with("p.chat_messages", "places", lambda m, at: F.struct(m.alias("m"), at.alias("at")))).alias("i", "e")).select("conversation_id", "i", "e.m", "e.at")
    return m.select(F.lit(LIST_SOURCE).alias("source"), "conversation_id", F.coalesce("at", "i").cast("int").alias("pos"), F.col("m.uuid").alias("node_id"), F.col("m.parent_message_uuid").alias("parent_id"), F.col("m.sender").alias("role"), F.lit(None).cast("string").alias("content_type"), list_text(F.col("m")).alias("text"), F.col("at").isNotNull().alias("on_branch"))


def tree_messages(conversations: DataFrame, id_col: str = "conversation_id", raw: str = "raw_json") -> DataFrame:
    """Every node of tree payloads. The walk starts at the current node, else at the first node of the map without children; the node without parent is the root and not of the branch; hidden messages aren't either."""
    p = conversations.select(F.col(id_col).alias("conversation_id"), F.from_json(raw, TREE_PAYLOAD).alias("p")).where(F.size("p.mapping") > 0)
    first_leaf = F.get(F.filter(F.map_entries("p.mapping"), lambda e: F.coalesce(F.size(e["value"]["children"]), F.lit(0)) <= 0), 0)["key"]
    start = F.coalesce(F.nullif(F.col("p.current_node"), F.lit("")), first_leaf)
    p = p.withColumn("places", places(start, F.map_keys("p.mapping"), F.transform(F.map_values("p.mapping"), lambda v: v["parent"]), rootless=True))
    nodes = F.zip_with(F.map_entries("p.mapping"), "places", lambda e, at: F.struct(e["key"].alias("node_id"), e["value"].alias("v"), at.alias("at")))
    n = p.select("conversation_id", F.posexplode(nodes).alias("i", "e")).select("conversation_id", "i", "e.node_id", "e.v", "e.at")
    role, kind = F.col("v.message.author.role"), F.col("v.message.content.content_type")
    on = F.col("at").isNotNull() & F.col("v.message").isNotNull()
    out = n.select(F.lit(TREE_SOURCE).alias("source"), "conversation_id", F.when(on, F.col("at")).otherwise(F.col("i")).cast("int").alias("pos"), "node_id", F.col("v.parent").alias("parent_id"), F.when(F.col("v.message").isNotNull(), F.coalesce(role, F.lit("unknown"))).alias("role"), kind.alias("content_type"), tree_text(F.col("v")).alias("text"), on.alias("on_branch"))
    return out.withColumn("on_branch", F.col("on_branch") & shown_message())


def flat_messages(conversations: DataFrame, id_col: str = "conversation_id", raw: str = "raw_json") -> DataFrame:
    """The messages of rebuilt payloads: all are of the branch."""
    m = conversations.select("source", F.col(id_col).alias("conversation_id"), F.posexplode(F.from_json(raw, FLAT_PAYLOAD)["messages"]).alias("pos", "m"))
    null = F.lit(None).cast("string")
    return m.select("source", "conversation_id", "pos", null.alias("node_id"), null.alias("parent_id"), F.col("m.role").alias("role"), null.alias("content_type"), F.coalesce("m.text", F.lit("")).alias("text"), F.lit(True).alias("on_branch"))


def messages(conversations: DataFrame) -> DataFrame:
    """One row for each message of each stored conversation, by the shape of its payload."""
    api = conversations.where(F.col("raw_source") != REBUILT)
    parts = [list_messages(api.where(F.col("source") == LIST_SOURCE)), tree_messages(api.where(F.col("source") == TREE_SOURCE)), flat_messages(conversations.where(F.col("raw_source") == REBUILT))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*MESSAGES)


def active_branch(conversations: DataFrame) -> DataFrame:
    """The messages of the branch that is shown, pos counting from its top in steps that may skip hidden ones."""
    return messages(conversations).where("on_branch").drop("on_branch")


def first_model(raw: str | Column = "raw_json") -> Column:
    """The first model named in the order of the tree's map, on the branch or not."""
    mapping = F.from_json(raw, TREE_PAYLOAD)["mapping"]
    return F.get(F.filter(F.transform(F.map_values(mapping), lambda v: v["message"]["metadata"]["model_slug"]), lambda s: F.length(s) > 0), 0)
