"""Markdown transcripts back to messages, each file checked by rendering it again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import id_from_filename, role_of_label, source_from_filename
from ..functions.times import lenient_text
from ..schema import LIST_SOURCE, REBUILT, SENDERS, TREE_SOURCE
from .render import RULE


def _anchor(source: str) -> str:
    return r"(?:\A|\n\n)\*\*(" + "|".join(SENDERS[source].values()) + r")\*\*:\n\n"


def _field(header: Column, name: str) -> Column:
    """The last line of the header that starts with a field's name."""
    mark = f"**{name}:** "
    lines = F.filter(F.slice(F.split(header, "\n"), F.lit(2), F.greatest(F.size(F.split(header, "\n")) - 1, F.lit(0))), lambda x: F.startswith(x, F.lit(mark)))
    return F.substr(F.try_element_at(lines, F.lit(-1)), F.lit(len(mark) + 1))


def parse_markdown(files: DataFrame, text: str = "value", source: str = "source") -> DataFrame:
    """``files`` with title, created, updated, model, messages (role, label, text) and error: null, or why the file can't be trusted."""
    t = F.col(text)
    cut = F.instr(t, RULE)
    df = files.withColumn("header_", F.when(cut > 0, F.substr(t, F.lit(1), cut - 1))).withColumn("body_", F.when(cut > 0, F.substr(t, cut + len(RULE))))
    df = df.withColumn("title", F.substr(F.get(F.split("header_", "\n"), 0), F.lit(3)))
    for c, n in (("created", "Created"), ("updated", "Updated"), ("model", "Model")):
        df = df.withColumn(c, _field(F.col("header_"), n))
    labels = F.when(F.col(source) == LIST_SOURCE, F.regexp_extract_all("body_", F.lit(_anchor(LIST_SOURCE)), F.lit(1))).otherwise(F.regexp_extract_all("body_", F.lit(_anchor(TREE_SOURCE)), F.lit(1)))
    # An anchor takes the line breaks before it, which belong to what stands above; they are put back.
    pieces = F.when(F.col(source) == LIST_SOURCE, F.split("body_", _anchor(LIST_SOURCE), -1)).otherwise(F.split("body_", _anchor(TREE_SOURCE), -1))
    df = df.withColumn("labels_", labels).withColumn("pieces_", pieces)
    n = F.size("labels_")
    bodies = F.transform(F.slice("pieces_", F.lit(2), F.greatest(n, F.lit(0))), lambda p, i: F.when(i < n - 1, F.concat(p, F.lit("\n\n"))).otherwise(p))
    df = df.withColumn("bodies_", bodies)
    ended = F.forall("bodies_", lambda b: F.endswith(b, F.lit(RULE)))
    texts = F.transform("bodies_", lambda b: F.substr(b, F.lit(1), F.length(b) - len(RULE)))
    df = df.withColumn("messages", F.zip_with("labels_", texts, lambda a, b: F.struct(role_of_label(F.col(source), a).alias("role"), a.alias("label"), b.alias("text"))))
    line = lambda c, name: F.coalesce(F.concat(F.lit(f"**{name}:** "), F.col(c), F.lit("\n")), F.lit(""))
    again = F.concat(F.lit("# "), "title", F.lit("\n\n"), line("created", "Created"), line("updated", "Updated"), line("model", "Model"), F.lit("\n---\n\n"), F.array_join(F.transform("messages", lambda m: F.concat(F.lit("**"), m["label"], F.lit("**:\n\n"), m["text"], F.lit(RULE))), ""))
    df = df.withColumn("again_", again)
    error = (
        F.when(~F.coalesce(F.startswith(t, F.lit("# ")), F.lit(False)), "does not start with '# '")
        .when(F.col("body_").isNull(), "no rule after the header")
        .when(n < 1, "no sender in the body")
        .when(~ended, "a message has no rule after it")
        .when(F.col("again_") != t, F.concat(F.lit("rendered again it differs at offset "), first_difference(F.col("again_"), t).cast("string")))
    )
    return df.withColumn("error", error).drop("header_", "body_", "labels_", "pieces_", "bodies_", "again_")


def first_difference(a: Column, b: Column) -> Column:
    """The first offset at which two texts differ; the shorter one's length if it begins the other."""
    n = F.least(F.length(a), F.length(b))
    # Halving: a prefix that is equal moves the lower end up.
    steps = F.sequence(F.lit(1), F.lit(32))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.cast("int").alias("hi")), lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(F.when(F.substr(a, F.lit(1), F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")) == F.substr(b, F.lit(1), F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")), F.struct(F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int").alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (F.floor((s["lo"] + s["hi"] + 1) / 2) - 1).cast("int").alias("hi")))))
    return found["lo"]


def markdown_rows(files: DataFrame, name: str = "file_name", text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows to store, and the files refused: (path columns, error). Files of no known prefix are refused."""
    named = files.withColumn("source", source_from_filename(name))
    known = parse_markdown(named.where(F.col("source").isNotNull()), text)
    refused = named.where(F.col("source").isNull()).select(name, F.lit("no known prefix").alias("error")).unionByName(known.where(F.col("error").isNotNull()).select(name, "error"))
    good = known.where(F.col("error").isNull())
    created, updated = lenient_text("created"), lenient_text("updated")
    body = F.struct("title", created.alias("created_at"), updated.alias("updated_at"), "model", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))
    rows = good.select(
        "source", id_from_filename(name, F.col("source")).alias("conversation_id"), "title", "model",
        F.try_to_timestamp(created).alias("created_at"), F.try_to_timestamp(updated).alias("updated_at"), created.alias("created_text"), updated.alias("updated_text"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("raw_json"), F.lit(REBUILT).alias("raw_source"), F.size("messages").alias("message_count"),
    )
    return rows.withColumn("content_hash", F.sha2("raw_json", 256)), refused
