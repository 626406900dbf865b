"""Tables and payload shapes.

Conversations come in three shapes: a list of messages with parent pointers, a tree kept as a map of nodes, and the flat list rebuilt from a Markdown file."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data model.
LIST_SOURCE, TREE_SOURCE = "claude", "chatgpt"
SOURCES = (LIST_SOURCE, TREE_SOURCE)
API, REBUILT = "api_json", "markdown_reconstructed"
SENDERS = {LIST_SOURCE: {"human": "You", "assistant": "Claude"}, TREE_SOURCE: {"user": "You", "assistant": "ChatGPT"}}
SKIP_ROLES = ("system",)
SKIP_CONTENT_TYPES = ("model_editable_context", "user_editable_context")

_NULLABLE = ("title", "model", "created_at", "updated_at", "created_text", "updated_text")
_TIMES = ("created_at", "updated_at", "imported_at")
CONVERSATIONS = T.StructType([
    T.StructField(n, T.TimestampType() if n in _TIMES else T.StringType(), n in _NULLABLE)
    for n in ("source", "conversation_id", "title", "model", "created_at", "updated_at", "created_text", "updated_text", "raw_json", "raw_source", "content_hash", "imported_at")
])
LIST_PAYLOAD = "struct<uuid:string,name:string,model:string,created_at:string,updated_at:string,current_leaf_message_uuid:string,chat_messages:array<struct<uuid:string,parent_message_uuid:string,sender:string,text:string,content:array<struct<text:string>>>>>"
TREE_PAYLOAD = "struct<id:string,title:string,create_time:string,update_time:string,current_node:string,mapping:map<string,struct<id:string,parent:string,children:array<string>,message:struct<author:struct<role:string>,content:struct<content_type:string,parts:variant,text:string>,metadata:struct<model_slug:string>>>>>"
FLAT_PAYLOAD = "struct<title:string,created_at:string,updated_at:string,model:string,messages:array<struct<role:string,text:string>>>"


def empty_conversations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CONVERSATIONS)


def checked(conversations: DataFrame) -> DataFrame:
    """``conversations`` where every row obeys the constraints of the table; a row that doesn't fails the query."""
    for column, allowed in (("source", SOURCES), ("raw_source", (API, REBUILT))):
        bad = ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))
        conversations = conversations.withColumn(column, F.when(bad, F.raise_error(F.concat(F.lit(f"{column} is not allowed: "), F.coalesce(column, F.lit("null"))))).otherwise(F.col(column)))
    for column in ("conversation_id", "raw_json", "content_hash"):
        conversations = conversations.withColumn(column, F.when(F.col(column).isNull(), F.raise_error(F.lit(f"{column} is null"))).otherwise(F.col(column)))
    return conversations


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and all executors share; where it is unset, a session on this machine alone has a temporary folder, and on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file:{tempfile.gettempdir()}/parley-checkpoints"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of its own in the shared folder, so that all who read it see the same rows. It goes when the application ends."""
    spark = df.sparkSession
    top = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    at = f"{top}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
