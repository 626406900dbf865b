"""Queries over the driver's tables, which stand in for stored conversations, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyarrow import dataset, fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical, texts, times
from .. import schema
from ..operators import branch, filters, imports, merge, parse, render, summaries
from ..schema import API, LIST_PAYLOAD, LIST_SOURCE, REBUILT, TREE_SOURCE
from ..streaming.ingest import advance, catchup_bound

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages of the tree shape, all on the branch."""
    c = read(spark, sf_dir, "conversations")
    return c.select(F.lit(TREE_SOURCE).alias("source"), F.col("conv_id").alias("conversation_id"), F.col("turn").cast("long").alias("pos"), "role", F.lit(None).cast("string").alias("content_type"), "text")


def list_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows whose list payloads branch: turn n answers n-1, but every fourth one n-2, so that some turns are left behind."""
    c = read(spark, sf_dir, "conversations").where("role <> 'system'")
    parent = F.when(F.pmod("turn", F.lit(4)) == 3, F.col("turn") - 2).otherwise(F.col("turn") - 1)
    node = F.struct(F.col("turn").cast("string").alias("uuid"), parent.cast("string").alias("parent_message_uuid"), F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("sender"), "text")
    g = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", node.alias("n")))), lambda x: x["n"]).alias("chat_messages"), F.max("turn").cast("string").alias("current_leaf_message_uuid"))
    body = F.to_json(F.struct(F.concat(F.lit("chat "), F.col("conv_id").cast("string")).alias("name"), "current_leaf_message_uuid", "chat_messages"))
    return g.select(F.lit(LIST_SOURCE).alias("source"), F.col("conv_id").cast("string").alias("conversation_id"), F.concat(F.lit("chat "), F.col("conv_id").cast("string")).alias("title"), body.alias("raw_json"), F.lit(API).alias("raw_source"))


BRANCH = """WITH RECURSIVE n AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN turn - 2 ELSE turn - 1 END AS parent, text FROM conversations WHERE role <> 'system'),
b AS (SELECT n.conv_id, n.turn, n.parent, n.text FROM n JOIN (SELECT conv_id, max(turn) AS turn FROM n GROUP BY conv_id) l USING (conv_id, turn)
 UNION ALL SELECT n.conv_id, n.turn, n.parent, n.text FROM b JOIN n ON n.conv_id = b.conv_id AND n.turn = b.parent)
"""


@query(BRANCH + "SELECT CAST(conv_id AS VARCHAR) AS conversation_id, CAST(turn AS VARCHAR) AS node_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS pos, coalesce(text, '') AS text FROM b")
def active_branch(spark, sf_dir):
    return branch.active_branch(list_payloads(spark, sf_dir)).select("conversation_id", "node_id", F.col("pos").cast("long").alias("pos"), "text")


@query(BRANCH + "SELECT CAST(conv_id AS VARCHAR) AS conversation_id, '# chat ' || conv_id || e'\\n\\n**Created:** None\\n**Updated:** None\\n**Model:** None\\n\\n---\\n\\n' || string_agg('**' || CASE WHEN role = 'user' THEN 'You' ELSE 'Claude' END || e'**:\\n\\n' || coalesce(b.text, '') || e'\\n\\n---\\n\\n', '' ORDER BY turn) AS content FROM b JOIN (SELECT conv_id, turn, role FROM conversations) USING (conv_id, turn) GROUP BY conv_id")
def list_markdown(spark, sf_dir):
    return render.render(list_payloads(spark, sf_dir), "markdown").select("conversation_id", "content")


@query("SELECT conv_id AS conversation_id, string_agg('**' || CASE role WHEN 'user' THEN 'You' WHEN 'assistant' THEN 'ChatGPT' ELSE coalesce(role, 'unknown') END || e'**:\\n\\n' || text || e'\\n\\n---\\n\\n', '' ORDER BY turn) AS body, count(*) AS messages FROM conversations WHERE coalesce(role, '') <> 'system' AND length(text) > 0 GROUP BY conv_id")
def transcript_markdown(spark, sf_dir):
    shown = linear(spark, sf_dir).where(filters.shown_message() & filters.not_empty())
    part = F.concat(F.lit("**"), texts.sender_label("source", "role"), F.lit("**:\n\n"), "text", F.lit(render.RULE))
    return shown.groupBy("conversation_id").agg(render.joined_in_order(part).alias("body"), F.count(F.lit(1)).alias("messages"))


@query("SELECT conv_id AS conversation_id, CAST(turn AS BIGINT) AS pos, CASE WHEN role = 'user' THEN CASE WHEN row_number() OVER w = 1 THEN 'Human' ELSE 'H' END WHEN role = 'assistant' THEN CASE WHEN row_number() OVER w = 1 THEN 'Assistant' ELSE 'A' END ELSE role END AS label FROM conversations WHERE role <> 'system' AND length(text) > 0 WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)")
def text_labels(spark, sf_dir):
    return render.with_labels(linear(spark, sf_dir).where(filters.shown_message() & filters.not_empty())).select("conversation_id", "pos", "label")


@query("SELECT conv_id AS conversation_id, trim(string_agg(label || ': ' || text || e'\\n\\n', '' ORDER BY turn), e' \\n\\t') AS content FROM (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN CASE WHEN row_number() OVER w = 1 THEN 'Human' ELSE 'H' END WHEN role = 'assistant' THEN CASE WHEN row_number() OVER w = 1 THEN 'Assistant' ELSE 'A' END ELSE role END AS label FROM conversations WHERE role <> 'system' AND length(text) > 0 WINDOW w AS (PARTITION BY conv_id, role ORDER BY turn)) GROUP BY conv_id")
def transcript_text(spark, sf_dir):
    shown = render.with_labels(linear(spark, sf_dir).where(filters.shown_message() & filters.not_empty()))
    return shown.groupBy("conversation_id").agg(texts.strip(render.joined_in_order(F.concat("label", F.lit(": "), "text", F.lit("\n\n")))).alias("content"))


def tree_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows whose tree payloads have a root without message, hidden system turns, left branches as in ``list_payloads``, parts that are no texts, every third
    no current node and every fourth its text outside the parts. Every fifth has no root: its first node's parent is unknown."""
    c = read(spark, sf_dir, "conversations")
    node = lambda turn: F.concat(F.lit("n"), turn.cast("string"))
    up = F.when(F.pmod("turn", F.lit(4)) == 3, F.col("turn") - 2).otherwise(F.col("turn") - 1)
    c = c.withColumn("up", F.when(up >= 0, node(up)).otherwise("root"))
    parts = F.when(F.col("conv_id") % 4 == 3, F.array().cast("array<variant>")).otherwise(F.array(F.col("text").cast("variant"), F.parse_json(F.lit('{"asset": 1}')), F.lit("again").cast("variant")))
    content = F.struct(F.lit("text").alias("content_type"), parts.alias("parts"), F.when(F.col("conv_id") % 4 == 3, F.col("text")).alias("text"))
    slug = F.when(F.col("role") == "assistant", F.concat(F.lit("m"), (F.col("turn") + F.col("conv_id") % 3).cast("string")))
    message = F.struct(F.struct("role").alias("author"), content.alias("content"), F.struct(slug.alias("model_slug")).alias("metadata"))
    children = c.groupBy("conv_id", F.col("up").alias("of")).agg(F.sort_array(F.collect_list(node(F.col("turn")))).alias("children"))
    c = c.join(children.withColumnRenamed("conv_id", "of_conv"), (F.col("conv_id") == F.col("of_conv")) & (node(F.col("turn")) == F.col("of")), "left")
    value = F.struct(F.col("up").alias("parent"), F.coalesce("children", F.array().cast("array<string>")).alias("children"), message.alias("message"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.to_json(value).alias("v")))), lambda x: F.concat(F.lit('"'), node(x["turn"]), F.lit('":'), x["v"]))
    root = F.when(F.col("conv_id") % 5 != 0, '"root":{"parent":null,"children":["n0"],"message":null},').otherwise("")
    now = F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit('"current_node":"'), node(F.max("turn")), F.lit('",'))).otherwise("")
    g = c.groupBy("conv_id").agg(now.alias("now"), F.array_join(entries, ",").alias("nodes"))
    body = F.concat(F.lit('{"title":"tree '), F.col("conv_id").cast("string"), F.lit('","create_time":1700000000.5,'), "now", F.lit('"mapping":{'), root, "nodes", F.lit("}}"))
    return g.select(F.lit(TREE_SOURCE).alias("source"), F.col("conv_id").cast("string").alias("conversation_id"), F.concat(F.lit("tree "), F.col("conv_id").cast("string")).alias("title"), body.alias("raw_json"), F.lit(API).alias("raw_source"))


TREE = """WITH RECURSIVE n AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 4 = 3 THEN coalesce(text, '') ELSE coalesce(text || e'\\n', '') || 'again' END AS text, CASE WHEN turn % 4 = 3 THEN turn - 2 ELSE turn - 1 END AS up FROM conversations),
leaf AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN min(turn) FILTER (NOT EXISTS (SELECT 1 FROM n c WHERE c.conv_id = n.conv_id AND c.up = n.turn)) ELSE max(turn) END AS turn FROM n GROUP BY conv_id),
w AS (SELECT n.* FROM n JOIN leaf USING (conv_id, turn) UNION ALL SELECT n.* FROM w JOIN n ON n.conv_id = w.conv_id AND n.turn = w.up),
b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, text FROM w QUALIFY role IS DISTINCT FROM 'system'),
shown AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY pos) AS nth FROM b WHERE length(text) > 0)
"""


@query(TREE + "SELECT CAST(conv_id AS VARCHAR) AS conversation_id, 'n' || turn AS node_id, CAST(pos AS BIGINT) AS pos, role, text FROM b")
def tree_branch(spark, sf_dir):
    return branch.active_branch(tree_payloads(spark, sf_dir)).select("conversation_id", "node_id", F.col("pos").cast("long").alias("pos"), "role", "text")


@query(TREE + "SELECT CAST(c.conv_id AS VARCHAR) AS conversation_id, '# tree ' || c.conv_id || e'\\n\\n**Created:** 2023-11-14T22:13:20.500000+00:00\\n**Updated:** unknown\\n\\n---\\n\\n' || coalesce(string_agg('**' || CASE role WHEN 'user' THEN 'You' WHEN 'assistant' THEN 'ChatGPT' ELSE role END || e'**:\\n\\n' || text || e'\\n\\n---\\n\\n', '' ORDER BY pos), '') AS content FROM (SELECT DISTINCT conv_id FROM n) c LEFT JOIN shown USING (conv_id) GROUP BY c.conv_id")
def tree_markdown(spark, sf_dir):
    return render.render(tree_payloads(spark, sf_dir), "markdown").select("conversation_id", "content")


@query(TREE + "SELECT CAST(conv_id AS VARCHAR) AS conversation_id, 'tree ' || conv_id || e'\\n\\n---\\n\\n' || rtrim(string_agg(CASE WHEN role = 'user' THEN CASE nth WHEN 1 THEN 'Human' ELSE 'H' END WHEN role = 'assistant' THEN CASE nth WHEN 1 THEN 'Assistant' ELSE 'A' END ELSE role END || ': ' || text, e'\\n\\n' ORDER BY pos), e' \\n\\t') AS content FROM shown GROUP BY conv_id")
def tree_text(spark, sf_dir):
    return render.render(tree_payloads(spark, sf_dir), "text").select("conversation_id", "content")


@query("SELECT CAST(conv_id AS VARCHAR) AS conversation_id, 'm' || (min(turn) + conv_id % 3) AS model FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def tree_model(spark, sf_dir):
    return tree_payloads(spark, sf_dir).select("conversation_id", branch.first_model().alias("model")).where("model is not null")


@query("SELECT conv_id, CAST(turn AS BIGINT) AS turn, node FROM (SELECT conv_id, turn, 'n' || turn AS node FROM conversations WHERE role <> 'system')")
def tree_ids(spark, sf_dir):
    """Every node of the trees that shows a message of a side, on the branch or not."""
    m = branch.tree_messages(tree_payloads(spark, sf_dir)).where("role in ('user', 'assistant')")
    return m.select(F.col("conversation_id").cast("long").alias("conv_id"), F.substring("node_id", 2, 9).cast("long").alias("turn"), F.col("node_id").alias("node"))


HASHES = "SELECT conv_id, sha256(string_agg(sha256(coalesce(text, '')), '' ORDER BY turn)) AS h FROM conversations GROUP BY conv_id"


def _hashes(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.sha2(render.joined_in_order(F.sha2(F.coalesce("text", F.lit("")), 256), "turn"), 256).alias("h"))


@query(f"WITH n AS ({HASHES}), o AS (SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'x' ELSE h END AS h FROM n WHERE conv_id % 3 <> 0) SELECT CASE WHEN o.conv_id IS NULL THEN 'inserted' WHEN o.h = n.h THEN 'unchanged' ELSE 'updated' END AS outcome, count(*) AS n FROM n LEFT JOIN o USING (conv_id) GROUP BY 1")
def upsert_outcome(spark, sf_dir):
    h = _hashes(spark, sf_dir)
    null = F.lit(None)
    row = h.select(F.lit(LIST_SOURCE).alias("source"), F.col("conv_id").cast("string").alias("conversation_id"), F.lit("t").alias("title"), null.cast("string").alias("model"), *(null.cast("timestamp").alias(c) for c in ("created_at", "updated_at")), *(null.cast("string").alias(c) for c in ("created_text", "updated_text")), F.lit("{}").alias("raw_json"), F.lit(API).alias("raw_source"), F.col("h").alias("content_hash"), null.cast("timestamp").alias("imported_at"), "conv_id")
    old = row.where("conv_id % 3 <> 0").withColumn("content_hash", F.when(F.col("conv_id") % 5 == 0, "x").otherwise(F.col("content_hash")))
    return merge.outcome_counts(merge.outcomes(old, row))


@query("SELECT conv_id, turn, sha256(text) AS hash FROM conversations")
def turn_hash(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", canonical.text_hash("text").alias("hash"))


@query("SELECT event_id, ts FROM events e WHERE NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id = e.event_id AND o.ts = e.ts AND o.event_type <> 'error')")
def unchanged_skip(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    stored = e.withColumn("ts", F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("ts")))  # every row is stored, errors without a time
    return filters.unchanged_skip(e, stored, ["event_id"], "ts", "ts").select("event_id", "ts")


@query("WITH p AS (SELECT event_id, ts, (row_number() OVER (ORDER BY ts DESC, event_id) - 1) // 100 AS page FROM events), s AS (SELECT min(page) AS stop FROM (SELECT page, min(ts) AS oldest FROM p GROUP BY page) WHERE oldest < TIMESTAMP '2024-01-20') SELECT event_id, CAST(page AS BIGINT) AS page FROM p, s WHERE stop IS NULL OR page <= stop")
def paged_early_stop(spark, sf_dir):
    paged = summaries.pages(read(spark, sf_dir, "events").select("event_id", "ts"), [F.desc("ts"), F.col("event_id")], 100, F.to_date("ts"))
    return summaries.early_stop(paged, "ts", F.expr("TIMESTAMP_NTZ'2024-01-20'")).select("event_id", "page")


@query("SELECT event_id, CAST(CASE WHEN a >= 2.25 THEN 20 WHEN a >= 1.2 THEN 5 ELSE 0.5 END AS DOUBLE) AS pace FROM (SELECT event_id, avg(user_id % 4) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS a FROM events)")
def adaptive_pace(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("retries", F.col("user_id") % 4)
    return summaries.adaptive_pace(e, "event_type", "event_id", "retries").select("event_id", F.col("pace").cast("double").alias("pace"))


@query("WITH i AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events) SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM i WHERE event_type = 'error' GROUP BY user_id, run HAVING count(*) >= 2")
def failure_runs(spark, sf_dir):
    return summaries.failure_runs(read(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error", 2)


@query("SELECT event_type, max(ts) AS newest FROM events GROUP BY event_type")
def newest_update_per_source(spark, sf_dir):
    return summaries.newest(read(spark, sf_dir, "events"), "event_type", "ts")


@query("SELECT user_id, min_by(event_type, event_id) AS first_value FROM events WHERE length(event_type) > 0 GROUP BY user_id")
def first_model(spark, sf_dir):
    return summaries.first_non_empty(read(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("SELECT event_type, props, CAST(rn AS BIGINT) AS rn, total, CAST(greatest(total - 10, 0) AS BIGINT) AS more FROM (SELECT event_type, props, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS total FROM events) WHERE rn <= 10")
def top_titles(spark, sf_dir):
    return summaries.top_titles(read(spark, sf_dir, "events"), "event_type", "props", "event_id").withColumn("rn", F.col("rn").cast("long")).withColumn("more", F.col("more").cast("long"))


@query("SELECT event_type AS source, 'new' AS verb, count(*) || ' new ' || event_type || ' conversation' || CASE WHEN count(*) <> 1 THEN 's' ELSE '' END || e':\\n' || array_to_string(list_transform(list(event_id ORDER BY event_id)[1:10], lambda x: '- ' || x), e'\\n') || CASE WHEN count(*) > 10 THEN e'\\n- (+' || (count(*) - 10) || ' more)' ELSE '' END AS note FROM events GROUP BY event_type")
def change_notes(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    first = summaries.top_titles(e, "event_type", "event_id", "event_id")
    g = first.groupBy(F.col("event_type").alias("source")).agg(F.max("total").alias("n"), F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")).alias("titles"))
    return summaries.change_notes(g.withColumn("verb", F.lit("new")), total="n")


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def json_field_sum(spark, sf_dir):
    return summaries.field_sum(read(spark, sf_dir, "events"), "event_type", "props", "$.k").withColumnRenamed("total", "k")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate IS NULL OR (o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1995-06-01')")
def range_filter_null_pass(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.where(filters.between_or_null("o_orderdate", F.expr("TIMESTAMP_NTZ'1995-01-01'"), F.expr("TIMESTAMP_NTZ'1995-06-01'"))).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND (o_orderdate IS NULL OR o_orderdate >= TIMESTAMP '1995-01-01')")
def select_by_model(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("model", F.col("o_orderpriority"))
    return filters.select_conversations(o, after=F.expr("TIMESTAMP_NTZ'1995-01-01'"), model="1-URGENT", updated="o_orderdate").select("o_orderkey")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def count_by_source(spark, sf_dir):
    return summaries.count_by(read(spark, sf_dir, "documents"), "source")


@query("SELECT lang, source, max(doc_id) AS doc_id FROM documents GROUP BY lang, source")
def name_collision_last_wins(spark, sf_dir):
    return render.last_per_name(read(spark, sf_dir, "documents").select("lang", "source", "doc_id"), ["lang", "source"], "doc_id")


@query("SELECT doc_id, CAST(i AS BIGINT) AS i, text[i * 4000 + 1:(i + 1) * 4000] AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 4000) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)")
def message_chunks(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(texts.chunks("text")).alias("i", "chunk")).withColumn("i", F.col("i").cast("long"))


@query("SELECT doc_id, trim(regexp_replace(CASE WHEN instr(text, 'the') > 0 THEN substr(text, instr(text, 'the')) ELSE text END, '^(the:?)\\*+', '\\1'), e' \\n\\t\\r\\x0b\\x0c') AS tail FROM documents")
def extract_tail(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", texts.from_label("text", "the").alias("tail"))


@query("SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 300) || '...' END AS excerpt, substr('Q: ' || trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 100) AS line FROM documents")
def excerpts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", texts.excerpt("text").alias("excerpt"), texts.one_line("text", "Q: ").alias("line"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html FROM pages")
def escaped_html(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", texts.html_escape("html").alias("html"))


@query("SELECT page_id, coalesce(nullif(substr(regexp_replace(url, '[\\\\/:*?\"<>|]', '_', 'g'), 1, 150), ''), 'untitled') AS name FROM pages")
def safe_filename(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", texts.safe_filename("url").alias("name"))


@query("SELECT event_type, least(max(ts), TIMESTAMP '2024-01-25' - INTERVAL 2 MINUTE) AS after FROM events GROUP BY event_type")
def catchup_bounds(spark, sf_dir):
    g = read(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("m"))
    return g.select("event_type", catchup_bound(F.col("m"), F.lit(None).cast("timestamp_ntz"), F.expr("TIMESTAMP_NTZ'2024-01-25'")).alias("after"))


@query("SELECT source, CASE WHEN failed = 0 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS last_success_at FROM (SELECT event_type AS source, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY event_type)")
def watermark_advance(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.count_if(F.col("event_type") == "error").alias("failed"))
    state = e.select("source", F.expr("TIMESTAMP_NTZ'2024-01-01'").alias("last_success_at"), F.lit(None).cast("string").alias("last_error"))
    return advance(state, e.withColumn("error", F.lit(None).cast("string")), F.expr("TIMESTAMP_NTZ'2024-02-01'")).select("source", "last_success_at")


@query("WITH d AS (SELECT doc_id, source, lang, n_chars % 7 AS made, doc_id % 2 = 0 AS api FROM documents) SELECT doc_id FROM d WHERE api OR NOT EXISTS (SELECT 1 FROM d n WHERE n.api AND n.source = d.source AND n.lang = d.lang AND n.made = d.made AND n.doc_id <> d.doc_id)")
def supersede_anti(spark, sf_dir):
    """All documents are stored, the odd ones as rebuilt, with seven creation times; all even ones come in again."""
    even = F.col("doc_id") % 2 == 0
    d = read(spark, sf_dir, "documents").select("source", F.col("lang").alias("title"), (F.col("n_chars") % 7).alias("created_at"), F.col("doc_id").alias("conversation_id"), F.when(even, API).otherwise(REBUILT).alias("raw_source"))
    return merge.without_superseded(d, d.where(F.col("raw_source") == API)).select(F.col("conversation_id").alias("doc_id"))


@query("SELECT event_id AS update_id, props FROM events WHERE event_id >= 900 AND user_id = 7 AND length(props) > 0")
def offset_consume(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("update_id"), F.struct(F.struct(F.col("user_id").alias("id")).alias("chat"), F.col("props").alias("text")).alias("message"))
    return filters.accepted_updates(e, 7, 900).select("update_id", F.col("message.text").alias("props"))


@query("SELECT o_orderstatus AS source, CAST(o_orderkey AS VARCHAR) AS conversation_id, o_orderpriority AS title, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderstatus, CAST(o_orderkey AS VARCHAR) LIMIT 25")
def newest_first_topk(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("source"), F.col("o_orderkey").cast("string").alias("conversation_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("created_at"))
    return summaries.newest_first(o, 25)


@query("SELECT event_id, CAST(i AS BIGINT) AS i, n, CASE WHEN m > 0 THEN i / m ELSE 0 END AS rate FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n, CAST(event_id % 60 AS DOUBLE) AS m FROM events)")
def progress_rate(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("m", (F.col("event_id") % 60).cast("double"))
    return summaries.progress(e, "user_id", "event_id", F.col("m")).select("event_id", F.col("i").cast("long").alias("i"), "n", "rate")


@query("SELECT conv_id, turn FROM conversations WHERE text IS NULL OR NOT starts_with(text, 'Th')")
def title_prefix_filter(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("source", F.lit(LIST_SOURCE))
    return c.where(filters.not_scratch("text", "source", "Th")).select("conv_id", "turn")


@query("SELECT source, CAST(conv_id AS VARCHAR) AS conversation_id, CASE WHEN source = 'claude' AND NOT listed THEN false ELSE conv_id % 6 > 2 END AS valid FROM (SELECT conv_id, count(*) FILTER (role <> 'system') > 0 AS listed FROM conversations GROUP BY conv_id), (VALUES ('claude'), ('chatgpt')) s(source) WHERE source = 'chatgpt' OR listed")
def payload_validity(spark, sf_dir):
    """Both shapes; half of the payloads are empty objects, have no messages, or aren't JSON."""
    kind = F.col("conversation_id").cast("long") % 6
    empty = F.when(F.col("source") == LIST_SOURCE, '{"name": "x", "chat_messages": []}').otherwise('{"title": "x", "mapping": {}}')
    rows = list_payloads(spark, sf_dir).unionByName(tree_payloads(spark, sf_dir))
    rows = rows.withColumn("raw_json", F.when(kind == 0, "{}").when(kind == 1, empty).when(kind == 2, "{broken").otherwise(F.col("raw_json")))
    return rows.select("source", "conversation_id", filters.valid_payload().alias("valid"))


@query("SELECT conv_id FROM (SELECT DISTINCT conv_id, substr(sha256(CAST(conv_id AS VARCHAR)), 1, 18 + CAST(conv_id % 10 AS INT)) AS h FROM conversations) WHERE regexp_matches(h, '^[0-9a-f-]{20,40}$')")
def id_guard(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    h = F.substring(F.sha2(F.col("conv_id").cast("string"), 256), F.lit(1), (F.col("conv_id") % 10 + 18).cast("int"))
    return c.where(filters.valid_id(F.lit(TREE_SOURCE), h))


@query("SELECT 'conversations' AS table_name, count(*) AS n FROM conversations UNION ALL SELECT 'events', count(*) FROM events")
def table_counts(spark, sf_dir):
    return summaries.table_counts({t: read(spark, sf_dir, t) for t in ("conversations", "events")})


@query("WITH l AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT user_id, coalesce(string_agg(event_type, '' ORDER BY event_id), '') AS text FROM events e LEFT JOIN l USING (user_id) WHERE last IS NULL OR event_id >= last GROUP BY user_id")
def token_fold(spark, sf_dir):
    return summaries.fold_events(read(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "signup", F.col("event_type"))


@query("SELECT user_id, bool_or(event_type = 'view') AS got_question, count(*) FILTER (event_type = 'click') AS beats, max_by(CASE event_type WHEN 'purchase' THEN 'sent' ELSE 'failed' END, event_id) FILTER (event_type IN ('purchase', 'error')) AS outcome, bool_or(event_type = 'view') AND coalesce(max_by(event_type, event_id) FILTER (event_type IN ('purchase', 'error')) = 'purchase', false) AS passed FROM events GROUP BY user_id")
def verdict(spark, sf_dir):
    line = F.when(F.col("event_type") == "view", "Question: x").when(F.col("event_type") == "click", "[heartbeat] ping sent").when(F.col("event_type") == "purchase", summaries.SENT).when(F.col("event_type") == "error", "Council failed: x").otherwise("")
    return summaries.verdicts(read(spark, sf_dir, "events").withColumn("value", line), "user_id", "event_id")


@query("SELECT count(*) FILTER (sha256(text) <> CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE sha256(text) END) AS changed, count(*) AS total FROM documents")
def rehash_report(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("changed", F.sha2("text", 256) != F.when(F.col("doc_id") % 4 == 0, "x").otherwise(F.sha2("text", 256)))
    return merge.rehash_report(d)


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS pos, role, text FROM conversations WHERE role IN ('user', 'assistant')")
def markdown_roundtrip(spark, sf_dir):
    shown = linear(spark, sf_dir).where(F.col("role").isin("user", "assistant"))
    part = F.concat(F.lit("**"), texts.sender_label("source", "role"), F.lit("**:\n\n"), F.coalesce("text", F.lit("")), F.lit(render.RULE))
    files = shown.groupBy("conversation_id").agg(F.concat(F.lit("# t\n\n**Created:** unknown\n**Updated:** unknown\n\n---\n\n"), render.joined_in_order(part)).alias("value")).withColumn("source", F.lit(TREE_SOURCE))
    good = parse.parse_markdown(files).where("error is null")
    return good.select(F.col("conversation_id").alias("conv_id"), F.posexplode("messages").alias("pos", "m")).select("conv_id", F.col("pos").cast("long").alias("pos"), "m.role", "m.text")


@query("SELECT conv_id, turn FROM conversations ORDER BY sha256(CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)), conv_id, turn LIMIT 1")
def random_sample(spark, sf_dir):
    return summaries.random_one(read(spark, sf_dir, "conversations").select("conv_id", "turn"), by=("conv_id", "turn"))


@query("SELECT event_id, epoch_us(ts) AS us FROM events")
def api_timestamps(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    as_text = F.when(F.col("event_id") % 2 == 0, F.col("us").cast("decimal(38,6)").__truediv__(1_000_000).cast("string")).otherwise(times.iso_text(F.timestamp_micros("us")))
    return e.select("event_id", F.unix_micros(times.parse_timestamp(as_text)).alias("us"))


@query("SELECT 'claude' AS source, CAST(conv_id AS VARCHAR) AS conversation_id, 'chat ' || conv_id AS title, CAST(conv_id AS BIGINT) AS pos FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def list_detail_join(spark, sf_dir):
    """A listing and the payloads fetched for it, as rows to store."""
    p = list_payloads(spark, sf_dir)
    listing = p.select(F.col("conversation_id").cast("long").alias("pos"), F.col("conversation_id").alias("id"), F.lit("listed").alias("title"))
    rows = imports.api_rows(listing, p.select(F.col("conversation_id").alias("id"), "raw_json"), LIST_SOURCE)
    return rows.select("source", "conversation_id", "title", "pos")


@query("""SELECT event_id, sha256('{"a": [' || least(event_id % 10, user_id % 10) || ', ' || greatest(event_id % 10, user_id % 10) || '], "k": ' || json_extract_string(props, '$.k') || '}') AS hash FROM events""")
def canonical_hash(spark, sf_dir):
    """The props after a list of two digits, in whatever order; any depth of JSON needs a Python function."""
    digits = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "a": ['), (F.col("event_id") % 10).cast("string"), F.lit(","), (F.col("user_id") % 10).cast("string"), F.lit("]}"))
    return read(spark, sf_dir, "events").select("event_id", canonical.content_hash(digits).alias("hash"))


@query()
def random_pick(spark, sf_dir):
    return summaries.random_one(read(spark, sf_dir, "conversations").select("conv_id", "turn"))


@query("SELECT CAST(conv_id AS VARCHAR) AS conversation_id, 'new ' || conv_id AS title, count(*) FILTER (role <> 'system') AS n FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def streaming_merge(spark, sf_dir):
    """The stored rows after two streams of the same payloads, each twice with an older title: read again and again, taken in once, the newest."""
    from ..sources.snapshots import SnapshotTable
    from ..streaming.ingest import start_merge

    folder = own_folder(spark, "merge")
    null = F.lit(None)
    p = list_payloads(spark, sf_dir)
    p = p.withColumn("age", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("title", F.concat(F.when(F.col("age") == 0, "new ").otherwise("old "), "conversation_id"))
    p = p.withColumn("updated_at", F.timestamp_seconds(F.lit(1_700_000_000) - F.col("age"))).withColumn("content_hash", F.sha2(F.concat("raw_json", "title"), 256))
    rows = p.select("source", "conversation_id", "title", null.cast("string").alias("model"), null.cast("timestamp").alias("created_at"), "updated_at", *(null.cast("string").alias(c) for c in ("created_text", "updated_text")), "raw_json", "raw_source", "content_hash", F.current_timestamp().alias("imported_at"))
    rows.write.parquet(f"{folder}/in")
    table = SnapshotTable(spark, f"{folder}/table", buckets=8)
    for i in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        start_merge(stream, table, f"{folder}/offsets-{i}").awaitTermination()
    return table.read().select("conversation_id", "title", F.size(F.from_json("raw_json", LIST_PAYLOAD)["chat_messages"]).cast("long").alias("n"))


PAGE = 1000
#: Pages that lie in one file; with a file each, the time that a store takes for files outgrows that for rows.
PAGES_A_BLOCK = 64


@lru_cache(2)
def block_of(folder: str, files: tuple[str, ...]) -> pa.Table:
    """The rows of a block of pages, in order, from its files in the folder's store."""
    store, _ = fs.FileSystem.from_uri(folder)
    return dataset.dataset(list(files), filesystem=store, format="parquet").to_table().sort_by([("page", "ascending"), ("place", "ascending")])


def page_of(folder: str, offset: int, limit: int):
    """A page of a listing that lies in a folder as one folder for each block of pages, for the paged source. Pages are full but for the last."""
    store, top = fs.FileSystem.from_uri(folder)
    at = lambda n: f"{top}/block={n}"
    there = lambda n: store.get_file_info(at(n)).type == fs.FileType.Directory
    block, place = divmod(offset // limit, PAGES_A_BLOCK)
    if offset % limit or not there(block):
        return [], False
    files = store.get_file_info(fs.FileSelector(at(block)))
    rows = block_of(folder, tuple(sorted(f.path for f in files if not f.base_name.startswith((".", "_")))))  # files of other runs have other names
    end = (place + 1) * limit
    return rows.slice(place * limit, limit).to_pylist(), end < len(rows) or place + 1 == PAGES_A_BLOCK and there(block + 1)


def listed_pages(spark: SparkSession, events: DataFrame, folder: str) -> None:
    """The events as a listing, newest first, in blocks of pages: times as text or seconds, and none for every seventh."""
    paged = summaries.pages(events.select("event_id", "ts"), [F.desc("ts"), F.col("event_id")], PAGE, F.to_date("ts"))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    text = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 2 == 0, (us.cast("decimal(38,6)") / 1_000_000).cast("string")).otherwise(times.iso_text(F.timestamp_micros(us)))
    rows = paged.select(F.col("event_id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("model"), text.alias("created_at"), text.alias("updated_at"), F.struct((-us).alias("t"), "event_id").alias("o"), "page")
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("o"))).drop("o")
    ranked.withColumn("block", F.floor(F.col("page") / PAGES_A_BLOCK)).repartition("block").write.mode("overwrite").partitionBy("block").parquet(folder)


def own_folder(spark: SparkSession, name: str) -> str:
    """A folder of a query's own in the one that all share."""
    import uuid

    from ..schema import shared_folder

    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


PAGES = f"""WITH p AS (SELECT event_id, ts, (row_number() OVER (ORDER BY ts DESC, event_id) - 1) // {PAGE} AS page, (row_number() OVER (ORDER BY ts DESC, event_id) - 1) % {PAGE} AS place, event_id % 7 <> 0 AS timed FROM events),
"""


@query(PAGES + f"e AS (SELECT page, max_by(timed, place) AS timed, max_by(ts, place) AS ts FROM p GROUP BY page), s AS (SELECT min(page) AS stop FROM e WHERE timed AND ts < TIMESTAMP '2024-01-20') SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN timed THEN epoch_us(ts) ELSE -1 END AS us FROM p, s WHERE (stop IS NULL OR page <= stop) AND (NOT timed OR ts >= TIMESTAMP '2024-01-20')")
def paged_source(spark, sf_dir):
    """The events paged through by the listing source, which stops after the first page that ends before a day."""
    from ..sources.paged import read_listing

    listed_pages(spark, read(spark, sf_dir, "events"), folder := own_folder(spark, "pages"))
    rows = read_listing(spark, f"parley.plans.catalogue:page_of?{folder}", after="2024-01-20T00:00:00Z", size=PAGE)
    return rows.select("id", F.coalesce(F.unix_micros(times.parse_timestamp("updated_at")), F.lit(-1)).alias("us"))


@query("SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 7 <> 0 THEN epoch_us(ts) ELSE -1 END AS us, 1::BIGINT AS n FROM events")
def paged_stream(spark, sf_dir):
    """The events as a stream of a listing that grows between two of three runs of one query: each row comes once."""
    from ..sources.paged import stream_listing

    folder, e = own_folder(spark, "stream"), read(spark, sf_dir, "events")
    for seen in (e.where("ts < timestamp_ntz'2024-01-10'"), e, None):
        if seen is not None:
            listed_pages(spark, seen, f"{folder}/pages")
        rows = stream_listing(spark, f"parley.plans.catalogue:page_of?{folder}/pages", size=PAGE)
        rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{folder}/out").groupBy("id", "updated_at").agg(F.count(F.lit(1)).alias("n"))
    return found.select("id", F.coalesce(F.unix_micros(times.parse_timestamp("updated_at")), F.lit(-1)).alias("us"), "n")


@query("SELECT CAST(conv_id AS VARCHAR) AS conversation_id, 'chat ' || conv_id AS title, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def import_runs(spark, sf_dir):
    """The stored rows after two imports of one listing: the first runs out of time after a third of it, the second takes the rest."""
    from ..sources.snapshots import SnapshotTable
    from ..streaming import cycle

    p = list_payloads(spark, sf_dir)
    listing = p.select(F.col("conversation_id").cast("long").alias("pos"), F.col("conversation_id").alias("id"), "title", F.lit(None).cast("string").alias("model"), F.lit("2024-01-01").alias("created_at"), F.lit("2024-01-02").alias("updated_at"))
    details = lambda rows: p.join(rows.select("id"), F.col("id") == F.col("conversation_id")).select("id", "raw_json", F.lit(1).alias("attempts"))
    table = SnapshotTable(spark, own_folder(spark, "imports"), buckets=8)
    source, third = cycle.Source(LIST_SOURCE, lambda _: listing, details), max(1, listing.count() // 3)
    clock = iter([0.0, 0.0, 9.0]).__next__
    cycle.run_import(table, listing, source, third, 1.0, clock)
    cycle.run_import(table, listing, source, 2 * third)
    return table.read().select("conversation_id", "title", F.size(F.from_json("raw_json", LIST_PAYLOAD)["chat_messages"]).cast("long").alias("n"))


@query("SELECT event_id AS update_id, props AS text FROM events WHERE user_id = 7 AND length(props) > 0 AND event_id > (SELECT max(event_id) FROM events WHERE ts < TIMESTAMP '2024-01-02')")
def inbox(spark, sf_dir):
    """The messages of one chat in an inbox that skips what is there when it begins, and then gets all updates twice over, the second time with a start anew."""
    from ..streaming.ingest import Inbox

    e = read(spark, sf_dir, "events").select("ts", F.col("event_id").alias("update_id"), F.struct(F.struct(F.col("user_id").alias("id")).alias("chat"), F.col("props").alias("text")).alias("message"))
    folder = own_folder(spark, "inbox")
    for updates in (e.where("ts < timestamp_ntz'2024-01-02'"), e, e):
        Inbox(spark, folder, 7).take(updates.drop("ts"))
    return Inbox(spark, folder, 7).table.read().select("update_id", "text")


@query(SQL["list_markdown"])
def rebuilt_markdown(spark, sf_dir):
    """Transcripts taken in from the Markdown of others, and written as Markdown again."""
    rows = list_payloads(spark, sf_dir)
    files = render.render(rows, "markdown").select(F.concat(F.lit("claude-"), "conversation_id", F.lit(".md")).alias("file_name"), F.col("content").alias("value"))
    rebuilt, _, _ = imports.backfill(schema.empty_conversations(spark), files)
    return render.render(rebuilt, "markdown").select("conversation_id", "content")


@query(f"SELECT 'claude-chat ' || conversation_id || '.md' AS file_name, CAST(octet_length(encode(content)) AS BIGINT) AS bytes FROM ({SQL['list_markdown']})")
def exported_files(spark, sf_dir):
    """One file a conversation, by the sink."""
    from ..sources.exports import write_exports

    return write_exports(render.export_files(list_payloads(spark, sf_dir)), own_folder(spark, "exports"))


@query("SELECT CAST(conv_id AS VARCHAR) AS conversation_id, CAST(count(*) AS INTEGER) AS messages, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS asked FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def message_counts(spark, sf_dir):
    """Messages of rebuilt rows, from their file and from their payload."""
    shown = linear(spark, sf_dir).where(F.col("role").isin("user", "assistant"))
    part = F.concat(F.lit("**"), texts.sender_label("source", "role"), F.lit("**:\n\n"), F.coalesce("text", F.lit("")), F.lit(render.RULE))
    files = shown.groupBy("conversation_id").agg(F.concat(F.lit("# t\n\n\n---\n\n"), render.joined_in_order(part)).alias("value"))
    rows, _ = parse.markdown_rows(files.select(F.concat(F.lit("chatgpt-"), F.col("conversation_id").cast("string"), F.lit(".md")).alias("file_name"), "value"))
    asked = F.size(F.filter(F.from_json("raw_json", schema.FLAT_PAYLOAD)["messages"], lambda m: m["role"] == "user"))
    return rows.select("conversation_id", F.col("message_count").alias("messages"), asked.cast("long").alias("asked"))


@query("WITH o AS (SELECT event_id, props, CASE event_type WHEN 'view' THEN 'inserted' WHEN 'click' THEN 'updated' WHEN 'error' THEN 'failed' ELSE 'unchanged' END AS outcome FROM events), t AS (SELECT outcome, string_agg(props, '|' ORDER BY event_id) AS titles FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY event_id) <= 10) GROUP BY outcome) SELECT count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'updated') AS updated, count(*) FILTER (outcome = 'unchanged') AS unchanged, count(*) FILTER (outcome = 'failed') AS failed, coalesce((SELECT titles FROM t WHERE outcome = 'inserted'), '') AS inserted_titles, coalesce((SELECT titles FROM t WHERE outcome = 'updated'), '') AS updated_titles FROM o")
def run_stats(spark, sf_dir):
    outcome = F.when(F.col("event_type") == "view", "inserted").when(F.col("event_type") == "click", "updated").when(F.col("event_type") == "error", "failed").otherwise("unchanged")
    stats = summaries.run_stats(read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("props").alias("title"), outcome.alias("outcome")))
    return stats.withColumns({c: F.array_join(c, "|") for c in ("inserted_titles", "updated_titles")})


@query("SELECT CAST(o_orderkey AS VARCHAR) || '  ' || o_orderpriority AS line FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT count(*) FILTER (o_orderstatus = 'P') || ' of ' || count(*) FROM orders")
def listing_lines(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("conversation_id"), F.col("o_orderpriority").alias("title"), "o_orderstatus")
    return summaries.listing_lines(o, o.where("o_orderstatus = 'P'"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-31 22:00:00' AND TIMESTAMP '1996-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 40")
def select_with_bounds(spark, sf_dir):
    """Bounds as a user writes them, with a zone and as a day, and a limit in the listing's order."""
    o = read(spark, sf_dir, "orders").withColumns({"updated_at": F.col("o_orderdate").cast("timestamp"), "pos": F.struct(-F.unix_micros(F.col("o_orderdate").cast("timestamp")), "o_orderkey")})
    return filters.select_conversations(o, "1995-02-01T00:00:00+02:00", "1996-01-01", limit=40).select("o_orderkey")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^.*/', '') ELSE 'x' END AS id, CASE page_id % 3 WHEN 0 THEN '2024-01-02T03:04:05+00:00' WHEN 1 THEN 'unknown' END AS created FROM pages")
def file_headers(spark, sf_dir):
    """Ids from file names, and times of headers, which stay as they are where they are no times."""
    p = read(spark, sf_dir, "pages")
    stem = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^.*/", "")).otherwise("x")
    name = F.concat(F.lit("claude-"), stem, F.lit(".md"))
    created = F.when(F.col("page_id") % 3 == 0, "2024-01-02T03:04:05Z").when(F.col("page_id") % 3 == 1, "unknown").otherwise("")
    return p.select("page_id", texts.id_from_filename(name, F.lit("claude")).alias("id"), times.lenient_text(created).alias("created"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'e' || event_id END AS text, CASE event_id % 3 WHEN 0 THEN 'few' END AS message_limit FROM events")
def completions(spark, sf_dir):
    """Results that come as JSON text, with and without a limit, or as no JSON."""
    from ..streaming import folds

    body = F.concat(F.lit('{"text": "e'), F.col("event_id").cast("string"), F.lit('"'), F.when(F.col("event_id") % 3 == 0, ', "messageLimit": "few"}').otherwise("}"))
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 2, "no JSON").otherwise(body).alias("result"))
    return folds.completions(e).select("event_id", "text", "message_limit")
