"""Pieces that the operators share: shared tables, names, sessions, components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return. ``bytes.split()`` splits at exactly these.
SPACES = " \t\n\x0b\x0c\r"
#: Of tables between steps. A row group is held in memory whole by the task that writes it, and its columns by the one that reads it.
ROW_GROUP_BYTES = 16 << 20
#: Edges of a graph that one task takes.
EDGES_A_TASK = 100_000
#: ``bytes.translate`` table that lower-cases A-Z only.
LOWER_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a session on this machine alone uses a new temporary folder; on a cluster it is an error, as executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="parley-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found if "://" in found or found.startswith("file:") else "file://" + os.path.abspath(found)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for a table or files, in one of this application that goes when it ends."""
    top = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{top}/{name}-{uuid.uuid4().hex}"


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when it has ended, not when the driver next collects garbage. The session's own setting comes back afterwards."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again, so that a lost executor costs no earlier stage."""
    path = new_folder(df.sparkSession, name)
    with short_lived_shuffles(df.sparkSession):
        df.write.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_to_python(df: DataFrame, rows: int = 500) -> DataFrame:
    """``df``, whose rows hold whole texts, in Arrow batches of so few rows that some very long ones among them fit a Python worker's memory."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        df.sparkSession.conf.set(key, str(value))
    return df


def dealt(table: DataFrame, rows_a_task: int, *keys: str) -> DataFrame:
    """``table``, whose few rows stand for much work each, dealt out by its own number of rows; by size alone Spark would put them all in one task."""
    return table.repartition(max(1, -(-table.count() // rows_a_task)), *keys)


def drop_tables(*tables: DataFrame) -> None:
    """Deletes tables made by ``cut`` once nothing reads them any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        conf = t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for f in {x.rsplit("/", 1)[0] for x in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(conf).delete(path, True)


def fresh(columns: list[str], name: str) -> str:
    """A column name like ``name`` that clashes with none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_text(text: str = "text"):
    """The UTF-8 bytes of a text; a null text is an empty one."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def bitmap(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """Which of ``n_bits`` equal ranges of 64-bit hashes a set reaches, as longs. A bit that only one of two sets has is a hash that only that one has, at least."""
    bits = np.zeros(n_bits, np.uint8)
    bits[(hashes >> np.uint64(65 - n_bits.bit_length())).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the documents whose labels are never learned from. A null id counts as an empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that is not the least of its connected component; ``edges`` has (a, b).

    Alternates large-star and small-star steps until the edges are stars around each component's least node. Each step is a grouped minimum (combined before the
    shuffle, so a hub with a third of all edges costs one row a task) and a join with one row a node, which adaptive execution splits where a node is hot.
    Each round is written to the shared folder, by as many tasks as its edges need."""

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least.withColumnRenamed("a", "n"), F.col("a") == F.col("n"))
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return joined.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()

    def seen(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    was = seen(now)
    if not was[0]:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(most_rounds):
        after = cut(stars(stars(now, True), False).coalesce(was[0] // EDGES_A_TASK + 1), "edges")
        found = seen(after)
        drop_tables(now)
        now = after
        if found == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        was = found
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
