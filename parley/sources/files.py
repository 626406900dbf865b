"""Folders of Markdown exports, context folders, log tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown_exports(spark: SparkSession, root: str) -> DataFrame:
    """(path, file_name, value) of the Markdown files in the folders exports* of ``root``."""
    files = spark.read.text(f"{root}/exports*", wholetext=True, pathGlobFilter="*.md")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), "value")


def context(spark: SparkSession, folder: str, root: str | None = None) -> DataFrame:
    """(content, parts): all Markdown and text files below a folder, or one file, each under its path (from ``root`` on, if that is given), in order of paths. What a prompt holds bounds it, not the store."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,txt}")
    path = F.url_decode(F.replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/"), F.lit("+"), F.lit("%2B")))
    if root is not None:
        top = root.rstrip("/") + "/"
        path = F.when(F.startswith(path, F.lit(top)), F.substr(path, F.lit(len(top) + 1))).otherwise(path)
    part = F.concat(F.lit("=== "), path, F.lit(" ===\n"), "value")
    named = files.select(F.col("_metadata.file_path").alias("o"), part.alias("v"))
    return named.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]), "\n\n").alias("content"), F.count(F.lit(1)).alias("parts"))


def tail(spark: SparkSession, path: str, offset: int) -> tuple[str, int]:
    """What stands in a file after a byte offset, and the next offset; nothing of a file that isn't there. For logs; whole folders are read as streams."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return "", offset
    stream = fs.open(p)
    try:
        stream.seek(offset)
        data = bytes(stream.readAllBytes())
    finally:
        stream.close()
    return data.decode("utf-8", "replace"), offset + len(data)


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder)
