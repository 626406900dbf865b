"""Token counts from flat token files without an index: find end-of-document ids block by block, stitch documents across blocks with a prefix scan."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, dealt, new_folder, texts_to_python
from .files import Reader, opened

#: Tokens in a block that one range read fetches; blocks in a group of the prefix scan's first level.
BLOCK_TOKENS = 1 << 20
GROUP_BLOCKS = 1024
#: Files whose sizes a task looks up, and blocks that one searches.
FILES_A_TASK, BLOCKS_A_TASK = 64, 16
#: Tokens after which the writer starts another file.
FILE_TOKENS = 1 << 24
EOD = 50256


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def write_token_files(docs: DataFrame, folder: str, eod: int = EOD, vocabulary: tuple[str, str] | None = None, dtype: str = "<u2", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """(uri, ordinal, doc_id): writes each text's ids, each document followed by ``eod``, to flat files in ``folder``, and returns which document stands where.

    Each task attempt writes files of its own names; only those in the returned, written table count, so a lost or repeated task leaves no wrong file in it."""
    path, pattern = vocabulary or default_vocabulary()
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern).encode_ordinary
        store, top = opened(folder)
        out, uri, written, ordinal = None, "", 0, 0
        mark = np.array([eod], dtype).tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, uris, ordinals = batch.slice(start, 256), [], []
                for text in part.column(1):
                    if out is None or written >= file_tokens * width:
                        if out is not None:
                            out.close()
                        name, written, ordinal = f"{uuid.uuid4().hex}.bin", 0, 0
                        out, uri = store.open_output_stream(f"{top}/{name}"), f"{folder}/{name}"
                    data = np.array(encode(text.as_py()), dtype).tobytes() + mark
                    out.write(data)
                    uris.append(uri)
                    ordinals.append(ordinal)
                    written, ordinal = written + len(data), ordinal + 1
                yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array(ordinals, pa.int64()), part.column(0)], names=["uri", "ordinal", "doc_id"])
        if out is not None:
            out.close()

    return cut(texts_to_python(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "uri string, ordinal long, doc_id long"), "token-manifest")


def scan_token_files(files: DataFrame, eod: int = EOD, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """(uri, ordinal, start, n_tokens, ended) for each document of the files in column uri: where it starts, how many tokens it has without its separator, and whether one ends it.

    Blocks are searched on their own. The scan then adds up, in two levels (within groups of blocks, and over the groups of a file), how many separators come
    before each block and where the last of them is; no task sees more than a group's blocks or a file's groups. A file without tokens has no document;
    tokens after the last separator are one without end."""
    width = np.dtype(dtype).itemsize

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            rows = []
            for uri in batch.column(0).to_pylist():
                size = reader.size(uri)
                if size % width:
                    raise ValueError(f"{uri}: {size} bytes are no whole number of {width}-byte tokens")
                rows.append(size // width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.int64())], names=["uri", "tokens"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for uri, tokens, block in zip(*(c.to_pylist() for c in batch.columns)):
                first = block * block_tokens
                n = min(block_tokens, tokens - first)
                found = first + np.flatnonzero(np.frombuffer(reader.at(uri, first * width, n * width), dtype) == eod)
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([block], pa.int64()), pa.array([tokens], pa.int64()), pa.array([found], pa.list_(pa.int64()))], names=["uri", "block", "tokens", "ends"])

    known = dealt(files.select("uri").distinct(), FILES_A_TASK, "uri").mapInArrow(sizes, "uri string, tokens long").where("tokens > 0")
    tasks = max(1, (known.agg(F.sum(F.ceil(F.col("tokens") / block_tokens))).first()[0] or 0) // BLOCKS_A_TASK)
    blocks = known.select("uri", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / block_tokens))).alias("block"))
    ends = cut(blocks.repartition(tasks, "uri", "block").mapInArrow(search, "uri string, block long, tokens long, ends array<long>"), "separators")

    summary = ends.select("uri", "block", (F.col("block") / group_blocks).cast("long").alias("group"), F.size("ends").cast("long").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    inner = Window.partitionBy("uri", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("uri").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = summary.groupBy("uri", "group").agg(F.sum("n").alias("group_n"), F.max("last").alias("group_last"))
    groups = groups.select("uri", "group", F.coalesce(F.sum("group_n").over(outer), F.lit(0)).alias("before_n"), F.max("group_last").over(outer).alias("before_last"))
    scanned = summary.select("uri", "block", "group", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("own_n"), F.max("last").over(inner).alias("own_last")).join(groups, ["uri", "group"])
    scanned = scanned.select("uri", "block", (F.col("before_n") + F.col("own_n")).alias("base"), (F.coalesce("own_last", "before_last", F.lit(-1).cast("long")) + 1).alias("carry"))

    whole = ends.join(scanned, ["uri", "block"])
    last_block = F.col("block") == F.floor((F.col("tokens") - 1) / block_tokens)
    tail = F.coalesce(F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1) + 1, F.col("carry"))
    closed = whole.select("uri", "base", "carry", "ends", F.posexplode("ends").alias("i", "end")).select("uri", (F.col("base") + F.col("i")).alias("ordinal"), F.when(F.col("i") == 0, F.col("carry")).otherwise(F.get("ends", F.col("i") - 1) + 1).alias("start"), "end", F.lit(True).alias("ended"))
    open_ = whole.where(last_block).select("uri", (F.col("base") + F.size("ends")).alias("ordinal"), tail.alias("start"), F.col("tokens").alias("end"), F.lit(False).alias("ended")).where("start < end")
    return closed.union(open_).select("uri", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "ended")


def op4_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, counted from flat files. A null text is an empty document of 0 tokens; repeated rows repeat; an empty table has no files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "tokens")
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))
    placed = write_token_files(docs, folder)
    return scan_token_files(placed.select("uri")).join(placed, ["uri", "ordinal"]).select("doc_id", "n_tokens")
