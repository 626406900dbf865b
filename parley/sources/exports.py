"""Files written from rows: one export file a conversation, chunked messages, settings read from KEY=VALUE files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions.texts import CHUNK, chunks

FORMAT = "named_files"
FILE = "file_name string, content string"
#: Holds what isn't committed yet, and the lists of what is.
HIDDEN = ".exports"


@dataclass
class Written(WriterCommitMessage):
    """A task's files: (where they wait, their names, bytes)."""

    files: list[tuple[str, str, int]]


def _store(folder: str):
    from pyarrow import fs

    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


class NamedFiles(DataSource):
    """Rows (file_name, content) as one file each in a folder of any store that pyarrow reaches. Options: folder, and job, a name for the list of what was written."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FILE

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options["folder"], self.options["job"])


class NamedFilesWriter(DataSourceWriter):
    """Tasks write to a folder of the job's own; only when all have ended do files get their names. Then, of attempts of one task, one counts; a job that fails leaves no file under a final name."""

    def __init__(self, folder: str, job: str):
        self.folder, self.job = folder, job

    def write(self, iterator: Iterator) -> Written:
        store, top = _store(self.folder)
        mine = f"{top}/{HIDDEN}/{self.job}/{uuid.uuid4().hex}"
        files = []
        for i, row in enumerate(iterator):
            if not i:
                store.create_dir(mine, recursive=True)
            data, at = (row["content"] or "").encode(), f"{mine}/{i}"
            with store.open_output_stream(at) as out:
                out.write(data)
            files.append((at, row["file_name"], len(data)))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = _store(self.folder)
        files = [f for m in messages if m for f in m.files]
        names = [n for _, n, _ in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows repeat a file name")
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: store.move(f[0], f"{top}/{f[1]}"), files))
        self.abort(messages)
        store.create_dir(f"{top}/{HIDDEN}", recursive=True)
        with store.open_output_stream(f"{top}/{HIDDEN}/{self.job}.json") as out:
            out.write("".join(json.dumps({"file_name": n, "bytes": b}) + "\n" for _, n, b in files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Removes what waits."""
        from pyarrow import fs

        store, top = _store(self.folder)
        waiting = f"{top}/{HIDDEN}/{self.job}"
        if store.get_file_info(waiting).type != fs.FileType.NotFound:
            store.delete_dir(waiting)


def write_exports(files: DataFrame, folder: str) -> DataFrame:
    """Writes (file_name, content), now and once, as one file each into a shared folder, and returns (file_name, bytes) of what was written, from the job's list. Names must be unique."""
    spark, job = files.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(NamedFiles)
    files.select("file_name", "content").write.format(FORMAT).option("folder", folder).option("job", job).mode("append").save()
    return spark.read.schema("file_name string, bytes long").json(f"{folder.rstrip('/')}/{HIDDEN}/{job}.json")


def message_parts(messages: DataFrame, text: str = "text", size: int = CHUNK) -> DataFrame:
    """A row for each piece of a message that a sink of limited size takes: the other columns, part and chunk."""
    others = [c for c in messages.columns if c != text]
    return messages.select(*others, F.posexplode(chunks(text, size)).alias("part", "chunk"))


def settings(spark: SparkSession, path: str) -> dict[str, str]:
    """KEY=VALUE lines of a small file; comments and other lines don't count, the first of equal keys does."""
    found: dict[str, str] = {}
    for row in spark.read.text(path).toLocalIterator():
        line = row.value.strip()
        if line and not line.startswith("#") and "=" in line:
            key, _, value = line.partition("=")
            found.setdefault(key.strip(), value.strip())
    return found
