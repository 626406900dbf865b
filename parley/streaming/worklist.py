"""Work lists: a listing written once, and what became of each of its items, so that a run that ends early is taken up where it ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: States of an item; one without a state is still to do.
DONE, FAILED = "done", "failed"
ITEM = ("pos", "id", "title", "model", "created_at", "updated_at")


class WorkList:
    """Lists are numbered folders with ``items`` and ``states``, the latter one folder a batch. The last list that was written in full counts.

    An item is pending until a batch with it has been stored; states are written after that, so a crash in between has a batch fetched again, which changes nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self.number, self.batches, self._last = max(self._numbers(), default=0), 0, None

    def _numbers(self) -> list[int]:
        path = self._path(self.folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []
        return [int(n) for n in names if n.isdigit() and self._fs.exists(self._path(f"{self.folder}/{n}/items/_SUCCESS"))]

    def items(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.number:08d}/items")

    def states(self) -> DataFrame:
        """(id, updated_at, state) of the items that batches have dealt with."""
        top = self._path(f"{self.folder}/{self.number:08d}/states")
        kind = self.items().schema["updated_at"].dataType.simpleString() if self.number else "string"
        schema = f"id string, updated_at {kind}, state string"
        if not self.number or not self._fs.exists(top):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{self.number:08d}/states/*")

    def pending(self) -> DataFrame:
        """The items without a state."""
        if not self.number:
            return self.spark.createDataFrame([], "id string")
        known = self.states().select(F.col("id").alias("known_id"), F.col("updated_at").alias("known_time"))
        return self.items().join(known, (F.col("id") == F.col("known_id")) & F.col("updated_at").eqNullSafe(F.col("known_time")), "left_anti")

    def begin(self, chosen: DataFrame) -> None:
        """Writes a listing down, which is evaluated once, here. What an unfinished list before it has done, at the same listed time, is left out; what failed there isn't."""
        rows = chosen.select(*(c for c in ITEM if c in chosen.columns))
        if self.number and self.pending().limit(1).count():
            done = self.states().where(F.col("state") == DONE).select(F.col("id").alias("done_id"), F.col("updated_at").alias("done_time"))
            rows = rows.join(done, (F.col("id") == F.col("done_id")) & F.col("updated_at").eqNullSafe(F.col("done_time")), "left_anti")
        old, number = self._numbers(), self.number + 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/{number:08d}/items")
        self.number, self.batches, self._last = number, 0, None
        for n in old:
            self._fs.delete(self._path(f"{self.folder}/{n:08d}"), True)

    def claim(self, n: int) -> DataFrame | None:
        """The next ``n`` items in the listing's order, written down as a batch; none if there are no more."""
        rest, place = self.items(), F.struct("pos", "id")
        if self._last is not None:
            rest = rest.where(place > F.struct(*(F.lit(v).cast(rest.schema[c].dataType).alias(c) for c, v in zip(("pos", "id"), self._last))))
        path = f"{self.folder}/{self.number:08d}/claimed-{self.batches:08d}"
        rest.orderBy(place).limit(n).write.mode("overwrite").parquet(path)
        batch = self.spark.read.parquet(path)
        last = batch.agg(F.max(place).alias("last")).first().last
        if last is None:
            return None
        self._last, self.batches = (last.pos, last.id), self.batches + 1
        return batch

    def fetched(self, details: DataFrame) -> DataFrame:
        """Details of the batch claimed last, written down, so that each is fetched once whatever is made of it."""
        path = f"{self.folder}/{self.number:08d}/fetched-{self.batches - 1:08d}"
        details.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def settle(self, batch: DataFrame, failed: DataFrame) -> None:
        """Writes the states of a batch: those of ``failed`` (id) failed, the others are done. Its other files go."""
        gone = failed.select(F.col("id").alias("failed_id")).distinct()
        state = F.when(F.col("failed_id").isNull(), DONE).otherwise(FAILED)
        top = f"{self.folder}/{self.number:08d}"
        batch.join(gone, F.col("id") == F.col("failed_id"), "left").select("id", "updated_at", state.alias("state")).write.mode("overwrite").parquet(f"{top}/states/{self.batches - 1:08d}")
        for kind in ("claimed", "fetched"):
            self._fs.delete(self._path(f"{top}/{kind}-{self.batches - 1:08d}"), True)
