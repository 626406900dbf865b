"""Windows over keys of any size: a key with many rows is cut into ranges of its order, which tasks take one by one, each with what it needs of those before it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import written

#: Rows of a key above which it is cut, and the most pieces of a key.
PIECE_ROWS, MOST_PIECES = 1 << 20, 256
PIECE, CARRY, BEFORE = "piece_", "carry_", "before_"


class Pieces:
    """``rows`` with the piece of each. Ends of pieces are quantiles of the order, found for keys of more than PIECE_ROWS rows only and written down, so that every use sees the same ones.

    Rows of equal order are of one piece. An order that is no number or time isn't cut, nor are rows without one, which come first."""

    def __init__(self, rows: DataFrame, key: str, order: str):
        self.key, self.order, self.columns = key, order, rows.columns
        sizes = rows.groupBy(F.col(key).alias("of_")).agg(F.count(F.lit(1)).alias("size_"))
        most = (sizes.agg(F.max("size_")).first()[0] or 0) if self._cuttable(rows.schema[order].dataType.simpleString()) else 0
        self.whole = most <= PIECE_ROWS
        if self.whole:
            self.rows = rows.withColumn(PIECE, F.lit(0))
            return
        n = min(MOST_PIECES, math.ceil(most / PIECE_ROWS))
        hot = sizes.where(F.col("size_") > PIECE_ROWS).select("of_")
        ends = rows.join(hot, F.col(key).eqNullSafe(F.col("of_")), "left_semi").groupBy(F.col(key).alias("of_")).agg(F.percentile_approx(order, [i / n for i in range(1, n)], 20 * n).alias("ends_"))
        ends = written(ends, "ends")
        after = F.coalesce(F.size(F.filter("ends_", lambda e: e < F.col(order))), F.lit(0))
        self.rows = rows.join(ends, F.col(key).eqNullSafe(F.col("of_")), "left").withColumn(PIECE, F.greatest(after, F.lit(0))).select(*self.columns, PIECE)

    @staticmethod
    def _cuttable(kind: str) -> bool:
        return kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz") or kind.startswith("decimal")

    def window(self) -> WindowSpec:
        """A piece's rows in order."""
        return Window.partitionBy(self.key, PIECE).orderBy(self.order)

    def with_carry(self, total: Column) -> DataFrame:
        """The rows with an aggregate's sum over the key's pieces before their own, 0 for the first."""
        if self.whole:
            return self.rows.withColumn(CARRY, F.lit(0).cast("long"))
        sums = self.rows.groupBy(F.col(self.key).alias("of_"), F.col(PIECE).alias("of_piece_")).agg(total.alias("sum_"))
        upto = F.sum("sum_").over(Window.partitionBy("of_").orderBy("of_piece_").rowsBetween(Window.unboundedPreceding, -1))
        carries = sums.select("of_", "of_piece_", F.coalesce(upto, F.lit(0)).alias(CARRY))
        return self.rows.join(carries, F.col(self.key).eqNullSafe(F.col("of_")) & (F.col(PIECE) == F.col("of_piece_"))).select(*self.columns, PIECE, CARRY)

    def with_rows_before(self, n: int, *needed: str) -> DataFrame:
        """The rows, and to each piece the last ``n`` rows of its key before it, marked in BEFORE; of those only key, order and the needed columns are filled."""
        own = self.rows.withColumn(BEFORE, F.lit(False))
        if self.whole or n <= 0:
            return own
        last = F.row_number().over(Window.partitionBy(self.key, PIECE).orderBy(F.desc(self.order)))
        tail = self.rows.select(self.key, self.order, PIECE, *needed, last.alias("last_")).where(F.col("last_") <= n)
        tails = tail.groupBy(self.key, PIECE).agg(F.array_sort(F.collect_list(F.struct(F.col(self.order).alias("o"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(needed))))).alias("tail_"))
        earlier = F.flatten(F.collect_list("tail_").over(Window.partitionBy(self.key).orderBy(PIECE).rowsBetween(-n, -1)))
        ahead = tails.select(self.key, PIECE, earlier.alias("earlier_"))
        context = ahead.select(self.key, PIECE, F.explode(F.slice("earlier_", F.greatest(F.size("earlier_") - n, F.lit(0)) + 1, n)).alias("e"))
        filled = {self.order: "e.o"} | {c: f"e.c{i}" for i, c in enumerate(needed)}
        kinds = {f.name: f.dataType for f in self.rows.schema.fields}
        columns = [F.col(c) if c in (self.key, PIECE) else F.col(filled[c]).alias(c) if c in filled else F.lit(None).cast(kinds[c]).alias(c) for c in [*self.columns, PIECE]]
        return own.unionByName(context.select(*columns).withColumn(BEFORE, F.lit(True)))
