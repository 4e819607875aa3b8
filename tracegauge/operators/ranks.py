"""Ranks, running sums and running minima over a whole table, without a task that reads all of it.

Rows are dealt by ranges of the order and sorted within a partition, and written, so that their places don't change; what a
row needs of the partitions before or after its own are one number for each partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shared_folder


class Ordered:
    """A table in one order.  ``rows`` has its columns, ``part``, and ``rank`` from 1 on; ``count`` is their number."""

    def __init__(self, df: DataFrame, *order):
        spark = df.sparkSession
        folder = shared_folder(spark, "ranks")
        placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
        placed.write.parquet(folder)
        stored = spark.read.schema(placed.schema).parquet(folder)
        # the number of a row: its partition's above 33 bits, its place below
        stored = stored.withColumn("part", F.shiftrightunsigned("_id", 33).cast("int")).withColumn("_place", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
        self.rows = stored
        sizes = self._by_part(F.count(F.lit(1)))
        self.count = sum(sizes.values())
        self.rows = self.plus(stored, "_before", self._before(sizes, sum, 0)).withColumn("rank", (F.col("_before") + F.col("_place") + 1).cast("int")).drop("_before", "_place")

    def _by_part(self, value) -> dict:
        return {r["part"]: r["v"] for r in self.rows.groupBy("part").agg(value.alias("v")).collect()}  # a row for each partition

    @staticmethod
    def _before(values: dict, fold, start, backwards: bool = False) -> dict:
        """Of each partition, the fold of those before it (or after it); null where there are none and no ``start``."""
        out, held = {}, start
        for p in sorted(values, reverse=backwards):
            out[p] = held
            held = values[p] if held is None else held if values[p] is None else fold((held, values[p]))
        return out

    def plus(self, rows: DataFrame, name: str, values: dict) -> DataFrame:
        kind = "double" if any(isinstance(v, float) for v in values.values()) else "long"
        table = rows.sparkSession.createDataFrame(list(values.items()), f"part int, {name} {kind}")
        return rows.join(F.broadcast(table), "part")

    def with_sum(self, value, name: str) -> Ordered:
        """Adds the sum of ``value`` over the rows up to each."""
        w = Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
        rows = self.plus(self.rows, "_sum", self._before(self._by_part(F.sum(value)), sum, 0))
        self.rows = rows.withColumn(name, F.sum(value).over(w) + F.col("_sum")).drop("_sum")
        return self

    def with_least_from(self, value, name: str) -> Ordered:
        """Adds the least ``value`` of each row and those after it."""
        w = Window.partitionBy("part").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
        later = self._before(self._by_part(F.min(value)), min, None, backwards=True)
        rows = self.plus(self.rows, "_later", later)
        self.rows = rows.withColumn(name, F.least(F.min(value).over(w), "_later")).drop("_later")
        return self
