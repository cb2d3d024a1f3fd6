"""Rows of a table in order, with their positions, whatever their number.

The rows are dealt to ranges of the order, sorted in each and written. A row's place is then the
number of its range and its number within it; the rows of the ranges before it, a prefix sum over
one row per range, turn that into its position. No task sees more than a range.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger.sinks.scratch import scratch_path

_PLACE_BITS = 33  # of monotonically_increasing_id: the rest is the number of the partition


def free_name(taken: list[str], wanted: str) -> str:
    """A column name that no column has, in any case."""
    lower = {name.lower() for name in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


class OrderedRows:
    """Rows on shared storage in a total order.

    Rows that the order does not tell apart have neighbouring positions, in any order but the same
    one for every reader. An empty table has no positions. Without a number of ranges there are as
    many as the session has shuffle partitions, and adaptive execution joins small ones; so the
    rows are computed once. The driver keeps one number per range.
    """

    def __init__(self, rows: DataFrame, order: list[Column], ranges: int | None = None):
        spark = rows.sparkSession
        self.place = free_name(rows.columns, "place")
        path = scratch_path(spark, "ordered")
        dealt = rows.repartitionByRange(*([ranges] if ranges else []), *order)
        placed = dealt.sortWithinPartitions(*order).withColumn(self.place, F.monotonically_increasing_id())
        placed.write.parquet(path)
        self.rows = spark.read.schema(placed.schema).parquet(path)
        counted = self.rows.groupBy(self._range().alias("range")).agg(F.count("*").alias("n")).collect()
        self.ranges = sorted((row["range"], row["n"]) for row in counted)
        self.before = [0, *accumulate(n for _, n in self.ranges)]

    def _range(self) -> Column:
        return F.shiftright(self.place, _PLACE_BITS)

    def __len__(self) -> int:
        return self.before[-1]

    def _place_of(self, position: int) -> int:
        at = bisect_right(self.before, position) - 1
        return (self.ranges[at][0] << _PLACE_BITS) + position - self.before[at]

    def between(self, first: int = 0, last: int | None = None, name: str = "position") -> DataFrame:
        """The rows at positions first, first + 1, ..., last - 1, with their positions from 0.

        A filter on the place, which ascends with the position, leaves the files of other ranges
        unread.
        """
        first, last = max(first, 0), len(self) if last is None else min(last, len(self))
        spark, place = self.rows.sparkSession, F.col(self.place)
        if first >= last:
            return self.rows.limit(0).withColumn(self.place, place).withColumnRenamed(self.place, name)
        low, high = self._place_of(first), self._place_of(last - 1)
        held = [(r, before) for (r, _), before in zip(self.ranges, self.before) if low >> _PLACE_BITS <= r <= high >> _PLACE_BITS]
        range_name = free_name([*self.rows.columns, name], "range")
        before_name = free_name([*self.rows.columns, name], "before")
        # one short row per range
        starts = F.broadcast(spark.createDataFrame(held, f"`{range_name}` bigint, `{before_name}` bigint"))
        wanted = self.rows.where((place >= low) & (place <= high)).withColumn(range_name, self._range())
        position = F.col(before_name) + place.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
        own = [F.col(f"`{c}`") for c in self.rows.columns if c != self.place]
        return wanted.join(starts, range_name).select(*own, position.alias(name))
