"""Top rows of a dimension straight from log lines, without shuffling every bucket.

A fixed number of cells is counted first: every bucket belongs to the cell of its hash, so a cell's sum
is an upper bound for each of its buckets. The buckets of the largest cells are then counted exactly. The
last of the best among them is a lower bound for the result, and a cell whose sum is below it can
hold no row of the result. Only the buckets of the cells that are left are counted, and the ranking
over them is exact. The worst case, equal buckets everywhere, is the full count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitledger import names
from hitledger.functions.grouping import GroupingRules
from hitledger.operators import counting, ranking
from hitledger.operators.parsing import parse_lines
from hitledger.sinks.scratch import scratch_path

CELLS = 1 << 16
FIRST_CELLS = 4  # cells that are counted first, for each row of the result


def _counted(rows: DataFrame, key: str) -> DataFrame:
    sums = rows.groupBy(key).agg(
        F.count("*").alias("visits"), F.sum("_bytes").cast(names.BYTES_TYPE).alias("traffic_bytes")
    )
    path = scratch_path(rows.sparkSession, key)
    sums.write.parquet(path)
    return rows.sparkSession.read.schema(sums.schema).parquet(path)


def top_rows_of_lines(
    lines: DataFrame,
    dimension: str,
    sort_by: str = "visits",
    top: int = names.DEFAULT_TOP,
    rules: GroupingRules | None = None,
    cells: int = CELLS,
) -> DataFrame:
    """What ``ranking.top_rows`` of the counted lines gives, for logs with many distinct buckets.

    Reads the lines two or three times. A task sends one row per cell, and later one per bucket of the
    cells that can matter; at most ``cells`` numbers are broadcast.
    """
    spark, metric = lines.sparkSession, names.sort_column(sort_by)
    kind = names.dimension_kind(dimension)
    rows = counting.bucket_rows(parse_lines(lines.select("value")), kind, rules)
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("bucket"), F.lit(cells)))
    bounds = _counted(rows, "cell")
    totals = bounds.agg(F.sum("visits"), F.sum("traffic_bytes")).first()

    def of_cells(chosen: DataFrame) -> DataFrame:
        path = scratch_path(spark, "chosen")
        chosen.select("cell").write.parquet(path)
        few = F.broadcast(spark.read.schema("cell bigint").parquet(path))  # at most `cells` numbers
        return _counted(rows.join(few, "cell", "left_semi"), "bucket")

    first = bounds.orderBy(F.desc(metric), "cell").limit(FIRST_CELLS * max(top, 1))
    found = of_cells(first)
    best = found.orderBy(F.desc(metric)).limit(max(top, 1)).agg(F.count("*"), F.min(metric)).first()
    least = best[1] if best[0] >= top else 0
    # the first cells are all at or above the smallest of them, and the order of cells is total
    rest = bounds.join(F.broadcast(first.select("cell")), "cell", "left_anti").where(F.col(metric) >= F.lit(least))
    if not rest.isEmpty():
        found = found.unionByName(of_cells(rest))
    counters = found.select(F.lit(kind).alias("kind"), "bucket", "visits", "traffic_bytes")
    total = [(names.TOTAL, names.META_BUCKET, *totals)] if totals[0] else []
    return ranking.top_rows(counters.unionByName(spark.createDataFrame(total, names.COUNTER_SCHEMA)), dimension, sort_by, top)
