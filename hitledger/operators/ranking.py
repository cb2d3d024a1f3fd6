"""Top rows of the dimensions with their share of all parsed lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitledger import names
from hitledger.functions.display import human_bytes, percent_text, trend_label, truncate_label
from hitledger.operators.positions import OrderedRows
from hitledger.sinks import tables

_METRICS = ("key", "visits", "traffic_bytes", "visit_pct", "traffic_pct")
_RANKED_COLUMNS = ("dimension", "rank", *_METRICS)

# How many rows of a ranking one task puts in order; longer rankings are dealt to ranges.
IN_ONE_TASK = 10_000
# Into how many parts a dimension is dealt before its best rows meet.
LIMIT_PARTS = 64


def percent_of(value: Column, total: Column) -> Column:
    """Share in percent; 0 where there is nothing to share."""
    share = value.cast("double") / total.cast("double") * 100
    return F.when(F.coalesce(total, F.expr("0L")) == 0, 0.0).otherwise(share)


def _row_order(sort_by: str) -> list[Column]:
    """Metric, then visits, then key: a total order, so every limit is deterministic."""
    return [F.desc(names.sort_column(sort_by)), F.desc("visits"), F.asc("bucket")]


def _with_shares(rows: DataFrame) -> DataFrame:
    """Turn ranked rows that include the totals row into metric rows.

    The window spans one partition, which holds no more rows than a few times IN_ONE_TASK.
    """
    everything = Window.partitionBy()
    is_total = F.col("kind") == names.TOTAL
    with_totals = rows.select(
        "*",
        F.max(F.when(is_total, F.col("visits"))).over(everything).alias("_all_visits"),
        F.max(F.when(is_total, F.col("traffic_bytes"))).over(everything).alias("_all_bytes"),
    )
    return _metrics(with_totals.where(~is_total), F.col("_all_visits"), F.col("_all_bytes"))


def _metrics(rows: DataFrame, all_visits: Column, all_bytes: Column) -> DataFrame:
    return rows.select(
        "kind",
        F.col("bucket").alias("key"),
        "visits",
        "traffic_bytes",
        percent_of(F.col("visits"), all_visits).alias("visit_pct"),
        percent_of(F.col("traffic_bytes"), all_bytes).alias("traffic_pct"),
        "rank",
    )


def top_rows(
    counters: DataFrame, dimension: str, sort_by: str = "visits", top: int = names.DEFAULT_TOP
) -> DataFrame:
    """The ``top`` best buckets of a dimension, best first, with shares of all parsed lines.

    The totals row travels through the same sort as the buckets, ahead of them, so the input is
    read once and no second aggregate has to be joined in. Up to IN_ONE_TASK rows are the best of
    each task, put in order by one; more are ranked by ranges of the order (``OrderedRows``).
    """
    return _ranked(counters, dimension, sort_by, top).orderBy("rank").drop("rank")


def _ranked(counters: DataFrame, dimension: str, sort_by: str, top: int) -> DataFrame:
    if top > IN_ONE_TASK:
        return RankedBuckets(counters, dimension, sort_by, top).between(0, top)
    kind = names.dimension_kind(dimension)
    order = _totals_first(sort_by)
    best = (
        counters.where(F.col("kind").isin(kind, names.TOTAL))
        .orderBy(*order)
        .limit(max(top, 0) + 1)
    )
    so_far = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = best.withColumn("rank", F.count_if(F.col("kind") == kind).over(so_far).cast("int"))
    return (
        _with_shares(numbered)
        .where(F.col("rank") <= max(top, 0))
        .select(*_METRICS, "rank")
    )


def _totals_first(sort_by: str) -> list[Column]:
    return [(F.col("kind") == names.TOTAL).desc(), *_row_order(sort_by)]


class RankedBuckets:
    """A ranking of any length on shared storage: every bucket of a dimension in its order.

    The totals row stands first, so the counters are read once. Ranks are handed out by ranges, and
    a stretch of them reads only the files that hold it.
    """

    def __init__(self, counters: DataFrame, dimension: str, sort_by: str, top: int):
        kind = names.dimension_kind(dimension)
        rows = counters.where(F.col("kind").isin(kind, names.TOTAL))
        self.ordered = OrderedRows(rows.select(*names.COUNTER_SCHEMA.names), _totals_first(sort_by))
        first = self.ordered.between(0, 1).collect()
        self.totals = first[0] if first and first[0].kind == names.TOTAL else None
        self.skipped = int(self.totals is not None)
        self.length = min(max(top, 0), len(self.ordered) - self.skipped)

    def between(self, first: int, last: int) -> DataFrame:
        """The rows with ranks first + 1 to last, with their metrics; ranks beyond the top are not there."""
        last = min(last, self.length)
        rows = self.ordered.between(first + self.skipped, last + self.skipped)
        numbered = rows.withColumn("rank", (F.col("position") + 1 - self.skipped).cast("int"))
        totals = (self.totals.visits, self.totals.traffic_bytes) if self.totals else (0, 0)
        return _metrics(numbered, *map(F.lit, totals)).select(*_METRICS, "rank")


def top_rows_each(
    counters: DataFrame, sort_by: str = "visits", top: int = names.DEFAULT_TOP
) -> DataFrame:
    """Top rows of all four dimensions, ranked one by one, with dimension and rank.

    For saved tables: each dimension reads only its own part, and each task keeps its best rows
    without sorting the others.
    """
    parts = [
        _ranked(counters, dimension, sort_by, top).withColumn("dimension", F.lit(dimension))
        for dimension in names.DIMENSION_KINDS
    ]
    return reduce(DataFrame.unionByName, parts).select(*_RANKED_COLUMNS)


def top_rows_all(
    counters: DataFrame, sort_by: str = "visits", top: int = names.DEFAULT_TOP
) -> DataFrame:
    """The same for counters that are still to be computed: they are computed once.

    The best rows of each part of a dimension, dealt by bucket, meet first, and then those of its
    parts; so nothing is written, and no task sees more of a dimension than ``top`` rows of each
    part. Beyond IN_ONE_TASK rows the counters are written and ranked one dimension at a time.
    """
    kinds = {kind: dimension for dimension, kind in names.DIMENSION_KINDS.items()}
    best = counters.where(F.col("kind").isin(*kinds, names.TOTAL))
    if top > IN_ONE_TASK:
        return top_rows_each(tables.materialize(best), sort_by, top)
    best = best.withColumn("part", F.pmod(F.xxhash64("bucket"), F.lit(LIMIT_PARTS)))
    for keys in (("kind", "part"), ("kind",)):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*_row_order(sort_by)))
        best = best.withColumn("rank", rank).where(F.col("rank") <= max(top, 1))
    dimension = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("kind")]
    rows = _with_shares(best).where(F.col("rank") <= top)
    return rows.withColumn("dimension", dimension).select(*_RANKED_COLUMNS)


def page_of_rows(
    counters: DataFrame,
    dimension: str,
    sort_by: str = "visits",
    top: int = names.DEFAULT_TOP,
    scroll: int = 0,
    visible: int = 10,
) -> DataFrame:
    """``visible`` top rows after the first ``scroll``; scrolling stops at the last full page.

    Of a ranking beyond IN_ONE_TASK rows, only the page is read once the ranking is written.
    """
    if top > IN_ONE_TASK:
        ranking = RankedBuckets(counters, dimension, sort_by, top)
        begin = max(0, min(scroll, ranking.length - visible))
        return ranking.between(begin, begin + visible).orderBy("rank")
    rows = _ranked(counters, dimension, sort_by, top)
    counted = rows.withColumn("_rows", F.count("*").over(Window.partitionBy()))
    first = F.least(F.lit(scroll), F.greatest(F.col("_rows") - visible, F.lit(0)))
    return (
        counted.where((F.col("rank") > first) & (F.col("rank") <= first + visible))
        .orderBy("rank")
        .drop("_rows")
    )


def bar_series(
    counters: DataFrame,
    dimension: str,
    sort_by: str = "visits",
    top: int = names.DEFAULT_TOP,
    graph_items: int = 0,
    label_length: int = 14,
) -> DataFrame:
    """Label, value and value text of the first ``graph_items`` top rows; 0 means all of them."""
    shown = min(top, graph_items) if graph_items > 0 else top
    rows = _ranked(counters, dimension, sort_by, shown)
    value = F.col(names.sort_column(sort_by))
    text = value.cast("string") if sort_by == "visits" else human_bytes(value)
    return rows.orderBy("rank").select(
        "rank",
        truncate_label(F.col("key"), label_length).alias("label"),
        value.alias("value"),
        text.alias("value_text"),
    )


def table_cells(rows: DataFrame) -> DataFrame:
    """Metric rows as display text: key, visits, traffic and the two shares."""
    return rows.select(
        "key",
        F.col("visits").cast("string").alias("visits"),
        human_bytes(F.col("traffic_bytes")).alias("traffic"),
        percent_text(F.col("visit_pct")).alias("visit_pct"),
        percent_text(F.col("traffic_pct")).alias("traffic_pct"),
    )


def trend_points(counters: DataFrame, granularity: str) -> DataFrame:
    """Chart points of a date series: position, label, visits, bytes, in order.

    Timestamps are unchecked text, so there can be any number of buckets: positions are handed
    out by ranges of the buckets, and no task sees the whole series.
    """
    kind = names.trend_kind(granularity)
    series = counters.where(F.col("kind") == kind).select("bucket", "visits", "traffic_bytes")
    points = OrderedRows(series, [F.asc("bucket")]).between(name="x")
    return points.orderBy("x").select(
        "x",
        "bucket",
        trend_label(F.col("bucket"), granularity).alias("label"),
        "visits",
        "traffic_bytes",
    )
