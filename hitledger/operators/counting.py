"""The counter table: visits and bytes per (kind, bucket), the one aggregate all views read."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger import names
from hitledger.functions.grouping import GroupingRules
from hitledger.functions.line_fields import BYTE_TYPE
from hitledger.operators.parsing import parse_lines, with_buckets


def _bucket_column(kind: str, rules: GroupingRules) -> Column:
    """The bucket of a parsed line in one kind; null where the line does not count there."""
    if kind == names.DIMENSION_KINDS["ip"]:
        return rules.ip.apply(F.col("ip"))
    if kind == names.DIMENSION_KINDS["path"]:
        return rules.path.apply(F.col("path"))
    if kind == names.DIMENSION_KINDS["user_agent"]:
        return rules.user_agent.apply(F.col("user_agent"))
    for granularity, trend in names.TREND_KINDS.items():
        if kind == trend:
            return F.col(granularity)
    condition = {
        names.TOTAL: "ip IS NOT NULL",
        names.PARSE_ERRORS: "ip IS NULL",
    }
    if kind in condition:
        return F.expr(f"CASE WHEN {condition[kind]} THEN '{names.META_BUCKET}' END")
    if kind == names.DIMENSION_KINDS["status"]:
        return F.col("status_code")
    raise ValueError(f"nothing to count for kind {kind!r}")


def count_records(
    parsed: DataFrame,
    rules: GroupingRules | None = None,
    kinds: Iterable[str] = names.TALLY_KINDS,
) -> DataFrame:
    """Counter table of parsed lines (rejects included) for the wanted kinds.

    One scan and one shuffle whatever the number of kinds: each line is expanded to one row per
    kind and counted before the shuffle, so a key that holds most of the lines sends one row per
    task. Ask only for the kinds a view needs: the fields of the others are not even parsed.
    """
    kinds = list(kinds)
    rules = rules or GroupingRules()
    return (
        with_buckets(parsed)
        .select(
            F.coalesce("traffic_bytes", F.lit(0).cast(BYTE_TYPE)).alias("_bytes"),
            *(_bucket_column(kind, rules).alias(kind) for kind in kinds),
        )
        .unpivot(["_bytes"], kinds, "kind", "bucket")
        .where(F.col("bucket").isNotNull())
        .groupBy("kind", "bucket")
        .agg(
            F.count("*").alias("visits"),
            F.sum("_bytes").cast(names.BYTES_TYPE).alias("traffic_bytes"),
        )
    )


def bucket_rows(parsed: DataFrame, kind: str, rules: GroupingRules | None = None) -> DataFrame:
    """The bucket and the bytes (``_bytes``) of each parsed line that counts in one kind."""
    bytes_ = F.coalesce("traffic_bytes", F.lit(0).cast(BYTE_TYPE)).alias("_bytes")
    bucket = _bucket_column(kind, rules or GroupingRules()).alias("bucket")
    return with_buckets(parsed).select(bucket, bytes_).where(F.col("bucket").isNotNull())


def count_lines(
    lines: DataFrame,
    rules: GroupingRules | None = None,
    kinds: Iterable[str] = names.TALLY_KINDS,
) -> DataFrame:
    """Counter table straight from log lines (column ``value``)."""
    return count_records(parse_lines(lines.select("value")), rules, kinds)


def with_file_count(counters: DataFrame, files: int) -> DataFrame:
    """Add the number of input files, which the lines themselves cannot tell."""
    row = counters.sparkSession.range(0, 1, 1, 1).select(
        F.lit(names.FILES).alias("kind"),
        F.lit(names.META_BUCKET).alias("bucket"),
        F.lit(files).cast("bigint").alias("visits"),
        F.lit(0).cast(names.BYTES_TYPE).alias("traffic_bytes"),
    )
    return counters.unionByName(row)


def merge_counters(*tables: DataFrame) -> DataFrame:
    """Add up counter tables of disjoint inputs: every scalar and every bucket."""
    rows = reduce(DataFrame.unionByName, tables)
    return rows.groupBy("kind", "bucket").agg(
        F.sum("visits").alias("visits"), F.sum("traffic_bytes").alias("traffic_bytes")
    )


def summary(counters: DataFrame, sort_by: str = "visits") -> DataFrame:
    """One row: parsed lines, their bytes, rejects, input files and the sort order in use."""
    names.sort_column(sort_by)

    def scalar(kind: str, column: str) -> Column:
        found = F.sum(F.when(F.col("kind") == kind, F.col(column)))
        zero = F.lit(0).cast(names.BYTES_TYPE) if column == "traffic_bytes" else F.expr("0L")
        return F.coalesce(found, zero)

    return (
        counters.where(F.col("kind").isin(names.TOTAL, names.PARSE_ERRORS, names.FILES))
        .agg(
            scalar(names.TOTAL, "visits").alias("visits"),
            scalar(names.TOTAL, "traffic_bytes").alias("traffic_bytes"),
            scalar(names.PARSE_ERRORS, "visits").alias("parse_errors"),
            scalar(names.FILES, "visits").alias("files"),
        )
        .withColumn("sort", F.lit(sort_by))
    )


def dimension_counters(counters: DataFrame, dimension: str) -> DataFrame:
    """All buckets of one dimension, unordered."""
    return _of_kind(counters, names.dimension_kind(dimension))


def date_series(counters: DataFrame, granularity: str) -> DataFrame:
    """Observed buckets of one granularity in text order; hours or days without visits are absent."""
    return _of_kind(counters, names.trend_kind(granularity)).orderBy("bucket")


def _of_kind(counters: DataFrame, kind: str) -> DataFrame:
    return counters.where(F.col("kind") == kind).select("bucket", "visits", "traffic_bytes")
