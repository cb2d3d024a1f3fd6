"""Names shared by every module: dimensions, granularities, sort orders, counter kinds."""

from __future__ import annotations

from pyspark.sql import types as T

# The labels written to exports.
DIMENSION_KINDS = {
    "ip": "dimension:ip",
    "path": "dimension:path",
    "user_agent": "dimension:user-agent",
    "status": "dimension:status",
}
TREND_KINDS = {
    "hour": "trend:hour",
    "day": "trend:day",
    "month": "trend:month",
}

# Kinds of our own that hold the scalars of a tally; their bucket is always META_BUCKET.
TOTAL = "meta:total"
PARSE_ERRORS = "meta:parse_errors"
FILES = "meta:files"
META_BUCKET = "all"

# What one pass over parsed lines can count. FILES is added from the resolved inputs.
TALLY_KINDS = (
    *DIMENSION_KINDS.values(),
    *TREND_KINDS.values(),
    TOTAL,
    PARSE_ERRORS,
)

SORT_COLUMNS = {"visits": "visits", "traffic": "traffic_bytes"}

# Sums of unsigned 64-bit numbers: no log is long enough to exceed it.
BYTES_TYPE = "DECIMAL(38, 0)"

COUNTER_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField("visits", T.LongType()),
        T.StructField("traffic_bytes", T.DecimalType(38, 0)),
    ]
)

DEFAULT_TOP = 30


def _lookup(table: dict[str, str], value: str, what: str) -> str:
    try:
        return table[value]
    except KeyError:
        raise ValueError(f"{what} must be one of {', '.join(table)}; got {value!r}") from None


def dimension_kind(dimension: str) -> str:
    return _lookup(DIMENSION_KINDS, dimension, "dimension")


def trend_kind(granularity: str) -> str:
    return _lookup(TREND_KINDS, granularity, "granularity")


def sort_column(sort_by: str) -> str:
    return _lookup(SORT_COLUMNS, sort_by, "sort_by")
