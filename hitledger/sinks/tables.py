"""Counter tables on storage: Parquet snapshots and CSV exports."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitledger import names
from hitledger.sinks.scratch import scratch_path

# The sections of an export, in order.
EXPORT_ORDER = (
    *names.DIMENSION_KINDS.values(),
    names.TREND_KINDS["hour"],
    names.TREND_KINDS["day"],
    names.TREND_KINDS["month"],
)

# Into how many parts a kind of an intermediate table is dealt; adaptive execution joins small ones.
SPREAD = 512

# Plain quoting: quotes doubled, nothing trimmed, empty text written as nothing.
_CSV_OPTIONS = {
    "header": True,
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "lineSep": "\n",
}


# A snapshot's buckets: a power of two, so that those of different sizes divide each other.
LEAST_BUCKETS, MOST_BUCKETS = 8, 1 << 15
_MARK = "_buckets_"


class _Catalogued:
    """A name for a bucketed folder in the session's catalogue, while it is written or read as buckets."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, f"hitledger_{uuid.uuid4().hex}"

    def __enter__(self) -> str:
        return self.name

    def __exit__(self, *_: object) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")  # an external table: its files stay


def save_snapshot(
    counters: DataFrame, path: str, mode: str = "error", buckets: int | None = None, dealt: bool = False
) -> None:
    """Write a counter table as Parquet, one folder per kind, so that views read only theirs.

    Each kind is dealt to the same number of buckets by the hash of its bucket names, and the folder
    says to how many, so that ``merge_snapshots`` can add up two of them without a shuffle. ``dealt``
    says that the rows lie so already.
    """
    spark = counters.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if mode == "error" and files.exists(target):
        raise FileExistsError(f"PATH_ALREADY_EXISTS: {path}")
    wanted = max(buckets or LEAST_BUCKETS, LEAST_BUCKETS)
    buckets = min(1 << (wanted - 1).bit_length(), MOST_BUCKETS)
    rows = counters.select(*[F.col(f.name).cast(f.dataType) for f in names.COUNTER_SCHEMA])
    if not dealt:
        rows = rows.repartition(buckets, "bucket")
    with _Catalogued(spark) as name:
        writer = rows.write.mode(mode).option("path", path).format("parquet")
        writer.partitionBy("kind").bucketBy(buckets, "bucket").saveAsTable(name)
    files.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path, f"{_MARK}{buckets}"))


def snapshot_buckets(spark: SparkSession, path: str) -> int | None:
    """How many buckets each kind of a snapshot has; None if nothing says so."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in files.listStatus(folder):
        name = entry.getPath().getName()
        if name.startswith(_MARK):
            return int(name.removeprefix(_MARK))
    return None


def merge_snapshots(spark: SparkSession, first: str, second: str, path: str) -> None:
    """Add up two saved snapshots of disjoint inputs into a third, bucket by bucket, without a shuffle.

    Where one has more buckets than the other, those of the one that the other's bucket comprises
    are read together.
    """
    kinds = (*names.TALLY_KINDS, names.FILES)
    buckets = [snapshot_buckets(spark, p) for p in (first, second)]
    with _Catalogued(spark) as a, _Catalogued(spark) as b, _joining_unlike_buckets(spark, buckets):
        for name, source, many in zip((a, b), (first, second), buckets):
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names.COUNTER_SCHEMA)
            place = source.replace("\\", "\\\\").replace("'", "\\'")
            spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (kind)"
                f" CLUSTERED BY (bucket) INTO {many} BUCKETS LOCATION '{place}'"
            )
            spark.catalog.recoverPartitions(name)
        merged = merged_buckets(spark.table(a), spark.table(b), kinds)
        save_snapshot(merged, path, buckets=min(buckets), dealt=True)


def merged_buckets(left: DataFrame, right: DataFrame, kinds: Iterable[str]) -> DataFrame:
    """The sum of two bucketed tables, one kind after the other."""
    parts = []
    for kind in kinds:
        a, b = (t.where(F.col("kind") == kind).select("bucket", "visits", "traffic_bytes") for t in (left, right))
        both = a.alias("a").join(b.hint("merge").alias("b"), F.col("a.bucket") == F.col("b.bucket"), "full_outer")
        zero = {"visits": F.expr("0L"), "traffic_bytes": F.lit(0).cast(names.BYTES_TYPE)}
        sums = [(F.coalesce(f"a.{c}", z) + F.coalesce(f"b.{c}", z)).cast(names.COUNTER_SCHEMA[c].dataType).alias(c) for c, z in zero.items()]
        parts.append(both.select(F.lit(kind).alias("kind"), F.coalesce("a.bucket", "b.bucket").alias("bucket"), *sums))
    return reduce(DataFrame.unionByName, parts)


@contextmanager
def _joining_unlike_buckets(spark: SparkSession, buckets: list[int]) -> Iterator[None]:
    """Lets Spark read several small buckets as one large bucket, as far apart as these are."""
    wanted = {
        "spark.sql.sources.bucketing.enabled": "true",
        "spark.sql.bucketing.coalesceBucketsInJoin.enabled": "true",
        "spark.sql.bucketing.coalesceBucketsInJoin.maxBucketRatio": str(max(buckets) // min(buckets)),
    }
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Counter table written by ``save_snapshot``; filters on kind prune its folders."""
    columns = names.COUNTER_SCHEMA.names
    return spark.read.schema(names.COUNTER_SCHEMA).parquet(path).select(*columns)


def materialize(counters: DataFrame, what: str = "counters") -> DataFrame:
    """Compute a counter table once, on shared storage, for several readers.

    A written table outlives the executors that computed it, unlike a cached one.
    """
    spark = counters.sparkSession
    path = scratch_path(spark, what)
    rows = counters.select(*[F.col(f.name).cast(f.dataType) for f in names.COUNTER_SCHEMA])
    rows.repartition("kind", F.pmod(F.xxhash64("bucket"), F.lit(SPREAD))).write.partitionBy("kind").parquet(path)
    return load_snapshot(spark, path)


def _section() -> Column:
    return (F.array_position(F.array(*map(F.lit, EXPORT_ORDER)), F.col("kind")) - 1).cast("int")


def export_rows(counters: DataFrame) -> DataFrame:
    """Every bucket of every dimension, then every hour, day and month; no totals."""
    return (
        counters.where(F.col("kind").isin(*EXPORT_ORDER))
        .select(*names.COUNTER_SCHEMA.names)
        .orderBy(_section(), "bucket")
    )


def export_csv(
    counters: DataFrame, path: str, mode: str = "error", single_file: bool = False
) -> None:
    """Write the export as CSV files with a header each, in the order of their paths.

    A folder for each section holds its files. The rows of a dimension are written where they are
    read, in no order; those of the three date series are sorted by ranges. So saved counters are
    exported without a shuffle of the dimensions; counters that are still to be computed would be
    computed twice. ``single_file`` is for small exports only: one task then writes one sorted file.
    """
    if single_file:
        export_rows(counters).coalesce(1).write.mode(mode).options(**_CSV_OPTIONS).csv(path)
        return
    dimensions, series = _sections(counters)
    for rows, how in ((dimensions, mode), (series, "append")):
        rows.write.mode(how).options(**_CSV_OPTIONS).partitionBy("section").csv(path)


def _sections(counters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the dimensions as they are, and those of the series in order."""
    rows = counters.select(_section().alias("section"), *names.COUNTER_SCHEMA.names)
    dimensions = rows.where(F.col("kind").isin(*names.DIMENSION_KINDS.values()))
    series = rows.where(F.col("kind").isin(*names.TREND_KINDS.values()))
    return dimensions, series.repartitionByRange("section", "bucket").sortWithinPartitions("section", "bucket")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Counter rows of a CSV export; an empty bucket comes back as empty text."""
    options = {**_CSV_OPTIONS, "nullValue": "\x00", "multiLine": True}
    rows = spark.read.schema(names.COUNTER_SCHEMA).options(**options).csv(path)
    columns = [F.coalesce("bucket", F.lit("")).alias(c) if c == "bucket" else F.col(c) for c in names.COUNTER_SCHEMA.names]
    return rows.select(*columns)
