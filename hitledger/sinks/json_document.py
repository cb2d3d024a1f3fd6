"""The interchange form of a snapshot: one JSON document with a map per dimension and trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitledger import names
from hitledger.sources.any_document import read_any
from hitledger.sources.compact_document import read_compact

# The names of the maps in the document and the kinds they hold, in their order.
MAPS = {
    "ip": names.DIMENSION_KINDS["ip"],
    "path": names.DIMENSION_KINDS["path"],
    "user_agent": names.DIMENSION_KINDS["user_agent"],
    "status_code": names.DIMENSION_KINDS["status"],
    "by_day": names.TREND_KINDS["day"],
    "by_hour": names.TREND_KINDS["hour"],
    "by_month": names.TREND_KINDS["month"],
}
SCALARS = ("total_visits", "total_traffic_bytes", "parse_errors")

_COUNTER = T.StructType().add("visits", "long").add("traffic_bytes", T.DecimalType(38, 0))
_AGGREGATES = T.StructType()
for _name in SCALARS:
    _AGGREGATES.add(_name, T.DecimalType(38, 0) if _name == "total_traffic_bytes" else "long")
for _name in MAPS:
    _AGGREGATES.add(_name, T.MapType(T.StringType(), _COUNTER))
_STRICT = {"mode": "FAILFAST"}
DOCUMENT_SCHEMA = T.StructType().add("files_count", "long").add("aggregates", _AGGREGATES)


# Section 2i opens map i and holds what stands before it, section 2i+1 holds its entries; a last
# section closes the document. Two digits keep the folders of the sections in order.
_LAST_SECTION = 2 * len(MAPS)


def document_lines(counters: DataFrame) -> DataFrame:
    """The document as text lines ordered by section: one line per bucket and per frame piece.

    Each bucket is its own row, so no task ever holds a whole map. Needs a saved table, as the
    counters are read three times: for the scalars, the first buckets and all buckets.
    """
    kind_names = list(MAPS.values())

    def scalar(kind: str, column: str) -> Column:
        value = F.sum(F.when(F.col("kind") == kind, F.col(column)))
        return F.coalesce(value, F.expr("0L")).cast("string")

    scalars = counters.where(F.col("kind").startswith("meta:")).agg(
        F.concat(
            F.lit('{"files_count":'),
            scalar(names.FILES, "visits"),
            F.lit(',"aggregates":{"total_visits":'),
            scalar(names.TOTAL, "visits"),
            F.lit(',"total_traffic_bytes":'),
            scalar(names.TOTAL, "traffic_bytes"),
            F.lit(',"parse_errors":'),
            scalar(names.PARSE_ERRORS, "visits"),
            F.lit(","),
        ).alias("head")
    )

    def piece(section: int, text: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), text.alias("value"))

    openings = [
        piece(2 * i, F.concat(F.lit("},") if i else F.col("head"), F.lit(f'"{name}":{{')))
        for i, name in enumerate(MAPS)
    ]
    frame = scalars.select(
        F.inline(F.array(*openings, piece(_LAST_SECTION, F.lit("}}}"))))
    ).select("section", F.lit("").alias("bucket"), "value")

    in_maps = counters.where(F.col("kind").isin(*kind_names))
    # at most one row per map
    first = in_maps.groupBy("kind").agg(F.min("bucket").alias("first_bucket"))
    position = F.array_position(F.array(*map(F.lit, kind_names)), F.col("kind")).cast("int")
    # a one-element array in JSON, without its brackets, is the escaped key
    key = F.to_json(F.array("bucket"))
    entries = in_maps.join(F.broadcast(first), "kind").select(
        (2 * position - 1).alias("section"),
        "bucket",
        F.concat(
            F.when(F.col("bucket") == F.col("first_bucket"), "").otherwise(","),
            F.substring(key, F.lit(2), F.char_length(key) - 2),
            F.lit(':{"visits":'),
            F.col("visits").cast("string"),
            F.lit(',"traffic_bytes":'),
            F.col("traffic_bytes").cast("string"),
            F.lit("}"),
        ).alias("value"),
    )
    lines = frame.unionByName(entries)
    return lines.withColumn("section", F.lpad(F.col("section").cast("string"), 2, "0"))


def save_document(counters: DataFrame, path: str, mode: str = "error") -> None:
    """Write the document as text files that make it up when joined in the order of their paths."""
    ordered = document_lines(counters).orderBy("section", "bucket").select("section", "value")
    ordered.write.mode(mode).partitionBy("section").text(path, lineSep="\n")


def load_document(spark: SparkSession, path: str) -> DataFrame:
    """Counter table of a document in one file. Group rules are not applied again.

    A compact document is cut into its buckets; any other into its strings. Either way it is read in
    parallel. Text that is no such document is an error.
    """
    compact = read_compact(spark, path, MAPS)
    return read_any(spark, path, MAPS, SCALARS) if compact is None else compact


def load_document_folder(spark: SparkSession, path: str) -> DataFrame:
    """Counter table of a folder written by ``save_document``, each bucket line on its own."""
    schema = T.StructType().add("value", "string").add("section", "string")
    lines = spark.read.schema(schema).text(path)
    head = _parsed(lines.where(F.col("section") == "00"), F.concat("value", F.lit("}}}")))
    section = F.col("section").cast("int")
    entry = F.concat(F.lit("{"), F.regexp_replace("value", r"\A,", ""), F.lit("}"))
    kinds = F.array(*map(F.lit, MAPS.values()))
    entries = lines.where(section % 2 == 1).select(
        F.get(kinds, F.floor((section - 1) / 2).cast("int")).alias("kind"),
        F.explode_outer(F.from_json(entry, T.MapType(T.StringType(), _COUNTER), _STRICT)).alias(
            "bucket", "counter"
        ),
    )
    scalars = head.select(F.inline_outer(_scalar_rows()))
    return _checked(scalars.unionByName(entries.select("kind", "bucket", "counter.*")), path)


def _parsed(text: DataFrame, document: Column) -> DataFrame:
    parsed = text.select(F.from_json(document, DOCUMENT_SCHEMA, _STRICT).alias("document"))
    return parsed.select("document.files_count", "document.aggregates.*")


def _row(kind: str, bucket: Column, visits: Column, traffic_bytes: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        bucket.alias("bucket"),
        visits.alias("visits"),
        traffic_bytes.alias("traffic_bytes"),
    )


def _scalar_rows() -> Column:
    everything, zero = F.lit(names.META_BUCKET), F.lit(0).cast(names.BYTES_TYPE)
    return F.array(
        _row(names.TOTAL, everything, F.col("total_visits"), F.col("total_traffic_bytes")),
        _row(names.PARSE_ERRORS, everything, F.col("parse_errors"), zero),
        _row(names.FILES, everything, F.col("files_count"), zero),
    )


def _checked(counters: DataFrame, path: str) -> DataFrame:
    """Anything missing from the document has left a null behind; that ends the run."""
    failure = F.raise_error(F.lit(f"not a whole document: {path}"))
    row_is_whole = F.lit(True)
    for name in names.COUNTER_SCHEMA.names:
        row_is_whole &= F.col(name).isNotNull()
    return counters.select(
        F.when(row_is_whole, F.col("kind")).otherwise(failure).alias("kind"),
        "bucket",
        "visits",
        "traffic_bytes",
    )
