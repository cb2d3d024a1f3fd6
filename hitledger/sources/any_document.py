"""Read a JSON document of any layout in parallel: white space, order of fields, unknown fields.

The text is cut at every quote. How many real quotes stand before a piece, a prefix sum over its
block and over the blocks, tells whether it lies inside a string; pieces of a string that escaped
quotes divide are joined. What remains are tokens: a string and the structure that follows it, up to the
next string. The braces of the structure, summed likewise, give the depth of each string; the last
keys above it, carried from chunk to chunk, give its path. No task sees more than a block of the
file or a chunk of tokens; only one row per block or chunk meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitledger import names
from hitledger.sinks.scratch import scratch_path

_QUOTE = '"'
_CHUNK = 1 << 16  # tokens
_BLANK = r"[ \t\n\r]+"

# The fields of a bucket, and the structure that may follow a key by what it opens.
_FIELDS = ("visits", "traffic_bytes")
_NUMBER = r"\A:(0|[1-9][0-9]*)(,|\}+,?)\z"
_BUCKET = r"\A:\{\z"
_MAP = r"\A:\{(\}+,?)?\z"


def read_any(spark: SparkSession, path: str, maps: dict[str, str], scalars: tuple[str, ...]) -> DataFrame:
    """Counter rows of a document; text that is none, or lacks a part, is an error.

    ``maps`` gives the kind of each map and ``scalars`` the names of the numbers beside them. Fields of other
    names are passed over. Numbers are whole and unsigned, of 64 bits or, for bytes, up to 38 digits.
    """
    tokens = _nested(_tokens(spark, path))
    inside = F.col("depth_1") == "aggregates"
    own = {
        "bucket": inside & F.col("depth_2").isin(*maps) & (F.col("depth") == 3),
        "field": inside & F.col("depth_2").isin(*maps) & (F.col("depth") == 4) & F.col("name").isin(*_FIELDS),
        "map": inside & (F.col("depth") == 2) & F.col("name").isin(*maps),
        "scalar": inside & (F.col("depth") == 2) & F.col("name").isin(*scalars),
        "files": (F.col("depth") == 1) & (F.col("name") == "files_count"),
        "all": (F.col("depth") == 1) & (F.col("name") == "aggregates"),
    }
    role = F.lit(None).cast("string")
    for name, condition in own.items():
        role = F.when(F.col("is_key") & condition, name).otherwise(role)
    wide = F.col("name").isin("traffic_bytes", "total_traffic_bytes")
    number = F.regexp_extract("after", _NUMBER, 1)
    value = F.when(wide, number.try_cast(names.BYTES_TYPE)).otherwise(number.try_cast("bigint").cast(names.BYTES_TYPE))
    tokens = tokens.withColumn("role", role).withColumn("value", F.when(F.col("role").isin("field", "scalar", "files"), value))
    numbers = F.col("role").isin("field", "scalar", "files")
    good = (
        F.when(numbers, F.col("value").isNotNull())
        .when(F.col("role") == "bucket", F.col("after").rlike(_BUCKET))
        .when(F.col("role").isin("map", "all"), F.col("after").rlike(_MAP))
        .otherwise(True)
    )
    tokens = _written(tokens.withColumn("good", good), "document")

    def seen(name: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("role") == name, F.col("name")))).alias(name)

    # one row: at most as many names as there are maps and scalars
    found = tokens.agg(
        F.count_if(~F.col("good") | F.col("name").isNull() & (F.col("at") > 0) | F.col("after").isNull() | (F.col("least") < 1) & ~F.col("ends")).alias("odd"),
        F.sum("delta").alias("left"),
        F.count_if(F.col("role").isin("map", "scalar", "files", "all")).alias("parts"),
        *map(seen, ("map", "scalar", "files", "all")),
    ).first()
    whole = [sorted(maps), sorted(scalars), ["files_count"], ["aggregates"]]
    if (found.odd, found.left, found.parts) != (0, 0, sum(map(len, whole))) or [found.map, found.scalar, found.files, found["all"]] != whole:
        raise ValueError(f"not a whole document: {path}")
    return _rows(tokens, maps, path)


def _written(rows: DataFrame, what: str) -> DataFrame:
    path = scratch_path(rows.sparkSession, what)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _ahead(rows: DataFrame, group: str, value: str) -> DataFrame:
    """For each group the sum of a column over the groups before it; one row per group."""
    earlier = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(group).agg(F.sum(value).alias("all"))
    return sums.select(group, F.coalesce(F.sum("all").over(earlier), F.expr("0L")).alias("ahead"))


def _running(rows: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """The sum of a column over all rows before each, by sums within groups and over them."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(value).over(before), F.expr("0L"))
    return rows.join(_ahead(rows, group, value), group).withColumn(name, F.col("ahead") + within).drop("ahead")


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """Strings in order with the structure that follows each; at 0 stands what precedes the first."""
    text = spark.read.option("lineSep", _QUOTE).text(path)
    slashes = F.length("value") - F.length(F.rtrim("value", F.lit("\\")))
    pieces = text.select(
        "value",
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        (1 - slashes % 2).cast("bigint").alias("quotes"),
    )
    pieces = _running(_written(pieces, "quotes"), "block", "row", "quotes", "before")
    inside = F.col("before") % 2 == 1
    at = F.floor((F.col("before") + 1) / 2).cast("bigint").alias("at")
    part = F.when(inside, F.struct("block", "row", "value"))
    parts = F.transform(F.array_sort(F.collect_list(part)), lambda x: x["value"])
    tokens = pieces.groupBy(at).agg(
        F.when(F.count_if(inside) > 0, F.array_join(parts, _QUOTE)).alias("name"),
        F.max(F.when(~inside, F.col("value"))).alias("after"),
    )
    unescaped = F.from_json(F.concat(F.lit('["'), "name", F.lit('"]')), "array<string>")[0]
    name = F.when(F.col("name").contains("\\"), unescaped).otherwise(F.col("name"))
    divided = F.col("after").rlike(r"[0-9]" + _BLANK + r"[0-9]")
    after = F.when(~divided, F.regexp_replace("after", _BLANK, ""))
    chunk = F.floor(F.col("at") / _CHUNK).cast("bigint").alias("chunk")
    return tokens.select("at", chunk, name.alias("name"), after.alias("after"))


def _nested(tokens: DataFrame) -> DataFrame:
    """With the depth of each string, whether it is a key, and the last keys at the depths above."""
    after = F.coalesce("after", F.lit(""))
    opened, closed = (F.length(after) - F.length(F.regexp_replace(after, brackets, "")) for brackets in (r"[\[{]", r"[\]}]"))
    tokens = _written(tokens.withColumn("delta", (opened - closed).cast("bigint")), "tokens")
    rows = _running(tokens, "chunk", "at", "delta", "depth")
    rows = rows.withColumn("is_key", after.startswith(":")).withColumn("least", F.col("depth") + F.least("delta", F.lit(0)))
    last_at = tokens.agg(F.max("at").alias("last_at"))
    rows = rows.crossJoin(F.broadcast(last_at))  # one row
    rows = rows.withColumn("least", F.when(F.col("at") == 0, F.col("delta")).otherwise(F.col("least"))).withColumn("ends", F.col("at") == F.col("last_at"))
    for depth in (1, 2, 3):
        rows = rows.withColumn(f"key_{depth}", F.when(F.col("is_key") & (F.col("depth") == depth), F.struct("at", "name")))
    keys = [f"key_{depth}" for depth in (1, 2, 3)]
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("chunk").agg(*(F.max(key).alias(key) for key in keys))
    carried = ends.select("chunk", *(F.max(key).over(earlier).alias(f"carried_{key}") for key in keys))
    so_far = Window.partitionBy("chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for key in keys:
        rows = rows.withColumn(key, F.max(key).over(so_far))
    rows = rows.join(carried, "chunk")
    last = [F.coalesce(key, F.col(f"carried_{key}")) for key in keys]
    return rows.select(
        "at", "name", "after", "delta", "depth", "least", "ends", "is_key",
        last[0]["name"].alias("depth_1"), last[1]["name"].alias("depth_2"),
        last[2]["at"].alias("bucket_at"), last[2]["name"].alias("bucket"),
    )


def _rows(tokens: DataFrame, maps: dict[str, str], path: str) -> DataFrame:
    """The buckets from their fields, and the scalars. A bucket that lacks a field ends the run."""
    kinds = F.create_map(*[F.lit(x) for pair in maps.items() for x in pair])[F.col("depth_2")]

    def field(name: str) -> Column:
        return F.max(F.when((F.col("role") == "field") & (F.col("name") == name), F.col("value"))).alias(name)

    buckets = tokens.where(F.col("role").isin("field", "bucket")).groupBy(kinds.alias("kind"), "bucket_at").agg(F.max("bucket").alias("bucket"), *map(field, _FIELDS))
    lacking = F.col("visits").isNull() | F.col("traffic_bytes").isNull()
    failure = F.raise_error(F.lit(f"not a whole document: {path}"))
    buckets = buckets.select(
        F.when(lacking, failure).otherwise(F.col("kind")).alias("kind"), "bucket", F.col("visits").cast("bigint").alias("visits"), "traffic_bytes"
    )

    def scalar(name: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col("value"))).alias(name)

    zero = F.lit(0).cast(names.BYTES_TYPE)
    values = tokens.where(F.col("role").isin("scalar", "files")).agg(*map(scalar, ("files_count", "total_visits", "total_traffic_bytes", "parse_errors")))
    pairs = {names.TOTAL: ("total_visits", F.col("total_traffic_bytes")), names.PARSE_ERRORS: ("parse_errors", zero), names.FILES: ("files_count", zero)}
    rows = [
        F.struct(F.lit(kind).alias("kind"), F.lit(names.META_BUCKET).alias("bucket"), F.col(visits).cast("bigint").alias("visits"), traffic.alias("traffic_bytes"))
        for kind, (visits, traffic) in pairs.items()
    ]
    return buckets.unionByName(values.select(F.inline(F.array(*rows))))
