"""Read a compact one-line JSON document in parallel.

Such a document is a single line of any length. Cut at every ``},"`` it falls into pieces of one
bucket each, whose order in the file tells which map they belong to. The pieces are written to the
shared folder with their places, so that nothing depends on how a later job splits the file. A cut
inside a bucket name shows by the quotes before it, and its pieces are joined again. A text that
cannot be cut so (it has white space between its tokens) is left to the reader of whole documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitledger import names
from hitledger.sinks.scratch import scratch_path

_SEPARATOR = '},"'

# What a piece looks like. The first piece opens with the scalars; a piece may open
# a map; it holds one bucket unless the map it opens is empty. The closing braces of a bucket are
# part of the separator, so braces are left over where a map or the document ends.
_PIECE = (
    r'(?s)\A(?:\{"files_count":([0-9]+),"aggregates":\{"total_visits":([0-9]+)'
    r',"total_traffic_bytes":([0-9]+),"parse_errors":([0-9]+),")?'
    r'(?:(MAPS)":\{"?)?'
    r'(?:([^"\\]*+(?:\\.[^"\\]*+)*+)":\{"visits":([0-9]+),"traffic_bytes":([0-9]+))?'
    r"(\}*)\s*\z"
)
_FIELDS = (
    "files_count",
    "total_visits",
    "total_traffic_bytes",
    "parse_errors",
    "map",
    "key",
    "visits",
    "traffic_bytes",
    "closing",
)


def read_compact(spark: SparkSession, path: str, maps: dict[str, str]) -> DataFrame | None:
    """Counter rows of a compact document; None if the text is not one, whatever else it is.

    ``maps`` gives the kind of each map, in the order of the document. One job checks all pieces
    and finds where the maps begin; its result is a single row.
    """
    pieces = _pieces(spark, path, maps)
    starts = [F.min(F.when(F.col("map") == name, F.col("place"))).alias(name) for name in maps]
    found = pieces.agg(
        F.count_if(~F.col("whole")).alias("odd"),
        F.count_if(F.col("map") != "").alias("opened"),
        F.count_if(F.col("files_count") != "").alias("heads"),
        F.count_if(F.length("closing") >= 3).alias("ends"),
        *starts,
    ).first()
    places = [found[name] for name in maps]
    in_order = None not in places and places == sorted(places)
    if (found.odd, found.opened, found.heads, found.ends) != (0, len(maps), 1, 1) or not in_order:
        return None
    return _rows(pieces, dict(zip(maps.values(), places)))


def _pieces(spark: SparkSession, path: str, maps: dict[str, str]) -> DataFrame:
    """The fields of every piece, its place in the file and whether it has the expected shape."""
    text = _joined(_placed(spark, path))
    pattern = _PIECE.replace("MAPS", "|".join(maps))
    template = "\n".join(f"${i}" for i in range(1, len(_FIELDS) + 1))
    placed = text.select(
        F.split(F.regexp_replace("value", F.lit(pattern), F.lit(template)), "\n", -1).alias("f"),
        "place",
    )
    fields = placed.select(
        "place",
        F.size("f").alias("size"),
        *(F.get("f", F.lit(i)).alias(name) for i, name in enumerate(_FIELDS)),
    )
    has_bucket = F.col("visits") != ""
    numbers_fit = reduce(
        Column.__and__,
        (
            (F.col(name) == "")
            | F.col(name).try_cast(names.BYTES_TYPE if "traffic" in name else "bigint").isNotNull()
            for name in _FIELDS
            if name not in ("map", "key", "closing")
        ),
    )
    braces = F.length("closing")
    shape = F.when(has_bucket, braces.isin(0, 1, 4)).otherwise(
        (F.col("map") != "") & braces.isin(0, 3)
    )
    whole = (F.col("size") == len(_FIELDS)) & shape & numbers_fit
    return fields.withColumn("whole", F.coalesce(whole, F.lit(False)))


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The pieces as they are cut, with block, row in the block, and the quotes up to the next piece."""
    text = spark.read.option("lineSep", _SEPARATOR).text(path)
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit(""))) + 1
    placed = text.select(
        "value",
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        quotes.cast("bigint").alias("quotes"),
    )
    target = scratch_path(spark, "pieces")
    placed.write.parquet(target)
    return spark.read.schema(placed.schema).parquet(target)


def _joined(pieces: DataFrame) -> DataFrame:
    """Text and place of each bucket: a piece after an even number of quotes goes on the one before.

    Numbers run within a block; what the blocks before add is one row per block.
    """
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pieces.groupBy("block").agg(F.sum("quotes").alias("all"))
    ahead = blocks.select("block", F.coalesce(F.sum("all").over(earlier), F.expr("0L")).alias("ahead"))
    in_block = Window.partitionBy("block").orderBy("row")
    so_far = F.coalesce(F.sum("quotes").over(in_block.rowsBetween(Window.unboundedPreceding, -1)), F.expr("0L"))
    counted = pieces.join(ahead, "block").withColumn("before", F.col("ahead") + so_far)
    place = F.struct("block", "row")
    begins = (F.col("before") == 0) | (F.col("before") % 2 == 1)
    marked = counted.withColumn("begin", F.when(begins, place))
    last = marked.groupBy("block").agg(F.max("begin").alias("last"))
    carried = last.select("block", F.max("last").over(earlier).alias("carried"))
    own = F.max("begin").over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    named = marked.withColumn("own", own).join(carried, "block").select(
        F.coalesce("own", "carried").alias("place"), F.struct("block", "row", "value").alias("piece")
    )
    parts = F.transform(F.array_sort(F.collect_list("piece")), lambda x: x["value"])
    return named.groupBy("place").agg(F.array_join(parts, _SEPARATOR).alias("value"))


def _rows(pieces: DataFrame, start_of: dict[str, object]) -> DataFrame:
    """Buckets with the kind of the last map that began before them, and the scalars."""
    kind = None
    for name, place in reversed(start_of.items()):
        start = F.struct(F.lit(place.block).alias("block"), F.lit(place.row).alias("row"))
        reached = F.col("place") >= start
        kind = F.when(reached, name) if kind is None else kind.when(reached, name)
    unescaped = F.from_json(F.concat(F.lit('["'), "key", F.lit('"]')), "array<string>")[0]
    key = F.when(F.col("key").contains("\\"), unescaped).otherwise(F.col("key"))
    buckets = pieces.where(F.col("visits") != "").select(
        kind.alias("kind"),
        key.alias("bucket"),
        F.col("visits").cast("bigint"),
        F.col("traffic_bytes").cast(names.BYTES_TYPE),
    )
    scalars = {
        names.TOTAL: ("total_visits", "total_traffic_bytes"),
        names.PARSE_ERRORS: ("parse_errors", None),
        names.FILES: ("files_count", None),
    }
    rows = [
        F.struct(
            F.lit(name).alias("kind"),
            F.lit(names.META_BUCKET).alias("bucket"),
            F.col(visits).cast("bigint").alias("visits"),
            (F.col(traffic) if traffic else F.lit("0")).cast(names.BYTES_TYPE).alias("traffic_bytes"),
        )
        for name, (visits, traffic) in scalars.items()
    ]
    head = pieces.where(F.col("files_count") != "").select(F.inline(F.array(*rows)))
    return buckets.unionByName(head)
