"""Access logs rendered from the event and page tables, to have logs whose content is known.

Every row becomes one line. Some events are written in the odd forms that real logs hold: junk,
tabs for spaces, an unknown month, no byte count. Which ones is a fixed rule on the event number,
so that the expected counts follow from the columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitledger.functions.line_fields import MONTHS

# An event whose number is a multiple of one of these is written in that odd form.
JUNK_LINE = 97
UNKNOWN_MONTH = 101
TAB_SEPARATED = 89
NO_BYTE_COUNT = 13
NO_REQUEST = 7
NO_TEXT = 11


def _every(step: int) -> Column:
    return F.col("event_id") % step == 0


def _timestamp(ts: Column, unknown_month: Column | None = None) -> Column:
    """``dd/Mon/yyyy:HH:mm:ss +0000`` from the text of a zone-less timestamp."""
    text = ts.cast("string")
    month = F.get(F.array(*map(F.lit, MONTHS)), F.substring(text, 6, 2).cast("int") - 1)
    if unknown_month is not None:
        month = F.when(unknown_month, "Foo").otherwise(month)
    day, year, time = F.substring(text, 9, 2), F.substring(text, 1, 4), F.substring(text, 12, 8)
    return F.concat(day, F.lit("/"), month, F.lit("/"), year, F.lit(":"), time, F.lit(" +0000"))


def event_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event number and request text of every event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", _request().alias("request"))


def _request() -> Column:
    return F.concat(
        F.lit("GET /"),
        "event_type",
        F.lit("/"),
        (F.col("event_id") % 50).cast("string"),
        F.lit("?k="),
        F.get_json_object("props", "$.k"),
        F.lit(" HTTP/1.1"),
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line per event: ``event_id``, ``event_type``, ``value``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    user = F.col("user_id")
    fields = {
        "ip": F.concat(
            F.lit("10.0."),
            F.expr("user_id div 256").cast("string"),
            F.lit("."),
            (user % 256).cast("string"),
        ),
        "time": F.concat(F.lit("["), _timestamp(F.col("ts"), _every(UNKNOWN_MONTH)), F.lit("]")),
        "request": F.concat(F.lit('"'), _request(), F.lit('"')),
        "status": F.when(F.col("event_type") == "error", "500").otherwise("200"),
        "bytes": F.when(_every(NO_BYTE_COUNT), "-").otherwise(
            F.floor(F.col("value") * 100).cast("string")
        ),
        "agent": F.concat(F.lit('"ua/'), (user % 7).cast("string"), F.lit('"')),
    }
    dash, no_referer = F.lit("-"), F.lit('"-"')
    order = ["ip", dash, dash, "time", "request", "status", "bytes", no_referer, "agent"]
    line = (
        F.when(_every(JUNK_LINE), F.concat(F.lit("garbage "), F.col("event_id").cast("string")))
        .when(_every(TAB_SEPARATED), F.concat_ws("\t", *order))
        .otherwise(F.concat_ws(" ", *order))
    )
    return events.select("event_id", "event_type", *(c.alias(n) for n, c in fields.items())).select(
        "event_id", "event_type", line.alias("value")
    )


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line per stored page: the request asks a proxy for its URL, the bytes are its size."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    line = F.concat(
        F.lit("10.1.0.1 - - [01/Jan/2024:00:00:00 +0000] \"GET "),
        "url",
        F.lit(' HTTP/1.1" 200 '),
        F.octet_length("html").cast("string"),
        F.lit(' "-" "-"'),
    )
    return pages.select("page_id", line.alias("value"))


def written_logs(spark: SparkSession, sf_dir: str, folder: str, line_end: str = "\n") -> dict[str, str]:
    """The event log as files below a new folder: ``first`` and ``second`` -> their paths.

    Every event is in one of the two folders. Their files are named like logs. Beside them lie decoys
    that hold the same lines again: files with other names, and a folder named like a log.
    """
    lines = event_lines(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(2)))
    paths = {}
    for part, name in enumerate(("first", "second")):
        own = lines.where(F.col("part") == part).select("value")
        paths[name] = f"{folder}/{name}"
        own.write.text(paths[name], lineSep=line_end)
        _name_files(spark, paths[name], "access.log")
    lines.select("value").write.mode("append").text(paths["first"], lineSep=line_end)
    _name_files(spark, paths["first"], "error.log")
    lines.select("value").write.text(f"{paths['second']}/access.log.d", lineSep=line_end)
    return paths


def daily_logs(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """The event log below a new folder with one file for each day: the folder of the files."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.to_date("ts").alias("day"))
    lines = event_lines(spark, sf_dir).select("event_id", "value").join(events, "event_id")
    lines.repartition("day").select("value", "day").write.partitionBy("day").text(f"{folder}/days")
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/days")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/daily")
    files.mkdirs(target)
    for day in files.listStatus(root):
        if day.isDirectory():
            for entry in files.listStatus(day.getPath()):
                if entry.getPath().getName().startswith("part-"):
                    name = day.getPath().getName().replace("day=", "access.log-")
                    files.rename(entry.getPath(), spark._jvm.org.apache.hadoop.fs.Path(target, name))
    return f"{folder}/daily"


def odd_named_logs(spark: SparkSession, sf_dir: str, folder: str) -> list[str]:
    """The event log in files below a new folder whose names begin or end like those of unfinished files."""
    event_lines(spark, sf_dir).select("value").repartition(3).write.text(folder, lineSep="\n")
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    forms, paths = ("_{}.log", ".hidden {}", "{}.log._COPYING_"), []
    for number, entry in enumerate(files.listStatus(root)):
        if entry.getPath().getName().startswith("part-"):
            paths.append(f"{folder}/{forms[number % 3].format(number)}")
            files.rename(entry.getPath(), spark._jvm.org.apache.hadoop.fs.Path(paths[-1]))
    return paths


def _name_files(spark: SparkSession, folder: str, prefix: str) -> None:
    """Renames Spark's files to prefix-number; there are as many as the writing job had tasks."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for number, entry in enumerate(files.listStatus(root)):
        name = entry.getPath().getName()
        if name.startswith("part-"):
            files.rename(entry.getPath(), spark._jvm.org.apache.hadoop.fs.Path(root, f"{prefix}-{number}"))


def odd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines, of which some have no request and no agent, and some a byte that is no UTF-8."""
    lines = event_lines(spark, sf_dir)
    bare = F.regexp_replace("value", '"GET [^"]*"', '""')
    bare = F.regexp_replace(bare, ' "ua/[0-9]+"$', "")
    broken = F.concat(F.col("value").cast("binary"), F.lit(b"\xff")).cast("string")
    return lines.select(
        "event_id", F.when(_every(NO_REQUEST), bare).when(_every(NO_TEXT), broken).otherwise(F.col("value")).alias("value")
    )


def huge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per event with a byte count around 2^63 and 2^64; the status tells which kind."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind, user = F.col("event_id") % 5, F.col("user_id").cast("decimal(20, 0)")

    def number(text: str) -> Column:
        return F.lit(text).cast("decimal(20, 0)")

    token = (
        F.when(kind == 0, (number("18446744073709551615") - user).cast("string"))
        .when(kind == 1, (number("9223372036854775807") + user).cast("string"))
        .when(kind == 2, (number("18446744073709551616") + user).cast("string"))
        .when(kind == 3, F.concat(F.lit("+000"), (number("9223372036854775807") - user).cast("string")))
        .otherwise(F.col("user_id").cast("string"))
    )
    start = F.lit('10.9.0.1 - - [01/Jan/2024:00:00:00 +0000] "GET /huge HTTP/1.1" ')
    line = F.concat(start, (200 + kind).cast("string"), F.lit(" "), token, F.lit(' "-" "ua"'))
    return events.select("event_id", line.alias("value"))
