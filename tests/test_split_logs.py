"""Queries that write the event log and read it back, over a table that Spark reads in several tasks."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from tests.test_queries import sorted_rows

FILES = 5


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with an events table of several files, each of them a task's."""
    folder = tmp_path_factory.mktemp("split")
    number = F.col("id")
    events = spark.range(2_000).select(
        number.alias("event_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id * 7 AS int))").alias("ts"),
        (number % 31).alias("user_id"),
        F.when(number % 5 == 0, "error").otherwise("view").alias("event_type"),
        (number * 0.5).alias("value"),
        F.concat(F.lit('{"k": '), (number % 9).cast("string"), F.lit("}")).alias("props"),
    )
    events.repartition(FILES).write.parquet(f"{folder}/events.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    yield str(folder)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def check(spark, folder, name):
    assert spark.read.parquet(f"{folder}/events.parquet").rdd.getNumPartitions() == FILES
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    result, expected = registry.queries()[name](spark, folder), duck.sql(registry.oracle_sql()[name])
    ours = sorted_rows(result.columns, [tuple(r) for r in result.collect()])
    assert ours == sorted_rows(expected.columns, expected.fetchall()) and len(ours) > 100


def test_carriage_returns(spark, folder):
    check(spark, folder, "carriage_returns")


def test_scan_log_files(spark, folder):
    check(spark, folder, "scan_log_files")


def test_undecodable_and_bare_lines(spark, folder):
    check(spark, folder, "undecodable_and_bare_lines")
