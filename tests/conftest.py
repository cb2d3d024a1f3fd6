import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

def counter_table(spark, rows):
    """A counter table of (kind, bucket, visits, bytes)."""
    from hitledger import names

    return spark.createDataFrame([(*r[:3], Decimal(r[3])) for r in rows], names.COUNTER_SCHEMA)


SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lines_of(spark):
    """DataFrame of numbered lines from Python text."""

    def make(texts):
        return spark.createDataFrame(list(enumerate(texts)), "id int, value string")

    return make
