"""What the operators share: tables, scratch tables and views of Arrow text columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitledger.sinks.scratch import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors' Python workers, once per application.

    The driver makes one small archive; Spark serves it, so that no shared folder is needed.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="package-")) / "hitledger_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text alone, so that other columns can have any name; null counts as empty."""
    ship(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


BATCH_ROWS = 2_000  # whole texts in one Arrow batch, which the executor and its worker both hold
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS rows at most for the jobs that are started meanwhile."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def written(df: DataFrame, what: str) -> DataFrame:
    """The table written to the shared scratch folder and read again: this cuts the lineage."""
    path = scratch_path(df.sparkSession, what)
    with small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MOST_PARTS = 50_000  # of one exchange or bucketed table, for which Spark allows 100,000


def parts_for(size: int, each: int, least: int = 1) -> int:
    """How many partitions of about `each` bytes hold `size` bytes; beyond MOST_PARTS they grow."""
    return min(MOST_PARTS, max(least, -(-size // each)))


def free_shuffles(spark: SparkSession) -> None:
    """Frees the disk of shuffles that nothing refers to any more.

    Spark removes their files when the driver's collector finds them unused, which a driver with
    much memory does late; between two steps that shuffle whole texts it is asked to.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns what this Python worker has freed to the system.

    Arrow's pool and the C library keep freed memory for later; the workers of an executor would each
    keep as much as their largest batch took. Where the C library has no such call, nothing happens.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column without nulls, and where each text begins and ends.

    Called once for each batch, it first gives back what the batches before have freed.
    """
    give_back()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int64, copy=False), pa.int64())
