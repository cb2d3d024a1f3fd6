"""From logs or a snapshot to every view and export: the library's front door."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from hitledger import names
from hitledger.functions.grouping import GroupingRules
from hitledger.operators import counting, ranking
from hitledger.sinks import json_document, tables
from hitledger.sinks.scratch import scratch_path
from hitledger.sources.log_files import read_lines, resolve_inputs


SHUFFLE_PARTITIONS = "spark.sql.shuffle.partitions"
INPUT_BYTES_PER_SHUFFLE_PARTITION = 4 << 30
COUNTER_BYTES_PER_SHUFFLE_PARTITION = 64 << 20


class Ledger:
    """A saved counter table and the questions that can be asked of it."""

    def __init__(
        self,
        counters: DataFrame,
        sort_by: str = "visits",
        top: int = names.DEFAULT_TOP,
        graph_items: int = 0,
        snapshot: str | None = None,
    ):
        """``snapshot`` is the folder that ``save_snapshot`` wrote the counters to, if it did."""
        names.sort_column(sort_by)
        self.counters = counters
        self.snapshot = snapshot
        self.sort_by = sort_by
        self.top = top
        self.graph_items = graph_items

    def summary(self) -> DataFrame:
        return counting.summary(self.counters, self.sort_by)

    def rows(self, dimension: str) -> DataFrame:
        return ranking.top_rows(self.counters, dimension, self.sort_by, self.top)

    def all_rows(self) -> DataFrame:
        return ranking.top_rows_each(self.counters, self.sort_by, self.top)

    def page(self, dimension: str, scroll: int, visible: int) -> DataFrame:
        return ranking.page_of_rows(
            self.counters, dimension, self.sort_by, self.top, scroll, visible
        )

    def bars(self, dimension: str) -> DataFrame:
        return ranking.bar_series(
            self.counters, dimension, self.sort_by, self.top, self.graph_items
        )

    def series(self, granularity: str = "day") -> DataFrame:
        return counting.date_series(self.counters, granularity)

    def trend(self, granularity: str = "day") -> DataFrame:
        return ranking.trend_points(self.counters, granularity)

    def merged_with(self, other: Ledger) -> Ledger:
        """A ledger of both inputs, written to the shared folder.

        Two snapshots are added up bucket by bucket, without a shuffle; other counters are dealt anew.
        """
        spark = self.counters.sparkSession
        path = scratch_path(spark, "merged")
        snapshots = [self.snapshot, other.snapshot]
        if all(s and tables.snapshot_buckets(spark, s) for s in snapshots):
            tables.merge_snapshots(spark, *snapshots, path)
        else:
            both = counting.merge_counters(self.counters, other.counters)
            # two ledgers hold counters, not lines: a partition takes far fewer bytes of them
            size = (_input_bytes(self.counters) + _input_bytes(other.counters)) * (INPUT_BYTES_PER_SHUFFLE_PARTITION // COUNTER_BYTES_PER_SHUFFLE_PARTITION)
            with _enough_shuffle_partitions(spark, size) as buckets:
                tables.save_snapshot(both, path, buckets=buckets)
        return Ledger(tables.load_snapshot(spark, path), self.sort_by, self.top, self.graph_items, path)

    def save(self, path: str, mode: str = "error") -> None:
        tables.save_snapshot(self.counters, path, mode, _buckets_for(self.counters, self.snapshot))

    def save_json(self, path: str, mode: str = "error") -> None:
        json_document.save_document(self.counters, path, mode)

    def export_csv(self, path: str, mode: str = "error", single_file: bool = False) -> None:
        tables.export_csv(self.counters, path, mode, single_file)


def analyze(
    spark: SparkSession,
    files: Iterable[str] = (),
    *,
    load_db: str | None = None,
    save_db: str | None = None,
    export_csv: str | None = None,
    top: int = names.DEFAULT_TOP,
    graph_items: int = 0,
    sort_by: str = "visits",
    invalid_utf8: str = "fail",
    mode: str = "error",
    **group_options: str,
) -> Ledger:
    """Count the logs, or load a snapshot; save and export if asked; return the ledger.

    ``load_db`` takes a Parquet snapshot or a JSON document and excludes log files; group options
    have no effect on it. The logs are read once: the counters go to ``save_db``, or else to the
    cluster's shared folder, and everything after that reads them there. Where ``save_db`` or
    ``export_csv`` exists, mode "error" refuses it before any log is read, and "overwrite"
    replaces it.
    """
    if mode not in ("error", "overwrite"):
        raise ValueError(f"mode must be error or overwrite; got {mode!r}")
    files = list(files)
    for option, target in (("save_db", save_db), ("export_csv", export_csv)):
        if target is not None and mode == "error" and _exists(spark, target):
            raise FileExistsError(f"{option} exists already: {target}")
    if load_db is not None and load_db == save_db:
        raise ValueError("save_db cannot replace the snapshot that load_db reads")
    if load_db is not None:
        if files:
            raise ValueError("load_db cannot be combined with log files")
        counters = load_counters(spark, load_db)
        snapshot = load_db if _is_snapshot(spark, load_db) else None
        if save_db is not None:
            tables.save_snapshot(counters, save_db, mode, _buckets_for(counters, snapshot))
    else:
        resolved = resolve_inputs(spark, files)
        rules = GroupingRules.from_options(spark, **group_options)
        lines = read_lines(spark, resolved, invalid_utf8)
        counted = counting.with_file_count(counting.count_lines(lines, rules), len(resolved))
        target = save_db if save_db is not None else scratch_path(spark, "counters")
        with _enough_shuffle_partitions(spark, _input_bytes(lines)) as buckets:
            tables.save_snapshot(counted, target, mode, buckets)
        counters, snapshot = tables.load_snapshot(spark, target), target
    ledger = Ledger(counters, sort_by, top, graph_items, snapshot)
    if export_csv is not None:
        ledger.export_csv(export_csv, mode)
    return ledger


def _buckets_for(counters: DataFrame, snapshot: str | None) -> int:
    """As many buckets as the snapshot has that holds the counters, or as their size calls for."""
    held = tables.snapshot_buckets(counters.sparkSession, snapshot) if snapshot else None
    return held or -(-_input_bytes(counters) // COUNTER_BYTES_PER_SHUFFLE_PARTITION)


def _input_bytes(lines: DataFrame) -> int:
    """Size of the files behind the lines, from Spark's own statistics; nothing is read."""
    statistics = lines._jdf.queryExecution().optimizedPlan().stats()
    return int(str(statistics.sizeInBytes()))


@contextmanager
def _enough_shuffle_partitions(spark: SparkSession, input_bytes: int) -> Iterator[int]:
    """At least as many shuffle partitions as the input calls for, while the counters are written.

    Gives the number that the input calls for.

    Adaptive execution joins partitions that turn out small, but cannot split those of an
    aggregate.
    """
    configured = spark.conf.get(SHUFFLE_PARTITIONS)
    wanted = -(-input_bytes // INPUT_BYTES_PER_SHUFFLE_PARTITION)
    spark.conf.set(SHUFFLE_PARTITIONS, max(int(configured), wanted))
    try:
        yield wanted
    finally:
        spark.conf.set(SHUFFLE_PARTITIONS, configured)


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def load_counters(spark: SparkSession, path: str) -> DataFrame:
    """Counters of a snapshot folder or of a JSON document; a document is read once, re-written."""
    if _is_snapshot(spark, path):
        return tables.load_snapshot(spark, path)
    if any(name.startswith("section=") for name in _folder_names(spark, path)):
        return tables.materialize(json_document.load_document_folder(spark, path))
    return tables.materialize(json_document.load_document(spark, path))


def _is_snapshot(spark: SparkSession, path: str) -> bool:
    return any(name.startswith("kind=") for name in _folder_names(spark, path))


def _folder_names(spark: SparkSession, path: str) -> list[str]:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not file_system.exists(jpath):
        raise FileNotFoundError(f"there is no snapshot or document at {path}")
    return [entry.getPath().getName() for entry in file_system.listStatus(jpath)]
