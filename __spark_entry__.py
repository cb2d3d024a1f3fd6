"""

The logs are rendered from the event and page tables (one line per row, see
``hitledger/plans/event_logs.py``) and go through the whole parser; the SQL computes the same
answers from the source columns and never parses a line.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from hitledger import GroupingRules, GroupRule, names
from hitledger.functions import line_fields as lf
from hitledger.functions.display import human_bytes
from hitledger.operators import counting, heavy, parsing, ranking
from hitledger.plans.event_logs import (
    daily_logs,
    event_lines,
    event_requests,
    huge_lines,
    odd_lines,
    odd_named_logs,
    page_lines,
    written_logs,
)
from hitledger.plans.ledger import Ledger, analyze
from hitledger.sinks import json_document, tables
from hitledger.sinks.scratch import scratch_path
from hitledger.sources.log_files import read_lines, resolve_inputs
from oracle_queries import ORACLE_SQL

try:  # the subpackage and the pipeline can be absent, and nothing else may be
    import corpus_pipeline
    from hitledger.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "hitledger.llm"):
        raise
    LLM_QUERIES, LLM_SQL = {}, {}
else:
    LLM_QUERIES = {**llm_queries.QUERIES, "pipeline": corpus_pipeline.run}
    LLM_SQL = {**llm_queries.ORACLE_SQL}
    if corpus_pipeline.ORACLE_SQL:
        LLM_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL

Query = Callable[[SparkSession, str], DataFrame]

IP, PATH, AGENT, STATUS = names.DIMENSION_KINDS.values()

RULES = GroupingRules(
    ip=GroupRule(r"^10\.0\.(\d+)\.\d*(\d)$", "$1-*$2"),
    path=GroupRule(r"^/([^/]+)/\d*(\d)\?.*$", "${1}#$2"),
    user_agent=GroupRule(r"^ua/([0-2])$", "early $1"),
)
STRIP_QUERY = GroupingRules(path=GroupRule(r"\?.*$", ""))
# Rules over an event type, by what is wrong with them, if anything.
RULE_FORMS = {
    "whole": "^NAME$",
    "groups": "(?P<kind>NAME)/(\\d+)",
    "open group": "(NAME",
    "open class": "[NAME",
    "look-ahead": "NAME(?=/)",
    "back-reference": "(NAME)\\1",
    "bad range": "NAME{2,1}",
    "nothing to repeat": "NAME|*",
}
URL_HOST = GroupingRules(path=GroupRule(r"^(?P<scheme>\w+)://(?P<host>[^/?#]+).*$", "${host}"))


def entry(spark: SparkSession) -> DataFrame:
    """Top 30 paths by traffic, without their query strings, with shares of everything."""
    return top_paths_without_query(spark, "/root/testdata/sf0.001")


def _counters(spark: SparkSession, sf_dir: str, *kinds: str, rules=None) -> DataFrame:
    """Counters of the event log for the wanted kinds; all of them by default."""
    return counting.count_lines(event_lines(spark, sf_dir), rules, kinds or names.TALLY_KINDS)


def top_paths_without_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = _counters(spark, sf_dir, PATH, names.TOTAL, rules=STRIP_QUERY)
    return ranking.top_rows(counters, "path", "traffic")


def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines; the record is null where the line is a reject."""
    lines = event_lines(spark, sf_dir).select("event_id", "value")
    return parsing.parse_lines(lines)


def parse_fallback_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines by the second pattern alone, which these lines match as well."""
    lines = event_lines(spark, sf_dir).select("event_id", "value")
    return parsing.parse_lines_by_pattern(lines)


def parse_page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_lines(page_lines(spark, sf_dir)).select("page_id", "path", "traffic_bytes")


def request_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = event_requests(spark, sf_dir)
    return requests.select("event_id", lf.request_path(F.col("request")).alias("path"))


def request_path_any_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", lf.request_path(F.col("text")).alias("path"))


def parse_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.explode(F.split("text", "[ \n]")).alias("token")
    )
    counted = words.groupBy(lf.parse_bytes(F.col("token")).alias("traffic_bytes"))
    return counted.agg(F.count("*").alias("tokens"))


def parse_error_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counting.summary(_counters(spark, sf_dir, names.TOTAL, names.PARSE_ERRORS))
    lines = (F.col("visits") + F.col("parse_errors")).alias("lines")
    return found.select(lines, "parse_errors")


def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.rejected_lines(event_lines(spark, sf_dir).select("event_id", "value"))


def timestamp_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_lines(spark, sf_dir).select("event_id", "value")
    return parsing.with_buckets(parsing.parse_lines(lines)).select(
        "event_id", "hour", "day", "month"
    )


def _grouped(dimension: str, rules: GroupingRules, lines=event_lines) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        kind = names.DIMENSION_KINDS[dimension]
        counters = counting.count_lines(lines(spark, sf_dir), rules, [kind])
        return counting.dimension_counters(counters, dimension)

    return query


def group_rule_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event type, which rules made of its name are refused, and by the name of which option."""
    types = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct()
    rows = []
    for kind in sorted(row.event_type for row in types.toLocalIterator()):
        for form, pattern in RULE_FORMS.items():
            for option in ("group_ip_regex", "group_path_regex", "group_ua_regex"):
                try:
                    GroupingRules.from_options(spark, **{option: pattern.replace("NAME", kind)})
                    refusal = ""
                except ValueError as problem:
                    refusal = str(problem).split(":")[0]
                rows.append((kind, form, option, refusal))
    return spark.createDataFrame(rows, "event_type string, form string, option string, refusal string")


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a folder with one file for each day."""
    folder = daily_logs(spark, sf_dir, scratch_path(spark, "logs"))
    return analyze(spark, [folder]).summary()


def _series(granularity: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        counters = _counters(spark, sf_dir, names.TREND_KINDS[granularity])
        return counting.date_series(counters, granularity)

    return query


def counter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counters(spark, sf_dir)


def counter_table_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counters(spark, sf_dir, rules=RULES)


def date_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = tables.materialize(_counters(spark, sf_dir, *names.TREND_KINDS.values()))
    series = [
        counting.date_series(saved, granularity).select(F.lit(granularity).alias("granularity"), "*")
        for granularity in names.TREND_KINDS
    ]
    return reduce(DataFrame.unionByName, series)


def snapshot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logs counted and saved apart, error events and the others, then added up side by side."""
    lines = event_lines(spark, sf_dir)
    errors = F.col("event_type") == "error"
    ledgers = []
    for own, buckets in ((lines.where(errors), 8), (lines.where(~errors), 16)):
        path = scratch_path(spark, "snapshot")
        tables.save_snapshot(counting.count_lines(own), path, buckets=buckets)
        ledgers.append(Ledger(tables.load_snapshot(spark, path), snapshot=path))
    return ledgers[0].merged_with(ledgers[1]).counters


def pct_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of paths with their shares of everything."""
    counters = _counters(spark, sf_dir, PATH, names.TOTAL, rules=RULES)
    return ranking.top_rows(counters, "path", "visits", 100)


def _top(dimension: str, sort_by: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        counters = _counters(spark, sf_dir, names.DIMENSION_KINDS[dimension], names.TOTAL)
        return ranking.top_rows(counters, dimension, sort_by)

    return query


def top_path_from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best paths without a count of all paths."""
    return heavy.top_rows_of_lines(event_lines(spark, sf_dir), "path", "traffic")


def top_n_all_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [*names.DIMENSION_KINDS.values(), names.TOTAL]
    return ranking.top_rows_all(_counters(spark, sf_dir, *kinds), "traffic", 10)


def top_n_each_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a saved table."""
    saved = tables.materialize(_counters(spark, sf_dir))
    return ranking.top_rows_each(saved, "traffic", 10)


def top_rows_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrolled past the end: the page stops at the last ten of the top 30."""
    counters = _counters(spark, sf_dir, IP, names.TOTAL)
    return ranking.page_of_rows(counters, "ip", "visits", 30, scroll=25, visible=10)


def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = _counters(spark, sf_dir, IP, names.TOTAL)
    return ranking.table_cells(ranking.top_rows(counters, "ip", "traffic"))


def human_bytes_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = _counters(spark, sf_dir, PATH, rules=STRIP_QUERY)
    paths = counting.dimension_counters(counters, "path")
    return paths.select(
        F.col("bucket").alias("key"),
        F.col("visits").cast("string").alias("visits_text"),
        human_bytes(F.col("traffic_bytes")).alias("traffic_text"),
        human_bytes(F.col("traffic_bytes") * 1000003).alias("large_text"),
    )


def bar_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = _counters(spark, sf_dir, PATH, names.TOTAL)
    return ranking.bar_series(counters, "path", "traffic", 30, graph_items=12)


def trend_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.trend_points(_counters(spark, sf_dir, names.TREND_KINDS["hour"]), "hour")


def trend_points_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.trend_points(_counters(spark, sf_dir, names.TREND_KINDS["day"]), "day")


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV and read back."""
    path = scratch_path(spark, "export")
    tables.export_csv(tables.materialize(_counters(spark, sf_dir)), path)
    return tables.read_export(spark, path)


def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a Parquet snapshot and read back."""
    return tables.materialize(counting.with_file_count(_counters(spark, sf_dir), 1))


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved, written as a JSON document and read back from that."""
    path = scratch_path(spark, "document")
    json_document.save_document(snapshot_roundtrip(spark, sf_dir), path)
    return json_document.load_document_folder(spark, path)


def json_any_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved, written as one indented JSON document in one file, and read back from that."""
    path = scratch_path(spark, "document")
    lines = json_document.document_lines(snapshot_roundtrip(spark, sf_dir)).orderBy("section", "bucket")
    lines.select("value").coalesce(1).write.text(path, lineSep="\n    ")
    return json_document.load_document(spark, path)


def scan_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as text files, then scanned, parsed and counted from there."""
    path = scratch_path(spark, "log")
    event_lines(spark, sf_dir).select("value").write.text(path, lineSep="\n")
    return counting.count_lines(read_lines(spark, [path]))


def several_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders with decoys in them, both named twice."""
    logs = written_logs(spark, sf_dir, scratch_path(spark, "logs"))
    files = resolve_inputs(spark, [logs["first"], logs["second"], logs["second"], logs["first"]])
    return counting.count_lines(read_lines(spark, files))


def odd_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in files with names that Spark passes over, each named as an input of its own."""
    folder = scratch_path(spark, "logs")
    files = odd_named_logs(spark, sf_dir, folder)
    return counting.count_lines(read_lines(spark, resolve_inputs(spark, files)))


def carriage_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log whose lines end in CR LF."""
    path = scratch_path(spark, "log")
    event_lines(spark, sf_dir).select("value").write.text(path, lineSep="\r\n")
    return counting.count_lines(read_lines(spark, [path]))


def undecodable_and_bare_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are no UTF-8 make a reject; a missing request or agent has its default."""
    path = scratch_path(spark, "log")
    odd_lines(spark, sf_dir).select("value").write.text(path, lineSep="\n")
    return counting.count_lines(read_lines(spark, [path], invalid_utf8="reject"))


def save_and_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run that saves and exports, twice over the same targets; what the export of all logs holds."""
    logs = written_logs(spark, sf_dir, scratch_path(spark, "logs"))
    db, export = scratch_path(spark, "db"), scratch_path(spark, "csv")
    for folders in ([logs["first"]], [logs["first"], logs["second"]]):
        analyze(spark, folders, save_db=db, export_csv=export, mode="overwrite")
    saved = analyze(spark, load_db=db).counters.where(F.col("kind") == names.TOTAL)
    return tables.read_export(spark, export).unionByName(saved)


def bars_by_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = _counters(spark, sf_dir, IP, names.TOTAL)
    return ranking.bar_series(counters, "ip", "visits", 20)


def _with_long_bytes(query: Query) -> Query:
    """Byte counts as BIGINT, which the checked tables fit; larger ones are compared as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = query(spark, sf_dir)
        decimals = {name: F.col(name).cast("bigint") for name, kind in found.dtypes if "decimal" in kind}
        return found.withColumns(decimals) if decimals else found

    return run


def huge_byte_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte counts of 2^63 and more, up to the largest that counts, and one that is too large."""
    return counting.dimension_counters(
        counting.count_lines(huge_lines(spark, sf_dir), kinds=[names.DIMENSION_KINDS["status"]]), "status"
    ).select("bucket", "visits", F.col("traffic_bytes").cast("string").alias("traffic_bytes"))


def human_bytes_of_huge_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    counters = counting.count_lines(huge_lines(spark, sf_dir), kinds=[names.TOTAL])
    return counters.select("visits", human_bytes(F.col("traffic_bytes")).alias("traffic_text"))


def queries() -> dict[str, Query]:
    """One entry per operator; each callable takes the session and a data folder."""
    own = {
        "top_paths_without_query": top_paths_without_query,
        "parse_lines": parse_lines,
        "parse_fallback_lines": parse_fallback_lines,
        "parse_page_requests": parse_page_requests,
        "request_path": request_path,
        "request_path_any_text": request_path_any_text,
        "parse_bytes": parse_bytes,
        "parse_error_count": parse_error_count,
        "rejected_lines": rejected_lines,
        "timestamp_buckets": timestamp_buckets,
        "group_ip_subnet": _grouped("ip", RULES),
        "group_path_first_segment": _grouped("path", RULES),
        "group_path_strip_query": _grouped("path", STRIP_QUERY),
        "group_user_agent": _grouped("user_agent", RULES),
        "group_page_url_host": _grouped("path", URL_HOST, page_lines),
        "group_page_url_strip_query": _grouped("path", STRIP_QUERY, page_lines),
        "group_rule_refusals": group_rule_refusals,
        "summary": summary,
        "dim_ip": _grouped("ip", GroupingRules()),
        "dim_path": _grouped("path", GroupingRules()),
        "dim_user_agent": _grouped("user_agent", GroupingRules()),
        "dim_status": _grouped("status", GroupingRules()),
        "trend_day": _series("day"),
        "trend_hour": _series("hour"),
        "trend_month": _series("month"),
        "counter_table": counter_table,
        "counter_table_grouped": counter_table_grouped,
        "snapshot_merge": snapshot_merge,
        "pct_of_total": pct_of_total,
        "top_ip_by_visits": _top("ip", "visits"),
        "top_path_by_traffic": _top("path", "traffic"),
        "top_user_agent_by_visits": _top("user_agent", "visits"),
        "top_status_by_traffic": _top("status", "traffic"),
        "top_path_from_lines": top_path_from_lines,
        "top_n_all_dimensions": top_n_all_dimensions,
        "top_n_each_dimension": top_n_each_dimension,
        "date_series": date_series,
        "top_rows_page": top_rows_page,
        "table_text": table_text,
        "human_bytes": human_bytes_of_paths,
        "bar_series": bar_series,
        "trend_points": trend_points,
        "trend_points_day": trend_points_day,
        "export_rows": export_rows,
        "snapshot_roundtrip": snapshot_roundtrip,
        "json_roundtrip": json_roundtrip,
        "json_any_layout": json_any_layout,
        "scan_log_files": scan_log_files,
        "several_inputs": several_inputs,
        "odd_file_names": odd_file_names,
        "carriage_returns": carriage_returns,
        "undecodable_and_bare_lines": undecodable_and_bare_lines,
        "save_and_export": save_and_export,
        "bars_by_visits": bars_by_visits,
        "huge_byte_counts": huge_byte_counts,
        "human_bytes_of_huge_sums": human_bytes_of_huge_sums,
    }
    return {**{name: _with_long_bytes(query) for name, query in own.items()}, **LLM_QUERIES}


def oracle_sql() -> dict[str, str]:
    """The SQL counterpart of every query, from the source columns."""
    return {**ORACLE_SQL, **LLM_SQL}
