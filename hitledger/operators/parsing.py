"""Log lines to records: delimiter search first, the stricter pattern second, else a reject.

Each step is a projection whose results the next step uses several times, so Catalyst keeps them
apart and evaluates every split once; all of them still run in one code-generated stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitledger.functions import line_fields as lf

# A plain line keeps address and timestamp before its first quote, status and byte count between
# its second and third, and has at least four quotes; nothing but spaces precedes the status.
# Splitting at quotes, at the bracket and at spaces then does the whole delimiter search.
_IS_PLAIN = """
    coalesce(
        contains(get(_head, 0), ' ')
        AND contains(get(_head, 1), ']')
        AND get(_response, 0) >= '!' AND get(_response, 0) < char(127)
        AND get(_response, 2) IS NOT NULL
        AND get(_quoted, 4) IS NOT NULL,
        false)
"""


def _columns(frame: DataFrame, but: str | None = None) -> list[Column]:
    """The columns of a frame, whatever characters their names hold."""
    return [F.col(f"`{name}`") for name in frame.columns if name != but]


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """One output row per input row: the other input columns and the record.

    The record columns are all null where the line is a reject. Byte counts are decimals, which
    hold every unsigned 64-bit number. Lines that are not plain go through the patterns, which
    hold for every line.
    """
    kept = _columns(lines, but=column)
    line = lf.without_trailing_cr(F.col(f"`{column}`"))
    quoted = lines.select(*kept, line.alias("_line"), F.split(line, '"', 7).alias("_quoted"))
    pieces = quoted.select(
        *kept,
        "_line",
        "_quoted",
        F.split(F.expr("get(_quoted, 0)"), r"\[", 2).alias("_head"),
        F.split(F.expr("ltrim(get(_quoted, 2))"), " ", 3).alias("_response"),
    )
    decided = pieces.select("*", F.expr(_IS_PLAIN).alias("_plain"))
    request = F.expr("get(_quoted, 1)")
    by_pattern = lf.fields_of(F.col("_line"), lf.DELIMITED_LINE, lf.COMBINED_LINE)
    matched = decided.select(
        *kept,
        "_quoted",
        "_head",
        "_response",
        "_plain",
        F.when(~F.col("_plain"), by_pattern).alias("_matched"),
        F.when(F.col("_plain"), lf.second_visible_word(request)).alias("_word"),
    )
    number = lf.number_or_null(F.expr("get(_response, 1)"))
    fields = matched.select(
        *kept,
        _field("ip", "substring_index(get(_head, 0), ' ', 1)"),
        _field("timestamp_str", "substring_index(get(_head, 1), ']', 1)"),
        F.when(F.col("_word") != "", F.col("_word"))
        .when(F.col("_plain"), lf.second_word(request))
        .otherwise(F.expr(_pattern_field("_path")))
        .alias("_path"),
        _field("status_code", "get(_response, 0)"),
        F.when(F.col("_plain"), number).otherwise(F.expr(_pattern_field("_bytes"))).alias("_bytes"),
        F.expr(
            "CASE WHEN _plain THEN coalesce(get(_quoted, 5), '-') "
            f"ELSE {_without_quote(_pattern_field('_agent'))} END"
        ).alias("user_agent"),
    )
    return _records(fields, kept)


def parse_lines_by_pattern(
    lines: DataFrame, column: str = "value", patterns: tuple[str, ...] = (lf.COMBINED_LINE,)
) -> DataFrame:
    """The same rows and columns from whole-line patterns alone; by default only the second one."""
    kept = _columns(lines, but=column)
    line = lf.without_trailing_cr(F.col(f"`{column}`"))
    matched = lines.select(*kept, lf.fields_of(line, *patterns).alias("_matched"))
    fields = matched.select(
        *kept,
        *(F.expr(_pattern_field(name)).alias(name) for name in _PATTERN_FIELDS),
        F.expr(_without_quote(_pattern_field("_agent"))).alias("user_agent"),
    )
    return _records(fields, kept)


_PATTERN_FIELDS = ("ip", "timestamp_str", "_path", "status_code", "_bytes", "_agent")


def _pattern_field(name: str) -> str:
    return f"CASE WHEN size(_matched) > 1 THEN get(_matched, {_PATTERN_FIELDS.index(name)}) END"


def _without_quote(agent: str) -> str:
    """Pattern fields carry the opening quote, which tells an empty agent from a missing one."""
    return f"CASE WHEN {agent} = '' THEN '-' ELSE substring({agent}, 2) END"


def _field(name: str, from_plain: str) -> Column:
    return F.expr(f"CASE WHEN _plain THEN {from_plain} ELSE {_pattern_field(name)} END").alias(name)


def _records(fields: DataFrame, kept: list[Column]) -> DataFrame:
    """Finish the fields: the default path and the byte count as a number."""
    return fields.select(
        *kept,
        "ip",
        F.expr("CASE WHEN _path = '' THEN '-' ELSE _path END").alias("path"),
        "user_agent",
        "status_code",
        F.expr(f"CASE WHEN ip IS NOT NULL THEN {lf.BYTE_COUNT.format('_bytes')} END").alias(
            "traffic_bytes"
        ),
        "timestamp_str",
    )


def accepted_records(parsed: DataFrame) -> DataFrame:
    """The parsed rows without the rejects.

    A filter would be pushed below the parse and run it a second time; a generator that emits
    nothing for a reject does not move.
    """
    row = F.array(F.struct(*_columns(parsed)))
    return parsed.select(F.inline(F.when(F.col("ip").isNotNull(), row)))


def rejected_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The input rows whose line cannot be parsed, as they came."""
    as_it_came = F.struct(*_columns(lines)).alias("_row")
    parsed = parse_lines(lines.select(F.col(f"`{column}`").alias("_text"), as_it_came), "_text")
    return parsed.select(F.inline(F.when(F.col("ip").isNull(), F.array("_row"))))


def with_buckets(parsed: DataFrame) -> DataFrame:
    """Add the hour, day and month buckets, null where the timestamp has no usable text."""
    cut = parsed.select("*", F.expr(lf.HOUR_BUCKET.format("timestamp_str")).alias("_hour"))
    # separators stand at the same bytes in every bucket, so its beginnings are day and month
    valid = "CASE WHEN is_valid_utf8(_hour) THEN {} END"
    start = "CAST(substring(CAST(_hour AS BINARY), 1, {}) AS STRING)"
    return cut.select(
        *_columns(parsed),
        F.expr(valid.format("_hour")).alias("hour"),
        F.expr(valid.format(start.format(len("YYYY-MM-DD")))).alias("day"),
        F.expr(valid.format(start.format(len("YYYY-MM")))).alias("month"),
    )
