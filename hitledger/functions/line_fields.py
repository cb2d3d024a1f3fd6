"""Column expressions over the text of one log line and of its fields.

Everything here is a built-in Spark expression, so a parse stays inside one code-generated stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two accepted line shapes, tried in this order. Possessive quantifiers are safe
# because every token's character class excludes the character that ends the token, so there is
# nothing to give back; a hostile line therefore costs linear time. A group that may be left when a
# shape fails must not sit inside a possessive one, or Java keeps its text for the next shape.
# Groups of both: address, timestamp, path (2nd word of the request), status, byte count (only if
# it is a plain number), user agent with its opening quote.
DELIMITED_LINE = (
    r'([^ ]*+) [^\[]*+\[([^\]]*+)\]'
    r'[^"]*+"\s*+(?:[^\s"]++\s++([^\s"]++))?[^"]*+"'
    r'\s*+([^ ]*+) (?:(\+?[0-9]++) |[^ ]*+ )'
    r'[^"]*+"[^"]*+"[^"]*+(?:("[^"]*+)(?:".*+)?+)?+'
)
COMBINED_LINE = (
    r'(\S++)\s++\S++\s++\S++\s++\[([^\]]++)\]'
    r'\s++"\s*+(?:[^\s"]++\s++([^\s"]++))?[^"]*+"'
    r'\s++(\d{3})\s++(?:(\+?[0-9]++)|\S++)'
    r'\s++"[^"]*+"\s++("[^"]*+)".*+'
)

# (?U): \s, \S and \d follow Unicode; (?s): the ignored tail may hold a lone carriage return.
_FLAGS = "(?sU)"

# Month abbreviations in log timestamps, January first.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

FIELD_COUNT = 6


def without_trailing_cr(line: Column) -> Column:
    """Drop every trailing carriage return; untouched lines skip the trim."""
    return F.when(line.endswith("\r"), F.rtrim(line, F.lit("\r"))).otherwise(line)


def fields_of(line: Column, *patterns: str) -> Column:
    """Array of the six fields captured by the first pattern that matches the line.

    All patterns go into one alternation whose match is rewritten to the fields joined by line
    feeds: one regex run per line, where an extract per field would take six. A line itself holds
    no line feed, so a line that matches nothing gives an array of one element. A group that took
    no part in the match is empty.
    """
    template = "\n".join(
        "".join(f"${FIELD_COUNT * i + field}" for i in range(len(patterns)))
        for field in range(1, FIELD_COUNT + 1)
    )
    regex = f"{_FLAGS}^(?:{'|'.join(patterns)})"
    return F.split(F.regexp_replace(line, F.lit(regex), F.lit(template)), "\n", -1)


def second_word(text: Column) -> Column:
    """Second word of a text split at any Unicode white space; empty if there is none."""
    return F.regexp_extract(text, r"(?U)\A\s*+\S++\s++(\S++)", 1)


def second_visible_word(text: Column) -> Column:
    """The same for texts that begin with two words of visible ASCII; empty for others. Cheaper."""
    return F.regexp_extract(text, r"\A *+[!-~]++ ++([!-~]++)(?= |\z)", 1)


def request_path(request: Column) -> Column:
    """Second whitespace-separated word of the request, or ``-``."""
    word = second_word(request)
    return F.when(word == "", "-").otherwise(word)


def number_or_null(token: Column) -> Column:
    """The token itself if it is written as an unsigned integer, else null."""
    return F.when(token.rlike(r"\A\+?[0-9]+\z"), token)


# SQL text with a place for the column: one parsed expression each, where composing them call by
# call would take longer than planning the query.

# Value of an unsigned integer token of up to 64 bits; 0 if it is null, empty or larger. Short tokens
# take the cheap conversion; of the others only those with few enough digits are converted at all,
# because the conversion of a very long one would take quadratic time.
BYTE_TYPE = "DECIMAL(20, 0)"
_DIGITS = "trim(LEADING '+0' FROM {0})"
_LARGE = f"try_cast({_DIGITS} AS {BYTE_TYPE})"
BYTE_COUNT = f"""
    coalesce(
        CASE WHEN octet_length({{0}}) < 19 THEN CAST(try_cast({{0}} AS BIGINT) AS {BYTE_TYPE})
             WHEN octet_length({_DIGITS}) <= 20 AND {_LARGE} <= 18446744073709551615 THEN {_LARGE}
        END,
        CAST(0 AS {BYTE_TYPE}))
"""

# ``YYYY-MM-DD HH:00`` cut out of ``dd/Mon/yyyy:HH...``; null if it has no such shape. Text slices
# only: digits, separators and the zone offset are not checked, so the bucket is the local time
# written in the log. Slices are by byte; the caller drops results that cut a character.
_SLICE = "CAST(substring(CAST({{0}} AS BINARY), {0}, {1}) AS STRING)"
_MONTH_NUMBER = " ".join(f"WHEN '{name}' THEN '{n:02d}'" for n, name in enumerate(MONTHS, 1))
HOUR_BUCKET = f"""
    CASE WHEN octet_length({{0}}) >= 14 THEN
        concat(
            {_SLICE.format(8, 4)}, '-',
            CASE {_SLICE.format(4, 3)} {_MONTH_NUMBER} END, '-',
            {_SLICE.format(1, 2)}, ' ', {_SLICE.format(13, 2)}, ':00')
    END
"""


def parse_bytes(token: Column) -> Column:
    """Byte count of any token: an unsigned 64-bit integer, or 0 for everything else."""
    number = number_or_null(token)
    digits = F.ltrim(number, F.lit("+0"))
    large = F.when(F.octet_length(digits) <= 20, digits.try_cast(BYTE_TYPE))
    value = F.when(F.octet_length(number) < 19, number.try_cast("bigint").cast(BYTE_TYPE)).otherwise(
        F.when(large <= F.lit("18446744073709551615").cast(BYTE_TYPE), large)
    )
    return F.coalesce(value, F.lit(0).cast(BYTE_TYPE))
