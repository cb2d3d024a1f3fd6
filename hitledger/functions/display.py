"""Text forms of counters for reports. Rounding is exact, in integers, half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units in steps of 1024; the last one has no upper end.
UNITS = ("B", "KB", "MB", "GB", "TB")


def _two_decimals(scaled: Column, shift: int) -> Column:
    """Text of ``scaled / 2**shift`` with two decimals; a BIGINT with fewer than 57 bits of
    fraction, so that 100 times the fraction still fits."""
    rest = scaled.bitwiseAND(F.lit((1 << shift) - 1))
    return _with_two_decimals(F.shiftright(scaled, shift), rest, shift)


def _with_two_decimals(units: Column, rest: Column, shift: int) -> Column:
    """Text of ``units + rest / 2**shift``."""
    mask = F.lit((1 << shift) - 1)
    rest = rest * 100
    hundredths = F.shiftright(rest, shift)
    left_over = rest.bitwiseAND(mask)
    half = 1 << (shift - 1)
    odd = hundredths.bitwiseAND(F.lit(1)) == 1
    rounded = hundredths + F.when((left_over > half) | ((left_over == half) & odd), 1).otherwise(0)
    whole = units + F.when(rounded == 100, 1).otherwise(0)
    decimals = F.when(rounded == 100, 0).otherwise(rounded)
    return F.concat(
        whole.cast("string"), F.lit("."), F.lpad(decimals.cast("string"), 2, "0")
    )


def human_bytes(value: Column) -> Column:
    """``532 B``, ``1.12 KB``, ``3.00 MB``: whole bytes below 1024, else two decimals."""
    value = value.cast("decimal(38, 0)")
    text = F.when(value < 1024, F.concat(value.cast("string"), F.lit(f" {UNITS[0]}")))
    for power, unit in enumerate(UNITS[1:], start=1):
        # the remainder fits a BIGINT, and what it leaves divides without a rest
        one = F.lit(1 << (10 * power)).cast("decimal(13, 0)")
        rest = (value % one).cast("bigint")
        whole = ((value - rest) / one).cast("decimal(38, 0)")
        in_unit = F.concat(_with_two_decimals(whole, rest, 10 * power), F.lit(f" {unit}"))
        if unit == UNITS[-1]:
            return text.otherwise(in_unit)
        text = text.when(value < F.lit(1 << (10 * power + 10)), in_unit)


def percent_text(value: Column) -> Column:
    """``12.50%`` for a percentage between 0 and 100.

    The double is scaled by a power of two, which is exact, so the rounding sees its true value
    and not its shortest decimal form. Small values take the larger scale to keep all their bits;
    what that one cuts off lies below 2^-60, where the text is 0.00 anyway.
    """

    def scaled(shift: int) -> Column:
        return _two_decimals((value * float(1 << shift)).cast("bigint"), shift)

    return F.concat(F.when(value < 0.0625, scaled(60)).otherwise(scaled(56)), F.lit("%"))


def truncate_label(text: Column, length: int = 14) -> Column:
    """Texts longer than ``length`` characters keep one character less than that and get a ``~``."""
    cut = F.concat(F.substring(text, 1, length - 1), F.lit("~"))
    return F.when(F.char_length(text) > length, cut).otherwise(text)


def trend_label(bucket: Column, granularity: str) -> Column:
    """Bucket without its year, for hours also without the minutes; months stay whole."""
    if granularity == "month":
        return bucket
    end = {"hour": 13, "day": 10}[granularity]
    cut = F.substring(bucket.cast("binary"), 6, end - 5).cast("string")
    return F.when((F.octet_length(bucket) >= end) & F.is_valid_utf8(cut), cut).otherwise(bucket)
