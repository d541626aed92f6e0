"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sunmeter.schema import HISTOGRAM_OFFSET, POWER_STORED, WINDOW_HOURS

SECOND_PATTERN = "yyyy-MM-dd HH:mm:ss"


def second_text(time: Column) -> Column:
    """A timestamp as text, cut to whole seconds."""
    return F.date_format(time, SECOND_PATTERN)


def wire_time(time: Column) -> Column:
    """A timestamp as producers write it: six fraction digits, or none at a full second."""
    text = time.cast("string")  # the cast drops trailing zeros of the fraction
    return F.when(F.instr(text, ".") == 0, text).otherwise(F.rpad(text, 26, "0"))


def stored_power(power: Column) -> Column:
    """The exact decimal the raw table holds; the cast rounds half up.

    NULL where the type cannot hold the value, which ``split_valid`` rejects.
    """
    return power.try_cast(POWER_STORED)


def window_hours(start: Column, end: Column) -> Column:
    """A window's length in hours; 30 s has the fixed ten-digit figure."""
    seconds = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6
    return F.when(seconds == 30, F.lit(WINDOW_HOURS)).otherwise(seconds / 3600)


def z_value(*places: Column, bits: int) -> Column:
    """The bits of all places in turn, the highest first: what is near in z is near in each.

    Places are whole numbers below 2 ** ``bits``.
    """
    z = F.lit(0).cast("long")
    for bit in reversed(range(bits)):
        for place in places:
            z = z * 2 + F.shiftright(place, bit) % 2
    return z


def bucket_start(value: Column, width: float, offset: float = HISTOGRAM_OFFSET) -> Column:
    """Lower edge of the histogram bucket ``value`` falls in."""
    return F.floor((value - offset) / width) * width + offset


def expected_power(
    time: Column,
    peak: Column | float = 400.0,
    start_hour: Column | int = 12,
    start_minute: Column | int = 0,
    hours: float = 1,
    minutes: float = 0,
    exponent: float = 30,
) -> Column:
    """Modelled output at ``time`` of a panel that starts at the given clock time.

    Peak and start may be columns, as each panel has its own.
    The curve is peak * sech(x)^exponent; x runs from -hours/2 at the start to
    +hours/2 at ``hours`` hours later when ``minutes`` is 0.  Far from the peak
    the power of cosh overflows to infinity and the output is 0, not an error.
    """
    half_span = (hours * 3600 + minutes * 60) / 2
    if half_span == 0:
        raise ValueError("the curve needs a non-zero span")
    start = start_hour * 3600 + start_minute * 60
    slope = hours * 0.5 / half_span
    second = F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    x = (second - start) * F.lit(slope) - hours * 0.5
    peak = peak if isinstance(peak, Column) else F.lit(float(peak))
    return peak / F.pow(F.cosh(x), F.lit(float(exponent)))
