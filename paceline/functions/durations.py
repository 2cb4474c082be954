"""Durations as text: reading, classifying and writing them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted text forms.
CLOCK_TEXT = r"^(?:(\d+):)?(\d+):(\d+(?:\.\d+)?)$"
HMS_TEXT = r"^[0-9]+:[0-9]{2}:[0-9]{2}$"
MS_TEXT = r"^[0-9]+:[0-9]{2}$"
NUMBER_TEXT = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
# End of fixed values.


def _number(text: Column) -> Column:
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def clock_minutes(text: Column) -> Column:
    """Minutes of `H:MM:SS` or `MM:SS` text; anything else is null."""
    clean = F.trim(text.cast("string"))
    hours, minutes, seconds = (F.regexp_extract(clean, CLOCK_TEXT, i).try_cast("double") for i in (1, 2, 3))
    return F.when(clean.rlike(CLOCK_TEXT), F.coalesce(hours, F.lit(0.0)) * 60 + minutes + seconds / 60)


def loose_minutes(text: Column) -> Column:
    """Like `clock_minutes`, but a plain number counts as minutes and parts may carry blanks or signs."""
    clean = F.trim(text.cast("string"))
    parts = F.transform(F.split(clean, ":"), lambda part: _number(F.trim(part)))
    first, second, third = (F.get(parts, F.lit(i)) for i in range(3))
    return (
        F.when(F.size(parts) == 1, first)
        .when(F.size(parts) == 2, first + second / 60)
        .when(F.size(parts) == 3, first * 60 + second + third / 60)
    )


def clock_format(text: Column) -> Column:
    """Which text form a value has: `hms`, `ms` or `other`; null stays null."""
    clean = F.trim(text.cast("string"))
    return (
        F.when(clean.isNull(), None)
        .when(clean.rlike(HMS_TEXT), "hms")
        .when(clean.rlike(MS_TEXT), "ms")
        .otherwise("other")
    )


def finite(value: Column) -> Column:
    """The value as a double, null if it is not a finite number."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def _clock(seconds: Column) -> Column:
    hours, rest = F.floor(seconds / 3600), seconds % 3600
    minutes, left = F.floor(rest / 60), rest % 60
    long, short = F.format_string("%d:%02d:%02d", hours, minutes, left), F.format_string("%d:%02d", minutes, left)
    return F.when(hours > 0, long).when(hours == 0, short)


def _rounded_seconds(minutes: Column) -> Column:
    return F.floor(minutes * 60 + 0.5).cast("long")


def clock_text(minutes: Column) -> Column:
    """`H:MM:SS` or `M:SS`; below zero shows zero, a missing value shows a dash."""
    seconds = _rounded_seconds(finite(minutes))
    return F.coalesce(_clock(F.when(seconds < 0, 0).otherwise(seconds)), F.lit("-"))


def length_text(minutes: Column) -> Column:
    """Like `clock_text` for the size of a difference: the sign is dropped."""
    return F.coalesce(_clock(_rounded_seconds(F.abs(finite(minutes)))), F.lit("-"))


def delta_text(minutes: Column) -> Column:
    """A signed difference."""
    value = finite(minutes)
    sign = F.when(value > 0, "+").when(value < 0, "-").otherwise("")
    return F.coalesce(F.concat(sign, length_text(value)), F.lit("-"))
