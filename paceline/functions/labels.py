"""Display labels of percentiles, dates and windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paceline.functions.durations import finite


def percent_text(share: Column) -> Column:
    """A missing share reads as zero, one that is no number as a dash."""
    value = finite(F.coalesce(share, F.lit(0.0)))
    return F.when(value.isNotNull(), F.format_string("%.1f%%", value * 100)).otherwise("-")


def percentile_band(percentile: Column) -> Column:
    """Fixed bands of a percentile in [0, 1]."""
    value = finite(percentile)
    return (
        F.when(value >= 0.9, "excellent").when(value >= 0.75, "good").when(value >= 0.25, "average").when(
            value.isNotNull(), "below"
        )
    )


def top_percent(percentile: Column) -> Column:
    """`Top N%`, never better than `Top 1%`."""
    top = F.floor((1 - finite(percentile)) * 100 + 0.5).cast("long")
    return F.concat(F.lit("Top "), F.when(top < 1, 1).otherwise(top).cast("string"), F.lit("%"))


def percent_fill(percentile: Column) -> Column:
    """The percentile on a 0 to 100 scale, kept inside it."""
    value = finite(percentile) * 100
    return F.when(value < 0, 0.0).when(value > 100, 100.0).otherwise(value)


def month_label(moment: Column, with_year: bool = True) -> Column:
    return F.date_format(moment, "MMM ''yy" if with_year else "MMM")


def window_label(minutes: Column) -> Column:
    value = finite(minutes)
    shown = F.regexp_replace(value.cast("string"), r"\.0$", "")
    return F.when(value > 0, F.concat(F.lit("+/- "), shown, F.lit(" min"))).otherwise("the selected +/- time window")
