"""Select by rank: the value at a given place of a group's sorted order, for a whole table of places.

A range of places in sorted order (a window of times, say) is summarised without visiting its rows: its size is a
difference of places, its ends and quantiles are values at places, its sum a difference of running sums. Each group's
values are numbered once (large groups by a range sort over all tasks, see `ordering.running_totals`); asked places
are then an equi-join on (group, place), so no request is ever paired with the rows of its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.operators.joins import key_join
from paceline.operators.ordering import HOT_ROWS, hot_groups, running_totals

#: Type of running sums: 29 digits before the point and 9 after. A double's shortest decimal form is kept; its
#: binary noise (some 1e-12 at 30,000) is not.
EXACT = "decimal(38,9)"


def ordered_places(values: DataFrame, keys: list[str], value: str, tiebreak: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each non-null value with its place in its group (from 0, by value then `tiebreak`) and the sum before it.

    Sums are decimals (EXACT): a difference of two running sums then equals the sum of the range to the last digit,
    where doubles would lose the digits that the two large sums share.

    Columns: keys, `place`, `value`, `sum_before`, `sum_through` (that value included). Rows with equal value and tiebreak get distinct places in an
    arbitrary order among themselves, which changes no value at any place.
    """
    slim = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("value"), F.col(tiebreak).alias("_order"))
    hot = hot_groups(slim, keys, hot_rows)
    weighted = slim.withColumns({"_one": F.lit(1), "_exact": F.col("value").cast(EXACT)})
    summed = running_totals(weighted, keys, ["value", "_order"], {"_upto": "_one", "_sum": "_exact"}, hot)
    return summed.select(
        *keys, (F.col("_upto") - 1).alias("place"), "value", (F.col("_sum") - F.col("_exact")).alias("sum_before"),
        F.col("_sum").alias("sum_through"),
    )


def values_at(places: DataFrame, asks: DataFrame, keys: list[str]) -> DataFrame:
    """`asks` (keys, `place`, anything else) with the `value`, `sum_before` and `sum_through` found at that place.

    Places are made distinct before the join, so a place asked by very many requests is one key of the shuffle.
    A place outside its group gives nulls.
    """
    wanted = asks.select(*keys, "place").distinct()
    found = key_join(wanted, places, [*keys, "place"])
    return key_join(asks, found, [*keys, "place"], "left")


def interpolated(position: Column, low: Column, high: Column) -> Column:
    """A quantile between the values at the floor and ceiling of its position, as Spark's `percentile` does it."""
    between = (F.ceil(position) - position) * low + (position - F.floor(position)) * high
    return F.when(low == high, low).otherwise(between)
