"""Row conditions. Each returns a Column, so that Catalyst can push it into the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.errors import InvalidRequest
from paceline.functions.durations import finite
from paceline.operators.joins import all_of
from paceline.schema import GENDER_ALIASES, floor_of


def has(df: DataFrame, *columns: str) -> bool:
    """Whether the table carries the columns: older files lack some."""
    return set(columns) <= set(df.columns)


def given(value) -> str | None:
    """Filter text as the user meant it: trimmed, blank means no filter."""
    text = "" if value is None else str(value).strip()
    return text or None


def text_is(column: str, value: str) -> Column:
    return F.lower(F.col(column)) == str(value).strip().lower()


def gender_is(value: str, column: str = "gender") -> Column:
    """Short and long gender labels mean the same."""
    wanted = str(value).strip().lower()
    return F.lower(F.col(column)).isin(GENDER_ALIASES.get(wanted, [wanted]))


def name_contains(value: str, column: str = "name") -> Column:
    return F.lower(F.col(column)).contains(str(value).strip().lower())


def open_interval(column: str, bound) -> Column:
    """A number keeps smaller values; a pair keeps values strictly between, None leaves a side open."""
    if isinstance(bound, (tuple, list)):
        if len(bound) != 2:
            raise InvalidRequest("an interval needs exactly two bounds")
        low, high = bound
    else:
        low, high = None, bound
    parts = []
    if low is not None:
        parts.append(F.col(column) > float(low))
    if high is not None:
        parts.append(F.col(column) < float(high))
    return all_of(parts)


def closed_bounds(column: str, low=None, high=None) -> Column:
    if low is not None and high is not None and low > high:
        raise InvalidRequest("the lower bound must not exceed the upper bound")
    parts = []
    if low is not None:
        parts.append(F.col(column) >= float(low))
    if high is not None:
        parts.append(F.col(column) <= float(high))
    return all_of(parts)


def believable(column: str, name: str | None = None) -> Column:
    """Present, and not below the floor of the metric."""
    floor = floor_of(name or column)
    there = F.col(column).isNotNull()
    return there if floor is None else there & (F.col(column) >= floor)


def positive(column: Column) -> Column:
    """The value as a finite number above zero, else null."""
    number = finite(column)
    return F.when(number > 0, number)


def cohort_filter(
    *, season=None, year=None, location=None, division=None, gender=None, age_group=None
) -> Column:
    """Conjunction of the usual filters; what is not given does not filter."""
    parts = []
    if season is not None:
        parts.append(F.col("season") == int(season))
    if year is not None:
        parts.append(F.col("year") == int(year))
    for column, value in (("location", location), ("division", division), ("age_group", age_group)):
        if given(value):
            parts.append(text_is(column, value))
    if given(gender):
        parts.append(gender_is(gender))
    return all_of(parts)


def override(value, default) -> str | None:
    """A filter the user set, else the value of the row it starts from."""
    return given(value) or given(default)
