"""Joins on cohort keys, where a missing key is a value of its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def key_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", broadcast: bool = False) -> DataFrame:
    """Equi-join in which null equals null; the keys of the left side are kept."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    if broadcast:
        renamed = F.broadcast(renamed)
    condition = all_of([F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_right_{k}" for k in keys])


def key_condition(keys: dict[str, object]) -> Column:
    """The same equality against known values, which the scan can use."""
    return all_of([F.col(name).eqNullSafe(F.lit(value)) for name, value in keys.items()])
