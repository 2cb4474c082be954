"""Checks a warehouse must pass before it is used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions.durations import clock_format, clock_minutes
from paceline.schema import REQUIRED_COLUMNS, SUPPORTED_SCHEMA_VERSION, UNIQUE_KEYS


def check_table(df: DataFrame, required: list[str], unique: list[str]) -> DataFrame:
    """One row per rule: `rule, violations`. Absent columns violate with every row."""
    rules = [
        (f"{c} not null", F.count_if(F.col(c).isNull()) if c in df.columns else F.count(F.lit(1))) for c in required
    ]
    counted = df.agg(*[rule.alias(f"r{i}") for i, (_, rule) in enumerate(rules)]).select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations")) for i, (n, _) in enumerate(rules)]))
    )
    if not set(unique) <= set(df.columns):
        return counted
    # Rows beyond the first of their key; keys are combined before the shuffle.
    extra = df.groupBy(*unique).agg((F.count(F.lit(1)) - 1).alias("_extra"))
    name = f"{', '.join(unique)} unique"
    return counted.unionByName(
        extra.agg(F.coalesce(F.sum("_extra"), F.lit(0)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
    )


def check_warehouse_table(df: DataFrame, name: str) -> DataFrame:
    return check_table(df, REQUIRED_COLUMNS[name], UNIQUE_KEYS[name])


def check_version(build_info: DataFrame) -> DataFrame:
    """The version rule of the one-row build table."""
    newest = F.max("schema_version")
    return build_info.agg((newest.isNull() | (newest > SUPPORTED_SCHEMA_VERSION)).cast("long").alias("violations")).select(
        F.lit(f"schema_version at most {SUPPORTED_SCHEMA_VERSION}").alias("rule"), "violations"
    )


def roster_gate(results: DataFrame, max_rows_per_name: float, keys=("season", "location", "year", "division")) -> DataFrame:
    """Groups with many rows per distinct name: a sign of a roster that was read twice."""
    names = results.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("_n"))
    rosters = names.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.count("name").alias("names"))
    ratio = F.col("rows") / F.nullif(F.col("names"), F.lit(0))
    return rosters.withColumn("rows_per_name", ratio).where(F.col("rows_per_name") > max_rows_per_name)


def duration_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column: how many values parse, how many do not, and how many have each form."""
    there = [c for c in columns if c in df.columns]
    long = df.select(*[F.col(c).cast("string") for c in there]).unpivot([], there, "column", "raw").where("raw is not null")
    form = clock_format(F.col("raw"))
    return long.groupBy("column").agg(
        F.count_if(clock_minutes(F.col("raw")).isNotNull()).alias("parsed"),
        F.count_if(clock_minutes(F.col("raw")).isNull()).alias("rejected"),
        *[F.count_if(form == kind).alias(f"form_{kind}") for kind in ("hms", "ms", "other")],
    )
