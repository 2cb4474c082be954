"""Summaries, histograms and value lists per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.operators.joins import key_join
from paceline.operators.ordering import HOT_ROWS, SHORT_LIST, local_table, quantiles_in_group
from paceline.schema import AGGREGATE_SEGMENTS, DEFAULT_BINS, RUN_FLOOR_MIN, SEGMENTS

SEVEN_NUMBERS = {"median": 0.5, "p10": 0.1, "p90": 0.9}
FIVE_NUMBERS = {"median": 0.5}


def describe(df: DataFrame, keys: list[str], value: str, points=None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Count, min, max, mean, median, p10, p90 per group (or other quantiles)."""
    return quantiles_in_group(df, keys, value, SEVEN_NUMBERS if points is None else points, hot_rows)


def describe_columns(df: DataFrame, columns: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Count, mean, standard deviation, extremes and quartiles of each column, all in one table."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).try_cast("double").alias("value")) for c in columns])
    long = df.select(F.inline(cells)).where(F.col("value").isNotNull() & ~F.isnan("value"))
    spread = long.groupBy("column").agg(F.stddev_samp("value").alias("sd"))
    numbers = quantiles_in_group(long, ["column"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, hot_rows)
    return key_join(numbers, spread, ["column"]).select("column", "count", "mean", "sd", "min", "q1", "median", "q3", "max")


def long_segments(df: DataFrame, ids: list[str], columns: list[str], floors: bool = False) -> DataFrame:
    """One row per segment that has a time. Columns the table lacks are left out."""
    there = [c for c in columns if c in df.columns]
    slim = df.select(*ids, *[F.col(c).try_cast("double").alias(c) for c in there])
    long = slim.unpivot(ids, there, "segment", "minutes").where(F.col("minutes").isNotNull() & ~F.isnan("minutes"))
    if floors:
        long = long.where(~F.col("segment").startswith("run") | (F.col("minutes") >= RUN_FLOOR_MIN))
    return long


def segment_table(df: DataFrame) -> DataFrame:
    """The fixed list of segments: column, label, group and position."""
    names = ("segment", "label", "segment_group", "position")
    rows = [dict(zip(names, row)) for row in SEGMENTS + AGGREGATE_SEGMENTS]
    return local_table(df, rows, "segment string, label string, segment_group string, position int")


def with_segment_labels(df: DataFrame) -> DataFrame:
    return df.join(F.broadcast(segment_table(df)), "segment")


def bounded(df: DataFrame) -> tuple[DataFrame, bool]:
    """Bring a per-group table to the driver if it is short, so that it can be broadcast.

    Returns the table and whether it is short; a long one stays distributed.
    """
    rows = df.limit(SHORT_LIST + 1).toArrow()
    if rows.num_rows > SHORT_LIST:
        return df, False
    return local_table(df, rows, df.schema), True


def bin_index(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin; the maximum falls into the last one, a single value into the first."""
    inside = F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1))
    return F.when(high > low, inside).otherwise(F.lit(0)).cast("int")


def histogram(
    df: DataFrame,
    keys: list[str],
    value: str,
    bins: int = DEFAULT_BINS,
    shared: list[str] | None = None,
    label: str | None = None,
    described: DataFrame | None = None,
    counted: Column | None = None,
    at_least: int = 0,
) -> DataFrame:
    """Equal-width histogram per group, empty bins included: `bin, start, end, count`.

    `shared` names the keys that share their edges; by default every group has its own.
    `label` names a text column whose distinct values are listed per bin as `labels`.
    `described` is the same groups' table from `describe`, whose ends then need no pass of their own.
    `counted` says which values fall into bins, where not all that set the edges do; groups with fewer than
    `at_least` of these are left out.
    """
    clean = df.where(F.col(value).isNotNull())
    if described is not None:
        groups, short = bounded(described.select(*keys, F.col("min").alias("_low"), F.col("max").alias("_high")))
    else:
        inside = F.lit(True) if counted is None else counted
        ends = (F.min(value).alias("_low"), F.max(value).alias("_high"), F.count_if(inside).alias("_counted"))
        groups, short = bounded(clean.groupBy(*keys).agg(*ends))
    if shared is not None:
        ends = groups.groupBy(*shared).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
        groups = key_join(groups.drop("_low", "_high"), ends, shared, broadcast=short)
    if counted is not None:
        clean = clean.where(counted)
        groups = groups.where(F.col("_counted") >= at_least)
    placed = key_join(clean, groups, keys, broadcast=short).withColumn(
        "bin", bin_index(F.col(value), F.col("_low"), F.col("_high"), bins)
    )
    counts = placed.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    if label is not None:
        counts = key_join(counts, _labels_per_bin(placed, keys, label), [*keys, "bin"], "left")
    width = (F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(F.lit(1.0))) / bins
    frame = groups.select(
        *keys, "_low", width.alias("_width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    filled = key_join(frame, counts, [*keys, "bin"], "left")
    extra = [] if label is None else [F.coalesce("labels", F.array().cast("array<string>")).alias("labels")]
    return filled.select(
        *keys,
        "bin",
        (F.col("_low") + F.col("_width") * F.col("bin")).alias("start"),
        (F.col("_low") + F.col("_width") * (F.col("bin") + 1)).alias("end"),
        F.coalesce("count", F.lit(0)).alias("count"),
        *extra,
    )


def _labels_per_bin(placed, keys, label):
    named = placed.select(*keys, "bin", F.trim(label).alias("_label")).where("_label <> ''").distinct()
    ordered = F.array_sort(F.collect_list(F.struct(F.lower("_label").alias("fold"), F.col("_label").alias("text"))))
    return named.groupBy(*keys, "bin").agg(ordered["text"].alias("labels"))


def marker_standing(df: DataFrame, keys: list[str], value: str, markers: DataFrame) -> DataFrame:
    """Percentile of one marker value per group (`marker`): 1 is fastest, not clamped.

    `markers` has one row per group and is as small as the number of requests.
    """
    counted = (
        key_join(df.where(F.col(value).isNotNull()), markers, keys)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(value) < F.col("marker")).alias("_below"))
    )
    share = F.when(F.col("marker").isNull(), None).when(F.col("_n") == 1, 1.0)
    return key_join(markers, counted, keys, "left").select(
        *keys, "marker", share.when(F.col("_n") > 1, 1 - F.col("_below") / (F.col("_n") - 1)).alias("marker_percentile")
    )


def distinct_folded(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Distinct spellings up to case; of several spellings the first in order stays."""
    keys = keys or []
    text = df.select(*keys, F.trim(column).alias(column)).where(F.col(column) != "")
    folded = text.groupBy(*keys, F.lower(column).alias("_fold")).agg(F.min(column).alias(column))
    return folded.orderBy(*keys, "_fold").drop("_fold")


def distinct_numbers(df: DataFrame, column: str) -> DataFrame:
    """Distinct whole numbers of a column that may hold text; what is no number is dropped."""
    number = F.col(column).try_cast("double").try_cast("int")
    return df.select(number.alias(column)).where(F.col(column).isNotNull()).distinct().orderBy(column)


def facets(df: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """All distinct values of several columns in one pass: `facet, value, position`.

    Numbers are listed from the latest down, texts without regard to case; blanks are dropped.
    """
    cells = [
        F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"), F.col(c).cast("long").alias("number"))
        for c in numbers
        if c in df.columns
    ] + [
        F.struct(F.lit(c).alias("facet"), F.trim(c).alias("value"), F.lit(None).cast("long").alias("number"))
        for c in texts
        if c in df.columns
    ]
    values = df.select(F.inline(F.array(*cells))).where(F.col("value") != "").distinct()
    place = Window.partitionBy("facet").orderBy(F.desc("number"), F.lower("value"), "value")
    return values.select("facet", "value", F.row_number().over(place).alias("position"))


def first_n_in_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The n first rows of each group; Spark keeps n per group and task before it shuffles."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= n).drop("_place")
