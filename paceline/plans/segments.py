"""Segment statistics: distribution of one metric, planner, race summary, averages of a slice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.errors import InvalidRequest, NotFound
from paceline.operators.filters import believable, closed_bounds, cohort_filter, given
from paceline.operators.joins import key_join
from paceline.operators.ordering import HOT_ROWS, quantiles_in_group
from paceline.operators.stats import bounded, describe, histogram, long_segments, with_segment_labels
from paceline.schema import (
    AGGREGATE_SEGMENTS,
    DEFAULT_BINS,
    SEGMENTS,
    SMALL_SAMPLE,
    distribution_column,
)

SEGMENT_COLUMNS = [column for column, *_ in SEGMENTS]
SUMMARY_COLUMNS = SEGMENT_COLUMNS + [column for column, *_ in AGGREGATE_SEGMENTS]


@dataclass
class Distribution:
    season: int | None
    column: str
    stats: DataFrame
    bins: DataFrame


def hide_tails(stats: DataFrame) -> DataFrame:
    """Take the outer quantiles off small samples and say so."""
    small = F.col("count") < SMALL_SAMPLE
    note = F.format_string("only %d results: outer percentiles are left out", F.col("count"))
    return stats.withColumns(
        {
            "p10": F.when(~small, F.col("p10")),
            "p90": F.when(~small, F.col("p90")),
            "small_sample": small,
            "note": F.when(small, note),
        }
    )


def distribution(
    results: DataFrame,
    gender: str,
    season: int | None = None,
    division: str | None = None,
    age_group: str | None = None,
    location: str | None = None,
    metric: str = "overall",
    bins: int = DEFAULT_BINS,
) -> Distribution:
    """Distribution of one metric. Defaults: division open, latest season the cohort has."""
    column = distribution_column(metric)
    cohort = results.where(
        cohort_filter(division=given(division) or "open", gender=gender, age_group=age_group, location=location)
    )
    if season is None:
        # One number, so that the season becomes a partition filter of the real query.
        season = cohort.agg(F.max("season")).first()[0]
    if season is not None:
        cohort = cohort.where(F.col("season") == int(season))
    values = cohort.where(believable(column)).select(F.lit(column).alias("segment"), F.col(column).alias("minutes"))
    # One row, kept at hand: the histogram takes its ends from it.
    stats, _ = bounded(describe(values, ["segment"], "minutes"))
    return Distribution(season, column, hide_tails(stats), histogram(values, ["segment"], "minutes", bins, described=stats))


@dataclass
class SegmentReport:
    count: DataFrame
    stats: DataFrame
    bins: DataFrame | None = None
    groups: DataFrame | None = None
    threshold: float | None = None
    total_count: int | None = None


def planner(
    results: DataFrame,
    season=None,
    location=None,
    year=None,
    division=None,
    gender=None,
    min_total_time=None,
    max_total_time=None,
    bins: int = DEFAULT_BINS,
) -> SegmentReport:
    """Statistics and histogram of every segment under the filters, all segments in one job."""
    wanted = cohort_filter(season=season, location=location, year=year, division=division, gender=gender)
    cohort = results.where(wanted & closed_bounds("total_time_min", min_total_time, max_total_time))
    long = long_segments(cohort, [], SEGMENT_COLUMNS, floors=True)
    # One row per segment, kept at hand: the histogram takes its ends from it.
    stats, _ = bounded(describe(long, ["segment"], "minutes"))
    return SegmentReport(
        count=cohort.agg(F.count(F.lit(1)).alias("count")),
        stats=with_segment_labels(stats).orderBy("position"),
        bins=with_segment_labels(histogram(long, ["segment"], "minutes", bins, described=stats)).orderBy("position", "bin"),
    )


def fastest_share(cohort: DataFrame, keys: list[str], percent: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows at or under the given percentile of the total time of their group, with the threshold."""
    if not 0 < percent < 100:
        raise InvalidRequest("the percentile must lie strictly between 0 and 100")
    cut = quantiles_in_group(cohort, keys, "total_time_min", {"threshold": percent / 100}, hot_rows)
    table, short = bounded(cut.select(*keys, "threshold"))
    return key_join(cohort, table, keys, broadcast=short).where(F.col("total_time_min") <= F.col("threshold"))


def race_summary(
    results: DataFrame, season: int, location: str, gender=None, division=None, age_group=None, top_percentile=None
) -> SegmentReport:
    """Seven numbers for every segment of one race; optionally of its fastest share only.

    `count` is what the numbers rest on, `total_count` the whole race under the filters.
    """
    cohort = _one_race(results, season, location, gender, division, age_group)
    total, timed = cohort.agg(F.count(F.lit(1)), F.count("total_time_min")).first()
    threshold = None
    if top_percentile is not None:
        share = fastest_share(cohort.withColumn("_all", F.lit(0)), ["_all"], top_percentile)
        if not timed:
            raise NotFound(f"no result of season={season}, location={location!r} has a total time")
        cohort = share
        threshold = cohort.agg(F.max("threshold")).first()[0]
    stats = describe(long_segments(cohort, [], SUMMARY_COLUMNS), ["segment"], "minutes")
    return SegmentReport(
        count=cohort.agg(F.count(F.lit(1)).alias("count")),
        stats=with_segment_labels(stats).orderBy("position"),
        threshold=threshold,
        total_count=total,
    )


def _one_race(results, season, location, gender, division, age_group):
    wanted = cohort_filter(season=season, location=location, gender=gender, division=division, age_group=age_group)
    cohort = results.where(wanted)
    if cohort.isEmpty():
        raise NotFound(f"no results for season={season}, location={location!r}")
    return cohort


def group_averages(stats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean of the segment means of runs and of stations."""
    keys = keys or []
    parts = stats.where(F.col("segment_group").isin("runs", "stations"))
    return parts.groupBy(*keys, "segment_group").agg(F.avg("mean").alias("avg_time_min"))


def segment_averages(
    results: DataFrame, season: int, location: str, gender=None, division=None, age_group=None, top_n=None, bottom_n=None
) -> SegmentReport:
    """Segment statistics of the fastest or slowest n of a race, or of all."""
    if top_n is not None and bottom_n is not None:
        raise InvalidRequest("top_n and bottom_n exclude each other")
    cohort = _one_race(
        results.where(F.col("total_time_min").isNotNull()), season, location, gender, division, age_group
    )
    if top_n is not None:
        cohort = cohort.orderBy("total_time_min", "result_id").limit(int(top_n))
    elif bottom_n is not None:
        cohort = cohort.orderBy(F.desc("total_time_min"), F.desc("result_id")).limit(int(bottom_n))
    stats = with_segment_labels(describe(long_segments(cohort, [], SUMMARY_COLUMNS), ["segment"], "minutes"))
    return SegmentReport(
        count=cohort.agg(F.count(F.lit(1)).alias("count")),
        stats=stats.orderBy("position"),
        groups=group_averages(stats),
    )
