"""Lists to choose from: filter values and races."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.errors import InvalidRequest
from paceline.operators.filters import cohort_filter
from paceline.operators.stats import facets

RACE_KEYS = ["event_name", "event_id", "location", "season", "year"]


def filter_menu(results: DataFrame, season=None, division=None, gender=None) -> DataFrame:
    scoped = results.where(cohort_filter(season=season, division=division, gender=gender))
    return facets(scoped, ["season", "year"], ["division", "gender", "location", "age_group"])


def deepdive_menu(results: DataFrame, season: int, division=None, gender=None) -> DataFrame:
    if season is None:
        raise InvalidRequest("season is required")
    scoped = results.where(cohort_filter(season=season, division=division, gender=gender))
    return facets(scoped, [], ["location", "age_group"])


def list_races(results: DataFrame, season=None, gender=None) -> DataFrame:
    """Races with their number of entries, the latest first."""
    scoped = results.where(cohort_filter(season=season, gender=gender))
    return (
        scoped.groupBy(*RACE_KEYS)
        .agg(F.count(F.lit(1)).alias("participant_count"))
        .orderBy(F.desc("season"), F.desc("year"), F.lower("location").asc_nulls_last())
    )


def split_names(splits: DataFrame) -> DataFrame:
    return splits.select("split_name").where("split_name <> ''").distinct().orderBy("split_name")


def divisions_per_event(results: DataFrame) -> DataFrame:
    """The divisions seen at each event and how many they are."""
    pairs = results.select("event_name", "division").where("event_name is not null and division is not null").distinct()
    return pairs.groupBy("event_name").agg(
        F.array_sort(F.collect_list("division")).alias("divisions"), F.count(F.lit(1)).alias("n_divisions")
    )
