"""One result against the places a cohort raced at."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.errors import InvalidRequest, NotFound
from paceline.operators.cohorts import pick_result
from paceline.operators.filters import believable, cohort_filter, override
from paceline.operators.joins import key_join
from paceline.operators.ordering import HOT_ROWS, local_table
from paceline.operators.stats import FIVE_NUMBERS, bounded, describe, first_n_in_group, histogram, marker_standing
from paceline.schema import DEFAULT_BINS, floor_of, time_column

# What the groups of a deep dive are.
TOP_SHARE, BOTTOM_SHARE, PODIUM = 0.05, 0.9, 3
CLOSE_ABSOLUTE, CLOSE_RELATIVE = 1e-8, 1e-5
# End of fixed values.
THRESHOLDS = {"median": 0.5, "p05": TOP_SHARE, "p90": BOTTOM_SHARE}


def location_stats(cohort: DataFrame, keys: list[str], value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per location (missing ones count as one): times, quantiles, third best, and the seasons and years seen."""
    points = {"p05": TOP_SHARE, "p50": 0.5, "p90": BOTTOM_SHARE}
    stats = describe(cohort, keys, value, points, hot_rows).withColumnRenamed("min", "fastest").drop("max")
    podium = first_n_in_group(cohort, keys, [value], PODIUM).groupBy(*keys).agg(F.max(value).alias("podium"))
    seen = cohort.groupBy(*keys).agg(
        F.array_sort(F.collect_set("season")).alias("seasons"), F.array_sort(F.collect_set("year")).alias("years")
    )
    return key_join(key_join(stats, podium, keys), seen, keys)


def tagged_groups(cohort: DataFrame, scope: list[str], value: str, tiebreak: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rows of each scope repeated per group they belong to: all, top, podium, bottom (column `grp`)."""
    cut, short = bounded(describe(cohort, scope, value, THRESHOLDS, hot_rows).select(*scope, "p05", "p90"))
    inside = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(F.col(value) <= F.col("p05"), "top"),
            F.when(F.col(value) >= F.col("p90"), "bottom"),
        )
    )
    tagged = key_join(cohort, cut, scope, broadcast=short).withColumn("grp", F.explode(inside)).drop("p05", "p90")
    podium = first_n_in_group(cohort, scope, [value, tiebreak], PODIUM).withColumn("grp", F.lit("podium"))
    return tagged.unionByName(podium)


class DeepDive:
    """One result against its cohort of a season, place by place and group by group.

    Each part is planned when it is asked for.
    """

    def __init__(
        self,
        results: DataFrame,
        result_id,
        season: int,
        metric: str = "total_time_min",
        n_bins: int = DEFAULT_BINS,
        division=None,
        gender=None,
        age_group=None,
        location=None,
    ):
        if season is None:
            raise InvalidRequest("season is required")
        column = self.column = time_column(metric)
        self.race = pick_result(results, result_id)
        if self.race[column] is None:
            raise InvalidRequest(f"the result has no {column}")
        self.athlete_value, self.n_bins = float(self.race[column]), n_bins
        self.filters = {
            "season": int(season),
            "division": override(division, self.race["division"]),
            "gender": override(gender, self.race["gender"]),
            "age_group": override(age_group, self.race["age_group"]),
            "location": override(location, None),
        }
        self.cohort = results.where(cohort_filter(**self.filters) & believable(column)).select(
            F.lit(0).alias("_all"), "result_id", "location", "season", "year", F.col(column).alias("minutes")
        )
        if self.cohort.isEmpty():
            raise NotFound("no results match the filters")

    @cached_property
    def tagged(self) -> DataFrame:
        return tagged_groups(self.cohort, ["_all"], "minutes", "result_id")

    @cached_property
    def summary(self) -> DataFrame:
        return describe(self.cohort, ["_all"], "minutes", THRESHOLDS).drop("_all")

    @cached_property
    def locations(self) -> DataFrame:
        return location_stats(self.cohort, ["location"], "minutes")

    @cached_property
    def groups(self) -> DataFrame:
        """Five numbers of each group. There are four groups, so the table is kept at hand."""
        return bounded(describe(self.tagged, ["grp"], "minutes", FIVE_NUMBERS))[0]

    @cached_property
    def bins(self) -> DataFrame:
        return histogram(self.tagged, ["grp"], "minutes", self.n_bins, label="location")

    @cached_property
    def markers(self) -> DataFrame:
        """The athlete's value in the groups whose range holds it; on the podium only if it is one of its times.

        A value below what is believable for the metric stands in no group.
        """
        mine = self.athlete_value
        close = F.abs(F.col("minutes") - mine) <= CLOSE_ABSOLUTE + CLOSE_RELATIVE * abs(mine)
        inside = {r["grp"]: r["grp"] == "all" or r["min"] <= mine <= r["max"] for r in self.groups.collect()}
        inside["podium"] = not self.tagged.where((F.col("grp") == "podium") & close).isEmpty()
        floor = floor_of(self.column)
        counts = floor is None or mine >= floor
        marks = [{"grp": name, "marker": mine if shown and counts else None} for name, shown in inside.items()]
        table = local_table(self.cohort, marks, "grp string, marker double")
        return marker_standing(self.tagged, ["grp"], "minutes", table)


def location_deltas(locations: DataFrame, athlete_value: float, stat: str = "mean") -> DataFrame:
    """The athlete against one number of each place, the largest lead first."""
    mine = F.lit(float(athlete_value))
    return locations.withColumns(
        {"stat_value": F.col(stat), "delta": mine - F.col(stat), "delta_fastest": mine - F.col("fastest")}
    ).orderBy(F.asc_nulls_last("delta"), F.asc_nulls_last("location"))
