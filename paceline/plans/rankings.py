"""Rankings of a cohort and where a time would place in it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.errors import InvalidRequest
from paceline.operators.filters import cohort_filter, gender_is, given, name_contains, text_is
from paceline.operators.ordering import HOT_ROWS, count_below, count_below_few, hot_groups, local_table, running_total
from paceline.operators.stats import facets

SHOWN = [
    "result_id", "name", "event_name", "event_id", "location", "season", "year",
    "division", "gender", "age_group", "total_time_min",
]


@dataclass
class Rankings:
    """`rows` are the placed results, `locations` counts and best times, `lookup` the placing of a target."""

    rows: DataFrame
    locations: DataFrame
    count: DataFrame
    lookup: DataFrame | None


def ranking_cohort(results: DataFrame, season: int, division: str, gender: str, age_group: str | None = None) -> DataFrame:
    for name, value in (("division", division), ("gender", gender)):
        if not given(value):
            raise InvalidRequest(f"{name} is required for rankings")
    wanted = cohort_filter(season=season, division=division, gender=gender, age_group=age_group)
    return results.where(wanted & F.col("total_time_min").isNotNull())


def placements(cohort: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every row with its place in the whole cohort by time, then id."""
    numbered = cohort.withColumns({"_all": F.lit(0), "_one": F.lit(1)})
    hot = hot_groups(numbered, ["_all"], hot_rows)
    placed = running_total(numbered, ["_all"], ["total_time_min", "result_id"], "_one", "placement", hot)
    return placed.drop("_all", "_one", "placement_all")


def top_rows(cohort: DataFrame, limit: int) -> DataFrame:
    """The first rows with their places: only `limit` rows ever meet in one task."""
    first = cohort.orderBy("total_time_min", "result_id").limit(int(limit))
    return first.withColumn("placement", F.row_number().over(Window.orderBy("total_time_min", "result_id")).cast("long"))


def named_rows(cohort: DataFrame, athlete_name: str, limit: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The first rows of a name with their places in the whole cohort, which itself is only counted.

    A place is the number of rows before it: those with a smaller time, and of the same time those with a smaller id.
    """
    named = cohort.where(name_contains(athlete_name)).orderBy("total_time_min", "result_id").limit(int(limit))
    # `limit` rows, kept so that both counts below see the same ones.
    named = local_table(cohort, named.toArrow(), named.schema)
    times = cohort.withColumn("_all", F.lit(0))
    asked = named.select(F.lit(0).alias("_all"), "total_time_min").distinct()
    below = count_below_few(times, asked, ["_all"], "total_time_min", hot_rows).select("total_time_min", "below")
    same = named.select("total_time_min", F.col("result_id").alias("_id"))
    ties = (
        cohort.select("total_time_min", F.col("result_id").alias("_other"))
        .join(F.broadcast(same), "total_time_min")
        .groupBy("total_time_min", "_id")
        .agg(F.count_if(F.col("_other") <= F.col("_id")).alias("_upto"))
    )
    placed = named.join(below, "total_time_min").join(
        ties.withColumnsRenamed({"_id": "result_id"}), ["total_time_min", "result_id"]
    )
    return placed.withColumn("placement", F.col("below") + F.col("_upto")).select(*named.columns, "placement").orderBy("placement")


def location_bests(cohort: DataFrame) -> DataFrame:
    return (
        cohort.groupBy("location")
        .agg(F.count(F.lit(1)).alias("count"), F.min("total_time_min").alias("fastest_time_min"))
        .orderBy(F.lower("location").asc_nulls_last())
    )


def placement_lookup(cohort: DataFrame, target: float) -> DataFrame:
    """Where a time would place; no row if the cohort is empty."""
    total, value = F.col("total_time_min"), F.lit(float(target))
    return cohort.agg(
        (F.count_if(total < value) + 1).alias("placement"),
        F.count(F.lit(1)).alias("out_of"),
        F.count_if(total == value).alias("exact_matches"),
    ).where("out_of > 0").select(value.alias("target_time_min"), "placement", "out_of", "exact_matches")


def placement_lookups(results: DataFrame, targets: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same for a table of targets (`keys` and `target_time_min`), each in its own cohort."""
    timed = results.where(F.col("total_time_min").isNotNull()).withColumnRenamed("total_time_min", "target_time_min")
    answered = count_below(timed, targets, keys, "target_time_min", hot_rows)
    return answered.where("total > 0").select(
        *targets.columns,
        (F.col("below") + 1).alias("placement"),
        F.col("total").alias("out_of"),
        F.col("equal").alias("exact_matches"),
    )


def rankings(
    results: DataFrame,
    season: int,
    division: str,
    gender: str,
    age_group: str | None = None,
    athlete_name: str | None = None,
    limit: int = 200,
    target_time_min: float | None = None,
) -> Rankings:
    """Ranked results. A name filter selects from the ranking and does not change the places."""
    cohort = ranking_cohort(results, season, division, gender, age_group)
    shown = cohort.select(*[c for c in SHOWN if c in cohort.columns])
    if given(athlete_name):
        rows = named_rows(shown, athlete_name, limit)
    else:
        rows = top_rows(shown, limit)
    return Rankings(
        rows=rows,
        locations=location_bests(cohort),
        count=cohort.agg(F.count(F.lit(1)).alias("count")),
        lookup=None if target_time_min is None else placement_lookup(cohort, target_time_min),
    )


def ranking_menu(results: DataFrame, season: int, division: str, gender: str, age_group: str | None = None) -> DataFrame:
    """Age groups of a ranking cohort; an age group narrows the locations only."""
    for name, value in (("division", division), ("gender", gender)):
        if not given(value):
            raise InvalidRequest(f"{name} is required for rankings filters")
    scoped = results.where((F.col("season") == int(season)) & text_is("division", division) & gender_is(gender))
    if given(age_group):
        scoped = scoped.withColumn("location", F.when(text_is("age_group", age_group), F.col("location")))
    return facets(scoped, [], ["age_group", "location"])
