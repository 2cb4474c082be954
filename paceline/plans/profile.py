"""Careers: everything about an athlete, for one athlete or for all."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.errors import Ambiguous, InvalidRequest, NotFound
from paceline.functions.durations import finite
from paceline.functions.text import present, shown_name
from paceline.operators.cohorts import cohorts_of
from paceline.operators.filters import given, has, positive, text_is
from paceline.operators.joins import key_join
from paceline.operators.ordering import HOT_ROWS, count_before, count_below_few, hot_groups, running_total, standing
from paceline.operators.stats import bounded, first_n_in_group
from paceline.plans.report import with_event_ranks
from paceline.schema import COHORT_KEYS, PROFILE_METRICS, RUN_PLUS_ROXZONE, TIME_COLUMNS


def newest_first() -> list:
    return [F.desc_nulls_last("year"), F.asc_nulls_last("location"), F.col("result_id")]


def athlete_races(results: DataFrame, links: DataFrame, index: DataFrame) -> DataFrame:
    """Results with the athlete they belong to."""
    identity = index.select(
        "athlete_id",
        F.col("canonical_name").alias("athlete_canonical_name"),
        F.col("gender").alias("athlete_gender"),
        F.col("nationality").alias("athlete_nationality"),
    )
    linked = results.join(links.select("athlete_id", "result_id"), "result_id").join(identity, "athlete_id", "left")
    return linked.withColumn("athlete_name", shown_name(F.col("name"), F.col("athlete_canonical_name")))


def metric_times(df: DataFrame) -> dict[str, Column]:
    """The time of each profile metric that the table has columns for; null unless positive."""
    times = {metric: positive(F.col(column)) for metric, column in PROFILE_METRICS.items() if has(df, column)}
    if has(df, "run_time_min", "roxzone_time_min"):
        times[RUN_PLUS_ROXZONE] = positive(F.col("run_time_min")) + positive(F.col("roxzone_time_min"))
    return times


def metric_rows(df: DataFrame, ids: list[str]) -> DataFrame:
    """One row per result and profile metric with a positive time (`metric`, `minutes`)."""
    cells = [F.struct(F.lit(metric).alias("metric"), time.alias("minutes")) for metric, time in metric_times(df).items()]
    return df.select(*ids, F.inline(F.array(*cells))).where(F.col("minutes").isNotNull())


def metric_percentiles(
    rows: DataFrame, results: DataFrame, hot_rows: int | None = HOT_ROWS, few: bool = False
) -> DataFrame:
    """Percentile of each metric row among all results of the same division and gender, within [0, 1]."""
    group = ["division", "gender"]
    if not has(results, *group):
        return rows.withColumn("percentile", F.lit(None).cast("double"))
    values, keys = metric_rows(results, group), [*group, "metric"]
    if few:
        answered = count_below_few(values, rows, keys, "minutes", hot_rows)
    else:
        # A group has each metric at most once per result, so counting results is enough to rule out large ones.
        limit = None if hot_rows is None or hot_groups(results, group, COUNTED_ROWS * hot_rows) is None else hot_rows
        asked = rows.withColumn("_upto", F.lit(False))
        sizes, short = bounded(values.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")))
        placed = count_before(values, asked, keys, "minutes", "below", "_upto", limit).drop("_upto")
        answered = key_join(placed, sizes, keys, "left", broadcast=short)
    share = standing(F.col("below"), F.col("total"))
    inside = F.when(share < 0, 0.0).when(share > 1, 1.0).otherwise(share)
    return answered.withColumn("percentile", inside).drop("below", "equal", "total")


#: How many times as many values as ranked rows a task is given: equal ones are combined, and a sum runs over them.
COUNTED_ROWS = 4


class Profiles:
    """Profiles of the athletes in `rows` (from `athlete_races`), measured against all `results`.

    Each part is planned when it is asked for.
    """

    def __init__(
        self, rows: DataFrame, results: DataFrame, division: str | None = None, few: bool = False, hot_rows: int = HOT_ROWS
    ):
        self.all_rows, self.results, self.few, self.hot_rows = rows, results, few, hot_rows
        self.filtered = given(division) is not None
        self.rows = rows.where(text_is("division", division)) if self.filtered else rows

    @cached_property
    def ranked(self) -> DataFrame:
        return age_group_ranks(self.rows, self.results, self.hot_rows)

    @cached_property
    def metrics(self) -> DataFrame:
        ids = ["athlete_id", "division", "gender", "result_id", "location", "year"]
        return metric_percentiles(metric_rows(self.rows, ids), self.results, self.hot_rows, self.few)

    @cached_property
    def athletes(self) -> DataFrame:
        return headers(self.rows, one_division_only=not self.filtered)

    @cached_property
    def divisions(self) -> DataFrame:
        return divisions_of(self.all_rows)

    @cached_property
    def summary(self) -> DataFrame:
        return summary_of(self.ranked)

    @cached_property
    def bests(self) -> DataFrame:
        # Which row is best does not hang on its percentile, so only best rows get one.
        placed = metric_percentiles(personal_bests(self.rows), self.results, self.hot_rows, self.few)
        return placed.withColumnRenamed("minutes", "time").drop("division", "gender")

    @cached_property
    def averages(self) -> DataFrame:
        return self.metrics.groupBy("athlete_id", "metric").agg(
            F.avg("minutes").alias("time"), F.avg("percentile").alias("percentile")
        )

    @cached_property
    def seasons(self) -> DataFrame:
        return seasons_of(self.rows)

    @cached_property
    def races(self) -> DataFrame:
        return race_progress(self.ranked)


def age_group_ranks(rows: DataFrame, results: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the rank in the own cohort, ranking only cohorts that matter."""
    if not has(results, *COHORT_KEYS, "total_time_min"):
        return rows.withColumn("age_group_rank", F.lit(None).cast("long"))
    slim = results.select("result_id", *COHORT_KEYS, "total_time_min")
    ranked = with_event_ranks(cohorts_of(slim, rows), hot_rows)
    return rows.join(ranked.select("result_id", F.col("event_rank").alias("age_group_rank")), "result_id", "left")


def headers(rows: DataFrame, one_division_only: bool = True) -> DataFrame:
    """Name and groups from the newest result. An athlete of several divisions shows none."""
    newest = first_n_in_group(rows, ["athlete_id"], newest_first(), 1)
    shown = newest.select(
        "athlete_id",
        F.coalesce(present(F.col("name")), present(F.col("athlete_name")), F.lit("Athlete")).alias("name"),
        F.coalesce(present(F.col("gender")), present(F.col("athlete_gender"))).alias("gender"),
        present(F.col("division")).alias("division"),
        present(F.col("age_group")).alias("age_group"),
        present(F.col("athlete_nationality")).alias("nationality"),
    )
    if not one_division_only:
        return shown
    pairs = divisions_of(rows).groupBy("athlete_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = key_join(shown, pairs, ["athlete_id"], "left")
    return joined.withColumn("division", F.when(F.coalesce("_n", F.lit(0)) <= 1, F.col("division"))).drop("_n")


def divisions_of(rows: DataFrame) -> DataFrame:
    return rows.select("athlete_id", F.trim("division").alias("division")).where("division <> ''").distinct()


def summary_of(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("athlete_id").agg(
        F.count(F.lit(1)).alias("total_races"),
        F.min("total_time_min").alias("best_overall_time"),
        F.min("age_group_rank").alias("best_age_group_finish"),
        F.min("year").cast("string").alias("first_season"),
    )


def personal_bests(rows: DataFrame) -> DataFrame:
    """Best row per athlete and metric, with its division and gender; of equal times the newest counts.

    One pass per athlete finds the bests of all metrics, before rows are taken apart by metric.
    """
    best = {}
    for metric, time in metric_times(rows).items():
        newest = F.struct(
            time.alias("minutes"),
            F.coalesce(-F.col("year"), F.lit(2**31 - 1)).alias("_age"),
            F.col("location").isNull().alias("_nowhere"),
            "location",
            "result_id",
            "year",
            "division",
            "gender",
        )
        best[metric] = F.min(F.when(time.isNotNull(), newest)).alias(metric)
    found = rows.groupBy("athlete_id").agg(*best.values())
    cells = [F.struct(F.lit(metric).alias("metric"), F.col(metric).alias("b")) for metric in best]
    return found.select("athlete_id", F.inline(F.array(*cells))).where(F.col("b").isNotNull()).select(
        "athlete_id", "metric", "b.minutes", "b.result_id", present(F.col("b.location")).alias("location"), "b.year", "b.division", "b.gender"
    )


def seasons_of(rows: DataFrame) -> DataFrame:
    """Best time and number of starts per calendar year; years without a time are dropped."""
    return (
        rows.where("year is not null")
        .groupBy("athlete_id", F.col("year").cast("string").alias("season"))
        .agg(F.min("total_time_min").alias("best_time"), F.count(F.lit(1)).alias("race_count"))
        .where(F.col("best_time").isNotNull())
    )


def season_series(seasons: DataFrame) -> DataFrame:
    """Season bests in the order of a chart."""
    return seasons.where(finite(F.col("best_time")).isNotNull()).orderBy("athlete_id", "season")


def race_progress(ranked: DataFrame) -> DataFrame:
    """One row per start with the times a progress chart shows."""
    times = [F.col(c) if has(ranked, c) else F.lit(None).cast("double").alias(c) for c in TIME_COLUMNS]
    both = [F.col(c) if has(ranked, c) else F.lit(None).cast("double") for c in ("run_time_min", "roxzone_time_min")]
    start = F.col("start_date").cast("string") if has(ranked, "start_date") else F.lit(None).cast("string")
    return ranked.select(
        "athlete_id",
        "result_id",
        present(F.col("location")).alias("location"),
        "year",
        "age_group_rank",
        start.alias("start_date"),
        *times,
        (both[0] + both[1]).alias("runplusroxzone_time_min"),
    ).orderBy("athlete_id", *newest_first())


def progression(races: DataFrame, metric: str = "total_time_min", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Starts that have the metric, in time order: by date, else at the turn of their year."""
    when = F.coalesce(F.col("start_date").try_cast("timestamp"), F.make_timestamp(
        F.col("year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    timed = races.withColumns({"moment": when, "minutes": finite(F.col(metric))}).where(F.col("minutes").isNotNull())
    order = [F.asc_nulls_last("moment"), F.asc_nulls_last("year"), F.asc_nulls_last("location"), F.col("result_id")]
    counted = timed.withColumn("_one", F.lit(1))
    steps = running_total(counted, ["athlete_id"], order, "_one", "step", hot_groups(counted, ["athlete_id"], hot_rows))
    return steps.select("athlete_id", "result_id", "moment", "minutes", "step")


def profile(
    results: DataFrame, links: DataFrame, index: DataFrame, athlete_id: str, division: str | None = None
) -> Profiles:
    """The profile of one athlete."""
    wanted = given(athlete_id)
    if wanted is None:
        raise InvalidRequest("athlete_id is required")
    rows = _races_of(results, links, index, wanted)
    matching = rows.where(text_is("division", division)) if given(division) else rows
    if matching.isEmpty():
        where = f" in division {division!r}" if given(division) else ""
        raise NotFound(f"no races for athlete_id {wanted!r}{where}")
    return Profiles(rows, results, division, few=True)


def _races_of(results, links, index, athlete_id):
    own, short = bounded(links.where(F.col("athlete_id") == athlete_id).select("athlete_id", "result_id").distinct())
    mine = key_join(results, own.select("result_id"), ["result_id"], "left_semi", broadcast=short)
    return athlete_races(mine, own, index.where(F.col("athlete_id") == athlete_id))


def athletes_named(results: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Ids of the athletes whose results carry exactly this name, in any case."""
    named = results.where(F.lower("name") == str(name).strip().lower()).select("result_id")
    return links.join(named, "result_id").select(present(F.col("athlete_id")).alias("athlete_id")).where(
        "athlete_id is not null"
    ).distinct()


def profile_by_name(
    results: DataFrame, links: DataFrame, index: DataFrame, name: str, division: str | None = None
) -> Profiles:
    if given(name) is None:
        raise InvalidRequest("name is required")
    found = [row[0] for row in athletes_named(results, links, name).limit(2).collect()]
    if not found:
        raise NotFound(f"no races for {name!r}")
    if len(found) > 1:
        raise Ambiguous(f"several athletes are called {name!r}; ask by athlete_id", found)
    return profile(results, links, index, found[0], division)


def races_by_canonical_name(results: DataFrame, links: DataFrame, athletes: DataFrame, name: str) -> DataFrame:
    """Results of the athletes with this canonical name, newest first."""
    wanted = athletes.where(F.col("canonical_name") == str(name).strip().lower()).select("athlete_id")
    mine = links.join(wanted, "athlete_id", "left_semi").select("result_id").distinct()
    return results.join(mine, "result_id").orderBy(
        F.desc_nulls_last("season"), F.desc_nulls_last("year"), F.asc_nulls_last("event_name")
    )


def newest_per_athlete(rows: DataFrame) -> DataFrame:
    """One row per athlete id, or per name where the id is missing: the newest."""
    named = rows.withColumns({"athlete_id": present(F.col("athlete_id")), "athlete_name": F.trim("athlete_name")})
    keyed = named.where("athlete_name <> ''").withColumn("_key", F.coalesce("athlete_id", F.lower("athlete_name")))
    newest = first_n_in_group(keyed, ["_key"], [F.desc_nulls_last("year"), F.col("result_id")], 1)
    return newest.drop("_key").orderBy(F.lower("athlete_name"))
