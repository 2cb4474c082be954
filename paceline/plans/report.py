"""The report of one result, and the same numbers for all results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.errors import InvalidRequest
from paceline.functions.durations import finite
from paceline.functions.labels import percent_fill
from paceline.functions.text import plain
from paceline.operators.cohorts import demographic_cohort, pick_result, time_band, time_window_cohort, time_window_standing
from paceline.operators.filters import believable, given, has
from paceline.operators.joins import key_condition, key_join
from paceline.operators.ordering import HOT_ROWS, HotGroups, count_before, count_below, hot_groups, local_table, rank_in_group, standing
from paceline.operators.positions import interpolated, ordered_places, values_at
from paceline.operators.stats import bounded, describe, histogram, marker_standing, segment_table
from paceline.operators.windows import PACKED_ROWS, window_faster, window_histograms, window_numbers
from paceline.schema import COHORT_KEYS, DEFAULT_BINS, PACING_RUNS, RUN_COLUMNS, RUN_FLOOR_MIN, STATION_COLUMNS, floor_of, time_column
from paceline.session import checkpointed

QUANTILES = {"median": 0.5, "p10": 0.1, "p90": 0.9}
STORED_RANKS = ["season_rank", "season_size", "season_percentile", "overall_rank", "overall_size", "overall_percentile"]
SPLIT_ORDER = ["split_name", "split_time_min", "result_id"]
SPLIT_SHOWN = ["split_name", "split_time_min", "split_rank", "split_size", "split_percentile"]


def with_event_ranks(results: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rank, size and percentile in the own cohort. Results without a time stay, unranked."""
    timed = rank_in_group(
        results.where(F.col("total_time_min").isNotNull()), COHORT_KEYS, "total_time_min", "result_id", "event", hot_rows
    )
    return timed.unionByName(results.where(F.col("total_time_min").isNull()), allowMissingColumns=True)


def with_stored_ranks(results: DataFrame, rankings: DataFrame) -> DataFrame:
    """Season and overall ranks from the rankings table; what it lacks is null."""
    keys = ["result_id", *(["season"] if has(rankings, "season") else [])]
    stored = rankings.select(*keys, *[c for c in STORED_RANKS if has(rankings, c)])
    return results.join(stored, keys, "left")


def _of_race(table: DataFrame, picked: dict, location: bool = True) -> DataFrame:
    """The rows of a table that lie in the season, and the place, of the picked result: what its scan can skip by."""
    keys = {k: picked[k] for k in ("season", *(["location"] if location else [])) if has(table, k)}
    return table.where(key_condition(keys))


@dataclass
class ResultReport:
    """Everything about one result; each part is its own lazy table."""

    race: DataFrame
    cohort: DataFrame
    splits: DataFrame
    cohort_splits: DataFrame
    time_window: DataFrame | None = None
    time_window_splits: DataFrame | None = None


def result_report(
    results: DataFrame, rankings: DataFrame, splits: DataFrame, result_id, window_min: float | None = 5.0
) -> ResultReport:
    """One result with its cohort, its splits, and those who finished within `window_min` of it.

    The result is looked up first: one row, whose keys then filter every scan.
    """
    picked = pick_result(results, result_id, COHORT_KEYS + ["total_time_min"])
    cohort = with_event_ranks(demographic_cohort(results, picked))
    rankings = _of_race(rankings, picked)
    here = _of_race(splits, picked)
    race = with_stored_ranks(cohort.where(F.col("result_id") == F.lit(result_id)), rankings)
    own = here.where(F.col("result_id") == F.lit(result_id)).select(*SPLIT_SHOWN)
    keys = {k: picked[k] for k in COHORT_KEYS}
    cohort_splits = splits.where(key_condition(keys))
    if window_min is None:
        return ResultReport(race, _by_time(cohort), own.orderBy("split_name"), _by_split(cohort_splits))
    near = time_window_cohort(results, picked, window_min)
    # The window frame shows the stored event ranks, unlike the race and the cohort.
    stored = rankings.select("result_id", *[c for c in ("event_rank", "event_size", "event_percentile") if has(rankings, c)])
    near_splits = here.join(near.select("result_id"), "result_id", "left_semi")
    return ResultReport(
        race=race,
        cohort=_by_time(cohort),
        splits=split_window_standing(own, near_splits).orderBy("split_name"),
        cohort_splits=_by_split(cohort_splits),
        time_window=_by_time(near.join(stored, "result_id", "left")),
        time_window_splits=_by_split(near_splits),
    )


def _by_time(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("total_time_min"), "result_id")


def _by_split(df: DataFrame) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("split_name"), F.asc_nulls_last("split_time_min"), "result_id")


def split_window_standing(own: DataFrame, near_splits: DataFrame) -> DataFrame:
    """Percentile of each own split among the same split of the window. `own` is one result."""
    counted = (
        near_splits.where(F.col("split_time_min").isNotNull())
        .select("split_name", F.col("split_time_min").alias("_other"))
        .join(F.broadcast(own.select("split_name", F.col("split_time_min").alias("_mine")).distinct()), "split_name")
        .groupBy("split_name", "_mine")
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_other") < F.col("_mine")).alias("_below"))
    )
    joined = key_join(own, counted.withColumnRenamed("_mine", "split_time_min"), ["split_name", "split_time_min"], "left")
    value = F.when(F.col("split_time_min").isNotNull(), standing(F.col("_below"), F.col("_n")))
    return joined.select(*own.columns, value.alias("split_percentile_time_window"))


class BoundedReport:
    """The report of one result as statistics: nothing in it grows with the cohort.

    Distributions are kept per `scope`: `cohort`, `time_window`, and with a split name `split_cohort`
    and `split_time_window`. Each part is planned when it is asked for.
    """

    def __init__(
        self,
        results: DataFrame,
        rankings: DataFrame,
        splits: DataFrame,
        result_id,
        window_min: float | None = 5.0,
        split_name: str | None = None,
        n_bins: int = DEFAULT_BINS,
    ):
        self.results, self.rankings, self.all_splits, self.result_id = results, rankings, splits, result_id
        self.window_min = window_min if window_min and window_min > 0 else None
        self.split_name, self.n_bins = given(split_name), n_bins
        self.picked = pick_result(results, result_id)
        if self.window_min is not None:
            time_band(self.picked, self.window_min)

    @cached_property
    def full(self) -> ResultReport:
        return result_report(self.results, self.rankings, self.all_splits, self.result_id, self.window_min)

    @property
    def race(self) -> DataFrame:
        return self.full.race

    @property
    def splits(self) -> DataFrame:
        return self.full.splits

    @cached_property
    def scopes(self) -> list[tuple[str, DataFrame, str, float | None]]:
        """Name, rows, value column and own value of each distribution."""
        total, picked = self.picked["total_time_min"], self.picked
        found = [("cohort", demographic_cohort(self.results, picked), "total_time_min", total)]
        near = None
        if self.window_min is not None:
            near = time_window_cohort(self.results, picked, self.window_min)
            found.append(("time_window", near, "total_time_min", total))
        if self.split_name is not None:
            chosen = F.lower("split_name") == self.split_name.lower()
            kept = _of_race(self.all_splits, picked).where(chosen & believable("split_time_min", self.split_name))
            own = kept.where(F.col("result_id") == F.lit(self.result_id)).agg(F.max("split_time_min")).first()[0]
            keys = {k: picked[k] for k in COHORT_KEYS}
            found.append(("split_cohort", kept.where(key_condition(keys)), "split_time_min", own))
            if near is not None:
                rows = kept.join(near.select("result_id"), "result_id", "left_semi")
                found.append(("split_time_window", rows, "split_time_min", own))
        return found

    @cached_property
    def values(self) -> DataFrame:
        """All distributions below each other, so that one job summarises them."""
        stacked = None
        for scope, rows, column, _ in self.scopes:
            there = rows.where(F.col(column).isNotNull())
            part = there.select(F.lit(scope).alias("scope"), F.col(column).alias("minutes"))
            stacked = part if stacked is None else stacked.unionByName(part)
        return stacked

    @cached_property
    def stats(self) -> DataFrame:
        """There are four scopes at most, so the table is kept at hand; the bins take their ends from it."""
        return bounded(describe(self.values, ["scope"], "minutes"))[0]

    @cached_property
    def bins(self) -> DataFrame:
        return histogram(self.values, ["scope"], "minutes", self.n_bins, described=self.stats)

    @cached_property
    def markers(self) -> DataFrame:
        marks = [{"scope": scope, "marker": None if own is None else float(own)} for scope, _, _, own in self.scopes]
        table = local_table(self.results, marks, "scope string, marker double")
        return marker_standing(self.values, ["scope"], "minutes", table)

    @property
    def _own(self) -> DataFrame:
        return _of_race(self.results, self.picked).where(F.col("result_id") == F.lit(self.result_id))

    @property
    def work_run(self) -> DataFrame:
        return self._own.select("result_id", *work_run_split(self._own))

    @property
    def run_change(self) -> DataFrame:
        own = _of_race(self.all_splits, self.picked).where(F.col("result_id") == F.lit(self.result_id))
        return run_change(self._own, own)

    def cohort_preview(self, limit: int = 200) -> tuple[DataFrame, DataFrame]:
        return preview(self.full.cohort, ["total_time_min", "result_id"], limit)

    def cohort_splits_preview(self, limit: int = 500) -> tuple[DataFrame, DataFrame]:
        return preview(self.full.cohort_splits, SPLIT_ORDER, limit)

    def window_splits_preview(self, limit: int = 500) -> tuple[DataFrame, DataFrame] | None:
        rows = self.full.time_window_splits
        return None if rows is None else preview(rows, SPLIT_ORDER, limit)


class BatchReports:
    """The statistics, bins, markers and window splits of many results at once.

    `requests` is a table of result ids. Numbers of a demographic cohort are computed once per cohort and joined by its
    keys; numbers of a time window are differences of positions in sorted order. No two results are ever paired.

    Time windows of a race (for splits, of a race and split name) with up to `packed_rows` rows are answered in one task from
    its rows, which are shuffled once (`operators/windows.py`). Requests in larger ones, and (but for bins) ids that several
    results carry, go the way of range sorts over all tasks; so do all with `packed_rows=0`. Both ways give the same rows.
    """

    def __init__(
        self, results: DataFrame, splits: DataFrame, requests: DataFrame, window_min: float = 5.0, n_bins: int = DEFAULT_BINS,
        hot_rows: int = HOT_ROWS, packed_rows: int = PACKED_ROWS,
    ):
        self.results, self.splits, self.window_min, self.n_bins, self.hot_rows = results, splits, float(window_min), n_bins, hot_rows
        self.packed_rows = packed_rows
        self.requests = requests.select("result_id").distinct()
        self.picked = results.join(self.requests, "result_id", "left_semi").select("result_id", *COHORT_KEYS, "total_time_min")

    @cached_property
    def cohort_stats(self) -> DataFrame:
        """Seven numbers of each asked cohort, one row per request."""
        return key_join(self.picked.select("result_id", *COHORT_KEYS), self._cohort_numbers, COHORT_KEYS).drop(*COHORT_KEYS)

    @cached_property
    def _cohort_rows(self) -> DataFrame:
        timed = self.results.where(F.col("total_time_min").isNotNull()).select(*COHORT_KEYS, "total_time_min")
        return key_join(timed, self.picked.select(*COHORT_KEYS).distinct(), COHORT_KEYS, "left_semi")

    @cached_property
    def _cohort_numbers(self) -> DataFrame:
        return describe(self._cohort_rows, COHORT_KEYS, "total_time_min", hot_rows=self.hot_rows)

    @cached_property
    def cohort_bins(self) -> DataFrame:
        """The histogram of each asked cohort, once per cohort: keys, bin, start, end, count."""
        return histogram(self._cohort_rows, COHORT_KEYS, "total_time_min", self.n_bins)

    @cached_property
    def markers(self) -> DataFrame:
        """Per request its total time and its standing in cohort and window, 1 is fastest."""
        timed = self.picked.where(F.col("total_time_min").isNotNull())
        cohort = count_below(self._cohort_rows, timed, COHORT_KEYS, "total_time_min", self.hot_rows).select(
            "result_id", F.col("total_time_min").alias("marker"), standing(F.col("below"), F.col("total")).alias("cohort_percentile")
        )
        race = ["location", "season"]
        here = key_join(
            self.results.where(F.col("total_time_min").isNotNull()).select("result_id", *race, "total_time_min"),
            timed.select(*race).distinct(), race, "left_semi",
        )
        near = time_window_standing(here, self.window_min, race, hot_rows=self.hot_rows)
        return cohort.join(near.select("result_id", "window_size", "window_percentile"), "result_id", "left")

    @cached_property
    def _repeated(self) -> HotGroups | None:
        """Ids that several results carry."""
        return hot_groups(self.results.where(F.col("result_id").isNotNull()), ["result_id"], 1)

    @cached_property
    def _asked_races(self) -> tuple[DataFrame, bool]:
        return bounded(self.picked.select("location", "season").distinct())

    def _of_asked_races(self, rows: DataFrame) -> DataFrame:
        races, short = self._asked_races
        return key_join(rows, races, ["location", "season"], "left_semi", broadcast=short)

    def _shared_out(self, crowded: HotGroups | None, repeated: HotGroups | None) -> tuple[DataFrame, BatchReports | None]:
        """Requests that tasks answer from whole groups, and the report of the others: those in races with a group in
        `crowded`, and `repeated` ids."""
        race = ["location", "season"]
        others = []
        if repeated is not None:
            others.append(self.requests.join(repeated.table, "result_id", "left_semi"))
        if crowded is not None:
            here = key_join(self.picked, crowded.table.select(*race).distinct(), race, "left_semi")
            others.append(here.select("result_id"))
        if not others:
            return self.requests, None
        rest = checkpointed(reduce(DataFrame.unionByName, others).distinct())
        report = BatchReports(self.results, self.splits, rest, self.window_min, self.n_bins, self.hot_rows, packed_rows=0)
        return self.requests.join(rest, "result_id", "left_anti"), report

    @cached_property
    def _timed_races(self) -> tuple[DataFrame, HotGroups | None]:
        """Timed results of the asked races, and which of these no task can hold."""
        race = ["location", "season"]
        timed = self.results.where(F.col("total_time_min").isNotNull()).select("result_id", *race, "total_time_min")
        timed = self._of_asked_races(timed)
        return timed, hot_groups(timed, race, self.packed_rows)

    def _race_windows(self, repeated: HotGroups | None) -> tuple[DataFrame, BatchReports | None]:
        """Timed results of the asked races, with `_asked` where a task answers the request; and the report of the others."""
        timed, crowded = self._timed_races
        plain, others = self._shared_out(crowded, repeated)
        return timed.join(plain.withColumn("_asked", F.lit(True)), "result_id", "left"), others

    @cached_property
    def _window_bounds(self) -> tuple[DataFrame, DataFrame]:
        """Timed results of the asked races, and each timed request with `_from` and `_to`: the places of its time
        window, [total - window, total + window] inclusive, in its race's order of total times."""
        race = ["location", "season"]
        asked = self.picked.where(F.col("total_time_min").isNotNull()).select("result_id", *race, "total_time_min")
        timed = self.results.where(F.col("total_time_min").isNotNull()).select("result_id", *race, "total_time_min")
        timed = key_join(timed, asked.select(*race).distinct(), race, "left_semi")
        slim = timed.select(*race, F.col("total_time_min").alias("_at"))
        low = asked.withColumn("_at", F.col("total_time_min") - self.window_min)
        high = asked.withColumn("_at", F.col("total_time_min") + self.window_min)
        first = count_below(slim, low, race, "_at", self.hot_rows).select("result_id", F.coalesce("below", F.lit(0)).alias("_from"))
        last = count_below(slim, high, race, "_at", self.hot_rows).select(
            "result_id", F.coalesce(F.col("below") + F.col("equal"), F.lit(0)).alias("_to")
        )
        # Both the statistics and the bins start from here, and read it more than once.
        return timed, checkpointed(asked.join(first, "result_id").join(last, "result_id"))

    @cached_property
    def window_stats(self) -> DataFrame:
        """Seven numbers of the total times in each request's time window, one row per timed request.

        Count is a difference of places; min, max and the interpolated quantiles are values at places; the mean is a
        difference of running sums, a decimal and exact (values to 9 places). No result is paired with another.
        """
        if not self.packed_rows:
            return self._ranged_window_stats
        rows, others = self._race_windows(self._repeated)
        found = window_numbers(rows, ["location", "season"], "total_time_min", self.window_min, QUANTILES)
        numbers = _seven_numbers(found, F.col("_sum"))
        return numbers if others is None else numbers.unionByName(others.window_stats)

    @cached_property
    def _ranged_window_stats(self) -> DataFrame:
        race = ["location", "season"]
        timed, bounds = self._window_bounds
        places = ordered_places(timed, race, "total_time_min", "result_id", self.hot_rows)
        n = F.col("_to") - F.col("_from")
        def pick(name: str, place: Column) -> Column:
            return F.struct(F.lit(name).alias("name"), place.cast("long").alias("place"))

        picks = [pick("min", F.col("_from")), pick("max", F.col("_to") - 1)]
        for name, share in QUANTILES.items():
            position = (n - 1) * F.lit(share)
            picks += [pick(f"{name}_lo", F.col("_from") + F.floor(position)), pick(f"{name}_hi", F.col("_from") + F.ceil(position))]
        asks = bounds.select("result_id", *race, F.inline(F.array(*picks)))
        found = values_at(places, asks, race)
        got = found.groupBy("result_id").agg(
            *[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in ["min", "max", *[f"{q}_{e}" for q in QUANTILES for e in ("lo", "hi")]]],
            F.max(F.when(F.col("name") == "min", F.col("sum_before"))).alias("_sum_from"),
            F.max(F.when(F.col("name") == "max", F.col("sum_through"))).alias("_sum_to"),
        )
        out = bounds.select("result_id", n.alias("count")).join(got, "result_id")
        return _seven_numbers(out, F.col("_sum_to") - F.col("_sum_from"))

    @cached_property
    def window_bins(self) -> DataFrame:
        """The histogram of each request's time window: result_id, bin, start, end, count; empty bins included.

        Edges are equal steps from the window's fastest to its slowest time (a step of 1/bins if they are equal); a
        time belongs to the bin whose start it reaches and whose end it is under, the slowest to the last bin. Each
        count is a difference of places: the race's times under one edge and under the next, held to the window.
        Results with equal id, race and time share one histogram.
        """
        if not self.packed_rows:
            return self._ranged_window_bins
        rows, others = self._race_windows(None)
        found = window_histograms(rows, ["location", "season"], "total_time_min", self.window_min, self.n_bins)
        listed = found.select("result_id", "_low", "_width", F.posexplode("_counts").alias("bin", "count"))
        edge = [F.col("_low") + F.col("_width") * F.col("bin"), F.col("_low") + F.col("_width") * (F.col("bin") + 1)]
        bins = listed.select("result_id", "bin", edge[0].alias("start"), edge[1].alias("end"), F.col("count").cast("long").alias("count"))
        return bins if others is None else bins.unionByName(others.window_bins)

    @cached_property
    def _ranged_window_bins(self) -> DataFrame:
        race = ["location", "season"]
        timed, bounds = self._window_bounds
        ends = checkpointed(self.window_stats.select("result_id", F.col("min").alias("_low"), F.col("max").alias("_high")))
        width = F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(F.lit(1.0)) / self.n_bins
        framed = bounds.join(ends, "result_id").select(
            "result_id", *race, "_from", "_to", "_low", width.alias("_width"),
            F.explode(F.sequence(F.lit(0), F.lit(self.n_bins - 1))).alias("bin"),
        )
        framed = framed.withColumn("start", F.col("_low") + F.col("_width") * F.col("bin"))
        framed = framed.withColumn("end", F.col("_low") + F.col("_width") * (F.col("bin") + 1))
        inner = framed.where(F.col("bin") > 0).select("result_id", "bin", *race, F.col("start").alias("_at"))
        slim = timed.select(*race, F.col("total_time_min").alias("_at"))
        inner = inner.withColumn("_upto", F.lit(False))
        under = count_before(slim, inner, race, "_at", "_under", "_upto", self.hot_rows).select("result_id", "bin", "_under")
        starts = framed.join(under, ["result_id", "bin"], "left")
        held = F.least(F.greatest(F.coalesce("_under", "_from"), "_from"), "_to")
        starts = starts.withColumn("_first", F.when(F.col("bin") == 0, F.col("_from")).otherwise(held))
        nexts = starts.select("result_id", (F.col("bin") - 1).alias("bin"), F.col("_first").alias("_next"))
        counted = starts.join(nexts, ["result_id", "bin"], "left")
        count = F.coalesce("_next", "_to") - F.col("_first")
        return counted.select("result_id", "bin", "start", "end", count.alias("count"))

    @cached_property
    def window_splits(self) -> DataFrame:
        """Each split of a request with its standing among the same split of its time window.

        Splits meet their results' races and totals by result, and go to the task of their race and name.
        """
        if not self.packed_rows:
            return self._ranged_window_splits
        race = ["location", "season"]
        people = self._of_asked_races(self.results.select("result_id", *race, "total_time_min"))
        timed = people.where(F.col("total_time_min").isNotNull()).select("result_id", *race)
        named = self.splits.where(F.col("split_time_min").isNotNull()).select("result_id", "split_name")
        # If each result is there once, no group is larger than the rows of its split name.
        crowded = self._repeated or hot_groups(named, ["split_name"], self.packed_rows)
        if crowded is not None:
            crowded = hot_groups(named.join(timed, "result_id"), [*race, "split_name"], self.packed_rows)
        plain, others = self._shared_out(crowded, self._repeated)
        known = people.join(plain.withColumn("_asked", F.lit(True)), "result_id", "full")
        rows = self.splits.select("result_id", "split_name", "split_time_min").join(known, "result_id")
        rows = rows.where("_asked or (total_time_min is not null and split_time_min is not null)")
        found = window_faster(rows, [*race, "split_name"], "total_time_min", "split_time_min", self.window_min)
        share = standing(F.col("_below"), F.col("_n")).alias("split_percentile_time_window")
        standings = found.select("result_id", "split_name", "split_time_min", share)
        return standings if others is None else standings.unionByName(others.window_splits)

    @cached_property
    def _ranged_window_splits(self) -> DataFrame:
        """Window splits over range-sorted groups.

        Two orders meet here: the window is a range of total times, the faster ones are the first few by split time.
        Splits of a race are ranked by their time, and each is filed under the blocks of 1, 2, 4, 8, ... ranks it lies
        in. The ranks before a request's split are a handful of such blocks, one per bit of their number; inside a block
        the window is a difference of two positions in the order of total times. So every split becomes as many rows
        as its rank has bits, and no request is paired with a result.
        """
        race = ["location", "season", "split_name"]
        own = self.splits.join(self.requests, "result_id", "left_semi").select("result_id", "split_name", "split_time_min")
        totals = self.picked.select("result_id", "location", "season", "total_time_min")
        asked = own.join(totals, "result_id").where("total_time_min is not null and split_time_min is not null")
        timed = self.results.where(F.col("total_time_min").isNotNull()).select("result_id", "location", "season", "total_time_min")
        timed = key_join(timed, totals.select("location", "season").distinct(), ["location", "season"], "left_semi")
        others = self.splits.where(F.col("split_time_min").isNotNull()).select("result_id", "split_name", "split_time_min")
        values = timed.join(others, "result_id")

        ranked = rank_in_group(values, race, "split_time_min", "result_id", "_s", self.hot_rows)
        levels = F.sequence(F.lit(0), F.floor(F.log2("_s_size")).cast("int"))
        filed = ranked.select(*race, F.explode(levels).alias("_level"), (F.col("_s_rank") - 1).alias("_place"), "total_time_min")
        filed = filed.select(*race, "_level", F.expr("shiftright(_place, _level)").alias("_block"), "total_time_min")
        faster = count_below(values, asked, race, "split_time_min", self.hot_rows).withColumnRenamed("below", "_before")
        bits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.expr("_before").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0)
        parts = faster.select(*asked.columns, "_before", F.explode(bits).alias("_level"))
        parts = parts.withColumn("_block", F.expr("shiftright(_before, _level) - 1"))
        inside = self._within(filed, parts, [*race, "_level", "_block"])
        below = inside.groupBy("result_id", "split_name", "split_time_min").agg(F.sum("_inside").alias("_below"))
        size = self._within(values, asked, race).select("result_id", "split_name", "split_time_min", F.col("_inside").alias("_n"))
        ids = ["result_id", "split_name", "split_time_min"]
        joined = key_join(key_join(own, size, ids, "left"), below, ids, "left")
        share = standing(F.coalesce("_below", F.lit(0)), F.col("_n"))
        return joined.select(*ids, share.alias("split_percentile_time_window"))

    def _within(self, values: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
        """`requests` with `_inside`, the values of their group whose total time lies in the window.

        Both ends of a window travel in one sort; equal requests travel as one, and stay as many as their pairs of ends.
        """
        slim = values.select(*keys, F.col("total_time_min").alias("_at"))
        ids = [*requests.columns]
        ends = F.array(
            F.struct((F.col("total_time_min") - self.window_min).alias("_at"), F.lit(False).alias("_upto")),
            F.struct((F.col("total_time_min") + self.window_min).alias("_at"), F.lit(True).alias("_upto")),
        )
        asked = requests.groupBy(*ids).agg(F.count(F.lit(1)).cast("int").alias("_same")).select(*ids, "_same", F.inline(ends))
        placed = count_before(slim, asked, keys, "_at", "_place", "_upto", self.hot_rows)
        signed = F.when(F.col("_upto"), F.col("_place")).otherwise(-F.col("_place"))
        met = placed.groupBy(*ids, "_same").agg(F.sum(F.coalesce(signed, F.lit(0))).alias("_inside"))
        return met.withColumn("_same", F.explode(F.array_repeat(F.lit(0), F.col("_same") * F.col("_same")))).drop("_same")


def _seven_numbers(found: DataFrame, total: Column) -> DataFrame:
    """The numbers of windows from their counts, ends, sums and the values beside their quantiles' positions."""
    # Typed so that the quotient keeps 19 places: rounding it later to fewer is then rounding once.
    mean = (total.cast("decimal(28,9)") / F.col("count").cast("decimal(9,0)")).alias("mean")
    quantiles = [
        interpolated((F.col("count") - 1) * F.lit(share), F.col(f"{name}_lo"), F.col(f"{name}_hi")).alias(name)
        for name, share in QUANTILES.items()
    ]
    return found.select("result_id", "count", "min", "max", mean, *quantiles)


def preview(df: DataFrame, order: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """The first rows and the full row count."""
    rows = df.orderBy(*[F.asc_nulls_last(c) for c in order]).limit(int(limit))
    return rows, df.agg(F.count(F.lit(1)).alias("total"))


def work_run_split(df: DataFrame) -> list[Column]:
    """Time and share of work against running; transitions count as running. Null without any part."""
    work, run, rox = (finite(F.col(c)) if has(df, c) else F.lit(None).cast("double") for c in (
        "work_time_min", "run_time_min", "roxzone_time_min"))
    moving = F.coalesce(run + rox, run, rox)
    total = work + moving
    return [
        moving.alias("run_time_with_roxzone_min"),
        total.alias("work_run_total_min"),
        F.when(total > 0, work / total).alias("work_pct"),
        F.when(total > 0, moving / total).alias("run_pct"),
    ]


def split_time_map(splits: DataFrame) -> DataFrame:
    """Per result a map from the plain split name to its time. Of repeated names the largest time stays.

    Splits are shuffled once, by result; both aggregations find them there.
    """
    key, value = plain(F.col("split_name")), finite(F.col("split_time_min"))
    clean = splits.select("result_id", key.alias("_key"), value.alias("_value")).where("_key <> '' and _value is not null")
    single = clean.repartition("result_id").groupBy("result_id", "_key").agg(F.max("_value").alias("_value"))
    return single.groupBy("result_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_key", "_value")))).alias("split_times")
    )


def run_change(results: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """Pacing: runs two to seven against their own median, one row per result.

    A run comes from its column, else from the split of that name. Runs are at most six per result,
    so they are compared inside the row and nothing is shuffled but the splits.
    """
    if splits is not None:
        # Only the runs that are compared are mapped.
        paced = splits.where(plain(F.col("split_name")).isin([f"run{n}" for n in PACING_RUNS]))
        results = results.join(split_time_map(paced), "result_id", "left")
    times = []
    for n in PACING_RUNS:
        column = f"run{n}_time_min"
        own = finite(F.col(column)) if has(results, column) else F.lit(None).cast("double")
        times.append(own if splits is None else F.coalesce(own, F.element_at("split_times", F.lit(f"run{n}"))))
    runs = F.array(*times)
    known = F.array_sort(F.filter(runs, lambda t: t.isNotNull()))
    count = F.size(known)
    lower = F.get(known, F.floor((count - 1) / 2).cast("int"))
    upper = F.get(known, F.floor(count / 2).cast("int"))
    points = F.transform(
        F.arrays_zip(F.array(*[F.lit(f"Run {n}") for n in PACING_RUNS]).alias("run"), F.col("_runs").alias("time")),
        lambda p: F.struct(
            p["run"].alias("run"), p["time"].alias("run_time_min"), (p["time"] - F.col("median_run_time_min")).alias("delta_min")
        ),
    )
    with_median = results.select(
        "result_id", runs.alias("_runs"), ((lower + upper) / 2).alias("median_run_time_min"), count.cast("long").alias("count")
    )
    return with_median.withColumn("points", points).select(
        "result_id",
        "median_run_time_min",
        "points",
        "count",
        F.array_min("points.delta_min").alias("min_delta_min"),
        F.array_max("points.delta_min").alias("max_delta_min"),
    )


def cohort_distribution(
    results: DataFrame, result_id, metric: str, bins: int = 30, mode: str = "demographic", window_min: float = 5.0,
    marked: bool = True,
) -> tuple[float | None, DataFrame]:
    """The value of one result and the histogram of its cohort for one metric.

    The demographic cohort spans all seasons here; the time window keeps the season and ignores the rest. A result without
    the metric is an error, as there is no value to mark; with `marked=False` its value is None and the cohort stays whole.
    """
    mode = str(mode).strip().lower()
    if mode not in ("demographic", "time_window"):
        raise InvalidRequest("mode must be 'demographic' or 'time_window'")
    column = time_column(metric)
    picked = pick_result(results, result_id, list(dict.fromkeys([*COHORT_KEYS, "total_time_min", column])))
    value = picked[column]
    if marked and value is None:
        raise InvalidRequest(f"the result has no {column}")
    if picked["season"] is None:
        raise InvalidRequest("the result has no season")
    if mode == "demographic":
        cohort = demographic_cohort(results, picked, [k for k in COHORT_KEYS if k != "season"])
    else:
        cohort = time_window_cohort(results, picked, window_min)
    values = cohort.where(F.col(column).isNotNull()).select(F.lit(column).alias("segment"), F.col(column).alias("minutes"))
    return None if value is None else float(value), histogram(values, ["segment"], "minutes", bins)


def split_distributions(splits: DataFrame, keys: list[str], bins: int = DEFAULT_BINS) -> tuple[DataFrame, DataFrame]:
    """Statistics and histogram of every split in every group at once; run splits keep their floor."""
    named = splits.withColumn("split", F.lower("split_name")).where(F.col("split_time_min").isNotNull())
    kept = named.where(~F.col("split").startswith("run") | (F.col("split_time_min") >= RUN_FLOOR_MIN))
    return (
        describe(kept, [*keys, "split"], "split_time_min"),
        histogram(kept, [*keys, "split"], "split_time_min", bins),
    )


def percentile_series(splits: DataFrame) -> DataFrame:
    """Split percentiles on a 0 to 100 scale in course order, runs and stations."""
    columns = RUN_COLUMNS + STATION_COLUMNS
    course = segment_table(splits).where(F.col("segment").isin(columns)).select(
        F.lower(F.regexp_replace("segment", "_time_min$", "")).alias("_key"), "label", "segment_group", "position"
    )
    window = F.col("split_percentile_time_window") if has(splits, "split_percentile_time_window") else F.lit(None).cast("double")
    shown = splits.select(
        "result_id",
        plain(F.col("split_name")).alias("_key"),
        percent_fill(F.col("split_percentile")).alias("cohort"),
        percent_fill(window).alias("window"),
    )
    return shown.join(F.broadcast(course), "_key").drop("_key")
