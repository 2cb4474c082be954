"""Every operator as a query over the shared test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.functions import durations, labels, text
from paceline.operators import cohorts, filters, ordering, stats
from paceline.operators.joins import key_condition
from paceline.plans import compare, deepdive, derived, menus, profile, rankings, report, search, segments, studies
from paceline.schema import COHORT_KEYS, OVERALL_KEYS, SEASON_KEYS, STATION_COLUMNS, STATIONS
from paceline.sources import contract, manifest, races, warehouse
from paceline.suite import star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: The result that the single-result reports look at.
ONE = 7
WINDOW = 5000.0
#: Small enough that the large-group path is taken at every scale.
FORCED = 300


def tidy(df: DataFrame) -> DataFrame:
    """Plain columns that compare across engines: long, rounded double, text."""
    columns = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.LongType)):
            c = c.cast("long")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(build(spark, sf_dir))

    QUERIES[build.__name__] = run
    return run


# Ranks


def _rank(spark, sf, keys, prefix, **options):
    timed = star.results(spark, sf).select("result_id", *COHORT_KEYS, "total_time_min")
    ranked = ordering.rank_in_group(timed, keys, "total_time_min", "result_id", prefix, **options)
    return ranked.select("result_id", f"{prefix}_rank", f"{prefix}_size", f"{prefix}_percentile")


@query
def rank_event(spark, sf):
    return _rank(spark, sf, COHORT_KEYS, "event")


@query
def rank_season(spark, sf):
    return _rank(spark, sf, SEASON_KEYS, "season")


@query
def rank_overall(spark, sf):
    return _rank(spark, sf, OVERALL_KEYS, "overall")


@query
def rank_overall_ranged(spark, sf):
    return _rank(spark, sf, OVERALL_KEYS, "overall", hot_rows=FORCED)


@query
def race_rankings(spark, sf):
    return derived.race_rankings(star.results(spark, sf))


@query
def race_rankings_ranged(spark, sf):
    return derived.race_rankings(star.results(spark, sf), hot_rows=FORCED)


def _wide(spark, sf):
    return star.stored(spark, sf, "race_results")


def _splits(spark, sf):
    return derived.splits_of(_wide(spark, sf))


@query
def split_percentiles(spark, sf):
    ranked = derived.split_percentiles(_splits(spark, sf))
    return ranked.select("result_id", "split_name", "split_time_min", "split_rank", "split_size", "split_percentile")


@query
def split_percentiles_ranged(spark, sf):
    ranked = derived.split_percentiles(_splits(spark, sf), hot_rows=FORCED // 3)
    return ranked.select("result_id", "split_name", "split_time_min", "split_rank", "split_size", "split_percentile")


RANKED = ["result_id", "name", "location", "season", "age_group", "total_time_min", "placement"]


def _ranking(spark, sf, **options):
    return rankings.rankings(star.results(spark, sf), 1998, "2-HIGH", "female", **options)


@query
def placement_topk(spark, sf):
    return _ranking(spark, sf).rows.select(*RANKED)


@query
def placement_named(spark, sf):
    return _ranking(spark, sf, athlete_name="7").rows.select(*RANKED)


@query
def placement_all(spark, sf):
    return rankings.placements(star.results(spark, sf).select("result_id", "total_time_min")).select("result_id", "placement")


@query
def placement_all_ranged(spark, sf):
    slim = star.results(spark, sf).select("result_id", "total_time_min")
    return rankings.placements(slim, hot_rows=FORCED * 10).select("result_id", "placement")


@query
def placement_lookup(spark, sf):
    return _ranking(spark, sf, target_time_min=250000.0).lookup


@query
def placement_lookups(spark, sf):
    rows = star.results(spark, sf)
    keys = ["season", "division", "gender"]
    targets = rows.select(*keys, (F.col("total_time_min") + 1000).alias("target_time_min"))
    return rankings.placement_lookups(rows, targets, keys)


@query
def location_bests(spark, sf):
    return _ranking(spark, sf).locations


# Menus


@query
def filter_menu(spark, sf):
    return menus.filter_menu(star.results(spark, sf), division="1-Urgent")


@query
def deepdive_menu(spark, sf):
    return menus.deepdive_menu(star.results(spark, sf), 1998, gender="f")


@query
def ranking_menu(spark, sf):
    return rankings.ranking_menu(star.results(spark, sf), 1998, "2-HIGH", "female", "Machinery")


@query
def list_races(spark, sf):
    return menus.list_races(star.results(spark, sf))


@query
def split_names(spark, sf):
    return menus.split_names(_splits(spark, sf))


@query
def divisions_per_event(spark, sf):
    return menus.divisions_per_event(star.results(spark, sf))


@query
def distinct_folded(spark, sf):
    return stats.distinct_folded(star.table(spark, sf, "part"), "p_name")


@query
def distinct_numbers(spark, sf):
    return stats.distinct_numbers(star.table(spark, sf, "part"), "p_size")


# Statistics


@query
def describe_seven(spark, sf):
    return stats.describe(star.results(spark, sf), ["season", "location"], "total_time_min")


@query
def describe_ranged(spark, sf):
    return stats.describe(star.results(spark, sf), ["age_group"], "total_time_min", hot_rows=FORCED * 2)


@query
def describe_five(spark, sf):
    return stats.describe(star.results(spark, sf), ["division"], "total_time_min", stats.FIVE_NUMBERS)


@query
def column_summary(spark, sf):
    return stats.describe_columns(star.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query
def histogram(spark, sf):
    return stats.histogram(star.results(spark, sf), ["location", "age_group"], "total_time_min")


@query
def histogram_labels(spark, sf):
    return stats.histogram(star.results(spark, sf), ["season"], "total_time_min", 30, label="nationality")


def _distribution(spark, sf):
    return segments.distribution(_wide(spark, sf), gender="female", division="5-low", metric="SkiErg")


@query
def distribution_stats(spark, sf):
    return _distribution(spark, sf).stats.drop("note")


@query
def distribution_bins(spark, sf):
    return _distribution(spark, sf).bins


def _planner(spark, sf):
    return segments.planner(_wide(spark, sf), season=1997, min_total_time=50000, max_total_time=400000)


@query
def planner_stats(spark, sf):
    return _planner(spark, sf).stats


@query
def planner_bins(spark, sf):
    return _planner(spark, sf).bins.drop("label", "segment_group", "position")


SUMMARY = ["segment", "label", "segment_group", "count", "min", "max", "mean", "median", "p10", "p90"]


@query
def race_summary(spark, sf):
    return segments.race_summary(_wide(spark, sf), 1996, "Asia").stats.select(*SUMMARY)


@query
def race_summary_counts(spark, sf):
    """How many results the numbers of a fastest share rest on, beside all of the race."""
    found = segments.race_summary(_wide(spark, sf), 1996, "Asia", top_percentile=10)
    return found.count.select("count", F.lit(found.total_count).alias("total_count"), F.lit(found.threshold).alias("threshold"))


@query
def race_summary_fastest(spark, sf):
    return segments.race_summary(_wide(spark, sf), 1996, "Asia", top_percentile=10).stats.select(*SUMMARY)


@query
def segment_averages_top(spark, sf):
    return segments.segment_averages(_wide(spark, sf), 1996, "Asia", top_n=100).stats.select(*SUMMARY)


@query
def segment_averages_bottom(spark, sf):
    return segments.segment_averages(_wide(spark, sf), 1996, "Asia", bottom_n=100).stats.select(*SUMMARY)


@query
def group_averages(spark, sf):
    return segments.segment_averages(_wide(spark, sf), 1996, "Asia", top_n=100).groups


@query
def fastest_share(spark, sf):
    return segments.fastest_share(star.results(spark, sf), ["season", "location"], 5).select("result_id", "threshold")


@query
def split_statistics(spark, sf):
    return report.split_distributions(_splits(spark, sf), ["location"])[0]


@query
def split_histograms(spark, sf):
    return report.split_distributions(_splits(spark, sf), ["location"])[1]


# Cohorts and the report


@query
def demographic_cohort(spark, sf):
    rows = star.results(spark, sf)
    picked = cohorts.pick_result(rows, ONE, COHORT_KEYS)
    return cohorts.demographic_cohort(rows, picked).select("result_id", "total_time_min")


def _winners(rows):
    return stats.first_n_in_group(rows, ["season", "location"], ["total_time_min", "result_id"], 1)


@query
def cohorts_of_winners(spark, sf):
    rows = star.results(spark, sf)
    return cohorts.cohorts_of(rows, _winners(rows)).select("result_id")


@query
def time_window_cohort(spark, sf):
    rows = star.results(spark, sf)
    picked = cohorts.pick_result(rows, ONE, [*COHORT_KEYS, "total_time_min"])
    return cohorts.time_window_cohort(rows, picked, WINDOW).select("result_id", "total_time_min")


def _window_standing(spark, sf, **options):
    slim = star.results(spark, sf).select("result_id", "season", "location", "total_time_min")
    placed = cohorts.time_window_standing(slim, WINDOW, **options)
    return placed.select("result_id", "window_size", "window_faster", "window_percentile")


@query
def time_window_standing(spark, sf):
    return _window_standing(spark, sf)


@query
def time_window_standing_ranged(spark, sf):
    return _window_standing(spark, sf, hot_rows=FORCED)


def _result_report(spark, sf):
    rows = _wide(spark, sf)
    splits = star.stored(spark, sf, "split_percentiles")
    return report.result_report(rows, star.stored(spark, sf, "race_rankings"), splits, ONE, WINDOW * 4)


@query
def report_race(spark, sf):
    return _result_report(spark, sf).race.select(
        "result_id", "name", "total_time_min", "event_rank", "event_size", "event_percentile", *report.STORED_RANKS
    )


@query
def report_cohort(spark, sf):
    return _result_report(spark, sf).cohort.select("result_id", "event_rank", "event_size", "event_percentile")


@query
def report_splits(spark, sf):
    return _result_report(spark, sf).splits


@query
def report_time_window(spark, sf):
    return _result_report(spark, sf).time_window.select("result_id", "total_time_min", "event_rank", "event_size", "event_percentile")


@query
def report_cohort_splits(spark, sf):
    return _result_report(spark, sf).cohort_splits.select("result_id", "split_name", "split_time_min", "split_rank")


@query
def report_window_splits(spark, sf):
    return _result_report(spark, sf).time_window_splits.select("result_id", "split_name", "split_time_min")


@query
def report_preview(spark, sf):
    """The first 50 rows of the time window by split, with the full count beside them."""
    rows, total = _bounded_report(spark, sf).window_splits_preview(50)
    return rows.select("result_id", "split_name", "split_time_min", F.lit(total.first().total).alias("total"))


def _bounded_report(spark, sf):
    rows = _wide(spark, sf)
    splits = star.stored(spark, sf, "split_percentiles")
    return report.BoundedReport(rows, star.stored(spark, sf, "race_rankings"), splits, ONE, WINDOW * 4, split_name="Run1")


@query
def report_stats(spark, sf):
    return _bounded_report(spark, sf).stats


@query
def report_bins(spark, sf):
    return _bounded_report(spark, sf).bins


@query
def report_markers(spark, sf):
    return _bounded_report(spark, sf).markers


def _requests(spark, sf):
    """Every result: the reports that are asked for together."""
    rows = _wide(spark, sf)
    asked = rows.select("result_id")
    return report.BatchReports(rows, star.stored(spark, sf, "split_percentiles"), asked, WINDOW * 4)


@query
def report_requests_stats(spark, sf):
    return _requests(spark, sf).cohort_stats


@query
def report_requests_bins(spark, sf):
    return _requests(spark, sf).cohort_bins


@query
def report_requests_markers(spark, sf):
    return _requests(spark, sf).markers


@query
def report_requests_window_stats(spark, sf):
    # The exact mean is rounded as a decimal, half up, before it becomes a double.
    stats = _requests(spark, sf).window_stats
    return stats.withColumn("mean", F.round("mean", 6).cast("double"))


@query
def report_requests_window_bins(spark, sf):
    return _requests(spark, sf).window_bins


@query
def report_requests_window_splits(spark, sf):
    return _requests(spark, sf).window_splits


@query
def work_run_split(spark, sf):
    rows = _wide(spark, sf)
    return rows.select("result_id", *report.work_run_split(rows))


@query
def run_change(spark, sf):
    return report.run_change(_wide(spark, sf)).drop("points")


@query
def run_change_points(spark, sf):
    # Runs come from the splits alone here.
    rows = star.results(spark, sf)
    points = report.run_change(rows, _splits(spark, sf)).select("result_id", F.inline("points"))
    return points


@query
def split_time_map(spark, sf):
    times = report.split_time_map(_splits(spark, sf)).select("result_id", F.map_entries("split_times").alias("e"))
    shown = F.transform("e", lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("decimal(18,3)").cast("string")))
    return times.select("result_id", F.size("e").alias("n"), shown.alias("split_times"))


@query
def percentile_series(spark, sf):
    # The window's percentile of a report, made up here from the cohort's; some are missing, some beyond the scale.
    splits = star.stored(spark, sf, "split_percentiles")
    window = F.when(F.col("result_id") % 3 != 0, F.col("split_percentile") * 1.5 - 0.2)
    return report.percentile_series(splits.withColumn("split_percentile_time_window", window))


@query
def cohort_distribution(spark, sf):
    # The histogram is asked for whether or not the result itself has the segment: at some scales it has none.
    return report.cohort_distribution(_wide(spark, sf), ONE, "sled push", marked=False)[1]


@query
def cohort_distribution_window(spark, sf):
    rows = _wide(spark, sf)
    return report.cohort_distribution(rows, ONE, "run2", mode="time_window", window_min=WINDOW * 4, marked=False)[1]


# Deep dive


@query
def location_stats(spark, sf):
    return deepdive.location_stats(star.results(spark, sf), ["division", "location"], "total_time_min")


def _dive(spark, sf):
    return deepdive.DeepDive(_wide(spark, sf), ONE, 1997, metric="total", age_group="Building")


@query
def deepdive_locations(spark, sf):
    return _dive(spark, sf).locations


@query
def deepdive_summary(spark, sf):
    return _dive(spark, sf).summary


@query
def deepdive_groups(spark, sf):
    return _dive(spark, sf).groups


@query
def deepdive_bins(spark, sf):
    return _dive(spark, sf).bins


@query
def deepdive_markers(spark, sf):
    return _dive(spark, sf).markers


@query
def deepdive_markers_floor(spark, sf):
    """The result with the shortest first run, which lies below what is believable at every scale but the smallest."""
    rows = _wide(spark, sf)
    first = rows.where("run1_time_min is not null").orderBy("run1_time_min", "result_id").first()
    return deepdive.DeepDive(rows, first.result_id, first.season, metric="run1", age_group="Building").markers


@query
def deepdive_deltas(spark, sf):
    found = _dive(spark, sf)
    deltas = deepdive.location_deltas(found.locations, found.athlete_value)
    return deltas.select("location", "stat_value", "delta", "delta_fastest")


@query
def tagged_groups(spark, sf):
    tagged = deepdive.tagged_groups(star.results(spark, sf), ["season"], "total_time_min", "result_id")
    return stats.describe(tagged, ["season", "grp"], "total_time_min", stats.FIVE_NUMBERS)


# Profiles


def _athlete_rows(spark, sf):
    rows = _wide(spark, sf)
    plain_rows = rows.drop("athlete_id", "nationality")
    return profile.athlete_races(plain_rows, star.links(rows), star.stored(spark, sf, "athlete_index")), plain_rows


def _profiles(spark, sf, **options):
    rows, results = _athlete_rows(spark, sf)
    return profile.Profiles(rows, results, **options)


@query
def profile_percentiles(spark, sf):
    rows = _wide(spark, sf)
    wanted = profile.metric_rows(rows, ["result_id", "division", "gender"])
    return profile.metric_percentiles(wanted, rows).select("result_id", "metric", "minutes", "percentile")


@query
def profile_bests(spark, sf):
    return _profiles(spark, sf).bests


@query
def profile_bests_division(spark, sf):
    return _profiles(spark, sf, division="2-High").bests


@query
def profile_one(spark, sf):
    rows = _wide(spark, sf)
    plain_rows = rows.drop("athlete_id", "nationality")
    return profile.profile(plain_rows, star.links(rows), star.stored(spark, sf, "athlete_index"), "11").bests


@query
def profile_averages(spark, sf):
    return _profiles(spark, sf).averages


@query
def profile_seasons(spark, sf):
    return _profiles(spark, sf).seasons


@query
def profile_summary(spark, sf):
    return _profiles(spark, sf).summary


@query
def profile_divisions(spark, sf):
    return _profiles(spark, sf).divisions


@query
def profile_headers(spark, sf):
    return profile.headers(star.results(spark, sf).withColumns(
        {"athlete_name": F.col("name"), "athlete_gender": F.col("gender"), "athlete_nationality": F.col("nationality")}
    ))


@query
def profile_races(spark, sf):
    return _profiles(spark, sf).races.select(
        "athlete_id", "result_id", "location", "year", "age_group_rank", "start_date", "total_time_min", "runplusroxzone_time_min"
    )


@query
def progression(spark, sf):
    return profile.progression(star.results(spark, sf)).drop("moment")


@query
def age_group_ranks(spark, sf):
    rows = star.results(spark, sf)
    return profile.age_group_ranks(rows, rows).select("result_id", "age_group_rank")


@query
def newest_per_athlete(spark, sf):
    rows = star.results(spark, sf).withColumn("athlete_name", F.col("name"))
    text_ids = rows.withColumn("athlete_id", F.col("athlete_id").cast("string"))
    newest = profile.newest_per_athlete(text_ids).select(F.col("athlete_id").cast("long").alias("athlete_id"), "result_id", "year")
    return newest


@query
def races_by_name(spark, sf):
    rows = star.results(spark, sf)
    people = star.stored(spark, sf, "athlete_index")
    return profile.races_by_canonical_name(rows, star.links(rows), people, " Customer#000000011 ").select(
        "result_id", "season", "event_name"
    )


@query
def athletes_named(spark, sf):
    rows = star.results(spark, sf)
    text_links = star.links(rows).withColumn("athlete_id", F.col("athlete_id").cast("string"))
    return profile.athletes_named(rows, text_links, "customer#000000011")


# Search


def _search(spark, sf, name, **options):
    rows = star.results(spark, sf)
    found = search.search_races(rows.drop("athlete_id", "nationality"), star.links(rows), star.stored(spark, sf, "athlete_index"), name, **options)
    return found.select("result_id", "athlete_id", "athlete_name")


@query
def search_exact(spark, sf):
    return _search(spark, sf, "000000011, customer")


@query
def search_contains(spark, sf):
    return _search(spark, sf, "000000013", match="contains", require_unique=False)


@query
def search_capped(spark, sf):
    """The first rows of a search with the full count beside them."""
    rows = star.results(spark, sf)
    found = search.search_races(
        rows.drop("athlete_id", "nationality"), star.links(rows), star.stored(spark, sf, "athlete_index"), "customer 000000013"
    )
    shown, total = search.capped(found.orderBy("result_id"), 4)
    return shown.select("result_id", F.lit(total.first().total).alias("total"))


@query
def shown_names(spark, sf):
    """A name of its own, else the one of the index."""
    own = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).when(F.col("o_orderkey") % 3 == 1, F.col("o_clerk_name"))
    orders = star.table(spark, sf, "orders").join(star.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    named = orders.withColumn("o_clerk_name", F.concat(F.lit("Clerk "), F.col("o_custkey")))
    return named.select("o_orderkey", text.shown_name(own, F.col("c_name")).alias("name"))


@query
def resolve_names(spark, sf):
    digits = F.replace("s_name", F.lit("Supplier#"), F.lit(""))
    whole = F.concat(digits, F.lit(", Customer"))
    asked = star.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("query_id"), F.when(F.col("s_suppkey") % 2 == 0, whole).otherwise(digits).alias("query")
    )
    people = star.results(spark, sf).select("athlete_id", F.col("name").alias("canonical_name")).distinct()
    return search.resolve_names(asked, people)


@query
def name_signatures(spark, sf):
    return star.table(spark, sf, "part").select(
        "p_partkey", text.signature(text.tokens(F.col("p_name"))).alias("signature"), text.plain(F.col("p_brand")).alias("brand_key")
    )


@query
def partners(spark, sf):
    people = star.table(spark, sf, "customer")
    kind, name, other = F.col("c_custkey") % 4, F.col("c_name"), F.col("c_mktsegment")
    pair = (
        F.when(kind == 0, F.concat(name, F.lit(" / "), other))
        .when(kind == 1, F.concat(name, F.lit(" and "), other))
        .when(kind == 2, F.concat(name, F.lit(", "), other))
        .otherwise(F.concat(name, F.lit(" a, "), other, F.lit(" b")))
    )
    # A single word after the comma is a first name, two words are another person.
    found = text.partners(pair)
    return people.select("c_custkey", F.size(found).alias("people"), found.alias("parts"))


# Comparison


@query
def compare_results(spark, sf):
    rows = _wide(spark, sf)
    pairs = star.results(spark, sf).groupBy(F.col("athlete_id").alias("pair_id")).agg(
        F.min("result_id").alias("base_id"), F.max("result_id").alias("other_id")
    )
    return compare.compare_results(rows, _splits(spark, sf), pairs)


@query
def segment_values(spark, sf):
    # Some splits and some columns are taken away, so that each source is the only one for some values.
    splits = _splits(spark, sf).where("NOT (split_name = 'run2' AND result_id % 2 = 0)")
    raised = splits.withColumn("split_time_min", F.col("split_time_min") + F.when(F.col("split_name") == "run3", 1.0).otherwise(0.0))
    rows = _wide(spark, sf).withColumn("skiErg_time_min", F.when(F.col("result_id") % 3 != 0, F.col("skiErg_time_min")))
    splits = raised.where("NOT (split_name = 'skiErg' AND result_id % 2 = 0)")
    return compare.segment_values(rows, splits, fill=0.0)


# Derived tables and checks


@query
def athletes(spark, sf):
    return derived.athletes(star.results(spark, sf))


@query
def athlete_results(spark, sf):
    return derived.athlete_results(star.results(spark, sf))


@query
def athlete_index(spark, sf):
    return derived.athlete_index(_wide(spark, sf))


@query
def contract_check(spark, sf):
    return contract.check_table(star.results(spark, sf), ["result_id", "age_group", "bib"], ["athlete_id", "season"])


@query
def roster_gate(spark, sf):
    return contract.roster_gate(star.results(spark, sf), 1.1)


@query
def manifest_races(spark, sf):
    return manifest.races(star.manifest(spark, sf))


@query
def manifest_first_entries(spark, sf):
    first = manifest.first_entries(star.manifest(spark, sf))
    return first.select("season", "location", manifest.object_key(F.col("path")).alias("path"))


def _wanted_races(spark, sf):
    """Race keys as they are, with the first letter lost, in a season and in a year that no race has."""
    rows = star.results(spark, sf).select("season", "location", "year").distinct()
    lost = F.expr("substring(location, 2)").alias("location")
    return (
        rows.unionAll(rows.select("season", lost, "year"))
        .unionAll(rows.select(F.col("season") + 100, "location", "year"))
        .unionAll(rows.select("season", "location", F.col("year") + 100))
        .distinct()
    )


@query
def missing_races(spark, sf):
    found = manifest.missing_races(_wanted_races(spark, sf), star.manifest(spark, sf))
    return found.select("season", "location", "year", "status")


@query
def race_suggestions(spark, sf):
    """The best suggestion for a name that lost its first letter is the name."""
    found = manifest.missing_races(_wanted_races(spark, sf), star.manifest(spark, sf))
    return found.where("status = 'no such location'").select("season", "location", "year", F.col("suggestions")[0].alias("suggestion"))


@query
def race_menus(spark, sf):
    return manifest.race_menus(star.manifest(spark, sf))


@query
def find_race(spark, sf):
    """The manifest entry of one race, read from its CSV file."""
    found = manifest.find_race(star.race_files(spark, sf)[1], 1996, "asia", 1996)
    return spark.createDataFrame([found], "season long, location string, path string, year long, file_last_modified string, line long").drop("line")


RACE = ["name", "gender", "division", "total_time", "run_time", "run1_time", "run2_time", "skiErg_time"]


@query
def get_race(spark, sf):
    base, listing = star.race_files(spark, sf)
    return races.get_race(spark, listing, 1996, "Asia", gender="F", total_time=(50.0, 200.0), base=base).select(*RACE)


@query
def get_season(spark, sf):
    base, listing = star.race_files(spark, sf)
    return races.get_season(spark, listing, 1997, division="2-HIGH", base=base).select(*RACE)


@query
def get_season_layout(spark, sf):
    base, _ = star.race_files(spark, sf)
    return races.get_season_layout(spark, f"{base}/files", 1997, locations=["europe", "Africa"]).select(*RACE)


@query
def get_season_places(spark, sf):
    base, listing = star.race_files(spark, sf)
    return races.get_season(spark, listing, 1997, locations=["europe", "Africa"], base=base).select(*RACE)


# Texts


@query
def clock_minutes(spark, sf):
    return star.clock_texts(spark, sf).select("event_id", "raw", durations.clock_minutes(F.col("raw")).alias("minutes"))


@query
def loose_minutes(spark, sf):
    return star.clock_texts(spark, sf).select("event_id", durations.loose_minutes(F.col("raw")).alias("minutes"))


@query
def duration_quality(spark, sf):
    return contract.duration_quality(star.clock_texts(spark, sf), ["raw"])


@query
def display_labels(spark, sf):
    value = F.col("value")
    return star.table(spark, sf, "events").select(
        "event_id",
        durations.clock_text(value).alias("clock"),
        durations.delta_text(value - 20).alias("delta"),
        labels.month_label(F.col("ts")).alias("month"),
        labels.percentile_band(value / 100).alias("band"),
        labels.top_percent(value / 100).alias("top"),
        labels.percent_fill(value / 100).alias("fill"),
    )


# Filters


@query
def open_interval(spark, sf):
    return star.results(spark, sf).where(filters.open_interval("total_time_min", (100000, 120000))).select("result_id")


@query
def closed_bounds(spark, sf):
    return star.results(spark, sf).where(filters.closed_bounds("total_time_min", 100000, 120000)).select("result_id")


@query
def cohort_filter(spark, sf):
    wanted = filters.cohort_filter(
        season=1997, year=1997, location=" Europe ", division="3-medium", gender="Female", age_group="FURNITURE"
    )
    return star.results(spark, sf).where(wanted).select("result_id")


@query
def null_safe_filter(spark, sf):
    return star.results(spark, sf).where(key_condition({"age_group": None, "location": "ASIA"})).select("result_id")


@query
def value_list(spark, sf):
    return star.results(spark, sf).where(F.col("event_name").isin("1996 ASIA", "1997 EUROPE")).select("result_id")


@query
def name_contains(spark, sf):
    return races.athlete_in_race(star.results(spark, sf), " R#0000001").select("result_id")


@query
def believable_runs(spark, sf):
    rows = _wide(spark, sf)
    return rows.where(filters.believable("run1_time_min")).select("result_id", "run1_time_min")


@query
def filter_overrides(spark, sf):
    """Cohort sizes of many base results: the division is overridden, the other filters are their own."""
    rows = star.results(spark, sf)
    return cohorts.override_sizes(rows, _winners(rows), {"division": "2-HIGH"})


@query
def typed_numbers(spark, sf):
    value = F.col("value").cast("decimal(10,2)").cast("string")
    raw = (
        F.when(F.col("event_type") == "click", "n/a").when(F.col("event_type") == "view", F.concat(F.lit("-"), value)).otherwise(value)
    )
    return star.table(spark, sf, "events").select("event_id", filters.positive(raw).alias("number"))


@query
def sql_query(spark, sf):
    star.table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    text_ = "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > ? GROUP BY l_returnflag"
    return warehouse.query(spark, text_, [25])


@query
def records_export(spark, sf):
    return warehouse.records(star.table(spark, sf, "nation"))


@query
def stack_races(spark, sf):
    # A frame per season; every second one lacks the run.
    rows = _wide(spark, sf)
    seasons = sorted(r.season for r in rows.select("season").distinct().collect())
    frames = [
        rows.where(F.col("season") == s).select("result_id", "season", *(["run1_time_min"] if s % 2 else [])) for s in seasons
    ]
    return races.stack_races(frames)


@query
def readable_columns(spark, sf):
    """Raw numbered columns with duration text, read as named minutes."""
    n = star.LINES
    lines = star.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        *[F.format_string("0:%02d:00", F.count_if(F.col("l_linenumber") == i)).alias(f"run_{i}") for i in n]
    )
    return races.readable(lines)


# Studies


@query
def fastest_part(spark, sf):
    return studies.fastest_part(star.results(spark, sf), "total_time_min", 0.25).select("result_id")


TRIMMED = ["run1_time_min", "run2_time_min", "skiErg_time_min", "run_time_min", "total_time_min"]


@query
def clean_times(spark, sf):
    rows = _wide(spark, sf)
    return studies.clean_times(rows, TRIMMED, "total_time_min", 0.01, 0.97).select("result_id")


ALL_TIMES = [*[f"run{n}_time_min" for n in star.LINES], *[f"{name}_time_min" for name, _ in STATIONS[: len(star.LINES)]], "run_time_min", "total_time_min"]


@query
def clean_times_all(spark, sf):
    """Every split column, as in a study; the tails are wide enough to leave results at every scale."""
    return studies.clean_times(_wide(spark, sf), ALL_TIMES, "total_time_min", 0.001, 0.995).select("result_id")


@query
def faster_than_mean(spark, sf):
    return studies.faster_than_mean(_wide(spark, sf), "run_time_min").select("result_id")


@query
def to_minutes(spark, sf):
    # Prices are far above any time in minutes, sums of scaled prices are not.
    rows = _wide(spark, sf).select("result_id", "total_time_min", "run_time_min")
    return studies.to_minutes(rows, ["total_time_min", "run_time_min"])


@query
def remainders(spark, sf):
    short = {c: c.removesuffix("_min") for c in ("work_time_min", "total_time_min", "run_time_min", "sledPush_time_min", "burpeeBroadJump_time_min")}
    named = _wide(spark, sf).withColumnsRenamed(short)
    return studies.with_remainders(named).select("result_id", "remaining_work", "remaining_time")


@query
def z_scores(spark, sf):
    scored = studies.z_scores(_wide(spark, sf), ["season", "location"], ["skiErg_time_min", "run1_time_min"])
    return scored.select("result_id", "skiErg_time_min_z", "run1_time_min_z")


@query
def station_shares(spark, sf):
    rows = _wide(spark, sf)
    there = [c for c in STATION_COLUMNS if c in rows.columns]
    return studies.shares(rows, there).select("result_id", *[f"{c}_share" for c in there])


@query
def average_rank_percentile(spark, sf):
    rows = star.results(spark, sf).select("result_id", "location", F.floor(F.col("total_time_min") / 1000).alias("p"))
    return studies.average_rank_percentile(rows, ["location"], "p").select("result_id", "percentile")


@query
def pace_buckets(spark, sf):
    return studies.pace_buckets(star.table(spark, sf, "events"), "value")


STUDIED = ["total_time_min", "work_time_min", "run_time_min", "roxzone_time_min"]


def _group_statistics(spark, sf):
    return studies.group_statistics(_wide(spark, sf), ["event_name", "gender"], STUDIED)


@query
def group_statistics(spark, sf):
    return _group_statistics(spark, sf)


@query
def large_groups(spark, sf):
    keys = ["event_name", "gender"]
    return studies.large_groups(_wide(spark, sf), keys, needed=[*keys, *STUDIED[:2]])


@query
def events_by_mean(spark, sf):
    return studies.events_by_mean(_group_statistics(spark, sf), "event_name", "run_time_min")


@query
def shared_histograms(spark, sf):
    return studies.shared_histograms(_wide(spark, sf), "event_name", "gender", STUDIED[:2], 20)


@query
def column_means(spark, sf):
    return studies.column_distributions(_wide(spark, sf), STUDIED)[0]


@query
def column_histograms(spark, sf):
    return studies.column_distributions(_wide(spark, sf), STUDIED)[1]


@query
def season_series(spark, sf):
    return profile.season_series(_profiles(spark, sf).seasons)


@query
def profile_by_name(spark, sf):
    rows = _wide(spark, sf)
    text_links = star.links(rows).withColumn("athlete_id", F.col("athlete_id").cast("string"))
    people = star.stored(spark, sf, "athlete_index").withColumn("athlete_id", F.col("athlete_id").cast("string"))
    found = profile.profile_by_name(rows.drop("athlete_id", "nationality"), text_links, people, "customer#000000011")
    return found.averages.drop("athlete_id")


def _regression(spark, sf):
    rows = _wide(spark, sf)
    return rows, studies.regression(
        rows, "run_time_min", "location", "sledPush_time_min", ["burpeeBroadJump_time_min"], "ASIA"
    )


@query
def location_regression(spark, sf):
    """Least squares with robust errors. Doubles are rounded to what both engines' sums agree on."""
    table = _regression(spark, sf)[1].coefficients
    return table.select("term", *[F.round(c, 4).alias(c) for c in ("coefficient", "robust_error", "z")])


@query
def location_predictions(spark, sf):
    rows, fitted = _regression(spark, sf)
    grid = studies.prediction_grid(
        rows, "location", "sledPush_time_min", ["burpeeBroadJump_time_min"], ["ASIA", "EUROPE", "AFRICA"]
    )
    predicted = fitted.predict(grid)
    return predicted.withColumns({c: F.round(c, 4) for c in ("sledPush_time_min", "burpeeBroadJump_time_min", "prediction")})


@query
def residual_checks(spark, sf):
    """What least squares must leave: per event no residual in sum, and none along the slope or the other column."""
    rows, fitted = _regression(spark, sf)
    off = F.col("run_time_min") - F.col("prediction")
    left = fitted.predict(rows.where("run_time_min is not null")).withColumn("off", off)
    return left.groupBy("location").agg(
        F.count("off").alias("n"),
        F.round(F.abs(F.sum("off")), 2).alias("sum"),
        F.round(F.abs(F.sum(off * F.col("sledPush_time_min"))), 2).alias("along_slope"),
    )
