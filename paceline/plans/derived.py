"""Tables of the warehouse that follow from the results."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions.text import stable_id
from paceline.operators.filters import has
from paceline.operators.ordering import HOT_ROWS, HotGroups, hot_among, rank_in_group
from paceline.schema import COHORT_KEYS, OVERALL_KEYS, RUN_COLUMNS, SEASON_KEYS, STATION_COLUMNS
from paceline.session import checkpointed


def race_rankings(results: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Event, season and overall ranks of every timed result.

    Only ids, keys and times are carried. The narrowest cohorts go first: in the other order Spark
    would keep the few overall cohorts together and rank everything in a handful of tasks. Group sizes are counted
    once, for the narrowest cohorts; each family of cohorts splits the next, so the wider ones are sums of these.
    """
    timed = results.where(F.col("total_time_min").isNotNull()).select("result_id", *COHORT_KEYS, "total_time_min")
    families = ((COHORT_KEYS, "event"), (SEASON_KEYS, "season"), (OVERALL_KEYS, "overall"))
    hot: dict[str, HotGroups | None] = dict.fromkeys(prefix for _, prefix in families)
    if hot_rows is not None:
        sizes = checkpointed(timed.groupBy(*COHORT_KEYS).agg(F.count(F.lit(1)).alias("_n")))
        for keys, prefix in families[::-1]:
            hot[prefix] = hot_among(sizes.groupBy(*keys).agg(F.sum("_n").alias("_n")), keys, hot_rows)
            if hot[prefix] is None:
                # If no wider cohort is large, no narrower one is.
                break
    if any(hot.values()):
        # Read several times where rows are range-sorted: split, sampled, shuffled.
        timed = checkpointed(timed)
    ranked = timed
    for keys, prefix in families:
        ranked = rank_in_group(ranked, keys, "total_time_min", "result_id", prefix, hot[prefix])
        if hot[prefix] is not None:
            # Ranked over range-sorted data: written once, or the next family would sort it again.
            ranked = checkpointed(ranked)
    # The season stays: the table is partitioned by it.
    return ranked.drop(*[k for k in COHORT_KEYS if k != "season"], "total_time_min")


def splits_of(results: DataFrame) -> DataFrame:
    """One row per result and split, named after the wide column. Rows stay where they are, and partitioned as they are."""
    columns = [c for c in RUN_COLUMNS + STATION_COLUMNS if has(results, c)]
    ids = ["result_id", *(["event_id"] if has(results, "event_id") else []), *COHORT_KEYS]
    splits = [F.struct(F.lit(c.removesuffix("_time_min")).alias("split_name"), F.col(c).alias("split_time_min")) for c in columns]
    return results.select(*ids, F.inline(F.array(*splits))).where("split_time_min is not null")


def split_percentiles(splits: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Rank, size and percentile of every split among the same split of the cohort."""
    return rank_in_group(splits, [*COHORT_KEYS, "split_name"], "split_time_min", "result_id", "split", hot_rows)


def split_percentiles_of(results: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same from the results: where no cohort is large, its results are shuffled and then taken apart, not its splits."""
    columns = [c for c in RUN_COLUMNS + STATION_COLUMNS if has(results, c)]
    sizes = results.groupBy(*COHORT_KEYS).agg(F.count(F.lit(1)).alias("_n"))
    largest, total = sizes.agg(F.max("_n"), F.sum("_n")).first()
    if not total or largest * len(columns) > hot_rows:
        return split_percentiles(splits_of(results), hot_rows)
    parts = max(int(results.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(total * len(columns) / hot_rows))
    return split_percentiles(splits_of(results.repartition(parts, *COHORT_KEYS)), None)


def _identified(results: DataFrame) -> DataFrame:
    name = F.lower(F.trim("name_raw" if has(results, "name_raw") else "name"))
    return results.withColumn("canonical_name", name).withColumn(
        "athlete_id", stable_id(F.col("canonical_name"), F.col("gender"), F.col("nationality"))
    )


def athletes(results: DataFrame) -> DataFrame:
    """One row per canonical name, gender and nationality."""
    return _identified(results).select("athlete_id", "canonical_name", "gender", "nationality").distinct()


def athlete_results(results: DataFrame) -> DataFrame:
    """Which result belongs to which athlete."""
    return _identified(results).select(
        "athlete_id", "result_id", F.lit(1.0).alias("link_confidence"), F.lit("exact_key").alias("link_method")
    )


def athlete_index(results: DataFrame) -> DataFrame:
    """The search index: one row per athlete with counts and averages."""
    ratio = F.col("run_time_min") / F.nullif(F.col("total_time_min"), F.lit(0.0)) if has(results, "run_time_min") else F.lit(None)
    return (
        _identified(results)
        .groupBy("athlete_id", "canonical_name", "gender", "nationality")
        .agg(
            F.count(F.lit(1)).cast("int").alias("race_count"),
            F.avg("total_time_min").alias("avg_total_time"),
            F.avg(ratio.cast("double")).alias("avg_run_ratio"),
        )
        .withColumn("name_lc", F.lower("canonical_name"))
    )


def build_info(df: DataFrame, schema_version: int, source: str) -> DataFrame:
    return df.sparkSession.range(1).select(
        F.lit(schema_version).alias("schema_version"), F.current_timestamp().alias("built_at"), F.lit(source).alias("source")
    )
