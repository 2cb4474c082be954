"""Two results side by side, for one pair or a table of pairs."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions.durations import finite
from paceline.functions.text import plain
from paceline.operators.filters import has
from paceline.operators.joins import key_join
from paceline.operators.ordering import SHORT_LIST
from paceline.schema import RUN_COLUMNS, STATION_COLUMNS
from paceline.session import checkpointed

#: Rows that a task of a comparison sorts, on average.
TASK_ROWS = 500_000
#: Lines of a result that has every usual split: two totals, the splits.
LINES = 2 + len(RUN_COLUMNS) + len(STATION_COLUMNS)


def compare_results(
    results: DataFrame, splits: DataFrame, pairs: DataFrame, task_rows: int = TASK_ROWS, short_list: int = SHORT_LIST
) -> DataFrame:
    """Rows of a comparison per pair (`pair_id`, `base_id`, `other_id`): totals first, then every split.

    Both sides are fetched in one join and meet in one aggregation. A split that only one side has
    stays, without a difference. The last two parameters choose a plan and nothing else.
    """
    sides = F.array(
        F.struct(F.col("base_id").alias("result_id"), F.lit(True).alias("_base")),
        F.struct(F.col("other_id").alias("result_id"), F.lit(False).alias("_base")),
    )
    # Counted, and read by two joins.
    wanted = checkpointed(pairs.select("pair_id", F.inline(sides)))
    own = results.select("result_id", "total_time_min", "run_time_min", "roxzone_time_min")
    own_splits = splits.select("result_id", "split_name", "split_time_min")
    asked = wanted.count()
    if asked <= short_list:
        wanted = F.broadcast(wanted)
    else:
        own, own_splits, wanted = _parted(own, own_splits, wanted, asked, task_rows)
        wanted = wanted.hint("merge")
    run_total = finite(F.col("run_time_min")) + finite(F.col("roxzone_time_min"))
    totals = F.array(
        _line(F.lit("total_time"), F.lit("Total time"), finite(F.col("total_time_min"))),
        _line(F.lit("run_roxzone"), F.lit("Run + Roxzone"), run_total),
    )
    key = F.concat(F.lit("split-"), plain(F.col("split_name")))
    # Only the results that are asked for are taken apart, and only their names are made plain.
    lines = own.join(wanted, "result_id").select("pair_id", "_base", F.inline(totals)).unionByName(
        own_splits.join(wanted, "result_id")
        .select("pair_id", "_base", F.inline(F.array(_line(key, F.col("split_name"), finite(F.col("split_time_min"))))))
        .where(F.col("key") != "split-")
    )

    def of(base: bool, column: str):
        return F.max(F.when(F.col("_base") == base, F.col(column)))

    met = lines.groupBy("pair_id", "key").agg(
        F.coalesce(of(True, "label"), of(False, "label")).alias("label"),
        of(True, "minutes").alias("primary_value"),
        of(False, "minutes").alias("compare_value"),
    )
    return met.withColumn("delta", F.col("primary_value") - F.col("compare_value"))


def _parted(results: DataFrame, splits: DataFrame, wanted: DataFrame, asked: int, task_rows: int) -> list[DataFrame]:
    """The three tables in as many partitions by result as their rows, and the lines that are asked for, call for.

    Left alone, partitions are filled up to a size on disk, and a task's sorts take many times that in memory.
    """
    rows = results.count() + splits.count() + LINES * asked
    parts = max(ceil(rows / task_rows), results.sparkSession.sparkContext.defaultParallelism)
    return [table.repartition(parts, "result_id") for table in (results, splits, wanted)]


def _line(key, label, minutes):
    return F.struct(key.alias("key"), label.alias("label"), minutes.alias("minutes"))


def segment_values(results: DataFrame, splits: DataFrame, fill: float | None = None) -> DataFrame:
    """Run and station times per result: from the split, else from the wide column, else `fill`."""
    columns = [c for c in RUN_COLUMNS + STATION_COLUMNS if has(results, c)]
    # The splits of a result become one row before they are shuffled; the wide rows are taken apart after the join.
    key, split = plain(F.col("split_name")), finite(F.col("split_time_min"))
    named = splits.select("result_id", key.alias("_key"), split.alias("_split"))
    single = named.groupBy("result_id").agg(
        *[F.max(F.when(F.col("_key") == c.removesuffix("_time_min").lower(), F.col("_split"))).alias(f"_split_{c}") for c in columns]
    )
    joined = key_join(results.select("result_id", *columns), single, ["result_id"], "left")
    rest = [] if fill is None else [F.lit(float(fill))]
    segments = [
        F.struct(F.lit(c).alias("segment"), F.coalesce(F.col(f"_split_{c}"), finite(F.col(c)), *rest).alias("minutes")) for c in columns
    ]
    return joined.select("result_id", F.inline(F.array(*segments)))
