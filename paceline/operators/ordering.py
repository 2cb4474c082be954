"""Ranks, running totals and exact quantiles inside groups of very different size.

A window or a `percentile` aggregate puts each group into one task. That is right for the many
small groups and wrong for a group that holds a large part of the table. So the group sizes are
counted first (one narrow pass, combined before the shuffle) and only the large groups take the
other way: their rows are sorted by range over all tasks and numbered across partitions. Both ways
give the same result, so the limits below choose a plan and nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.operators.joins import key_join
from paceline.session import checkpointed

#: A group with more rows than this is not given to a single task.
HOT_ROWS = 1_000_000
#: A list of groups is broadcast if it has at most this many rows; a longer one is joined by a shuffle.
SHORT_LIST = 100_000

_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
_BEFORE_HERE = (Window.unboundedPreceding, -1)


@dataclass
class HotGroups:
    """The large groups of a table."""

    keys: list[str]
    table: DataFrame
    rows: int
    limit: int
    short: bool = True


def hot_groups(df: DataFrame, keys: list[str], hot_rows: int | None = HOT_ROWS) -> HotGroups | None:
    """The groups with more than `hot_rows` rows, or None if there are none.

    All of them are kept. Each holds more than `hot_rows` rows, so the list is that much shorter than the
    table; a short one is brought to the driver and broadcast, a longer one is written and joined by a shuffle.
    A caller that has counted already, and knows that no group is large, passes `hot_rows=None`.
    """
    if hot_rows is None:
        return None
    return hot_among(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys, hot_rows)


def hot_among(sizes: DataFrame, keys: list[str], hot_rows: int) -> HotGroups | None:
    """The same from a table of group sizes (`keys`, `_n`) that a caller has already."""
    large = sizes.where(F.col("_n") > hot_rows)
    listed = large.limit(SHORT_LIST + 1).toArrow()
    if listed.num_rows == 0:
        return None
    if listed.num_rows <= SHORT_LIST:
        return HotGroups(keys, local_table(sizes, listed, large.schema).drop("_n"), sum(listed["_n"].to_pylist()), hot_rows)
    large = checkpointed(large)
    return HotGroups(keys, large.drop("_n"), large.agg(F.sum("_n")).first()[0], hot_rows, short=False)


def local_table(df: DataFrame, rows, schema) -> DataFrame:
    """A short Arrow table, or list of dicts, as a relation whose size Spark knows when it plans."""
    if isinstance(rows, list):
        rows = pa.Table.from_pylist(rows)
    return df.sparkSession.createDataFrame(rows, schema)


def split_hot(df: DataFrame, hot: HotGroups) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary groups, rows of large groups."""
    return (
        key_join(df, hot.table, hot.keys, "left_anti", broadcast=hot.short),
        key_join(df, hot.table, hot.keys, "left_semi", broadcast=hot.short),
    )


def running_total(
    df: DataFrame, keys: list[str], order: list[str], weight: str, out: str, hot: HotGroups | None
) -> DataFrame:
    """Add `out`, the sum of `weight` from the start of the group to this row, and `<out>_all`, that of the group.

    `keys + order` must identify a row, or the order among equal rows is arbitrary.
    """
    return running_totals(df, keys, order, {out: weight}, hot)


def running_totals(
    df: DataFrame, keys: list[str], order: list[str], totals: dict[str, str], hot: HotGroups | None
) -> DataFrame:
    """`running_total` of several weights (`totals`: out to weight) in one order, sorted once."""
    if hot is None:
        return _windowed_total(df, keys, order, totals)
    ordinary, large = split_hot(df, hot)
    return _windowed_total(ordinary, keys, order, totals).unionByName(_ranged_total(large, hot, order, totals))


def _windowed_total(df, keys, order, totals):
    group = Window.partitionBy(*keys)
    here = group.orderBy(*order).rowsBetween(*_UP_TO_HERE)
    sums = {out: F.sum(weight).over(here) for out, weight in totals.items()}
    return df.withColumns({**sums, **{f"{out}_all": F.sum(weight).over(group) for out, weight in totals.items()}})


def _ranged_total(df, hot, order, totals, tied=None):
    """Running totals over a range-sorted table.

    Every partition gets a like share of the rows whatever the groups are. A total runs through each
    partition; the partitions before it and the groups before it are added and taken off. The sorted
    table is written out first because a second sampling of the ranges could cut elsewhere.
    How many partitions there are follows from the rows, not from how small a group may be and still come here.

    With `tied`, the first columns of `order`, `_first` is added: the place in its group of the first row equal in them.
    """
    keys = hot.keys
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(2 * hot.rows / max(hot.limit, HOT_ROWS)))
    ranged = checkpointed(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))

    # One row per partition and one per large group, so they may be summed in one task.
    ahead = Window.orderBy("_part").rowsBetween(*_BEFORE_HERE)
    groups = Window.orderBy(*keys).rowsBetween(*_BEFORE_HERE)

    def before(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window), F.lit(0))

    sums = [F.sum(weight).alias(f"{out}_all") for out, weight in totals.items()]
    leads = [before(f"{out}_all", ahead).alias(f"_lead_{out}") for out in totals]
    before_part = ranged.groupBy("_part").agg(*sums).select("_part", *leads)
    before_group = ranged.groupBy(*keys).agg(*sums, F.count(F.lit(1)).alias("_rt_size")).select(
        *keys,
        *[before(f"{out}_all", groups).alias(f"_skip_{out}") for out in totals],
        *[f"{out}_all" for out in totals],
        before("_rt_size", groups).alias("_rt_skip"),
    )
    inside = Window.partitionBy("_part").orderBy(*keys, *order).rowsBetween(*_UP_TO_HERE)
    local = ranged.withColumns({f"_local_{out}": F.sum(weight).over(inside) for out, weight in totals.items()})
    if tied:
        before_part = before_part.join(_carried_ties(ranged, [*keys, *tied], ahead), "_part")
        local = local.withColumn("_rt_tie", F.rank().over(Window.partitionBy("_part").orderBy(*keys, *tied)))
    placed = key_join(local.join(F.broadcast(before_part), "_part"), before_group, keys, "inner", broadcast=hot.short)
    found = [(F.col(f"_lead_{out}") + F.col(f"_local_{out}") - F.col(f"_skip_{out}")).alias(out) for out in totals]
    if tied:
        # Rows equal to the first row of their partition may have started earlier.
        started = F.when(F.col("_rt_tie") == 1, F.col("_rt_start"))
        found.append((F.coalesce(started, F.col("_rt_rows") + F.col("_rt_tie")) - F.col("_rt_skip")).alias("_first"))
    return placed.select(*df.columns, *found, *[f"{out}_all" for out in totals])


def _carried_ties(ranged, columns, ahead):
    """Per partition the rows before it and `_rt_start`, the place in the table of the first row equal to its first row;
    null if that row is the partition's own."""
    equal = F.struct(*columns)
    ends = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rt_n"), F.min(equal).alias("_rt_head"), F.max(equal).alias("_rt_tail"))
    under = (
        ranged.join(F.broadcast(ends.select("_part", "_rt_tail")), "_part")
        .groupBy("_part")
        .agg(F.count_if(~equal.eqNullSafe(F.col("_rt_tail"))).alias("_rt_under"))
    )
    went_on = F.col("_rt_head").eqNullSafe(F.lag("_rt_tail").over(Window.orderBy("_part")))
    told = ends.join(under, "_part").select(
        "_part", "_rt_under", went_on.alias("_rt_went_on"), F.coalesce(F.sum("_rt_n").over(ahead), F.lit(0)).alias("_rt_rows")
    )
    # A partition that holds one value only, begun before it, starts nothing.
    starts = F.when(~F.col("_rt_went_on") | (F.col("_rt_under") > 0), F.col("_rt_rows") + F.col("_rt_under") + 1)
    told = told.withColumn("_rt_begun", starts)
    return told.select("_part", "_rt_rows", F.when(F.col("_rt_went_on"), F.last("_rt_begun", ignorenulls=True).over(ahead)).alias("_rt_start"))


def rank_in_group(
    df: DataFrame, keys: list[str], value: str, tiebreak: str, prefix: str, hot_rows: int | HotGroups | None = HOT_ROWS
) -> DataFrame:
    """Add `<prefix>_rank`, `_size` and `_percentile` (1 is fastest, equal values share one percentile).

    Rows without a value must be removed by the caller; they take no part in a ranking. A caller that
    has the large groups already passes them in place of the limit.
    """
    names = [f"{prefix}_rank", f"{prefix}_size", f"{prefix}_percentile"]
    hot = hot_rows if isinstance(hot_rows, HotGroups) else hot_groups(df, keys, hot_rows)
    if hot is None:
        return _windowed_rank(df, keys, value, tiebreak, names)
    ordinary, large = split_hot(df, hot)
    return _windowed_rank(ordinary, keys, value, tiebreak, names).unionByName(
        _ranged_rank(large, hot, value, tiebreak, names)
    )


def _windowed_rank(df, keys, value, tiebreak, names):
    group = Window.partitionBy(*keys)
    return df.withColumns(
        {
            names[0]: F.row_number().over(group.orderBy(value, tiebreak)).cast("long"),
            names[1]: F.count(F.lit(1)).over(group),
            names[2]: 1 - F.percent_rank().over(group.orderBy(value)),
        }
    )


def _ranged_rank(df, hot, value, tiebreak, names):
    rank, size, percentile = names
    placed = _ranged_total(df.withColumn("_one", F.lit(1)), hot, [value, tiebreak], {rank: "_one"}, tied=[value])
    share = 1 - (F.col("_first") - 1) / (F.col(size) - 1)
    return (
        placed.withColumnRenamed(f"{rank}_all", size)
        .withColumn(percentile, F.when(F.col(size) == 1, 1.0).otherwise(share))
        .drop("_one", "_first")
    )


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How often each value occurs in each group: equal values are combined before the shuffle."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))


def count_below(
    values: DataFrame, probes: DataFrame, keys: list[str], value: str, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """For each probe: `below` and `equal` (values of its group under it, and on it) and `total`.

    Works by sorting values and probes together, so no value is paired with a probe; equal ones become
    one row before the shuffle. A probe whose group has no values gets zeros.
    """
    hot = hot_groups(values.select(*keys).unionAll(probes.select(*keys)), keys, hot_rows)
    marks = values.select(*keys, value, F.lit(1).alias("_n"), F.lit(False).alias("_asked")).unionAll(
        probes.select(*keys, value, F.lit(0).alias("_n"), F.lit(True).alias("_asked"))
    )
    merged = (
        marks.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.sum("_n").alias("_n"), F.max("_asked").alias("_asked"))
    )
    answers = running_total(merged, keys, [value], "_n", "total", hot).where("_asked")
    found = answers.select(
        *keys, value, (F.col("total") - F.col("_n")).alias("below"), F.col("_n").alias("equal"), F.col("total_all").alias("total")
    )
    return key_join(probes, found, [*keys, value], "left")


def count_before(
    values: DataFrame, probes: DataFrame, keys: list[str], value: str, out: str, upto: str, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Each probe row with `out`: the values of its group under it, or not over it where the column `upto` is true.

    Probes carry their columns through the one sort and are not joined back, so each is shuffled once. Equal values are
    combined before that. A probe whose group has no values gets zero, a null probe null.
    """
    counted = value_counts(values.where(F.col(value).isNotNull()).select(*keys, value), keys, value)
    marks = counted.withColumn("_kind", F.lit(1)).unionByName(
        probes.where(F.col(value).isNotNull()).withColumns(
            {"_n": F.lit(0).cast("long"), "_kind": F.when(F.col(upto), F.lit(2)).otherwise(F.lit(0))}
        ),
        allowMissingColumns=True,
    )
    hot = hot_groups(counted.select(*keys).unionAll(probes.select(*keys)), keys, hot_rows)
    placed = running_total(marks, keys, [value, "_kind"], "_n", out, hot).where(F.col("_kind") != 1)
    missing = probes.where(F.col(value).isNull()).withColumn(out, F.lit(None).cast("long"))
    return placed.select(*probes.columns, out).unionByName(missing)


#: Most probes that `count_below_few` carries to every task.
FEW_PROBES = 1_000


def count_below_few(
    values: DataFrame, probes: DataFrame, keys: list[str], value: str, hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """`count_below` for a handful of probes: the values are only counted, not moved.

    The probes of a group travel as one sorted list. Each value is counted under its position in
    that list, which is combined before the shuffle, so what is shuffled is as small as the probes.
    """
    asked = probes.select(*keys, value).where(F.col(value).isNotNull()).distinct().limit(FEW_PROBES + 1)
    listed = asked.toArrow()
    if listed.num_rows > FEW_PROBES:
        return count_below(values, probes, keys, value, hot_rows)
    table = local_table(values, listed, asked.schema)
    lists = table.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_list"))
    at = F.size(F.filter("_list", lambda probe: probe <= F.col(value)))
    counts = (
        key_join(values.where(F.col(value).isNotNull()), lists, keys, broadcast=True)
        .select(*keys, at.alias("_at"), (F.get("_list", at - 1) == F.col(value)).alias("_on"))
        .groupBy(*keys, "_at")
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if("_on").alias("_equal"))
    )
    places = lists.select(*keys, F.posexplode("_list").alias("_place", value))
    found = (
        key_join(places, counts, keys, "left", broadcast=False)
        .groupBy(*keys, value)
        .agg(
            F.sum(F.when(F.col("_at") <= F.col("_place"), F.col("_n")).otherwise(0)).alias("below"),
            F.sum(F.when(F.col("_at") == F.col("_place") + 1, F.col("_equal")).otherwise(0)).alias("equal"),
            F.coalesce(F.sum("_n"), F.lit(0)).alias("total"),
        )
    )
    return key_join(probes, found, [*keys, value], "left")


def standing(below: Column, total: Column) -> Column:
    """Percentile of a value with `below` faster ones among `total`: 1 is fastest, null without a cohort."""
    return F.when(total == 1, 1.0).when(total > 1, 1 - below / (total - 1))


def quantiles_in_group(
    df: DataFrame, keys: list[str], value: str, points: dict[str, float], hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Count, min, max, mean and exact interpolated quantiles per group; nulls are ignored."""
    clean = df.where(F.col(value).isNotNull()).select(*keys, value)
    hot = hot_groups(clean, keys, hot_rows)
    if hot is None:
        return _aggregated_quantiles(clean, keys, value, points)
    ordinary, large = split_hot(clean, hot)
    return _aggregated_quantiles(ordinary, keys, value, points).unionByName(
        _ranged_quantiles(large, hot, value, points)
    )


def _aggregated_quantiles(df, keys, value, points):
    names = list(points)
    summary = df.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
        *([F.percentile(value, [points[n] for n in names]).alias("_q")] if names else []),
    )
    return summary.select(
        *keys, "count", "min", "max", "mean", *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(names)]
    )


def _ranged_quantiles(df, hot, value, points):
    keys = hot.keys
    counted = _ranged_total(value_counts(df, keys, value), hot, [value], {"_upto": "_n"})
    summary = df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean")
    )
    placed = counted.withColumnRenamed("_upto_all", "count")

    def at(position: Column) -> Column:
        covers = (F.col("_upto") > position) & (F.col("_upto") - F.col("_n") <= position)
        return F.max(F.when(covers, F.col(value)))

    picks = []
    for name, share in points.items():
        position = (F.col("count") - 1) * F.lit(share)
        picks += [at(F.floor(position)).alias(f"_lo_{name}"), at(F.ceil(position)).alias(f"_hi_{name}")]
    picked = placed.groupBy(*keys).agg(*picks) if picks else placed.select(*keys).distinct()
    result = key_join(summary, picked, keys, "inner", broadcast=hot.short)
    for name, share in points.items():
        position = (F.col("count") - 1) * F.lit(share)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        # Written as Spark's `percentile` does it, so that both ways agree to the last bit.
        between = (F.ceil(position) - position) * low + (position - F.floor(position)) * high
        result = result.withColumn(name, F.when(low == high, low).otherwise(between))
    return result.select(*keys, "count", "min", "max", "mean", *points)
