"""Studies over whole seasons: cleaning, scores, buckets, group statistics, regression."""

from __future__ import annotations

from dataclasses import dataclass
from math import erfc, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.errors import InvalidRequest
from paceline.functions.durations import finite
from paceline.operators.filters import positive
from paceline.operators.joins import all_of, key_join
from paceline.operators.ordering import HOT_ROWS, count_below, local_table, quantiles_in_group
from paceline.operators.stats import bin_index, bounded, describe, histogram
from paceline.schema import RUN_NUMBERS, STATIONS
from paceline.session import checkpointed

STATION_TIMES = [f"{name}_time" for name, _ in STATIONS]
SPLIT_TIMES = STATION_TIMES + [f"run{n}_time" for n in RUN_NUMBERS] + ["run_time", "total_time"]

# Fixed values of the studies.
LOW_CUT, HIGH_CUT = 0.0001, 0.99
SECONDS_ABOVE = 300
MIN_PER_GROUP = 20
PACE_EDGES = [0, 55, 60, 65, 70, 999]
PACE_LABELS = ["<55", "55-60", "60-65", "65-70", "70+"]
GRID_STEPS, GRID_LOW, GRID_HIGH = 50, 0.1, 0.9999
# End of fixed values.


def _whole(df: DataFrame) -> DataFrame:
    return df.withColumn("_all", F.lit(0))


def fastest_part(df: DataFrame, column: str = "total_time", share: float = 1.0, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Rows at or below a quantile of a column; rows without a number go."""
    number = finite(F.col(column))
    cut = quantiles_in_group(
        df.select(F.lit(0).alias("_all"), number.alias("_v")), ["_all"], "_v", {"cut": share}, hot_rows
    ).first()
    return df.withColumn(column, number).where(F.col(column) <= F.lit(None if cut is None else cut["cut"]))


def clean_times(
    df: DataFrame, columns: list[str], total: str = "total_time", low: float = LOW_CUT, high: float = HIGH_CUT
) -> DataFrame:
    """Drop impossible times, then cut both tails column by column.

    Each cut depends on the one before. The studied columns are written once; a cut then takes two counting passes
    over them, see `cut_points`, and nothing is sorted. Only two numbers come back per column; all of them become literal
    filters on the rows returned.
    """
    rows = df.withColumns({c: finite(F.col(c)) for c in columns})
    rows = rows.where(all_of([(F.col(c) > 0) & (F.col(c) <= F.col(total)) for c in columns]))
    slim = checkpointed(rows.select(*columns))
    ends = slim.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)]).first()
    for column in columns:
        if ends[f"min_{column}"] is None:
            return rows
        found = cut_points(slim, column, [low, high], ends[f"min_{column}"], ends[f"max_{column}"])
        if found is None:
            return rows
        kept = F.col(column).between(*found)
        slim, rows = slim.where(kept), rows.where(kept)
    return rows


#: Buckets of a counting pass, and the most values of a bucket that are listed.
BUCKETS, LISTED = 4_096, 50_000


def cut_points(df: DataFrame, column: str, shares: list[float], low: float, high: float) -> list[float] | None:
    """Exact interpolated quantiles of one column, by counting; None without values.

    `low` and `high` enclose the values. A pass counts the values per bucket, combined before the shuffle; the buckets
    that hold the wanted places are listed value by value, or counted again in finer buckets while they are too full
    for that. So a few thousand counts come to the driver in each pass, whatever the table holds.
    """
    value = F.col(column)

    def bucket(lo: float, hi: float) -> Column:
        return bin_index(value, F.lit(float(lo)), F.lit(float(hi)), BUCKETS)

    def counted(rows: DataFrame, lo: float, hi: float) -> list:
        found = rows.where(value.isNotNull()).groupBy(bucket(lo, hi).alias("b"))
        return sorted(found.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect())

    top = counted(df, low, high)
    total = sum(r.n for r in top)
    if not total:
        return None
    positions = [(total - 1) * s for s in shares]
    wanted = sorted({int(f(p)) for p in positions for f in (np.floor, np.ceil)})
    at: dict[int, float] = {}

    def resolve(rows: DataFrame, parts: list, lo: float, hi: float, before: int) -> None:
        """Find the values at the wanted places that lie in `parts`, of which `before` values come first."""
        listed, seen = [], before
        for part in parts:
            inside = [w for w in wanted if seen <= w < seen + part.n]
            if inside and part.lo == part.hi:
                at.update(dict.fromkeys(inside, part.lo))
            elif inside and part.n <= LISTED:
                listed.append((part.b, seen))
            elif inside:
                finer = rows.where(bucket(lo, hi) == part.b)
                resolve(finer, counted(finer, part.lo, part.hi), part.lo, part.hi, seen)
            seen += part.n
        if listed:
            cells = rows.where(bucket(lo, hi).isin([b for b, _ in listed])).groupBy(bucket(lo, hi).alias("b"), value.alias("v"))
            values = sorted(cells.agg(F.count(F.lit(1)).alias("n")).collect())
            for b, seen in listed:
                for cell in (v for v in values if v.b == b):
                    at.update({w: cell.v for w in wanted if seen <= w < seen + cell.n})
                    seen += cell.n

    resolve(df, top, low, high, 0)
    out = []
    for p in positions:
        below, above = at[int(np.floor(p))], at[int(np.ceil(p))]
        # Written as Spark's `percentile` does it.
        out.append(below if below == above else (np.ceil(p) - p) * below + (p - np.floor(p)) * above)
    return [float(x) for x in out]


def full_clean(df: DataFrame, columns: list[str] = SPLIT_TIMES, total: str = "total_time") -> DataFrame:
    return clean_times(fastest_part(df, total), columns, total)


def faster_than_mean(df: DataFrame, column: str) -> DataFrame:
    mean = df.agg(F.avg(column)).first()[0]
    return df.where(F.col(column) < F.lit(mean))


def to_minutes(df: DataFrame, columns: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Columns whose median is too large for minutes hold seconds: convert those."""
    numbers = df.withColumns({c: finite(F.col(c)) for c in columns})
    long = numbers.select(*columns).unpivot([], columns, "column", "_v")
    medians = {r["column"]: r["median"] for r in describe(long, ["column"], "_v", {"median": 0.5}, hot_rows).collect()}
    return numbers.withColumns({c: F.col(c) / 60 for c in columns if (medians.get(c) or 0) > SECONDS_ABOVE})


def with_remainders(df: DataFrame) -> DataFrame:
    """Time left when the studied stations, and the runs, are taken off."""
    stations = F.col("sledPush_time") + F.col("burpeeBroadJump_time")
    return df.withColumns(
        {
            "remaining_work": F.col("work_time") - stations,
            "remaining_time": F.col("total_time") - (stations + F.col("run_time")),
        }
    )


def z_scores(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Add `<column>_z` against mean and population deviation of the group; a constant column gives null."""
    spread = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    table, short = bounded(spread)
    scored = key_join(df, table, keys, broadcast=short)
    scores = {
        f"{c}_z": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") != 0, F.col(f"_s_{c}")) for c in columns
    }
    return scored.withColumns(scores).select(*df.columns, *scores)


def shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add `<column>_share`: the part of a row's own sum; missing times count as nothing in the sum."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns[1:]), F.coalesce(columns[0], F.lit(0.0)))
    return df.withColumns({f"{c}_share": F.col(c) / F.when(total != 0, total) for c in columns})


def average_rank_percentile(df: DataFrame, keys: list[str], column: str, out: str = "percentile", hot_rows=HOT_ROWS) -> DataFrame:
    """Rank over count, where equal values share the middle of their ranks."""
    timed = df.where(F.col(column).isNotNull())
    placed = count_below(timed, timed, keys, column, hot_rows)
    middle = F.col("below") + (F.col("equal") + 1) / 2
    return placed.withColumn(out, middle / F.col("total")).drop("below", "equal", "total")


def pace_bucket(value: Column, edges=PACE_EDGES, labels=PACE_LABELS) -> Column:
    """Buckets that include their upper edge; outside all of them is null."""
    bucket = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges, edges[1:], labels))):
        bucket = F.when((value > low) & (value <= high), label).otherwise(bucket)
    return bucket


def pace_buckets(df: DataFrame, column: str, edges=PACE_EDGES, labels=PACE_LABELS) -> DataFrame:
    return (
        df.groupBy(pace_bucket(F.col(column), edges, labels).alias("pace_bucket"))
        .agg(F.count(column).alias("count"), F.avg(column).alias("mean"))
        .where("pace_bucket is not null")
    )


def large_groups(df: DataFrame, keys: list[str], at_least: int = MIN_PER_GROUP, needed: list[str] = ()) -> DataFrame:
    """Group sizes (`n_used`) of the groups worth looking at, over the rows that have all `needed` columns."""
    used = df.where(all_of([F.col(c).isNotNull() for c in needed])) if needed else df
    return used.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_used")).where(F.col("n_used") >= at_least)


def group_statistics(
    df: DataFrame, keys: list[str], columns: list[str], at_least: int = MIN_PER_GROUP, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per group and column: count, mean, population deviation, median and interquartile range of positive times."""
    kept = key_join(df, large_groups(df, keys, at_least).select(*keys), keys, "left_semi")
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), positive(F.col(c)).alias("minutes")) for c in columns])
    long = kept.select(*keys, F.inline(cells)).where(F.col("minutes").isNotNull())
    ids = [*keys, "metric"]
    points = {"median": 0.5, "q1": 0.25, "q3": 0.75}
    spread = long.groupBy(*ids).agg(F.stddev_pop("minutes").alias("sd"))
    return key_join(quantiles_in_group(long, ids, "minutes", points, hot_rows), spread, ids).select(
        *ids, "count", "mean", "sd", "median", (F.col("q3") - F.col("q1")).alias("iqr")
    )


def shared_histograms(
    df: DataFrame, event: str, group: str, columns: list[str], bins: int, at_least: int = MIN_PER_GROUP
) -> DataFrame:
    """Histograms per event and group; the groups of an event share their edges.

    Only rows with key and all columns count. A group needs `at_least` of them; its values set the edges, all of them,
    but the bins count positive times, and a metric with fewer than `at_least` of these is left out.
    """
    there = [*columns, event, group]
    used = df.where(all_of([F.col(c).isNotNull() for c in there]))
    kept = key_join(used, large_groups(used, [event, group], at_least).select(event, group), [event, group], "left_semi")
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), finite(F.col(c)).alias("minutes")) for c in columns])
    long = kept.select(event, group, F.inline(cells))
    return histogram(
        long, [event, group, "metric"], "minutes", bins, shared=[event, "metric"], counted=F.col("minutes") > 0, at_least=at_least
    )


def column_distributions(df: DataFrame, columns: list[str], bins: int = 30) -> tuple[DataFrame, DataFrame]:
    """Mean and median, and the histogram, of each column."""
    long = df.select(*[finite(F.col(c)).alias(c) for c in columns]).unpivot([], columns, "metric", "minutes")
    stats = describe(long, ["metric"], "minutes", {"median": 0.5}).select("metric", "mean", "median")
    return stats, histogram(long, ["metric"], "minutes", bins)


def events_by_mean(stats: DataFrame, event: str, metric: str) -> DataFrame:
    """Events in the order of their mean of one metric over its groups."""
    return (
        stats.where(F.col("metric") == metric).groupBy(event).agg(F.avg("mean").alias("mean")).orderBy("mean", event)
    )


@dataclass
class Regression:
    """A fitted linear model with heteroscedasticity-robust (HC3) errors.

    `events` holds each event's own intercept and slope, `coefficients` the same model as differences from the
    reference event; neither passes through the driver.
    """

    event: str
    slope: str
    shared: dict[str, float]
    events: DataFrame
    coefficients: DataFrame

    def predict(self, df: DataFrame) -> DataFrame:
        """Add `prediction`; null for an event that the model has not seen."""
        own = self.events.select(F.col(self.event), F.col("intercept").alias("_a"), F.col("slope").alias("_b"))
        rest = sum((F.col(c) * value for c, value in self.shared.items()), F.lit(0.0))
        return (
            key_join(df, own, [self.event], "left")
            .withColumn("prediction", F.col("_a") + F.col("_b") * F.col(self.slope) + rest)
            .drop("_a", "_b")
        )


def regression(df: DataFrame, target: str, event: str, slope: str, others: list[str], reference: str) -> Regression:
    """Least squares of `target` on event, `slope` with its own slope per event, and `others`.

    Every event has an intercept and a slope of its own, so these are swept out by event: one pass takes means and
    covariances per event, and what is left to solve is a system as large as `others`. A second pass sums the
    squared errors that the HC3 errors need, again per event. Only sums over `others` come to the driver, whatever
    the number of events. An event whose slope column does not vary has the slope zero; where every row
    of an event decides its own fitted value, the event's errors are null.
    """
    names = [f"_x{i}" for i in range(len(others))]
    rows = df.where(all_of([F.col(c).isNotNull() for c in (target, event, slope, *others)])).select(
        F.col(event).alias("_event"),
        F.col(slope).cast("double").alias("_s"),
        F.col(target).cast("double").alias("_y"),
        *[F.col(c).cast("double").alias(n) for c, n in zip(others, names)],
    )
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    # One row per event; it is read again by the second pass, so it is written once.
    moments = checkpointed(
        rows.groupBy("_event").agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.avg(c).alias(f"_mean{c}") for c in ("_s", "_y", *names)],
            F.var_pop("_s").alias("_var"),
            *[F.covar_pop("_s", c).alias(f"_with{c}") for c in ("_y", *names)],
            *[F.covar_pop(c, "_y").alias(f"_y{c}") for c in names],
            *[F.covar_pop(a, b).alias(f"_of{a}{b}") for a, b in pairs],
        ).withColumns({f"_per{c}": F.when(F.col("_var") > 0, F.col(f"_with{c}") / F.col("_var")).otherwise(0.0) for c in ("_y", *names)})
    )
    base = moments.where(F.col("_event") == reference).first()
    if base is None:
        raise InvalidRequest(f"no rows for the reference event {reference!r}")

    k = len(names)
    n = F.col("_n")
    swept = [F.sum(n * (F.col(f"_of{a}{b}") - F.col(f"_per{a}") * F.col(f"_with{b}"))) for a, b in pairs]
    swept += [F.sum(n * (F.col(f"_y{c}") - F.col(f"_per{c}") * F.col("_with_y"))) for c in names]
    sums = moments.agg(*[c.alias(f"s{i}") for i, c in enumerate(swept or [F.lit(0)])]).first()
    gram = np.zeros((k, k))
    for (a, b), value in zip(pairs, sums):
        i, j = names.index(a), names.index(b)
        gram[i, j] = gram[j, i] = value
    inverse = np.linalg.inv(gram) if k else gram
    shared = inverse @ np.array(list(sums)[len(pairs) :], dtype=float) if k else np.zeros(0)

    own_slope = F.col("_per_y") - sum((F.col(f"_per{c}") * float(v) for c, v in zip(names, shared)), F.lit(0.0))
    fitted = moments.withColumn("slope", own_slope)
    fitted = fitted.withColumn(
        "intercept",
        F.col("_mean_y") - F.col("slope") * F.col("_mean_s") - sum((F.col(f"_mean{c}") * float(v) for c, v in zip(names, shared)), F.lit(0.0)),
    )

    # Second pass: residual, leverage, and the weight of each row. What is left of `others` is called `_r`.
    at = F.col("_s") - F.col("_mean_s")
    place = {f"_r{c}": F.col(c) - F.col(f"_mean{c}") - at * F.col(f"_per{c}") for c in names}
    joined = rows.join(fitted, "_event").withColumns(place)
    rest = [f"_r{c}" for c in names]
    lever = 1 / n + F.when(F.col("_var") > 0, at * at / (n * F.col("_var"))).otherwise(0.0)
    for i, a in enumerate(rest):
        for j, b in enumerate(rest):
            lever = lever + F.col(a) * F.col(b) * float(inverse[i, j])
    error = F.col("_y") - F.col("intercept") - F.col("slope") * F.col("_s")
    error = error - sum((F.col(c) * float(v) for c, v in zip(names, shared)), F.lit(0.0))
    step = F.when(F.col("_var") > 0, at / (n * F.col("_var"))).otherwise(0.0)
    # A row that decides its own fitted value has no residual to weigh.
    free = F.when(1 - lever > 1e-9, 1 - lever)
    weighted = joined.select(
        "_event", *rest, step.alias("_d"), (1 / n - F.col("_mean_s") * step).alias("_p"), ((error / free) ** 2).alias("_w")
    )
    w = F.col("_w")
    parts = weighted.groupBy("_event").agg(
        F.sum(w * F.col("_d") * F.col("_d")).alias("_dd"),
        F.sum(w * F.col("_p") * F.col("_p")).alias("_pp"),
        *[F.sum(w * F.col("_d") * F.col(r)).alias(f"_d{r}") for r in rest],
        *[F.sum(w * F.col("_p") * F.col(r)).alias(f"_p{r}") for r in rest],
        *[F.sum(w * F.col(a) * F.col(b)).alias(f"_w{i}_{j}") for i, a in enumerate(rest) for j, b in enumerate(rest)],
    )
    events = checkpointed(fitted.join(parts, "_event"))
    meat = events.agg(F.lit(0).alias("none"), *[F.sum(f"_w{i}_{j}").alias(f"w{i}_{j}") for i in range(k) for j in range(k)]).first()
    meat = np.array(list(meat)[1:], dtype=float).reshape(k, k)
    spread = inverse @ meat @ inverse

    def columns(row_of, kind: str) -> tuple[list, list]:
        """How a coefficient of an event leans on the shared ones, and its weighted sums with them."""
        if kind == "slope":
            return [row_of(f"_per{c}") for c in names], [row_of(f"_d{r}") for r in rest]
        lean = [row_of(f"_mean{c}") - row_of("_mean_s") * row_of(f"_per{c}") for c in names]
        return lean, [row_of(f"_p{r}") for r in rest]

    def variance(kind: str, against: bool) -> Column:
        lean, cross = columns(F.col, kind)
        own = F.col("_dd" if kind == "slope" else "_pp")
        if against:
            base_row = events.where(F.col("_event") == reference).first()
            base_lean, base_cross = columns(lambda c: float(base_row[c]), kind)
            own = own + float(base_row["_dd" if kind == "slope" else "_pp"])
            lean = [a - b for a, b in zip(lean, base_lean)]
            cross = [a - b for a, b in zip(cross, base_cross)]
        for i in range(k):
            for j in range(k):
                own = own - 2 * float(inverse[i, j]) * lean[i] * cross[j] + float(spread[i, j]) * lean[i] * lean[j]
        return own

    is_base = F.col("_event") == reference
    name = F.col("_event").cast("string")
    base_row = fitted.where(is_base).first()
    cells = [
        (F.when(is_base, F.lit("intercept")).otherwise(name), "intercept", variance("intercept", False), variance("intercept", True)),
        (F.when(is_base, F.lit(slope)).otherwise(F.concat(name, F.lit(f":{slope}"))), "slope", variance("slope", False), variance("slope", True)),
    ]
    structs = [
        F.struct(
            term.alias("term"),
            (F.col(kind) - F.when(is_base, 0.0).otherwise(float(base_row[kind]))).alias("coefficient"),
            F.sqrt(F.when(is_base, alone).otherwise(both)).alias("robust_error"),
        )
        for term, kind, alone, both in cells
    ]
    table = events.select(F.inline(F.array(*structs)))
    if k:
        rows_of = [{"term": c, "coefficient": float(v), "robust_error": float(np.sqrt(spread[i, i]))} for i, (c, v) in enumerate(zip(others, shared))]
        table = table.unionByName(local_table(df, rows_of, "term string, coefficient double, robust_error double"))
    table = table.withColumn("z", F.col("coefficient") / F.nullif(F.col("robust_error"), F.lit(0.0)))
    coefficients = table.withColumn("p_value", _two_sided(F.col("z")))
    return Regression(
        event, slope, dict(zip(others, map(float, shared))), events.select(F.col("_event").alias(event), "intercept", "slope"), coefficients
    )


@F.pandas_udf(T.DoubleType())
def _two_sided(z: pd.Series) -> pd.Series:
    """Chance of a normal value at least that far out; one row per coefficient."""
    return z.map(lambda v: erfc(abs(v) / sqrt(2)), na_action="ignore")


def prediction_grid(
    df: DataFrame,
    event: str,
    slope: str,
    others: list[str],
    events: list[str],
    low_percent: float | dict[str, float] = 0.1,
    steps: int = GRID_STEPS,
) -> DataFrame:
    """Rows to predict: evenly spaced `slope` values per event, the others at a low percentile of the event.

    `low_percent` is one percentile for all of the others, or one for each.
    """
    low = {c: low_percent[c] if isinstance(low_percent, dict) else low_percent for c in others}
    ends = quantiles_in_group(
        _whole(df).select("_all", slope), ["_all"], slope, {"low": GRID_LOW, "high": GRID_HIGH}
    ).first()
    long = df.where(F.col(event).isin(events)).select(event, *others).unpivot(event, others, "column", "_v")
    points = {f"at{i}": low[c] / 100 for i, c in enumerate(others)}
    level = quantiles_in_group(long, [event, "column"], "_v", points)
    chosen = [F.max(F.when(F.col("column") == c, F.col(f"at{i}"))).alias(c) for i, c in enumerate(others)]
    fixed = level.groupBy(event).agg(*chosen)
    step = (ends["high"] - ends["low"]) / (steps - 1)
    return fixed.select(
        event, *others, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")
    ).withColumn(slope, F.lit(ends["low"]) + F.col("step") * step)
