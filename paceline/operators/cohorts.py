"""Reference populations: who a result is compared with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.errors import InvalidRequest, NotFound
from paceline.operators.joins import all_of, key_condition, key_join
from paceline.operators.ordering import HOT_ROWS, hot_groups, running_total, standing, value_counts
from paceline.schema import COHORT_KEYS


def pick_result(results: DataFrame, result_id, columns: list[str] | None = None) -> dict:
    """The one row of a result, as a dict."""
    if result_id is None or not str(result_id).strip():
        raise InvalidRequest("result_id must not be empty")
    found = results.where(F.col("result_id") == F.lit(result_id))
    rows = (found.select(*columns) if columns else found).limit(1).collect()
    if not rows:
        raise NotFound(f"result_id not found: {result_id}")
    return rows[0].asDict()


def demographic_cohort(results: DataFrame, picked: dict, keys=COHORT_KEYS) -> DataFrame:
    """Rows that share the keys of one picked row. Known values reach the scan as filters."""
    return results.where(key_condition({k: picked[k] for k in keys}))


def cohorts_of(results: DataFrame, requests: DataFrame, keys=COHORT_KEYS) -> DataFrame:
    """Rows in the cohort of any requested row, each once."""
    return key_join(results, requests.select(*keys).distinct(), keys, "left_semi")


def override_sizes(results: DataFrame, base: DataFrame, overridden: dict[str, str | None]) -> DataFrame:
    """How large the cohort of each base row is, when some filters are set and the others are its own.

    `base` has one row per request: `result_id`, `season` and the text filters division, gender, age_group. A filter in
    `overridden` takes the given value for all of them; a null filter is open. Text is compared without case. Sizes are
    counted per combination first, so a request meets combinations of its season and never rows.
    """
    texts = ["division", "gender", "age_group"]
    folded = {f"_{c}": F.lower(F.col(c)) for c in texts}
    sizes = results.withColumns(folded).groupBy("season", *folded).agg(F.count(F.lit(1)).alias("_n"))
    asked = base.select("result_id", "season", *[F.lower(F.lit(overridden[c]) if c in overridden else F.col(c)).alias(f"_ask_{c}") for c in texts])
    open_ = [F.col(f"_ask_{c}").isNull() for c in texts]
    found = []
    # One equi-join per set of filters that are given: every given filter is a key of the join.
    for mask in range(1 << len(texts)):
        given_ = [c for k, c in enumerate(texts) if mask >> k & 1]
        rows = asked.where(all_of([~o if c in given_ else o for c, o in zip(texts, open_)]))
        part = sizes.groupBy("season", *[f"_{c}" for c in given_]).agg(F.sum("_n").alias("cohort_size"))
        part = part.withColumnsRenamed({f"_{c}": f"_ask_{c}" for c in given_})
        found.append(rows.join(part, ["season", *[f"_ask_{c}" for c in given_]]).select("result_id", "cohort_size"))
    return reduce(DataFrame.unionByName, found)


def time_band(picked: dict, minutes: float) -> tuple[float, float]:
    if minutes is None or float(minutes) <= 0:
        raise InvalidRequest("the time window must be a positive number")
    total = picked["total_time_min"]
    if total is None:
        raise InvalidRequest("the result has no total time")
    if picked["season"] is None:
        raise InvalidRequest("the result has no season")
    return float(total) - float(minutes), float(total) + float(minutes)


def time_window_cohort(results: DataFrame, picked: dict, minutes: float) -> DataFrame:
    """Rows of the same race whose total lies within `minutes` of the picked one, ends included."""
    low, high = time_band(picked, minutes)
    here = key_condition({k: picked[k] for k in ("location", "season")})
    return results.where(here & F.col("total_time_min").between(low, high))


def time_window_standing(
    results: DataFrame, minutes: float, keys=("location", "season"), value="total_time_min", hot_rows=HOT_ROWS
) -> DataFrame:
    """For every result: how many are within `minutes`, how many of those are faster, and the percentile.

    A window is the difference of two positions in the sorted group, so no pairs are built.
    """
    keys = list(keys)
    timed = results.where(F.col(value).isNotNull())
    hot = hot_groups(timed, keys, hot_rows)
    counted = value_counts(timed.select(*keys, value), keys, value)
    own, half = F.col(value), float(minutes)
    # At one place in the order a lower end comes first, then the values, then an upper end.
    marks = F.array(
        F.struct((own - half).alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_w")),
        F.struct(own.alias("_at"), F.lit(1).alias("_kind"), F.col("_n").alias("_w")),
        F.struct((own + half).alias("_at"), F.lit(2).alias("_kind"), F.lit(0).cast("long").alias("_w")),
    )
    events = counted.select(*keys, value, F.inline(marks))
    placed = running_total(events, keys, ["_at", "_kind", value], "_w", "_upto", hot)

    def at(kind: int, count: Column) -> Column:
        return F.max(F.when(F.col("_kind") == kind, count))

    ends = placed.groupBy(*keys, value).agg(
        at(0, F.col("_upto")).alias("_from"),
        at(1, F.col("_upto") - F.col("_w")).alias("_below"),
        at(2, F.col("_upto")).alias("_to"),
    )
    size, faster = F.col("_to") - F.col("_from"), F.col("_below") - F.col("_from")
    return key_join(timed, ends, [*keys, value]).select(
        *results.columns,
        size.alias("window_size"),
        faster.alias("window_faster"),
        standing(faster, size).alias("window_percentile"),
    )
