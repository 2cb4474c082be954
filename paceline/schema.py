"""Names and types of the results tables."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from paceline.errors import InvalidRequest

COHORT_KEYS = ["season", "location", "division", "gender", "age_group"]
SEASON_KEYS = ["season", "division", "gender", "age_group"]
OVERALL_KEYS = ["division", "gender", "age_group"]

# Station and run names, their order, labels and groups are part of the data format.
STATIONS = [
    ("skiErg", "SkiErg"),
    ("sledPush", "Sled Push"),
    ("sledPull", "Sled Pull"),
    ("burpeeBroadJump", "Burpee Broad Jump"),
    ("rowErg", "RowErg"),
    ("farmersCarry", "Farmers Carry"),
    ("sandbagLunges", "Sandbag Lunges"),
    ("wallBalls", "Wall Balls"),
]
RUN_NUMBERS = range(1, 9)
PACING_RUNS = range(2, 8)
TOTALS = ["total", "run", "work", "roxzone"]
GENDER_ALIASES = {"m": ["m", "male"], "male": ["m", "male"], "f": ["f", "female"], "female": ["f", "female"]}
DEFAULT_BINS = 22
SMALL_SAMPLE = 30
RUN_FLOOR_MIN = 1.0
SUPPORTED_SCHEMA_VERSION = 1
# End of fixed values.

STATION_COLUMNS = [f"{name}_time_min" for name, _ in STATIONS]
RUN_COLUMNS = [f"run{n}_time_min" for n in RUN_NUMBERS]
TIME_COLUMNS = [f"{name}_time_min" for name in TOTALS] + RUN_COLUMNS + STATION_COLUMNS

#: (column, label, group, position) of everything a segment report shows.
SEGMENTS = [
    (column, label, group, position)
    for position, (column, label, group) in enumerate(
        [("total_time_min", "Total time", "overall")]
        + [(f"run{n}_time_min", f"Run {n}", "runs") for n in RUN_NUMBERS]
        + [(f"{name}_time_min", label, "stations") for name, label in STATIONS]
    )
]
AGGREGATE_SEGMENTS = [
    ("run_time_min", "Total Run", "aggregate", len(SEGMENTS)),
    ("work_time_min", "Total Work", "aggregate", len(SEGMENTS) + 1),
    ("roxzone_time_min", "Total Roxzone", "aggregate", len(SEGMENTS) + 2),
]

#: Raw files number their stations and runs; readable names follow the course order.
RAW_RENAMES = {
    **{f"work_{n}": f"{name}_time" for n, (name, _) in enumerate(STATIONS, start=1)},
    **{f"run_{n}": f"run{n}_time" for n in RUN_NUMBERS},
}
RAW_DURATIONS = [*RAW_RENAMES.values(), "total_time", "work_time", "roxzone_time", "run_time"]

#: Metrics of an athlete profile; the combined run metric is derived from two columns.
PROFILE_METRICS = {"overall": "total_time_min", **{n.lower(): f"{n}_time_min" for n, _ in STATIONS}}
RUN_PLUS_ROXZONE = "runplusroxzone"
DISTRIBUTION_METRICS = {**PROFILE_METRICS, **{f"run{n}": f"run{n}_time_min" for n in RUN_NUMBERS}}

REQUIRED_COLUMNS = {
    "race_results": ["result_id", "season", "location", "year", "event_id", "name"],
    "athletes": ["athlete_id", "canonical_name"],
    "athlete_results": ["athlete_id", "result_id", "link_confidence", "link_method"],
    "athlete_index": ["athlete_id", "canonical_name", "name_lc", "race_count"],
}
UNIQUE_KEYS = {
    "race_results": ["result_id"],
    "athletes": ["athlete_id"],
    "athlete_results": ["athlete_id", "result_id"],
    "athlete_index": ["athlete_id"],
}


def _fields(kind, names, nullable=True):
    return [T.StructField(name, kind, nullable) for name in names]


RESULTS_SCHEMA = T.StructType(
    _fields(T.StringType(), ["result_id", "event_id", "location", "name"], False)
    + _fields(T.IntegerType(), ["season", "year"], False)
    + _fields(T.StringType(), ["event_name", "division", "gender", "age_group", "nationality", "name_raw"])
    + _fields(T.DoubleType(), TIME_COLUMNS)
)
MANIFEST_SCHEMA = T.StructType(
    _fields(T.IntegerType(), ["season"])
    + _fields(T.StringType(), ["location", "path"])
    + _fields(T.IntegerType(), ["year"])
    + _fields(T.StringType(), ["file_last_modified"])
)


def plain_key(text: str) -> str:
    """Lower-case letters and digits of a name, so that spelling variants meet."""
    return re.sub(r"[^a-z0-9]+", "", str(text).lower())


_TIME_ALIASES = {
    plain_key(alias): column
    for column in TIME_COLUMNS
    for alias in (column, column.removesuffix("_min"), column.removesuffix("_time_min"))
}
_TIME_ALIASES.update({"runtotal": "run_time_min", "worktotal": "work_time_min"})


def time_column(metric: str) -> str:
    """The time column a user means by `metric`."""
    if metric is None or not str(metric).strip():
        raise InvalidRequest("metric must be a non-empty name")
    column = _TIME_ALIASES.get(plain_key(metric))
    if column is None:
        raise InvalidRequest(f"unknown metric {metric!r}; known ones include {', '.join(sorted(TIME_COLUMNS)[:6])}")
    return column


def distribution_column(metric: str) -> str:
    """Like `time_column`, for the shorter list of distribution metrics."""
    column = DISTRIBUTION_METRICS.get(plain_key(metric))
    if column is None:
        raise InvalidRequest(f"unknown metric {metric!r}")
    return column


def floor_of(name: str) -> float | None:
    """Smallest believable value of a run column or run split; other metrics have none."""
    return RUN_FLOOR_MIN if name.lower().startswith("run") else None
