"""Raw race files: one Parquet file per race, durations as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.errors import InvalidRequest, NotFound
from paceline.functions.durations import clock_minutes
from paceline.operators.filters import has, name_contains, open_interval
from paceline.schema import RAW_DURATIONS, RAW_RENAMES
from paceline.sources.manifest import find_race, first_entries, object_key, race_not_found


def readable(raw: DataFrame) -> DataFrame:
    """Readable column names, durations in minutes. Columns a file lacks are skipped."""
    named = raw.withColumnsRenamed(RAW_RENAMES)
    return named.withColumns({c: clock_minutes(F.col(c)) for c in RAW_DURATIONS if c in named.columns})


def normalise_durations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as minutes in place."""
    return df.withColumns({c: clock_minutes(F.col(c)) for c in columns if c in df.columns})


def _files(spark: SparkSession, paths: list[str], gender: str | None, division: str | None) -> DataFrame:
    """Scan race files whose columns may differ; the equality filters are pushed into the scan."""
    rows = spark.read.option("mergeSchema", len(paths) > 1).parquet(*paths)
    for column, value in (("gender", gender), ("division", division)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def _located(base: str, key: str) -> str:
    return f"{base.rstrip('/')}/{key}" if base else key


def get_race(
    spark: SparkSession,
    manifest: DataFrame,
    season: int,
    location: str,
    year: int | None = None,
    gender: str | None = None,
    division: str | None = None,
    total_time=None,
    base: str = "",
) -> DataFrame:
    """Entries of one race. `total_time` is an upper bound or an open interval in minutes."""
    entry = find_race(manifest.withColumn("path", object_key(F.col("path"))), season, location, year)
    rows = _files(spark, [_located(base, entry["path"])], gender, division)
    if rows.isEmpty():
        raise NotFound(f"no rows for season={season}, location={location!r} (gender={gender}, division={division})")
    return timed_within(readable(rows), total_time)


def timed_within(rows: DataFrame, total_time) -> DataFrame:
    if total_time is None:
        return rows
    if not has(rows, "total_time"):
        raise InvalidRequest("the race data has no total_time")
    return rows.where(open_interval("total_time", total_time))


def get_season(
    spark: SparkSession,
    manifest: DataFrame,
    season: int,
    locations: list[str] | None = None,
    gender: str | None = None,
    division: str | None = None,
    base: str = "",
    first_only: bool = False,
) -> DataFrame:
    """All races of a season in one scan. `first_only` keeps one file per location."""
    rows = manifest.where(F.col("season") == int(season))
    if first_only:
        rows = first_entries(rows)
    if locations:
        rows = rows.where(F.lower("location").isin([name.lower() for name in locations]))
    # The file list of one season: what a reader takes as its arguments.
    paths = [row.path for row in rows.select(object_key(F.col("path")).alias("path")).distinct().collect()]
    if not paths:
        raise race_not_found(manifest, season, ", ".join(locations or ["any"]))
    return readable(_files(spark, [_located(base, p) for p in sorted(paths)], gender, division))


def get_season_layout(
    spark: SparkSession,
    root: str,
    season: int,
    locations: list[str] | None = None,
    gender: str | None = None,
    division: str | None = None,
) -> DataFrame:
    """All races of a season from files laid out as `season=<n>/location=<name>/`.

    The reader finds the files itself, and the filters on season and place choose folders; no list of paths is made.
    Files of one layout must agree in their columns; for others there is `get_season`.
    """
    rows = spark.read.parquet(root).where(F.col("season") == int(season))
    if locations:
        rows = rows.where(F.lower("location").isin([name.lower() for name in locations]))
    for column, value in (("gender", gender), ("division", division)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return readable(rows)


def stack_races(frames: list[DataFrame]) -> DataFrame:
    """Put race frames below each other by column name; what a frame lacks is null."""
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame, allowMissingColumns=True)
    return stacked


def athlete_in_race(rows: DataFrame, athlete_name: str) -> DataFrame:
    """Entries whose name contains the text, in any case."""
    if athlete_name is None or not str(athlete_name).strip():
        raise InvalidRequest("athlete_name must not be empty")
    if not has(rows, "name"):
        raise InvalidRequest("the race data has no name column")
    found = rows.where(name_contains(athlete_name))
    if found.isEmpty():
        raise NotFound(f"athlete {athlete_name!r} is not in this race")
    return found
