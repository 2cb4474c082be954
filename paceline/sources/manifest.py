"""The manifest: which race files exist."""

from __future__ import annotations

from difflib import SequenceMatcher
from heapq import nlargest

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.errors import NotFound
from paceline.operators.filters import has, text_is
from paceline.operators.joins import key_join
from paceline.operators.stats import distinct_folded, distinct_numbers, first_n_in_group
from paceline.schema import MANIFEST_SCHEMA

# How alike a suggestion must be, and how many are made.
CLOSE_ENOUGH = 0.6
SUGGESTIONS = 3
# End of fixed values.


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest CSV with the line order kept, because the first entry of a race wins."""
    table = spark.read.csv(path, header=True)
    typed = [
        F.col(field.name).try_cast(field.dataType).alias(field.name)
        for field in MANIFEST_SCHEMA
        if field.name in table.columns
    ]
    return table.select(*typed, F.monotonically_increasing_id().alias("line"))


def object_key(path: Column) -> Column:
    """The path inside a bucket."""
    return F.regexp_replace(path, r"^s3://[^/]+/", "")


def races(manifest: DataFrame, season: int | None = None) -> DataFrame:
    """Races of the manifest, with the time of the latest file if it is recorded."""
    rows = manifest if season is None else manifest.where(F.col("season") == int(season))
    if has(manifest, "file_last_modified"):
        found = rows.groupBy("season", "location").agg(F.max("file_last_modified").alias("file_last_modified"))
    else:
        found = rows.select("season", "location").distinct()
    return found.where("season is not null and location is not null").orderBy("season", "location")


def seasons(manifest: DataFrame) -> DataFrame:
    return distinct_numbers(manifest, "season")


def locations(manifest: DataFrame, season: int | None = None) -> DataFrame:
    rows = manifest if season is None else manifest.where(F.col("season") == int(season))
    return distinct_folded(rows, "location")


def years(manifest: DataFrame, season: int | None = None, location: str | None = None) -> DataFrame:
    rows = manifest if season is None else manifest.where(F.col("season") == int(season))
    if location is not None:
        rows = rows.where(text_is("location", location))
    if not has(rows, "year"):
        return rows.select(F.lit(None).cast("int").alias("year")).limit(0)
    return distinct_numbers(rows, "year")


def first_entries(manifest: DataFrame) -> DataFrame:
    """One row per season and location (up to case): the first entry."""
    order = [F.col("line")] if has(manifest, "line") else [F.asc_nulls_last("year"), F.col("path")]
    keyed = manifest.withColumn("_fold", F.lower("location"))
    return first_n_in_group(keyed, ["season", "_fold"], order, 1).drop("_fold")


def find_race(manifest: DataFrame, season: int, location: str, year: int | None = None) -> dict:
    """The first manifest entry of a race; if there is none the error says what exists."""
    rows = manifest.where((F.col("season") == int(season)) & text_is("location", location))
    if year is not None:
        rows = rows.where(F.col("year") == int(year))
    order = ["line"] if has(manifest, "line") else [F.asc_nulls_last("year"), "path"]
    found = rows.orderBy(*order).limit(1).collect()
    if found:
        return found[0].asDict()
    raise race_not_found(manifest, season, location, year)


def race_not_found(manifest: DataFrame, season: int, location: str, year: int | None = None) -> NotFound:
    """What does exist near a race that does not. All lists are as short as the manifest's menus."""

    def values(df: DataFrame) -> list:
        return [row[0] for row in df.collect()]

    context = {"season": season, "location": location, "year": year, "available_seasons": values(seasons(manifest))}
    message = f"no race for season={season}, location={location!r}" + ("" if year is None else f", year={year}")
    here = values(locations(manifest, season))
    if not here:
        known = ", ".join(map(str, context["available_seasons"]))
        return NotFound(f"{message}. Available seasons: {known}.", suggestions=[], **context)
    context["available_locations"] = here
    in_place = values(years(manifest, season, location))
    if location.lower() in {name.lower() for name in here}:
        shown = ", ".join(map(str, in_place))
        return NotFound(f"{message}. Available years: {shown}.", available_years=in_place, suggestions=[], **context)
    folded = {name.lower(): name for name in here}
    near = [folded[text] for _, text in _closest(location.lower(), list(folded))]
    hint = f". Did you mean: {', '.join(near)}?" if near else "."
    return NotFound(message + hint, suggestions=near, **context)


def _closest(wanted: str, candidates: list[str]) -> list[tuple[float, str]]:
    matcher = SequenceMatcher()
    matcher.set_seq2(wanted)
    scored = []
    for text in candidates:
        matcher.set_seq1(text)
        if matcher.real_quick_ratio() >= CLOSE_ENOUGH and matcher.quick_ratio() >= CLOSE_ENOUGH:
            ratio = matcher.ratio()
            if ratio >= CLOSE_ENOUGH:
                scored.append((ratio, text))
    return nlargest(SUGGESTIONS, scored)


_SCORED = T.ArrayType(
    T.StructType([T.StructField("score", T.DoubleType()), T.StructField("suggestion", T.StringType())])
)


@F.pandas_udf(_SCORED)
def _closest_of(wanted: pd.Series, candidates: pd.Series) -> pd.Series:
    return pd.Series(
        [
            [{"score": score, "suggestion": text} for score, text in _closest(word, list(texts))]
            for word, texts in zip(wanted, candidates)
        ]
    )


def close_matches(unmatched: DataFrame, known: DataFrame, block: list[str], column: str) -> DataFrame:
    """Suggestions for a table of labels that match nothing: up to three known labels per row.

    Only labels of the same block are compared, and only lengths that can reach the similarity: the
    known labels travel as one short list per block and length, no pair of labels becomes a row.
    """
    wanted = unmatched.select(*block, F.lower(column).alias(column)).where(F.col(column).isNotNull()).distinct()
    menu = (
        known.select(*block, F.lower(F.trim(column)).alias("_text"))
        .where("_text <> ''")
        .distinct()
        .groupBy(*block, F.length("_text").alias("_len"))
        .agg(F.collect_list("_text").alias("_texts"))
    )
    # 2*min/(a+b) bounds the similarity from above, which gives the shortest and longest useful length.
    ratio = CLOSE_ENOUGH / (2 - CLOSE_ENOUGH)
    size = F.length(column)
    lengths = F.sequence(F.ceil(size * ratio - 1e-9).cast("int"), F.floor(size / ratio + 1e-9).cast("int"))
    spread = wanted.where(size > 0).withColumn("_len", F.explode(lengths))
    scored = key_join(spread, menu, [*block, "_len"]).select(
        *block, column, F.inline(_closest_of(F.col(column), F.col("_texts")))
    )
    order = [F.desc("score"), F.desc("suggestion")]
    best = first_n_in_group(scored, [*block, column], order, SUGGESTIONS)
    place = Window.partitionBy(*block, column).orderBy(*order)
    return best.withColumn("place", F.row_number().over(place))


def race_menus(manifest: DataFrame) -> DataFrame:
    """What exists, once per season and location: `season, location, years`."""
    known = manifest.where("season is not null and location is not null")
    named = known.groupBy("season", F.lower("location").alias("_fold")).agg(
        F.min("location").alias("location"), F.array_sort(F.collect_set("year")).alias("years")
    )
    return named.drop("_fold")


def missing_races(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """A table of wanted races (`season, location, year`) with what is wrong and what comes close.

    What exists instead is the same for all rows of a season, so it is a table of its own: `race_menus`. A row that
    asks for a year no race has carries the years of its place, which are few.
    """
    known = manifest.where("season is not null and location is not null")
    folded = wanted.withColumn("_fold", F.lower("location"))
    by_season = known.groupBy("season").agg(F.lit(True).alias("_any"))
    by_place = known.groupBy("season", F.lower("location").alias("_fold")).agg(
        F.array_sort(F.collect_set("year")).alias("available_years")
    )
    joined = key_join(key_join(folded, by_season, ["season"], "left"), by_place, ["season", "_fold"], "left")
    status = (
        F.when(F.col("_any").isNull(), "no such season")
        .when(F.col("available_years").isNull(), "no such location")
        .when(F.col("year").isNotNull() & ~F.array_contains("available_years", F.col("year")), "no such year")
        .otherwise("found")
    )
    lost = joined.withColumn("status", status).where("status = 'no such location'")
    near = close_matches(lost, known, ["season"], "location").groupBy("season", F.col("location").alias("_fold")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "suggestion"))), lambda s: s["suggestion"]).alias(
            "suggestions"
        )
    )
    return (
        key_join(joined.withColumn("status", status), near, ["season", "_fold"], "left")
        .withColumn("suggestions", F.when(F.col("status") == "no such location", F.col("suggestions")))
        .withColumn("available_years", F.when(F.col("status") == "no such year", F.col("available_years")))
        .drop("_fold", "_any")
    )


