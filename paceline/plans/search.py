"""Finding athletes by name, for one name or for a table of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.errors import Ambiguous, InvalidRequest, NotFound
from paceline.functions.text import has_words, literal_tokens, partner_tokens, same_words, signature, tokens
from paceline.operators.filters import given, text_is
from paceline.operators.joins import all_of, key_join
from paceline.operators.stats import bounded, first_n_in_group
from paceline.plans.profile import athlete_races

MODES = ("best", "exact", "contains")


def find_athletes(index: DataFrame, name: str, match: str = "best", gender=None, nationality=None) -> DataFrame:
    """Athletes matching a name, those with most races first."""
    if given(name) is None:
        raise InvalidRequest("the name must not be empty")
    words = literal_tokens(name)
    if not words:
        raise InvalidRequest("the name must hold at least one word")
    match = match.lower()
    if match not in MODES:
        raise InvalidRequest(f"match must be one of {', '.join(MODES)}")
    wanted = all_of([F.col("name_lc").contains(word) for word in words])
    if gender is not None:
        wanted &= F.col("gender") == gender
    if nationality is not None:
        wanted &= F.col("nationality") == nationality
    candidates = index.where(wanted)
    # Every exact match also contains the words, so one column tells both.
    name_of = F.col("canonical_name")
    if match == "best":
        marked = candidates.where(has_words(name_of, words)).withColumn("_exact", same_words(name_of, words))
        marked, _ = bounded(marked)
        exact = marked.where("_exact")
        found = (marked if exact.isEmpty() else exact).drop("_exact")
    else:
        found = candidates.where((same_words if match == "exact" else has_words)(name_of, words))
    return found.orderBy(F.desc_nulls_last("race_count"), "canonical_name")


def search_races(
    results: DataFrame,
    links: DataFrame,
    index: DataFrame,
    name: str,
    match: str = "best",
    gender=None,
    division=None,
    nationality=None,
    require_unique: bool = True,
) -> DataFrame:
    """All results of the athletes matching a name."""
    if division is not None and given(division) is None:
        raise InvalidRequest("the division must not be blank")
    found, short = bounded(find_athletes(index, name, match, gender, nationality))
    if require_unique:
        first = found.limit(6).collect()
        if len(first) > 1:
            shown = [f"{r.canonical_name} ({r.gender or 'unknown'}, {r.nationality or 'unknown'})" for r in first[:5]]
            raise Ambiguous(f"several athletes match {name!r}: {', '.join(shown)}", shown)
    ids = found.select("athlete_id").where("athlete_id is not null").distinct()
    own = key_join(links, ids, ["athlete_id"], "left_semi", broadcast=short)
    races = athlete_races(results if division is None else results.where(text_is("division", division)), own, index)
    if races.isEmpty():
        raise NotFound(f"no races for {name!r}")
    races = races.orderBy(*[F.asc_nulls_last(c) for c in ("season", "year", "location", "event_id")])
    return races


def capped(races: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame]:
    """The rows to show and the full count."""
    total = races.agg(F.count(F.lit(1)).alias("total"))
    return (races if limit is None else races.limit(int(limit))), total


def resolve_names(queries: DataFrame, index: DataFrame, match: str = "best") -> DataFrame:
    """Athletes for a table of names (`query_id`, `query`): `query_id, athlete_id, matched`.

    Exact matches meet on the sorted words of a partner. For the rest each name looks only among
    partners that hold its rarest word. Equal queries and equal partners are looked up once; a query of
    common words alone pulls the list of the rarest of them, as that list is its answer's superset.
    """
    people = index.select("athlete_id", F.explode(partner_tokens(F.col("canonical_name"))).alias("words"))
    asked = queries.select("query_id", tokens(F.col("query")).alias("asked")).where(F.size("asked") > 0)
    exact = (
        asked.select("query_id", signature(F.col("asked")).alias("_sig"))
        .join(people.select("athlete_id", signature(F.col("words")).alias("_sig")), "_sig")
        .select("query_id", "athlete_id", F.lit("exact").alias("matched"))
        .distinct()
    )
    if match == "exact":
        return exact
    open_queries = asked if match == "contains" else asked.join(exact.select("query_id"), "query_id", "left_anti")
    words = people.select("athlete_id", "words", F.explode(F.array_distinct("words")).alias("word"))
    frequency = words.groupBy("word").agg(F.count(F.lit(1)).alias("_n"))
    wanted = open_queries.select("query_id", "asked", F.explode(F.array_distinct("asked")).alias("word"))
    rarest = first_n_in_group(
        wanted.join(frequency, "word", "left"), ["query_id"], [F.asc_nulls_first("_n"), F.col("word")], 1
    )
    containing = (
        rarest.join(words, "word")
        .where(F.size(F.array_except("asked", "words")) == 0)
        .select("query_id", "athlete_id", F.lit("contains").alias("matched"))
        .distinct()
    )
    return containing if match == "contains" else exact.unionByName(containing)


