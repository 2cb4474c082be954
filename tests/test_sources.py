import pytest
from fixtures import by, ids, rows
from pyspark.sql import functions as F

from paceline.errors import InvalidRequest, NotFound
from paceline.sources import contract, manifest, races, warehouse

MANIFEST = "season int, location string, path string, year int, file_last_modified string"


@pytest.fixture(scope="module")
def listing(spark):
    return rows(
        spark,
        MANIFEST,
        [
            (4, "Tallinn", "tll", None, "2031-05-11"),
            (4, "Riga", "riga-spring", 2030, "2030-12-03"),
            (4, "Riga", "riga-autumn", 2031, "2031-09-27"),
            (4, "Oslo", "oslo", None, "2031-06-01"),
            (3, "Graz", "graz", None, "2029-11-30"),
        ],
    )


@pytest.fixture(scope="module")
def ragged(spark):
    return rows(
        spark,
        "season int, location string, year int, path string",
        [(5, "Porto", 2033, "1"), (4, "Bern", 2031, "2"), (5, "PORTO", 2032, "3"), (None, None, None, "4"), (5, "Lyon", None, "5"), (5, " ", 2032, "6")],
    )


def test_races_of_manifest(listing, ragged):
    assert [tuple(r) for r in manifest.races(listing, 3).collect()] == [(3, "Graz", "2029-11-30")]
    assert by(manifest.races(listing, 4), "location")["Riga"].file_last_modified == "2031-09-27"
    assert [tuple(r) for r in manifest.races(ragged, 4).collect()] == [(4, "Bern")]


def test_menus_of_manifest(ragged):
    def first(df):
        return [r[0] for r in df.collect()]

    assert first(manifest.seasons(ragged)) == [4, 5]
    assert first(manifest.locations(ragged, 5)) == ["Lyon", "PORTO"]
    assert first(manifest.locations(ragged, 77)) == []
    assert first(manifest.years(ragged, 5, "porto")) == [2032, 2033]
    assert first(manifest.years(ragged, 77, "porto")) == []
    assert [tuple(r) for r in manifest.race_menus(ragged.where("season = 5 and location <> ' '")).orderBy("location").collect()] == [
        (5, "Lyon", []), (5, "PORTO", [2032, 2033]),
    ]


def test_find_race(listing):
    assert manifest.find_race(listing, 4, "riga", 2031)["path"] == "riga-autumn"
    assert manifest.find_race(listing, 4, "RIGA")["path"] == "riga-spring"
    assert manifest.find_race(listing, 4, "tallinn")["path"] == "tll"


def test_not_found_says_what_exists(spark, listing):
    with pytest.raises(NotFound, match="Available seasons: 3, 4") as error:
        manifest.find_race(listing, 6, "Riga")
    assert error.value.context["available_seasons"] == [3, 4] and error.value.context["suggestions"] == []
    with pytest.raises(NotFound, match="Did you mean: Tallinn") as error:
        manifest.find_race(listing, 4, "talin")
    assert error.value.context["suggestions"] == ["Tallinn"]
    with pytest.raises(NotFound, match="Available years: 2030, 2031") as error:
        manifest.find_race(listing, 4, "Riga", 2044)
    assert error.value.context["available_years"] == [2030, 2031]


def test_missing_races_as_a_table(spark, listing):
    wanted = rows(
        spark,
        "season int, location string, year int",
        [(4, "talin", None), (6, "Riga", None), (4, "Riga", 2044), (4, "Riga", 2030), (4, "qqqqqq", None)],
    )
    found = {(r.season, r.location, r.year): r for r in manifest.missing_races(wanted, listing).collect()}
    assert len(found) == 5
    assert found[4, "talin", None].status == "no such location" and found[4, "talin", None].suggestions == ["tallinn"]
    assert found[6, "Riga", None].status == "no such season"
    assert found[4, "Riga", 2044].status == "no such year" and found[4, "Riga", 2044].available_years == [2030, 2031]
    assert found[4, "Riga", 2030].status == "found" and found[4, "Riga", 2030].available_years is None
    assert found[4, "qqqqqq", None].suggestions is None


def test_close_matches_agree_with_a_plain_search(spark):
    from difflib import get_close_matches

    known = ["london", "lisbon", "londen", "long", "berlin", "bern", "dublin", "malaga", "milan", "x"]
    wanted = ["londn", "berln", "lon", "mila", "dubli", "q"]
    found = manifest.close_matches(
        rows(spark, "season int, location string", [(1, w) for w in wanted]),
        rows(spark, "season int, location string", [(1, k) for k in known]),
        ["season"],
        "location",
    )
    got = {}
    for r in found.orderBy("location", "place").collect():
        got.setdefault(r.location, []).append(r.suggestion)
    for w in wanted:
        assert got.get(w, []) == get_close_matches(w, known, n=3, cutoff=0.6), w


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("races"))
    raw = rows(
        spark,
        "name string, gender string, division string, total_time string, work_1 string, run_1 string",
        [
            ("Kaia Berg", "F", "elite", "01:10:45", "5:15", "6:30"),
            ("Tomas Okafor", "M", "elite", "01:02:30", "4:00", "n/a"),
            ("Wim Korda", "M", "solo", "01:25:00", "6:45", "7:15"),
            ("Nora Eide", "F", "elite", "01:31:15", "7:30", "8:00"),
        ],
    )
    raw.coalesce(1).write.parquet(f"{base}/season=4/Riga.parquet")
    raw.drop("run_1").where("division = 'elite'").withColumn("bib", F.lit(9)).coalesce(1).write.parquet(f"{base}/season=4/Oslo.parquet")
    lines = ["season,location,path,year", "4,Riga,s3://b/season=4/Riga.parquet,2031", "4,Oslo,s3://b/season=4/Oslo.parquet,?"]
    spark.range(1).select(F.lit("\n".join(lines)).alias("value")).coalesce(1).write.text(f"{base}/manifest")
    return base, manifest.read_manifest(spark, f"{base}/manifest")


def names(df):
    return ids(df, "name")


def test_get_race(spark, files):
    base, listing = files

    def found(**options):
        return names(races.get_race(spark, listing, 4, "riga", base=base, **options))

    first = by(races.get_race(spark, listing, 4, "RIGA", base=base), "name")
    assert first["Kaia Berg"].total_time == 70.75 and first["Kaia Berg"].skiErg_time == 5.25
    assert first["Tomas Okafor"].run1_time is None
    assert found(total_time=85) == ["Kaia Berg", "Tomas Okafor"]
    assert found(total_time=(62.5, 85.5)) == ["Kaia Berg", "Wim Korda"]
    assert found(total_time=(80, None)) == ["Nora Eide", "Wim Korda"]
    assert found(gender="M", division="elite") == ["Tomas Okafor"]
    with pytest.raises(NotFound):
        found(gender="f")
    with pytest.raises(InvalidRequest):
        found(total_time=(1, 2, 3))


def test_get_race_pushes_filters(spark, files):
    base, listing = files
    race = races.get_race(spark, listing, 4, "Riga", gender="M", base=base)
    plan = race._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gender,M)" in plan


def test_get_season(spark, files):
    base, listing = files
    season = races.get_season(spark, listing, 4, base=base)
    assert season.count() == 7 and {"run1_time", "bib"} <= set(season.columns)
    assert races.get_season(spark, listing, 4, locations=["OSLO"], base=base).count() == 3
    assert races.get_season(spark, listing, 4, division="solo", base=base).count() == 1
    assert races.get_season(spark, listing, 4, base=base, first_only=True).count() == 7
    with pytest.raises(NotFound):
        races.get_season(spark, listing, 8, base=base)


def test_season_layout_reads_one_folder(spark, tmp_path):
    raw = rows(
        spark,
        "season int, location string, name string, gender string, total_time string",
        [(4, "Riga", "a", "F", "01:10:00"), (4, "Oslo", "b", "M", "01:20:00"), (3, "Riga", "c", "F", "01:30:00")],
    )
    raw.write.partitionBy("season", "location").parquet(str(tmp_path / "files"))
    season = races.get_season_layout(spark, str(tmp_path / "files"), 4)
    assert by(season, "name")["a"].total_time == 70.0 and names(season) == ["a", "b"]
    assert "PartitionFilters: [isnotnull(season" in season._jdf.queryExecution().executedPlan().toString()
    assert names(races.get_season_layout(spark, str(tmp_path / "files"), 4, ["OSLO"], gender="M")) == ["b"]


def test_athlete_in_race(spark, files):
    base, listing = files
    race = races.get_race(spark, listing, 4, "Riga", base=base)
    assert names(races.athlete_in_race(race, "OKA")) == ["Tomas Okafor"]
    with pytest.raises(NotFound):
        races.athlete_in_race(race, "nobody")
    with pytest.raises(InvalidRequest):
        races.athlete_in_race(race, " ")


def test_warehouse_round_trip(spark, tmp_path):
    df = rows(spark, "result_id string, season int, total_time_min double", [("a", 7, 60.0), ("b", 8, None)])
    warehouse.write_table(df, str(tmp_path), "race_results")
    warehouse.write_table(df.drop("season"), str(tmp_path), "athletes")
    back = warehouse.read_table(spark, str(tmp_path), "race_results")
    assert ids(back.where("season = 8")) == ["b"]
    plan = back.where("season = 8")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan
    assert {"race_results", "athletes"} <= set(warehouse.register(spark, str(tmp_path), ["race_results", "athletes"]))
    assert warehouse.query(spark, "SELECT count(*) FROM race_results WHERE season > ?", [7]).first()[0] == 1
    records = [r[0] for r in warehouse.records(back.orderBy("result_id")).collect()]
    assert records == ['{"result_id":"a","total_time_min":60.0,"season":7}', '{"result_id":"b","total_time_min":null,"season":8}']
    assert warehouse.records(back, limit=1).count() == 1


def test_contract(spark):
    df = rows(
        spark,
        "result_id string, season int, location string, year int, event_id string",
        [("a", 8, "x", 2024, "e"), ("a", 8, None, 2024, "e"), ("b", None, "x", 2024, "e")],
    )
    found = {r.rule: r.violations for r in contract.check_warehouse_table(df, "race_results").collect()}
    assert found == {
        "result_id not null": 0, "season not null": 1, "location not null": 1, "year not null": 0, "event_id not null": 0,
        "name not null": 3, "result_id unique": 1,
    }
    assert contract.check_version(rows(spark, "schema_version int", [(1,)])).first().violations == 0
    assert contract.check_version(rows(spark, "schema_version int", [(2,)])).first().violations == 1


def test_roster_gate(spark):
    schema = "season int, location string, year int, division string, name string"
    df = rows(spark, schema, [(8, "x", 2024, "open", "a")] * 3 + [(8, "y", 2024, "open", n) for n in "abc"])
    found = contract.roster_gate(df, 1.5).collect()
    assert [(r.location, r.rows, r["names"], r.rows_per_name) for r in found] == [("x", 3, 1, 3.0)]
