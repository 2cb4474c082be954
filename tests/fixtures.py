"""Small hand-made tables."""

from __future__ import annotations


def rows(spark, schema: str, data):
    return spark.createDataFrame(data, schema).coalesce(1)


def ids(df, column="result_id"):
    return sorted(r[0] for r in df.select(column).collect())


def by(df, key):
    return {r[key]: r for r in df.collect()}


COHORT = "season int, location string, year int, division string, gender string, age_group string"


def report_tables(spark):
    """Three solo results of one race, one of another division, and one of the season before."""
    solo = ("solo", "F", "45-49")
    results = rows(
        spark,
        f"result_id string, event_id string, {COHORT}, name string, total_time_min double",
        [
            ("q1", "oslo4", 4, "oslo", 2031, *solo, "Kaia Berg", 81.5),
            ("q2", "oslo4", 4, "oslo", 2031, *solo, "Liv Dahl", 77.0),
            ("q3", "oslo4", 4, "oslo", 2031, "relay", "F", "45-49", "Team Fjord", 83.0),
            ("q4", "oslo4b", 4, "oslo", 2031, *solo, "Nora Eide", 80.25),
            ("q5", "oslo3", 3, "oslo", 2030, *solo, "Signe Foss", 75.5),
        ],
    )
    rankings = rows(
        spark,
        "result_id string, event_rank int, event_size int, event_percentile double, season_rank int, season_size int, "
        "season_percentile double, overall_rank int, overall_size int, overall_percentile double",
        [("q1", 12, 40, 0.7, 21, 90, 0.77, 55, 300, 0.82), ("q3", 2, 6, 0.8, 3, 15, 0.85, 8, 44, 0.84)],
    )
    cohort = ("oslo", *solo)
    splits = rows(
        spark,
        "result_id string, event_id string, season int, location string, division string, gender string, age_group string, "
        "split_name string, split_time_min double, split_rank int, split_size int, split_percentile double",
        [
            ("q1", "oslo4", 4, *cohort, "run_1", 6.5, 2, 3, 0.5),
            ("q1", "oslo4", 4, *cohort, "row_erg", 4.4, 2, 2, 0.0),
            ("q2", "oslo4", 4, *cohort, "run_1", 5.8, 1, 3, 1.0),
            ("q2", "oslo4", 4, *cohort, "row_erg", 4.1, 1, 2, 1.0),
            ("q3", "oslo4", 4, "oslo", "relay", "F", "45-49", "run_1", 6.1, 1, 1, 1.0),
            ("q4", "oslo4b", 4, *cohort, "run_1", 6.9, 3, 3, 0.0),
            ("q5", "oslo3", 3, *cohort, "run_1", 5.0, 1, 1, 1.0),
        ],
    )
    return results, rankings, splits


def dive_results(spark):
    """Nine results of one cohort in two places, and two of another cohort."""
    data = [("kaia", "lyon", "Kaia Berg", 88.0)]
    data += [(f"lyon{i}", "lyon", f"Lyon Runner {i}", t) for i, t in enumerate((84.5, 85.0, 90.5))]
    data += [(f"graz{i}", "graz", f"Graz Runner {i}", t) for i, t in enumerate((83.0, 86.25, 87.5, 91.0, 95.5))]
    elite, other = ("elite", "F", "40-44"), ("solo", "M", "20-24")
    return rows(
        spark,
        f"result_id string, event_name string, event_id string, {COHORT}, name string, total_time_min double",
        [(i, f"{place} 4", f"{place}4", 4, place, 2031, *elite, who, t) for i, place, who, t in data]
        + [(f"out{i}", f"{place} 4", f"{place}4", 4, place, 2031, *other, "Out Sider", t) for i, (place, t) in enumerate((("lyon", 70.0), ("porto", 71.0)))],
    )


STATION_COLUMNS = ["skiErg", "sledPush", "sledPull", "burpeeBroadJump", "rowErg", "farmersCarry", "sandbagLunges", "wallBalls"]
PORTO_ELITE = (4, "Porto", 2031, "Elite", "Female", "F40-44")


def career_tables(spark, elite=False):
    """One athlete who raced twice among others; with `elite` also once in a higher division."""
    columns = ["total", "run", "roxzone", *STATION_COLUMNS]
    schema = f"result_id string, event_id string, {COHORT}, name string, " + ", ".join(f"{c}_time_min double" for c in columns)
    solo = ("Solo", "Female", "F40-44")
    graz, lyon, porto = (4, "Graz", 2031), (3, "Lyon", 2030), (4, "Porto", 2031)

    def row(result_id, race, cohort, who, total, run, rest):
        # Eight stations a tenth of a minute apart.
        return (result_id, f"{race[1]}{race[0]}", *race, *cohort, who, total, run, rest, *[5.0 + k / 10 for k in range(8)])

    data = [
        row("c1", graz, solo, "Petra Novak", 95.5, 44.0, 6.5),
        row("c2", lyon, solo, "Petra Novak", 92.25, 43.0, 6.0),
        row("o1", graz, solo, "Ute Brandt", 94.0, 43.5, 6.25),
        row("o2", graz, solo, "Vera Lang", 99.0, 46.0, 7.0),
        row("o3", lyon, solo, "Wilma Roth", 96.0, 45.0, 6.0),
        row("o4", porto, solo, "Xenia Maier", 91.0, 42.0, 5.75),
        row("o5", graz, ("Solo", "Male", "M40-44"), "Yann Petit", 85.0, 39.0, 5.0),
    ]
    if elite:
        times = (("c3", "Petra Novak", 90.5), ("o6", "Zita Horn", 89.0), ("o7", "Anke Voss", 93.0))
        data += [row(i, porto, PORTO_ELITE[3:], who, t, 41.0, 5.5) for i, who, t in times]
    links = rows(spark, "athlete_id string, result_id string", [("petra", d[0]) for d in data if d[8] == "Petra Novak"])
    index = rows(
        spark,
        "athlete_id string, canonical_name string, name_lc string, gender string, nationality string, race_count int",
        [("petra", "petra novak", "petra novak", "Female", "CZE", 2)],
    )
    return rows(spark, schema, data), links, index


def people_tables(spark, more=()):
    """Athletes (id, name, nationality) with their results (id, event, division)."""
    people = [
        ("p1", "mira solberg", "NO", [("m1", "oslo4", "solo"), ("m2", "graz4", "elite")]),
        ("p2", "tomas okafor", "NG", [("t1", "oslo4", "solo")]),
        *more,
    ]
    index = rows(
        spark,
        "athlete_id string, canonical_name string, name_lc string, gender string, nationality string, race_count int",
        [(a, n, n, "M" if a == "p2" else "F", c, len(r)) for a, n, c, r in people],
    )
    links = rows(spark, "athlete_id string, result_id string", [(a, r[0]) for a, _, _, rs in people for r in rs])
    results = rows(
        spark,
        "result_id string, event_id string, season int, location string, year int, name string, division string",
        [(r, e, 4, e[:4], 2031, n.title(), d) for _, n, _, rs in people for r, e, d in rs],
    )
    return results, links, index
