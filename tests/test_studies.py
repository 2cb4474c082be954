import numpy as np
import pytest
from fixtures import by, ids, rows
from pyspark.sql import functions as F

from paceline.errors import InvalidRequest
from paceline.plans import studies


def numbers(spark, values, name="v"):
    return rows(spark, f"result_id int, {name} double", list(enumerate(values)))


def test_fastest_part(spark):
    df = numbers(spark, [1.0, 2.0, 3.0, 4.0, 5.0, None])
    assert ids(studies.fastest_part(df, "v", 0.5)) == [0, 1, 2]
    assert ids(studies.fastest_part(df, "v")) == [0, 1, 2, 3, 4]


def test_clean_times_cuts_one_column_after_the_other(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.uniform(1, 10, 300), rng.uniform(1, 10, 300)
    b[:3], a[3] = [0.0, 500.0, np.nan], 30.0
    data = [(i, float(x), None if np.isnan(y) else float(y), 25.0) for i, (x, y) in enumerate(zip(a, b))]
    df = rows(spark, "result_id int, a double, b double, total_time double", data)
    kept = [r for r in data if r[2] is not None and all(0 < t <= 25.0 for t in (r[1], r[2], r[3]))]
    for k in (1, 2, 3):
        column = [r[k] for r in kept]
        low, high = np.quantile(column, 0.05), np.quantile(column, 0.9)
        kept = [r for r in kept if low <= r[k] <= high]
    found = studies.clean_times(df, ["a", "b", "total_time"], low=0.05, high=0.9)
    assert ids(found) == [r[0] for r in kept]
    # Coarse buckets that are soon too full take more passes and find the same.
    monkeypatch.setattr(studies, "BUCKETS", 3)
    monkeypatch.setattr(studies, "LISTED", 4)
    assert ids(studies.clean_times(df, ["a", "b", "total_time"], low=0.05, high=0.9)) == [r[0] for r in kept]


def jobs_of(spark, action):
    """How many jobs an action runs."""
    context = spark.sparkContext
    context.setJobGroup("counted", "counted")
    try:
        action()
        return len(context.statusTracker().getJobIdsForGroup("counted"))
    finally:
        context._jsc.clearJobGroup()


def test_clean_times_takes_two_passes_a_column(spark):
    rng = np.random.default_rng(6)
    columns = [f"c{k}" for k in range(6)]
    data = [(i, *map(float, rng.uniform(1, 9, 6)), 60.0) for i in range(500)]
    df = rows(spark, "result_id int, " + ", ".join(f"{c} double" for c in columns) + ", total_time double", data)
    few, many = (jobs_of(spark, lambda n=n: studies.clean_times(df, columns[:n], low=0.01, high=0.99)) for n in (2, 6))
    # A collected aggregate may count as two jobs, one per stage.
    assert many - few <= 4 * 4


def test_cut_points(spark, monkeypatch):
    values = [5.0] * 40 + [1.0, 2.0, 2.0, 9.0, 1e9, None]
    df = numbers(spark, values)
    known = [v for v in values if v is not None]
    for buckets, listed in ((4096, 50_000), (2, 1)):
        monkeypatch.setattr(studies, "BUCKETS", buckets)
        monkeypatch.setattr(studies, "LISTED", listed)
        found = studies.cut_points(df, "v", [0.0, 0.05, 0.5, 0.99, 1.0], 1.0, 1e9)
        assert found == pytest.approx(list(np.quantile(known, [0.0, 0.05, 0.5, 0.99, 1.0])))
    assert studies.cut_points(df.where("v is null"), "v", [0.5], 0.0, 1.0) is None


def test_faster_than_mean(spark):
    assert ids(studies.faster_than_mean(numbers(spark, [1.0, 2.0, 9.0]), "v")) == [0, 1]


def test_to_minutes(spark):
    df = rows(spark, "a double, b double", [(3600.0, 60.0), (3000.0, 61.0), (None, 299.0)])
    assert [tuple(r) for r in studies.to_minutes(df, ["a", "b"]).collect()] == [(60.0, 60.0), (50.0, 61.0), (None, 299.0)]


def test_z_scores(spark):
    df = rows(spark, "g int, a double, b double", [(1, 1.0, 5.0), (1, 3.0, 5.0), (2, 7.0, 1.0), (2, None, 2.0)])
    found = [(r.a_z, r.b_z) for r in studies.z_scores(df, ["g"], ["a", "b"]).orderBy("g", "b", "a").collect()]
    assert found == [(-1.0, None), (1.0, None), (None, -1.0), (None, 1.0)]


def test_shares(spark):
    df = rows(spark, "a double, b double", [(1.0, 3.0), (2.0, None), (0.0, 0.0)])
    assert [(r.a_share, r.b_share) for r in studies.shares(df, ["a", "b"]).collect()] == [(0.25, 0.75), (1.0, None), (None, None)]


def test_average_rank_percentile(spark):
    df = numbers(spark, [10.0, 20.0, 20.0, 30.0, None]).withColumn("g", F.lit(1))
    found = {r.result_id: r.percentile for r in studies.average_rank_percentile(df, ["g"], "v").collect()}
    assert found == {0: 0.25, 1: 0.625, 2: 0.625, 3: 1.0}


def test_pace_buckets_include_their_upper_edge(spark):
    found = by(studies.pace_buckets(numbers(spark, [55.0, 55.1, 60.0, 64.0, 80.0, 0.0, 2000.0]), "v"), "pace_bucket")
    assert {k: r["count"] for k, r in found.items()} == {"<55": 1, "55-60": 2, "60-65": 1, "70+": 1}
    assert found["55-60"].mean == pytest.approx(57.55)


def test_group_statistics(spark):
    data = [("x", "f", float(v)) for v in range(1, 6)] + [("x", "m", 1.0), ("x", "f", 0.0)]
    df = rows(spark, "event string, gender string, t double", data)
    found = studies.group_statistics(df, ["event", "gender"], ["t"], at_least=5).collect()
    assert [(r.gender, r.metric, r["count"], r.mean, r.sd, r.median, r.iqr) for r in found] == [
        ("f", "t", 5, 3.0, pytest.approx(2**0.5), 3.0, 2.0)
    ]


def test_shared_histograms_have_common_edges(spark):
    data = [("x", g, float(v)) for g, vs in (("f", (1, 2, 3)), ("m", (7, 8, 9))) for v in vs]
    df = rows(spark, "event string, gender string, t double", data)
    found = studies.shared_histograms(df, "event", "gender", ["t"], 4, at_least=2).collect()
    edges = {g: sorted((r.start, r.end) for r in found if r.gender == g) for g in "fm"}
    assert edges["f"] == edges["m"] and edges["f"][0][0] == 1.0 and edges["f"][-1][1] == 9.0
    assert {g: [r["count"] for r in sorted(found, key=lambda r: r.bin) if r.gender == g] for g in "fm"} == {"f": [2, 1, 0, 0], "m": [0, 0, 0, 3]}


def test_groups_are_gated_twice(spark):
    data = [("x", "f", 2.0, 1.0), ("x", "f", 4.0, 1.0), ("x", "f", -9.0, 2.0), ("x", "m", 6.0, None), ("x", "m", 8.0, 1.0), ("x", "n", 5.0, 5.0), ("x", "n", -1.0, 7.0)]
    df = rows(spark, "event string, gender string, t double, w double", data)
    used = {r.gender: r.n_used for r in studies.large_groups(df, ["event", "gender"], 2, ["t", "w"]).collect()}
    assert used == {"f": 3, "n": 2}
    found = studies.shared_histograms(df, "event", "gender", ["t", "w"], 2, at_least=2).collect()
    # Group m has one complete row; n has one positive t. The edges hold every value of f and n.
    assert {(r.gender, r.metric) for r in found} == {("f", "t"), ("f", "w"), ("n", "w")}
    assert [(r.start, r.end, r["count"]) for r in sorted(found, key=lambda r: r.bin) if (r.gender, r.metric) == ("f", "t")] == [(-9.0, -2.0, 0), (-2.0, 5.0, 2)]


def test_column_distributions(spark):
    stats, bins = studies.column_distributions(rows(spark, "a double, b double", [(1.0, 10.0), (3.0, None), (8.0, 20.0)]), ["a", "b"], 5)
    assert {r.metric: (r.mean, r.median) for r in stats.collect()} == {"a": (4.0, 3.0), "b": (15.0, 15.0)}
    assert bins.groupBy("metric").agg(F.sum("count").alias("n")).where("metric = 'b'").first().n == 2


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.default_rng(11)
    data = []
    for i in range(400):
        event = ["berlin", "london", "rome"][i % 3]
        sled, burpee, wall = rng.uniform(2, 5), rng.uniform(3, 6), rng.uniform(4, 8)
        slope = {"berlin": 1.0, "london": 2.0, "rome": 0.5}[event]
        run = 20 + slope * sled + 0.7 * burpee + 0.3 * wall + rng.normal(0, 0.1 * sled)
        data.append((event, *map(float, (sled, burpee, wall, run))))
    return data, rows(spark, "event string, sled double, burpee double, wall double, run double", data)


def test_regression_with_robust_errors(spark, field):
    data, df = field
    fitted = studies.regression(df, "run", "event", "sled", ["burpee", "wall"], reference="london")
    terms = ["intercept", "berlin", "rome", "sled", "burpee", "wall", "berlin:sled", "rome:sled"]
    x = np.array([[1, e == "berlin", e == "rome", s, b, w, (e == "berlin") * s, (e == "rome") * s] for e, s, b, w, _ in data], float)
    y = np.array([r[-1] for r in data])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    weight = ((y - x @ beta) / (1 - np.einsum("ij,jk,ik->i", x, inverse, x))) ** 2
    errors = np.sqrt(np.diag(inverse @ (x.T * weight) @ x @ inverse))
    found = by(fitted.coefficients, "term")
    assert np.allclose([found[t].coefficient for t in terms], beta, rtol=1e-6, atol=1e-6)
    assert np.allclose([found[t].robust_error for t in terms], errors, rtol=1e-6)
    assert found["sled"].p_value < 1e-6
    with pytest.raises(InvalidRequest):
        studies.regression(df, "run", "event", "sled", ["burpee"], reference="paris")


def test_regression_with_many_events(spark):
    rng = np.random.default_rng(12)
    data = [(f"e{i % 400}", float(rng.uniform(2, 5)), float(rng.uniform(3, 6))) for i in range(2400)]
    data = [(e, s, b, 3.0 + int(e[1:]) + (1 + int(e[1:]) % 3) * s + 0.5 * b) for e, s, b in data]
    # An event of one start and one without spread: their slope is zero, and their rows are met exactly.
    data += [("single", 3.0, 4.0, 50.0), ("flat", 2.0, 4.0, 8.0), ("flat", 2.0, 6.0, 9.0)]
    df = rows(spark, "event string, sled double, burpee double, run double", data)
    fitted = studies.regression(df, "run", "event", "sled", ["burpee"], reference="e399")
    found = by(fitted.coefficients, "term")
    assert len(found) == 2 * 402 + 1
    assert found["burpee"].coefficient == pytest.approx(0.5)
    assert found["e7"].coefficient == pytest.approx(7 - 399) and found["e7:sled"].coefficient == pytest.approx(1.0)
    assert fitted.predict(df).where("abs(prediction - run) > 1e-6").count() == 0
    none = studies.regression(df, "run", "event", "sled", [], reference="e399")
    assert none.coefficients.count() == 2 * 402
    assert fitted.predict(rows(spark, "event string, sled double, burpee double", [("new", 1.0, 1.0)])).first().prediction is None


def test_prediction_grid(spark, field):
    data, df = field
    fitted = studies.regression(df, "run", "event", "sled", ["burpee", "wall"], reference="london")
    grid = studies.prediction_grid(df, "event", "sled", ["burpee", "wall"], ["berlin", "rome"], low_percent=10, steps=5)
    found = fitted.predict(grid).orderBy("event", "step").collect()
    assert [r.event for r in found] == ["berlin"] * 5 + ["rome"] * 5
    sleds = np.array([r[1] for r in data])
    assert np.allclose([r.sled for r in found[:5]], np.linspace(np.quantile(sleds, 0.1), np.quantile(sleds, 0.9999), 5))
    assert found[0].burpee == pytest.approx(np.quantile([r[2] for r in data if r[0] == "berlin"], 0.1))
    assert found[4].prediction > found[0].prediction
    apart = studies.prediction_grid(df, "event", "sled", ["burpee", "wall"], ["rome"], low_percent={"burpee": 10, "wall": 40}, steps=2).first()
    assert apart.burpee == pytest.approx(np.quantile([r[2] for r in data if r[0] == "rome"], 0.1))
    assert apart.wall == pytest.approx(np.quantile([r[3] for r in data if r[0] == "rome"], 0.4))


def test_remainders(spark):
    df = rows(
        spark,
        "work_time double, total_time double, run_time double, sledPush_time double, burpeeBroadJump_time double",
        [(30.0, 70.0, 35.0, 3.0, 4.0)],
    )
    got = studies.with_remainders(df).first()
    assert (got.remaining_work, got.remaining_time) == (23.0, 28.0)
