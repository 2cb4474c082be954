"""The two ways of ordering work must agree, whatever the groups look like."""

import random

import numpy as np
import pandas as pd
import pytest
from fixtures import rows
from pyspark.sql import functions as F

from paceline.operators import cohorts, ordering, stats
from paceline.operators.ordering import (
    HOT_ROWS,
    count_below,
    count_below_few,
    hot_groups,
    quantiles_in_group,
    rank_in_group,
    running_total,
)

SCHEMA = "id int, g string, h int, v double, w long"
LIMITS = [HOT_ROWS, 50]


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds a third of the rows, one value a third of that group, one group has no key."""
    random.seed(3)
    data = []
    for i in range(1200):
        group = "hot" if i % 3 == 0 else random.choice(["a", "b", None, *[f"s{k}" for k in range(60)]])
        value = 50.0 if group == "hot" and random.random() < 0.33 else round(random.uniform(1, 99), 1)
        data.append((i, group, random.choice([1, 2]), value, random.randint(1, 5)))
    return rows(spark, SCHEMA, data).repartition(4).cache()


@pytest.fixture(scope="module")
def frame(skewed):
    pdf = skewed.toPandas()
    pdf["g"] = pdf["g"].where(pdf["g"].notna(), "<none>")
    return pdf


def as_frame(df, *order):
    pdf = df.toPandas()
    if "g" in pdf:
        pdf["g"] = pdf["g"].where(pdf["g"].notna(), "<none>")
    return pdf.sort_values(list(order)).reset_index(drop=True)


def test_hot_groups_lists_only_the_large_ones(skewed, frame):
    hot = hot_groups(skewed, ["g"], 100)
    assert [r[0] for r in hot.table.collect()] == ["hot"] and hot.rows == (frame.g == "hot").sum()
    assert hot_groups(skewed, ["g"], 10_000) is None
    assert hot_groups(skewed, ["g"], None) is None


@pytest.mark.parametrize("limit", LIMITS)
def test_running_total(skewed, frame, limit):
    hot = hot_groups(skewed, ["g"], limit)
    found = as_frame(running_total(skewed, ["g"], ["v", "id"], "w", "total", hot), "id")
    ordered = frame.sort_values(["g", "v", "id"])
    expected = ordered.assign(total=ordered.groupby("g").w.cumsum()).sort_values("id")
    assert found.total.tolist() == expected.total.tolist()


@pytest.mark.parametrize("limit", LIMITS)
def test_rank(skewed, frame, limit):
    found = as_frame(rank_in_group(skewed, ["g"], "v", "id", "x", limit), "id")
    ordered = frame.sort_values(["g", "v", "id"])
    group = ordered.groupby("g")
    expected = ordered.assign(rank=group.cumcount() + 1, size=group.v.transform("size"), low=group.v.rank("min")).sort_values("id")
    assert found.x_rank.tolist() == expected["rank"].tolist()
    assert found.x_size.tolist() == expected["size"].tolist()
    share = np.where(expected["size"] == 1, 1.0, 1 - (expected.low - 1) / (expected["size"] - 1).clip(lower=1))
    assert np.allclose(found.x_percentile, share)


@pytest.mark.parametrize("limit", LIMITS)
def test_quantiles(skewed, frame, limit):
    points = {"median": 0.5, "p05": 0.05, "p90": 0.9, "low": 0.0001, "top": 1.0}
    found = as_frame(quantiles_in_group(skewed, ["g"], "v", points, limit), "g").set_index("g")
    for name, q in points.items():
        expected = frame.groupby("g").v.quantile(q)
        assert np.allclose(found[name], expected.loc[found.index]), name
    assert np.allclose(found["mean"], frame.groupby("g").v.mean().loc[found.index])
    assert found["count"].tolist() == frame.groupby("g").v.count().loc[found.index].tolist()


@pytest.mark.parametrize("ways", [(count_below, HOT_ROWS), (count_below, 50), (count_below_few, HOT_ROWS)])
def test_count_below(spark, skewed, frame, ways):
    way, limit = ways
    probes = rows(spark, "g string, v double", [("hot", 50.0), ("hot", 50.05), ("hot", 0.0), ("hot", 1e9), (None, 40.0), ("none such", 1.0)])
    found = way(skewed, probes, ["g"], "v", limit).collect()
    assert len(found) == 6
    for r in found:
        values = frame[frame.g == ("<none>" if r.g is None else r.g)].v
        assert (r.below, r.equal, r.total) == ((values < r.v).sum(), (values == r.v).sum(), len(values)), r


@pytest.mark.parametrize("limit", LIMITS)
def test_time_window_standing(skewed, frame, limit):
    found = cohorts.time_window_standing(skewed, 5.0, ["g"], "v", limit).collect()
    assert len(found) == len(frame)
    for r in found[::7]:
        group = frame[frame.g == ("<none>" if r.g is None else r.g)].v
        near = group[(group >= r.v - 5.0) & (group <= r.v + 5.0)]
        assert (r.window_size, r.window_faster) == (len(near), (near < r.v).sum())
        share = 1.0 if len(near) == 1 else 1 - (near < r.v).sum() / (len(near) - 1)
        assert r.window_percentile == pytest.approx(share)


def test_many_probes_are_not_carried_around(spark, skewed, monkeypatch):
    monkeypatch.setattr(ordering, "FEW_PROBES", 3)
    probes = skewed.select("g", "v").distinct()
    few, many = (
        {(r.g, r.v): (r.below, r.equal, r.total) for r in way(skewed, probes, ["g"], "v").collect()} for way in (count_below_few, count_below)
    )
    assert few == many and len(few) > 3


def test_histogram_counts_every_value(skewed, frame):
    found = as_frame(stats.histogram(skewed, ["g"], "v", 7), "g", "bin")
    assert found.groupby("g")["count"].sum().to_dict() == frame.groupby("g").size().to_dict()
    assert set(found.groupby("g").size()) == {7}
    hot = frame[frame.g == "hot"].v
    expected, edges = np.histogram(hot, bins=7)
    part = found[found.g == "hot"]
    assert part["count"].tolist() == expected.tolist()
    assert np.allclose(part["start"], edges[:-1]) and np.allclose(part["end"], edges[1:])


def test_histogram_of_one_value(spark):
    found = stats.histogram(rows(spark, "g int, v double", [(1, 5.0), (1, 5.0), (2, None)]), ["g"], "v", 4).orderBy("bin").collect()
    assert [(r.bin, r.start, r.end, r["count"]) for r in found] == [(0, 5.0, 5.25, 2), (1, 5.25, 5.5, 0), (2, 5.5, 5.75, 0), (3, 5.75, 6.0, 0)]


def test_histogram_labels_ignore_case_in_order(spark):
    df = rows(spark, "g int, v double, t string", [(1, 1.0, "b"), (1, 1.0, " a "), (1, 1.0, "B"), (1, 1.0, ""), (1, 2.0, None)])
    found = stats.histogram(df, ["g"], "v", 2, label="t").orderBy("bin").collect()
    assert [r.labels for r in found] == [["a", "B", "b"], []]


def test_facets(spark):
    df = rows(
        spark,
        "season int, division string",
        [(8, "open"), (9, " Pro "), (8, ""), (None, None), (9, "doubles")],
    )
    found = stats.facets(df, ["season"], ["division", "absent"]).orderBy("facet", "position").collect()
    assert [(r.facet, r.value) for r in found] == [
        ("division", "doubles"), ("division", "open"), ("division", "Pro"), ("season", "9"), ("season", "8"),
    ]


def test_ranged_order_keeps_strings_and_nulls(spark):
    df = rows(spark, "g string, t string, id string, w int", [(None, None, "a", 1), (None, "x", "b", 1), ("g", "z", "c", 1), ("g", "é", "d", 1)])
    hot = hot_groups(df, ["g"], 1)
    assert hot.rows == 4
    found = {r.id: r.n for r in running_total(df, ["g"], ["t", "id"], "w", "n", hot).collect()}
    assert found == {"a": 1, "b": 2, "c": 1, "d": 2}


def test_no_group_reaches_one_task_whole(spark):
    """The range way cuts a group over partitions."""
    df = spark.range(2000).select(F.lit(1).alias("g"), F.col("id").alias("v"), F.lit(1).alias("w"))
    hot = hot_groups(df, ["g"], 100)
    plan = running_total(df, ["g"], ["v"], "w", "n", hot)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_part" in plan and pd.notna(hot.rows)


def test_ranged_partitions_follow_rows_not_the_limit(spark, monkeypatch):
    """A limit of one row per group made two partitions per row; ties run over several partitions here."""
    df = spark.range(4000).select(
        (F.col("id") % 3).cast("string").alias("g"), F.nullif(F.floor(F.col("id") / 3) % 5, F.lit(4)).cast("double").alias("v"), "id"
    )
    wanted, cut = [], type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, n, *by: wanted.append(n) or cut(self, n, *by))
    shown = ["id", "x_rank", "x_size", "x_percentile"]
    plain = {tuple(r) for r in rank_in_group(df, ["g"], "v", "id", "x", None).select(*shown).collect()}
    for parts in (2, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            ranked = {tuple(r) for r in rank_in_group(df, ["g"], "v", "id", "x", 1).select(*shown).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 2)
        assert ranked == plain
    assert wanted == [2, 40]
