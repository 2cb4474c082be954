"""What is shuffled on the way to the warehouse tables and the split queries, and that the rows stay the same."""

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from paceline.operators import ordering
from paceline.operators.ordering import HOT_ROWS
from paceline.plans import compare, derived, profile, report
from paceline.schema import COHORT_KEYS
from paceline.sources.warehouse import read_table, write_table
from paceline.suite import star


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def wide(spark):
    """40 results in cohorts with a missing key, ties, missing splits and a null id."""
    n = F.col("id")
    return spark.range(40).select(
        F.nullif(n, F.lit(39)).alias("result_id"),
        (n % 2 + 7).cast("int").alias("season"),
        F.nullif((n % 3).cast("string"), F.lit("2")).alias("location"),
        *[F.concat(F.lit(c), (n % 1).cast("string")).alias(c) for c in COHORT_KEYS[2:]],
        (n % 4).cast("double").alias("run1_time_min"),
        F.when(n % 5 != 0, (n % 7).cast("double")).alias("run2_time_min"),
        F.when(n % 3 != 0, n / 2).alias("skiErg_time_min"),
    )


def test_split_percentiles_shuffle_results_not_splits(spark):
    rows = wide(spark)
    ranked = derived.split_percentiles_of(rows)
    plan = plan_of(ranked)
    # One shuffle, of wide rows: it lies below the generator of splits.
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    plain = derived.split_percentiles(derived.splits_of(rows), HOT_ROWS)
    large = derived.split_percentiles_of(rows, 3)
    shown = ["result_id", "location", "split_name", "split_time_min", "split_rank", "split_size", "split_percentile"]
    wanted = sorted(map(str, plain.select(*shown).collect()))
    assert sorted(map(str, ranked.select(*shown).collect())) == wanted
    assert sorted(map(str, large.select(*shown).collect())) == wanted and len(wanted) == 40 + 32 + 26


def test_split_time_map_is_shuffled_once(spark):
    splits = derived.splits_of(wide(spark))
    assert plan_of(report.split_time_map(splits)).count("Exchange") == 1


def test_segment_values_join_before_rows_are_taken_apart(spark):
    rows = wide(spark).where("result_id is not null")
    splits = spark.createDataFrame([(1, "Run 1", 9.0), (1, "run1", 8.0), (2, "SKIERG", 5.0), (3, "run2", None)], "result_id long, split_name string, split_time_min double")
    found = compare.segment_values(rows, splits, fill=0.0)
    plan = plan_of(found)
    assert plan.index("Generate") < plan.index("Join")
    values = {(r.result_id, r.segment): r.minutes for r in found.collect()}
    assert len(values) == 39 * 3
    assert values[1, "run1_time_min"] == 9.0 and values[2, "skiErg_time_min"] == 5.0
    assert values[3, "run2_time_min"] == 3.0 and values[3, "skiErg_time_min"] == 0.0


def test_compare_results_partitions_follow_the_rows(spark):
    """Against a dictionary, as a short list of pairs and as a long one; ids missing, null, repeated, names spelt twice, blank or null."""
    results = [(i, float(i), 10.0 + i, None if i % 4 == 0 else 1.0) for i in range(40)] + [(3, 99.0, None, None), (None, 5.0, 5.0, 5.0)]
    spelt = ["Run 1", "run_1", "SkiErg", " ", None]
    splits = [(i, spelt[k], None if i % 7 == 0 else i + k / 8) for i in range(45) for k in range(5) if (i + k) % 3] + [(None, "Run 1", 1.0)]
    pairs = [(i, i, i + 3) for i in range(0, 60, 2)] + [(4, 9, 9), (None, 1, 2), (None, 5, None), (7, None, 80)]
    tables = (
        spark.createDataFrame(results, "result_id long, total_time_min double, run_time_min double, roxzone_time_min double"),
        spark.createDataFrame(splits, "result_id long, split_name string, split_time_min double"),
        spark.createDataFrame(pairs, "pair_id long, base_id long, other_id long"),
    )
    wanted = {}
    for pair, *ends in pairs:
        for side, end in enumerate(ends):
            lines = [line for i, total, run, rox in results if i == end is not None for line in (
                ("total_time", "Total time", total), ("run_roxzone", "Run + Roxzone", None if None in (run, rox) else run + rox),
            )]
            plain = {name: "".join(c for c in (name or "").lower() if c.isalnum()) for name in spelt}
            lines += [(f"split-{plain[name]}", name, m) for i, name, m in splits if i == end is not None and plain[name]]
            for key, label, minutes in lines:
                wanted.setdefault((pair, key), [([], []), ([], [])])
                wanted[pair, key][side][0].append(label)
                wanted[pair, key][side][1].extend([] if minutes is None else [minutes])
    rows = set()
    for (pair, key), ((labels, mine), (other_labels, theirs)) in wanted.items():
        a, b = max(mine, default=None), max(theirs, default=None)
        rows.add((pair, key, max(labels or other_labels), a, b, None if None in (a, b) else a - b))
    long = compare.compare_results(*tables, task_rows=100, short_list=0)
    for found in (compare.compare_results(*tables), long):
        shown = [tuple(r) for r in found.select("pair_id", "key", "label", "primary_value", "compare_value", "delta").collect()]
        assert len(shown) == len(rows) and set(shown) == rows
    # The session has 2 shuffle partitions, a task of the join gets 100 rows; names are made plain above the join.
    plan = plan_of(long)
    parts = -(-(len(results) + len(splits) + compare.LINES * 2 * len(pairs)) // 100)
    assert parts > 2 and plan.count(f", {parts}), REPARTITION_BY_NUM") == 4 and "Broadcast" not in plan
    assert plan.index("regexp_replace") < plan.rindex("Join") and plan.count("Exchange hashpartitioning(result_id") == 4


def test_times_are_summed_in_whole_numbers(spark, sf):
    # A sum of decimals carries a flag beside each wide number.
    assert "isEmpty" not in plan_of(star.times(spark, sf))


def test_a_table_is_written_without_a_shuffle(spark, tmp_path):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("write", "write")
    try:
        write_table(wide(spark).coalesce(2), str(tmp_path), "race_results")
        stages = [s for j in tracker.getJobIdsForGroup("write") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(stages) == 1
    assert read_table(spark, str(tmp_path), "race_results").count() == 40


def test_count_before_shuffles_probes_once(spark):
    """Against pairing; a null probe, a group without values, repeated probes, both ways of ordering."""
    data = [(g, float(v)) for g, v in [("a", 1), ("a", 2), ("a", 2), ("a", 5), ("b", 3), (None, 4)]]
    values = spark.createDataFrame([*data, ("a", None)], "g string, v double")
    asked = [(1, "a", 2.0, False), (2, "a", 2.0, True), (3, "a", 2.0, True), (4, "c", 9.0, True), (5, None, 4.0, True), (6, "a", None, True), (7, "b", 0.0, False)]
    probes = spark.createDataFrame(asked, "id int, g string, v double, upto boolean")
    for limit in (None, 1):
        found = ordering.count_before(values, probes, ["g"], "v", "n", "upto", limit)
        assert sorted(tuple(r) for r in found.select("id", "n").collect()) == sorted(
            (i, None if v is None else sum(h == g and (w <= v if up else w < v) for h, w in data)) for i, g, v, up in asked
        )
    plan = plan_of(ordering.count_before(values, probes, ["g"], "v", "n", "upto", None))
    assert "Join" not in plan and plan.count("Exchange") == 2


def batch_tables(spark):
    """Results with ties, a null time, null keys, ids that come twice; splits that repeat, lack a time, a name or a result."""
    results = [(i, "oslo" if i % 3 else None, 4 if i % 4 else None, None if i % 11 == 0 else 30.0 + (i * 7) % 13) for i in range(40)]
    results += [(50, "oslo", 4, 35.5), (50, "oslo", 4, 35.5), (51, "oslo", 4, 33.0), (51, "graz", 4, 34.0), (None, "oslo", 4, 36.0)]
    names = ["run1", "skiErg", None]
    splits = [(i, names[k], None if (i + k) % 9 == 0 else float((i * 5 + k) % 6)) for i in [*range(44), 50, 51] for k in range(3) if (i + k) % 4]
    splits += [(5, "run1", 4.25), (5, "run1", 4.25), (6, "run1", float("nan")), (None, "run1", 1.0)]
    return (
        spark.createDataFrame([(i, s, p, "solo", "F", "25-29", t) for i, p, s, t in results], "result_id long, season int, location string, division string, gender string, age_group string, total_time_min double"),
        spark.createDataFrame(splits, "result_id long, split_name string, split_time_min double"),
        results,
        splits,
    )


def both_ways(spark, part, once=False, **options):
    """`part` of a report of three quarters of the results: small groups in tasks, and over range sorts only; and all groups in tasks, of ids that come once."""
    results, splits, _, _ = batch_tables(spark)
    asked = spark.createDataFrame([(i,) for i in [*range(60), None] if i is None or i % 4 != 1 or i in (5, 50, 51)], "result_id long")
    found = []
    for limit in (9, 0):
        batch = report.BatchReports(results.where("result_id < 50") if once else results, splits, asked, 3.0, packed_rows=limit, **options)
        found.append(sorted(str(tuple(r)) for r in getattr(batch, part).collect()))
    plain = report.BatchReports(results.where("result_id < 50"), splits, asked, 3.0, **options)
    return found, getattr(plain, part)


def test_window_splits_shuffle_each_split_twice(spark):
    """By result and by group, never under blocks of ranks; against pairs, and the same as over range sorts."""
    found, plain = both_ways(spark, "window_splits")
    assert found[0] == found[1] and len(found[0]) > 80
    _, _, results, splits = batch_tables(spark)
    known = {i: (place, season, t) for i, place, season, t in results if i is not None and i < 50}
    rows = [(known[i][:2], name, known[i][2], s) for i, name, s in splits if i in known and s is not None and known[i][2] is not None]
    for row in plain.where("result_id <> 5").collect():
        race, t, s = known.get(row.result_id, (0, 0, None))[:2], known.get(row.result_id, (0, 0, None))[2], row.split_time_min
        near = [w for r, name, u, w in rows if (r, name) == (race, row.split_name) and t is not None and s is not None and abs(u - t) <= 3]
        faster = sum(w < s or (s != s and w == w) for w in near)
        wanted = None if not near else 1.0 if len(near) == 1 else 1 - faster / (len(near) - 1)
        assert row.split_percentile_time_window == wanted, row
    plan = plan_of(plain)
    assert "Generate" not in plan and "Window" not in plan
    assert plan.count("Exchange hashpartitioning(location") == 1


def test_window_bins_look_edges_up_in_tasks(spark):
    """Bins are no rows of a shuffle; counted from pairs, and the same as over range sorts."""
    found, plain = both_ways(spark, "window_bins", once=True, n_bins=5)
    plan = plan_of(plain)
    assert plan.count("Exchange hashpartitioning(location") == 1 and "Window" not in plan
    assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")]
    assert found[0] == found[1] and len(found[0]) > 100
    _, _, results, _ = batch_tables(spark)
    rows = {i: (place, season, t) for i, place, season, t in results if i is not None and i < 50 and t is not None}
    bins = {}
    for r in plain.collect():
        bins.setdefault(r.result_id, []).append((r.bin, r.start, r.end, r["count"]))
    assert set(bins) == {i for i in rows if i % 4 != 1 or i == 5}
    for i, got in bins.items():
        near = [t for *race, t in rows.values() if race == [*rows[i][:2]] and abs(t - rows[i][2]) <= 3]
        step = (max(near) - min(near) or 1.0) / 5
        edges = [min(near) + step * k for k in range(6)]
        counts = [sum(edges[k] <= t and (k == 4 or t < edges[k + 1]) for t in near) for k in range(5)]
        assert sorted(got) == [(k, edges[k], edges[k + 1], counts[k]) for k in range(5)]
    # Ids that come twice: the same result is one request, another result another one.
    tables = batch_tables(spark)
    twice = report.BatchReports(*tables[:2], tables[0].select("result_id"), 3.0, n_bins=5).window_bins.where("result_id >= 50")
    counts = {}
    for r in twice.collect():
        counts.setdefault((r.result_id, r.start if r.bin == 0 else None), []).append(r["count"])
    assert [len(counts[i, None]) for i in (50, 51)] == [4, 8] and len(counts) == 5


def test_window_stats_shuffle_results_once_by_race(spark):
    """Sums are exact, negative and large values too; the same as over range sorts."""
    found, plain = both_ways(spark, "window_stats")
    assert found[0] == found[1] and len(found[0]) > 25
    plan = plan_of(plain)
    assert plan.count("Exchange hashpartitioning(location") == 1 and "Window" not in plan
    assert "decimal" not in plan[plan.index("Exchange hashpartitioning(location") :]
    times = [-7.000000001, 0.1, 0.2, 0.3, 1e12, 1e12 + 0.123, -1e12]
    results = spark.createDataFrame(
        [(k, 4, "oslo", "solo", "F", "25-29", t) for k, t in enumerate(times)],
        "result_id long, season int, location string, division string, gender string, age_group string, total_time_min double",
    )
    splits = spark.createDataFrame([], "result_id long, split_name string, split_time_min double")
    stats = {r.result_id: r for r in report.BatchReports(results, splits, results.select("result_id"), 10.0).window_stats.collect()}
    near = [[u for u in times if abs(u - t) <= 10] for t in times]
    for k, window in enumerate(near):
        mean = sum(Decimal(repr(u)).quantize(Decimal("1e-9"), ROUND_HALF_UP) for u in window) / len(window)
        assert stats[k]["count"] == len(window) and abs(stats[k]["mean"] - mean) <= Decimal("1e-18")


def test_bests_are_found_before_percentiles(spark):
    """Only best rows are ranked, and rows are taken apart by metric after the best are found; against a dictionary."""
    n = F.col("id")
    results = spark.range(60).select(
        n.alias("result_id"),
        F.nullif((n % 5).cast("string"), F.lit("4")).alias("location"),
        F.nullif((2030 + n % 3).cast("int"), F.lit(2032)).alias("year"),
        F.nullif((n % 2).cast("string"), F.lit("2")).alias("division"),
        F.nullif((n % 7 % 2).cast("string"), F.lit("1")).alias("gender"),
        F.when(n % 6 != 0, (n % 8).cast("double")).alias("total_time_min"),
        F.when(n % 4 != 0, (n * 3 % 11).cast("double")).alias("skiErg_time_min"),
        (n % 9).cast("double").alias("run_time_min"),
        F.when(n % 9 < 7, (n % 3).cast("double")).alias("roxzone_time_min"),
    )
    rows = results.withColumn("athlete_id", F.nullif(F.col("result_id") % 13, F.lit(12)))
    wanted, groups, times = {}, {}, {}
    for r in rows.collect():
        both = r.run_time_min + r.roxzone_time_min if r.run_time_min > 0 and (r.roxzone_time_min or 0) > 0 else None
        for metric, time in (("overall", r.total_time_min), ("skierg", r.skiErg_time_min), ("runplusroxzone", both)):
            if time is not None and time > 0:
                times.setdefault((r.division, r.gender, metric), []).append(time)
                order = (time, -r.year if r.year else 2**31 - 1, r.location is None, r.location or "", r.result_id)
                if (r.athlete_id, metric) not in wanted or order < wanted[r.athlete_id, metric][0]:
                    wanted[r.athlete_id, metric] = order, r
    for (athlete, metric), (order, r) in wanted.items():
        cohort = times[r.division, r.gender, metric]
        share = 1.0 if len(cohort) == 1 else 1 - sum(t < order[0] for t in cohort) / (len(cohort) - 1)
        groups[athlete, metric] = (order[0], r.result_id, r.location, r.year, max(0.0, min(1.0, share)))
    for limit in (HOT_ROWS, 1):
        bests = profile.Profiles(rows, results, hot_rows=limit).bests
        assert {(b.athlete_id, b.metric): tuple(b)[2:] for b in bests.collect()} == groups and bests.count() == len(groups) == 39
    plan = plan_of(profile.Profiles(rows, results).bests)
    assert plan.index("Window") < plan.index("Generate") < plan.index("min(CASE")
