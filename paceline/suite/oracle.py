"""SQL that gives the same tables as the registered queries.

Written against the query results, not against the operators: plain windows, `quantile_cont`, joins.
Doubles are rounded to six places on both sides, whole numbers are BIGINT, lists are joined by a bar.
"""

from __future__ import annotations

from paceline.schema import RAW_RENAMES, STATIONS
from paceline.suite.star import LINES

STATION = [STATIONS[n - 1][0] for n in LINES]
RUNS = [f"run{n}_time_min" for n in LINES]
PLACES = [f"{s}_time_min" for s in STATION]
SPLITS = RUNS + PLACES
SEGMENT_VALUES = ["total_time_min", *SPLITS]
K5 = ["season", "location", "division", "gender", "age_group"]

RESULTS = """results AS (
  SELECT o_orderkey AS result_id,
         concat_ws(' ', CAST(year(o_orderdate) AS VARCHAR), r_name) AS event_id,
         concat_ws(' ', CAST(year(o_orderdate) AS VARCHAR), r_name) AS event_name,
         CAST(year(o_orderdate) AS BIGINT) AS season, CAST(year(o_orderdate) AS BIGINT) AS year,
         r_name AS location, o_orderpriority AS division, o_orderstatus AS gender,
         nullif(c_mktsegment, 'HOUSEHOLD') AS age_group, c_name AS name, c_custkey AS athlete_id,
         n_name AS nationality, strftime(o_orderdate, '%Y-%m-%d') AS start_date,
         o_totalprice AS total_time_min
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_LINE = "CAST(sum(CASE WHEN l_linenumber = {n} THEN CAST({c} AS DECIMAL(12,2)) END) AS DOUBLE)"
TIMES = (
    """times AS (
  SELECT l_orderkey AS result_id,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) / 997 AS run_time_min,
         CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS work_time_min,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / 997
           AS roxzone_time_min,
         """
    + ",\n         ".join(
        [_LINE.format(n=n, c="l_extendedprice") + f" / 997 AS run{n}_time_min" for n in LINES]
        + [_LINE.format(n=n, c="l_quantity") + f" AS {s}_time_min" for n, s in zip(LINES, STATION)]
    )
    + """
  FROM lineitem GROUP BY l_orderkey)"""
)
WIDE = "wide AS (SELECT * FROM results LEFT JOIN times USING (result_id))"
SPLIT_ROWS = (
    "splits AS (\n  "
    + "\n  UNION ALL ".join(
        f"SELECT result_id, event_id, {', '.join(K5)}, '{c.removesuffix('_time_min')}' AS split_name, {c} AS split_time_min "
        f"FROM wide WHERE {c} IS NOT NULL"
        for c in SPLITS
    )
    + ")"
)

SHAPE = "count(*) AS count, round(min({v}),6) AS min, round(max({v}),6) AS max, round(avg({v}),6) AS mean"
SEVEN = SHAPE + (
    ", round(quantile_cont({v},0.5),6) AS median, round(quantile_cont({v},0.1),6) AS p10,"
    " round(quantile_cont({v},0.9),6) AS p90"
)
FIVE = SHAPE + ", round(quantile_cont({v},0.5),6) AS median"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


BASE = with_(RESULTS)
FULL = with_(RESULTS, TIMES, WIDE)
SPLIT = with_(RESULTS, TIMES, WIDE, SPLIT_ROWS)


def rank_sql(keys, prefix, value="total_time_min", tie="result_id"):
    part = ", ".join(keys)
    return (
        f"row_number() OVER (PARTITION BY {part} ORDER BY {value}, {tie}) AS {prefix}_rank, "
        f"count(*) OVER (PARTITION BY {part}) AS {prefix}_size, "
        f"round(1 - percent_rank() OVER (PARTITION BY {part} ORDER BY {value}), 6) AS {prefix}_percentile"
    )


def segments_long(source: str, columns, floors=False) -> str:
    return "\n  UNION ALL ".join(
        f"SELECT '{c}' AS segment, {c} AS minutes FROM {source} WHERE {c} IS NOT NULL"
        + (f" AND {c} >= 1.0" if floors and c.startswith("run") else "")
        for c in columns
    )


SEGMENT_NAMES = (
    "names(segment, label, segment_group, position) AS (VALUES "
    + ", ".join(
        f"('{c}', '{label}', '{group}', {pos})"
        for c, label, group, pos in (
            [("total_time_min", "Total time", "overall", 0)]
            + [(f"run{n}_time_min", f"Run {n}", "runs", n) for n in range(1, 9)]
            + [(f"{s}_time_min", label, "stations", 9 + i) for i, (s, label) in enumerate(STATIONS)]
            + [
                ("run_time_min", "Total Run", "aggregate", 17),
                ("work_time_min", "Total Work", "aggregate", 18),
                ("roxzone_time_min", "Total Roxzone", "aggregate", 19),
            ]
        )
    )
    + ")"
)


def histogram_sql(source: str, keys, value, bins, shared=None, label=None, edges=None) -> str:
    """Histogram rows of `source`, to follow a WITH list; `edges` sets the ends, where not `source` does."""
    edges = edges or "hv"
    shared = keys if shared is None else shared

    def same(a, b, ks):
        return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in ks) or "TRUE"

    ks = ", ".join(keys)
    lists = (
        ""
        if label is None
        else f""",
hl AS (SELECT {ks}, bin, array_to_string(list(t ORDER BY lower(t), t), '|') AS labels
       FROM (SELECT DISTINCT {ks}, bin, trim({label}) AS t FROM hb WHERE trim({label}) <> '') GROUP BY {ks}, bin)"""
    )
    labels = "" if label is None else ", coalesce(hl.labels, '') AS labels"
    join = "" if label is None else f" LEFT JOIN hl ON {same('hg', 'hl', keys)} AND hl.bin = b.bin"
    return f""",
hv AS (SELECT * FROM {source} WHERE {value} IS NOT NULL),
he AS (SELECT {', '.join(shared)}, min({value}) AS lo, max({value}) AS hi FROM {edges} GROUP BY {', '.join(shared)}),
hg AS (SELECT DISTINCT {', '.join('hv.' + k for k in keys)}, he.lo, he.hi FROM hv JOIN he ON {same('hv', 'he', shared)}),
hb AS (SELECT hv.*, CASE WHEN he.hi > he.lo
         THEN CAST(least(floor((hv.{value} - he.lo) / (he.hi - he.lo) * {bins}), {bins - 1}) AS BIGINT) ELSE 0 END AS bin
       FROM hv JOIN he ON {same('hv', 'he', shared)}),
hc AS (SELECT {ks}, bin, count(*) AS n FROM hb GROUP BY {ks}, bin){lists}
SELECT {', '.join('hg.' + k for k in keys)}, CAST(b.bin AS BIGINT) AS bin,
  round(hg.lo + (CASE WHEN hg.hi > hg.lo THEN hg.hi - hg.lo ELSE 1.0 END) / {bins} * b.bin, 6) AS "start",
  round(hg.lo + (CASE WHEN hg.hi > hg.lo THEN hg.hi - hg.lo ELSE 1.0 END) / {bins} * (b.bin + 1), 6) AS "end",
  coalesce(hc.n, 0) AS count{labels}
FROM hg CROSS JOIN (SELECT unnest(range({bins})) AS bin) b
LEFT JOIN hc ON {same('hg', 'hc', keys)} AND hc.bin = b.bin{join}"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    # Ranks
    for name, keys in (("event", K5), ("season", [K5[0], *K5[2:]]), ("overall", K5[2:])):
        q[f"rank_{name}"] = f"{BASE}SELECT result_id, {rank_sql(keys, name)} FROM results"
    q["rank_overall_ranged"] = q["rank_overall"]
    q["race_rankings"] = (
        f"{BASE}SELECT result_id, season, {rank_sql(K5, 'event')}, {rank_sql([K5[0], *K5[2:]], 'season')}, "
        f"{rank_sql(K5[2:], 'overall')} FROM results"
    )
    q["race_rankings_ranged"] = q["race_rankings"]
    q["split_percentiles"] = q["split_percentiles_ranged"] = (
        f"{SPLIT}SELECT result_id, split_name, round(split_time_min,6) AS split_time_min, "
        f"{rank_sql([*K5, 'split_name'], 'split', 'split_time_min')} FROM splits"
    )
    cohort = "season = 1998 AND lower(division) = '2-high' AND lower(gender) IN ('f','female')"
    place = "row_number() OVER (ORDER BY total_time_min, result_id) AS placement"
    shown = "result_id, name, location, season, age_group, round(total_time_min,6) AS total_time_min"
    q["placement_topk"] = f"{BASE}SELECT {shown}, {place} FROM results WHERE {cohort} ORDER BY placement LIMIT 200"
    q["placement_named"] = (
        f"{BASE}SELECT * FROM (SELECT {shown}, {place} FROM results WHERE {cohort}) WHERE lower(name) LIKE '%7%'"
        " ORDER BY placement LIMIT 200"
    )
    q["placement_all"] = f"{BASE}SELECT result_id, {place} FROM results"
    q["placement_all_ranged"] = q["placement_all"]
    q["placement_lookup"] = (
        f"{BASE}SELECT 250000.0::DOUBLE AS target_time_min, count(*) FILTER (WHERE total_time_min < 250000) + 1 AS placement, "
        f"count(*) AS out_of, count(*) FILTER (WHERE total_time_min = 250000) AS exact_matches FROM results WHERE {cohort}"
    )
    q["placement_lookups"] = f"""{BASE}, r AS (
  SELECT season, division, gender, total_time_min + 1000 AS x FROM results)
SELECT r.season, r.division, r.gender, round(r.x,6) AS target_time_min,
  (SELECT count(*) FROM results s WHERE s.season = r.season AND s.division = r.division AND s.gender = r.gender
     AND s.total_time_min < r.x) + 1 AS placement,
  (SELECT count(*) FROM results s WHERE s.season = r.season AND s.division = r.division AND s.gender = r.gender) AS out_of,
  (SELECT count(*) FROM results s WHERE s.season = r.season AND s.division = r.division AND s.gender = r.gender
     AND s.total_time_min = r.x) AS exact_matches
FROM r""".replace("\n, r AS", ",\nr AS")
    q["location_bests"] = (
        f"{BASE}SELECT location, count(*) AS count, round(min(total_time_min),6) AS fastest_time_min FROM results "
        f"WHERE {cohort} GROUP BY location"
    )

    # Menus
    def facet_sql(where, numbers, texts, source="results"):
        parts = [
            f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value, row_number() OVER (ORDER BY {c} DESC) AS position "
            f"FROM (SELECT DISTINCT {c} FROM {source} WHERE {where} AND {c} IS NOT NULL)"
            for c in numbers
        ] + [
            f"SELECT '{c}' AS facet, v AS value, row_number() OVER (ORDER BY lower(v), v) AS position "
            f"FROM (SELECT DISTINCT trim({c}) AS v FROM {source} WHERE {where} AND trim({c}) <> '')"
            for c in texts
        ]
        return BASE + "\nUNION ALL ".join(parts)

    q["filter_menu"] = facet_sql("lower(division) = '1-urgent'", ["season", "year"], ["division", "gender", "location", "age_group"])
    q["deepdive_menu"] = facet_sql("season = 1998 AND lower(gender) IN ('f','female')", [], ["location", "age_group"])
    q["ranking_menu"] = (
        facet_sql(cohort, [], ["age_group"])
        + f"\nUNION ALL SELECT 'location', v, row_number() OVER (ORDER BY lower(v), v) FROM (SELECT DISTINCT trim(location) AS v "
        f"FROM results WHERE {cohort} AND lower(age_group) = 'machinery')"
    )
    q["list_races"] = (
        f"{BASE}SELECT event_name, event_id, location, season, year, count(*) AS participant_count FROM results GROUP BY ALL"
    )
    q["split_names"] = f"{SPLIT}SELECT DISTINCT split_name FROM splits"
    q["divisions_per_event"] = (
        f"{BASE}SELECT event_name, array_to_string(list(DISTINCT division ORDER BY division), '|') AS divisions, "
        "count(DISTINCT division) AS n_divisions FROM results GROUP BY event_name"
    )
    q["distinct_folded"] = (
        "SELECT min(trim(p_name)) AS p_name FROM part WHERE trim(p_name) <> '' GROUP BY lower(trim(p_name))"
    )
    q["distinct_numbers"] = "SELECT DISTINCT CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size IS NOT NULL"

    # Statistics
    v = "total_time_min"
    q["describe_seven"] = f"{BASE}SELECT season, location, {SEVEN.format(v=v)} FROM results GROUP BY season, location"
    q["describe_ranged"] = f"{BASE}SELECT age_group, {SEVEN.format(v=v)} FROM results GROUP BY age_group"
    q["describe_five"] = f"{BASE}SELECT division, {FIVE.format(v=v)} FROM results GROUP BY division"
    q["column_summary"] = " UNION ALL ".join(
        f"SELECT '{c}' AS column, count({c}) AS count, round(avg({c}),6) AS mean, round(stddev_samp({c}),6) AS sd, round(min({c}),6) AS min, "
        f"round(quantile_cont({c},0.25),6) AS q1, round(median({c}),6) AS median, round(quantile_cont({c},0.75),6) AS q3, round(max({c}),6) AS max FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    )
    q["histogram"] = f"{with_(RESULTS)[:-1]}{histogram_sql('results', ['location', 'age_group'], v, 22)}"
    q["histogram_labels"] = f"{with_(RESULTS)[:-1]}{histogram_sql('results', ['season'], v, 30, label='nationality')}"
    open_f = "lower(division) = '5-low' AND lower(gender) IN ('f','female')"
    latest = f"season = (SELECT max(season) FROM results WHERE {open_f})"
    skierg = f"""picked AS (SELECT 'skiErg_time_min' AS segment, skiErg_time_min AS minutes FROM wide
  WHERE {open_f} AND {latest} AND skiErg_time_min IS NOT NULL)"""
    q["distribution_stats"] = f"""{with_(RESULTS, TIMES, WIDE, skierg)}, s AS (
  SELECT segment, {SEVEN.format(v='minutes')} FROM picked GROUP BY segment)
SELECT segment, count, min, max, mean, median, CASE WHEN count >= 30 THEN p10 END AS p10,
  CASE WHEN count >= 30 THEN p90 END AS p90, count < 30 AS small_sample FROM s""".replace(")\n, s", "),\ns")
    q["distribution_bins"] = with_(RESULTS, TIMES, WIDE, skierg)[:-1] + histogram_sql("picked", ["segment"], "minutes", 22)
    long = f"long AS ({segments_long('wide WHERE_', SEGMENT_VALUES, True)})".replace("wide WHERE_ WHERE", "wide WHERE season = 1997 AND total_time_min >= 50000 AND total_time_min <= 400000 AND")
    planner = with_(RESULTS, TIMES, WIDE, SEGMENT_NAMES, long)
    q["planner_stats"] = (
        f"{planner}SELECT n.segment, n.label, n.segment_group, CAST(n.position AS BIGINT) AS position, s.* EXCLUDE (segment) FROM "
        f"(SELECT segment, {SEVEN.format(v='minutes')} FROM long GROUP BY segment) s JOIN names n USING (segment)"
    )
    q["planner_bins"] = planner[:-1] + histogram_sql("long", ["segment"], "minutes", 22)
    race = "season = 1996 AND lower(location) = 'asia'"
    summary_columns = [*SEGMENT_VALUES, "run_time_min", "work_time_min", "roxzone_time_min"]

    def summary(picked):
        lines = f"picked AS ({picked})"
        rows = f"long AS ({segments_long('picked', summary_columns)})"
        return (
            with_(RESULTS, TIMES, WIDE, SEGMENT_NAMES, lines, rows)
            + f"SELECT segment, n.label, n.segment_group, s.* EXCLUDE (segment) FROM (SELECT segment, {SEVEN.format(v='minutes')}"
            " FROM long GROUP BY segment) s JOIN names n USING (segment)"
        )

    q["race_summary"] = summary(f"SELECT * FROM wide WHERE {race}")
    q["race_summary_fastest"] = summary(
        f"SELECT * FROM wide WHERE {race} AND total_time_min <= (SELECT quantile_cont(total_time_min, 0.1) FROM wide WHERE {race})"
    )
    top = f"SELECT * FROM wide WHERE {race} ORDER BY total_time_min, result_id LIMIT 100"
    q["segment_averages_top"] = summary(top)
    q["segment_averages_bottom"] = summary(
        f"SELECT * FROM wide WHERE {race} ORDER BY total_time_min DESC, result_id DESC LIMIT 100"
    )
    q["group_averages"] = f"""{with_(RESULTS, TIMES, WIDE, SEGMENT_NAMES, f"picked AS ({top})", f"long AS ({segments_long('picked', SEGMENT_VALUES)})")}
SELECT segment_group, round(avg(m),6) AS avg_time_min FROM (SELECT segment, avg(minutes) AS m FROM long GROUP BY segment)
JOIN names USING (segment) WHERE segment_group IN ('runs','stations') GROUP BY segment_group"""
    q["fastest_share"] = f"""{BASE}SELECT result_id, round(threshold,6) AS threshold FROM (
  SELECT *, quantile_cont(total_time_min, 0.05) OVER (PARTITION BY season, location) AS threshold FROM results)
WHERE total_time_min <= threshold"""
    q["split_statistics"] = (
        f"{SPLIT}SELECT location, lower(split_name) AS split, {SEVEN.format(v='split_time_min')} FROM splits "
        "WHERE split_name NOT LIKE 'run%' OR split_time_min >= 1.0 GROUP BY location, lower(split_name)"
    )
    q["split_histograms"] = (
        with_(RESULTS, TIMES, WIDE, SPLIT_ROWS, "named AS (SELECT location, lower(split_name) AS split, split_time_min FROM splits WHERE split_name NOT LIKE 'run%' OR split_time_min >= 1.0)")[:-1]
        + histogram_sql("named", ["location", "split"], "split_time_min", 22)
    )

    # Cohorts and the report
    same5 = " AND ".join(f"r.{k} IS NOT DISTINCT FROM p.{k}" for k in K5)
    q["demographic_cohort"] = (
        f"{BASE}SELECT r.result_id, round(r.total_time_min,6) AS total_time_min FROM results r "
        f"JOIN (SELECT * FROM results WHERE result_id = 7) p ON {same5}"
    )
    q["cohorts_of_winners"] = f"""{with_(RESULTS, "winners AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season, location ORDER BY total_time_min, result_id) AS k FROM results) WHERE k = 1)")}
SELECT r.result_id FROM results r WHERE EXISTS (SELECT 1 FROM winners p WHERE {same5})"""
    q["time_window_cohort"] = (
        f"{BASE}SELECT r.result_id, round(r.total_time_min,6) AS total_time_min FROM results r "
        "JOIN (SELECT * FROM results WHERE result_id = 7) p ON r.location IS NOT DISTINCT FROM p.location "
        "AND r.season IS NOT DISTINCT FROM p.season AND r.total_time_min BETWEEN p.total_time_min - 5000 AND p.total_time_min + 5000"
    )
    window = f"""{BASE}SELECT a.result_id, count(*) AS window_size,
  count(*) FILTER (WHERE b.total_time_min < a.total_time_min) AS window_faster,
  round(CASE WHEN count(*) = 1 THEN 1.0 ELSE 1 - count(*) FILTER (WHERE b.total_time_min < a.total_time_min) / (count(*) - 1) END, 6)
    AS window_percentile
FROM results a JOIN results b ON a.location = b.location AND a.season = b.season
  AND b.total_time_min BETWEEN a.total_time_min - 5000.0 AND a.total_time_min + 5000.0 GROUP BY a.result_id"""
    q["time_window_standing"] = window
    q["time_window_standing_ranged"] = window
    ranks = f"ranks AS (SELECT *, {rank_sql(K5, 'event')}, {rank_sql([K5[0], *K5[2:]], 'season')}, {rank_sql(K5[2:], 'overall')} FROM results)"
    q["report_race"] = (
        f"{with_(RESULTS, ranks)}SELECT result_id, name, round(total_time_min,6) AS total_time_min, event_rank, event_size, "
        "event_percentile, season_rank, season_size, season_percentile, overall_rank, overall_size, overall_percentile "
        "FROM ranks WHERE result_id = 7"
    )
    q["report_cohort"] = (
        f"{with_(RESULTS, ranks)}SELECT r.result_id, r.event_rank, r.event_size, r.event_percentile FROM ranks r "
        f"JOIN (SELECT * FROM ranks WHERE result_id = 7) p ON {same5}"
    )
    near = (
        "near AS (SELECT r.result_id FROM results r JOIN (SELECT * FROM results WHERE result_id = 7) p ON r.location = p.location "
        "AND r.season = p.season AND r.total_time_min BETWEEN p.total_time_min - 20000 AND p.total_time_min + 20000)"
    )
    split_ranks = f"sp AS (SELECT *, {rank_sql([*K5, 'split_name'], 'split', 'split_time_min')} FROM splits)"
    q["report_splits"] = f"""{with_(RESULTS, TIMES, WIDE, SPLIT_ROWS, near, split_ranks)}
SELECT a.split_name, round(a.split_time_min,6) AS split_time_min, a.split_rank, a.split_size, a.split_percentile,
  round(CASE WHEN count(b.split_time_min) = 1 THEN 1.0
    ELSE 1 - count(*) FILTER (WHERE b.split_time_min < a.split_time_min) / (count(b.split_time_min) - 1) END, 6)
    AS split_percentile_time_window
FROM sp a LEFT JOIN (SELECT * FROM splits WHERE result_id IN (SELECT result_id FROM near)) b ON a.split_name = b.split_name
WHERE a.result_id = 7 GROUP BY ALL"""
    scopes = f"""scopes AS (
  SELECT 'cohort' AS scope, r.total_time_min AS minutes FROM results r JOIN (SELECT * FROM results WHERE result_id = 7) p ON {same5}
  UNION ALL SELECT 'time_window', total_time_min FROM results WHERE result_id IN (SELECT result_id FROM near)
  UNION ALL SELECT 'split_cohort', r.split_time_min FROM splits r JOIN (SELECT * FROM results WHERE result_id = 7) p ON {same5}
    WHERE lower(split_name) = 'run1' AND split_time_min >= 1.0
  UNION ALL SELECT 'split_time_window', split_time_min FROM splits WHERE result_id IN (SELECT result_id FROM near)
    AND lower(split_name) = 'run1' AND split_time_min >= 1.0)"""
    report = with_(RESULTS, TIMES, WIDE, SPLIT_ROWS, near, scopes)
    q["report_stats"] = f"{report}SELECT scope, {SEVEN.format(v='minutes')} FROM scopes GROUP BY scope"
    q["report_bins"] = report[:-1] + histogram_sql("scopes", ["scope"], "minutes", 22)
    q["report_markers"] = f"""{report[:-1]},
marks AS (SELECT scope, CASE WHEN scope LIKE 'split%'
    THEN (SELECT max(split_time_min) FROM splits WHERE result_id = 7 AND split_name = 'run1' AND split_time_min >= 1.0)
    ELSE (SELECT total_time_min FROM results WHERE result_id = 7) END AS marker FROM (VALUES ('cohort'), ('time_window'), ('split_cohort'), ('split_time_window')) t(scope))
SELECT m.scope, round(m.marker,6) AS marker, round(CASE WHEN m.marker IS NULL THEN NULL WHEN count(s.minutes) = 1 THEN 1.0
  WHEN count(s.minutes) > 1 THEN 1 - count(*) FILTER (WHERE s.minutes < m.marker) / (count(s.minutes) - 1) END, 6) AS marker_percentile
FROM marks m LEFT JOIN scopes s USING (scope) GROUP BY m.scope, m.marker"""
    q["report_time_window"] = (
        f"{with_(RESULTS, TIMES, WIDE, near, ranks)}SELECT result_id, round(total_time_min,6) AS total_time_min, event_rank, "
        "event_size, event_percentile FROM ranks WHERE result_id IN (SELECT result_id FROM near)"
    )
    q["report_cohort_splits"] = (
        f"{with_(RESULTS, TIMES, WIDE, SPLIT_ROWS, split_ranks)}SELECT r.result_id, r.split_name, round(r.split_time_min,6) AS split_time_min, "
        f"r.split_rank FROM sp r JOIN (SELECT * FROM results WHERE result_id = 7) p ON {same5}"
    )
    near_splits = "SELECT result_id, split_name, round(split_time_min,6) AS split_time_min FROM splits WHERE result_id IN (SELECT result_id FROM near)"
    q["report_window_splits"] = with_(RESULTS, TIMES, WIDE, SPLIT_ROWS, near) + near_splits
    q["report_preview"] = with_(RESULTS, TIMES, WIDE, SPLIT_ROWS, near) + (
        near_splits.replace(" FROM splits", ", count(*) OVER () AS total FROM splits") + " ORDER BY splits.split_name, splits.split_time_min, splits.result_id LIMIT 50"
    )
    q["work_run_split"] = f"""{FULL}SELECT result_id, round(m,6) AS run_time_with_roxzone_min, round(w + m,6) AS work_run_total_min,
  round(CASE WHEN w + m > 0 THEN w / (w + m) END,6) AS work_pct, round(CASE WHEN w + m > 0 THEN m / (w + m) END,6) AS run_pct
FROM (SELECT result_id, work_time_min AS w, coalesce(run_time_min + roxzone_time_min, run_time_min, roxzone_time_min) AS m FROM wide)"""
    pacing = [f"run{n}_time_min" for n in range(2, 8)]
    q["run_change"] = f"""{FULL[:-1]},
runs AS ({' UNION ALL '.join(f"SELECT result_id, {i} AS k, {c} AS t FROM wide" for i, c in enumerate(pacing, 2))}),
med AS (SELECT result_id, median(t) AS m FROM runs GROUP BY result_id)
SELECT result_id, round(m,6) AS median_run_time_min, count(t) AS count, round(min(t - m),6) AS min_delta_min,
  round(max(t - m),6) AS max_delta_min FROM runs JOIN med USING (result_id) GROUP BY result_id, m"""
    q["run_change_points"] = f"""{FULL[:-1]},
runs AS ({' UNION ALL '.join(f"SELECT result_id, 'Run {i}' AS run, {c} AS t FROM wide" for i, c in enumerate(pacing, 2))}),
med AS (SELECT result_id, median(t) AS m FROM runs GROUP BY result_id)
SELECT result_id, run, round(t,6) AS run_time_min, round(t - m,6) AS delta_min FROM runs JOIN med USING (result_id)"""
    q["split_time_map"] = (
        f"{SPLIT}SELECT result_id, count(*) AS n, array_to_string(list(lower(split_name) || '=' || CAST(CAST(split_time_min AS DECIMAL(18,3)) AS VARCHAR) "
        "ORDER BY lower(split_name)), '|') AS split_times FROM splits GROUP BY result_id"
    )
    q["percentile_series"] = f"""{with_(RESULTS, TIMES, WIDE, SPLIT_ROWS, split_ranks, SEGMENT_NAMES)}
SELECT result_id, label, segment_group, CAST(position AS BIGINT) AS position,
  round(least(100.0, greatest(0.0, (1 - pr) * 100)), 6) AS cohort,
  round(CASE WHEN result_id % 3 <> 0 THEN least(100.0, greatest(0.0, ((1 - pr) * 1.5 - 0.2) * 100)) END, 6) AS "window"
FROM (SELECT *, percent_rank() OVER (PARTITION BY {', '.join(K5)}, split_name ORDER BY split_time_min) AS pr FROM splits) s
JOIN names n ON n.segment = s.split_name || '_time_min'"""
    q["cohort_distribution"] = (
        with_(RESULTS, TIMES, WIDE, f"picked AS (SELECT 'sledPush_time_min' AS segment, r.sledPush_time_min AS minutes FROM wide r JOIN (SELECT * FROM wide WHERE result_id = 7) p ON {' AND '.join(f'r.{k} IS NOT DISTINCT FROM p.{k}' for k in K5[1:])})")[:-1]
        + histogram_sql("picked", ["segment"], "minutes", 30)
    )
    q["cohort_distribution_window"] = (
        with_(RESULTS, TIMES, WIDE, near, "picked AS (SELECT 'run2_time_min' AS segment, run2_time_min AS minutes FROM wide WHERE result_id IN (SELECT result_id FROM near))")[:-1]
        + histogram_sql("picked", ["segment"], "minutes", 30)
    )

    # Deep dive
    def places_sql(source, keys):
        ks = ", ".join(keys)
        return f"""SELECT {ks}, count(*) AS count, round(min(minutes),6) AS fastest, round(avg(minutes),6) AS mean,
  round(quantile_cont(minutes,0.05),6) AS p05, round(quantile_cont(minutes,0.5),6) AS p50, round(quantile_cont(minutes,0.9),6) AS p90,
  round(max(minutes) FILTER (WHERE k <= 3),6) AS podium,
  array_to_string(list(DISTINCT season ORDER BY season), '|') AS seasons, array_to_string(list(DISTINCT year ORDER BY year), '|') AS years
FROM (SELECT *, row_number() OVER (PARTITION BY {ks} ORDER BY minutes, result_id) AS k FROM {source}) GROUP BY {ks}"""

    timed = "timed AS (SELECT *, total_time_min AS minutes FROM results)"
    q["location_stats"] = with_(RESULTS, timed) + places_sql("timed", ["division", "location"])
    dive = """dive AS (SELECT r.result_id, r.location, r.season, r.year, r.total_time_min AS minutes FROM wide r
  JOIN (SELECT * FROM wide WHERE result_id = 7) p ON lower(r.division) = lower(p.division) AND lower(r.gender) = lower(p.gender)
  WHERE r.season = 1997 AND lower(r.age_group) = 'building')"""
    tags = """cut AS (SELECT quantile_cont(minutes,0.05) AS p05, quantile_cont(minutes,0.9) AS p90 FROM dive),
tagged AS (SELECT *, 'all' AS grp FROM dive UNION ALL SELECT dive.*, 'top' FROM dive, cut WHERE minutes <= p05
  UNION ALL SELECT dive.*, 'bottom' FROM dive, cut WHERE minutes >= p90
  UNION ALL SELECT * FROM (SELECT *, 'podium' AS grp FROM dive ORDER BY minutes, result_id LIMIT 3))"""
    dives = with_(RESULTS, TIMES, WIDE, dive, tags)
    q["deepdive_locations"] = with_(RESULTS, TIMES, WIDE, dive) + places_sql("dive", ["location"])
    q["deepdive_summary"] = (
        with_(RESULTS, TIMES, WIDE, dive)
        + f"SELECT {FIVE.format(v='minutes')}, round(quantile_cont(minutes,0.05),6) AS p05, round(quantile_cont(minutes,0.9),6) AS p90 FROM dive"
    )
    q["deepdive_groups"] = f"{dives}SELECT grp, {FIVE.format(v='minutes')} FROM tagged GROUP BY grp"
    q["deepdive_bins"] = dives[:-1] + histogram_sql("tagged", ["grp"], "minutes", 22, label="location")
    q["deepdive_markers"] = f"""{dives[:-1]},
mine AS (SELECT total_time_min AS x FROM wide WHERE result_id = 7),
marks AS (SELECT grp, CASE WHEN grp = 'all' THEN x
   WHEN grp = 'podium' THEN CASE WHEN bool_or(abs(minutes - x) <= 1e-8 + 1e-5 * abs(x)) THEN x END
   WHEN min(minutes) <= x AND x <= max(minutes) THEN x END AS marker, count(*) AS n, count(*) FILTER (WHERE minutes < x) AS below
  FROM tagged, mine GROUP BY grp, x)
SELECT grp, round(marker,6) AS marker, round(CASE WHEN marker IS NULL THEN NULL WHEN n = 1 THEN 1.0 ELSE 1 - below / (n - 1) END,6)
  AS marker_percentile FROM marks"""
    low = """mine AS (SELECT * FROM wide WHERE run1_time_min IS NOT NULL ORDER BY run1_time_min, result_id LIMIT 1),
dive AS (SELECT r.result_id, r.location, r.season, r.year, r.run1_time_min AS minutes FROM wide r JOIN mine p
  ON lower(r.division) = lower(p.division) AND lower(r.gender) = lower(p.gender) AND r.season = p.season
  WHERE lower(r.age_group) = 'building' AND r.run1_time_min >= 1.0)"""
    q["deepdive_markers_floor"] = f"""{with_(RESULTS, TIMES, WIDE, low, tags)[:-1]},
marks AS (SELECT grp, CASE WHEN x < 1.0 THEN NULL WHEN grp = 'all' THEN x
   WHEN grp = 'podium' THEN CASE WHEN bool_or(abs(minutes - x) <= 1e-8 + 1e-5 * abs(x)) THEN x END
   WHEN min(minutes) <= x AND x <= max(minutes) THEN x END AS marker, count(*) AS n, count(*) FILTER (WHERE minutes < x) AS below
  FROM tagged, (SELECT run1_time_min AS x FROM mine) GROUP BY grp, x)
SELECT grp, round(marker,6) AS marker, round(CASE WHEN marker IS NULL THEN NULL WHEN n = 1 THEN 1.0 ELSE 1 - below / (n - 1) END,6)
  AS marker_percentile FROM marks"""
    q["deepdive_deltas"] = f"""{with_(RESULTS, TIMES, WIDE, dive)}, mine AS (SELECT total_time_min AS x FROM wide WHERE result_id = 7)
SELECT location, round(avg(minutes),6) AS stat_value, round(max(x) - avg(minutes),6) AS delta, round(max(x) - min(minutes),6) AS delta_fastest
FROM dive, mine GROUP BY location""".replace(")\n, mine", "),\nmine")
    q["tagged_groups"] = f"""{with_(RESULTS, timed)}, cut AS (
  SELECT season, quantile_cont(minutes,0.05) AS p05, quantile_cont(minutes,0.9) AS p90 FROM timed GROUP BY season),
tagged AS (SELECT season, minutes, 'all' AS grp FROM timed
  UNION ALL SELECT season, minutes, 'top' FROM timed JOIN cut USING (season) WHERE minutes <= p05
  UNION ALL SELECT season, minutes, 'bottom' FROM timed JOIN cut USING (season) WHERE minutes >= p90
  UNION ALL SELECT season, minutes, 'podium' FROM (SELECT *, row_number() OVER (PARTITION BY season ORDER BY minutes, result_id) AS k FROM timed) WHERE k <= 3)
SELECT season, grp, {FIVE.format(v='minutes')} FROM tagged GROUP BY season, grp""".replace(")\n, cut", "),\ncut")

    # Profiles
    metric_columns = {"overall": "total_time_min", **{s.lower(): f"{s}_time_min" for s in STATION}}
    metrics = "metrics AS (\n  " + "\n  UNION ALL ".join(
        f"SELECT athlete_id, division, gender, result_id, location, year, '{m}' AS metric, {c} AS minutes FROM wide WHERE {c} > 0"
        for m, c in metric_columns.items()
    ) + """
  UNION ALL SELECT athlete_id, division, gender, result_id, location, year, 'runplusroxzone', run_time_min + roxzone_time_min
    FROM wide WHERE run_time_min > 0 AND roxzone_time_min > 0),
scored AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN n = 1 THEN 1.0 ELSE 1 - (r - 1) / (n - 1) END)) AS percentile FROM (
  SELECT *, rank() OVER (PARTITION BY division, gender, metric ORDER BY minutes) AS r,
    count(*) OVER (PARTITION BY division, gender, metric) AS n FROM metrics))"""
    career = with_(RESULTS, TIMES, WIDE, metrics)
    q["profile_percentiles"] = f"{career}SELECT result_id, metric, round(minutes,6) AS minutes, round(percentile,6) AS percentile FROM scored"
    bests = """SELECT athlete_id, metric, round(minutes,6) AS time, result_id, location, year, round(percentile,6) AS percentile FROM (
  SELECT *, row_number() OVER (PARTITION BY athlete_id, metric ORDER BY minutes, year DESC NULLS LAST, location NULLS LAST, result_id) AS k
  FROM scored{where}) WHERE k = 1"""
    q["profile_bests"] = career + bests.format(where="")
    q["profile_bests_division"] = career + bests.format(where=" WHERE lower(division) = '2-high'")
    q["profile_one"] = career + bests.format(where=" WHERE athlete_id = 11")
    q["profile_averages"] = (
        f"{career}SELECT athlete_id, metric, round(avg(minutes),6) AS time, round(avg(percentile),6) AS percentile FROM scored GROUP BY athlete_id, metric"
    )
    q["profile_seasons"] = (
        f"{BASE}SELECT athlete_id, CAST(year AS VARCHAR) AS season, round(min(total_time_min),6) AS best_time, count(*) AS race_count "
        "FROM results GROUP BY athlete_id, year"
    )
    q["profile_summary"] = (
        f"{with_(RESULTS, ranks)}SELECT athlete_id, count(*) AS total_races, round(min(total_time_min),6) AS best_overall_time, "
        "min(event_rank) AS best_age_group_finish, CAST(min(year) AS VARCHAR) AS first_season FROM ranks GROUP BY athlete_id"
    )
    q["profile_divisions"] = f"{BASE}SELECT DISTINCT athlete_id, trim(division) AS division FROM results"
    newest = "row_number() OVER (PARTITION BY athlete_id ORDER BY year DESC NULLS LAST, location NULLS LAST, result_id) AS k"
    q["profile_headers"] = f"""{BASE}SELECT athlete_id, name, gender, CASE WHEN nd <= 1 THEN division END AS division, age_group, nationality FROM (
  SELECT r.*, {newest}, d.nd FROM results r JOIN (SELECT athlete_id, count(DISTINCT division) AS nd FROM results GROUP BY athlete_id) d USING (athlete_id))
WHERE k = 1"""
    q["profile_races"] = f"""{with_(RESULTS, TIMES, "wide AS (SELECT * FROM ranks LEFT JOIN times USING (result_id))").replace('wide AS', ranks + ', wide AS')}
SELECT athlete_id, result_id, location, year, event_rank AS age_group_rank, start_date, round(total_time_min,6) AS total_time_min,
  round(run_time_min + roxzone_time_min,6) AS runplusroxzone_time_min FROM wide"""
    q["progression"] = f"""{BASE}SELECT athlete_id, result_id, round(total_time_min,6) AS minutes,
  row_number() OVER (PARTITION BY athlete_id ORDER BY start_date, year, location, result_id) AS step FROM results"""
    q["age_group_ranks"] = f"{with_(RESULTS, ranks)}SELECT result_id, event_rank AS age_group_rank FROM ranks"
    q["newest_per_athlete"] = f"""{BASE}SELECT athlete_id, result_id, year FROM (
  SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY year DESC, result_id) AS k FROM results) WHERE k = 1"""
    q["races_by_name"] = f"{BASE}SELECT result_id, season, event_name FROM results WHERE lower(name) = 'customer#000000011'"
    q["athletes_named"] = f"{BASE}SELECT DISTINCT CAST(athlete_id AS VARCHAR) AS athlete_id FROM results WHERE lower(name) = 'customer#000000011'"

    # Search
    q["search_exact"] = f"{BASE}SELECT result_id, athlete_id, name AS athlete_name FROM results WHERE name = 'Customer#000000011'"
    q["search_contains"] = f"{BASE}SELECT result_id, athlete_id, name AS athlete_name FROM results WHERE name LIKE '%#000000013'"
    q["search_capped"] = f"""{BASE}SELECT result_id, total FROM (SELECT result_id, count(*) OVER () AS total
  FROM results WHERE name LIKE '%#000000013') ORDER BY result_id LIMIT 4"""
    q["shown_names"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN 'Clerk ' || o_custkey ELSE c_name END AS name
FROM orders JOIN customer ON o_custkey = c_custkey"""
    asked = """asked AS (SELECT s_suppkey AS query_id, replace(s_name, 'Supplier#', '') AS digits FROM supplier),
people AS (SELECT DISTINCT athlete_id, name FROM results)"""
    q["resolve_names"] = f"""{with_(RESULTS, asked)}
SELECT query_id, athlete_id, CASE WHEN query_id % 2 = 0 THEN 'exact' ELSE 'contains' END AS matched
FROM asked JOIN people ON name = 'Customer#' || digits"""
    words = "list_sort(string_split(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' '))"
    q["name_signatures"] = (
        f"SELECT p_partkey, array_to_string({words.format(c='p_name')}, ' ') AS signature, "
        "regexp_replace(lower(trim(p_brand)), '[^a-z0-9]', '', 'g') AS brand_key FROM part"
    )
    q["partners"] = """SELECT c_custkey, CAST(CASE WHEN c_custkey % 4 IN (0, 1, 3) THEN 2 ELSE 1 END AS BIGINT) AS people,
  CASE c_custkey % 4 WHEN 0 THEN c_name || '|' || c_mktsegment WHEN 1 THEN c_name || '|' || c_mktsegment
    WHEN 2 THEN c_name || ', ' || c_mktsegment ELSE c_name || ' a|' || c_mktsegment || ' b' END AS parts FROM customer"""

    # Comparison
    pairs = """pairs AS (SELECT athlete_id AS pair_id, min(result_id) AS base_id, max(result_id) AS other_id FROM results GROUP BY athlete_id)"""

    lines = """lines AS (SELECT result_id, 'total_time' AS key, 'Total time' AS label, total_time_min AS m FROM wide
  UNION ALL SELECT result_id, 'run_roxzone', 'Run + Roxzone', run_time_min + roxzone_time_min FROM wide
  UNION ALL SELECT result_id, 'split-' || lower(split_name), split_name, split_time_min FROM splits)"""
    ends = "ends AS (SELECT pair_id, base_id AS result_id, TRUE AS base FROM pairs UNION ALL SELECT pair_id, other_id, FALSE FROM pairs)"
    wide_once = WIDE.replace("AS (", "AS MATERIALIZED (", 1)
    q["compare_results"] = f"""{with_(RESULTS, TIMES, wide_once, SPLIT_ROWS, pairs, ends, lines)}
SELECT pair_id, key, coalesce(max(label) FILTER (WHERE base), max(label)) AS label, round(max(m) FILTER (WHERE base),6) AS primary_value,
  round(max(m) FILTER (WHERE NOT base),6) AS compare_value, round(max(m) FILTER (WHERE base) - max(m) FILTER (WHERE NOT base),6) AS delta
FROM lines JOIN ends USING (result_id) GROUP BY pair_id, key"""

    def segment_value(c):
        name = c.removesuffix("_time_min")
        column = "CASE WHEN result_id % 3 <> 0 THEN skiErg_time_min END" if name == "skiErg" else c
        split = "run3_time_min + 1.0" if name == "run3" else c
        if name in ("run2", "skiErg"):
            split = f"CASE WHEN result_id % 2 <> 0 THEN {c} END"
        return f"SELECT result_id, '{c}' AS segment, round(coalesce({split}, {column}, 0.0),6) AS minutes FROM wide"

    q["segment_values"] = f"{FULL}" + " UNION ALL ".join(map(segment_value, SPLITS))

    # Derived tables
    md5 = "md5(concat_ws('|', lower(trim(name)), gender, nationality))"
    q["athletes"] = f"{BASE}SELECT DISTINCT {md5} AS athlete_id, lower(trim(name)) AS canonical_name, gender, nationality FROM results"
    q["athlete_results"] = f"{BASE}SELECT {md5} AS athlete_id, result_id, 1.0::DOUBLE AS link_confidence, 'exact_key' AS link_method FROM results"
    q["athlete_index"] = f"""{FULL}SELECT {md5} AS athlete_id, lower(trim(name)) AS canonical_name, lower(trim(name)) AS name_lc, gender, nationality,
  count(*) AS race_count, round(avg(total_time_min),6) AS avg_total_time, round(avg(run_time_min / nullif(total_time_min, 0)),6) AS avg_run_ratio
FROM wide GROUP BY ALL"""
    q["contract_check"] = f"""{BASE}SELECT rule, violations FROM (
  SELECT 'result_id not null' AS rule, count(*) FILTER (WHERE result_id IS NULL) AS violations FROM results
  UNION ALL SELECT 'age_group not null', count(*) FILTER (WHERE age_group IS NULL) FROM results
  UNION ALL SELECT 'bib not null', count(*) FROM results
  UNION ALL SELECT 'athlete_id, season unique', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM results GROUP BY athlete_id, season))"""
    q["roster_gate"] = f"""{BASE}SELECT season, location, year, division, count(*) AS rows, count(DISTINCT name) AS names,
  round(count(*) / count(DISTINCT name),6) AS rows_per_name FROM results GROUP BY season, location, year, division
HAVING count(*) / count(DISTINCT name) > 1.1"""
    q["manifest_races"] = f"{BASE}SELECT season, location, max(start_date) AS file_last_modified FROM results GROUP BY season, location"
    q["manifest_first_entries"] = f"""{BASE}SELECT season, location, 'season=' || season || '/' || location || '-' || min(start_date[1:7]) AS path
FROM results GROUP BY season, location"""

    # Texts
    texts = """texts AS (SELECT event_id, event_type, user_id, value, ts, CASE event_type WHEN 'click' THEN strftime(ts, '%-H:%M:%S')
  WHEN 'view' THEN strftime(ts, '%M:%S') WHEN 'signup' THEN ' ' || strftime(ts, '%-H:') || minute(ts) || ':' || second(ts) || ' '
  WHEN 'error' THEN ':' || strftime(ts, '%S') ELSE CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) END AS raw FROM events)"""
    clock = "CASE event_type WHEN 'click' THEN hour(ts) * 60 + minute(ts) + second(ts) / 60.0::DOUBLE WHEN 'view' THEN minute(ts) + second(ts) / 60.0::DOUBLE WHEN 'signup' THEN hour(ts) * 60 + minute(ts) + second(ts) / 60.0::DOUBLE"
    q["clock_minutes"] = f"{with_(texts)}SELECT event_id, raw, round({clock} END,6) AS minutes FROM texts"
    q["loose_minutes"] = (
        f"{with_(texts)}SELECT event_id, round({clock} WHEN 'purchase' THEN CAST(raw AS DOUBLE) END,6) AS minutes FROM texts"
    )
    q["duration_quality"] = f"""{with_(texts)}SELECT 'raw' AS "column", count(*) FILTER (WHERE event_type IN ('click','view','signup')) AS parsed,
  count(*) FILTER (WHERE event_type NOT IN ('click','view','signup')) AS rejected,
  count(*) FILTER (WHERE regexp_matches(trim(raw), '^[0-9]+:[0-9]{{2}}:[0-9]{{2}}$')) AS form_hms,
  count(*) FILTER (WHERE regexp_matches(trim(raw), '^[0-9]+:[0-9]{{2}}$')) AS form_ms,
  count(*) FILTER (WHERE NOT regexp_matches(trim(raw), '^[0-9]+:[0-9]{{2}}(:[0-9]{{2}})?$')) AS form_other FROM texts"""

    def fmt(total):
        t = f"CAST({total} AS BIGINT)"
        return (
            f"CASE WHEN {t} >= 3600 THEN ({t} // 3600) || ':' || lpad(CAST(({t} % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({t} % 60 AS VARCHAR), 2, '0') "
            f"ELSE ({t} // 60) || ':' || lpad(CAST({t} % 60 AS VARCHAR), 2, '0') END"
        )

    delta = fmt("floor(abs(value - 20) * 60 + 0.5)")
    q["display_labels"] = f"""SELECT event_id, {fmt('floor(value * 60 + 0.5)')} AS clock,
  (CASE WHEN value > 20 THEN '+' WHEN value < 20 THEN '-' ELSE '' END) || {delta} AS delta, strftime(ts, '%b ''%y') AS month,
  CASE WHEN value / 100 >= 0.9 THEN 'excellent' WHEN value / 100 >= 0.75 THEN 'good' WHEN value / 100 >= 0.25 THEN 'average' ELSE 'below' END AS band,
  'Top ' || greatest(1, CAST(floor((1 - value / 100) * 100 + 0.5) AS BIGINT)) || '%' AS top,
  round(least(100.0, greatest(0.0, value / 100 * 100)),6) AS fill FROM events"""

    # Filters
    q["open_interval"] = f"{BASE}SELECT result_id FROM results WHERE total_time_min > 100000 AND total_time_min < 120000"
    q["closed_bounds"] = f"{BASE}SELECT result_id FROM results WHERE total_time_min BETWEEN 100000 AND 120000"
    q["cohort_filter"] = (
        f"{BASE}SELECT result_id FROM results WHERE season = 1997 AND year = 1997 AND lower(location) = 'europe' "
        "AND lower(division) = '3-medium' AND lower(gender) IN ('f','female') AND lower(age_group) = 'furniture'"
    )
    q["null_safe_filter"] = f"{BASE}SELECT result_id FROM results WHERE age_group IS NULL AND location = 'ASIA'"
    q["value_list"] = f"{BASE}SELECT result_id FROM results WHERE event_name IN ('1996 ASIA', '1997 EUROPE')"
    q["name_contains"] = f"{BASE}SELECT result_id FROM results WHERE contains(lower(name), 'r#0000001')"
    q["believable_runs"] = f"{FULL}SELECT result_id, round(run1_time_min,6) AS run1_time_min FROM wide WHERE run1_time_min >= 1.0"
    q["filter_overrides"] = f"""{BASE}SELECT p.result_id, count(*) AS cohort_size FROM results r JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY season, location ORDER BY total_time_min, result_id) AS k FROM results) WHERE k = 1) p
ON r.season = p.season AND lower(r.division) = '2-high' AND (p.gender IS NULL OR lower(r.gender) = lower(p.gender))
  AND (p.age_group IS NULL OR lower(r.age_group) = lower(p.age_group)) GROUP BY p.result_id"""
    q["typed_numbers"] = (
        "SELECT event_id, CASE WHEN try_cast(raw AS DOUBLE) > 0 THEN try_cast(raw AS DOUBLE) END AS number FROM (SELECT event_id, "
        "CASE WHEN event_type = 'click' THEN 'n/a' WHEN event_type = 'view' THEN '-' || CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) "
        "ELSE CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR) END AS raw FROM events)"
    )
    q["sql_query"] = "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag"
    q["records_export"] = (
        "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS record FROM nation"
    )
    q["stack_races"] = f"{FULL}SELECT result_id, season, CASE WHEN season % 2 = 1 THEN round(run1_time_min,6) END AS run1_time_min FROM wide"
    wanted = """races AS (SELECT DISTINCT season, location, year FROM results),
wanted AS (SELECT *, 'found' AS status FROM races UNION SELECT season, substr(location, 2), year, 'no such location' FROM races
  UNION SELECT season + 100, location, year, 'no such season' FROM races UNION SELECT season, location, year + 100, 'no such year' FROM races)"""
    q["missing_races"] = with_(RESULTS, wanted) + "SELECT season, location, year, status FROM wanted"
    q["race_suggestions"] = with_(RESULTS, wanted) + "SELECT season, substr(location, 2) AS location, year, lower(location) AS suggestion FROM races"
    q["race_menus"] = f"{BASE}SELECT season, location, array_to_string(list(DISTINCT year ORDER BY year), '|') AS years FROM results GROUP BY season, location"
    q["find_race"] = f"""{BASE}SELECT season, location, 's3://bucket/files/season=' || season || '/location=' || location AS path, max(year) AS year,
  max(start_date) AS file_last_modified FROM results WHERE season = 1996 AND location = 'ASIA' GROUP BY season, location"""

    def clocked(column, scale):
        return f"round(floor({column} * {scale}) / 60,6)"

    files = f"""files AS (SELECT season, location, name, gender, division, {clocked('total_time_min', '0.04::DOUBLE')} AS total_time,
  {clocked('run_time_min', 10)} AS run_time, {clocked('run1_time_min', 60)} AS run1_time, {clocked('run2_time_min', 60)} AS run2_time,
  {clocked('skiErg_time_min', 60)} AS skiErg_time FROM wide)"""
    raced = with_(RESULTS, TIMES, WIDE, files) + "SELECT name, gender, division, total_time, run_time, run1_time, run2_time, skiErg_time FROM files WHERE "
    q["get_race"] = raced + "season = 1996 AND location = 'ASIA' AND gender = 'F' AND total_time > 50 AND total_time < 200"
    q["get_season"] = raced + "season = 1997 AND division = '2-HIGH'"
    q["get_season_layout"] = q["get_season_places"] = raced + "season = 1997 AND location IN ('EUROPE', 'AFRICA')"
    q["readable_columns"] = (
        "SELECT l_orderkey, "
        + ", ".join(f"CAST(count(*) FILTER (WHERE l_linenumber = {n}) AS DOUBLE) AS {RAW_RENAMES[f'run_{n}']}" for n in LINES)
        + " FROM lineitem GROUP BY l_orderkey"
    )

    # Studies
    q["fastest_part"] = (
        f"{BASE}SELECT result_id FROM results WHERE total_time_min <= (SELECT quantile_cont(total_time_min, 0.25) FROM results)"
    )
    trimmed = ["run1_time_min", "run2_time_min", "skiErg_time_min", "run_time_min", "total_time_min"]
    steps = ["c0 AS (SELECT * FROM wide WHERE " + " AND ".join(f"{c} > 0 AND {c} <= total_time_min" for c in trimmed) + ")"]
    for i, c in enumerate(trimmed):
        steps.append(
            f"c{i + 1} AS (SELECT * FROM c{i} WHERE {c} BETWEEN (SELECT quantile_cont({c}, 0.01) FROM c{i}) AND (SELECT quantile_cont({c}, 0.97) FROM c{i}))"
        )
    q["clean_times"] = with_(RESULTS, TIMES, WIDE, *steps) + f"SELECT result_id FROM c{len(trimmed)}"
    trimmed = [*SPLITS, "run_time_min", "total_time_min"]
    once = WIDE.replace("AS (", "AS MATERIALIZED (", 1)
    steps = ["c0 AS MATERIALIZED (SELECT * FROM wide WHERE " + " AND ".join(f"{c} > 0 AND {c} <= total_time_min" for c in trimmed) + ")"]
    for i, c in enumerate(trimmed):
        steps.append(
            f"c{i + 1} AS MATERIALIZED (SELECT * FROM c{i} WHERE {c} BETWEEN (SELECT quantile_cont({c}, 0.001) FROM c{i}) AND (SELECT quantile_cont({c}, 0.995) FROM c{i}))"
        )
    q["clean_times_all"] = with_(RESULTS, TIMES, once, *steps) + f"SELECT result_id FROM c{len(trimmed)}"
    q["faster_than_mean"] = f"{FULL}SELECT result_id FROM wide WHERE run_time_min < (SELECT avg(run_time_min) FROM wide)"
    q["to_minutes"] = f"{FULL}SELECT result_id, round(total_time_min / 60,6) AS total_time_min, round(run_time_min,6) AS run_time_min FROM wide"
    q["remainders"] = f"""{FULL}SELECT result_id, round(work_time_min - (sledPush_time_min + burpeeBroadJump_time_min),6) AS remaining_work,
  round(total_time_min - (sledPush_time_min + burpeeBroadJump_time_min + run_time_min),6) AS remaining_time FROM wide"""
    zs = ["skiErg_time_min", "run1_time_min"]
    q["z_scores"] = f"{FULL}SELECT result_id, " + ", ".join(
        f"round(({c} - avg({c}) OVER w) / nullif(stddev_pop({c}) OVER w, 0),6) AS {c}_z" for c in zs
    ) + " FROM wide WINDOW w AS (PARTITION BY season, location)"
    total = " + ".join(f"coalesce({c}, 0)" for c in PLACES)
    q["station_shares"] = f"{FULL}SELECT result_id, " + ", ".join(f"round({c} / nullif({total}, 0),6) AS {c}_share" for c in PLACES) + " FROM wide"
    q["average_rank_percentile"] = f"""{BASE}SELECT result_id, round((rank() OVER (PARTITION BY location ORDER BY p) + (count(*) OVER (PARTITION BY location, p) - 1) / 2)
  / count(*) OVER (PARTITION BY location),6) AS percentile FROM (SELECT result_id, location, floor(total_time_min / 1000) AS p FROM results)"""
    q["pace_buckets"] = """SELECT CASE WHEN v > 0 AND v <= 55 THEN '<55' WHEN v > 55 AND v <= 60 THEN '55-60' WHEN v > 60 AND v <= 65 THEN '60-65'
  WHEN v > 65 AND v <= 70 THEN '65-70' WHEN v > 70 AND v <= 999 THEN '70+' END AS pace_bucket, count(v) AS count, round(avg(v),6) AS mean
FROM (SELECT value AS v FROM events) WHERE v > 0 AND v <= 999 GROUP BY 1"""
    studied = ["total_time_min", "work_time_min", "run_time_min", "roxzone_time_min"]
    kept = "kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY event_name, gender) AS n FROM wide) WHERE n >= 20)"
    cells = "cells AS (" + " UNION ALL ".join(f"SELECT event_name, gender, '{c}' AS metric, {c} AS minutes FROM kept WHERE {c} > 0" for c in studied) + ")"
    stats = f"""stats AS (SELECT event_name, gender, metric, count(*) AS count, avg(minutes) AS mean, stddev_pop(minutes) AS sd, median(minutes) AS median,
  quantile_cont(minutes,0.75) - quantile_cont(minutes,0.25) AS iqr FROM cells GROUP BY ALL)"""
    q["group_statistics"] = with_(RESULTS, TIMES, WIDE, kept, cells, stats) + (
        "SELECT event_name, gender, metric, count, round(mean,6) AS mean, round(sd,6) AS sd, round(median,6) AS median, round(iqr,6) AS iqr FROM stats"
    )
    used = "used AS (SELECT * FROM wide WHERE event_name IS NOT NULL AND gender IS NOT NULL AND total_time_min IS NOT NULL AND work_time_min IS NOT NULL)"
    q["large_groups"] = with_(RESULTS, TIMES, WIDE, used) + (
        "SELECT event_name, gender, count(*) AS n_used FROM used GROUP BY ALL HAVING count(*) >= 20"
    )
    q["events_by_mean"] = with_(RESULTS, TIMES, WIDE, kept, cells, stats) + (
        "SELECT event_name, round(avg(mean),6) AS mean FROM stats WHERE metric = 'run_time_min' GROUP BY event_name"
    )
    gated = "gated AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY event_name, gender) AS n FROM used) WHERE n >= 20)"
    all_two = "all_two AS (" + " UNION ALL ".join(
        f"SELECT event_name, gender, '{c}' AS metric, {c} AS minutes FROM gated" for c in studied[:2]
    ) + ")"
    two = """two AS (SELECT * EXCLUDE (k) FROM (SELECT *, count(*) OVER (PARTITION BY event_name, gender, metric) AS k
  FROM all_two WHERE minutes > 0) WHERE k >= 20)"""
    q["shared_histograms"] = with_(RESULTS, TIMES, WIDE, used, gated, all_two, two)[:-1] + histogram_sql(
        "two", ["event_name", "gender", "metric"], "minutes", 20, shared=["event_name", "metric"], edges="all_two"
    )
    q["column_means"] = FULL + " UNION ALL ".join(
        f"SELECT '{c}' AS metric, round(avg({c}),6) AS mean, round(median({c}),6) AS median FROM wide" for c in studied
    )
    four = "four AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS metric, {c} AS minutes FROM wide WHERE {c} IS NOT NULL" for c in studied
    ) + ")"
    q["column_histograms"] = with_(RESULTS, TIMES, WIDE, four)[:-1] + histogram_sql("four", ["metric"], "minutes", 30)
    same = "AND ".join(f"r.{k} IS NOT DISTINCT FROM p.{k} " for k in K5)
    asked = "asked AS (SELECT * FROM wide)"
    q["report_requests_stats"] = with_(RESULTS, TIMES, WIDE, asked) + (
        f"SELECT p.result_id, {SEVEN.format(v='r.total_time_min')} FROM asked p JOIN wide r ON {same} GROUP BY p.result_id"
    )
    q["report_requests_bins"] = with_(
        RESULTS, TIMES, WIDE, asked, f"picked AS (SELECT r.* FROM wide r WHERE EXISTS (SELECT 1 FROM asked p WHERE {same}))"
    )[:-1] + histogram_sql("picked", K5, "total_time_min", 22)

    def place(n, below):
        return f"round(CASE WHEN {n} = 1 THEN 1.0 WHEN {n} > 1 THEN 1 - {below} / ({n} - 1) END, 6)"

    q["report_requests_markers"] = f"""{with_(RESULTS, TIMES, WIDE, asked)[:-1]},
c AS (SELECT p.result_id, count(*) AS n, count(*) FILTER (WHERE r.total_time_min < p.total_time_min) AS b FROM asked p JOIN wide r ON {same} GROUP BY ALL),
w AS (SELECT p.result_id, count(*) AS n, count(*) FILTER (WHERE r.total_time_min < p.total_time_min) AS b FROM asked p JOIN wide r
  ON r.season = p.season AND r.location = p.location AND r.total_time_min BETWEEN p.total_time_min - 20000 AND p.total_time_min + 20000 GROUP BY ALL)
SELECT p.result_id, round(p.total_time_min,6) AS marker, {place('c.n', 'c.b')} AS cohort_percentile, w.n AS window_size,
  {place('w.n', 'w.b')} AS window_percentile FROM asked p JOIN c USING (result_id) JOIN w USING (result_id)"""
    near = """near AS (SELECT p.result_id, r.total_time_min AS v FROM asked p JOIN wide r
  ON r.season IS NOT DISTINCT FROM p.season AND r.location IS NOT DISTINCT FROM p.location
  AND r.total_time_min BETWEEN p.total_time_min - 20000 AND p.total_time_min + 20000)"""
    q["report_requests_window_stats"] = with_(RESULTS, TIMES, WIDE, asked, near) + (
        f"SELECT result_id, {SEVEN.format(v='v')} FROM near GROUP BY result_id"
    ).replace(
        # The mean is exact, rounded half up in integers: a decimal sum over the count, as the query's decimal running sums.
        "round(avg(v),6) AS mean",
        "round(CAST((CAST(sum(CAST(v AS DECIMAL(38,9))) * 1000000000 AS HUGEINT) + count(*) * 500) // (count(*) * 1000)"
        " AS DOUBLE) / 1000000,6) AS mean"
    )
    q["report_requests_window_bins"] = f"""{with_(RESULTS, TIMES, WIDE, asked, near)[:-1]},
ends AS (SELECT result_id, min(v) AS lo, (CASE WHEN max(v) > min(v) THEN max(v) - min(v) ELSE 1.0 END) / 22 AS width FROM near GROUP BY result_id),
guess AS (SELECT n.result_id, v, lo, width, CAST(least(greatest(floor((v - lo) / width), 0), 21) AS BIGINT) AS c FROM near n JOIN ends USING (result_id)),
placed AS (SELECT result_id, CASE WHEN lo + width * c > v THEN c - 1 WHEN c < 21 AND lo + width * (c + 1) <= v THEN c + 1 ELSE c END AS bin
  FROM guess),
counts AS (SELECT result_id, bin, count(*) AS n FROM placed GROUP BY ALL),
frame AS (SELECT result_id, lo, width, unnest(range(22)) AS bin FROM ends)
SELECT f.result_id, f.bin, round(lo + width * f.bin, 6) AS start, round(lo + width * (f.bin + 1), 6) AS "end", coalesce(n, 0) AS count
FROM frame f LEFT JOIN counts c USING (result_id, bin)"""
    q["report_requests_window_splits"] = f"""{with_(RESULTS, TIMES, WIDE, SPLIT_ROWS, asked)[:-1]},
own AS (SELECT s.*, p.total_time_min AS t FROM splits s JOIN asked p USING (result_id)),
others AS (SELECT s.*, r.total_time_min AS t FROM splits s JOIN results r USING (result_id)),
c AS (SELECT p.result_id, p.split_name, count(*) AS n, count(*) FILTER (WHERE r.split_time_min < p.split_time_min) AS b FROM own p JOIN others r
  ON r.season = p.season AND r.location = p.location AND r.split_name = p.split_name AND r.t BETWEEN p.t - 20000 AND p.t + 20000 GROUP BY ALL)
SELECT p.result_id, p.split_name, round(p.split_time_min,6) AS split_time_min, {place('c.n', 'c.b')} AS split_percentile_time_window
FROM own p JOIN c USING (result_id, split_name)"""
    q["race_summary_counts"] = f"""{BASE}, race AS (SELECT total_time_min AS t FROM results WHERE season = 1996 AND location = 'ASIA'),
cut AS (SELECT quantile_cont(t, 0.1) AS q FROM race)
SELECT count(*) FILTER (WHERE t <= q) AS count, count(*) AS total_count, round(max(q),6) AS threshold FROM race, cut""".replace(")\n, race", "),\nrace")
    fit = """r AS (SELECT location AS e, sledPush_time_min AS s, burpeeBroadJump_time_min AS x, run_time_min AS y FROM wide
  WHERE sledPush_time_min IS NOT NULL AND burpeeBroadJump_time_min IS NOT NULL AND run_time_min IS NOT NULL),
m AS (SELECT e, count(*) AS n, avg(s) AS ms, avg(x) AS mx, avg(y) AS my, var_pop(s) AS vs, var_pop(x) AS vx, covar_pop(s, x) AS sx,
  covar_pop(s, y) AS sy, covar_pop(x, y) AS xy FROM r GROUP BY e),
k AS (SELECT sum(n * (vx - sx * sx / vs)) AS a, sum(n * (xy - sx * sy / vs)) / sum(n * (vx - sx * sx / vs)) AS c FROM m),
f AS (SELECT m.*, a, c, sy / vs - c * sx / vs AS b, my - (sy / vs - c * sx / vs) * ms - c * mx AS i FROM m, k)"""
    errors = """u AS (SELECT e, (s - ms) / (n * vs) AS d, 1 / n - ms * (s - ms) / (n * vs) AS p, x - mx - (s - ms) * sx / vs AS q, a,
  y - i - b * s - c * x AS off, 1 / n + (s - ms) * (s - ms) / (n * vs) AS h FROM r JOIN f USING (e)),
w AS (SELECT *, power(off / (1 - (h + q * q / a)), 2) AS ww FROM u),
t AS (SELECT e, sum(ww * d * d) AS dd, sum(ww * p * p) AS pp, sum(ww * d * q) AS dq, sum(ww * p * q) AS pq, sum(ww * q * q) AS qq FROM w GROUP BY e),
v AS (SELECT sum(qq) / max(a * a) AS v FROM t, k),
z AS (SELECT f.*, t.* EXCLUDE (e), v, sx / vs AS ls, mx - ms * sx / vs AS li FROM f JOIN t USING (e), v),
g AS (SELECT * FROM z WHERE e = 'ASIA'),
o AS (SELECT 'intercept' AS term, i AS coefficient, sqrt(pp - 2 / a * li * pq + v * li * li) AS err FROM g
  UNION ALL SELECT 'sledPush_time_min', b, sqrt(dd - 2 / a * ls * dq + v * ls * ls) FROM g
  UNION ALL SELECT 'burpeeBroadJump_time_min', c, sqrt(v) FROM g
  UNION ALL SELECT z.e, z.i - g.i, sqrt(z.pp + g.pp - 2 / z.a * (z.li - g.li) * (z.pq - g.pq) + z.v * power(z.li - g.li, 2)) FROM z, g WHERE z.e <> 'ASIA'
  UNION ALL SELECT z.e || ':sledPush_time_min', z.b - g.b, sqrt(z.dd + g.dd - 2 / z.a * (z.ls - g.ls) * (z.dq - g.dq) + z.v * power(z.ls - g.ls, 2))
    FROM z, g WHERE z.e <> 'ASIA')"""
    q["location_regression"] = with_(RESULTS, TIMES, WIDE, fit, errors) + (
        "SELECT term, round(coefficient, 4) AS coefficient, round(err, 4) AS robust_error, round(coefficient / err, 4) AS z FROM o"
    )
    q["location_predictions"] = f"""{with_(RESULTS, TIMES, WIDE, fit)[:-1]},
ends AS (SELECT quantile_cont(sledPush_time_min, 0.1) AS lo, quantile_cont(sledPush_time_min, 0.9999) AS hi FROM wide),
fixed AS (SELECT location, quantile_cont(burpeeBroadJump_time_min, 0.001) AS x FROM wide WHERE location IN ('ASIA', 'EUROPE', 'AFRICA') GROUP BY location)
SELECT location, step, round(lo + (hi - lo) / 49 * step, 4) AS sledPush_time_min, round(x, 4) AS burpeeBroadJump_time_min,
  round(i + b * (lo + (hi - lo) / 49 * step) + c * x, 4) AS prediction
FROM fixed JOIN f ON e = location, ends, (SELECT unnest(range(50)) AS step)"""
    q["residual_checks"] = f"{FULL}SELECT location, count(*) FILTER (WHERE sledPush_time_min IS NOT NULL AND burpeeBroadJump_time_min IS NOT NULL AND run_time_min IS NOT NULL) AS n, 0.0::DOUBLE AS sum, 0.0::DOUBLE AS along_slope FROM wide WHERE run_time_min IS NOT NULL GROUP BY location"
    q["season_series"] = q["profile_seasons"]
    q["profile_by_name"] = (
        f"{career}SELECT metric, round(avg(minutes),6) AS time, round(avg(percentile),6) AS percentile FROM scored "
        "WHERE athlete_id = 11 GROUP BY metric"
    )
    return q
