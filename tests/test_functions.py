import datetime as dt
import math

import pytest
from fixtures import rows
from pyspark.sql import functions as F

from paceline.errors import InvalidRequest
from paceline.functions import durations, labels, text
from paceline.schema import RAW_RENAMES, distribution_column, floor_of, time_column


def values(spark, kind, data, expression):
    df = rows(spark, f"i int, v {kind}", list(enumerate(data)))
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_clock_minutes(spark):
    cases = {
        "00:54:30": 54.5, "5:30": 5.5, "75:30": 75.5, "1:75:00": 135.0, "5:3": 5.05, "1:02:00.5": 62 + 0.5 / 60,
        "-0:05:00": None, "62": None, "3.5": None, "": None, "nan": None, "1:2:3:4": None, " 10:00 ": 10.0, "a:b": None, ":30": None,
    }
    found = values(spark, "string", list(cases), durations.clock_minutes)
    assert found == [None if v is None else pytest.approx(v) for v in cases.values()]


def test_loose_minutes(spark):
    cases = {
        "5:30": 5.5, "1:23:45": 83.75, "0:45": 0.75, "2:00:00": 120.0, "  3.14  ": 3.14, "42": 42.0, "0": 0.0,
        ":30": None, "5:": None, "1:2:3:4": None, "a:b": None, "abc": None, "12abc": None, "   ": None, "": None, "NaN": None,
    }
    found = values(spark, "string", [*cases, None], durations.loose_minutes)
    assert found == [None if v is None else pytest.approx(v) for v in cases.values()] + [None]


def test_clock_text(spark):
    data = [0.0, 5.0, 5.5, 12.25, 60.0, 90.5, 125.0, -5.0, None, math.nan, math.inf]
    assert values(spark, "double", data, durations.clock_text) == [
        "0:00", "5:00", "5:30", "12:15", "1:00:00", "1:30:30", "2:05:00", "0:00", "-", "-", "-",
    ]
    assert values(spark, "double", [-5.0, 75.0], durations.length_text) == ["5:00", "1:15:00"]
    assert values(spark, "double", [0.0, 2.5, -3.0, None], durations.delta_text) == ["0:00", "+2:30", "-3:00", "-"]


def test_labels(spark):
    assert values(spark, "double", [0.5, 1.0, 0.953, None, math.nan], labels.percent_text) == [
        "50.0%", "100.0%", "95.3%", "0.0%", "-",
    ]
    assert values(spark, "double", [0.9, 0.75, 0.25, 0.1, None], labels.percentile_band) == [
        "excellent", "good", "average", "below", None,
    ]
    assert values(spark, "double", [1.0, 0.75, 0.5], labels.top_percent) == ["Top 1%", "Top 25%", "Top 50%"]
    assert values(spark, "double", [1.2, -1.0, 0.5], labels.percent_fill) == [100.0, 0.0, 50.0]
    assert values(spark, "double", [5.0, 0.0, 2.5], labels.window_label) == [
        "+/- 5 min", "the selected +/- time window", "+/- 2.5 min",
    ]
    moment = [dt.datetime(2024, 3, 1)]
    assert values(spark, "timestamp", moment, labels.month_label) == ["Mar '24"]


def test_text(spark):
    assert values(spark, "string", ["Run 1", " SkiErg ", "Burpee Broad Jump", None], text.plain) == [
        "run1", "skierg", "burpeebroadjump", None,
    ]
    assert values(spark, "string", ["Zoë O'Neil-Smith", "a_b"], text.tokens) == [["zoë", "o", "neil", "smith"], ["a_b"]]
    names = ["a b / c d", "a b & c", "ann one and bo two", "a x b", "a b, c d", "smith, ann", "maxx andy", "p|q", ""]
    assert values(spark, "string", names, text.partners) == [
        ["a b", "c d"], ["a b", "c"], ["ann one", "bo two"], ["a", "b"], ["a b", "c d"], ["smith, ann"], ["maxx andy"], ["p", "q"], [],
    ]
    assert values(spark, "string", [" x ", "  ", None], text.present) == ["x", None, None]


def test_finite(spark):
    assert values(spark, "string", ["1.5", "x", "NaN", "Infinity", None], durations.finite) == [1.5, None, None, None, None]


def test_metric_names():
    assert time_column("sledPush") == "sledPush_time_min"
    assert time_column("Sled Push Time") == time_column("sledPush_time_min")
    assert time_column("run_total") == time_column("run") == "run_time_min"
    assert time_column("total") == "total_time_min"
    assert distribution_column("overall") == "total_time_min"
    assert distribution_column("SkiErg") == "skiErg_time_min"
    with pytest.raises(InvalidRequest, match="burpeeBroadJump_time_min, farmersCarry_time_min"):
        time_column("swim")
    with pytest.raises(InvalidRequest):
        distribution_column("work")
    assert floor_of("run1_time_min") == floor_of("Run 3") == floor_of("run_time_min") == 1.0
    assert floor_of("rowErg_time_min") is None
    assert RAW_RENAMES["work_4"] == "burpeeBroadJump_time" and RAW_RENAMES["run_8"] == "run8_time" and len(RAW_RENAMES) == 16
