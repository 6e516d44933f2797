"""Series operators: gaps, short series, events at either end."""

import pytest
from pyspark.sql import functions as F

from lineside.operators import series

MONTHS = [f"{2020 + i // 12}-{i % 12 + 1:02d}" for i in range(30)]


def panel(frame, lengths):
    return frame([(e, MONTHS[i], float(i % 5)) for e, n in lengths.items() for i in range(n)], "e string, m string, v double")


def test_trailing_needs_enough_rows_and_leaves_out_the_current_one(frame):
    w = series.over_entity("e", "m")
    df = panel(frame, {"a": 8}).withColumn("b", series.trailing("v", w, 12, 6, include_current=False)).orderBy("m")
    got = [r.b for r in df.collect()]
    assert got[:6] == [None] * 6 and got[6] == pytest.approx(sum([0, 1, 2, 3, 4, 0]) / 6)


def test_centred_trend_misses_the_last_six_rows(frame):
    w = series.over_entity("e", "m")
    got = [r.t for r in panel(frame, {"a": 14}).withColumn("t", series.centred_trend("v", w)).orderBy("m").collect()]
    values = [i % 5 for i in range(14)]
    assert got[-6:] == [None] * 6
    assert got[0] == pytest.approx(sum(values[:7]) / 7) and got[7] == pytest.approx(sum(values[2:14]) / 12)


def test_lag_counts_rows_not_months(frame):
    df = frame([("a", "2020-01", 1.0), ("a", "2020-05", 4.0)], "e string, m string, v double")
    assert [r.delta_v for r in series.first_differences(df, "e", "m", ["v"]).collect()] == [3.0]


def test_last_periods_and_minimum_rows(frame):
    df = panel(frame, {"a": 30, "b": 5})
    assert series.last_periods(df, "m", 12).count() == 12
    assert {r.e for r in series.entities_with(df, "e", 12).select("e").distinct().collect()} == {"a"}


def test_balanced_panel(frame):
    df = panel(frame, {"a": 24, "b": 11}).withColumn("k", F.substring("m", 6, 2).cast("int"))
    assert {r.e for r in series.balanced_panel(df, "e", "k").collect()} == {"a"}


def test_linear_trend_without_variance(frame):
    df = frame([("flat", 1.0, 0.3), ("flat", 1.0, 0.5), ("up", 0.0, 1.0), ("up", 1.0, 2.0), ("up", 2.0, 3.5)], "e string, x double, y double")
    out = {r.e: r for r in series.linear_trend(df, ["e"], "x", "y").collect()}
    assert out["flat"].slope == 0.0 and out["flat"].slope_stderr is None and out["flat"].slope_significant is False
    assert out["up"].slope == pytest.approx(15.0) and out["up"].slope_stderr == pytest.approx(12 * 0.14433757)


def test_events_need_two_values_on_both_sides(frame):
    otp = panel(frame, {"a": 10})
    codes = [(("a", MONTHS[i], "p1" if i < at else "p2", i)) for at in (5,) for i in range(10)]
    events = series.change_points(frame(codes, "e string, m string, c string, t int"), "e", "m", "c", "t")
    row = series.event_windows(events, otp, "e", "m", "v").first()
    assert (row.n_before, row.n_after, row.value_before, row.value_after) == (3, 3, 3.0, 1.0)
    for at in (1, 9):  # first and last month: one value on one side
        codes = [("a", MONTHS[i], "p1" if i < at else "p2", i) for i in range(10)]
        events = series.change_points(frame(codes, "e string, m string, c string, t int"), "e", "m", "c", "t")
        assert events.count() == 1 and series.event_windows(events, otp, "e", "m", "v").count() == 0
