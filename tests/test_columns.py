"""Column expressions on hand-written rows."""

import math

import pytest
from pyspark.sql import functions as F

from lineside.functions import columns as C


def values(df, name):
    return [r[name] for r in df.collect()]


def test_labels(frame):
    df = frame([("1 - FREEPORT ROAD",), ("MONONGAHELA INCLINE",), ("28X",), ("A - B - C",)], "label string")
    out = df.select(C.entity_id(F.col("label")).alias("i"), C.entity_name(F.col("label")).alias("n")).collect()
    assert [(r.i, r.n) for r in out] == [
        ("1", "FREEPORT ROAD"), ("MI", "MONONGAHELA INCLINE"), ("28X", "28X"), ("A", "B - C")]


def test_months(frame):
    df = frame([("2019-Jan", "201902")], "h string, k string")
    row = df.select(C.month_from_header(F.col("h")).alias("a"), C.month_from_key(F.col("k")).alias("b"),
                    C.month_of_year(F.lit("2019-07")).alias("c")).first()
    assert (row.a, row.b, row.c) == ("2019-01", "2019-02", 7)


def test_bus_subtype(frame):
    rows = ["51", "51L", "28X", "P1", "P12", "G2", "O1", "P1L"]
    df = frame([(r,) for r in rows], "r string").select(C.bus_subtype(F.col("r")).alias("s"))
    assert values(df, "s") == ["local", "limited", "express", "busway", "flyer", "busway", "flyer", "limited"]


def test_known_place(frame):
    df = frame([("Hill",), (None,), ("0",), ("",)], "h string").select(C.known_place(F.col("h")).alias("k"))
    assert [bool(v) for v in values(df, "k")] == [True, False, False, False]


@pytest.mark.parametrize("rows, weighted, fallback", [
    ([(0.5, 1.0), (1.0, 3.0)], 0.875, 0.875),
    ([(0.5, 0.0), (1.0, 0.0)], None, 0.75),           # zero total weight
    ([(0.5, None), (1.0, None)], None, 0.75),         # no weights at all
    ([(0.5, None), (1.0, 2.0)], 1.0, 1.0),            # a missing weight leaves both sums
    ([(None, 2.0), (1.0, 2.0)], 0.5, 0.5),            # a missing value leaves its weight in place
])
def test_weighted_means(frame, rows, weighted, fallback):
    out = frame(rows, "v double, w double").agg(
        C.weighted_mean(F.col("v"), F.col("w")).alias("a"), C.weighted_or_plain_mean(F.col("v"), F.col("w")).alias("b")).first()
    assert (out.a, out.b) == (weighted, fallback)


def test_pearson_without_variance(frame):
    assert frame([(1.0, 2.0), (1.0, 3.0)], "x double, y double").agg(C.pearson(F.col("x"), F.col("y")).alias("r")).first().r is None


def test_sum_of_nothing_and_log(frame):
    row = frame([(None, 0.0), (None, -1.0)], "x double, y double").agg(
        C.sum_or_zero(F.col("x")).alias("s"), F.max(C.safe_log(F.col("y"))).alias("l")).first()
    assert (row.s, row.l) == (0.0, None)


def test_geometry(spark):
    row = spark.range(1).select(
        C.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("quarter"),
        C.mercator_lat(F.lit(4926000.0)).alias("lat"), C.mercator_lon(F.lit(-8905559.263)).alias("lon"),
        C.distance_zone(F.lit(2.0)).alias("zone")).first()
    assert row.quarter == pytest.approx(math.pi / 2 * 6371)
    assert row.lon == pytest.approx(-80.0, abs=1e-6) and row.lat == pytest.approx(40.42, abs=0.05)
    assert row.zone == "Inner ring (2-8 km)"


@pytest.mark.parametrize("scale", [1e-13, 1.0, 1e9, 1e300, 1e-290])
def test_stable_cuts_significant_digits(frame, scale):
    rows = frame([(i, scale * (i + 1), scale * (i + 1) * (1 + 3e-16)) for i in range(10)], "i int, a double, b double")
    got = rows.select(C.stable(F.col("a")).alias("a"), C.stable(F.col("b")).alias("b"), "i").orderBy("i").collect()
    assert len({r.a for r in got}) == 10 and all(r.a == r.b == pytest.approx(scale * (r.i + 1), rel=1e-11) for r in got)


def test_stable_leaves_special_values(frame):
    got = values(frame([(0.0,), (-0.0,), (float("inf"),), (None,), (-2.5,)], "v double").select(C.stable(F.col("v")).alias("v")), "v")
    assert got == [0.0, 0.0, float("inf"), None, -2.5] and math.copysign(1, got[1]) == 1


def test_gap_of_equal_sums_is_zero(frame):
    df = frame([(0.1 + 0.2, 0.3), (1e-13, 2e-13), (5e9, 5e9 - 1)], "a double, b double")
    assert values(df.select(C.gap(F.col("a"), F.col("b")).alias("g")), "g") == [0.0, pytest.approx(-1e-13), 1.0]
