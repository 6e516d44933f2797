"""Ranks, quantiles and running sums against plain Python on awkward values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineside.operators import order

VALUES = [0.0, -0.0, 1.0, 1.0, 1.0, 2.0, 3.9999999, 4.0, -1.5, -1.5, 1e-300, -1e-300, 1e300, 7.0, 8.0, 7.9999999999, 0.1, 0.1]


def average_ranks(values):
    s = sorted(values)
    return [s.index(v) + (s.count(v) + 1) / 2 for v in values]


def test_average_ranks_with_ties_nulls_and_extremes(frame):
    df = frame([(i, v) for i, v in enumerate(VALUES)] + [(99, None)], "i int, v double")
    out = {r.i: (r.up, r.down) for r in order.with_average_ranks(df, {"up": "v", "down": "v"}, descending=["down"]).collect()}
    expected = average_ranks(VALUES)
    for i, rank in enumerate(expected):
        assert out[i] == (rank, len(VALUES) + 1 - rank)
    assert out[99] == (None, None)


def test_ranks_inside_strata_including_null_stratum(frame):
    df = frame([("a", 1.0), ("a", 2.0), (None, 5.0), (None, 5.0)], "s string, v double")
    out = sorted((str(r.s), r.r) for r in order.with_average_ranks(df, {"r": "v"}, ["s"]).collect())
    assert out == [("None", 1.5), ("None", 1.5), ("a", 1.0), ("a", 2.0)]


@pytest.mark.parametrize("n", [1, 2, 5, 10, 11])
def test_quantiles(frame, n):
    rng = random.Random(n)
    values = [round(rng.uniform(-3, 3), 1) for _ in range(n)]
    df = frame([(v,) for v in values], "v double")
    linear = order.quantiles(df, "v", {"m": 0.5, "p90": 0.9}).first()
    assert linear.m == pytest.approx(np.median(values)) and linear.p90 == pytest.approx(np.percentile(values, 90))
    assert order.quantiles(df, "v", {"u": 0.5}, method="upper").first().u == sorted(values)[n // 2]
    assert order.quantiles(df, "v", {"q": 0.25}, method="nearest").first().q == sorted(values)[int((n - 1) * 0.25 + 0.5)]


def test_gini(frame):
    df = frame([("a", 1.0), ("a", 3.0), ("a", 3.0), ("one", 2.0), ("zero", 0.0), ("zero", 0.0)], "g string, v double")
    out = {r.g: r.gini for r in order.gini(df, "v", ["g"]).collect()}
    x = np.array([1.0, 3.0, 3.0])
    assert out["a"] == pytest.approx((2 * (np.arange(1, 4) * x).sum() - 4 * x.sum()) / (3 * x.sum()))
    assert out["one"] is None and out["zero"] is None


def test_positions_and_running_weight_with_a_hot_value(frame):
    rows = [(f"id{i:03d}", 5.0 if i % 3 else float(i), float(i)) for i in range(60)]
    df = frame(rows, "id string, v double, w double")
    got = order.with_positions(df, "v", "id", descending=True, weight="w").orderBy("position").collect()
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [r.id for r in got] == [r[0] for r in want]
    assert [r.cum_weight for r in got] == pytest.approx(list(np.cumsum([r[2] for r in want])))
    assert {r.total for r in got} == {60} and got[-1].total_weight == pytest.approx(sum(r[2] for r in rows))


@pytest.mark.parametrize("n", [3, 5, 7, 12])
def test_ntile_gives_the_remainder_to_the_first_tiles(spark, n):
    df = spark.range(1, n + 1).select(order.ntile_of(F.col("id"), F.lit(n), 5).alias("t"))
    sizes = [n // 5 + (q <= n % 5) for q in range(1, 6)]
    assert [r.t for r in df.collect()] == [q for q, s in enumerate(sizes, 1) for _ in range(s)]


def test_infinity_and_nan_have_a_place(frame):
    values = [1.0, float("inf"), float("-inf"), float("nan"), 2.0, float("inf"), 1e308, -1e308]
    out = {r.i: r.rank for r in order.with_average_ranks(frame(list(enumerate(values)), "i int, v double"), {"rank": "v"}).collect()}
    assert [out[i] for i in range(8)] == [3.0, 6.5, 1.0, 8.0, 4.0, 6.5, 5.0, 2.0]


@pytest.mark.parametrize("descending", [False, True])
def test_large_integers_keep_their_order(frame, descending):
    rows = [("a", 2**60 + 2), ("b", 2**60 + 1), ("c", 2**60 + 3), ("d", -(2**63)), ("e", 2**60 + 1)]
    got = [r.id for r in order.with_positions(frame(rows, "id string, v long"), "v", "id", descending=descending).orderBy("position").collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (-r[1] if descending else r[1], r[0]))]


def test_tied_ids_with_a_common_head(frame):
    ids = [f"STOP-000000000{i:09d}" for i in range(60)] + ["STOP", "STOP-000000000", "S"]
    rows = frame([(i, 1.0 if n % 3 else 2.0, float(n)) for n, i in enumerate(ids)], "id string, v double, w double")
    got = order.with_positions(rows, "v", "id", weight="w").orderBy("position").collect()
    want = sorted(((1.0 if n % 3 else 2.0, i, float(n)) for n, i in enumerate(ids)))
    assert [r.id for r in got] == [x[1] for x in want] and [r.position for r in got] == list(range(1, len(ids) + 1))
    assert [r.cum_weight for r in got] == [sum(x[2] for x in want[:k + 1]) for k in range(len(ids))]


def most_in_a_task(frame):
    """The largest partition of a range split and the rows in all."""
    sizes = [r["count"] for r in frame.groupBy("_pid").count().collect()]
    return max(sizes), sum(sizes)


@pytest.fixture
def uncoalesced(spark):
    """Small partitions stay as they are split, so that borders and shares can be seen."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.unset(key)


def test_ties_and_nulls_are_spread_and_ranked(uncoalesced):
    spark = uncoalesced
    n = 20_000
    rows = spark.range(n).select("id", F.when(F.col("id") % 10 == 0, F.col("id") / 2).otherwise(7.25).alias("tied"),
                                 F.when(F.col("id") % 10 == 0, (F.col("id") % 30).cast("double")).alias("sparse"))
    for value in ("tied", "sparse"):
        split = order._in_ranges(rows.withColumns({"_key": F.col(value), "_any": F.rand(5)}), [], ["_key", "_any"])
        largest, total = most_in_a_task(split)
        assert total == n and largest < 0.4 * n
    got = {r.id: r for r in order.with_average_ranks(rows, {"a": "tied", "b": "sparse", "c": "tied"}, descending=["c"]).collect()}
    tied = np.array([i / 2 if i % 10 == 0 else 7.25 for i in range(n)])
    places = np.sort(tied)
    want = (np.searchsorted(places, tied, "left") + np.searchsorted(places, tied, "right") + 1) / 2
    assert all(got[i].a == want[i] and got[i].c == n + 1 - want[i] for i in range(n))
    sparse = {i: i % 30 for i in range(0, n, 10)}
    places = np.sort(list(sparse.values()))
    assert all(got[i].b == (None if i not in sparse else (np.searchsorted(places, sparse[i], "left") + np.searchsorted(places, sparse[i], "right") + 1) / 2)
               for i in range(n))


def test_runs_that_cross_partitions_in_some_strata(uncoalesced):
    spark = uncoalesced
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, 2.0, 2.0, None, 3.0])) for i in range(3000)]
    got = {r.i: (r.own, r.all) for r in order.with_average_ranks(
        spark.createDataFrame(rows, "i int, s string, v double").repartition(7), {"own": "v", "all": "v"}, within={"own": ["s"]}).collect()}
    for name, kept in (("all", lambda s: rows), ("own", lambda s: [r for r in rows if r[1] == s])):
        for s in ("a", "b", None):
            values = [r[2] for r in kept(s) if r[2] is not None]
            below = {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in set(values)}
            for i, t, v in rows:
                if t == s:
                    assert got[i][name == "all"] == below.get(v)


def test_positions_of_one_value_with_a_long_common_head(uncoalesced):
    spark = uncoalesced
    n = 20_000
    rows = spark.range(n).select(F.format_string("https://example.org/a/common/path/of/forty/%08d", "id").alias("id"), F.lit(1.0).alias("v"),
                                 (F.col("id") % 7 / 10).alias("w"))
    split = order._in_ranges(rows.withColumns({"_key": F.col("v"), "_tie": F.col("id"), "_row": F.xxhash64("id")}), [], ["_key", "_tie", "_row"])
    assert most_in_a_task(split)[0] < 0.4 * n
    got = order.with_positions(rows, "v", "id", weight="w").orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, n + 1)) and [r.id for r in got] == sorted(r.id for r in got)
    sums = np.cumsum([int(r.id[-8:]) % 7 for r in got]) / 10
    assert np.allclose([r.cum_weight for r in got], sums, rtol=1e-15, atol=0)
    again = order.with_positions(rows.repartition(3, "w"), "v", "id", weight="w").orderBy("position").collect()
    assert [(r.id, r.cum_weight, r.total_weight) for r in again] == [(r.id, r.cum_weight, r.total_weight) for r in got]


def test_running_sums_of_odd_weights(frame):
    rows = [("a", 1.0, 1e300), ("b", 2.0, -1e300), ("c", 3.0, 1e-300), ("d", 4.0, None), ("e", 5.0, 0.0)]
    got = order.with_positions(frame(rows, "id string, v double, w double"), "v", "id", weight="w").orderBy("position").collect()
    assert [r.cum_weight for r in got] == [1e300, 0.0, 0.0, 0.0, 0.0]
    ends = order.with_positions(frame([("a", 1.0, float("inf")), ("b", 2.0, 1.0)], "id string, v double, w double"), "v", "id", weight="w").collect()
    assert {r.cum_weight for r in ends} == {float("inf")}
    assert order.with_positions(frame([], "id string, v double, w double"), "v", "id", weight="w").count() == 0
