"""Analyses on hand-written native tables with the awkward rows, and a sample of twins on the smallest data."""

import pytest
from pyspark.sql import functions as F

from lineside import catalog
from lineside.plans import common, etl, places, routes, system, usage
from lineside.sources.binding import Tables
from tests.oracle_check import compare, duck

SMALL = "/root/testdata/sf0.001"
SAMPLE = ["system_trend", "mode_comparison", "entity_ranking", "anomalies", "area_equity", "paired_variants", "value_quintiles",
          "concentration_index", "pareto_curve", "stop_consolidation", "geographic_span", "schedule_change_impact", "usage_geography",
          "load_first_row_wins", "etl_otp_long", "co_movement", "granger_causality", "weather_seasonal_models"]


@pytest.fixture
def native(frame):
    months = [f"{2019 + i // 12}-{i % 12 + 1:02d}" for i in range(24)]
    otp = [("51", m, 0.5 + (i % 3) / 10) for i, m in enumerate(months)] + [("51L", m, 0.7) for m in months[:18]]
    otp += [("28X", m, 0.6) for m in months[:5]] + [("lost", months[0], 0.9)]
    return {
        "otp": frame(otp, "route_id string, month string, otp double"),
        "routes": frame([("51", "Carrick", "BUS"), ("51L", "Carrick limited", "BUS"), ("28X", "Airport", "BUS"), ("RED", "Red", "RAIL")],
                        "route_id string, route_name string, mode string"),
        "route_stops": frame([("51", "s1", "IB", 10, 5, 5, 70), ("51", "s2", "OB", 20, 0, 0, 140), ("51L", "s1", "IB,OB", None, 1, 1, None),
                              ("28X", "s3", "IB", 0, 0, 0, 0), ("28X", "s4", None, 0, 0, 0, 0)],
                             "route_id string, stop_id string, direction string, trips_wd int, trips_sa int, trips_su int, trips_7d int"),
        "stops": frame([("s1", "One", 40.0, -80.0, "C", "M", "H"), ("s2", "Two", 40.1, -80.0, "C", "M", "0"), ("s3", "Three", 40.0, -80.0, "C", "0", ""),
                        ("s4", "Four", 40.0, -80.0, "C", None, None)],
                       "stop_id string, stop_name string, lat double, lon double, county string, muni string, hood string"),
        "schedule": frame([("51", months[0], "WEEKDAY", 40)], "route_id string, month string, day_type string, daily_trips int"),
    }


def test_trend_weights_fall_back(native):
    rows = {r.month: r for r in system.system_trend(native["otp"], native["schedule"], native["route_stops"], native["routes"])
            .where("stratum = 'all'").collect()}
    first, second = rows["2019-01"], rows["2019-02"]
    assert first.route_count == 4 and first.pct_time_varying == 25.0
    assert first.weighted_otp == pytest.approx(0.5)           # only route 51 has a weight
    assert second.weighted_otp == pytest.approx(0.6)          # weekly trips / 7
    assert rows["2020-01"].yoy_change == pytest.approx(0.0) and first.yoy_change is None


def test_variants_pair_by_suffix(native):
    pairs = system.paired_variants(native["otp"], native["routes"])
    assert {(r.base_id, r.variant_id) for r in pairs.collect()} == {("51", "51L")} and pairs.count() == 18


def test_ranking_flags_and_missing_parts(native):
    rows = {r.route_id: r for r in routes.entity_ranking(native["otp"], native["routes"], native["route_stops"], "2019-01").collect()}
    assert rows["28X"].limited_data and rows["28X"].rank_avg is None and rows["28X"].slope is None
    assert (rows["51L"].rank_avg, rows["51"].rank_avg) == (1.0, 2.0) and "lost" not in rows


def test_anomaly_needs_spread_and_history(native):
    flagged = routes.anomalies(native["otp"], native["routes"], events={"2019-08": "works"})
    rows = {(r.route_id, r.month): r for r in flagged.collect()}
    assert rows["51L", "2019-12"].z_score == 0.0 and rows["51", "2019-06"].rolling_mean is None
    assert rows["51", "2019-08"].known_event == "works" and rows["51", "2019-09"].known_event is None
    assert {r.route_id for r in routes.short_entities(native["otp"]).collect()} == {"28X", "lost"}


def test_area_ignores_missing_names_and_weights(native):
    rows = places.area_equity(native["otp"], native["routes"], native["route_stops"], native["stops"]).collect()
    assert [(r.hood, r.route_count, r.stop_count, r.total_trips_7d) for r in rows] == [("H", 1, 1, 70)]


def test_stop_value_is_dropped_without_trips(native):
    rows = {r.stop_id for r in places.stop_hotspots(native["otp"], native["routes"], native["route_stops"], native["stops"], 1).collect()}
    assert rows == {"s1", "s2"}


def test_asymmetry_leaves_out_one_direction_routes(native):
    rows = places.directional_asymmetry(native["otp"], native["routes"], native["route_stops"]).collect()
    assert [(r.route_id, r.asymmetry_index) for r in rows] == [("51", pytest.approx(1 / 3))]


def test_jurisdictions_without_enough_routes_have_no_test(native):
    row = places.jurisdiction_test(places.jurisdiction_rows(native["otp"], native["routes"], native["route_stops"], native["stops"])).first()
    assert row.n_cross == 0 and row.n_single == 2 and row.t is None and row.p is None


def test_weekend_ratio_without_weekday_service(native):
    rows = {r.route_id: r.weekend_ratio for r in common.with_weekend_ratio(common.peak_trips(native["route_stops"])).collect()}
    assert rows["28X"] == 0.0 and rows["51"] == pytest.approx(0.25)


def test_projected_stops_may_be_negative(frame, native):
    candidates = frame([(f"s{i}", "51", True) for i in range(5)], "stop_id string, route_name string, candidate boolean")
    row = usage.consolidation_summary(candidates, native["otp"], native["routes"], native["route_stops"]).first()
    assert (row.stop_count, row.n_candidates, row.projected_stops) == (2, 5, -3)


def test_usage_change_without_earlier_use(frame):
    rows = [("s", "r", "2019", "Weekday", p, "BUS", on, 0.0, "x", 40.0, -80.0) for p, on in (("Pre-pandemic", 0.0), ("Pandemic", 4.0))]
    df = frame(rows, "stop_id string, route_name string, datekey string, serviceday string, time_period string, mode string, avg_ons double, "
                     "avg_offs double, stop_name string, latitude double, longitude double")
    row = usage.usage_change(df).first()
    assert (row.abs_change, row.pct_change, row.zone) == (4.0, None, "Outer ring (> 8 km)")


def test_audit_reports_absence(native):
    tables = {"routes": native["routes"], "otp_monthly": native["otp"], "route_stops": native["route_stops"], "stops": native["stops"],
              "stop_reference": native["stops"].withColumn("mode", F.lit("BUS"))}
    rows = {(r.source, r.finding): r.n for r in etl.entity_audit(tables, ["MI", "28X"], ["one"], "RAIL").collect()}
    assert rows["routes", "id or mode"] == 2 and rows["otp_monthly", "positive values"] == 5 and rows["stops", "name match"] == 1


@pytest.fixture(scope="module")
def twins():
    from __spark_entry__ import oracle_sql

    return duck(SMALL), oracle_sql()


@pytest.mark.parametrize("name", SAMPLE)
def test_twin_on_the_smallest_data(spark, twins, name):
    con, sql = twins
    assert compare(catalog.run(name, spark, SMALL).toPandas(), con.execute(sql[name]).df()) is None


def test_every_query_has_a_twin(twins):
    assert set(catalog.names()) <= set(twins[1])


@pytest.mark.parametrize("name", ["seasonal_amplitude", "dual_recovery", "parametrised_sql"])
def test_month_ranges_reach_the_scan(spark, name):
    plan = catalog.run(name, spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in plan.splitlines() if "lineitem.parquet" in line]
    assert any("GreaterThanOrEqual(l_shipdate" in line and "LessThan(l_shipdate" in line for line in pushed)


def test_months_of_a_span_are_whole(spark):
    tables = Tables(spark, SMALL)
    part = tables.during(("1995-11", "1996-01"), ("1997-12", "1997-12"))
    months = ["1995-11", "1995-12", "1996-01", "1997-12"]
    assert part.otp.exceptAll(tables.otp.where(F.col("month").isin(months))).isEmpty()
    assert sorted(r.month for r in part.otp.select("month").distinct().collect()) == months


def test_stops_and_routes_of_a_place_are_counted_without_laying_rows_out_once_for_each_count(frame):
    otp = frame([("a", "2000-01", 0.5), ("a", "2000-02", 0.7), ("b", "2000-01", 1.0)], "route_id string, month string, otp double")
    visits = frame([("a", "s1", 2), ("a", "s1", 2), ("a", "s1", 3), ("b", "s1", None), ("b", "s2", 4), ("c", "s3", 9), ("a", "s4", 1)],
                   "route_id string, stop_id string, trips_wd bigint")
    stops = frame([("s1", "m", None), ("s1", "m", None), ("s2", "m", None), ("s3", "m", None), ("s4", "m", "x"), ("s4", "0", "x")], "stop_id string, muni string, county string")
    got = places.municipal_equity(otp, visits, stops, 1)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    found = {(r.muni, r.county): (round(r.avg_otp, 9), r.n_stops, r.n_routes, r.total_trips) for r in got.collect()}
    assert found == {("m", None): (round((0.6 * 10 + 4) / 14, 9), 2, 2, 14), ("m", "x"): (0.6, 1, 1, 1)}


def test_a_route_that_is_listed_twice_counts_twice_at_its_hubs(frame):
    otp = frame([("a", "2000-01", 0.5), ("b", "2000-01", 1.0)], "route_id string, month string, otp double")
    listed = frame([("a", "A", "BUS"), ("a", "A", "BUS"), ("b", "B", "BUS")], "route_id string, route_name string, mode string")
    visits = frame([("a", "s", 3), ("a", "s", 3), ("b", "s", 2)], "route_id string, stop_id string, trips_wd bigint")
    stops = frame([("s", "S", 1.0, 2.0, "m")], "stop_id string, stop_name string, lat double, lon double, muni string")
    [hub] = places.transfer_hubs(otp, listed, visits, stops).collect()
    assert (hub.avg_otp, hub.n_routes, hub.total_trips) == (0.625, 2, 8)
