"""Scans, keyed loads, constraints and the incremental load on small files."""

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lineside.operators import load
from lineside.plans import etl, usage, weather
from lineside.sources import json_arrays, readers, sinks


def test_text_scan_repairs_line_ends_bom_and_markers(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_bytes("﻿route_id,n,last\r\r\n1,NA,x\r\r\n2,,\r\r\n".encode())
    df = readers.read_text_csv(spark, str(path), ["NA"])
    assert df.columns == ["route_id", "n", "last"]
    assert [tuple(r) for r in df.orderBy("route_id").collect()] == [("1", None, "x"), ("2", None, None)]


def test_typed_scan_prunes_and_casts_leniently(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c\n1,2.5,x\nbad,,y\n")
    rows = readers.read_csv(spark, str(path), "c string, a int, b double").orderBy("c").collect()
    assert [tuple(r) for r in rows] == [("x", 1, 2.5), ("y", None, None)]
    part = readers.read_csv_overrides(spark, str(path), ["a", "b"], {"b": "double"})
    assert dict(part.dtypes) == {"a": "string", "b": "double"}


def test_parametrised_sql(spark, frame):
    df = frame([("a", 1), ("b", 2)], "k string, v int")
    assert readers.query_tables(spark, "SELECT k FROM {t} WHERE v > :low", {"low": 1}, t=df).first().k == "b"


def test_value_file_to_long_rows(frame):
    wide = frame([("1 - FREEPORT ROAD", "0.5", ""), ("MONONGAHELA INCLINE", None, "oops"), ("2 - A - B", "0.25", "0.75")],
                 "Route string, `2019-Jan` string, `2019-Feb` string")
    got = sorted(tuple(r) for r in etl.otp_long(wide).collect())
    assert got == [("1", "2019-01", 0.5), ("2", "2019-01", 0.25), ("2", "2019-02", 0.75)]


def test_routes_prefer_the_label_and_fill_unknown(frame):
    wide = frame([("1 - FREEPORT ROAD",), ("MONONGAHELA INCLINE",)], "Route string")
    system = frame([(0, "1", "Other name", "BUS"), (1, "1", "Later", "RAIL"), (2, "9", "Nine", "BUS")],
                   "o int, routes string, route_name string, mode string")
    got = sorted(tuple(r) for r in etl.routes_table(wide, system, "o").collect())
    assert got == [("1", "FREEPORT ROAD", "BUS"), ("9", "Nine", "BUS"), ("MI", "MONONGAHELA INCLINE", "UNKNOWN")]


def test_schedule_keeps_the_dominant_period(frame):
    raw = frame([("BLLB", "201901", "WEEKDAY", 10, 1.0, "p1", "G", "RAIL"), ("BLLB", "201901", "WEEKDAY", 30, 2.0, "p2", "G", "RAIL"),
                 ("1", "201902", "SAT.", 5, 3.0, "p2", "G", "BUS"), ("1", "201902", "SAT.", 5, 4.0, "p1", "G", "BUS")],
                "RouteCode string, dateKey string, `Day.Type.Join` string, `Daily.Trip.Count` int, `Daily.Trip.Dist` double, "
                "PickID string, Current_Garage string, Mode string")
    got = sorted((r.route_id, r.month, r.daily_trips, r.pick_id) for r in etl.schedule_table(raw).collect())
    assert got == [("1", "2019-02", 5, "p1"), ("BLUE", "2019-01", 30, "p2")]


def test_bridge_drops_aggregate_rows(frame):
    rows = [(0, "All Routes", "1", "s", "IB"), (1, "1", "1", "s", "IB"), (2, "1", "1", "s", "IB"), (3, None, "1", "s", "OB")]
    raw = frame([(*r, 1, 1, 1, 7, "x") for r in rows],
                "o int, route_filter string, routes string, stop_id string, direction string, trips_wd int, trips_sa int, trips_su int, "
                "trips_7d int, svc_days string")
    assert [(r.route_id, r.direction) for r in etl.route_stops_table(raw, "o").collect()] == [("1", "IB")]


def test_keyed_load_keeps_first_and_every_null_key(frame):
    df = frame([("a", None, 2, 1.0), ("a", None, 1, 2.0), ("a", "IB", 2, 3.0), ("a", "IB", 1, 4.0), ("b", "IB", 1, None)],
               "r string, d string, o int, v double")
    got = sorted((r.r, str(r.d), r.v) for r in load.load_once(df, ["r", "d"], ["o"], ["v"]).collect())
    assert got == [("a", "IB", 4.0), ("a", "None", 1.0), ("a", "None", 2.0)]


def test_constraints_are_counted_and_foreign_keys_stop_the_load(spark, frame, tmp_path):
    routes = frame([("1", "One", "BUS", 0), ("1", "Again", "BUS", 1), (None, "x", "BUS", 2)], "route_id string, route_name string, mode string, _ordinal int")
    good = frame([("1", "2019-01", 0.5, 0), ("1", "2019-01", 0.6, 1)], "route_id string, month string, otp double, _ordinal int")
    order = {"routes": ["_ordinal"], "otp_monthly": ["_ordinal"]}
    report = sinks.load_tables(spark, {"routes": routes, "otp_monthly": good}, str(tmp_path), order)
    found = {(r.table_name, r.check_name): r.violations for r in report.collect()}
    assert found["routes", "primary_key"] == 1 and found["routes", "not_null"] == 1
    assert spark.read.parquet(f"{tmp_path}/otp_monthly").first().otp == 0.5
    lost = frame([("7", "2019-01", 0.5, 0)], "route_id string, month string, otp double, _ordinal int")
    with pytest.raises(load.ForeignKeyError):
        sinks.load_tables(spark, {"routes": routes, "otp_monthly": lost}, str(tmp_path / "again"), order)


def test_profile_coverage_and_change(frame):
    a, b = frame([("m1", 1), ("m2", 3), (None, None)], "k string, v int"), frame([("m2",), ("m3",)], "k string")
    assert [(r.column_name, r.n_null) for r in load.null_profile(a, ["k", "v"]).collect()] == [("k", 1), ("v", 1)]
    row = load.key_coverage(a, b, "k").first()
    assert (row.n_both, row.n_only_left, row.n_only_right) == (1, 1, 1)
    assert load.period_change(a, "k", "v", "m1", "m2").first().pct_change == 200.0
    assert load.both_ends(a.dropna(), "v", "k", 5).count() == 2


def test_road_features(spark, tmp_path):
    def feature(i, count, paths):
        return {"attributes": {"OBJECTID": i, "CUR_AADT": count, "TRK_PCT": None, "SEG_LNGTH_FEET": None}, "geometry": {"paths": paths}}

    line = [[[0.0, 0.0], [10.0, 0.0]], [[20.0, 5.0]]]
    path = tmp_path / "f.json"
    path.write_text(json.dumps([feature(1, 100, line), feature(2, None, line), feature(3, 0, line), feature(4, 5, []), {"attributes": {"CUR_AADT": 3}}]))
    rows = etl.road_segments(readers.read_road_features(spark, str(path))).collect()
    assert [(r.object_id, r.length_ft, len(r.points)) for r in rows] == [(1, 0.0, 3)]


def test_monthly_weather_counts(frame):
    daily = frame([("2020-01-01", None, 5.0, 32.0, -1.0, 2.0), ("2020-01-02", 25.0, 0.0, 31.9, 0.0, None), ("2020-02-01", None, None, None, None, None)],
                  "DATE string, PRCP double, SNOW double, TMAX double, TMIN double, AWND double")
    jan, feb = weather.monthly_weather(daily).orderBy("month").collect()
    assert (jan.total_precip_mm, jan.snow_days, jan.hot_days, jan.freeze_days, jan.heavy_precip_days, jan.n_obs) == (25.0, 1, 1, 1, 1, 2)
    assert (feb.total_precip_mm, feb.mean_tmax_c, feb.n_obs) == (0.0, None, 1)


def test_a_file_with_another_header_is_refused(spark, tmp_path):
    (tmp_path / "1.csv").write_text("x,y\n1,2\n")
    (tmp_path / "2.csv").write_text("x,y\n3,4\n")
    assert sorted((r.x, r.y) for r in readers.read_text_csv(spark, str(tmp_path)).collect()) == [("1", "2"), ("3", "4")]
    (tmp_path / "3.csv").write_text("y,x\n6,5\n")
    with pytest.raises(Exception, match="header|HEADER"):
        readers.read_text_csv(spark, str(tmp_path)).collect()


def test_usage_attributes_do_not_depend_on_row_order(frame):
    kind = ("stop_id string, route_name string, time_period string, serviceday string, datekey int, avg_ons double, avg_offs double, "
            "latitude double, longitude double, stop_name string, direction string, mode string")
    rows = [("s", "1", usage.BEFORE, usage.WEEKDAY, 1, 1.0, 2.0, 40.0 + i, -80.0, name, "IB", "BUS") for i, name in enumerate("ba")]
    for order in (rows, rows[::-1]):
        got = usage.stop_route_usage(frame(order, kind).coalesce(1)).first()
        assert (got.lat, got.stop_name) == (40.0, "b")


def test_csv_sink(spark, frame, tmp_path):
    sinks.write_csv(frame([("a", 1)], "k string, v int"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).select(F.col("v").cast("int")).first().v == 1


def test_one_json_array_is_read_in_many_splits(spark, tmp_path):
    import random
    rng = random.Random(6)
    odd = ['}', '{"a": [', '\\', '"', ']]}', 'é🙂', '\n', ',', '\\"', '}{' * 40]
    rows = [{"id": i, "s": "".join(rng.choice(odd) for _ in range(rng.randint(0, 9))), "n": {"p": [[i, 1.5], []], "t": rng.choice(odd)}} for i in range(400)]
    rows[7] = {"id": None, "extra": {"x": ["}"]}}
    rows[9]["s"] = "long } " * 600
    schema = "id bigint, s string, n struct<p: array<array<double>>, t: string>"
    (tmp_path / "a.json").write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(rows[:50], indent=2), encoding="utf-8")
    (tmp_path / "c.json").write_text(" []\n")
    want = sorted(map(str, spark.read.schema(schema).option("multiLine", True).json(str(tmp_path)).collect()))
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    try:
        for size in ("97", "1000", "100000000"):
            spark.conf.set(key, size)
            scan = json_arrays.read_json_array(spark, str(tmp_path), schema)
            assert sorted(map(str, scan.collect())) == want
            splits = spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions()
            assert (splits > 100) == (size == "97")
    finally:
        spark.conf.set(key, was)


def test_json_array_sink(spark, frame, tmp_path):
    rows = [(i, "}" * i) for i in range(9)]
    sinks.write_json_arrays(frame(rows, "k int, v string").repartition(3), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in json_arrays.read_json_array(spark, str(tmp_path / "out"), "k int, v string").collect()) == rows
    sinks.write_json_arrays(frame([], "k int, v string"), str(tmp_path / "none"))
    assert json_arrays.read_json_array(spark, str(tmp_path / "none"), "k int, v string").count() == 0


def test_a_load_is_published_whole_or_not_at_all(spark, frame, tmp_path):
    root, order = str(tmp_path), {"routes": ["_ordinal"], "otp_monthly": ["_ordinal"]}
    routes = frame([("1", "One", "BUS", 0), ("1", "Again", "BUS", 1)], "route_id string, route_name string, mode string, _ordinal int")
    kind = "route_id string, month string, otp double, _ordinal int"
    assert sinks.published(spark, root) == (0, {})
    with pytest.raises(KeyError):
        sinks.read_published(spark, root, "routes")
    sinks.publish_load(spark, {"routes": routes, "otp_monthly": frame([("1", "2019-01", 0.5, 0)], kind)}, root, order)
    assert sinks.unpublished(spark, root) == []
    changed = frame([("1", "Other", "RAIL", 0)], "route_id string, route_name string, mode string, _ordinal int")
    with pytest.raises(load.ForeignKeyError):
        sinks.publish_load(spark, {"routes": changed, "otp_monthly": frame([("7", "2019-01", 0.5, 0)], kind)}, root, order)
    assert sinks.published(spark, root)[0] == 1 and sinks.read_published(spark, root, "routes").first().route_name == "One"
    assert len(sinks.unpublished(spark, root)) == 1
    held = sinks.read_published(spark, root, "otp_monthly")
    assert sinks.publish_table(frame([("1", "2020-01", 0.9)], "route_id string, month string, otp double"), root, "otp_monthly") == 2
    assert sinks.read_published(spark, root, "otp_monthly").first().otp == 0.9 and sinks.read_published(spark, root, "routes").first().mode == "BUS"
    assert held.first().otp == 0.5  # a reader that began before goes on undisturbed


def test_a_load_reads_its_source_once(spark, frame, tmp_path):
    rows = [("a", "IB", 2, 1.0), ("a", "IB", 1, 2.0), ("a", None, 2, 3.0), ("a", None, 1, 4.0), ("b", "IB", 1, None), ("b", "IB", 3, 5.0), ("c", "IB", 1, None)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    kind = "route_id string, month string, _ordinal int, otp double"
    df = frame(rows, kind).mapInPandas(counted, kind)
    routes = frame([("a", "A", "BUS", 0), ("b", "B", "BUS", 0)], "route_id string, route_name string, mode string, _ordinal int")
    order = {"routes": ["_ordinal"], "otp_monthly": ["_ordinal"]}
    report = sinks.load_tables(spark, {"routes": routes, "otp_monthly": df}, str(tmp_path / "a"), order)
    found = {(r.table_name, r.check_name, r.column_name): r.violations for r in report.collect()}
    assert read.value == len(rows)
    assert found["otp_monthly", "primary_key", "route_id,month"] == 2 and found["otp_monthly", "not_null", "month"] == 2
    assert found["otp_monthly", "not_null", "otp"] == 2 and found["routes", "primary_key", "route_id"] == 0
    kept = spark.read.parquet(f"{tmp_path}/a/otp_monthly")
    assert sorted(tuple(r) for r in kept.select("route_id", "month", "otp").collect()) == [("a", "IB", 2.0), ("b", "IB", 5.0)]
    # without NOT NULL every row with a null key part stays
    seen = Observation()
    load.load_once(frame(rows, kind), ["route_id", "month"], ["_ordinal"], seen=seen).write.parquet(f"{tmp_path}/b")
    assert seen.get == {"extra": 2} and spark.read.parquet(f"{tmp_path}/b").count() == 5
    # an empty table, and a load that fails, leave nothing behind
    empty = sinks.load_tables(spark, {"routes": routes.where("mode = 'none'")}, str(tmp_path / "e"), order)
    assert sum(r.violations for r in empty.collect()) == 0 and spark.read.parquet(f"{tmp_path}/e/routes").count() == 0
    with pytest.raises(load.ForeignKeyError):
        sinks.load_tables(spark, {"routes": routes.where("route_id = 'a'"), "otp_monthly": df}, str(tmp_path / "a"), order)
    assert spark.read.parquet(f"{tmp_path}/a/otp_monthly").count() == 2 and sorted(p.name for p in (tmp_path / "a").iterdir()) == ["otp_monthly", "routes"]
