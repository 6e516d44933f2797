"""Source files to the stored tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineside.functions.columns import (
    LABEL_OVERRIDES, RAIL_CODES, entity_id, entity_name, lookup, mercator_lat, mercator_lon, month_from_header, month_from_key,
)
from lineside.operators.load import dominant_row, first_per_key
from lineside.operators.spatial import distinct_points, match_segments


def otp_long(wide: DataFrame, label: str = "Route", overrides: Mapping[str, str] = LABEL_OVERRIDES) -> DataFrame:
    """Wide period columns to one row per route and month; cells that hold no number are dropped."""
    months = [c for c in wide.columns if c != label]
    typed = wide.select(label, *[F.expr(f"try_cast(nullif(cast(`{c}` as string), '') as double)").alias(c) for c in months])
    return typed.unpivot([label], months, "month_raw", "otp").where(F.col("otp").isNotNull()).select(
        entity_id(F.col(label), overrides).alias("route_id"), month_from_header(F.col("month_raw")).alias("month"), "otp")


def routes_table(wide: DataFrame, system: DataFrame, order: Column | str, label: str = "Route",
                 overrides: Mapping[str, str] = LABEL_OVERRIDES) -> DataFrame:
    """Routes of the value file and of the system file, merged on the id.

    The name of the value file's label wins over the system file's; a route the system file does
    not know gets the mode UNKNOWN. ``order`` decides which system row of a route counts.
    """
    labels = wide.select(label).distinct()
    named = labels.select(entity_id(F.col(label), overrides).alias("route_id"), entity_name(F.col(label)).alias("label_name"))
    known = first_per_key(
        system.select(F.col("routes").cast("string").alias("route_id"), "route_name", "mode",
                      (F.col(order) if isinstance(order, str) else order).alias("_o")), ["route_id"], ["_o"])
    return named.join(known, "route_id", "full").select(
        "route_id", F.coalesce("label_name", "route_name").alias("route_name"), F.coalesce("mode", F.lit("UNKNOWN")).alias("mode"))


def stops_table(raw: DataFrame, order: str) -> DataFrame:
    """One row per physical stop, the first in file order."""
    picked = raw.select("stop_id", "stop_code", "stop_name", F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"),
                        "county", "muni", "hood", F.col(order).alias("_o"))
    return first_per_key(picked, ["stop_id"], ["_o"]).drop("_o")


def route_stops_table(raw: DataFrame, order: str, aggregate_label: str = "All Routes") -> DataFrame:
    """Bridge rows without the file's own aggregate rows, first per (route, stop, direction)."""
    keep = raw.where(F.col("route_filter") != aggregate_label).select(
        F.col("routes").alias("route_id"), "stop_id", "direction", "trips_wd", "trips_sa", "trips_su", "trips_7d", "svc_days",
        F.col(order).alias("_o"))
    return first_per_key(keep, ["route_id", "stop_id", "direction"], ["_o"]).drop("_o")


def stop_reference_table(raw: DataFrame) -> DataFrame:
    return raw.select(
        "stop_id", "stop_code", "stop_name", "stop_source", "public_stop", F.col("hastus_lat").alias("lat"),
        F.col("hastus_lon").alias("lon"), "mode", "first_served", "last_served", "county", "muni", "hood")


def ridership_table(raw: DataFrame) -> DataFrame:
    """All-text ridership rows typed and keyed by month."""
    return raw.select(
        F.col("route").cast("string").alias("route_id"), F.substring("month_start", 1, 7).alias("month"), "day_type",
        F.expr("try_cast(nullif(avg_riders, '') as double)").alias("avg_riders"),
        F.expr("try_cast(nullif(day_count, '') as bigint)").alias("day_count"),
        F.col("route_full_name").alias("route_name"), "current_garage", "mode")


def schedule_table(raw: DataFrame, codes: Mapping[str, str] = RAIL_CODES) -> DataFrame:
    """Schedule rows per route, month and day type; of two schedule periods the one with more trips stays."""
    rows = raw.select(
        lookup(F.col("RouteCode"), codes, F.col("RouteCode")).alias("route_id"), month_from_key(F.col("dateKey")).alias("month"),
        F.col("`Day.Type.Join`").alias("day_type"), F.col("`Daily.Trip.Count`").alias("daily_trips"),
        F.col("`Daily.Trip.Dist`").alias("daily_trip_dist"), F.col("PickID").cast("string").alias("pick_id"),
        F.col("Current_Garage").alias("garage"), F.col("Mode").alias("mode"))
    return dominant_row(rows, ["route_id", "month", "day_type"], "daily_trips", "pick_id")


def periods_table(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("pickID").cast("string").alias("pick_id"), F.col("pickStart").alias("start_date"), F.col("pickEnd").alias("end_date"))


def road_segments(features: DataFrame) -> DataFrame:
    """Road features with a positive count and a geometry: id, count, truck share, length, points.

    The parts of a line are strung together in order, so the gap between two parts counts as
    part of the line when points are added along it.
    """
    a = F.col("attributes")
    ready = features.where((a["CUR_AADT"] > 0) & (F.size("geometry.paths") > 0))
    points = F.transform(F.flatten("geometry.paths"), lambda p: F.struct(
        mercator_lat(p[1]).alias("lat"), mercator_lon(p[0]).alias("lon")))
    return ready.select(
        a["OBJECTID"].alias("object_id"), a["CUR_AADT"].alias("count"), a["TRK_PCT"].alias("truck_pct"),
        F.coalesce(a["SEG_LNGTH_FEET"], F.lit(0.0)).alias("length_ft"), points.alias("points"))


def route_points(trips: DataFrame, shapes: DataFrame, trip_order: str = "route_id") -> DataFrame:
    """Points of each route from its shapes; a shape belongs to the first route that uses it."""
    owner = first_per_key(trips.select("shape_id", "route_id"), ["shape_id"], [trip_order])
    rows = shapes.join(owner, "shape_id").select(
        "route_id", F.col("shape_pt_lat").cast("double").alias("lat"), F.col("shape_pt_lon").cast("double").alias("lon"),
        F.struct("shape_id", F.col("shape_pt_sequence").cast("bigint")).alias("_o"))
    return distinct_points(rows, "route_id", "_o")


def route_traffic(features: DataFrame, trips: DataFrame, shapes: DataFrame, radius: float = 30.0, spacing: float = 15.0) -> DataFrame:
    """Traffic table: road segments within ``radius`` metres of each route's points, summed up per route."""
    return match_segments(route_points(trips, shapes), road_segments(features), "route_id", "object_id", radius, spacing)


def entity_findings(tables: Mapping[str, DataFrame], entities: list[str], patterns: list[str], mode: str) -> DataFrame:
    """Every row in which the entities show up: source, finding and the row's own words.

    ``tables`` has routes, otp_monthly, route_stops, stops and stop_reference; each is read once, and a row that meets several
    tests is given for each.
    """
    def text_match(column: str) -> Column:
        found = F.lit(False)
        for p in patterns:
            found = found | F.lower(column).contains(p.lower())
        return found

    def extract(source: str, detail: Column, **tests: Column) -> DataFrame:
        names = F.array_compact(F.array(*(F.when(test, finding.replace("_", " ")) for finding, test in tests.items())))
        return tables[source].select(F.lit(source).alias("source"), F.explode(names).alias("finding"), detail.alias("detail"))

    named = F.col("route_id").isin(*entities)
    return reduce(DataFrame.unionByName, [
        extract("routes", F.concat_ws("|", "route_id", "route_name", "mode"), id_or_mode=named | (F.col("mode") == mode)),
        extract("otp_monthly", F.concat_ws("|", "route_id", "month"), rows=named, positive_values=named & (F.col("otp") > 0)),
        extract("route_stops", F.concat_ws("|", "route_id", "stop_id"), rows=named),
        extract("stops", F.col("stop_name"), name_match=text_match("stop_name")),
        extract("stop_reference", F.col("stop_name"), mode_or_name_match=(F.col("mode") == mode) | text_match("stop_name"))])


def entity_audit(tables: Mapping[str, DataFrame], entities: list[str], patterns: list[str], mode: str) -> DataFrame:
    """Where the entities show up: rows found per table and test, one report row each.

    ``tables`` has routes, otp_monthly, route_stops, stops and stop_reference.
    """
    def text_match(column: str) -> Column:
        found = F.lit(False)
        for p in patterns:
            found = found | F.lower(column).contains(p.lower())
        return found

    def report(source: str, finding: str, where: Column, detail: Column) -> DataFrame:
        return tables[source].where(where).agg(F.count(F.lit(1)).alias("n"), F.min(detail).alias("detail")).select(
            F.lit(source).alias("source"), F.lit(finding).alias("finding"), "n", "detail")

    named = F.col("route_id").isin(*entities)
    lines = [
        report("routes", "id or mode", named | (F.col("mode") == mode), F.concat_ws("|", "route_id", "route_name", "mode")),
        report("otp_monthly", "rows", named, F.concat_ws("|", "route_id", "month")),
        report("otp_monthly", "positive values", named & (F.col("otp") > 0), F.concat_ws("|", "route_id", "month")),
        report("route_stops", "rows", named, F.concat_ws("|", "route_id", "stop_id")),
        report("stops", "name match", text_match("stop_name"), F.col("stop_name")),
        report("stop_reference", "mode or name match", (F.col("mode") == mode) | text_match("stop_name"), F.col("stop_name"))]
    out = lines[0]
    for line in lines[1:]:
        out = out.unionByName(line)
    return out
