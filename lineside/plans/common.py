"""Route-level frames that many analyses start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineside.functions.columns import bus_subtype, indicator


def route_average(otp: DataFrame, routes: DataFrame, min_months: int = 12) -> DataFrame:
    """Mean value and number of months per route, routes with enough months only.

    The months are averaged before the join to the route table.
    """
    means = otp.groupBy("route_id").agg(F.avg("otp").alias("avg_otp"), F.count(F.lit(1)).alias("months"))
    return means.where(F.col("months") >= min_months).join(routes.select("route_id", "route_name", "mode"), "route_id")


def stop_counts(route_stops: DataFrame) -> DataFrame:
    return route_stops.groupBy("route_id").agg(F.count_distinct("stop_id").alias("stop_count"))


def stop_visits(route_stops: DataFrame) -> DataFrame:
    """Weekly trips summed over the stops of a route: a stop-visit weight, not a trip count."""
    return route_stops.groupBy("route_id").agg(F.sum("trips_7d").alias("trips_7d"))


def peak_trips(route_stops: DataFrame) -> DataFrame:
    return route_stops.groupBy("route_id").agg(
        F.max("trips_wd").alias("max_wd"), F.max("trips_sa").alias("max_sa"), F.max("trips_su").alias("max_su"))


def with_weekend_ratio(df: DataFrame) -> DataFrame:
    """(Saturday + Sunday) / (2 * weekday) peak trips; 0 without weekday service."""
    ratio = (F.col("max_sa") + F.col("max_su")) / (2.0 * F.nullif(F.col("max_wd"), F.lit(0)))
    return df.withColumn("weekend_ratio", F.when(F.col("max_wd") > 0, ratio).otherwise(0.0))


def weekday_pairs(otp: DataFrame, ridership: DataFrame) -> DataFrame:
    """Route-months with both a value and weekday ridership."""
    weekday = ridership.where(F.col("day_type") == "WEEKDAY").drop("day_type", "mode")
    return otp.join(weekday, ["route_id", "month"])


def structural_features(averages: DataFrame, route_stops: DataFrame, stops: DataFrame, spans: DataFrame) -> DataFrame:
    """Averages joined with stop count, span, weekend ratio, municipalities and class indicators."""
    located = route_stops.select("route_id", "stop_id").distinct().join(stops.select("stop_id", "muni"), "stop_id")
    munis = located.where(F.col("muni").isNotNull() & (F.col("muni") != "0")).groupBy("route_id").agg(
        F.count_distinct("muni").alias("n_munis"))
    out = averages
    for part in (stop_counts(route_stops), peak_trips(route_stops), munis, spans):
        out = out.join(part, "route_id", "left")
    out = with_weekend_ratio(out)
    premium = (F.col("mode") == "BUS") & bus_subtype(F.col("route_id")).isin("busway", "flyer", "express", "limited")
    out = out.withColumns({"is_rail": indicator(F.col("mode") == "RAIL"), "is_premium_bus": indicator(premium)})
    return out.dropna(subset=["stop_count", "span_km", "weekend_ratio", "n_munis"])
