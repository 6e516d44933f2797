"""Analyses by place: neighbourhoods, municipalities, stops, directions, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineside.functions.columns import known_place, ladder, stable, weighted_mean
from lineside.operators import series
from lineside.operators.association import correlate, partial_correlation, pearson_test, welch_t
from lineside.operators.broadcasts import attach_row
from lineside.operators.load import both_ends
from lineside.operators.order import medians, with_average_ranks
from lineside.operators.spatial import group_span, longest_variant
from lineside.operators.strata import all_and_bus
from lineside.plans.common import route_average, stop_counts
from lineside.plans.routes import bounded_bucket
from lineside.session import settle, spread


def _hood_rows(otp: DataFrame, route_stops: DataFrame, stops: DataFrame, min_months: int) -> DataFrame:
    """Route-stop rows in a known neighbourhood with the route's mean value."""
    means = otp.groupBy("route_id").agg(F.avg("otp").alias("avg_otp"), F.count(F.lit(1)).alias("m"))
    places = stops.where(known_place(F.col("hood"))).select("stop_id", "hood", "muni", "county")
    served = route_stops.where(F.col("trips_7d").isNotNull()).select("route_id", "stop_id", "trips_7d")
    return spread(served.join(means.where(F.col("m") >= min_months).drop("m"), "route_id"), "stop_id").join(places, "stop_id")


def area_equity(otp: DataFrame, routes: DataFrame, route_stops: DataFrame, stops: DataFrame, min_months: int = 12) -> DataFrame:
    """Per neighbourhood: trip-weighted and per-route mean, their gap, counts, and the bus-only value.

    Rows are first added up per (area, route), since the value is one number per route. That
    leaves one row per area and route for everything that follows.
    """
    keys = ["hood", "muni", "county"]
    rows = _hood_rows(otp, route_stops, stops, min_months)
    visits = rows.groupBy(*keys, "route_id").agg(F.sum("trips_7d").alias("w"), F.max("avg_otp").alias("v"))
    visits = visits.join(routes.select("route_id", "mode"), "route_id", "left")
    bus = F.col("mode") == "BUS"
    areas = visits.groupBy(*keys).agg(
        weighted_mean(F.col("v"), F.col("w")).alias("weighted_otp"), F.count("route_id").alias("route_count"),
        F.sum("w").alias("total_trips_7d"),
        weighted_mean(F.when(bus, F.col("v")), F.when(bus, F.col("w"))).alias("bus_weighted_otp"),
        F.count_if(bus).alias("bus_route_count"))
    stop_count = rows.select(*keys, "stop_id").distinct().groupBy(*keys).agg(F.count("stop_id").alias("stop_count"))
    plain = visits.groupBy("hood", "route_id").agg(F.max("v").alias("v")).groupBy("hood").agg(F.avg("v").alias("unweighted_otp"))
    out = areas.join(stop_count, keys).join(plain, "hood", "left")
    return out.withColumn("otp_gap", F.col("weighted_otp") - F.col("unweighted_otp"))


def area_rank_shift(areas: DataFrame) -> DataFrame:
    """Rank of each area by the weighted and by the bus-only value, and the shift between the two."""
    known = areas.where(F.col("bus_weighted_otp").isNotNull()).select(
        "hood", "muni", "county", stable(F.col("weighted_otp")).alias("weighted_otp"),
        stable(F.col("bus_weighted_otp")).alias("bus_weighted_otp"))
    names = {"rank_all": "weighted_otp", "rank_bus": "bus_weighted_otp"}
    ranked = with_average_ranks(known, names, descending=list(names))
    return ranked.withColumn("rank_shift", F.abs(F.col("rank_all") - F.col("rank_bus")))


def area_extremes(areas: DataFrame, k: int = 10) -> DataFrame:
    """The k best and k worst areas."""
    named = areas.select(F.concat_ws("|", "hood", "muni", "county").alias("area"), stable(F.col("weighted_otp")).alias("weighted_otp"))
    return both_ends(named, "weighted_otp", "area", k)


def widest_gaps(areas: DataFrame, k: int = 10) -> DataFrame:
    """The k areas whose weighted and plain values differ most."""
    named = areas.select(F.concat_ws("|", "hood", "muni", "county").alias("area"), stable(F.col("otp_gap")).alias("otp_gap"))
    return named.orderBy(F.abs("otp_gap").desc_nulls_last(), "area").limit(k)


def area_quintile_series(otp: DataFrame, route_stops: DataFrame, stops: DataFrame, min_months: int = 12, window: int = 12,
                         min_rows: int = 6, buckets: int = 5) -> DataFrame:
    """Monthly mean per value quintile of areas; quintiles follow each area's trailing mean.

    Trips are added up per (area, route) before the months are joined, so the join grows with
    routes and months, not with stops.
    """
    places = stops.where(known_place(F.col("hood"))).select("stop_id", "hood")
    weights = route_stops.where(F.col("trips_7d").isNotNull()).join(places, "stop_id").groupBy("hood", "route_id").agg(
        F.sum("trips_7d").alias("w"))
    months = series.entities_with(otp, "route_id", min_months)
    areas = weights.join(months, "route_id").groupBy("hood", "month").agg(
        weighted_mean(F.col("otp"), F.col("w")).alias("weighted_otp"))
    trailing = series.trailing("weighted_otp", series.over_entity("hood", "month"), window, min_rows, include_current=True)
    rows = areas.withColumn("rolling_otp", stable(trailing)).where("rolling_otp IS NOT NULL")
    ranked = with_average_ranks(rows, {"r": "rolling_otp"}, ["month"])
    ranked = series_counts(ranked, "month")
    ranked = ranked.withColumn("quintile", bounded_bucket(F.col("r"), F.col("n"), buckets))
    return ranked.groupBy("quintile", "month").agg(F.avg("weighted_otp").alias("avg_otp"))


def series_counts(df: DataFrame, key: str) -> DataFrame:
    return df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key)


def stop_count_vs_value(otp: DataFrame, routes: DataFrame, route_stops: DataFrame, min_months: int = 12) -> DataFrame:
    return route_average(otp, routes, min_months).join(stop_counts(route_stops), "route_id")


def frequency_vs_value(otp: DataFrame, routes: DataFrame, route_stops: DataFrame, min_months: int = 12) -> DataFrame:
    peak = route_stops.groupBy("route_id").agg(F.max("trips_wd").alias("max_trips_wd"))
    return route_average(otp, routes, min_months).join(peak.where("max_trips_wd IS NOT NULL"), "route_id")


def stratum_correlation(rows: DataFrame, x: str, y: str = "avg_otp") -> DataFrame:
    """Pearson and Spearman of x and y over all routes and over buses."""
    return correlate(all_and_bus(rows), x, y, ["stratum"])


def stop_hotspots(otp: DataFrame, routes: DataFrame, route_stops: DataFrame, stops: DataFrame, min_months: int = 12) -> DataFrame:
    """Value each stop inherits from its routes, weighted by trips, with the modes serving it."""
    rows = route_stops.select("route_id", "stop_id", "trips_7d").join(route_average(otp, routes, min_months), "route_id")
    per_stop = rows.groupBy("stop_id").agg(
        weighted_mean(F.col("avg_otp"), F.col("trips_7d")).alias("weighted_otp"),
        F.count_distinct("route_id").alias("route_count"), F.sum("trips_7d").alias("total_trips_7d"),
        F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"))  # a handful of modes
    per_stop = per_stop.where(F.col("weighted_otp").isNotNull())
    return per_stop.join(stops.select("stop_id", "lat", "lon", "hood", "muni"), "stop_id")


def route_polylines(trips: DataFrame, shapes: DataFrame) -> DataFrame:
    """Per route its longest shape variant, with the ordered points of that shape."""
    points = trips.select("route_id", "shape_id").distinct().join(shapes, "shape_id")
    best = longest_variant(points, "route_id", "shape_id")
    return points.join(best, ["route_id", "shape_id"])


def directional_asymmetry(otp: DataFrame, routes: DataFrame, route_stops: DataFrame, min_months: int = 12) -> DataFrame:
    """Imbalance of inbound and outbound peak trips; stops marked both ways count for both."""
    served = route_stops.where(F.col("trips_wd").isNotNull())

    def side(name: str, column: str) -> DataFrame:
        return served.where(F.col("direction").isin(name, "IB,OB")).select("route_id", F.lit(column).alias("side"), "trips_wd")

    wide = side("IB", "ib_trips_wd").unionByName(side("OB", "ob_trips_wd")).groupBy("route_id").pivot(
        "side", ["ib_trips_wd", "ob_trips_wd"]).agg(F.max("trips_wd"))
    wide = wide.dropna(subset=["ib_trips_wd", "ob_trips_wd"]).withColumn("total_trips", F.col("ib_trips_wd") + F.col("ob_trips_wd"))
    wide = wide.where(F.col("total_trips") > 0).withColumn(
        "asymmetry_index", F.abs(F.col("ib_trips_wd") - F.col("ob_trips_wd")) / F.col("total_trips"))
    return wide.join(route_average(otp, routes, min_months), "route_id")


def route_spans(route_stops: DataFrame, stops: DataFrame) -> DataFrame:
    """Span in km of each route's stops."""
    located = route_stops.select("route_id", "stop_id").distinct().join(stops.select("stop_id", "lat", "lon"), "stop_id")
    return group_span(located, "route_id")


def geographic_span(otp: DataFrame, routes: DataFrame, route_stops: DataFrame, spans: DataFrame, min_months: int = 12) -> DataFrame:
    rows = stop_count_vs_value(otp, routes, route_stops, min_months).join(spans, "route_id")
    return rows.withColumn("stop_density", F.when(F.col("span_km") > 0, F.try_divide("stop_count", "span_km")))


def span_correlations(rows: DataFrame) -> DataFrame:
    """Every correlation of the span analysis, one row each: (measure, n, r, p)."""
    bus = rows.where(F.col("mode") == "BUS")

    def plain(name: str, frame: DataFrame, x: str, y: str) -> DataFrame:
        return pearson_test(frame, x, y).select(F.lit(name).alias("measure"), "n", F.col("pearson_r").alias("r"), F.col("pearson_p").alias("p"))

    def part(name: str, x: str, given: str) -> DataFrame:
        return partial_correlation(bus, x, "avg_otp", given).select(
            F.lit(name).alias("measure"), "n", F.col("partial_r").alias("r"), F.col("partial_p").alias("p"))

    rho = correlate(bus, "span_km", "avg_otp").select(
        F.lit("bus_span_rank").alias("measure"), "n", F.col("spearman_r").alias("r"), F.col("spearman_p").alias("p"))
    out = plain("bus_span", bus, "span_km", "avg_otp")
    for more in (rho, plain("all_span", rows, "span_km", "avg_otp"), plain("bus_density", bus, "stop_density", "avg_otp"),
                 part("span_given_stops", "span_km", "stop_count"), part("stops_given_span", "stop_count", "span_km"),
                 plain("span_and_stops", bus, "span_km", "stop_count")):
        out = out.unionByName(more)
    return out


def municipal_equity(otp: DataFrame, route_stops: DataFrame, stops: DataFrame, min_stops: int = 10) -> DataFrame:
    """Weekday-trip-weighted value per municipality with at least ``min_stops`` stops.

    The route means are taken before the join, instead of averaging a stops-times-months join.
    Rows that repeat a (stop, route, trips) combination count once.
    """
    means = otp.groupBy("route_id").agg(F.avg("otp").alias("v"))
    places = stops.where(F.col("muni").isNotNull() & (F.col("muni") != "0")).select("stop_id", "muni", "county")
    rows = _distinct_visits(route_stops, means).join(places, "stop_id")
    value = F.col("v") * F.col("trips_wd")
    # stops are counted by their own rows and routes by theirs, so no row is laid out once for each count
    at_stop = rows.groupBy("muni", "county", "stop_id").agg(F.sum(value).alias("vw"), F.sum("trips_wd").alias("w"))
    totals = at_stop.groupBy("muni", "county").agg(
        F.try_divide(F.sum("vw"), F.nullif(F.sum("w").cast("double"), F.lit(0.0))).alias("avg_otp"),
        F.count("stop_id").alias("n_stops"), F.sum("w").alias("total_trips"))
    served = rows.select("muni", "county", "route_id").distinct().groupBy(F.col("muni").alias("_muni"), F.col("county").alias("_county")).agg(
        F.count("route_id").alias("n_routes"))
    same = (F.col("muni") == F.col("_muni")) & F.col("county").eqNullSafe(F.col("_county"))
    return totals.where(F.col("n_stops") >= min_stops).join(served, same).drop("_muni", "_county")


def _distinct_visits(route_stops: DataFrame, means: DataFrame) -> DataFrame:
    """The different (route, stop, weekday trips), by stop, with each row of ``means`` of the route."""
    means = means.groupBy(*means.columns).agg(F.count(F.lit(1)).cast("int").alias("_rows"))
    rows = spread(route_stops.select("route_id", "stop_id", "trips_wd").join(means, "route_id"), "stop_id").distinct()
    return rows.withColumn("_rows", F.explode(F.array_repeat(F.lit(0), F.col("_rows")))).drop("_rows")


def municipal_summary(munis: DataFrame, city: str) -> DataFrame:
    """City against the rest, best, worst and spread, one row."""
    cut = munis.withColumn("avg_otp", stable(F.col("avg_otp")))
    home = F.col("muni") == city
    out = cut.agg(
        F.max(F.when(home, F.col("avg_otp"))).alias("city_otp"), F.avg(F.when(~home, F.col("avg_otp"))).alias("rest_mean_otp"),
        F.count(F.lit(1)).alias("n_munis"),
        F.min_by("muni", F.struct(-F.col("avg_otp"), "muni", "county")).alias("best_muni"), F.max("avg_otp").alias("best_otp"),
        F.min_by("muni", F.struct(F.col("avg_otp"), "muni", "county")).alias("worst_muni"), F.min("avg_otp").alias("worst_otp"))
    out = out.withColumn("spread", F.col("best_otp") - F.col("worst_otp"))
    return attach_row(out, medians(cut.where(~home), "avg_otp", name="rest_median_otp"))


def jurisdiction_rows(otp: DataFrame, routes: DataFrame, route_stops: DataFrame, stops: DataFrame, place: str = "muni") -> DataFrame:
    """Routes classed by whether their stops lie in one place or in several."""
    located = route_stops.select("route_id", "stop_id").distinct().join(stops.select("stop_id", F.col(place).alias("p")), "stop_id")
    counts = located.where(F.col("p").isNotNull() & (F.col("p") != "0")).groupBy("route_id").agg(F.count_distinct("p").alias("n_places"))
    kind = F.when(F.col("n_places") >= 2, "cross-jurisdictional").otherwise("single-municipality")
    return counts.join(route_average(otp, routes, 1), "route_id").withColumn("jurisdiction_type", kind)


def jurisdiction_test(rows: DataFrame) -> DataFrame:
    """Welch's t of the two classes; no t or p unless both hold more than two routes."""
    kind = F.col("jurisdiction_type")
    out = welch_t(rows, "avg_otp", kind == "cross-jurisdictional", kind == "single-municipality")
    enough = (F.col("n1") > 2) & (F.col("n2") > 2)
    return out.select(
        F.col("n1").alias("n_cross"), F.col("n2").alias("n_single"), F.col("mean1").alias("cross_mean_otp"),
        F.col("mean2").alias("single_mean_otp"), F.when(enough, F.col("t")).alias("t"), F.when(enough, F.col("p")).alias("p"))


def transfer_hubs(otp: DataFrame, routes: DataFrame, route_stops: DataFrame, stops: DataFrame) -> DataFrame:
    """Stops by the number of routes meeting there, with the weekday-trip-weighted value."""
    means = route_average(otp, routes, 1).select("route_id", "avg_otp")
    rows = _distinct_visits(route_stops, means)
    return _located_hubs(rows.groupBy("stop_id").agg(
        weighted_mean(F.col("avg_otp"), F.col("trips_wd")).alias("avg_otp"),
        F.count_distinct("route_id").alias("n_routes"), F.sum("trips_wd").alias("total_trips")), stops)


def _located_hubs(out: DataFrame, stops: DataFrame) -> DataFrame:
    out = out.where(F.col("avg_otp").isNotNull()).join(stops.select("stop_id", "stop_name", "lat", "lon", "muni"), "stop_id")
    n = F.col("n_routes")
    return out.withColumn("tier", ladder(n, [(n >= 5, "hub (5+)"), (n >= 2, "medium (2-4)")], "simple (1)"))


def route_connectivity(otp: DataFrame, routes: DataFrame, route_stops: DataFrame, stops: DataFrame) -> DataFrame:
    """Mean number of routes at the stops of each route."""
    means = route_average(otp, routes, 1)
    pairs = route_stops.select("route_id", "stop_id").distinct().join(stops.select("stop_id"), "stop_id", "left_semi").join(
        means.select("route_id"), "route_id", "left_semi")
    meeting = pairs.groupBy("stop_id").agg(F.count("route_id").alias("stop_n_routes"))
    return _with_means(pairs.join(meeting, "stop_id"), means)


def _with_means(pairs: DataFrame, means: DataFrame) -> DataFrame:
    out = pairs.groupBy("route_id").agg(
        F.count("stop_id").alias("n_stops_on_route"), F.avg("stop_n_routes").alias("avg_stop_connectivity"))
    return out.join(means.select("route_id", "mode", "avg_otp"), "route_id")


def hubs_and_connectivity(otp: DataFrame, routes: DataFrame, route_stops: DataFrame, stops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``transfer_hubs`` and ``route_connectivity`` with the facts read once: both are made of one row a stop, with its routes."""
    means = settle(route_average(otp, routes, 1))
    at_stop = _distinct_visits(route_stops, means.select("route_id", "avg_otp")).groupBy("stop_id").agg(
        weighted_mean(F.col("avg_otp"), F.col("trips_wd")).alias("avg_otp"), F.collect_set("route_id").alias("_routes"),
        F.sum("trips_wd").alias("total_trips"))
    at_stop = settle(at_stop.withColumn("n_routes", F.size("_routes").cast("bigint")))
    met = at_stop.join(stops.select("stop_id"), "stop_id", "left_semi").select(
        "stop_id", F.col("n_routes").alias("stop_n_routes"), F.explode("_routes").alias("route_id"))
    return _located_hubs(at_stop.drop("_routes"), stops), _with_means(met, means)


def hub_correlations(hubs: DataFrame, connected: DataFrame) -> DataFrame:
    """Stop-level and route-level connectivity against value."""
    stop_level = correlate(hubs, "n_routes", "avg_otp").withColumn("level", F.lit("stop"))
    route_level = correlate(all_and_bus(connected), "avg_stop_connectivity", "avg_otp", ["stratum"])
    route_level = route_level.withColumn("level", F.concat(F.lit("route_"), F.col("stratum"))).drop("stratum")
    return stop_level.unionByName(route_level)
