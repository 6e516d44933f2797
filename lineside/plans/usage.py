"""Stop-level boardings: consolidation, shelters, change between periods, concentration, flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineside.functions.columns import distance_zone, gap, haversine, stable
from lineside.operators.association import correlate, mann_whitney
from lineside.operators.broadcasts import attach_row
from lineside.operators.load import first_per_key
from lineside.operators.order import gini, medians, with_positions
from lineside.operators.spatial import nearest_neighbour
from lineside.plans.common import route_average, stop_counts

# Labels of the usage source, and the centre the distance zones are drawn around.
BEFORE, WEEKDAY, NO_SHELTER = "Pre-pandemic", "Weekday", "No Shelter"
CENTRE = (40.4406, -79.9959)


def before_weekdays(usage: DataFrame) -> DataFrame:
    return usage.where((F.col("time_period") == BEFORE) & (F.col("serviceday") == WEEKDAY))


def stop_route_usage(usage: DataFrame) -> DataFrame:
    """Mean boardings per stop and route over the earlier period's weekdays.

    Attributes come from the earliest date key and, on that date, from the row of least attributes,
    so they do not depend on row order.
    """
    places = ("latitude", "longitude", "stop_name", "direction", "mode")

    def first(column: str, name: str):
        # a date may have several rows (one per direction): the attributes themselves decide
        return F.min_by(column, F.struct("datekey", *places)).alias(name)

    out = before_weekdays(usage).groupBy("stop_id", "route_name").agg(
        F.avg("avg_ons").alias("avg_ons"), F.avg("avg_offs").alias("avg_offs"), first("latitude", "lat"),
        first("longitude", "lon"), first("stop_name", "stop_name"), first("direction", "direction"), first("mode", "mode"))
    return out.withColumn("avg_daily_usage", F.col("avg_ons") + F.col("avg_offs"))


def consolidation_candidates(per_route: DataFrame, low: float = 5.0, walk_m: float = 400.0) -> DataFrame:
    """Low-usage stops with another stop of the same route within walking distance."""
    out = nearest_neighbour(per_route, "route_name", "stop_id", keep=["avg_daily_usage"]).where("route_name IS NOT NULL AND stop_id IS NOT NULL")
    out = out.withColumn("low_usage", F.col("avg_daily_usage") < low)
    close = F.coalesce(F.col("nearest_neighbor_m") <= walk_m, F.lit(False))
    return out.withColumn("candidate", F.col("low_usage") & close)


def consolidation_summary(candidates: DataFrame, otp: DataFrame, routes: DataFrame, route_stops: DataFrame) -> DataFrame:
    """Candidates per route with the gain projected from the bus slope of value on stop count.

    ``projected_stops`` may be negative when the two sources disagree on the stops of a route.
    """
    averages = route_average(otp, routes).drop("route_name").join(stop_counts(route_stops), "route_id", "left").withColumn(
        "stop_count", F.coalesce("stop_count", F.lit(0)))
    slope = averages.where(F.col("mode") == "BUS").agg(F.regr_slope("avg_otp", "stop_count").alias("_slope"))
    per_route = candidates.groupBy("route_name").agg(
        F.count_if("candidate").alias("n_candidates"), F.count(F.lit(1)).alias("n_stops_csv"))
    out = per_route.join(averages, F.col("route_name") == F.col("route_id")).drop("route_name")
    return attach_row(out, slope).select(
        "route_id", "mode", "n_candidates", "n_stops_csv", "stop_count",
        (F.col("stop_count") - F.col("n_candidates")).alias("projected_stops"),
        (-F.col("_slope") * F.col("n_candidates")).alias("est_otp_gain"))


def stop_shelters(usage: DataFrame) -> DataFrame:
    """Usage per physical stop with its shelter: averaged over dates, added up over routes."""
    dated = first_per_key(
        before_weekdays(usage).select("stop_id", "route_name", "datekey", "avg_ons", "avg_offs", "stop_name", "shelter", "mode", "direction"),
        ["stop_id", "route_name", "datekey"], ["direction", "avg_ons", "avg_offs"])
    per_route = dated.groupBy("stop_id", "route_name").agg(
        F.avg("avg_ons").alias("avg_ons"), F.avg("avg_offs").alias("avg_offs"), F.min_by("stop_name", "datekey").alias("stop_name"),
        F.min_by("shelter", "datekey").alias("shelter"), F.min_by("mode", "datekey").alias("mode"))
    out = per_route.groupBy("stop_id").agg(
        F.sum("avg_ons").alias("avg_ons"), F.sum("avg_offs").alias("avg_offs"), F.min_by("stop_name", "route_name").alias("stop_name"),
        F.min_by("shelter", "route_name").alias("shelter"), F.min_by("mode", "route_name").alias("mode"))
    return out.withColumns({
        "avg_daily_usage": F.col("avg_ons") + F.col("avg_offs"),
        "has_shelter": F.coalesce(F.col("shelter") != NO_SHELTER, F.lit(False))})


def shelter_summary(stops: DataFrame) -> DataFrame:
    """Coverage, usage by shelter state, share of ridership, and the one-sided rank test: one row."""
    cut = stops.withColumn("avg_daily_usage", stable(F.col("avg_daily_usage")))
    has, use = F.col("has_shelter"), F.col("avg_daily_usage")
    out = cut.agg(
        F.count(F.lit(1)).alias("n_stops"), F.count_if(has).alias("n_sheltered"),
        (F.count_if(has) * 100.0 / F.count(F.lit(1))).alias("pct_sheltered"),
        F.avg(F.when(has, use)).alias("sheltered_mean_usage"), F.avg(F.when(~has, use)).alias("unsheltered_mean_usage"),
        F.try_divide(F.sum(F.when(has, use)) * 100, F.nullif(F.sum(use), F.lit(0.0))).alias("sheltered_ridership_share"))
    middle = medians(cut, "avg_daily_usage", ["has_shelter"], "m").agg(
        F.max(F.when(has, F.col("m"))).alias("sheltered_median_usage"), F.max(F.when(~has, F.col("m"))).alias("unsheltered_median_usage"))
    test = mann_whitney(cut, "avg_daily_usage", has, ~has, "greater").select(
        F.col("u").alias("mannwhitney_u"), F.col("p").alias("mannwhitney_p"))
    return attach_row(attach_row(out, middle), test)


def shelter_by_mode(stops: DataFrame) -> DataFrame:
    return stops.where(F.col("mode").isNotNull()).groupBy("mode").agg(
        F.count(F.lit(1)).alias("n_stops"), F.count_if("has_shelter").alias("n_sheltered"),
        F.avg("avg_daily_usage").alias("mean_usage"),
        (F.count_if("has_shelter") * 100.0 / F.count(F.lit(1))).alias("pct_sheltered"))


def shelter_by_owner(stops: DataFrame) -> DataFrame:
    return stops.where("has_shelter").groupBy("shelter").agg(
        F.count(F.lit(1)).alias("n_stops"), F.sum("avg_daily_usage").alias("total_usage"), F.avg("avg_daily_usage").alias("mean_usage"))


def shelter_priority(stops: DataFrame, k: int = 20) -> DataFrame:
    """The k busiest stops without a shelter."""
    cut = stops.where(~F.col("has_shelter")).withColumn("avg_daily_usage", stable(F.col("avg_daily_usage")))
    return cut.orderBy(F.col("avg_daily_usage").desc(), "stop_id").limit(k).select("stop_id", "stop_name", "mode", "avg_daily_usage")


def usage_change(usage: DataFrame, centre: tuple[float, float] = CENTRE) -> DataFrame:
    """Weekday usage per stop before and after, with change, distance to the centre and zone."""
    rows = usage.where(F.col("serviceday") == WEEKDAY).withColumn(
        "period", F.when(F.col("time_period") == BEFORE, "pre").otherwise("post"))
    dated = rows.groupBy("stop_id", "period", "datekey").agg(
        F.sum("avg_ons").alias("ons"), F.sum("avg_offs").alias("offs"),
        F.min_by(F.struct("stop_name", "latitude", "longitude", "mode"), F.struct("route_name")).alias("s"))
    parts = dated.groupBy("stop_id", "period").agg(
        (F.avg("ons") + F.avg("offs")).alias("u"), F.min_by("s", "datekey").alias("s"))
    wide = parts.groupBy("stop_id").agg(
        F.max(F.when(F.col("period") == "pre", F.col("u"))).alias("pre_usage"),
        F.max(F.when(F.col("period") == "post", F.col("u"))).alias("post_usage"),
        F.min_by("s", F.when(F.col("period") == "pre", F.lit(0))).alias("s"))
    wide = wide.where(F.col("pre_usage").isNotNull() & F.col("post_usage").isNotNull()).select(
        "stop_id", "s.stop_name", F.col("s.latitude").alias("lat"), F.col("s.longitude").alias("lon"), "s.mode", "pre_usage", "post_usage")
    change = F.col("post_usage") - F.col("pre_usage")
    km = haversine(F.col("lat"), F.col("lon"), F.lit(centre[0]), F.lit(centre[1]))
    return wide.withColumns({
        "abs_change": change, "pct_change": F.when(F.col("pre_usage") > 0, F.try_divide(change * 100, F.col("pre_usage"))),
        "dist_from_dt_km": km, "zone": distance_zone(km)})


def change_by(changes: DataFrame, group: str) -> DataFrame:
    """Totals, aggregate change of the totals, and the median stop change per group."""
    out = changes.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_stops"), F.sum("pre_usage").alias("total_pre"), F.sum("post_usage").alias("total_post"),
        F.try_divide((F.sum("post_usage") - F.sum("pre_usage")) * 100, F.nullif(F.sum("pre_usage"), F.lit(0.0))).alias("agg_pct_change"))
    middle = medians(changes.withColumn("v", stable(F.col("pct_change"))), "v", [group], "median_pct_change")
    return out.join(middle, group, "left")


def pareto_curve(per_route: DataFrame) -> DataFrame:
    """Stops from the busiest down with their cumulative share of stops and of ridership."""
    stops = per_route.groupBy("stop_id").agg(
        stable(F.sum("avg_daily_usage")).alias("avg_daily_usage"), F.min_by("stop_name", "route_name").alias("stop_name"))
    placed = with_positions(stops, "avg_daily_usage", "stop_id", descending=True, weight="avg_daily_usage")
    return placed.select(
        "stop_id", "stop_name", "avg_daily_usage", (F.col("position") * 100.0 / F.col("total")).alias("pct_stops"),
        F.try_divide(F.col("cum_weight") * 100, F.nullif(F.col("total_weight"), F.lit(0.0))).alias("cum_pct_ridership"))


def pareto_crossings(curve: DataFrame, targets: tuple[int, ...] = (50, 80, 90)) -> DataFrame:
    """Smallest share of stops that carries at least each target share of ridership."""
    reached = stable(F.col("cum_pct_ridership"))
    found = curve.agg(*[F.min(F.when(reached >= t, F.col("pct_stops"))).alias(str(t)) for t in targets])
    return found.unpivot([], [str(t) for t in targets], "target", "pct_stops").select(F.col("target").cast("int").alias("target"), "pct_stops")


def route_gini(per_route: DataFrame, min_stops: int = 3) -> DataFrame:
    out = gini(per_route.withColumn("v", stable(F.col("avg_daily_usage"))), "v", ["route_name"])
    return out.where(F.col("n_values") >= min_stops).select(
        "route_name", "gini", F.col("n_values").alias("n_stops"), F.col("total_value").alias("total_usage"),
        F.col("max_value").alias("max_stop_usage"))


def system_gini(per_route: DataFrame) -> DataFrame:
    stops = per_route.groupBy("stop_id").agg(stable(F.sum("avg_daily_usage")).alias("v"))
    return gini(stops, "v").select("gini", F.col("n_values").alias("n_stops"), F.col("total_value").alias("total_usage"))


def gini_correlation(ginis: DataFrame, otp: DataFrame, routes: DataFrame) -> DataFrame:
    averages = route_average(otp, routes).drop("route_name")
    rows = ginis.join(averages, F.col("route_name") == F.col("route_id")).select("gini", "avg_otp")
    return correlate(rows, "gini", "avg_otp")


def boarding_flows(per_route: DataFrame) -> DataFrame:
    """Net flow, class and on/off ratio per physical stop."""
    out = per_route.groupBy("stop_id").agg(
        F.sum("avg_ons").alias("avg_ons"), F.sum("avg_offs").alias("avg_offs"),
        F.min_by("stop_name", "route_name").alias("stop_name"), F.min_by("mode", "route_name").alias("mode"))
    net = gap(F.col("avg_ons"), F.col("avg_offs"))
    return out.withColumns({
        "net_flow": net, "total_usage": F.col("avg_ons") + F.col("avg_offs"),
        "flow_type": F.when(net > 0, "Generator").when(net < 0, "Attractor").otherwise("Balanced"),
        "on_off_ratio": F.when(F.col("avg_offs") > 0, F.try_divide("avg_ons", "avg_offs"))})


def flow_classes(flows: DataFrame, strong: float = 1.5, weak: float = 0.67) -> DataFrame:
    """Number of stops per class, and how many lean strongly either way among those with a ratio."""
    ratio = F.col("on_off_ratio")
    return flows.groupBy("flow_type").agg(
        F.count(F.lit(1)).alias("n_stops"), F.count(ratio).alias("n_with_ratio"),
        F.count_if(ratio > strong).alias("n_strong_generators"), F.count_if(ratio < weak).alias("n_strong_attractors"))


def direction_flows(usage: DataFrame) -> DataFrame:
    out = before_weekdays(usage).where(F.col("direction").isNotNull()).groupBy("direction").agg(
        F.sum("avg_ons").alias("total_ons"), F.sum("avg_offs").alias("total_offs"), F.count(F.lit(1)).alias("n_records"))
    return out.withColumns({
        "net_flow": F.col("total_ons") - F.col("total_offs"),
        "on_off_ratio": F.when(F.col("total_offs") > 0, F.try_divide("total_ons", "total_offs"))})
