"""System-wide series: trend, modes, variants of a route, weighting schemes, seasonality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineside.functions.columns import bus_subtype, gap, month_of_year, stable, weighted_mean, weighted_or_plain_mean
from lineside.operators import series
from lineside.operators.association import mann_whitney, paired_t, wilcoxon_signed_rank
from lineside.operators.broadcasts import attach_row
from lineside.operators.order import quantiles
from lineside.operators.strata import all_and_bus
from lineside.plans.common import stop_visits, weekday_pairs


def system_trend(otp: DataFrame, schedule: DataFrame, route_stops: DataFrame, routes: DataFrame) -> DataFrame:
    """Monthly trip-weighted and plain mean with year-over-year change, for all routes and buses.

    The weight is the month's scheduled weekday trips, else a seventh of the largest weekly trip
    count of the route's stops, else 0.
    """
    weekday = schedule.where(F.col("day_type") == "WEEKDAY").select("route_id", "month", F.col("daily_trips").alias("sched"))
    peak = route_stops.groupBy("route_id").agg((F.max("trips_7d") / F.lit(7.0)).alias("peak"))
    rows = (
        otp.join(weekday, ["route_id", "month"], "left").join(peak, "route_id", "left")
        .join(routes.select("route_id", "mode"), "route_id", "left")
        .withColumn("weight", F.coalesce(F.col("sched").cast("double"), "peak", F.lit(0.0))))
    monthly = all_and_bus(rows).groupBy("stratum", "month").agg(
        weighted_or_plain_mean(F.col("otp"), F.col("weight")).alias("weighted_otp"),
        F.avg("otp").alias("unweighted_otp"), F.count_distinct("route_id").alias("route_count"),
        (F.count("sched") * 100.0 / F.count(F.lit(1))).alias("pct_time_varying"))
    window = series.over_entity("stratum", "month")
    return monthly.withColumn("yoy_change", series.year_over_year("weighted_otp", window))


def _classified(otp: DataFrame, routes: DataFrame) -> DataFrame:
    known = routes.where(F.col("mode") != "UNKNOWN").select("route_id", "mode")
    return otp.join(known, "route_id")


def mode_comparison(otp: DataFrame, routes: DataFrame, route_stops: DataFrame) -> DataFrame:
    """Monthly means per mode (plain and visit-weighted) and per bus subtype, one stacked frame.

    Mode rows have no ``bus_type`` and subtype rows no ``weighted_otp``.
    """
    rows = _classified(otp, routes).join(stop_visits(route_stops), "route_id", "left").withColumn(
        "trips_7d", F.coalesce("trips_7d", F.lit(0)))
    by_mode = rows.groupBy("mode", "month").agg(
        F.avg("otp").alias("avg_otp"),
        weighted_or_plain_mean(F.col("otp"), F.col("trips_7d")).alias("weighted_otp"),
        F.count_distinct("route_id").alias("route_count"))
    buses = rows.where(F.col("mode") == "BUS").withColumn("bus_type", bus_subtype(F.col("route_id")))
    by_type = buses.groupBy("mode", "bus_type", "month").agg(
        F.avg("otp").alias("avg_otp"), F.count_distinct("route_id").alias("route_count"))
    return by_mode.unionByName(by_type, allowMissingColumns=True)


def mode_monthly(otp: DataFrame, routes: DataFrame) -> DataFrame:
    return _classified(otp, routes).groupBy("mode", "month").agg(F.avg("otp").alias("avg_otp"))


def mode_rank_test(otp: DataFrame, routes: DataFrame, first: str = "RAIL", second: str = "BUS") -> DataFrame:
    """Mann-Whitney of two modes' monthly means, with each mode's upper median."""
    monthly = mode_monthly(otp, routes).where(F.col("mode").isin(first, second))
    monthly = monthly.withColumn("avg_otp", stable(F.col("avg_otp")))
    test = mann_whitney(monthly, "avg_otp", F.col("mode") == first, F.col("mode") == second)
    middle = quantiles(monthly, "avg_otp", {"m": 0.5}, ["mode"], method="upper")
    pair = middle.agg(F.max(F.when(F.col("mode") == first, F.col("m"))).alias("first_median"),
                      F.max(F.when(F.col("mode") == second, F.col("m"))).alias("second_median"))
    return attach_row(test, pair)


def mode_gap_trend(otp: DataFrame, routes: DataFrame, first: str = "RAIL", second: str = "BUS") -> DataFrame:
    """Monthly gap between two modes and the straight line through it."""
    def mean(mode: str) -> Column:
        return F.avg(F.when(F.col("mode") == mode, F.col("otp")))

    gaps = _classified(otp, routes).groupBy("month").agg((mean(first) - mean(second)).alias("gap")).where("gap IS NOT NULL")
    gaps = gaps.join(series.period_ordinals(gaps, "month", "x"), "month")
    line = gaps.agg(F.regr_slope("gap", "x").alias("slope"), F.regr_intercept("gap", "x").alias("intercept"))
    return attach_row(gaps, line).select("month", "gap", (F.col("intercept") + F.col("slope") * F.col("x")).alias("trend"))


def paired_variants(otp: DataFrame, routes: DataFrame) -> DataFrame:
    """Months in which a route and its limited (L) or express (X) variant both have a value.

    One equi-join: a variant looks up the route named by its id without the suffix.
    """
    rows = _classified(otp, routes).select("route_id", "month", "otp")
    kind = F.when(F.col("route_id").endswith("L"), "local-vs-limited").when(F.col("route_id").endswith("X"), "local-vs-express")
    variants = rows.select(
        F.regexp_replace("route_id", "[LX]$", "").alias("base_id"), F.col("route_id").alias("variant_id"),
        kind.alias("pair_type"), "month", F.col("otp").alias("otp_variant")).where(F.col("pair_type").isNotNull())
    base = rows.select(F.col("route_id").alias("base_id"), "month", F.col("otp").alias("otp_base"))
    return variants.join(base, ["base_id", "month"]).withColumn("otp_diff", F.col("otp_variant") - F.col("otp_base"))


def variant_tests(pairs: DataFrame) -> DataFrame:
    """Paired t-test over all variant months, with the number of pairs and the mean of pair means."""
    by_pair = pairs.groupBy("base_id", "variant_id").agg(F.avg("otp_diff").alias("m"))
    means = by_pair.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("m").alias("pair_mean_diff"))
    return attach_row(paired_t(pairs, "otp_variant", "otp_base"), means)


def weighting_monthly(otp: DataFrame, ridership: DataFrame, route_stops: DataFrame, min_months: int = 12) -> DataFrame:
    """Monthly value under three weightings: none, stop visits, riders."""
    rows = series.entities_with(weekday_pairs(otp, ridership), "route_id", min_months)
    rows = rows.join(stop_visits(route_stops), "route_id", "left").withColumn("trips_7d", F.coalesce("trips_7d", F.lit(0)))
    return rows.groupBy("month").agg(
        F.avg("otp").alias("unweighted_otp"),
        weighted_or_plain_mean(F.col("otp"), F.col("trips_7d")).alias("trip_weighted_otp"),
        weighted_mean(F.col("otp"), F.col("avg_riders")).alias("ridership_weighted_otp"),
        F.count_distinct("route_id").alias("route_count"), F.sum("avg_riders").alias("total_riders"))


def weighting_summary(monthly: DataFrame) -> DataFrame:
    """Mean, median, spread and range of each weighting's monthly series."""
    names = ["unweighted_otp", "trip_weighted_otp", "ridership_weighted_otp"]
    tall = monthly.select(*[F.col(c).alias(c.removesuffix("_otp")) for c in names]).unpivot(
        [], [c.removesuffix("_otp") for c in names], "weighting", "v")
    return tall.groupBy("weighting").agg(
        F.avg("v").alias("mean"), F.median("v").alias("median"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))


def weighting_tests(monthly: DataFrame) -> DataFrame:
    """Paired t and Wilcoxon tests of the trip-weighted against the ridership-weighted series."""
    monthly = monthly.withColumn("gap", gap(F.col("trip_weighted_otp"), F.col("ridership_weighted_otp")))
    t = paired_t(monthly, "trip_weighted_otp", "ridership_weighted_otp").select(
        (-F.col("mean")).alias("mean_difference"), F.col("t").alias("paired_t_stat"), F.col("p").alias("paired_t_p"),
        F.col("n").alias("n_months"))
    w = wilcoxon_signed_rank(monthly, "gap").select(F.col("statistic").alias("wilcoxon_stat"), F.col("p").alias("wilcoxon_p"))
    return attach_row(t, w)


def balanced_system(otp: DataFrame, route_stops: DataFrame, first: str, last: str) -> DataFrame:
    """Visit-weighted monthly value over routes seen in every month of the year."""
    rows = otp.where(F.col("month").between(first, last)).withColumn("month_num", month_of_year(F.col("month")))
    rows = series.balanced_panel(rows, "route_id", "month_num")
    rows = rows.join(stop_visits(route_stops), "route_id", "left").withColumn("trips_7d", F.coalesce("trips_7d", F.lit(0)))
    return rows.groupBy("month").agg(weighted_or_plain_mean(F.col("otp"), F.col("trips_7d")).alias("weighted_otp"))


def seasonal_profile(system: DataFrame) -> DataFrame:
    """Mean deviation from the centred 12-month trend per month of the year.

    ``system`` holds one row per month, so the trend window is small.
    """
    window = series.over_entity([], "month")
    rows = system.withColumn("trend", series.centred_trend("weighted_otp", window))
    rows = rows.withColumn("detrended", F.col("weighted_otp") - F.col("trend")).where("detrended IS NOT NULL")
    return rows.groupBy(month_of_year(F.col("month")).alias("month_num")).agg(
        F.avg("detrended").alias("deviation"), F.avg("weighted_otp").alias("weighted_otp"))


def _eligible(otp: DataFrame, routes: DataFrame, first: str, last: str, min_years: int) -> DataFrame:
    rows = otp.where(F.col("month").between(first, last)).join(routes.select("route_id", "route_name"), "route_id")
    rows = rows.withColumn("month_num", month_of_year(F.col("month")))
    return series.entities_with(rows, "route_id", min_years * 12, F.count_distinct("month"))


def seasonal_amplitude(otp: DataFrame, routes: DataFrame, first: str, last: str, min_years: int = 3) -> DataFrame:
    """Per route the range of its mean detrended value over months of the year, with best and worst month."""
    rows = _eligible(otp, routes, first, last, min_years)
    trend = series.centred_trend("otp", series.over_entity("route_id", "month"))
    rows = rows.withColumn("detrended", F.col("otp") - trend).where("detrended IS NOT NULL")
    months = rows.groupBy("route_id", "route_name", "month_num").agg(stable(F.avg("detrended")).alias("d"))
    best = F.struct(-F.col("d"), F.col("month_num"))
    worst = F.struct(F.col("d"), F.col("month_num"))
    return months.groupBy("route_id", "route_name").agg(
        (F.max("d") - F.min("d")).alias("seasonal_amplitude"),
        F.min_by("month_num", best).alias("best_month"), F.min_by("month_num", worst).alias("worst_month"))


def seasonal_heatmap(otp: DataFrame, routes: DataFrame, first: str, last: str, min_years: int = 3) -> DataFrame:
    """Mean value per route and month of the year, one column per month."""
    rows = _eligible(otp, routes, first, last, min_years)
    months = [f"m{i:02d}" for i in range(1, 13)]
    named = rows.withColumn("m", F.concat(F.lit("m"), F.lpad(F.col("month_num").cast("string"), 2, "0")))
    return named.groupBy("route_id", "route_name").pivot("m", months).agg(F.avg("otp"))
