"""Panel analyses: ridership by day kind, structural models, lead-lag, co-movement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineside.functions.columns import safe_log
from lineside.operators import series
from lineside.operators.association import correlate, pearson_test
from lineside.operators.leadlag import bonferroni, granger
from lineside.operators.regression import fit_models, fit_ols, nested_f, with_residuals
from lineside.operators.similarity import centre_correlations
from lineside.operators.strata import all_and_bus
from lineside.plans.common import route_average, stop_counts, weekday_pairs
from lineside.session import settle

# Features of the structural model, for all routes and for buses.
FEATURES = ["stop_count", "span_km", "is_rail", "weekend_ratio", "n_munis", "is_premium_bus"]
BUS_FEATURES = ["stop_count", "span_km", "weekend_ratio", "n_munis", "is_premium_bus"]
DAY_TYPES = ("WEEKDAY", "SAT.", "SUN.")


def daytype_monthly(ridership: DataFrame, base_month: str = "2019-01") -> DataFrame:
    """Riders per month and day type, and as an index of the base month.

    The base value is the day type's own total in the base month, so it comes from a window over
    one row per month.
    """
    rows = ridership.where(F.col("avg_riders").isNotNull() & F.col("day_count").isNotNull())
    monthly = rows.groupBy("month", "day_type").agg(
        F.sum(F.col("avg_riders") * F.col("day_count")).alias("total_riders"), F.sum("avg_riders").alias("avg_riders_sum"),
        F.count_distinct("route_id").alias("n_routes"))
    base = monthly.where(F.col("month") == base_month).select("day_type", F.col("total_riders").alias("_base"))
    return monthly.join(base, "day_type", "left").withColumn(
        "indexed", F.try_divide(F.col("total_riders") * 100, F.nullif("_base", F.lit(0.0)))).drop("_base")


def weekend_shares(monthly: DataFrame) -> DataFrame:
    """Share of Saturday and Sunday riders per month; a missing day type counts as 0."""
    def total(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("day_type") == kind, F.col("total_riders"))), F.lit(0.0))

    out = monthly.groupBy("month").agg(*[total(k).alias(n) for k, n in zip(DAY_TYPES, ("weekday", "saturday", "sunday"))])
    out = out.withColumn("total", F.col("weekday") + F.col("saturday") + F.col("sunday"))
    whole = F.nullif("total", F.lit(0.0))
    return out.withColumns({
        "weekend_share": F.try_divide(F.col("saturday") + F.col("sunday"), whole),
        "sat_share": F.try_divide("saturday", whole), "sun_share": F.try_divide("sunday", whole)})


def route_weekend_ratio(ridership: DataFrame, min_months: int = 6) -> DataFrame:
    """Mean weekend-to-weekday rider ratio per route over months with all three day types."""
    wide = ridership.where(F.col("avg_riders").isNotNull()).groupBy("route_id", "month").pivot(
        "day_type", list(DAY_TYPES)).agg(F.min("avg_riders"))
    wide = wide.select("route_id", *[F.col(f"`{k}`").alias(n) for k, n in zip(DAY_TYPES, ("wd", "sa", "su"))])
    wide = wide.dropna(subset=["wd", "sa", "su"]).where(F.col("wd") > 0)
    ratio = F.avg((F.col("sa") + F.col("su")) / F.col("wd"))
    return wide.groupBy("route_id").agg(ratio.alias("avg_weekend_ratio"), F.count(F.lit(1)).alias("n_months")).where(
        F.col("n_months") >= min_months)


def weekend_correlation(ratios: DataFrame, otp: DataFrame, min_routes: int = 10) -> DataFrame:
    means = otp.groupBy("route_id").agg(F.avg("otp").alias("avg_otp"))
    return correlate(ratios.join(means, "route_id"), "avg_weekend_ratio", "avg_otp", min_n=min_routes)


def structural_models(rows: DataFrame) -> DataFrame:
    """Full model, model without the span, and bus-only model, from one pass over the routes."""
    reduced = [f for f in FEATURES if f != "span_km"]
    return fit_models(
        all_and_bus(rows), "avg_otp", {"full": FEATURES, "reduced": reduced, "bus_only": BUS_FEATURES}, ["stratum"],
        {"full": "all", "reduced": "all", "bus_only": "bus"})


def added_feature_models(rows: DataFrame, added: Sequence[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Structural models with and without more features, for all routes and buses, with nested F-tests.

    All models are fitted in one pass over the rows that have every added feature. The all-route
    model with the added features alone is fitted too.
    """
    models = {"all_base": FEATURES, f"all_{label}": [*FEATURES, *added], f"{label}_only": list(added),
              "bus_base": BUS_FEATURES, f"bus_{label}": [*BUS_FEATURES, *added]}
    fits = fit_models(all_and_bus(rows), "avg_otp", models, ["stratum"],
                      {m: "bus" if m.startswith("bus_") else "all" for m in models})
    return fits, nested_f(fits, {s: (f"{s}_base", f"{s}_{label}") for s in ("all", "bus")}, "scope")


def ridership_features(otp: DataFrame, ridership: DataFrame, routes: DataFrame, min_months: int = 12) -> DataFrame:
    """Route averages over months paired with weekday ridership, with mean riders and their logarithm."""
    pairs = weekday_pairs(otp, ridership).where(F.col("avg_riders").isNotNull()).select("route_id", "month", "otp")
    averages = route_average(pairs, routes, min_months)
    riders = ridership.where((F.col("day_type") == "WEEKDAY") & F.col("avg_riders").isNotNull()).groupBy("route_id").agg(
        F.avg("avg_riders").alias("avg_riders"))
    return averages.join(riders, "route_id").withColumn("log_riders", safe_log(F.col("avg_riders")))


def partial_residuals(rows: DataFrame, feature: str = "log_riders") -> DataFrame:
    """Slope of the value on ``feature`` after the other features are taken out of both."""
    whole = settle(rows.dropna(subset=[feature]))
    rest_y = with_residuals(whole, fit_ols(whole, "avg_otp", FEATURES), "avg_otp", FEATURES, "y_rest")
    both = with_residuals(rest_y, fit_ols(rest_y, feature, FEATURES), feature, FEATURES, "x_rest")
    return both.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y_rest", "x_rest").alias("slope"),
                    F.regr_intercept("y_rest", "x_rest").alias("intercept"))


def feature_collinearity(rows: DataFrame, feature: str) -> DataFrame:
    """Correlation of one feature with each of the others."""
    tall = rows.select(F.col(feature).alias("x"), *[F.col(f).cast("double").alias(f) for f in FEATURES]).unpivot(
        ["x"], FEATURES, "feature", "value")
    return pearson_test(tall, "x", "value", ["feature"])


def traffic_features(averages: DataFrame, traffic: DataFrame, min_match: float = 0.3) -> DataFrame:
    """Route features joined with the traffic table, for routes matched well enough."""
    rows = averages.join(traffic.where(F.col("match_rate") >= min_match), "route_id")
    return rows.withColumn("log_aadt", safe_log(F.col("weighted_aadt")))


def lead_lag_panel(otp: DataFrame, ridership: DataFrame, min_months: int = 36) -> DataFrame:
    """Paired series with each month's system mean removed from both."""
    pairs = weekday_pairs(otp, ridership).select("route_id", "month", "otp", "avg_riders")
    pairs = series.entities_with(pairs, "route_id", min_months)
    pairs = series.with_group_mean(pairs, "month", {"_otp": "otp", "_riders": "avg_riders"})
    return pairs.select("route_id", "month", (F.col("otp") - F.col("_otp")).alias("otp_dt"),
                        (F.col("avg_riders") - F.col("_riders")).alias("riders_dt"))


def granger_tests(panel: DataFrame, max_lag: int = 6) -> DataFrame:
    """Does the value help predict ridership? Best lag per route with the Bonferroni correction."""
    n_routes = panel.agg(F.count_distinct("route_id").alias("m"))
    return bonferroni(granger(panel, "route_id", "month", "otp_dt", "riders_dt", max_lag), "p_value", n_routes)


def detrended(otp: DataFrame, routes: DataFrame, min_months: int = 36) -> DataFrame:
    """Values with the month's system mean removed, for routes with enough months."""
    rows = series.with_group_mean(otp.join(routes.select("route_id"), "route_id", "left_semi"), "month", {"_system": "otp"})
    rows = rows.withColumn("otp_detrended", F.col("otp") - F.col("_system")).select("route_id", "month", "otp_detrended")
    return series.entities_with(rows, "route_id", min_months)


def co_movement_table(otp: DataFrame, ridership: DataFrame, routes: DataFrame, min_months: int = 36, min_overlap: int = 24) -> DataFrame:
    """Correlation of each route's detrended series with the mean series of every mode and every garage."""
    rows = settle(detrended(otp, routes, min_months))
    modes = routes.select("route_id", F.lit("mode").alias("family"), F.col("mode").alias("centre"))
    garages = ridership.groupBy("route_id").agg(F.min("current_garage").alias("centre")).select("route_id", F.lit("garage").alias("family"), "centre")
    members = modes.unionByName(garages).where("centre IS NOT NULL").join(rows.select("route_id").distinct(), "route_id", "left_semi")
    return centre_correlations(rows, members, "route_id", "month", "otp_detrended", min_overlap)


def cluster_profile(groups: DataFrame, otp: DataFrame, routes: DataFrame, route_stops: DataFrame) -> DataFrame:
    """Members of each group with their mode, mean value and stop count, summed up per group."""
    means = route_average(otp, routes, 1).join(stop_counts(route_stops), "route_id", "left")
    rows = groups.join(means, F.col("node") == F.col("route_id"))
    counts = rows.groupBy("cluster", "mode").agg(F.count(F.lit(1)).alias("c"))
    modal = counts.groupBy("cluster").agg(F.min_by("mode", F.struct(-F.col("c"), F.col("mode"))).alias("main_mode"))
    return rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_routes"), F.avg("avg_otp").alias("mean_otp"), F.avg("stop_count").alias("mean_stops")).join(modal, "cluster")
