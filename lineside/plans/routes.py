"""Route-level analyses: ranking, anomalies, recovery, garages, burden, concentration."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineside.functions.columns import (
    KNOWN_EVENTS, gap, indicator, ladder, lookup, stable, subtype_or_mode, weighted_mean,
)
from lineside.operators import series
from lineside.operators.association import (
    correlate, kruskal_wallis, one_sample_t, pearson_test, sign_quadrants,
)
from lineside.operators.broadcasts import attach_row
from lineside.operators.order import medians, ntile_of, with_average_ranks, with_positions
from lineside.operators.regression import fit_models, nested_f
from lineside.operators.strata import all_and_bus
from lineside.plans.common import peak_trips, route_average, stop_counts, weekday_pairs, with_weekend_ratio
from lineside.session import settle


def entity_ranking(otp: DataFrame, routes: DataFrame, route_stops: DataFrame, slope_from: str = "2022-01",
                   min_months: int = 12, recent_periods: int = 12) -> DataFrame:
    """All-time statistics, recent mean, slope with interval, four ranks and two flags per route."""
    rows = otp.join(routes.select("route_id", "route_name", "mode"), "route_id")
    summary = rows.groupBy("route_id", "route_name", "mode").agg(
        F.count("otp").alias("months"), F.avg("otp").alias("mean_otp"), F.stddev_samp("otp").alias("std_otp"),
        F.min("otp").alias("min_otp"), F.max("otp").alias("max_otp"))
    recent = series.last_periods(rows, "month", recent_periods).groupBy("route_id").agg(
        stable(F.avg("otp")).alias("recent_mean_otp"))
    late = rows.where(F.col("month") >= slope_from)
    late = late.join(series.period_ordinals(late, "month", "t"), "month")
    slopes = series.linear_trend(late, ["route_id"], "t", "otp").withColumnRenamed("n", "slope_months")
    spans = late.groupBy("route_id").agg((F.max("t") - F.min("t") + 1).cast("bigint").alias("obs_span_months"))
    slopes = slopes.where(F.col("slope_months") >= min_months).join(spans, "route_id")
    out = summary.join(recent, "route_id", "left").join(slopes, "route_id", "left")
    out = out.join(stop_counts(route_stops), "route_id", "left")
    out = out.withColumn("limited_data", F.col("months") < min_months)
    out = out.withColumns({"std_otp": stable(F.col("std_otp")), "slope": stable(F.col("slope"))})
    enough = ~F.col("limited_data")
    # written once: the ranks and the typical spread both start from these rows
    ready = settle(out.withColumns({
        "_avg": F.when(enough, F.col("recent_mean_otp")), "_slope": F.when(enough, F.col("slope")),
        "_std": F.when(enough, F.col("std_otp"))}))
    ranked = with_average_ranks(
        ready, {"rank_avg": "_avg", "rank_slope": "_slope", "rank_volatility": "_std", "mode_rank": "_avg"},
        descending=("rank_avg", "rank_slope", "mode_rank"), within={"mode_rank": ["mode"]})
    typical = medians(ready, "_std", name="_median")
    out = attach_row(ranked, typical).withColumn("high_volatility", F.col("std_otp") > 2 * F.col("_median"))
    return out.drop("_avg", "_slope", "_std", "_median")


def anomalies(otp: DataFrame, routes: DataFrame, threshold: float = 2.0, window: int = 12, min_rows: int = 6,
              events: Mapping[str, str] = KNOWN_EVENTS) -> DataFrame:
    """Every route-month with its lagged rolling baseline, z-score, flag and known event."""
    rows = otp.join(routes.select("route_id", "route_name", "mode"), "route_id")
    frame = series.over_entity("route_id", "month")
    rows = rows.withColumns({
        "rolling_mean": series.trailing("otp", frame, window, min_rows, include_current=False),
        "rolling_std": series.trailing("otp", frame, window, min_rows, include_current=False, fn=F.stddev_samp)})
    z = F.try_divide(F.col("otp") - F.col("rolling_mean"), F.nullif(F.col("rolling_std"), F.lit(0.0)))
    rows = rows.withColumn("z_score", F.when(F.col("rolling_std") > 1e-9, z).otherwise(0.0))
    return rows.withColumns({"is_anomaly": F.abs("z_score") > threshold, "known_event": lookup(F.col("month"), events)})


def anomaly_rates(flagged: DataFrame, share: float = 0.0455) -> DataFrame:
    """Flags per mode and overall against the number a normal distribution would give.

    Rows without a baseline are not tested; their number is reported beside.
    """
    tested = F.col("rolling_mean").isNotNull()
    both = flagged.withColumn("stratum", F.explode(F.array(F.lit("all"), F.col("mode"))))
    out = both.groupBy("stratum").agg(
        F.count_if(tested).alias("n_tested"), F.count_if(~tested).alias("n_untested"),
        F.count_if(F.col("is_anomaly")).alias("n_flagged"),
        F.count_if(F.col("is_anomaly") & (F.col("z_score") < 0)).alias("n_drops"))
    return out.withColumns({
        "expected": F.round(F.col("n_tested") * share).cast("bigint"),
        "rate": F.try_divide(F.col("n_flagged"), F.nullif(F.col("n_tested"), F.lit(0)))})


def short_entities(otp: DataFrame, needed: int = 7) -> DataFrame:
    """Routes with too few months to get a baseline."""
    counts = otp.groupBy("route_id").agg(F.count(F.lit(1)).alias("n_months"))
    return counts.where(F.col("n_months") < needed)


def most_flagged(flagged: DataFrame, k: int = 5) -> DataFrame:
    """All rows of the ``k`` routes with the most flags (ties by route id)."""
    top = flagged.where("is_anomaly").groupBy("route_id").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("n").desc(), "route_id").limit(k)
    return flagged.join(F.broadcast(top.select("route_id")), "route_id", "left_semi")  # k rows


def recovery(otp: DataFrame, routes: DataFrame, route_stops: DataFrame, first: str = "2019-01", last: str = "2020-02",
             min_months: int = 6, recent_periods: int = 12) -> DataFrame:
    """Baseline against the last periods per route: difference, ratio, subtype, stop count."""
    rows = otp.join(routes.select("route_id", "route_name", "mode"), "route_id")
    base = rows.where(F.col("month").between(first, last)).groupBy("route_id", "route_name", "mode").agg(
        F.avg("otp").alias("baseline_otp"), F.count(F.lit(1)).alias("baseline_months"))
    now = series.last_periods(rows, "month", recent_periods).groupBy("route_id").agg(
        F.avg("otp").alias("current_otp"), F.count(F.lit(1)).alias("current_months"))
    out = base.where(F.col("baseline_months") >= min_months).join(
        now.where(F.col("current_months") >= min_months), "route_id").join(stop_counts(route_stops), "route_id", "left")
    return out.withColumns({
        "recovery_delta": gap(F.col("current_otp"), F.col("baseline_otp")),
        "recovery_ratio": F.try_divide(F.col("current_otp"), F.nullif(F.col("baseline_otp"), F.lit(0.0))),
        "subtype": subtype_or_mode(F.col("route_id"), F.col("mode"))})


def recovery_tests(recovered: DataFrame) -> DataFrame:
    """Counts, median and mean change, regression to the mean, stop-count link, Kruskal-Wallis: one row."""
    cut = recovered.withColumn("recovery_delta", stable(F.col("recovery_delta")))
    counts = cut.agg(
        F.count(F.lit(1)).alias("n_routes"), F.avg("recovery_delta").alias("mean_delta"),
        F.count_if(F.col("recovery_delta") > 0).alias("n_improved"), F.count_if(F.col("recovery_delta") < 0).alias("n_declined"))
    rtm = pearson_test(recovered, "baseline_otp", "recovery_delta").select(
        F.col("pearson_r").alias("rtm_r"), F.col("pearson_p").alias("rtm_p"))
    stops = pearson_test(recovered.where(F.col("mode") == "BUS"), "stop_count", "recovery_delta", min_n=6).select(
        F.col("pearson_r").alias("stops_recovery_r"), F.col("pearson_p").alias("stops_recovery_p"))
    groups = kruskal_wallis(cut, "recovery_delta", "subtype").agg(F.max("h").alias("kruskal_h"), F.max("p").alias("kruskal_p"))
    out = counts
    for row in (medians(cut, "recovery_delta", name="median_delta"), rtm, stops, groups):
        out = attach_row(out, row)
    return out


def dual_recovery(otp: DataFrame, ridership: DataFrame, routes: DataFrame, first: str = "2019-01", last: str = "2020-02",
                  recovery_first: str = "2023-01", recovery_last: str = "2024-10", min_months: int = 6) -> DataFrame:
    """Value and ridership of a baseline and a recovery period side by side, from one aggregation."""
    pairs = weekday_pairs(otp, ridership)
    spans = {"baseline": F.col("month").between(first, last), "recovery": F.col("month").between(recovery_first, recovery_last)}
    aggs = []
    for name, there in spans.items():
        aggs += [F.avg(F.when(there, F.col("otp"))).alias(f"{name}_otp"),
                 F.avg(F.when(there, F.col("avg_riders"))).alias(f"{name}_riders"),
                 F.count_if(there).alias(f"{name}_months")]
    out = pairs.where(spans["baseline"] | spans["recovery"]).groupBy("route_id").agg(*aggs)
    out = out.where((F.col("baseline_months") >= min_months) & (F.col("recovery_months") >= min_months))
    out = out.join(routes.select("route_id", "route_name", "mode"), "route_id")
    change = F.try_divide(F.col("recovery_riders") - F.col("baseline_riders"), F.nullif(F.col("baseline_riders"), F.lit(0.0)))
    return out.withColumns({
        "otp_delta": gap(F.col("recovery_otp"), F.col("baseline_otp")), "ridership_pct_change": change,
        "subtype": subtype_or_mode(F.col("route_id"), F.col("mode"))})


def dual_recovery_tests(dual: DataFrame) -> DataFrame:
    """Correlations, sign quadrants and Kruskal-Wallis over subtypes, one row."""
    cut = dual.withColumns({c: stable(F.col(c)) for c in ("otp_delta", "ridership_pct_change")})
    quadrants = sign_quadrants(cut, "ridership_pct_change", "otp_delta")
    groups = kruskal_wallis(cut, "otp_delta", "subtype").agg(F.max("h").alias("kruskal_h"), F.max("p").alias("kruskal_p"))
    return attach_row(attach_row(correlate(dual, "ridership_pct_change", "otp_delta"), quadrants), groups)


def late_trips(otp: DataFrame, ridership: DataFrame, routes: DataFrame) -> DataFrame:
    """Late and total rider-trips per route-month: riders * days * (1 - value)."""
    total = F.col("avg_riders") * F.col("day_count")
    return weekday_pairs(otp, ridership).join(routes.select("route_id", "route_name"), "route_id").withColumns(
        {"late": total * (1.0 - F.col("otp")), "total": total})


def delay_burden(late: DataFrame) -> DataFrame:
    """Routes by late rider-trips with the rank by burden and by mean value."""
    rows = late.groupBy("route_id", "route_name").agg(
        stable(F.sum("late")).alias("total_late"), F.avg("late").alias("avg_monthly_late"), F.sum("total").alias("total_trips"),
        stable(F.avg("otp")).alias("avg_otp"), F.avg("avg_riders").alias("avg_riders"), F.count("month").alias("n_months"))
    served = F.nullif(F.col("total_trips"), F.lit(0.0))
    rows = rows.withColumn("effective_otp", 1.0 - F.try_divide(F.col("total_late"), served))
    rows = with_positions(rows, "total_late", "route_id", descending=True).withColumnRenamed("position", "burden_rank").drop("total")
    return with_positions(rows, "avg_otp", "route_id").withColumnRenamed("position", "otp_rank").drop("total")


def delay_monthly(late: DataFrame) -> DataFrame:
    return late.groupBy("month").agg(
        F.sum("late").alias("system_late"), F.sum("total").alias("system_total"),
        weighted_mean(F.col("otp"), F.col("avg_riders")).alias("system_otp"),
        F.count_distinct("route_id").alias("route_count"))


def burden_summary(burden: DataFrame, k: int = 10) -> DataFrame:
    """System late share, share of the ``k`` largest burdens, and the rank correlation of the two ranks."""
    top = F.sum(F.when(F.col("burden_rank") <= k, F.col("total_late")))
    totals = burden.agg(
        F.sum("total_late").alias("system_late"), F.sum("total_trips").alias("system_total"),
        F.try_divide(F.sum("total_late"), F.nullif(F.sum("total_trips"), F.lit(0.0))).alias("late_share"),
        F.try_divide(top, F.nullif(F.sum("total_late"), F.lit(0.0))).alias("top_share"))
    ranks = correlate(burden, "burden_rank", "otp_rank").select("spearman_r", "spearman_p")
    return attach_row(totals, ranks)


def garage_rows(otp: DataFrame, ridership: DataFrame, routes: DataFrame, min_months: int = 12) -> DataFrame:
    pairs = weekday_pairs(otp, ridership).where(F.col("current_garage").isNotNull())
    pairs = pairs.join(routes.select("route_id", "mode"), "route_id")
    return series.entities_with(pairs, "route_id", min_months)


def garage_routes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("route_id", "current_garage", "mode").agg(
        F.avg("otp").alias("avg_otp"), F.avg("avg_riders").alias("avg_riders"), F.count("month").alias("n_months"))


def garage_summary(per_route: DataFrame) -> DataFrame:
    """Garage statistics over its routes; the median goes through the value ladder."""
    base = per_route.groupBy("current_garage").agg(
        F.count("route_id").alias("n_routes"), F.avg("avg_otp").alias("mean_otp"), F.stddev_samp("avg_otp").alias("std_otp"),
        F.min("avg_otp").alias("min_otp"), F.max("avg_otp").alias("max_otp"), F.sum("avg_riders").alias("total_riders"),
        weighted_mean(F.col("avg_otp"), F.col("avg_riders")).alias("weighted_otp"))
    middle = medians(per_route.withColumn("v", stable(F.col("avg_otp"))), "v", ["current_garage"], "median_otp")
    return base.join(middle, "current_garage")


def garage_monthly(rows: DataFrame) -> DataFrame:
    return rows.groupBy("current_garage", "month").agg(
        weighted_mean(F.col("otp"), F.col("avg_riders")).alias("weighted_otp"), F.avg("otp").alias("unweighted_otp"),
        F.sum("avg_riders").alias("total_riders"), F.count_distinct("route_id").alias("n_routes"))


def garage_tests(per_route: DataFrame, min_group: int = 3) -> DataFrame:
    """Kruskal-Wallis of route means over garages, for all routes and for buses."""
    return kruskal_wallis(all_and_bus(per_route), "avg_otp", "current_garage", ["stratum"], min_group)


def garage_models(per_route: DataFrame, stop_count: DataFrame, spans: DataFrame, garages: list[str],
                  ) -> tuple[DataFrame, DataFrame]:
    """Bus routes: structure alone against structure plus garage indicators, with the nested F-test.

    ``garages`` are the indicator levels; the garage left out is the reference.
    """
    rows = per_route.where(F.col("mode") == "BUS").join(stop_count, "route_id").join(spans, "route_id")
    names = [f"garage_{g.replace(' ', '_')}" for g in garages]
    rows = rows.withColumns({n: indicator(F.col("current_garage") == g) for n, g in zip(names, garages)})
    base = ["stop_count", "span_km"]
    fits = fit_models(rows, "avg_otp", {"structure": base, "with_garages": [*base, *names]})
    return fits, nested_f(fits, {"garages": ("structure", "with_garages")})


def concentration_routes(otp: DataFrame, ridership: DataFrame, routes: DataFrame, min_months: int = 12) -> DataFrame:
    rows = weekday_pairs(otp, ridership).where(F.col("avg_riders").isNotNull())
    rows = series.entities_with(rows, "route_id", min_months).join(routes.select("route_id", "mode"), "route_id")
    return rows.groupBy("route_id", "mode").agg(
        stable(F.avg("otp")).alias("avg_otp"), F.avg("avg_riders").alias("avg_riders"), F.count("month").alias("n_months"))


def _quality_order(per_route: DataFrame) -> DataFrame:
    return with_positions(all_and_bus(per_route), "avg_otp", "route_id", ["stratum"], weight="avg_riders")


def concentration_index(per_route: DataFrame) -> DataFrame:
    """Ridership over routes from worst to best value: index, and where half of it is reached.

    The area is the trapezoid rule over the points of the routes, without the stretch from the
    origin to the first one.
    """
    placed = _quality_order(per_route)
    share = F.try_divide(F.col("cum_weight"), F.nullif(F.col("total_weight"), F.lit(0.0)))
    before = F.try_divide(F.col("cum_weight") - F.col("avg_riders"), F.nullif(F.col("total_weight"), F.lit(0.0)))
    # the strip between a route and the one before it is 1/n wide
    strip = F.when(F.col("position") > 1, (share + before) / 2 / F.col("total"))
    half = F.when(stable(share) >= 0.5, F.struct("position", "avg_otp"))
    out = placed.groupBy("stratum").agg(
        F.sum(strip).alias("_area"), F.min(half).alias("_half"), F.count(F.lit(1)).alias("n_routes"))
    return out.select("stratum", (2 * (F.coalesce("_area", F.lit(0.0)) - 0.5)).alias("gini"),
                      F.col("_half.avg_otp").alias("otp_at_50_pct"), F.col("_half.position").alias("routes_for_50_pct"), "n_routes")


def value_quintiles(per_route: DataFrame) -> DataFrame:
    """Equal-size value quintiles with their share of ridership, for all routes and buses."""
    placed = _quality_order(per_route)
    tile = F.concat(F.lit("Q"), ntile_of(F.col("position"), F.col("total"), 5).cast("string"))
    out = placed.groupBy("stratum", tile.alias("quintile")).agg(
        F.count("route_id").alias("n_routes"), F.avg("avg_otp").alias("mean_otp"), F.min("avg_otp").alias("min_otp"),
        F.max("avg_otp").alias("max_otp"), F.sum("avg_riders").alias("total_riders"),
        F.avg("avg_riders").alias("mean_riders"), F.max("total_weight").alias("_all"))
    return out.withColumn("ridership_share_pct", F.try_divide(F.col("total_riders") * 100, F.nullif("_all", F.lit(0.0)))).drop("_all")


def weekend_profile(otp: DataFrame, routes: DataFrame, route_stops: DataFrame) -> DataFrame:
    """Weekend ratio and service tier per route."""
    rows = with_weekend_ratio(route_average(otp, routes, 1).join(peak_trips(route_stops), "route_id"))
    ratio = F.col("weekend_ratio")
    return rows.withColumn("service_tier", ladder(ratio, [
        (ratio < 0.3, "weekday-heavy (<0.3)"), (ratio <= 0.7, "balanced (0.3-0.7)")], "weekend-heavy (>0.7)"))


def tier_statistics(rows: DataFrame, tier: str, value: str = "avg_otp") -> DataFrame:
    """Count, mean and median of ``value`` per tier."""
    base = rows.groupBy(tier).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_otp"))
    return base.join(medians(rows.withColumn("v", stable(F.col(value))), "v", [tier], "median_otp"), tier)


def panel_deltas(otp: DataFrame, schedule: DataFrame, routes: DataFrame) -> DataFrame:
    """Row-to-row changes of value and weekday trips per route, with the system's mean change removed."""
    weekday = schedule.where(F.col("day_type") == "WEEKDAY").select("route_id", "month", "daily_trips")
    rows = otp.join(weekday, ["route_id", "month"]).join(routes.select("route_id", "mode"), "route_id", "left")
    rows = series.first_differences(rows, "route_id", "month", ["otp", "daily_trips"])
    rows = series.with_group_mean(rows, "month", {"system_delta_otp": "delta_otp"})
    return rows.withColumn("detrended_delta_otp", F.col("delta_otp") - F.col("system_delta_otp"))


def delta_regressions(deltas: DataFrame, split: str = "2020-03", min_n: int = 10) -> DataFrame:
    """Detrended change on change of trips: slope, intercept, r, p, se and Spearman per subset."""
    from lineside.operators.strata import with_strata

    rows = with_strata(deltas, {
        "all": None, "bus": F.col("mode") == "BUS", "pre": F.col("month") < split, "post": F.col("month") >= split}, "subset")
    x, y = F.col("delta_daily_trips").cast("double"), F.col("detrended_delta_otp")
    line = rows.groupBy("subset").agg(
        F.count(F.lit(1)).alias("_n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"))
    rest = (F.col("_syy") - F.col("slope") * F.col("_sxy")) / F.nullif(F.col("_n") - 2, F.lit(0))
    line = line.where(F.col("_n") > min_n).withColumn("se", F.sqrt(F.try_divide(rest, F.nullif("_sxx", F.lit(0.0)))))
    tests = correlate(rows, "delta_daily_trips", "detrended_delta_otp", ["subset"])
    return line.drop("_n", "_sxx", "_syy", "_sxy").join(tests, "subset")


def schedule_changes(schedule: DataFrame, otp: DataFrame, width: int = 3, min_rows: int = 2,
                     covid_months: tuple[str, ...] = ("2020-03", "2020-04")) -> DataFrame:
    """Schedule changes with the mean value before and from the change on, classified by trip change."""
    weekday = schedule.where(F.col("day_type") == "WEEKDAY")
    events = series.change_points(weekday, "route_id", "month", "pick_id", "daily_trips").withColumn(
        "trip_delta", F.col("after") - F.col("before"))
    out = series.event_windows(events, otp, "route_id", "month", "otp", width, min_rows)
    kind = ladder(F.col("trip_delta"), [(F.col("trip_delta") > 0, "increase"), (F.col("trip_delta") < 0, "cut")], "neutral")
    return out.select(
        "route_id", F.col("change_period").alias("change_month"), F.col("old_code").alias("old_pick"),
        F.col("new_code").alias("new_pick"), F.col("before").alias("trips_before"), F.col("after").alias("trips_after"),
        "trip_delta", F.col("value_before").alias("otp_before"), F.col("value_after").alias("otp_after"),
        F.col("value_delta").alias("otp_delta"), "n_before", "n_after", kind.alias("event_type"),
        F.col("change_period").isin(*covid_months).alias("is_covid"))


def change_summary(changes: DataFrame) -> DataFrame:
    base = changes.groupBy("event_type").agg(
        F.count("otp_delta").alias("n"), F.avg("otp_delta").alias("mean_otp_delta"),
        F.stddev_samp("otp_delta").alias("std_otp_delta"), F.avg("trip_delta").alias("mean_trip_delta"))
    cut = changes.withColumn("v", stable(F.col("otp_delta")))
    return base.join(medians(cut, "v", ["event_type"], "median_otp_delta"), "event_type")


def change_tests(changes: DataFrame) -> DataFrame:
    """t against zero, Kruskal-Wallis over event classes and the link to trip change; all events and without covid ones."""
    from lineside.operators.strata import with_strata

    rows = with_strata(changes, {"all": None, "excluding_covid": ~F.col("is_covid")}, "subset")
    t = one_sample_t(rows, "otp_delta", ["subset"]).select("subset", F.col("mean").alias("mean_delta"), "t", F.col("p").alias("t_p"))
    groups = kruskal_wallis(rows, "otp_delta", "event_type", ["subset"], 2).select(
        "subset", F.col("h").alias("kruskal_h"), F.col("p").alias("kruskal_p"))
    link = correlate(rows, "trip_delta", "otp_delta", ["subset"])
    return t.join(groups, "subset", "left").join(link, "subset")


def bounded_bucket(rank: Column, n: Column, buckets: int = 5) -> Column:
    """Bucket 1..buckets from a rank fraction, cut to the valid range."""
    raw = F.floor((rank - 1) / n * buckets).cast("int")
    return F.least(F.greatest(raw, F.lit(0)), F.lit(buckets - 1)) + 1


