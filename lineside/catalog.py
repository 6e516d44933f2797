"""Named queries over the test tables: each maps (Tables) to one result frame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineside.functions.columns import rounded
from lineside.operators import load, similarity
from lineside.operators.leadlag import lagged_correlations, summarise_lags
from lineside.operators.spatial import nearest_neighbour
from lineside.plans import common, etl, panel, places, routes, system, usage, weather
from lineside.session import shared_dir
from lineside.sources import readers, sinks
from lineside.sources.binding import Tables, mode_of, route_of

# Periods of the test data that play the parts of the baseline, the recovery and so on.
BASE = ("1995-01", "1996-02")
RECOVERY = ("1999-01", "2000-10")
YEARS = ("1995-01", "2000-12")
SLOPE_FROM = "1999-01"
SPLIT = "1998-03"
SHOCK = ("1998-04", "1998-07")
EVENTS = {"1998-03": "service cut", "1998-04": "reduced service"}
GARAGES = ["Garage 1", "Garage 2", "Garage 3", "Garage 4"]
FIT = "feature coefficient std_error t_value p_value beta_weight r_squared adj_r_squared n k"
FIT_FLOATS = "coefficient std_error t_value p_value beta_weight r_squared adj_r_squared"
CORR = "n pearson_r pearson_p spearman_r spearman_p"
CORR_FLOATS = "pearson_r pearson_p spearman_r spearman_p"
NESTED = "f_stat f_p k_diff n r_squared_base r_squared_full"
NESTED_FLOATS = "f_stat f_p r_squared_base r_squared_full"

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}


def query(columns: str = "", floats: str = "") -> Callable:
    """Register a query; ``columns`` are kept, ``floats`` (``name`` or ``name:digits``) are rounded."""
    def register(fn: Callable[[Tables], DataFrame]) -> Callable:
        def run(tables: Tables) -> DataFrame:
            df = fn(tables)
            if columns:
                df = df.select(*columns.split())
            digits = dict((c.split(":") + ["6"])[:2] for c in floats.split())
            return df.withColumns({c: rounded(F.col(c), int(d)) for c, d in digits.items()}) if digits else df

        _QUERIES[fn.__name__] = run
        return fn

    return register


def names() -> list[str]:
    return list(_QUERIES)


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return _QUERIES[name](Tables(spark, folder))


# --- system series ----------------------------------------------------------------------------


@query("stratum month weighted_otp unweighted_otp route_count pct_time_varying yoy_change",
       "weighted_otp unweighted_otp pct_time_varying yoy_change")
def system_trend(t):
    return system.system_trend(t.otp, t.schedule, t.route_stops, t.routes)


@query("mode bus_type month avg_otp weighted_otp route_count", "avg_otp weighted_otp")
def mode_comparison(t):
    return system.mode_comparison(t.otp, t.routes, t.route_stops)


@query("n1 n2 u p first_median second_median", "u p first_median second_median")
def mode_rank_test(t):
    return system.mode_rank_test(t.otp, t.routes)


@query("month gap trend", "gap trend")
def mode_gap_trend(t):
    return system.mode_gap_trend(t.otp, t.routes)


@query("base_id variant_id pair_type month otp_base otp_variant otp_diff", "otp_base otp_variant otp_diff")
def paired_variants(t):
    return system.paired_variants(t.otp, t.routes)


@query("n mean sd t p ci_lower ci_upper n_pairs pair_mean_diff", "mean sd t p ci_lower ci_upper pair_mean_diff")
def variant_tests(t):
    return system.variant_tests(system.paired_variants(t.otp, t.routes))


@query("month unweighted_otp trip_weighted_otp ridership_weighted_otp route_count total_riders",
       "unweighted_otp trip_weighted_otp ridership_weighted_otp total_riders")
def weighting_monthly(t):
    return system.weighting_monthly(t.otp, t.ridership, t.route_stops)


@query("weighting mean median std min max", "mean median std min max")
def weighting_summary(t):
    return system.weighting_summary(system.weighting_monthly(t.otp, t.ridership, t.route_stops))


@query("mean_difference paired_t_stat paired_t_p n_months wilcoxon_stat wilcoxon_p",
       "mean_difference paired_t_stat paired_t_p wilcoxon_stat wilcoxon_p")
def weighting_tests(t):
    return system.weighting_tests(system.weighting_monthly(t.otp, t.ridership, t.route_stops))


@query("month_num deviation weighted_otp", "deviation weighted_otp")
def seasonal_profile(t):
    return system.seasonal_profile(system.balanced_system(t.during(YEARS).otp, t.route_stops, *YEARS))


@query("route_id route_name seasonal_amplitude best_month worst_month", "seasonal_amplitude")
def seasonal_amplitude(t):
    return system.seasonal_amplitude(t.during(YEARS).otp, t.routes, *YEARS)


@query("", " ".join(f"m{i:02d}" for i in range(1, 13)))
def seasonal_heatmap(t):
    return system.seasonal_heatmap(t.during(YEARS).otp, t.routes, *YEARS)


# --- routes -----------------------------------------------------------------------------------


@query("route_id route_name mode months mean_otp std_otp min_otp max_otp recent_mean_otp slope slope_stderr slope_ci_lo "
       "slope_ci_hi slope_significant slope_months obs_span_months stop_count limited_data high_volatility rank_avg "
       "rank_slope rank_volatility mode_rank",
       "mean_otp std_otp min_otp max_otp recent_mean_otp slope slope_stderr slope_ci_lo slope_ci_hi rank_avg rank_slope "
       "rank_volatility mode_rank")
def entity_ranking(t):
    return routes.entity_ranking(t.otp, t.routes, t.route_stops, SLOPE_FROM)


@query("route_id month otp rolling_mean rolling_std z_score is_anomaly known_event", "otp rolling_mean rolling_std z_score")
def anomalies(t):
    return routes.anomalies(t.otp, t.routes, events=EVENTS)


@query("stratum n_tested n_untested n_flagged n_drops expected rate", "rate")
def anomaly_rates(t):
    return routes.anomaly_rates(routes.anomalies(t.otp, t.routes, events=EVENTS))


@query("route_id n_months")
def short_routes(t):
    """Routes without the months that the longest series has."""
    return routes.short_entities(t.otp, 83)


@query("route_id month otp z_score is_anomaly", "otp z_score")
def most_flagged(t):
    return routes.most_flagged(routes.anomalies(t.otp, t.routes, events=EVENTS))


@query("route_id route_name mode baseline_otp baseline_months current_otp current_months stop_count recovery_delta "
       "recovery_ratio subtype", "baseline_otp current_otp recovery_delta recovery_ratio")
def recovery(t):
    return routes.recovery(t.otp, t.routes, t.route_stops, *BASE)


@query("n_routes median_delta mean_delta n_improved n_declined rtm_r rtm_p stops_recovery_r stops_recovery_p kruskal_h kruskal_p",
       "median_delta mean_delta rtm_r rtm_p stops_recovery_r stops_recovery_p kruskal_h kruskal_p")
def recovery_tests(t):
    return routes.recovery_tests(routes.recovery(t.otp, t.routes, t.route_stops, *BASE))


def _dual(t):
    part = t.during(BASE, RECOVERY)
    return routes.dual_recovery(part.otp, part.ridership, t.routes, *BASE, *RECOVERY)


@query("route_id route_name mode baseline_otp recovery_otp baseline_riders recovery_riders baseline_months recovery_months "
       "otp_delta ridership_pct_change subtype",
       "baseline_otp recovery_otp baseline_riders recovery_riders otp_delta ridership_pct_change")
def dual_recovery(t):
    return _dual(t)


@query(f"{CORR} n_both_up n_both_down n_x_up_y_down n_x_down_y_up kruskal_h kruskal_p", f"{CORR_FLOATS} kruskal_h kruskal_p")
def dual_recovery_tests(t):
    return routes.dual_recovery_tests(_dual(t))


@query("route_id total_late avg_monthly_late total_trips avg_otp avg_riders n_months effective_otp burden_rank otp_rank",
       "total_late:3 avg_monthly_late:3 total_trips:3 avg_otp avg_riders:4 effective_otp")
def delay_burden(t):
    return routes.delay_burden(routes.late_trips(t.otp, t.ridership, t.routes))


@query("month system_late system_total system_otp route_count", "system_late:3 system_total:3 system_otp")
def delay_monthly(t):
    return routes.delay_monthly(routes.late_trips(t.otp, t.ridership, t.routes))


@query("system_late system_total late_share top_share spearman_r spearman_p",
       "system_late:2 system_total:2 late_share top_share spearman_r spearman_p")
def burden_summary(t):
    return routes.burden_summary(routes.delay_burden(routes.late_trips(t.otp, t.ridership, t.routes)))


def _garage_routes(t):
    return routes.garage_routes(routes.garage_rows(t.otp, t.ridership, t.routes))


@query("current_garage n_routes mean_otp median_otp std_otp min_otp max_otp total_riders weighted_otp",
       "mean_otp median_otp std_otp min_otp max_otp total_riders:4 weighted_otp")
def garage_summary(t):
    return routes.garage_summary(_garage_routes(t))


@query("current_garage month weighted_otp unweighted_otp total_riders n_routes", "weighted_otp unweighted_otp total_riders")
def garage_monthly(t):
    return routes.garage_monthly(routes.garage_rows(t.otp, t.ridership, t.routes))


@query("stratum n_groups n h p", "h p")
def garage_tests(t):
    return routes.garage_tests(_garage_routes(t))


@query(f"model {FIT}", FIT_FLOATS)
def garage_models(t):
    spans = places.route_spans(t.route_stops, t.stops)
    return routes.garage_models(_garage_routes(t), common.stop_counts(t.route_stops), spans, GARAGES)[0]


@query(NESTED, NESTED_FLOATS)
def garage_nested_test(t):
    spans = places.route_spans(t.route_stops, t.stops)
    return routes.garage_models(_garage_routes(t), common.stop_counts(t.route_stops), spans, GARAGES)[1]


@query("stratum gini otp_at_50_pct routes_for_50_pct n_routes", "gini otp_at_50_pct")
def concentration_index(t):
    return routes.concentration_index(routes.concentration_routes(t.otp, t.ridership, t.routes))


@query("stratum quintile n_routes mean_otp min_otp max_otp total_riders mean_riders ridership_share_pct",
       "mean_otp min_otp max_otp total_riders:4 mean_riders:4 ridership_share_pct")
def value_quintiles(t):
    return routes.value_quintiles(routes.concentration_routes(t.otp, t.ridership, t.routes))


@query("route_id mode avg_otp max_wd max_sa max_su weekend_ratio service_tier", "avg_otp weekend_ratio")
def weekend_profile(t):
    return routes.weekend_profile(t.otp, t.routes, t.route_stops)


@query(f"stratum {CORR}", CORR_FLOATS)
def weekend_profile_correlation(t):
    rows = routes.weekend_profile(t.otp, t.routes, t.route_stops).where(F.col("max_wd") > 0)
    return places.stratum_correlation(rows, "weekend_ratio")


@query("service_tier n mean_otp median_otp", "mean_otp median_otp")
def weekend_tiers(t):
    return routes.tier_statistics(routes.weekend_profile(t.otp, t.routes, t.route_stops), "service_tier")


@query("route_id month mode otp daily_trips delta_otp delta_daily_trips detrended_delta_otp",
       "otp delta_otp detrended_delta_otp")
def panel_deltas(t):
    return routes.panel_deltas(t.otp, t.schedule, t.routes)


@query(f"subset slope intercept se {CORR}", f"slope intercept se {CORR_FLOATS}")
def delta_regressions(t):
    return routes.delta_regressions(routes.panel_deltas(t.otp, t.schedule, t.routes), SPLIT)


def _changes(t):
    return routes.schedule_changes(t.schedule, t.otp, covid_months=SHOCK)


@query("route_id change_month old_pick new_pick trips_before trips_after trip_delta otp_before otp_after otp_delta n_before "
       "n_after event_type is_covid", "otp_before otp_after otp_delta")
def schedule_change_impact(t):
    return _changes(t)


@query("event_type n mean_otp_delta median_otp_delta std_otp_delta mean_trip_delta",
       "mean_otp_delta median_otp_delta std_otp_delta mean_trip_delta")
def schedule_change_summary(t):
    return routes.change_summary(_changes(t))


@query(f"subset mean_delta t t_p kruskal_h kruskal_p {CORR}", f"mean_delta t t_p kruskal_h kruskal_p {CORR_FLOATS}")
def schedule_change_tests(t):
    return routes.change_tests(_changes(t))


# --- places -----------------------------------------------------------------------------------

_AREA = "weighted_otp unweighted_otp otp_gap bus_weighted_otp"


@query("hood muni county weighted_otp route_count stop_count total_trips_7d unweighted_otp otp_gap bus_weighted_otp bus_route_count", _AREA)
def area_equity(t):
    return places.area_equity(t.otp, t.routes, t.route_stops, t.stops)


@query("hood muni county rank_all rank_bus rank_shift", "rank_all rank_bus rank_shift")
def area_rank_shift(t):
    return places.area_rank_shift(places.area_equity(t.otp, t.routes, t.route_stops, t.stops))


@query("area weighted_otp", "weighted_otp")
def area_extremes(t):
    return places.area_extremes(places.area_equity(t.otp, t.routes, t.route_stops, t.stops))


@query("area otp_gap", "otp_gap")
def area_widest_gaps(t):
    return places.widest_gaps(places.area_equity(t.otp, t.routes, t.route_stops, t.stops))


@query("quintile month avg_otp", "avg_otp")
def area_quintile_ts(t):
    return places.area_quintile_series(t.otp, t.route_stops, t.stops)


@query(f"stratum {CORR}", CORR_FLOATS)
def stop_count_correlation(t):
    return places.stratum_correlation(places.stop_count_vs_value(t.otp, t.routes, t.route_stops), "stop_count")


@query("route_id route_name mode avg_otp months stop_count", "avg_otp")
def stop_count_vs_value(t):
    return places.stop_count_vs_value(t.otp, t.routes, t.route_stops)


@query("stop_id lat lon hood muni weighted_otp route_count total_trips_7d modes", "lat lon weighted_otp")
def stop_hotspots(t):
    return places.stop_hotspots(t.otp, t.routes, t.route_stops, t.stops)


@query("route_id shape_id n_points shape_pt_lat shape_pt_lon shape_pt_sequence", "shape_pt_lat shape_pt_lon")
def longest_shapes(t):
    return places.route_polylines(t.trips, t.shapes)


@query("source finding n detail")
def entity_audit(t):
    tables = {"routes": t.routes, "otp_monthly": t.otp, "route_stops": t.route_stops, "stops": t.stops,
              "stop_reference": t.stop_reference}
    return etl.entity_audit(tables, ["20", "70"], ["Ring", "bolt"], "INCLINE")


@query(f"stratum {CORR}", CORR_FLOATS)
def frequency_correlation(t):
    return places.stratum_correlation(places.frequency_vs_value(t.otp, t.routes, t.route_stops), "max_trips_wd")


@query("route_id route_name mode avg_otp months max_trips_wd", "avg_otp")
def frequency_routes(t):
    return places.frequency_vs_value(t.otp, t.routes, t.route_stops)


@query("route_id mode ib_trips_wd ob_trips_wd total_trips asymmetry_index avg_otp", "asymmetry_index avg_otp")
def directional_asymmetry(t):
    return places.directional_asymmetry(t.otp, t.routes, t.route_stops)


@query(f"stratum {CORR}", CORR_FLOATS)
def asymmetry_correlation(t):
    return places.stratum_correlation(places.directional_asymmetry(t.otp, t.routes, t.route_stops), "asymmetry_index")


def _spans(t):
    return places.geographic_span(t.otp, t.routes, t.route_stops, places.route_spans(t.route_stops, t.stops))


@query("route_id mode avg_otp stop_count span_km stop_density", "avg_otp span_km stop_density")
def geographic_span(t):
    return _spans(t)


@query("measure n r p", "r p")
def span_correlations(t):
    return places.span_correlations(_spans(t))


@query("muni county avg_otp n_stops n_routes total_trips", "avg_otp")
def municipal_equity(t):
    return places.municipal_equity(t.otp, t.route_stops, t.stops)


@query("city_otp rest_mean_otp rest_median_otp n_munis best_muni best_otp worst_muni worst_otp spread",
       "city_otp rest_mean_otp rest_median_otp best_otp worst_otp spread")
def municipal_summary(t):
    return places.municipal_summary(places.municipal_equity(t.otp, t.route_stops, t.stops), "ECONOMY 11")


@query("n_cross n_single cross_mean_otp single_mean_otp t p", "cross_mean_otp single_mean_otp t p")
def jurisdiction_test(t):
    return places.jurisdiction_test(places.jurisdiction_rows(t.otp, t.routes, t.route_stops, t.stops))


@query("stop_id stop_name muni avg_otp n_routes total_trips tier", "avg_otp")
def transfer_hubs(t):
    return places.transfer_hubs(t.otp, t.routes, t.route_stops, t.stops)


@query("tier n mean_otp median_otp", "mean_otp median_otp")
def transfer_tiers(t):
    return routes.tier_statistics(places.transfer_hubs(t.otp, t.routes, t.route_stops, t.stops), "tier")


@query(f"level {CORR}", CORR_FLOATS)
def hub_correlations(t):
    return places.hub_correlations(*places.hubs_and_connectivity(t.otp, t.routes, t.route_stops, t.stops))


# --- panel and models -------------------------------------------------------------------------


def _features(t):
    averages = common.route_average(t.otp, t.routes)
    return common.structural_features(averages, t.route_stops, t.stops, places.route_spans(t.route_stops, t.stops))


@query(f"model {FIT}", FIT_FLOATS)
def structural_ols(t):
    return panel.structural_models(_features(t))


@query("model feature vif", "vif")
def structural_vif(t):
    return panel.structural_models(_features(t)).where("feature <> 'intercept'")


def _rider_features(t):
    averages = panel.ridership_features(t.otp, t.ridership, t.routes)
    return common.structural_features(averages, t.route_stops, t.stops, places.route_spans(t.route_stops, t.stops))


@query(f"model {FIT}", FIT_FLOATS)
def ridership_ols(t):
    return panel.added_feature_models(_rider_features(t), ["log_riders"], "riders")[0]


@query(f"scope {NESTED}", NESTED_FLOATS)
def ridership_nested_test(t):
    return panel.added_feature_models(_rider_features(t), ["log_riders"], "riders")[1]


def _vif(fits):
    return fits.where((F.col("feature") != "intercept") & ~F.col("model").like("%_base") & ~F.col("model").like("%_only"))


@query("model feature vif", "vif")
def ridership_vif(t):
    return _vif(panel.added_feature_models(_rider_features(t), ["log_riders"], "riders")[0])


@query("n slope intercept", "slope intercept")
def ridership_partial_residuals(t):
    return panel.partial_residuals(_rider_features(t))


@query("feature n pearson_r pearson_p", "pearson_r pearson_p")
def ridership_collinearity(t):
    return panel.feature_collinearity(_rider_features(t).dropna(subset=["log_riders"]), "log_riders")


@query("route_id n_segments total_length_ft weighted_aadt max_aadt median_aadt p90_aadt avg_truck_pct n_route_points match_rate",
       "total_length_ft:3 weighted_aadt:3 median_aadt:3 p90_aadt:3 avg_truck_pct match_rate")
def route_traffic(t):
    return etl.route_traffic(t.traffic_features, t.trips, t.shapes)


def _traffic_rows(t):
    traffic = etl.route_traffic(t.traffic_features, t.trips, t.shapes)
    return panel.traffic_features(_features(t), traffic, 0.3)


@query(f"model {FIT}", FIT_FLOATS)
def traffic_ols(t):
    return panel.added_feature_models(_traffic_rows(t), ["log_aadt"], "traffic")[0]


@query("model feature vif", "vif")
def traffic_vif(t):
    return _vif(panel.added_feature_models(_traffic_rows(t), ["log_aadt"], "traffic")[0])


@query(f"model {FIT}", FIT_FLOATS)
def traffic_truck_ols(t):
    """The models with truck share, where at least 20 routes have one."""
    return panel.added_feature_models(_traffic_rows(t), ["log_aadt", "avg_truck_pct"], "trucks")[0].where("n >= 20")


@query("feature n pearson_r pearson_p", "pearson_r pearson_p")
def traffic_collinearity(t):
    return panel.feature_collinearity(_traffic_rows(t).dropna(subset=["log_aadt"]), "log_aadt")


@query(f"scope {NESTED}", NESTED_FLOATS)
def traffic_nested_test(t):
    return panel.added_feature_models(_traffic_rows(t), ["log_aadt", "avg_truck_pct"], "traffic")[1]


@query("month day_type total_riders avg_riders_sum n_routes indexed", "total_riders avg_riders_sum indexed")
def daytype_index(t):
    return panel.daytype_monthly(t.ridership, BASE[0])


@query("month weekday saturday sunday total weekend_share sat_share sun_share",
       "weekday saturday sunday total weekend_share sat_share sun_share")
def weekend_share(t):
    return panel.weekend_shares(panel.daytype_monthly(t.ridership, BASE[0]))


@query("route_id avg_weekend_ratio n_months", "avg_weekend_ratio")
def route_weekend_ratio(t):
    return panel.route_weekend_ratio(t.ridership)


@query(CORR, CORR_FLOATS)
def weekend_ratio_correlation(t):
    return panel.weekend_correlation(panel.route_weekend_ratio(t.ridership), t.otp)


@query("route_id lag correlation n p_value", "correlation p_value")
def lead_lag_correlation(t):
    return lagged_correlations(panel.lead_lag_panel(t.otp, t.ridership), "route_id", "month", "otp_dt", "riders_dt")


@query("lag median_r q25_r q75_r mean_r n_significant n_entities", "median_r q25_r q75_r mean_r")
def lead_lag_summary(t):
    return summarise_lags(lagged_correlations(panel.lead_lag_panel(t.otp, t.ridership), "route_id", "month", "otp_dt", "riders_dt"))


@query("route_id best_lag f_stat p_value p_bonferroni n_months", "f_stat p_value p_bonferroni")
def granger_causality(t):
    return panel.granger_tests(panel.lead_lag_panel(t.otp, t.ridership))


def _co_movement_table(t):
    return panel.co_movement_table(t.otp, t.ridership, t.routes)


@query("route_id family centre n imputed correlation", "correlation")
def series_correlation_table(t):
    return _co_movement_table(t)


@query("node cluster cluster_size")
def co_movement(t):
    return similarity.co_movement(_co_movement_table(t), "route_id")[0]


@query("family silhouette n_groups", "silhouette")
def co_movement_scores(t):
    return similarity.co_movement(_co_movement_table(t), "route_id")[1]


@query("cluster n_routes mean_otp mean_stops main_mode", "mean_otp mean_stops")
def co_movement_profile(t):
    groups = similarity.co_movement(_co_movement_table(t), "route_id")[0]
    return panel.cluster_profile(groups, t.otp, t.routes, t.route_stops)


# --- weather ----------------------------------------------------------------------------------


def _merged(t):
    return weather.joined_series(system.balanced_system(t.during(YEARS).otp, t.route_stops, *YEARS), t.weather)


@query(f"variable type {CORR}", CORR_FLOATS)
def weather_correlation(t):
    return weather.weather_correlations(_merged(t))


@query(FIT, FIT_FLOATS)
def weather_trend_model(t):
    return weather.weather_trend_models(_merged(t))[0]


@query(NESTED, NESTED_FLOATS)
def weather_trend_test(t):
    return weather.weather_trend_models(_merged(t))[1]


@query(f"model {FIT}", FIT_FLOATS)
def weather_seasonal_models(t):
    return weather.seasonal_models(_merged(t))[0]


@query(f"added {NESTED}", NESTED_FLOATS)
def weather_seasonal_tests(t):
    return weather.seasonal_models(_merged(t))[1]


@query("month_num raw_otp adjusted_otp", "raw_otp adjusted_otp")
def weather_adjusted_profile(t):
    return weather.adjusted_profile(_merged(t))


@query("feature coefficient cluster_se cluster_t cluster_p n_clusters n", "coefficient:8 cluster_se:8 cluster_t:4 cluster_p:5")
def weather_panel(t):
    rows = t.during(YEARS).otp.where(F.col("month").between(*YEARS)).join(t.routes.select("route_id"), "route_id", "left_semi")
    return weather.weather_panel(rows, t.weather)


@query("variable other r", "r")
def weather_matrix(t):
    return weather.weather_matrix(t.weather)


# --- stop usage -------------------------------------------------------------------------------


@query("stop_id route_name avg_daily_usage low_usage nearest_neighbor_m candidate", "avg_daily_usage nearest_neighbor_m:3")
def stop_consolidation(t):
    return usage.consolidation_candidates(usage.stop_route_usage(t.usage), 25.0)


@query("route_id mode n_candidates n_stops_csv stop_count projected_stops est_otp_gain", "est_otp_gain")
def consolidation_summary(t):
    found = usage.consolidation_candidates(usage.stop_route_usage(t.usage), 25.0)
    return usage.consolidation_summary(found, t.otp, t.routes, t.route_stops)


@query("route_id stop_id nearest_neighbor_m", "nearest_neighbor_m:3")
def nearest_stop(t):
    located = t.route_stops.select("route_id", "stop_id").distinct().join(t.stops.select("stop_id", "lat", "lon"), "stop_id")
    return nearest_neighbour(located, "route_id", "stop_id")


_SHELTER = ("pct_sheltered sheltered_mean_usage unsheltered_mean_usage sheltered_ridership_share sheltered_median_usage "
            "unsheltered_median_usage mannwhitney_u mannwhitney_p")


@query(f"n_stops n_sheltered {_SHELTER}", _SHELTER)
def shelter_summary(t):
    return usage.shelter_summary(usage.stop_shelters(t.usage))


@query("mode n_stops n_sheltered mean_usage pct_sheltered", "mean_usage pct_sheltered")
def shelter_by_mode(t):
    return usage.shelter_by_mode(usage.stop_shelters(t.usage))


@query("shelter n_stops total_usage mean_usage", "total_usage:4 mean_usage")
def shelter_by_owner(t):
    return usage.shelter_by_owner(usage.stop_shelters(t.usage))


@query("stop_id stop_name mode avg_daily_usage", "avg_daily_usage")
def shelter_priority(t):
    return usage.shelter_priority(usage.stop_shelters(t.usage))


@query("stop_id stop_name lat lon mode pre_usage post_usage abs_change pct_change dist_from_dt_km zone",
       "lat lon pre_usage post_usage abs_change pct_change dist_from_dt_km")
def usage_geography(t):
    return usage.usage_change(t.usage)


@query("zone n_stops total_pre total_post agg_pct_change median_pct_change",
       "total_pre:4 total_post:4 agg_pct_change median_pct_change")
def usage_by_zone(t):
    return usage.change_by(usage.usage_change(t.usage), "zone")


@query("mode n_stops total_pre total_post agg_pct_change median_pct_change",
       "total_pre:4 total_post:4 agg_pct_change median_pct_change")
def usage_by_mode(t):
    return usage.change_by(usage.usage_change(t.usage), "mode")


@query("stop_id stop_name avg_daily_usage pct_stops cum_pct_ridership", "avg_daily_usage pct_stops cum_pct_ridership")
def pareto_curve(t):
    return usage.pareto_curve(usage.stop_route_usage(t.usage))


@query("target pct_stops", "pct_stops")
def pareto_crossings(t):
    return usage.pareto_crossings(usage.pareto_curve(usage.stop_route_usage(t.usage)))


@query("route_name gini n_stops total_usage max_stop_usage", "gini total_usage:4 max_stop_usage")
def route_gini(t):
    return usage.route_gini(usage.stop_route_usage(t.usage))


@query("gini n_stops total_usage", "gini total_usage:3")
def system_gini(t):
    return usage.system_gini(usage.stop_route_usage(t.usage))


@query(CORR, CORR_FLOATS)
def gini_correlation(t):
    return usage.gini_correlation(usage.route_gini(usage.stop_route_usage(t.usage)), t.otp, t.routes)


@query("stop_id stop_name mode avg_ons avg_offs net_flow total_usage flow_type on_off_ratio",
       "avg_ons avg_offs net_flow total_usage on_off_ratio")
def boarding_flows(t):
    return usage.boarding_flows(usage.stop_route_usage(t.usage))


@query("flow_type n_stops n_with_ratio n_strong_generators n_strong_attractors")
def flow_classes(t):
    return usage.flow_classes(usage.boarding_flows(usage.stop_route_usage(t.usage)))


@query("direction total_ons total_offs n_records net_flow on_off_ratio", "total_ons total_offs net_flow on_off_ratio")
def direction_flows(t):
    return usage.direction_flows(t.usage)


# --- loading ----------------------------------------------------------------------------------


@query("l_suppkey l_partkey l_orderkey l_linenumber l_quantity")
def load_first_row_wins(t):
    rows = t.raw("lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return load.load_once(rows, ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber", "l_quantity"], ["l_quantity"])


@query("table_name check_name column_name violations")
def load_validation(t):
    orders, lines = t.raw("orders"), t.raw("lineitem")
    return (
        load.check_table("orders", orders, ["o_orderkey"], ["o_custkey", "o_orderdate"], {"o_custkey": (t.raw("customer"), "c_custkey")})
        .unionByName(load.check_table("lineitem", lines, ["l_orderkey", "l_linenumber"], ["l_shipdate"], {
            "l_partkey": (t.raw("part"), "p_partkey"), "l_suppkey": (t.raw("supplier"), "s_suppkey")}))
        .unionByName(load.check_table("labels", t.raw("labels"), ["doc_id"], ["quality"], {"doc_id": (t.raw("documents"), "doc_id")})))


@query("column_name n_rows n_null pct_null", "pct_null")
def null_profile(t):
    return load.null_profile(t.weather_daily, ["PRCP", "SNOW", "TMAX", "TMIN", "AWND"])


@query("n_both n_only_left n_only_right first_both last_both")
def period_coverage(t):
    return load.key_coverage(t.otp, t.weather, "month")


@query("n_both n_only_left n_only_right first_both last_both")
def route_coverage(t):
    return load.key_coverage(t.schedule, t.routes, "route_id")


@query("first_total second_total pct_change", "first_total second_total pct_change")
def period_ratio_check(t):
    return load.period_change(t.schedule.where(F.col("day_type") == "WEEKDAY"), "month", "daily_trips", "1998-03", "1998-04")


@query("winter_snow_days summer_snow_days winter_freeze_days summer_hot_days",
       "winter_snow_days summer_snow_days winter_freeze_days summer_hot_days")
def season_check(t):
    return weather.season_check(t.weather)


@query("route_id route_name mode months avg_otp", "avg_otp:4")
def load_top_routes(t):
    means = t.otp.groupBy("route_id").agg(F.count("month").alias("months"), F.round(F.avg("otp"), 4).alias("avg_otp"))
    return t.routes.join(means, "route_id", "left").orderBy(F.col("avg_otp").desc_nulls_last(), "route_id").limit(10)


@query("route_id stop_count")
def load_top_stop_counts(t):
    return common.stop_counts(t.route_stops).orderBy(F.col("stop_count").desc(), "route_id").limit(5)


def _label():
    """Label of a route as the wide source file has it; one route goes by its name only."""
    plain = F.concat(route_of(F.col("l_suppkey")), F.lit(" - LINE "), F.col("l_suppkey").cast("string"))
    return F.when(F.col("l_suppkey") == 20, "MONONGAHELA INCLINE").otherwise(plain)


def _wide(t):
    """The value table as the wide source file has it: a label and one column per month."""
    label = _label()
    share = F.format_string("%.6f", F.try_divide(F.count_if(F.col("l_returnflag") != "R"), F.count("l_returnflag")))
    rows = t.raw("lineitem").select(label.alias("Route"), F.date_format("l_shipdate", "yyyy-MMM").alias("h"), "l_returnflag")
    # The file has a column for each month that occurs; these are the columns of a table, so they are few.
    headers = sorted(r.h for r in rows.where("h IS NOT NULL").select("h").distinct().collect())
    return rows.groupBy("Route").pivot("h", headers).agg(share)


@query("route_id month otp", "otp")
def etl_otp_long(t):
    return etl.otp_long(_wide(t))


@query("route_id route_name mode")
def etl_routes(t):
    labels = t.raw("lineitem").select(_label().alias("Route"))
    system_file = t.raw("supplier").select(
        route_of(F.col("s_suppkey")).alias("routes"), F.col("s_name").alias("route_name"), mode_of(F.col("s_suppkey")).alias("mode"))
    return etl.routes_table(labels, system_file, "route_name")


@query("route_id month day_type daily_trips daily_trip_dist pick_id garage mode", "daily_trip_dist:2")
def etl_schedule(t):
    code = F.when(F.col("l_suppkey") == 30, "BLLB").otherwise(route_of(F.col("l_suppkey")))
    raw = t.lines.groupBy(code.alias("RouteCode"), F.date_format("l_shipdate", "yyyyMM").alias("dateKey"),
                          F.col("day_type").alias("Day.Type.Join"), F.col("l_linestatus").alias("PickID"),
                          F.concat(F.lit("Garage "), (F.col("l_suppkey") % 5).cast("string")).alias("Current_Garage"),
                          mode_of(F.col("l_suppkey")).alias("Mode")).agg(
        F.count(F.lit(1)).alias("Daily.Trip.Count"), F.sum("l_extendedprice").alias("Daily.Trip.Dist"))
    return etl.schedule_table(raw)


@query("stop_id stop_code stop_name stop_source public_stop lat lon mode first_served last_served county muni hood", "lat lon")
def etl_stop_reference(t):
    return etl.stop_reference_table(t.stop_reference.withColumnsRenamed({"lat": "hastus_lat", "lon": "hastus_lon"}))


@query("route_id month day_type avg_riders day_count route_name current_garage mode", "avg_riders")
def etl_ridership(t):
    """Ridership from an all-text file in which no riders is an empty cell."""
    riders = F.when(F.col("avg_riders") == 0, "").otherwise(F.col("avg_riders").cast("string"))
    return etl.ridership_table(t.ridership.select(
        F.col("route_id").alias("route"), F.concat("month", F.lit("-01")).alias("month_start"), "day_type", riders.alias("avg_riders"),
        F.col("day_count").cast("string").alias("day_count"), F.concat(F.lit("Route "), "route_id").alias("route_full_name"), "current_garage", "mode"))


@query("pick_id start_date end_date")
def etl_periods(t):
    return etl.periods_table(t.schedule.groupBy(F.col("pick_id").alias("pickID")).agg(F.min("month").alias("pickStart"), F.max("month").alias("pickEnd")))


_WEATHER = "total_precip_mm total_snow_mm mean_tmax_c mean_tmin_c mean_wind_ms"


@query("", _WEATHER)
def etl_weather(t):
    return t.weather


@query("stop_id stop_code stop_name lat lon county muni hood", "lat lon")
def etl_stops(t):
    """Stops from the stops-by-route file, where every stop repeats once per line."""
    raw = t.lines.select("stop_id", "l_orderkey", "l_linenumber").join(t.stops, "stop_id").select(
        "stop_id", "stop_code", "stop_name", F.col("lat").alias("stop_lat"), F.col("lon").alias("stop_lon"), "county", "muni", "hood",
        F.struct("l_orderkey", "l_linenumber").alias("o"))
    return etl.stops_table(raw, "o")


@query("route_id stop_id direction trips_wd")
def etl_route_stops(t):
    raw = t.lines.select(
        F.when(F.col("l_linenumber") == 1, "All Routes").otherwise(F.col("route_id")).alias("route_filter"),
        F.col("route_id").alias("routes"), "stop_id", F.when(F.col("l_linestatus") == "F", "IB").otherwise("OB").alias("direction"),
        F.col("l_quantity").cast("bigint").alias("trips_wd"), F.lit(0).alias("trips_sa"), F.lit(0).alias("trips_su"),
        F.lit(0).alias("trips_7d"), F.lit("1-5").alias("svc_days"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("o"))
    return etl.route_stops_table(raw, "o")


@query("mode n_rows n_shelter total_ons", "total_ons")
def csv_round_trip(t):
    """The usage table written as CSV with NA markers to the shared folder, scanned back and summed up."""
    path = f"{shared_dir(t.spark)}/usage-{uuid.uuid4().hex}"
    marked = t.usage.select("stop_id", "route_name", "mode", F.coalesce("shelter", F.lit("NA")).alias("shelter"), "avg_ons")
    sinks.write_csv(marked, path)
    back = readers.read_csv(t.spark, path, "stop_id string, mode string, shelter string, avg_ons double", ["NA"])
    return back.groupBy("mode").agg(F.count(F.lit(1)).alias("n_rows"), F.count("shelter").alias("n_shelter"),
                                    F.sum("avg_ons").alias("total_ons"))


@query("route_id mode n_months mean_otp", "mean_otp")
def parametrised_sql(t):
    return readers.query_tables(t.spark, """
        SELECT r.route_id, r.mode, count(*) AS n_months, avg(o.otp) AS mean_otp FROM {otp} o JOIN {routes} r ON r.route_id = o.route_id
        WHERE o.month BETWEEN :first AND :last AND r.mode = :mode GROUP BY r.route_id, r.mode""",
        {"first": BASE[0], "last": BASE[1], "mode": "BUS"}, otp=t.during(BASE).otp, routes=t.routes)


@query("route_id n_points north", "north:3")
def shape_scan(t):
    """Shapes written as text with a byte-order mark in front of the header, scanned back with a column subset."""
    path = f"{shared_dir(t.spark)}/shapes-{uuid.uuid4().hex}"
    sinks.write_csv(t.shapes.withColumnRenamed("shape_id", "\ufeffshape_id"), path)
    back = readers.read_csv_overrides(t.spark, path, ["shape_id", "shape_pt_lat"], {"shape_pt_lat": "double"})
    return back.join(t.trips, "shape_id").groupBy("route_id").agg(F.count(F.lit(1)).alias("n_points"), F.max("shape_pt_lat").alias("north"))


@query("object_id count truck_pct length_ft n_points lat lon", "truck_pct length_ft lat lon")
def feature_scan(t):
    """Road features written as JSON, one per line, scanned back as segments."""
    path = f"{shared_dir(t.spark)}/features-{uuid.uuid4().hex}"
    t.traffic_features.write.json(path)
    segments = etl.road_segments(readers.read_road_features(t.spark, path, one_per_line=True))
    last = F.element_at("points", -1)
    return segments.withColumns({"n_points": F.size("points"), "lat": last["lat"], "lon": last["lon"]})


@query("month n_routes mean_otp", "mean_otp")
def replaced_table(t):
    """The value table stored by the replacing sink and read back."""
    path = f"{shared_dir(t.spark)}/otp-{uuid.uuid4().hex}"
    sinks.replace_table(t.otp, path)
    stored = t.spark.read.schema(t.otp.schema).parquet(path)
    return stored.groupBy("month").agg(F.count_distinct("route_id").alias("n_routes"), F.avg("otp").alias("mean_otp"))


@query("object_id count truck_pct length_ft n_points lat lon", "truck_pct length_ft lat lon")
def feature_array_scan(t):
    """Road features written as JSON arrays, a file for each partition, cut by byte ranges and scanned back as segments."""
    path = f"{shared_dir(t.spark)}/arrays-{uuid.uuid4().hex}"
    sinks.write_json_arrays(t.traffic_features.repartition(2, "attributes"), path)
    segments = etl.road_segments(readers.read_road_features(t.spark, path))
    last = F.element_at("points", -1)
    return segments.withColumns({"n_points": F.size("points"), "lat": last["lat"], "lon": last["lon"]})


@query("table_name n_rows n_extra")
def published_load(t):
    """Six tables loaded by their keys, parents first, published as a whole and read back; rows beyond the first of a key are counted."""
    root = f"{shared_dir(t.spark)}/load-{uuid.uuid4().hex}"
    lines = t.lines.select(
        "route_id", "stop_id", F.when(F.col("l_linestatus") == "F", "IB").otherwise("OB").alias("direction"), F.col("l_quantity").cast("int").alias("trips_wd"),
        F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("_o"))
    tables = {
        "routes": t.routes, "stops": t.stops.select("stop_id", "stop_code", "stop_name", "lat", "lon", "county", "muni", "hood"), "route_stops": lines,
        "stop_reference": t.stop_reference, "otp_monthly": t.otp, "ridership_monthly": t.ridership}
    order = {"routes": ["route_name"], "stops": ["stop_code"], "route_stops": ["_o"], "stop_reference": ["stop_code"], "otp_monthly": ["otp"],
             "ridership_monthly": ["avg_riders"]}
    report = sinks.publish_load(t.spark, tables, root, order).where("check_name = 'primary_key'").select("table_name", F.col("violations").alias("n_extra"))
    stored = [sinks.read_published(t.spark, root, name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name in tables]
    return reduce(DataFrame.unionByName, stored).join(report, "table_name")


@query("month n_routes mean_otp", "mean_otp")
def republished_table(t):
    """The value table published twice, first in part; readers get the last one."""
    root = f"{shared_dir(t.spark)}/set-{uuid.uuid4().hex}"
    sinks.publish_table(t.otp.where("otp > 0.5"), root, "otp_monthly")
    sinks.publish_table(t.otp, root, "otp_monthly")
    return sinks.read_published(t.spark, root, "otp_monthly").groupBy("month").agg(
        F.count_distinct("route_id").alias("n_routes"), F.avg("otp").alias("mean_otp"))


@query("source finding detail")
def entity_extracts(t):
    tables = {"routes": t.routes, "otp_monthly": t.otp, "route_stops": t.route_stops, "stops": t.stops, "stop_reference": t.stop_reference}
    return etl.entity_findings(tables, ["20", "70"], ["Ring", "bolt"], "INCLINE")


@query("mode n_rows n_shelter total_ons", "total_ons")
def line_ends(t):
    """The usage table written as text whose lines end in two carriage returns before the line feed, scanned back and summed up."""
    path = f"{shared_dir(t.spark)}/lines-{uuid.uuid4().hex}"
    cells = t.usage.select(F.concat_ws(",", "stop_id", "mode", F.col("avg_ons").cast("string"), F.coalesce("shelter", F.lit("NA"))).alias("value"))
    sinks.write_lines(cells, path, "stop_id,mode,avg_ons,shelter", "\r\r\n")
    back = readers.read_csv(t.spark, path, "stop_id string, mode string, avg_ons double, shelter string", ["NA"])
    return back.groupBy("mode").agg(F.count(F.lit(1)).alias("n_rows"), F.count("shelter").alias("n_shelter"), F.sum("avg_ons").alias("total_ons"))
