"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lineside import catalog
from lineside.session import local_session

HEADLINE = [
    "system_trend", "mode_comparison", "paired_variants", "entity_ranking", "area_equity", "area_quintile_ts", "anomalies",
    "seasonal_amplitude", "stop_hotspots", "geographic_span", "recovery", "municipal_equity", "transfer_hubs", "structural_ols",
    "lead_lag_correlation", "granger_causality", "delay_burden", "garage_tests", "value_quintiles", "route_traffic",
    "weather_panel", "schedule_change_impact", "panel_deltas", "stop_consolidation", "usage_geography", "pareto_curve",
    "route_gini", "boarding_flows", "load_first_row_wins", "etl_schedule", "series_correlation_table", "co_movement",
    "hub_correlations", "traffic_ols", "nearest_stop",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    catalog.run("load_top_routes", spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    began = time.perf_counter()  # a fixed job: how fast this machine is, so that rounds can be compared
    spark.range(40_000_000).selectExpr("id % 1000003 AS k", "sin(id) AS v").groupBy("k").sum("v").write.format("noop").mode("overwrite").save()
    calibration = round(time.perf_counter() - began, 3)
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.run(name, spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "calibration": calibration,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
