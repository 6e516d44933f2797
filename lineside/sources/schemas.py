"""Schemas of the stored tables and of the nested source, and the keys of the load."""

from __future__ import annotations

# Column names and types of the stored tables.
TABLES = {
    "routes": "route_id string, route_name string, mode string",
    "stops": "stop_id string, stop_code int, stop_name string, lat double, lon double, county string, muni string, hood string",
    "route_stops": "route_id string, stop_id string, direction string, trips_wd int, trips_sa int, trips_su int, trips_7d int, svc_days string",
    "stop_reference": "stop_id string, stop_code int, stop_name string, stop_source string, public_stop string, lat double, "
                      "lon double, mode string, first_served string, last_served string, county string, muni string, hood string",
    "otp_monthly": "route_id string, month string, otp double",
    "ridership_monthly": "route_id string, month string, day_type string, avg_riders double, day_count bigint, route_name string, "
                         "current_garage string, mode string",
    "scheduled_trips_monthly": "route_id string, month string, day_type string, daily_trips int, daily_trip_dist double, "
                               "pick_id string, garage string, mode string",
    "schedule_periods": "pick_id string, start_date string, end_date string",
    "weather_daily": "DATE string, PRCP double, SNOW double, TMAX double, TMIN double, AWND double",
    "stop_usage": "stop_id string, route_name string, datekey string, serviceday string, time_period string, direction string, "
                  "mode string, stop_type string, shelter string, stop_name string, latitude double, longitude double, "
                  "avg_ons double, avg_offs double",
    "trips": "route_id string, shape_id string",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence bigint",
}
KEYS = {
    "routes": ["route_id"], "stops": ["stop_id"], "route_stops": ["route_id", "stop_id", "direction"],
    "stop_reference": ["stop_id"], "otp_monthly": ["route_id", "month"],
    "ridership_monthly": ["route_id", "month", "day_type"], "scheduled_trips_monthly": ["route_id", "month", "day_type"],
    "schedule_periods": ["pick_id"],
}
PARENTS = {
    "route_stops": {"route_id": ("routes", "route_id"), "stop_id": ("stops", "stop_id")},
    "otp_monthly": {"route_id": ("routes", "route_id")},
}
NOT_NULL = {
    "routes": ["route_id"], "stops": ["stop_id", "lat", "lon"], "route_stops": ["route_id", "stop_id"],
    "otp_monthly": ["route_id", "month", "otp"], "ridership_monthly": ["route_id", "month", "day_type"],
}
ROAD_FEATURES = (
    "attributes struct<OBJECTID: bigint, CUR_AADT: bigint, TRK_PCT: double, SEG_LNGTH_FEET: double, ST_RT_NO: string>, "
    "geometry struct<paths: array<array<array<double>>>>"
)
