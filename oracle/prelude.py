"""DuckDB views of the native tables over the test tables, as CTE texts keyed by name.

``with_tables("otp", "routes", ...)`` returns the WITH list those tables need.
"""

from __future__ import annotations

ROUTE = """CASE WHEN {n} % 2 = 0 THEN CAST({n} AS VARCHAR) WHEN {n} % 10 = 5 THEN 'P' || CAST({n} AS VARCHAR)
    WHEN {n} % 10 = 7 THEN CAST({n} - 1 AS VARCHAR) || 'X' ELSE CAST({n} - 1 AS VARCHAR) || 'L' END"""
MODE = """CASE WHEN {n} % 50 = 20 THEN 'INCLINE' WHEN {n} % 10 = 0 THEN 'RAIL' WHEN {n} % 33 = 32 THEN 'UNKNOWN' ELSE 'BUS' END"""
DAY = "CASE dayofweek(l_shipdate) WHEN 6 THEN '{sat}' WHEN 0 THEN '{sun}' ELSE '{wd}' END"
SUBTYPE = """CASE WHEN {r} LIKE '%L' THEN 'limited' WHEN {r} LIKE '%X' THEN 'express' WHEN {r} IN ('P1','P2','P3','G2') THEN 'busway'
    WHEN {r} LIKE 'P%' OR {r} LIKE 'G%' OR {r} LIKE 'O%' THEN 'flyer' ELSE 'local' END"""

_TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), f"""SELECT *, {ROUTE.format(n='l_suppkey')} AS route_id, CAST(l_partkey AS VARCHAR) AS stop_id,
        strftime(l_shipdate, '%Y-%m') AS month, {DAY.format(sat='SAT.', sun='SUN.', wd='WEEKDAY')} AS day_type FROM lineitem"""),
    "routes": ((), f"""SELECT {ROUTE.format(n='s_suppkey')} AS route_id, s_name AS route_name,
        {MODE.format(n='s_suppkey')} AS mode FROM supplier"""),
    "otp": (("lines",), """SELECT route_id, month, CAST(count(*) FILTER (WHERE l_returnflag <> 'R') AS DOUBLE) / count(*) AS otp
        FROM lines GROUP BY route_id, month"""),
    "ridership": (("lines",), f"""SELECT route_id, month, day_type,
        CASE WHEN l_suppkey % 10 = 9 THEN 0.0::DOUBLE ELSE sum(l_quantity) END AS avg_riders, count(*) AS day_count,
        'Garage ' || CAST(l_suppkey % 5 AS VARCHAR) AS current_garage, {MODE.format(n='l_suppkey')} AS mode
        FROM lines GROUP BY l_suppkey, route_id, month, day_type"""),
    "schedule": (("lines",), """SELECT route_id, month, day_type, count(*) AS daily_trips, sum(l_extendedprice) AS daily_trip_dist,
        left(month, 4) || 'Q' || CAST((CAST(substr(month, 6, 2) AS INT) + 2) // 3 AS VARCHAR) AS pick_id
        FROM lines WHERE l_linestatus = 'F' GROUP BY route_id, month, day_type"""),
    "route_stops": (("lines",), """SELECT route_id, stop_id,
        CASE WHEN l_linenumber = 7 THEN 'IB,OB' WHEN l_linestatus = 'F' THEN 'IB' ELSE 'OB' END AS direction,
        CAST(nullif(sum(CASE WHEN day_type = 'WEEKDAY' THEN CAST(l_quantity AS BIGINT) ELSE 0 END), 1) AS BIGINT) AS trips_wd,
        CAST(sum(CASE WHEN day_type = 'SAT.' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS trips_sa,
        CAST(sum(CASE WHEN day_type = 'SUN.' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS trips_su,
        CAST(nullif(sum(CAST(l_quantity AS BIGINT)), 1) AS BIGINT) AS trips_7d
        FROM lines GROUP BY ALL"""),
    "stops": ((), """SELECT CAST(p_partkey AS VARCHAR) AS stop_id, p_partkey AS stop_code, p_name AS stop_name,
        40.44::DOUBLE + CAST(embedding[1] AS DOUBLE) * 0.3::DOUBLE + p_size * 0.0005::DOUBLE AS lat,
        -79.99::DOUBLE + CAST(embedding[2] AS DOUBLE) * 0.3::DOUBLE + p_retailprice * 0.00001::DOUBLE AS lon,
        CASE WHEN p_size <= 25 THEN 'County A' ELSE 'County B' END AS county, p_type || ' ' || CAST(p_size AS VARCHAR) AS muni,
        CASE WHEN p_size = 50 THEN '0' WHEN p_size = 49 THEN '' WHEN p_size = 48 THEN NULL ELSE p_brand END AS hood,
        p_size, p_retailprice
        FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings)"""),
    "stop_reference": (("lines", "stops"), """SELECT s.*, 'Y' AS public_stop, CASE WHEN p_size = 1 THEN 'INCLINE' ELSE 'BUS' END AS mode,
        f.first_served, f.last_served FROM stops s LEFT JOIN
        (SELECT stop_id, min(month) AS first_served, max(month) AS last_served FROM lines GROUP BY stop_id) f ON f.stop_id = s.stop_id"""),
    "weather_daily": ((), """SELECT strftime(o_orderdate, '%Y-%m-%d') AS "DATE",
        count(*) FILTER (WHERE o_orderstatus = 'F') * 8.0::DOUBLE AS PRCP,
        count(*) FILTER (WHERE o_orderpriority = '1-URGENT') * 10.0::DOUBLE AS SNOW,
        max(o_totalprice) / 12000 AS TMAX, min(o_totalprice) / 10000 - 5 AS TMIN,
        CASE WHEN count(*) > 1 THEN max(o_totalprice) / 100000 END AS AWND FROM orders GROUP BY 1"""),
    "weather": (("weather_daily",), """SELECT left("DATE", 7) AS month, coalesce(sum(PRCP), 0.0::DOUBLE) AS total_precip_mm,
        count(*) FILTER (WHERE SNOW > 0) AS snow_days, coalesce(sum(SNOW), 0.0::DOUBLE) AS total_snow_mm,
        avg(TMAX) AS mean_tmax_c, avg(TMIN) AS mean_tmin_c, count(*) FILTER (WHERE TMIN < 0) AS freeze_days,
        count(*) FILTER (WHERE TMAX >= 32) AS hot_days, avg(AWND) AS mean_wind_ms,
        count(*) FILTER (WHERE PRCP >= 25) AS heavy_precip_days, count("DATE") AS n_obs FROM weather_daily GROUP BY 1"""),
    "usage": (("lines", "stops"), f"""SELECT g.*, CASE WHEN datekey < '1998' THEN 'Pre-pandemic' ELSE 'Pandemic' END AS time_period,
        stop_name, lat AS latitude, lon AS longitude,
        CASE WHEN p_size <= 5 THEN 'Agency shelter' WHEN p_size <= 10 THEN 'Vendor shelter' WHEN p_size > 11 THEN 'No Shelter' END AS shelter
        FROM (SELECT stop_id, route_id AS route_name, strftime(l_shipdate, '%Y') AS datekey,
          {DAY.format(sat='Saturday', sun='Sunday', wd='Weekday')} AS serviceday, {MODE.format(n='l_suppkey')} AS mode,
          sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS avg_ons,
          sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS avg_offs,
          CASE WHEN min(l_linestatus) = 'F' THEN 'Inbound' ELSE 'Outbound' END AS direction
          FROM lines GROUP BY 1, 2, 3, 4, 5) g JOIN stops USING (stop_id)"""),
    "route_avg": (("otp", "routes"), """SELECT o.route_id, r.route_name, r.mode, avg(o.otp) AS avg_otp, count(*) AS months
        FROM otp o JOIN routes r USING (route_id) GROUP BY 1, 2, 3"""),
    "stop_counts": (("route_stops",), "SELECT route_id, count(DISTINCT stop_id) AS stop_count FROM route_stops GROUP BY 1"),
    "stop_visits": (("route_stops",), "SELECT route_id, sum(trips_7d) AS trips_7d FROM route_stops GROUP BY 1"),
    "weekday": (("ridership",), "SELECT * FROM ridership WHERE day_type = 'WEEKDAY'"),
    "spans": (("route_stops", "stops"), """SELECT route_id, coalesce(max(12742.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h))), 0.0::DOUBLE) AS span_km FROM (
        SELECT a.route_id, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h
        FROM rs_points a JOIN rs_points b ON a.route_id = b.route_id AND a.stop_id <= b.stop_id) GROUP BY 1"""),
    "rs_points": (("route_stops", "stops"), "SELECT DISTINCT route_id, stop_id, lat, lon FROM route_stops JOIN stops USING (stop_id)"),
}
_TABLES["spans"] = (("rs_points",), _TABLES["spans"][1])


def with_tables(*names: str) -> str:
    """``WITH`` list (without a trailing comma) of the named tables and what they need, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for parent in _TABLES[name][0]:
            add(parent)
        ordered.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({_TABLES[n][1]})" for n in ordered)
