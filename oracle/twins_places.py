"""Twins of the queries by place, panel, weather, stop usage and loading."""

from __future__ import annotations

from oracle.kit import CORR_FLOATS, FIT, FIT_FLOATS, corr, correlation, f_p, gap, nested, ols, q, r_p, t_p
from oracle.prelude import MODE, ROUTE
from oracle.twins import (
    _DELTAS, _SYSTEM, _WEIGHTING, CORR, NESTED, NESTED_FLOATS, centred, kruskal, mann_whitney, ranked, strata, sub, wavg,
)

PLACES: dict[str, str] = {}
_ = (_DELTAS, kruskal)

# --- places -----------------------------------------------------------------------------------

_AREA = f"""
hrows AS MATERIALIZED (SELECT rs.route_id, rs.stop_id, s.hood, s.muni, s.county, a.v, rs.trips_7d AS w, r.mode FROM route_stops rs JOIN stops s USING (stop_id)
  JOIN (SELECT route_id, avg(otp) AS v FROM otp GROUP BY 1 HAVING count(*) >= 12) a USING (route_id) LEFT JOIN routes r USING (route_id)
  WHERE rs.trips_7d IS NOT NULL AND hood IS NOT NULL AND hood NOT IN ('0', '')),
areas AS MATERIALIZED (SELECT a.*, u.unweighted_otp, weighted_otp - unweighted_otp AS otp_gap FROM (SELECT hood, muni, county, {wavg('v', 'w')} AS weighted_otp,
  count(DISTINCT route_id) AS route_count, count(DISTINCT stop_id) AS stop_count, CAST(sum(w) AS BIGINT) AS total_trips_7d,
  sum(v * w) FILTER (WHERE mode = 'BUS') / nullif(CAST(sum(w) FILTER (WHERE mode = 'BUS') AS DOUBLE), 0) AS bus_weighted_otp,
  count(DISTINCT route_id) FILTER (WHERE mode = 'BUS') AS bus_route_count FROM hrows GROUP BY 1, 2, 3) a
  JOIN (SELECT hood, avg(v) AS unweighted_otp FROM (SELECT DISTINCT hood, route_id, v FROM hrows) GROUP BY 1) u USING (hood))"""
_AT = "otp route_stops stops routes"
PLACES["area_equity"] = q(_AT, "SELECT * FROM areas", "weighted_otp unweighted_otp otp_gap bus_weighted_otp", _AREA)
PLACES["area_rank_shift"] = q(_AT, f"""SELECT *, abs(rank_all - rank_bus) AS rank_shift FROM (SELECT hood, muni, county, {ranked('a', desc=True)} AS rank_all, {ranked('b', desc=True)} AS rank_bus
 FROM (SELECT *, round(weighted_otp, 12) AS a, round(bus_weighted_otp, 12) AS b FROM areas WHERE bus_weighted_otp IS NOT NULL))""", "rank_all rank_bus rank_shift", _AREA)
_NAMED = "(SELECT hood || '|' || muni || '|' || county AS area, round(weighted_otp, 12) AS weighted_otp, round(otp_gap, 12) AS otp_gap FROM areas)"
PLACES["area_extremes"] = q(_AT, f"""(SELECT area, weighted_otp FROM {_NAMED} ORDER BY weighted_otp DESC, area LIMIT 10) UNION
 (SELECT area, weighted_otp FROM {_NAMED} ORDER BY weighted_otp, area LIMIT 10)""", "weighted_otp", _AREA)
PLACES["area_widest_gaps"] = q(_AT, f"SELECT area, otp_gap FROM {_NAMED} ORDER BY abs(otp_gap) DESC, area LIMIT 10", "otp_gap", _AREA)
PLACES["area_quintile_ts"] = q("otp route_stops stops", f"""
SELECT CAST(least(greatest(floor((r - 1) / n * 5), 0), 4) AS INT) + 1 AS quintile, month, avg(weighted_otp) AS avg_otp FROM (
 SELECT *, {ranked('rolling', 'month')} AS r, count(*) OVER (PARTITION BY month) AS n FROM (
  SELECT *, CASE WHEN count(weighted_otp) OVER w >= 6 THEN round(avg(weighted_otp) OVER w, 12) END AS rolling FROM (
   SELECT s.hood, o.month, {wavg('o.otp', 'rs.trips_7d')} AS weighted_otp FROM route_stops rs JOIN otp o USING (route_id) JOIN stops s USING (stop_id)
   WHERE rs.trips_7d IS NOT NULL AND hood IS NOT NULL AND hood NOT IN ('0', '') AND rs.route_id IN (SELECT route_id FROM otp GROUP BY 1 HAVING count(*) >= 12) GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY hood ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) WHERE rolling IS NOT NULL) GROUP BY 1, 2""", "avg_otp")
_SC = "sc AS (SELECT a.*, stop_count FROM route_avg a JOIN stop_counts USING (route_id) WHERE months >= 12)"
PLACES["stop_count_vs_value"] = q("route_avg stop_counts", "SELECT * FROM sc", "avg_otp", _SC)
PLACES["stop_count_correlation"] = q("route_avg stop_counts", f"SELECT stratum, {CORR} FROM ({correlation(strata('sc'), 'stop_count', 'avg_otp', 'stratum')})", CORR_FLOATS, _SC)
PLACES["stop_hotspots"] = q("route_avg route_stops stops", f"""
SELECT s.stop_id, s.lat, s.lon, s.hood, s.muni, p.weighted_otp, p.route_count, p.total_trips_7d, p.modes FROM stops s JOIN (
 SELECT stop_id, {wavg('avg_otp', 'trips_7d')} AS weighted_otp, count(DISTINCT route_id) AS route_count, CAST(sum(trips_7d) AS BIGINT) AS total_trips_7d,
 array_to_string(list_sort(list(DISTINCT mode)), ',') AS modes FROM route_stops JOIN route_avg USING (route_id) WHERE months >= 12 GROUP BY 1) p USING (stop_id) WHERE weighted_otp IS NOT NULL""", "lat lon weighted_otp")
PLACES["longest_shapes"] = q("routes rs_points", """
SELECT p.route_id, 'S' || p.route_id AS shape_id, count(*) OVER (PARTITION BY p.route_id) AS n_points, lat AS shape_pt_lat, lon AS shape_pt_lon, CAST(stop_id AS BIGINT) AS shape_pt_sequence
FROM rs_points p JOIN routes USING (route_id)""", "shape_pt_lat shape_pt_lon")
PLACES["entity_audit"] = q("routes otp route_stops stops stop_reference", """
SELECT 'routes' AS source, 'id or mode' AS finding, count(*) AS n, min(route_id || '|' || route_name || '|' || mode) AS detail FROM routes WHERE route_id IN ('20', '70') OR mode = 'INCLINE'
UNION ALL SELECT 'otp_monthly', 'rows', count(*), min(route_id || '|' || month) FROM otp WHERE route_id IN ('20', '70')
UNION ALL SELECT 'otp_monthly', 'positive values', count(*), min(route_id || '|' || month) FROM otp WHERE route_id IN ('20', '70') AND otp > 0
UNION ALL SELECT 'route_stops', 'rows', count(*), min(route_id || '|' || stop_id) FROM route_stops WHERE route_id IN ('20', '70')
UNION ALL SELECT 'stops', 'name match', count(*), min(stop_name) FROM stops WHERE lower(stop_name) LIKE '%ring%' OR lower(stop_name) LIKE '%bolt%'
UNION ALL SELECT 'stop_reference', 'mode or name match', count(*), min(stop_name) FROM stop_reference WHERE mode = 'INCLINE' OR lower(stop_name) LIKE '%ring%' OR lower(stop_name) LIKE '%bolt%'""")
_FQ = "fq AS (SELECT a.*, m AS max_trips_wd FROM route_avg a JOIN (SELECT route_id, max(trips_wd) AS m FROM route_stops GROUP BY 1) USING (route_id) WHERE months >= 12 AND m IS NOT NULL)"
PLACES["frequency_routes"] = q("route_avg route_stops", "SELECT route_id, route_name, mode, avg_otp, months, max_trips_wd FROM fq", "avg_otp", _FQ)
PLACES["frequency_correlation"] = q("route_avg route_stops", f"SELECT stratum, {CORR} FROM ({correlation(strata('fq'), 'max_trips_wd', 'avg_otp', 'stratum')})", CORR_FLOATS, _FQ)
_ASYM = """da AS MATERIALIZED (SELECT d.route_id, mode, ib_trips_wd, ob_trips_wd, ib_trips_wd + ob_trips_wd AS total_trips, abs(ib_trips_wd - ob_trips_wd) / (ib_trips_wd + ob_trips_wd) AS asymmetry_index, avg_otp
  FROM (SELECT route_id, max(trips_wd) FILTER (WHERE direction IN ('IB', 'IB,OB')) AS ib_trips_wd, max(trips_wd) FILTER (WHERE direction IN ('OB', 'IB,OB')) AS ob_trips_wd FROM route_stops GROUP BY 1) d
  JOIN route_avg a USING (route_id) WHERE months >= 12 AND ib_trips_wd + ob_trips_wd > 0)"""
PLACES["directional_asymmetry"] = q("route_avg route_stops", "SELECT * FROM da", "asymmetry_index avg_otp", _ASYM)
PLACES["asymmetry_correlation"] = q("route_avg route_stops", f"SELECT stratum, {CORR} FROM ({correlation(strata('da'), 'asymmetry_index', 'avg_otp', 'stratum')})", CORR_FLOATS, _ASYM)
_GS = "gs AS MATERIALIZED (SELECT a.route_id, mode, avg_otp, stop_count, span_km, CASE WHEN span_km > 0 THEN stop_count / span_km END AS stop_density FROM route_avg a JOIN stop_counts USING (route_id) JOIN spans USING (route_id) WHERE months >= 12)"
_GT = "route_avg stop_counts spans"
PLACES["geographic_span"] = q(_GT, "SELECT * FROM gs", "avg_otp span_km stop_density", _GS)


def _plain(label: str, rows: str, x: str, y: str) -> str:
    return f"SELECT '{label}' AS measure, count(*) AS n, {corr(x, y)} AS r FROM {rows} WHERE {x} IS NOT NULL AND {y} IS NOT NULL"


def _partial(label: str, x: str, z: str) -> str:
    return f"""SELECT '{label}', n, (ab - ac * bc) / sqrt((1 - ac * ac) * (1 - bc * bc)) FROM (SELECT count(*) AS n, corr({x}, avg_otp) AS ab, corr({x}, {z}) AS ac, corr(avg_otp, {z}) AS bc FROM bus)"""


PLACES["span_correlations"] = q(_GT, f"""
SELECT measure, n, r, {r_p('r', 'n')} AS p FROM ({_plain('bus_span', 'bus', 'span_km', 'avg_otp')} UNION ALL {_plain('all_span', 'gs', 'span_km', 'avg_otp')}
 UNION ALL {_plain('bus_density', 'bus', 'stop_density', 'avg_otp')} UNION ALL {_plain('span_and_stops', 'bus', 'span_km', 'stop_count')}
 UNION ALL {_partial('span_given_stops', 'span_km', 'stop_count')} UNION ALL {_partial('stops_given_span', 'stop_count', 'span_km')})
UNION ALL SELECT 'bus_span_rank', n, spearman_r, spearman_p FROM ({correlation('bus', 'span_km', 'avg_otp')})""", "r p", _GS + ", bus AS MATERIALIZED (SELECT * FROM gs WHERE mode = 'BUS')")


def _muni(place: str) -> str:
    return f"""mu AS MATERIALIZED (SELECT muni, county, sum(v * trips_wd) / nullif(CAST(sum(trips_wd) AS DOUBLE), 0) AS avg_otp, count(DISTINCT stop_id) AS n_stops, count(DISTINCT route_id) AS n_routes,
  CAST(sum(trips_wd) AS BIGINT) AS total_trips FROM (SELECT DISTINCT rs.route_id, rs.stop_id, rs.trips_wd, {place} AS muni, s.county, a.v FROM route_stops rs JOIN stops s USING (stop_id)
  JOIN (SELECT route_id, avg(otp) AS v FROM otp GROUP BY 1) a USING (route_id) WHERE s.muni IS NOT NULL AND s.muni <> '0') GROUP BY 1, 2 HAVING count(DISTINCT stop_id) >= 10)"""


PLACES["municipal_equity"] = q("otp route_stops stops", "SELECT * FROM mu", "avg_otp", _muni("s.muni"))
PLACES["municipal_summary"] = q("otp route_stops stops", """
SELECT max(v) FILTER (WHERE home) AS city_otp, avg(v) FILTER (WHERE NOT home) AS rest_mean_otp, median(v) FILTER (WHERE NOT home) AS rest_median_otp, count(*) AS n_munis,
 first(muni ORDER BY v DESC, muni) AS best_muni, max(v) AS best_otp, first(muni ORDER BY v, muni) AS worst_muni, min(v) AS worst_otp, max(v) - min(v) AS spread
FROM (SELECT *, round(avg_otp, 12) AS v, muni = 'ECONOMY 11' AS home FROM mu)""", "city_otp rest_mean_otp rest_median_otp best_otp worst_otp spread", _muni("s.muni"))
PLACES["jurisdiction_test"] = q("route_avg route_stops stops", f"""
SELECT n1 AS n_cross, n2 AS n_single, m1 AS cross_mean_otp, m2 AS single_mean_otp, CASE WHEN n1 > 2 AND n2 > 2 THEN (m1 - m2) / sqrt(e1 + e2) END AS t,
 CASE WHEN n1 > 2 AND n2 > 2 THEN {t_p('((m1 - m2) / sqrt(e1 + e2))', '((e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)))')} END AS p FROM (
 SELECT count(*) FILTER (WHERE c >= 2) AS n1, count(*) FILTER (WHERE c < 2) AS n2, avg(avg_otp) FILTER (WHERE c >= 2) AS m1, avg(avg_otp) FILTER (WHERE c < 2) AS m2,
  var_samp(avg_otp) FILTER (WHERE c >= 2) / count(*) FILTER (WHERE c >= 2) AS e1, var_samp(avg_otp) FILTER (WHERE c < 2) / count(*) FILTER (WHERE c < 2) AS e2
 FROM route_avg JOIN (SELECT route_id, count(DISTINCT muni) AS c FROM route_stops JOIN stops USING (stop_id) WHERE muni IS NOT NULL AND muni <> '0' GROUP BY 1) USING (route_id))""",
    "cross_mean_otp single_mean_otp t p")
_HUB = f"""hubs AS MATERIALIZED (SELECT h.*, stop_name, muni, CASE WHEN n_routes >= 5 THEN 'hub (5+)' WHEN n_routes >= 2 THEN 'medium (2-4)' ELSE 'simple (1)' END AS tier FROM (
  SELECT stop_id, {wavg('avg_otp', 'trips_wd')} AS avg_otp, count(DISTINCT route_id) AS n_routes, CAST(sum(trips_wd) AS BIGINT) AS total_trips
  FROM (SELECT DISTINCT route_id, stop_id, trips_wd FROM route_stops) JOIN route_avg USING (route_id) GROUP BY 1) h JOIN stops USING (stop_id) WHERE avg_otp IS NOT NULL),
con AS MATERIALIZED (SELECT route_id, mode, avg_otp, c AS avg_stop_connectivity FROM route_avg JOIN (
  SELECT route_id, avg(k) AS c FROM (SELECT route_id, count(*) OVER (PARTITION BY stop_id) AS k FROM rs_points JOIN route_avg USING (route_id)) GROUP BY 1) USING (route_id))"""
_HT = "route_avg route_stops stops rs_points"
PLACES["transfer_hubs"] = q(_HT, "SELECT stop_id, stop_name, muni, avg_otp, n_routes, total_trips, tier FROM hubs", "avg_otp", _HUB)
PLACES["transfer_tiers"] = q(_HT, "SELECT tier, count(*) AS n, avg(avg_otp) AS mean_otp, median(avg_otp) AS median_otp FROM hubs GROUP BY 1", "mean_otp median_otp", _HUB)
PLACES["hub_correlations"] = q(_HT, f"""SELECT 'stop' AS level, {CORR} FROM ({correlation('hubs', 'n_routes', 'avg_otp', steps=20000)})
UNION ALL SELECT 'route_' || stratum, {CORR} FROM ({correlation(strata('con'), 'avg_stop_connectivity', 'avg_otp', 'stratum')})""", CORR_FLOATS, _HUB)

# --- models -----------------------------------------------------------------------------------

FEATURES = ["stop_count", "span_km", "is_rail", "weekend_ratio", "n_munis", "is_premium_bus"]
BUS = [f for f in FEATURES if f != "is_rail"]
_FT = "route_avg stop_counts spans route_stops stops"


def _features(averages: str) -> str:
    return f"""feat AS MATERIALIZED (SELECT a.*, stop_count, span_km, CASE WHEN mode = 'RAIL' THEN 1.0 ELSE 0.0 END AS is_rail,
  CASE WHEN max_wd > 0 THEN (max_sa + max_su) / (2.0::DOUBLE * max_wd) ELSE 0.0 END AS weekend_ratio, n_munis,
  CASE WHEN mode = 'BUS' AND {sub('a.route_id')} IN ('busway', 'flyer', 'express', 'limited') THEN 1.0 ELSE 0.0 END AS is_premium_bus
  FROM {averages} a JOIN stop_counts USING (route_id) JOIN spans USING (route_id)
  JOIN (SELECT route_id, max(trips_wd) AS max_wd, max(trips_sa) AS max_sa, max(trips_su) AS max_su FROM route_stops GROUP BY 1) USING (route_id)
  JOIN (SELECT route_id, count(DISTINCT muni) AS n_munis FROM route_stops JOIN stops USING (stop_id) WHERE muni IS NOT NULL AND muni <> '0' GROUP BY 1) USING (route_id))"""


_SOLS = _features("(SELECT * FROM route_avg WHERE months >= 12)") + ", fbus AS (SELECT * FROM feat WHERE mode = 'BUS'),\n" + ",\n".join([
    ols("full", "feat", "avg_otp", FEATURES), ols("red", "feat", "avg_otp", [f for f in FEATURES if f != "span_km"]), ols("bus", "fbus", "avg_otp", BUS)])
PLACES["structural_ols"] = q(_FT, " UNION ALL ".join(f"SELECT '{m}' AS model, {FIT} FROM {t}_fit" for m, t in (("full", "full"), ("reduced", "red"), ("bus_only", "bus"))), FIT_FLOATS, _SOLS)
PLACES["structural_vif"] = q(_FT, " UNION ALL ".join(f"SELECT '{m}' AS model, feature, vif FROM {t}_fit WHERE feature <> 'intercept'" for m, t in (("full", "full"), ("reduced", "red"), ("bus_only", "bus"))), "vif", _SOLS)


def _added(rows: str, added: list[str], label: str) -> tuple[str, str, str]:
    """CTEs, the model union and the nested tests of ``added_feature_models``."""
    ctes = f"whole AS MATERIALIZED ({rows}), wbus AS (SELECT * FROM whole WHERE mode = 'BUS'),\n" + ",\n".join([
        ols("ab", "whole", "avg_otp", FEATURES), ols("af", "whole", "avg_otp", FEATURES + added), ols("ao", "whole", "avg_otp", added),
        ols("bb", "wbus", "avg_otp", BUS), ols("bf", "wbus", "avg_otp", BUS + added)])
    names = {"all_base": "ab", f"all_{label}": "af", f"{label}_only": "ao", "bus_base": "bb", f"bus_{label}": "bf"}
    models = " UNION ALL ".join(f"SELECT '{m}' AS model, {FIT} FROM {t}_fit" for m, t in names.items())
    tests = f"SELECT 'all' AS scope, {NESTED} FROM ({nested('ab', 'af')}) UNION ALL SELECT 'bus', {NESTED} FROM ({nested('bb', 'bf')})"
    return ctes, models, tests


def _vif(label: str) -> str:
    return " UNION ALL ".join(f"SELECT '{m}_{label}' AS model, feature, vif FROM {t}_fit WHERE feature <> 'intercept'" for m, t in (("all", "af"), ("bus", "bf")))


_RT = "otp weekday routes stop_counts spans route_stops stops"
_RFEAT = _WEIGHTING + """,
ra AS (SELECT p.route_id, r.route_name, r.mode, avg(p.otp) AS avg_otp, count(*) AS months FROM paired p JOIN routes r USING (route_id) GROUP BY 1, 2, 3 HAVING count(*) >= 12),
rb AS (SELECT ra.*, avg_r AS avg_riders, CASE WHEN avg_r > 0 THEN ln(avg_r) END AS log_riders FROM ra JOIN (SELECT route_id, avg(avg_riders) AS avg_r FROM weekday GROUP BY 1) USING (route_id)),
""" + _features("rb") + ",\n"
_c, _m, _t = _added("SELECT * FROM feat WHERE log_riders IS NOT NULL", ["log_riders"], "riders")
PLACES["ridership_ols"] = q(_RT, _m, FIT_FLOATS, _RFEAT + _c)
PLACES["ridership_nested_test"] = q(_RT, _t, NESTED_FLOATS, _RFEAT + _c)
PLACES["ridership_vif"] = q(_RT, _vif("riders"), "vif", _RFEAT + _c)
_fit = "(SELECT coefficient FROM {t}_fit WHERE feature = '{f}')"


def _fitted(t: str) -> str:
    return _fit.format(t=t, f="intercept") + "".join(f" + {_fit.format(t=t, f=f)} * {f}" for f in FEATURES)


PLACES["ridership_partial_residuals"] = q(_RT, "SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM pr", "slope intercept",
    _RFEAT + "whole AS MATERIALIZED (SELECT * FROM feat WHERE log_riders IS NOT NULL),\n" + ols("py", "whole", "avg_otp", FEATURES) + ",\n" + ols("px", "whole", "log_riders", FEATURES)
    + f",\npr AS MATERIALIZED (SELECT avg_otp - ({_fitted('py')}) AS y, log_riders - ({_fitted('px')}) AS x FROM whole)")
PLACES["ridership_collinearity"] = q(_RT, f"""SELECT feature, n, r AS pearson_r, {r_p('r', 'n')} AS pearson_p FROM (
 {' UNION ALL '.join(f"SELECT '{f}' AS feature, count(*) AS n, {corr('log_riders', f)} AS r FROM feat WHERE log_riders IS NOT NULL" for f in FEATURES)})""", "pearson_r pearson_p", _RFEAT.rstrip(",\n"))

_D = "111320.0::DOUBLE"
_EAST = f"{_D} * cos(radians(40.44::DOUBLE))"
_TRAFFIC = f"""
seg AS MATERIALIZED (SELECT stop_code AS id, CAST(floor(p_retailprice * 10) AS BIGINT) AS aadt, CASE WHEN p_size <> 7 THEN CAST(p_size AS DOUBLE) END AS truck,
  CASE WHEN p_size <> 13 THEN p_retailprice ELSE 0.0 END AS len, radians(lon) * 6378137.0::DOUBLE AS x, ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0::DOUBLE AS y
  FROM stops WHERE p_size NOT IN (10, 20)),
pts AS (SELECT id, k, degrees(2.0 * atan(exp((y + dy) / 6378137.0::DOUBLE)) - pi() / 2) AS lat, degrees((x + dx) / 6378137.0::DOUBLE) AS lon FROM seg,
  (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 80.0, 50.0), (2, 90.0, 0.0), (3, 130.0, 40.0)) d(k, dx, dy)),
legs AS (SELECT *, lead(lat) OVER (PARTITION BY id ORDER BY k) AS lat1, lead(lon) OVER (PARTITION BY id ORDER BY k) AS lon1 FROM pts),
gaps AS (SELECT *, coalesce(CASE WHEN g > 15 THEN CAST(floor(g / 15) AS INT) END, 0) AS extra FROM (SELECT *, sqrt(pow(lon1 * {_EAST} - lon * {_EAST}, 2) + pow(lat1 * {_D} - lat * {_D}, 2)) AS g FROM legs)),
dense AS MATERIALIZED (SELECT id, (lon + coalesce(j / (extra + 1) * (lon1 - lon), 0.0)) * {_EAST} AS rx, (lat + coalesce(j / (extra + 1) * (lat1 - lat), 0.0)) * {_D} AS ry
  FROM (SELECT *, unnest(range(0, extra + 1)) AS j FROM gaps)),
rp AS MATERIALIZED (SELECT route_id, lat, lon, lon * {_EAST} AS x, lat * {_D} AS y FROM (SELECT *, row_number() OVER (PARTITION BY route_id, round_even(lat, 5), round_even(lon, 5)
  ORDER BY CAST(stop_id AS BIGINT)) AS k FROM rs_points) WHERE k = 1),
spots AS (SELECT x, y, floor(x / 30) + i AS cx, floor(y / 30) + j AS cy FROM (SELECT DISTINCT x, y FROM rp), (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)),
near AS MATERIALIZED (SELECT DISTINCT s.x, s.y, d.id FROM spots s JOIN (SELECT *, floor(rx / 30) AS cx, floor(ry / 30) AS cy FROM dense) d USING (cx, cy)
  WHERE (s.x - rx) * (s.x - rx) + (s.y - ry) * (s.y - ry) <= 900),
hits AS MATERIALIZED (SELECT route_id, rp.lat, rp.lon, id FROM rp JOIN near USING (x, y)),
traffic AS MATERIALIZED (SELECT route_id, coalesce(n_segments, 0) AS n_segments, coalesce(total_length_ft, 0) AS total_length_ft, coalesce(weighted_aadt, 0) AS weighted_aadt, coalesce(max_aadt, 0) AS max_aadt,
  coalesce(median_aadt, 0) AS median_aadt, coalesce(p90_aadt, 0) AS p90_aadt, avg_truck_pct, n_route_points, coalesce(hit, 0) / n_route_points AS match_rate
  FROM (SELECT route_id, count(*) AS n_route_points FROM rp GROUP BY 1) LEFT JOIN (SELECT route_id, count(*) AS hit FROM (SELECT DISTINCT route_id, lat, lon FROM hits) GROUP BY 1) USING (route_id)
  LEFT JOIN (SELECT route_id, count(*) AS n_segments, sum(len) AS total_length_ft, CASE WHEN sum(len) > 0 THEN sum(aadt * len) / sum(len) ELSE avg(aadt) END AS weighted_aadt, max(aadt) AS max_aadt,
    median(CAST(aadt AS DOUBLE)) AS median_aadt, quantile_cont(CAST(aadt AS DOUBLE), 0.9) AS p90_aadt,
    CASE WHEN sum(len) > 0 THEN sum(truck * len) / nullif(sum(CASE WHEN truck IS NOT NULL THEN len END), 0) ELSE avg(truck) END AS avg_truck_pct
    FROM (SELECT DISTINCT route_id, id FROM hits) JOIN seg USING (id) GROUP BY 1) USING (route_id))"""
PLACES["route_traffic"] = q("rs_points stops", "SELECT * FROM traffic", "total_length_ft:3 weighted_aadt:3 median_aadt:3 p90_aadt:3 avg_truck_pct match_rate", _TRAFFIC)
_TFEAT = _TRAFFIC + ",\n" + _features("(SELECT * FROM route_avg WHERE months >= 12)") + ",\n"
_TROWS = "SELECT f.*, CASE WHEN weighted_aadt > 0 THEN ln(weighted_aadt) END AS log_aadt, avg_truck_pct FROM feat f JOIN traffic USING (route_id) WHERE match_rate >= 0.3"
_c, _m, _ = _added(f"SELECT * FROM ({_TROWS}) WHERE log_aadt IS NOT NULL", ["log_aadt"], "traffic")
PLACES["traffic_ols"] = q(_FT + " rs_points", _m, FIT_FLOATS, _TFEAT + _c)
PLACES["traffic_vif"] = q(_FT + " rs_points", _vif("traffic"), "vif", _TFEAT + _c)
PLACES["traffic_collinearity"] = q(_FT + " rs_points", f"""SELECT feature, n, r AS pearson_r, {r_p('r', 'n')} AS pearson_p FROM (
 {' UNION ALL '.join(f"SELECT '{f}' AS feature, count(*) AS n, {corr('log_aadt', f)} AS r FROM whole WHERE log_aadt IS NOT NULL" for f in FEATURES)})""", "pearson_r pearson_p", _TFEAT + _c)
_c, _m, _t = _added(f"SELECT * FROM ({_TROWS}) WHERE log_aadt IS NOT NULL AND avg_truck_pct IS NOT NULL", ["log_aadt", "avg_truck_pct"], "trucks")
PLACES["traffic_nested_test"] = q(_FT + " rs_points", _t, NESTED_FLOATS, _TFEAT + _c)
PLACES["traffic_truck_ols"] = q(_FT + " rs_points", f"SELECT * FROM ({_m}) WHERE n >= 20", FIT_FLOATS, _TFEAT + _c)

# --- ridership panel --------------------------------------------------------------------------

_DAYS = """dm AS MATERIALIZED (SELECT month, day_type, sum(avg_riders * day_count) AS total_riders, sum(avg_riders) AS avg_riders_sum, count(DISTINCT route_id) AS n_routes FROM ridership GROUP BY 1, 2)"""
PLACES["daytype_index"] = q("ridership", """SELECT d.*, d.total_riders * 100 / nullif(b.total_riders, 0) AS indexed FROM dm d
 LEFT JOIN (SELECT day_type, total_riders FROM dm WHERE month = '1995-01') b USING (day_type)""", "total_riders avg_riders_sum indexed", _DAYS)
PLACES["weekend_share"] = q("ridership", """SELECT *, (saturday + sunday) / nullif(total, 0) AS weekend_share, saturday / nullif(total, 0) AS sat_share, sunday / nullif(total, 0) AS sun_share FROM (
 SELECT *, weekday + saturday + sunday AS total FROM (SELECT month, coalesce(sum(total_riders) FILTER (WHERE day_type = 'WEEKDAY'), 0) AS weekday,
 coalesce(sum(total_riders) FILTER (WHERE day_type = 'SAT.'), 0) AS saturday, coalesce(sum(total_riders) FILTER (WHERE day_type = 'SUN.'), 0) AS sunday FROM dm GROUP BY 1))""",
    "weekday saturday sunday total weekend_share sat_share sun_share", _DAYS)
_RATIO = """rr AS MATERIALIZED (SELECT route_id, avg((sa + su) / wd) AS avg_weekend_ratio, count(*) AS n_months FROM (SELECT route_id, month, max(avg_riders) FILTER (WHERE day_type = 'WEEKDAY') AS wd,
  max(avg_riders) FILTER (WHERE day_type = 'SAT.') AS sa, max(avg_riders) FILTER (WHERE day_type = 'SUN.') AS su FROM ridership GROUP BY 1, 2) WHERE wd > 0 AND sa IS NOT NULL AND su IS NOT NULL
  GROUP BY 1 HAVING count(*) >= 6)"""
PLACES["route_weekend_ratio"] = q("ridership", "SELECT * FROM rr", "avg_weekend_ratio", _RATIO)
PLACES["weekend_ratio_correlation"] = q("ridership otp", f"SELECT {CORR} FROM ({correlation('ro', 'avg_weekend_ratio', 'avg_otp', min_n=10)})", CORR_FLOATS,
    _RATIO + ", ro AS (SELECT rr.*, avg_otp FROM rr JOIN (SELECT route_id, avg(otp) AS avg_otp FROM otp GROUP BY 1) USING (route_id))")
_LAG = _WEIGHTING + f""",
k36 AS MATERIALIZED (SELECT * FROM paired WHERE route_id IN (SELECT route_id FROM paired GROUP BY 1 HAVING count(*) >= 36)),
ll AS MATERIALIZED (SELECT route_id, month, row_number() OVER (PARTITION BY route_id ORDER BY month) AS t, otp - avg(otp) OVER (PARTITION BY month) AS x,
  avg_riders - avg(avg_riders) OVER (PARTITION BY month) AS y FROM k36)"""
_LAGS = _LAG + f""",
lags AS MATERIALIZED (SELECT route_id, lag, r AS correlation, n, {r_p('r', 'n')} AS p_value FROM (
  SELECT a.route_id, l.lag, {corr('a.x', 'b.y')} AS r, count(*) AS n FROM ll a, (SELECT unnest(range(0, 7)) AS lag) l JOIN ll b ON b.route_id = a.route_id AND b.t = a.t + l.lag GROUP BY 1, 2))"""
PLACES["lead_lag_correlation"] = q("otp weekday", "SELECT route_id, CAST(lag AS INT) AS lag, correlation, n, p_value FROM lags", "correlation p_value", _LAGS)


def _nearest(p: str) -> str:
    return f"list_sort(list(round(correlation, 12)))[CAST(floor((count(correlation) - 1) * {p}::DOUBLE + 0.5) AS INT) + 1]"


PLACES["lead_lag_summary"] = q("otp weekday", f"""SELECT CAST(lag AS INT) AS lag, median(round(correlation, 12)) AS median_r, {_nearest('0.25')} AS q25_r, {_nearest('0.75')} AS q75_r, avg(correlation) AS mean_r,
 count(*) FILTER (WHERE p_value < 0.05 AND correlation > 0) AS n_significant, count(*) AS n_entities FROM lags GROUP BY 1""", "median_r q25_r q75_r mean_r", _LAGS)


def _granger() -> str:
    """Residual sums per route and lag by sweeping the lag covariances, own lags first."""
    pair = "{'i': %d, 'j': %d, 'v': covar_samp(%s, %s) * (count(*) - 1)}"
    parts = []
    for lag in range(1, 7):
        names = [f"y{j}" for j in range(1, lag + 1)] + [f"x{j}" for j in range(1, lag + 1)] + ["y"]
        k = 2 * lag
        cells = ", ".join(pair % (i, j, a, b) for i, a in enumerate(names) for j, b in enumerate(names))
        parts.append(f"g{lag}_0 AS MATERIALIZED (SELECT g, c.i AS i, c.j AS j, c.v AS v FROM (SELECT route_id AS g, unnest([{cells}]) AS c FROM lagged WHERE t > {lag} GROUP BY 1))")
        for p in range(k):
            a = f"g{lag}_{p}"
            parts.append(f"""g{lag}_{p + 1} AS MATERIALIZED (SELECT a.g, a.i, a.j, CASE WHEN a.i = {p} AND a.j = {p} THEN -1 / d.v WHEN a.i = {p} OR a.j = {p} THEN a.v / d.v ELSE a.v - r.v * c.v / d.v END AS v
              FROM {a} a JOIN {a} d ON d.g = a.g AND d.i = {p} AND d.j = {p} JOIN {a} r ON r.g = a.g AND r.i = a.i AND r.j = {p} JOIN {a} c ON c.g = a.g AND c.i = {p} AND c.j = a.j)""")
    union = " UNION ALL ".join(f"""SELECT s.g AS route_id, {lag} AS lag, s.v AS short, f.v AS whole, n - {lag} - {2 * lag} - 1 AS fr
      FROM g{lag}_{lag} s JOIN g{lag}_{2 * lag} f ON f.g = s.g AND f.i = {2 * lag} AND f.j = {2 * lag} JOIN sizes ON route_id = s.g WHERE s.i = {2 * lag} AND s.j = {2 * lag}""" for lag in range(1, 7))
    parts.append(f"tests AS MATERIALIZED (SELECT route_id, lag, f, {f_p('f', 'lag', '(fr * 1.0)')} AS p FROM (SELECT *, (short - whole) / lag / (whole / fr) AS f FROM ({union})))")
    return ",\n".join(parts)


PLACES["granger_causality"] = q("otp weekday", """
SELECT s.route_id, best_lag, f_stat, p_value, CASE WHEN p_value IS NOT NULL THEN least(p_value * (SELECT count(*) FROM sizes), 1.0) END AS p_bonferroni, n AS n_months FROM sizes s LEFT JOIN (
 SELECT route_id, CAST(first(lag ORDER BY p, lag) AS INT) AS best_lag, first(f ORDER BY p, lag) AS f_stat, min(p) AS p_value FROM tests
 WHERE route_id NOT IN (SELECT route_id FROM ll GROUP BY 1 HAVING max(y) = min(y) OR max(x) = min(x)) GROUP BY 1) USING (route_id)""", "f_stat p_value p_bonferroni",
    _LAG + ", sizes AS MATERIALIZED (SELECT route_id, count(*) AS n FROM ll GROUP BY 1),\nlagged AS MATERIALIZED (SELECT route_id, t, y, x, "
    + ", ".join(f"lag({c}, {j}) OVER w AS {c}{j}" for c in "yx" for j in range(1, 7)) + " FROM ll WINDOW w AS (PARTITION BY route_id ORDER BY t)),\n" + _granger())

_PAIRS = f"""
dt AS MATERIALIZED (SELECT route_id, month, d FROM (SELECT o.route_id, month, otp - avg(otp) OVER (PARTITION BY month) AS d FROM otp o JOIN routes USING (route_id))
  WHERE route_id IN (SELECT route_id FROM otp GROUP BY 1 HAVING count(*) >= 36)),
mem AS MATERIALIZED (SELECT route_id, 'mode' AS family, mode AS centre FROM routes WHERE route_id IN (SELECT route_id FROM dt)
  UNION ALL SELECT route_id, 'garage', min(current_garage) FROM ridership WHERE route_id IN (SELECT route_id FROM dt) GROUP BY 1),
ct AS MATERIALIZED (SELECT family, centre, month, sum(d) AS s, count(*) AS c FROM dt JOIN mem USING (route_id) GROUP BY ALL),
lk AS MATERIALIZED (SELECT dt.route_id, ct.family, ct.centre, d AS x, CASE WHEN m.centre = ct.centre THEN (s - d) / nullif(c - 1, 0) ELSE s / c END AS y
  FROM dt JOIN ct USING (month) LEFT JOIN mem m ON m.route_id = dt.route_id AND m.family = ct.family),
cr AS MATERIALIZED (SELECT route_id, family, centre, count(*) AS n, CASE WHEN count(*) >= 24 AND var_pop(x) > 1e-24::DOUBLE * avg(x * x) AND var_pop(y) > 1e-24::DOUBLE * avg(y * y)
  THEN greatest(least({corr('x', 'y')}, 1.0), -1.0) END AS m FROM lk WHERE y IS NOT NULL GROUP BY ALL),
prs AS MATERIALIZED (SELECT route_id, family, centre, n, m IS NULL AS imputed, coalesce(m, (SELECT median(m) FROM cr)) AS correlation FROM cr)"""
PLACES["series_correlation_table"] = q("otp routes ridership", "SELECT * FROM prs", "correlation", _PAIRS)
_GROUPS = _PAIRS + """,
ds AS MATERIALIZED (SELECT route_id, family, centre, least(greatest(1 - round(correlation, 12), 0.0), 2.0) AS d FROM prs),
nr AS MATERIALIZED (SELECT route_id, family, first(centre ORDER BY d, centre) AS centre, list(d ORDER BY d, centre) AS apart FROM ds GROUP BY 1, 2),
sc AS MATERIALIZED (SELECT family, avg(CASE WHEN len(apart) > 1 AND apart[2] > 0 THEN (apart[2] - apart[1]) / apart[2] ELSE 0.0 END) AS silhouette, count(DISTINCT centre) AS n_groups FROM nr GROUP BY 1),
grp AS MATERIALIZED (SELECT route_id AS node, centre AS cluster, count(*) OVER (PARTITION BY centre) AS cluster_size FROM nr
  WHERE family = (SELECT family FROM sc ORDER BY round(silhouette, 12) DESC, family LIMIT 1))"""
PLACES["co_movement"] = q("otp routes ridership", "SELECT * FROM grp", "", _GROUPS)
PLACES["co_movement_scores"] = q("otp routes ridership", "SELECT * FROM sc", "silhouette", _GROUPS)
PLACES["co_movement_profile"] = q("otp routes ridership route_avg stop_counts", """
SELECT cluster, count(*) AS n_routes, avg(avg_otp) AS mean_otp, avg(stop_count) AS mean_stops, (SELECT mode FROM grp g2 JOIN route_avg r2 ON r2.route_id = g2.node WHERE g2.cluster = g.cluster
 GROUP BY mode ORDER BY count(*) DESC, mode LIMIT 1) AS main_mode FROM grp g JOIN route_avg r ON r.route_id = g.node LEFT JOIN stop_counts s ON s.route_id = g.node GROUP BY 1""", "mean_otp mean_stops", _GROUPS)

# --- weather ----------------------------------------------------------------------------------

VARS = ["total_precip_mm", "snow_days", "total_snow_mm", "mean_tmax_c", "mean_tmin_c", "freeze_days", "hot_days", "mean_wind_ms", "heavy_precip_days"]
MODEL = ["total_precip_mm", "snow_days", "mean_tmax_c", "freeze_days", "mean_wind_ms"]
MONTHS = ["Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_MERGED = _SYSTEM + """,
mg AS MATERIALIZED (SELECT s.weighted_otp AS value, w.*, CAST(row_number() OVER (ORDER BY month) - 1 AS DOUBLE) AS linear_trend, CAST(substr(month, 6, 2) AS INT) AS month_num, """ + ", ".join(
    f"CASE WHEN substr(month, 6, 2) = '{i:02d}' THEN 1.0 ELSE 0.0 END AS month_{m}" for i, m in enumerate(MONTHS, 2)) + " FROM sys s JOIN weather w USING (month))"
_WT = "otp stop_visits weather"
_LONG = " UNION ALL ".join(f"SELECT '{v}' AS variable, month, value, CAST({v} AS DOUBLE) AS x FROM mg" for v in VARS)
PLACES["weather_correlation"] = q(_WT, f"SELECT variable, type, {CORR} FROM ({correlation('wl', 'a', 'b', 'variable, type', 10)}) WHERE n >= 10", CORR_FLOATS,
    _MERGED + f""", tall AS (SELECT *, value - {centred('value', 'variable')} AS vd, x - {centred('x', 'variable')} AS xd FROM ({_LONG})),
wl AS MATERIALIZED (SELECT variable, 'raw' AS type, x AS a, value AS b FROM tall UNION ALL SELECT variable, 'detrended', xd, vd FROM tall)""")
_WHOLE = "mgc AS MATERIALIZED (SELECT * FROM mg WHERE " + " AND ".join(f"{v} IS NOT NULL" for v in MODEL) + ")"
_TREND = _MERGED + f", {_WHOLE},\n" + ols("wt", "mgc", "value", [*MODEL, "linear_trend"]) + ",\n" + ols("tt", "mgc", "value", ["linear_trend"])
PLACES["weather_trend_model"] = q(_WT, f"SELECT {FIT} FROM wt_fit", FIT_FLOATS, _TREND)
PLACES["weather_trend_test"] = q(_WT, f"SELECT {NESTED} FROM ({nested('tt', 'wt')})", NESTED_FLOATS, _TREND)
_DUMMIES = [f"month_{m}" for m in MONTHS]
_SEASON = _MERGED + f", {_WHOLE},\n" + ",\n".join([
    ols("mo", "mg", "value", [*_DUMMIES, "linear_trend"]), ols("ms", "mgc", "value", [*_DUMMIES, "linear_trend"]),
    ols("wo", "mgc", "value", [*MODEL, "linear_trend"]), ols("bo", "mgc", "value", [*_DUMMIES, *MODEL, "linear_trend"])])
PLACES["weather_seasonal_models"] = q(_WT, " UNION ALL ".join(f"SELECT '{m}' AS model, {FIT} FROM {t}_fit" for m, t in (("month_only", "mo"), ("weather_only", "wo"), ("month_plus_weather", "bo"))), FIT_FLOATS, _SEASON)
PLACES["weather_seasonal_tests"] = q(_WT, f"SELECT 'weather' AS added, {NESTED} FROM ({nested('ms', 'bo')}) UNION ALL SELECT 'months', {NESTED} FROM ({nested('wo', 'bo')})", NESTED_FLOATS, _SEASON)
_wf = _fit.format(t="wo", f="intercept") + "".join(f" + {_fit.format(t='wo', f=f)} * {f}" for f in [*MODEL, "linear_trend"])
PLACES["weather_adjusted_profile"] = q(_WT, f"SELECT month_num, avg(value) AS raw_otp, avg(value - ({_wf}) + (SELECT avg(value) FROM mgc)) AS adjusted_otp FROM mgc GROUP BY 1", "raw_otp adjusted_otp",
    _MERGED + f", {_WHOLE},\n" + ols("wo", "mgc", "value", [*MODEL, "linear_trend"]))
_K = len(MODEL)
PLACES["weather_panel"] = q("otp routes weather", f"""
SELECT feature, coefficient, cluster_se, coefficient / cluster_se AS cluster_t, {t_p('(coefficient / cluster_se)', '(n_clusters - 1.0)')} AS cluster_p, n_clusters, n FROM (
 SELECT f.feature, f.coefficient, f.n, c.n_clusters, sqrt(s.v * c.n_clusters / (c.n_clusters - 1) * (f.n - 1) / (f.n - {_K} - 1)) AS cluster_se FROM pf_fit f
 JOIN sand s ON s.i = list_position(['intercept', {', '.join(f"'{v}'" for v in MODEL)}], f.feature) - 1, (SELECT count(*) AS n_clusters FROM scores) c)""",
    "coefficient:8 cluster_se:8 cluster_t:4 cluster_p:5",
    """pan AS MATERIALIZED (SELECT route_id, month, otp - avg(otp) OVER (PARTITION BY route_id) AS dm, w.* EXCLUDE (month) FROM otp JOIN routes USING (route_id) JOIN weather w USING (month) WHERE month BETWEEN '1995-01' AND '2000-12'),
""" + ols("pf", "pan", "dm", MODEL) + f""",
bread AS MATERIALIZED (SELECT v.i + 1 AS i, v.j + 1 AS j, -v.v / (o.n - 1) AS v FROM pf_s{_K} v, pf_model o WHERE v.i < {_K} AND v.j < {_K}
  UNION ALL SELECT 0, v.i + 1, sum(v.v * o.m[v.j + 2 - 1]) / max(o.n - 1) FROM pf_s{_K} v, pf_model o WHERE v.i < {_K} AND v.j < {_K} GROUP BY v.i
  UNION ALL SELECT v.i + 1, 0, sum(v.v * o.m[v.j + 1]) / max(o.n - 1) FROM pf_s{_K} v, pf_model o WHERE v.i < {_K} AND v.j < {_K} GROUP BY v.i
  UNION ALL SELECT 0, 0, max(1.0 / o.n) + sum(-v.v * o.m[v.i + 1] * o.m[v.j + 1]) / max(o.n - 1) FROM pf_s{_K} v, pf_model o WHERE v.i < {_K} AND v.j < {_K}),
res AS (SELECT *, dm - ({_fit.format(t='pf', f='intercept')}{''.join(f" + {_fit.format(t='pf', f=v)} * {v}" for v in MODEL)}) AS e FROM pan WHERE {' AND '.join(f'{v} IS NOT NULL' for v in MODEL)}),
scores AS MATERIALIZED (SELECT month, [sum(e), {', '.join(f'sum({v} * e)' for v in MODEL)}] AS s FROM res GROUP BY 1),
meat AS (SELECT i, j, sum(s[i + 1] * s[j + 1]) AS v FROM scores, (SELECT unnest(range(0, {_K + 1})) AS i) a, (SELECT unnest(range(0, {_K + 1})) AS j) b GROUP BY 1, 2),
sand AS MATERIALIZED (SELECT l.i, sum(l.v * m.v * r.v) AS v FROM bread l JOIN meat m ON m.i = l.j JOIN bread r ON r.i = m.j AND r.j = l.i GROUP BY 1)""")
PLACES["weather_matrix"] = q("weather", " UNION ALL ".join(f"SELECT '{a}' AS variable, '{b}' AS other, {corr(a, b)} AS r FROM weather WHERE {' AND '.join(f'{v} IS NOT NULL' for v in VARS)}" for a in VARS for b in VARS), "r")

# --- stop usage -------------------------------------------------------------------------------

_U = """
pre AS MATERIALIZED (SELECT * FROM usage WHERE time_period = 'Pre-pandemic' AND serviceday = 'Weekday'),
su AS MATERIALIZED (SELECT *, avg_ons + avg_offs AS avg_daily_usage FROM (SELECT stop_id, route_name, avg(avg_ons) AS avg_ons, avg(avg_offs) AS avg_offs, min(latitude) AS lat, min(longitude) AS lon,
  min(stop_name) AS stop_name, min(mode) AS mode FROM pre GROUP BY 1, 2))"""


def _near(rows: str, group: str) -> str:
    return f"""(SELECT a.{group}, a.stop_id, min(12742000.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h))) AS nearest_neighbor_m FROM (SELECT a.{group}, a.stop_id, b.stop_id AS other,
   pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h
   FROM {rows} a LEFT JOIN {rows} b ON a.{group} = b.{group} AND a.stop_id <> b.stop_id) a GROUP BY 1, 2)"""


_CAND = _U + f""",
cand AS MATERIALIZED (SELECT s.stop_id, s.route_name, avg_daily_usage, avg_daily_usage < 25 AS low_usage, nearest_neighbor_m, avg_daily_usage < 25 AND coalesce(nearest_neighbor_m <= 400, false) AS candidate
  FROM su s JOIN {_near('su', 'route_name')} n USING (route_name, stop_id))"""
PLACES["stop_consolidation"] = q("usage", "SELECT * FROM cand", "avg_daily_usage nearest_neighbor_m:3", _CAND)
PLACES["consolidation_summary"] = q("usage route_avg stop_counts", """
SELECT a.route_id, a.mode, c.n_candidates, c.n_stops_csv, a.stop_count, a.stop_count - c.n_candidates AS projected_stops,
 -(SELECT regr_slope(avg_otp, stop_count) FROM av WHERE mode = 'BUS') * c.n_candidates AS est_otp_gain
FROM av a JOIN (SELECT route_name, count(*) FILTER (WHERE candidate) AS n_candidates, count(*) AS n_stops_csv FROM cand GROUP BY 1) c ON c.route_name = a.route_id""", "est_otp_gain",
    _CAND + ", av AS MATERIALIZED (SELECT r.*, coalesce(stop_count, 0) AS stop_count FROM route_avg r LEFT JOIN stop_counts USING (route_id) WHERE months >= 12)")
PLACES["nearest_stop"] = q("rs_points", f"SELECT * FROM {_near('rs_points', 'route_id')}", "nearest_neighbor_m:3")
_SH = _U + """,
sr AS (SELECT stop_id, route_name, avg(avg_ons) AS avg_ons, avg(avg_offs) AS avg_offs, min(stop_name) AS stop_name, min(shelter) AS shelter, min(mode) AS mode FROM pre GROUP BY 1, 2),
sh AS MATERIALIZED (SELECT *, avg_ons + avg_offs AS avg_daily_usage, coalesce(shelter <> 'No Shelter', false) AS has_shelter FROM (SELECT stop_id, sum(avg_ons) AS avg_ons, sum(avg_offs) AS avg_offs,
  min(stop_name) AS stop_name, min(shelter) AS shelter, first(mode ORDER BY route_name) AS mode FROM sr GROUP BY 1))"""
PLACES["shelter_summary"] = q("usage", f"""
SELECT s.*, u AS mannwhitney_u, p AS mannwhitney_p FROM (SELECT count(*) AS n_stops, count(*) FILTER (WHERE has_shelter) AS n_sheltered, count(*) FILTER (WHERE has_shelter) * 100.0 / count(*) AS pct_sheltered,
 avg(avg_daily_usage) FILTER (WHERE has_shelter) AS sheltered_mean_usage, avg(avg_daily_usage) FILTER (WHERE NOT has_shelter) AS unsheltered_mean_usage,
 sum(avg_daily_usage) FILTER (WHERE has_shelter) * 100 / sum(avg_daily_usage) AS sheltered_ridership_share, median(avg_daily_usage) FILTER (WHERE has_shelter) AS sheltered_median_usage,
 median(avg_daily_usage) FILTER (WHERE NOT has_shelter) AS unsheltered_median_usage FROM sh) s, ({mann_whitney('sh', 'avg_daily_usage', 'has_shelter', False)})""",
    "pct_sheltered sheltered_mean_usage unsheltered_mean_usage sheltered_ridership_share sheltered_median_usage unsheltered_median_usage mannwhitney_u mannwhitney_p", _SH)
PLACES["shelter_by_mode"] = q("usage", """SELECT mode, count(*) AS n_stops, count(*) FILTER (WHERE has_shelter) AS n_sheltered, avg(avg_daily_usage) AS mean_usage,
 count(*) FILTER (WHERE has_shelter) * 100.0 / count(*) AS pct_sheltered FROM sh WHERE mode IS NOT NULL GROUP BY 1""", "mean_usage pct_sheltered", _SH)
PLACES["shelter_by_owner"] = q("usage", "SELECT shelter, count(*) AS n_stops, sum(avg_daily_usage) AS total_usage, avg(avg_daily_usage) AS mean_usage FROM sh WHERE has_shelter GROUP BY 1", "total_usage:4 mean_usage", _SH)
PLACES["shelter_priority"] = q("usage", "SELECT stop_id, stop_name, mode, avg_daily_usage FROM (SELECT * REPLACE (round(avg_daily_usage, 12) AS avg_daily_usage) FROM sh) WHERE NOT has_shelter ORDER BY avg_daily_usage DESC, stop_id LIMIT 20", "avg_daily_usage", _SH)
_GEO = """
geo AS MATERIALIZED (SELECT *, post_usage - pre_usage AS abs_change, CASE WHEN pre_usage > 0 THEN (post_usage - pre_usage) * 100 / pre_usage END AS pct_change,
  CASE WHEN dist_from_dt_km < 2 THEN 'Downtown (< 2 km)' WHEN dist_from_dt_km < 8 THEN 'Inner ring (2-8 km)' ELSE 'Outer ring (> 8 km)' END AS zone FROM (
  SELECT p.stop_id, s.stop_name, s.lat, s.lon, p.mode, p.u AS pre_usage, o.u AS post_usage, 12742.0::DOUBLE * atan2(sqrt(h), sqrt(1 - h)) AS dist_from_dt_km FROM pp p JOIN pp o ON o.stop_id = p.stop_id AND NOT o.early
  JOIN (SELECT *, pow(sin(radians(40.4406::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians(40.4406::DOUBLE)) * pow(sin(radians(-79.9959::DOUBLE - lon) / 2), 2) AS h FROM stops) s ON s.stop_id = p.stop_id WHERE p.early))"""
_GEO = """dk AS (SELECT stop_id, time_period = 'Pre-pandemic' AS early, datekey, sum(avg_ons) AS ons, sum(avg_offs) AS offs, first(mode ORDER BY route_name) AS mode FROM usage WHERE serviceday = 'Weekday' GROUP BY 1, 2, 3),
pp AS MATERIALIZED (SELECT stop_id, early, avg(ons) + avg(offs) AS u, first(mode ORDER BY datekey) AS mode FROM dk GROUP BY 1, 2),""" + _GEO
PLACES["usage_geography"] = q("usage", "SELECT * FROM geo", "lat lon pre_usage post_usage abs_change pct_change dist_from_dt_km", _GEO)
for _name, _by in (("usage_by_zone", "zone"), ("usage_by_mode", "mode")):
    PLACES[_name] = q("usage", f"""SELECT {_by}, count(*) AS n_stops, sum(pre_usage) AS total_pre, sum(post_usage) AS total_post, (sum(post_usage) - sum(pre_usage)) * 100 / nullif(sum(pre_usage), 0) AS agg_pct_change,
     median(pct_change) AS median_pct_change FROM geo GROUP BY 1""", "total_pre:4 total_post:4 agg_pct_change median_pct_change", _GEO)
_PARETO = _U + """,
pc AS MATERIALIZED (SELECT stop_id, stop_name, u AS avg_daily_usage, row_number() OVER o * 100.0 / count(*) OVER () AS pct_stops, sum(u) OVER (ORDER BY u DESC, stop_id ROWS UNBOUNDED PRECEDING) * 100 / nullif(sum(u) OVER (), 0) AS cum_pct_ridership
  FROM (SELECT stop_id, round(sum(avg_daily_usage), 12) AS u, min(stop_name) AS stop_name FROM su GROUP BY 1) WINDOW o AS (ORDER BY u DESC, stop_id))"""
PLACES["pareto_curve"] = q("usage", "SELECT * FROM pc", "avg_daily_usage pct_stops cum_pct_ridership", _PARETO)
PLACES["pareto_crossings"] = q("usage", "SELECT target, (SELECT min(pct_stops) FROM pc WHERE round(cum_pct_ridership, 12) >= target) AS pct_stops FROM (VALUES (50), (80), (90)) v(target)", "pct_stops", _PARETO)


def _gini(rows: str, by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {by + ', ' if by else ''}(2 * sum(i * v) - (count(*) + 1) * sum(v)) / nullif(count(*) * sum(v), 0) AS gini, count(*) AS n_stops, sum(v) AS total_usage, max(v) AS max_stop_usage
     FROM (SELECT *, row_number() OVER ({part} ORDER BY v) AS i FROM {rows}) {'GROUP BY ' + by if by else ''}"""


_RG = _U + f", rg AS MATERIALIZED ({_gini('(SELECT route_name, round(avg_daily_usage, 12) AS v FROM su)', 'route_name')} HAVING count(*) >= 3)"
PLACES["route_gini"] = q("usage", "SELECT * FROM rg", "gini total_usage:4 max_stop_usage", _RG)
PLACES["system_gini"] = q("usage", f"SELECT gini, n_stops, total_usage FROM ({_gini('(SELECT stop_id, round(sum(avg_daily_usage), 12) AS v FROM su GROUP BY 1)', '')})", "gini total_usage:3", _U)
PLACES["gini_correlation"] = q("usage route_avg", f"SELECT {CORR} FROM ({correlation('(SELECT gini, avg_otp FROM rg JOIN route_avg ON route_id = rg.route_name WHERE months >= 12)', 'gini', 'avg_otp')})", CORR_FLOATS, _RG)
_FLOW = _U + f""",
fl AS MATERIALIZED (SELECT *, {gap('avg_ons', 'avg_offs')} AS net_flow, avg_ons + avg_offs AS total_usage, CASE WHEN {gap('avg_ons', 'avg_offs')} > 0 THEN 'Generator' WHEN {gap('avg_ons', 'avg_offs')} < 0 THEN 'Attractor' ELSE 'Balanced' END AS flow_type,
  CASE WHEN avg_offs > 0 THEN avg_ons / avg_offs END AS on_off_ratio FROM (SELECT stop_id, sum(avg_ons) AS avg_ons, sum(avg_offs) AS avg_offs, min(stop_name) AS stop_name, first(mode ORDER BY route_name) AS mode FROM su GROUP BY 1))"""
PLACES["boarding_flows"] = q("usage", "SELECT * FROM fl", "avg_ons avg_offs net_flow total_usage on_off_ratio", _FLOW)
PLACES["flow_classes"] = q("usage", """SELECT flow_type, count(*) AS n_stops, count(on_off_ratio) AS n_with_ratio, count(*) FILTER (WHERE on_off_ratio > 1.5) AS n_strong_generators,
 count(*) FILTER (WHERE on_off_ratio < 0.67) AS n_strong_attractors FROM fl GROUP BY 1""", "", _FLOW)
PLACES["direction_flows"] = q("usage", """SELECT *, total_ons - total_offs AS net_flow, CASE WHEN total_offs > 0 THEN total_ons / total_offs END AS on_off_ratio FROM (
 SELECT direction, sum(avg_ons) AS total_ons, sum(avg_offs) AS total_offs, count(*) AS n_records FROM pre WHERE direction IS NOT NULL GROUP BY 1)""", "total_ons total_offs net_flow on_off_ratio", _U)

# --- loading ----------------------------------------------------------------------------------

PLACES["load_first_row_wins"] = """SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey
 ORDER BY l_orderkey, l_linenumber, l_quantity) AS k FROM lineitem WHERE l_quantity IS NOT NULL) WHERE k = 1"""


def _pk(table: str, key: str) -> str:
    return f"SELECT '{table}' AS table_name, 'primary_key' AS check_name, '{key}' AS column_name, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS violations FROM (SELECT count(*) AS c FROM {table} GROUP BY {key})"


def _nn(table: str, column: str) -> str:
    return f"SELECT '{table}', 'not_null', '{column}', count(*) FILTER (WHERE {column} IS NULL) FROM {table}"


def _fk(table: str, column: str, parent: str, key: str) -> str:
    return f"SELECT '{table}', 'foreign_key', '{column}', count(*) FROM {table} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent})"


PLACES["load_validation"] = " UNION ALL ".join([
    _pk("orders", "o_orderkey"), _nn("orders", "o_custkey"), _nn("orders", "o_orderdate"), _fk("orders", "o_custkey", "customer", "c_custkey"),
    _pk("lineitem", "l_orderkey,l_linenumber"), _nn("lineitem", "l_shipdate"), _fk("lineitem", "l_partkey", "part", "p_partkey"), _fk("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    _pk("labels", "doc_id"), _nn("labels", "quality"), _fk("labels", "doc_id", "documents", "doc_id")])
PLACES["null_profile"] = q("weather_daily", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, (count(*) - count({c})) * 100.0 / count(*) AS pct_null FROM weather_daily"
    for c in ("PRCP", "SNOW", "TMAX", "TMIN", "AWND")), "pct_null")


def _coverage(left: str, right: str, key: str) -> str:
    return f"""SELECT count(*) FILTER (WHERE l.k IS NOT NULL AND r.k IS NOT NULL) AS n_both, count(*) FILTER (WHERE r.k IS NULL) AS n_only_left, count(*) FILTER (WHERE l.k IS NULL) AS n_only_right,
     min(l.k) FILTER (WHERE r.k IS NOT NULL) AS first_both, max(l.k) FILTER (WHERE r.k IS NOT NULL) AS last_both FROM (SELECT DISTINCT {key} AS k FROM {left}) l FULL JOIN (SELECT DISTINCT {key} AS k FROM {right}) r ON r.k = l.k"""


PLACES["period_coverage"] = q("otp weather", _coverage("otp", "weather", "month"))
PLACES["route_coverage"] = q("schedule routes", _coverage("schedule", "routes", "route_id"))
PLACES["period_ratio_check"] = q("schedule", """SELECT *, (second_total - first_total) * 100.0 / nullif(first_total, 0) AS pct_change FROM (SELECT sum(daily_trips) FILTER (WHERE month = '1998-03') AS first_total,
 sum(daily_trips) FILTER (WHERE month = '1998-04') AS second_total FROM schedule WHERE day_type = 'WEEKDAY')""", "first_total second_total pct_change")
PLACES["season_check"] = q("weather", """SELECT avg(snow_days) FILTER (WHERE m IN ('12', '01', '02')) AS winter_snow_days, avg(snow_days) FILTER (WHERE m IN ('06', '07', '08')) AS summer_snow_days,
 avg(freeze_days) FILTER (WHERE m IN ('12', '01', '02')) AS winter_freeze_days, avg(hot_days) FILTER (WHERE m IN ('06', '07', '08')) AS summer_hot_days FROM (SELECT *, substr(month, 6, 2) AS m FROM weather)""",
    "winter_snow_days summer_snow_days winter_freeze_days summer_hot_days")
PLACES["load_top_routes"] = q("routes otp", """SELECT r.*, months, round(a, 4) AS avg_otp FROM routes r LEFT JOIN (SELECT route_id, count(*) AS months, avg(otp) AS a FROM otp GROUP BY 1) USING (route_id)
 ORDER BY round(a, 4) DESC NULLS LAST, route_id LIMIT 10""", "avg_otp:4")
PLACES["load_top_stop_counts"] = q("stop_counts", "SELECT route_id, stop_count FROM stop_counts ORDER BY stop_count DESC, route_id LIMIT 5")
PLACES["etl_otp_long"] = q("lines", """SELECT CASE WHEN l_suppkey = 20 THEN 'MI' ELSE route_id END AS route_id, month,
 CAST(printf('%.6f', count(*) FILTER (WHERE l_returnflag <> 'R') / count(*)) AS DOUBLE) AS otp FROM lines GROUP BY l_suppkey, route_id, month""", "otp")
PLACES["etl_routes"] = f"""SELECT coalesce(a.route_id, b.route_id) AS route_id, coalesce(a.n, b.s_name) AS route_name, coalesce(b.mode, 'UNKNOWN') AS mode
FROM (SELECT DISTINCT CASE WHEN l_suppkey = 20 THEN 'MI' ELSE {ROUTE.format(n='l_suppkey')} END AS route_id,
 CASE WHEN l_suppkey = 20 THEN 'MONONGAHELA INCLINE' ELSE 'LINE ' || CAST(l_suppkey AS VARCHAR) END AS n FROM lineitem) a
FULL JOIN (SELECT {ROUTE.format(n='s_suppkey')} AS route_id, s_name, {MODE.format(n='s_suppkey')} AS mode FROM supplier) b ON b.route_id = a.route_id"""
PLACES["etl_stop_reference"] = q("stop_reference", """SELECT stop_id, stop_code, stop_name, 'catalog' AS stop_source, public_stop, lat, lon, mode, first_served, last_served,
 county, muni, hood FROM stop_reference""", "lat lon")
PLACES["etl_ridership"] = q("ridership", """SELECT route_id, month, day_type, nullif(avg_riders, 0) AS avg_riders, day_count, 'Route ' || route_id AS route_name, current_garage, mode
 FROM ridership""", "avg_riders")
PLACES["etl_periods"] = q("schedule", "SELECT pick_id, min(month) AS start_date, max(month) AS end_date FROM schedule GROUP BY 1")
PLACES["short_routes"] = q("otp", "SELECT route_id, count(*) AS n_months FROM otp GROUP BY 1 HAVING count(*) < 83")
PLACES["etl_schedule"] = q("lines", f"""SELECT route_id, month, day_type, daily_trips, daily_trip_dist, pick_id, garage, mode FROM (
 SELECT *, row_number() OVER (PARTITION BY route_id, month, day_type ORDER BY daily_trips DESC, pick_id) AS k FROM (
 SELECT CASE WHEN l_suppkey = 30 THEN 'BLUE' ELSE route_id END AS route_id, month, day_type, l_linestatus AS pick_id, 'Garage ' || CAST(l_suppkey % 5 AS VARCHAR) AS garage,
 {MODE.format(n='l_suppkey')} AS mode, count(*) AS daily_trips, sum(l_extendedprice) AS daily_trip_dist FROM lines GROUP BY ALL)) WHERE k = 1""", "daily_trip_dist:2")
PLACES["etl_weather"] = q("weather", "SELECT * FROM weather", "total_precip_mm total_snow_mm mean_tmax_c mean_tmin_c mean_wind_ms")
PLACES["etl_stops"] = q("lines stops", "SELECT stop_id, stop_code, stop_name, lat, lon, county, muni, hood FROM stops WHERE stop_id IN (SELECT stop_id FROM lines)", "lat lon")
PLACES["etl_route_stops"] = q("lines", """SELECT route_id, stop_id, direction, trips_wd FROM (SELECT route_id, stop_id, CASE WHEN l_linestatus = 'F' THEN 'IB' ELSE 'OB' END AS direction, CAST(l_quantity AS BIGINT) AS trips_wd,
 row_number() OVER (PARTITION BY route_id, stop_id, l_linestatus ORDER BY l_orderkey, l_linenumber, l_quantity) AS k FROM lines WHERE l_linenumber <> 1) WHERE k = 1""")
PLACES["csv_round_trip"] = q("usage", "SELECT mode, count(*) AS n_rows, count(shelter) AS n_shelter, sum(avg_ons) AS total_ons FROM usage GROUP BY 1", "total_ons")
PLACES["parametrised_sql"] = q("otp routes", """SELECT route_id, mode, count(*) AS n_months, avg(otp) AS mean_otp FROM otp JOIN routes USING (route_id)
 WHERE month BETWEEN '1995-01' AND '1996-02' AND mode = 'BUS' GROUP BY 1, 2""", "mean_otp")
PLACES["shape_scan"] = q("rs_points", "SELECT route_id, count(*) AS n_points, max(lat) AS north FROM rs_points GROUP BY 1", "north:3")
PLACES["feature_scan"] = q("stops", """SELECT stop_code AS object_id, CAST(floor(p_retailprice * 10) AS BIGINT) AS count, CASE WHEN p_size <> 7 THEN CAST(p_size AS DOUBLE) END AS truck_pct,
 CASE WHEN p_size <> 13 THEN p_retailprice ELSE 0.0 END AS length_ft, 4 AS n_points,
 degrees(2.0 * atan(exp(ln(tan(pi() / 4 + radians(lat) / 2)) + 40.0 / 6378137.0::DOUBLE)) - pi() / 2) AS lat, lon + degrees(130.0 / 6378137.0::DOUBLE) AS lon FROM stops WHERE p_size NOT IN (10, 20)""",
    "truck_pct length_ft lat lon")
PLACES["replaced_table"] = q("otp", "SELECT month, count(DISTINCT route_id) AS n_routes, avg(otp) AS mean_otp FROM otp GROUP BY 1", "mean_otp")
PLACES["feature_array_scan"] = PLACES["feature_scan"]
PLACES["republished_table"] = PLACES["replaced_table"]
PLACES["published_load"] = q("lines routes stops stop_reference otp ridership", """
SELECT 'routes' AS table_name, count(DISTINCT route_id) AS n_rows, count(*) - count(DISTINCT route_id) AS n_extra FROM routes
UNION ALL SELECT 'stops', count(DISTINCT stop_id), count(*) - count(DISTINCT stop_id) FROM stops
UNION ALL SELECT 'route_stops', count(DISTINCT (route_id, stop_id, l_linestatus = 'F')), count(*) - count(DISTINCT (route_id, stop_id, l_linestatus = 'F')) FROM lines
UNION ALL SELECT 'stop_reference', count(DISTINCT stop_id), count(*) - count(DISTINCT stop_id) FROM stop_reference
UNION ALL SELECT 'otp_monthly', count(DISTINCT (route_id, month)), count(*) - count(DISTINCT (route_id, month)) FROM otp
UNION ALL SELECT 'ridership_monthly', count(DISTINCT (route_id, month, day_type)), count(*) - count(DISTINCT (route_id, month, day_type)) FROM ridership""")
PLACES["line_ends"] = PLACES["csv_round_trip"]
PLACES["entity_extracts"] = q("routes otp route_stops stops stop_reference", """
SELECT 'routes' AS source, 'id or mode' AS finding, route_id || '|' || route_name || '|' || mode AS detail FROM routes WHERE route_id IN ('20', '70') OR mode = 'INCLINE'
UNION ALL SELECT 'otp_monthly', 'rows', route_id || '|' || month FROM otp WHERE route_id IN ('20', '70')
UNION ALL SELECT 'otp_monthly', 'positive values', route_id || '|' || month FROM otp WHERE route_id IN ('20', '70') AND otp > 0
UNION ALL SELECT 'route_stops', 'rows', route_id || '|' || stop_id FROM route_stops WHERE route_id IN ('20', '70')
UNION ALL SELECT 'stops', 'name match', stop_name FROM stops WHERE lower(stop_name) LIKE '%ring%' OR lower(stop_name) LIKE '%bolt%'
UNION ALL SELECT 'stop_reference', 'mode or name match', stop_name FROM stop_reference WHERE mode = 'INCLINE' OR lower(stop_name) LIKE '%ring%' OR lower(stop_name) LIKE '%bolt%'""")
