"""DuckDB twins of the registered queries, keyed by query name. Each runs over the whole tables."""

from __future__ import annotations

from oracle.kit import CORR_FLOATS, FIT, FIT_FLOATS, chi2_p, corr, correlation, gap, nested, ols, q, r_p, t_p, z_p
from oracle.prelude import MODE, ROUTE, SUBTYPE

TWINS: dict[str, str] = {}
CORR = "n, pearson_r, pearson_p, spearman_r, spearman_p"
NESTED = "f_stat, f_p, k_diff, n, r_squared_base, r_squared_full"
NESTED_FLOATS = "f_stat f_p r_squared_base r_squared_full"
BASE, RECOVERY = ("1995-01", "1996-02"), ("1999-01", "2000-10")
STRATA = "(SELECT *, 'all' AS stratum FROM {r} UNION ALL SELECT *, 'bus' FROM {r} WHERE mode = 'BUS')"


def sub(r: str) -> str:
    return SUBTYPE.format(r=r)


def wavg(v: str, w: str) -> str:
    return f"sum({v} * {w}) / nullif(CAST(sum({w}) AS DOUBLE), 0)"


def wavg_or_mean(v: str, w: str) -> str:
    return f"CASE WHEN CAST(sum({w}) AS DOUBLE) > 0 THEN sum({v} * {w}) / CAST(sum({w}) AS DOUBLE) ELSE avg({v}) END"


def strata(r: str) -> str:
    return STRATA.format(r=r)


def ranked(v: str, part: str = "", desc: bool = False) -> str:
    """Average rank of non-NULL values."""
    keys = f"PARTITION BY {part}" if part else ""
    both = f"PARTITION BY {part + ', ' if part else ''}{v}"
    return (f"CASE WHEN {v} IS NOT NULL THEN rank() OVER ({keys} ORDER BY {v} {'DESC' if desc else ''} NULLS LAST) "
            f"+ (count(*) OVER ({both}) - 1) / 2.0 END")


def mann_whitney(rows: str, value: str, first: str, two_sided: bool) -> str:
    """One row n1, n2, u, p; ``first`` marks the first group among ``rows``."""
    larger = "greatest(u, n1 * n2 - u)" if two_sided else "u"
    tail = z_p("z")
    return f"""SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, u, least(1.0, {'2 * ' if two_sided else ''}{tail}) AS p FROM (
      SELECT *, ({larger} - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM (
      SELECT r1 - n1 * (n1 + 1) / 2 AS u, n1, n - n1 AS n2, n, (SELECT sum(pow(c, 3) - c) FROM (SELECT count(*) AS c FROM {rows} GROUP BY round({value}, 12))) AS ties
      FROM (SELECT sum(rk) FILTER (WHERE f) AS r1, CAST(count(*) FILTER (WHERE f) AS DOUBLE) AS n1, CAST(count(*) AS DOUBLE) AS n FROM (
        SELECT {first} AS f, {ranked('v')} AS rk FROM (SELECT *, round({value}, 12) AS v FROM {rows})))))"""


def kruskal(rows: str, value: str, group: str, by: str = "", min_group: int = 3) -> str:
    """One row n_groups, n, h, p per ``by`` group."""
    b = by or "''"
    return f"""SELECT g{' AS ' + by if by else ''}, n_groups, n, h, {chi2_p('h', '(n_groups - 1)')} AS p FROM (
      SELECT g, n_groups, CAST(n AS BIGINT) AS n, (12 / (n * (n + 1)) * rr - 3 * (n + 1)) / nullif(1 - ties / (n * n * n - n), 0) AS h FROM (
        SELECT g, count(*) AS n_groups, sum(size) AS n, sum(r * r / size) AS rr, max(ties) AS ties FROM (
          SELECT g, k, CAST(count(*) AS DOUBLE) AS size, sum(rk) AS r, max(ties) AS ties FROM (
            SELECT g, k, {ranked('v', 'g')} AS rk, sum(tie) OVER (PARTITION BY g) AS ties FROM (
              SELECT *, pow(count(*) OVER (PARTITION BY g, v), 2) - 1 AS tie FROM (
                SELECT {b} AS g, {group} AS k, round({value}, 12) AS v, count(*) OVER (PARTITION BY {b}, {group}) AS size FROM {rows}
                WHERE {value} IS NOT NULL AND {group} IS NOT NULL) WHERE size >= {min_group}))
          GROUP BY g, k) GROUP BY g) WHERE n_groups >= 2)"""


# --- system series ----------------------------------------------------------------------------

TWINS["system_trend"] = q("otp schedule route_stops routes", f"""
SELECT stratum, month, weighted_otp, unweighted_otp, route_count, pct_time_varying,
  weighted_otp - lag(weighted_otp, 12) OVER (PARTITION BY stratum ORDER BY month) AS yoy_change FROM (
  SELECT stratum, month, {wavg_or_mean('otp', 'w')} AS weighted_otp, avg(otp) AS unweighted_otp,
    count(DISTINCT route_id) AS route_count, count(sched) * 100.0 / count(*) AS pct_time_varying FROM {strata('base')} GROUP BY 1, 2)""",
    "weighted_otp unweighted_otp pct_time_varying yoy_change", """
base AS (SELECT o.route_id, o.month, o.otp, r.mode, s.daily_trips AS sched, coalesce(CAST(s.daily_trips AS DOUBLE), p.peak, 0.0) AS w
  FROM otp o LEFT JOIN schedule s ON s.route_id = o.route_id AND s.month = o.month AND s.day_type = 'WEEKDAY'
  LEFT JOIN (SELECT route_id, max(trips_7d) / 7.0::DOUBLE AS peak FROM route_stops GROUP BY 1) p ON p.route_id = o.route_id
  LEFT JOIN routes r ON r.route_id = o.route_id)""")

_MODE_ROWS = """known AS MATERIALIZED (SELECT o.route_id, o.month, o.otp, r.mode FROM otp o JOIN routes r USING (route_id) WHERE r.mode <> 'UNKNOWN')"""
TWINS["mode_comparison"] = q("otp routes stop_visits", f"""
SELECT mode, NULL::VARCHAR AS bus_type, month, avg(otp) AS avg_otp, {wavg_or_mean('otp', 'w')} AS weighted_otp, count(DISTINCT route_id) AS route_count FROM base GROUP BY mode, month
UNION ALL SELECT mode, {sub('route_id')} AS bus_type, month, avg(otp), NULL, count(DISTINCT route_id) FROM base WHERE mode = 'BUS' GROUP BY ALL""",
    "avg_otp weighted_otp", _MODE_ROWS + """,
base AS (SELECT k.*, coalesce(v.trips_7d, 0) AS w FROM known k LEFT JOIN stop_visits v USING (route_id))""")
_MONTHLY_MODES = _MODE_ROWS + ", mm AS MATERIALIZED (SELECT mode, month, round(avg(otp), 12) AS v FROM known WHERE mode IN ('RAIL', 'BUS') GROUP BY 1, 2)"
TWINS["mode_rank_test"] = q("otp routes", f"""
SELECT t.*, (SELECT list_sort(list(v))[len(list(v)) // 2 + 1] FROM mm WHERE mode = 'RAIL') AS first_median,
  (SELECT list_sort(list(v))[len(list(v)) // 2 + 1] FROM mm WHERE mode = 'BUS') AS second_median
FROM ({mann_whitney('mm', 'v', "mode = 'RAIL'", True)}) t""", "u p first_median second_median", _MONTHLY_MODES)
TWINS["mode_gap_trend"] = q("otp routes", """
SELECT month, gap, (SELECT regr_intercept(gap, x) FROM gaps) + (SELECT regr_slope(gap, x) FROM gaps) * x AS trend FROM gaps""", "gap trend", _MODE_ROWS + """,
gaps AS (SELECT month, gap, row_number() OVER (ORDER BY month) - 1 AS x FROM (SELECT month,
  avg(otp) FILTER (WHERE mode = 'RAIL') - avg(otp) FILTER (WHERE mode = 'BUS') AS gap FROM known GROUP BY 1) WHERE gap IS NOT NULL)""")
_PAIRS = _MODE_ROWS + """,
pairs AS MATERIALIZED (SELECT b.route_id AS base_id, v.route_id AS variant_id, CASE WHEN v.route_id LIKE '%L' THEN 'local-vs-limited' ELSE 'local-vs-express' END AS pair_type,
  v.month, b.otp AS otp_base, v.otp AS otp_variant, v.otp - b.otp AS otp_diff
  FROM known v JOIN known b ON b.month = v.month AND (v.route_id = b.route_id || 'L' OR v.route_id = b.route_id || 'X'))"""
TWINS["paired_variants"] = q("otp routes", "SELECT * FROM pairs", "otp_base otp_variant otp_diff", _PAIRS)
_T975 = f"""(WITH RECURSIVE b AS (SELECT 0 AS k, 0.0::DOUBLE AS lo, 50.0::DOUBLE AS hi, (SELECT count(*) FROM pairs) - 1.0 AS nf UNION ALL
  SELECT k + 1, CASE WHEN p > 0.05 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN p > 0.05 THEN hi ELSE (lo + hi) / 2 END, nf
  FROM (SELECT *, {t_p('((lo + hi) / 2)', 'nf', 20000)} AS p FROM b) WHERE k < 45) SELECT (lo + hi) / 2 FROM b WHERE k = 45)"""
TWINS["variant_tests"] = q("otp routes", f"""
SELECT n, mean, sd, t, {t_p('t', '(n - 1.0)', 20000)} AS p, mean - crit * e AS ci_lower, mean + crit * e AS ci_upper, n_pairs, pair_mean_diff FROM (
  SELECT s.*, mean / e AS t, {_T975} AS crit,
  (SELECT count(*) FROM (SELECT DISTINCT base_id, variant_id FROM pairs)) AS n_pairs,
  (SELECT avg(m) FROM (SELECT avg(otp_diff) AS m FROM pairs GROUP BY base_id, variant_id)) AS pair_mean_diff
  FROM (SELECT count(*) AS n, avg(otp_diff) AS mean, stddev_samp(otp_diff) AS sd, stddev_samp(otp_diff) / sqrt(count(*)) AS e FROM pairs) s)""",
    "mean sd t p ci_lower ci_upper pair_mean_diff", _PAIRS)

_WEIGHTING = f"""
paired AS MATERIALIZED (SELECT o.route_id, o.month, o.otp, w.avg_riders, w.day_count, w.current_garage FROM otp o JOIN weekday w USING (route_id, month)),
kept12 AS MATERIALIZED (SELECT * FROM paired WHERE route_id IN (SELECT route_id FROM paired GROUP BY 1 HAVING count(*) >= 12))"""
_WM = _WEIGHTING + f""",
wm AS MATERIALIZED (SELECT month, avg(otp) AS unweighted_otp, {wavg_or_mean('otp', 'coalesce(v.trips_7d, 0)')} AS trip_weighted_otp,
  {wavg('otp', 'avg_riders')} AS ridership_weighted_otp, count(DISTINCT k.route_id) AS route_count, sum(avg_riders) AS total_riders
  FROM kept12 k LEFT JOIN stop_visits v ON v.route_id = k.route_id GROUP BY month)"""
TWINS["weighting_monthly"] = q("otp weekday stop_visits", "SELECT * FROM wm", "unweighted_otp trip_weighted_otp ridership_weighted_otp total_riders", _WM)
TWINS["weighting_summary"] = q("otp weekday stop_visits", """
SELECT weighting, avg(v) AS mean, median(v) AS median, stddev_samp(v) AS std, min(v) AS min, max(v) AS max FROM (
 SELECT 'unweighted' AS weighting, unweighted_otp AS v FROM wm UNION ALL SELECT 'trip_weighted', trip_weighted_otp FROM wm
 UNION ALL SELECT 'ridership_weighted', ridership_weighted_otp FROM wm) GROUP BY 1""", "mean median std min max", _WM)
TWINS["weighting_tests"] = q("otp weekday stop_visits", f"""
SELECT -m AS mean_difference, t AS paired_t_stat, {t_p('t', '(n_months - 1.0)')} AS paired_t_p, n_months, wilcoxon_stat,
 least(1.0, 2 * {z_p('abs(z)')}) AS wilcoxon_p FROM (
 SELECT m, m / (sd / sqrt(n_months)) AS t, n_months, w AS wilcoxon_stat, (w - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z
 FROM (SELECT avg(d) AS m, stddev_samp(d) AS sd, count(*) AS n_months FROM (SELECT trip_weighted_otp - ridership_weighted_otp AS d FROM wm)),
 (SELECT least(sum(rk) FILTER (WHERE d > 0), sum(rk) FILTER (WHERE d < 0)) AS w, CAST(count(*) AS DOUBLE) AS n, sum(tie) AS ties FROM (
   SELECT d, {ranked('a')} AS rk, pow(count(*) OVER (PARTITION BY a), 2) - 1 AS tie FROM (SELECT round({gap('trip_weighted_otp', 'ridership_weighted_otp')}, 12) AS d,
     abs(round({gap('trip_weighted_otp', 'ridership_weighted_otp')}, 12)) AS a FROM wm) WHERE d <> 0)))""",
    "mean_difference paired_t_stat paired_t_p wilcoxon_stat wilcoxon_p", _WM)


def centred(v: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    w = f"OVER ({p}ORDER BY month ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)"
    return f"CASE WHEN lead(1, 6) OVER ({p}ORDER BY month) IS NOT NULL AND count({v}) {w} >= 6 THEN avg({v}) {w} END"


_SYSTEM = f"""
inyears AS MATERIALIZED (SELECT *, CAST(substr(month, 6, 2) AS INT) AS month_num FROM otp WHERE month BETWEEN '1995-01' AND '2000-12'),
sys AS MATERIALIZED (SELECT month, {wavg_or_mean('otp', 'coalesce(v.trips_7d, 0)')} AS weighted_otp FROM inyears i LEFT JOIN stop_visits v ON v.route_id = i.route_id
  WHERE i.route_id IN (SELECT route_id FROM inyears GROUP BY 1 HAVING count(DISTINCT month_num) = 12) GROUP BY month)"""
TWINS["seasonal_profile"] = q("otp stop_visits", f"""
SELECT CAST(substr(month, 6, 2) AS INT) AS month_num, avg(weighted_otp - trend) AS deviation, avg(weighted_otp) AS weighted_otp FROM (
 SELECT *, {centred('weighted_otp')} AS trend FROM sys) WHERE trend IS NOT NULL GROUP BY 1""", "deviation weighted_otp", _SYSTEM)
_ELIGIBLE = """elig AS MATERIALIZED (SELECT o.route_id, r.route_name, o.month, o.otp, CAST(substr(o.month, 6, 2) AS INT) AS month_num FROM otp o JOIN routes r USING (route_id)
  WHERE o.month BETWEEN '1995-01' AND '2000-12' AND route_id IN (SELECT route_id FROM otp WHERE month BETWEEN '1995-01' AND '2000-12' GROUP BY 1 HAVING count(DISTINCT month) >= 36))"""
TWINS["seasonal_amplitude"] = q("otp routes", f"""
SELECT route_id, route_name, max(d) - min(d) AS seasonal_amplitude, first(month_num ORDER BY d DESC, month_num) AS best_month, first(month_num ORDER BY d, month_num) AS worst_month FROM (
 SELECT route_id, route_name, month_num, round(avg(otp - trend), 12) AS d FROM (SELECT *, {centred('otp', 'route_id')} AS trend FROM elig) WHERE trend IS NOT NULL GROUP BY 1, 2, 3)
GROUP BY 1, 2""", "seasonal_amplitude", _ELIGIBLE)
TWINS["seasonal_heatmap"] = q("otp routes", "SELECT route_id, route_name, " + ", ".join(
    f"avg(otp) FILTER (WHERE month_num = {m}) AS m{m:02d}" for m in range(1, 13)) + " FROM elig GROUP BY 1, 2",
    " ".join(f"m{m:02d}" for m in range(1, 13)), _ELIGIBLE)

# --- routes -----------------------------------------------------------------------------------

TWINS["entity_ranking"] = q("otp routes stop_counts", f"""
SELECT route_id, route_name, mode, months, mean_otp, std_otp, min_otp, max_otp, recent_mean_otp, slope, slope_stderr, slope_ci_lo, slope_ci_hi, slope_significant,
  slope_months, obs_span_months, stop_count, limited_data, std_otp > 2 * (SELECT median(std_otp) FROM flagged WHERE NOT limited_data) AS high_volatility,
  {ranked('_avg', desc=True)} AS rank_avg, {ranked('_slope', desc=True)} AS rank_slope, {ranked('_std')} AS rank_volatility, {ranked('_avg', 'mode', True)} AS mode_rank
FROM (SELECT *, CASE WHEN NOT limited_data THEN recent_mean_otp END AS _avg, CASE WHEN NOT limited_data THEN slope END AS _slope,
  CASE WHEN NOT limited_data THEN std_otp END AS _std FROM flagged)""",
    "mean_otp std_otp min_otp max_otp recent_mean_otp slope slope_stderr slope_ci_lo slope_ci_hi rank_avg rank_slope rank_volatility mode_rank", """
late AS (SELECT o.*, t FROM otp o JOIN (SELECT month, row_number() OVER (ORDER BY month) - 1 AS t FROM (SELECT DISTINCT month FROM otp WHERE month >= '1999-01')) USING (month)),
fit AS (SELECT route_id, count(*) AS slope_months, max(t) - min(t) + 1 AS obs_span_months, round(12 * regr_slope(otp, t), 12) AS slope,
  12 * sqrt((regr_syy(otp, t) - regr_sxy(otp, t) * regr_sxy(otp, t) / regr_sxx(otp, t)) / (count(*) - 2) / regr_sxx(otp, t)) AS slope_stderr FROM late GROUP BY 1 HAVING count(*) >= 12),
flagged AS MATERIALIZED (SELECT s.*, recent_mean_otp, slope, slope_stderr, slope - 1.96 * slope_stderr AS slope_ci_lo, slope + 1.96 * slope_stderr AS slope_ci_hi,
  (slope - 1.96 * slope_stderr > 0 OR slope + 1.96 * slope_stderr < 0) AS slope_significant, slope_months, obs_span_months, stop_count, months < 12 AS limited_data FROM (
  SELECT o.route_id, r.route_name, r.mode, count(*) AS months, avg(otp) AS mean_otp, round(stddev_samp(otp), 12) AS std_otp, min(otp) AS min_otp, max(otp) AS max_otp
  FROM otp o JOIN routes r USING (route_id) GROUP BY 1, 2, 3) s
  LEFT JOIN (SELECT route_id, round(avg(otp), 12) AS recent_mean_otp FROM otp WHERE month IN (SELECT DISTINCT month FROM otp ORDER BY 1 DESC LIMIT 12) GROUP BY 1) USING (route_id)
  LEFT JOIN fit USING (route_id) LEFT JOIN stop_counts USING (route_id))""")

_W12 = "OVER (PARTITION BY o.route_id ORDER BY o.month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"
_ANOMALY = f"""
flags AS MATERIALIZED (SELECT *, abs(z_score) > 2 AS is_anomaly FROM (SELECT *, CASE WHEN rolling_std > 1e-9 THEN (otp - rolling_mean) / rolling_std ELSE 0.0 END AS z_score,
  CASE month WHEN '1998-03' THEN 'service cut' WHEN '1998-04' THEN 'reduced service' END AS known_event FROM (
  SELECT o.route_id, r.mode, o.month, o.otp, CASE WHEN count(otp) {_W12} >= 6 THEN avg(otp) {_W12} END AS rolling_mean,
    CASE WHEN count(otp) {_W12} >= 6 THEN stddev_samp(otp) {_W12} END AS rolling_std FROM otp o JOIN routes r USING (route_id))))"""
TWINS["anomalies"] = q("otp routes", "SELECT route_id, month, otp, rolling_mean, rolling_std, z_score, is_anomaly, known_event FROM flags",
                       "otp rolling_mean rolling_std z_score", _ANOMALY)
TWINS["anomaly_rates"] = q("otp routes", """
SELECT stratum, n_tested, n_untested, n_flagged, n_drops, CAST(round(n_tested * 0.0455::DOUBLE) AS BIGINT) AS expected, n_flagged / nullif(n_tested, 0) AS rate FROM (
 SELECT stratum, count(rolling_mean) AS n_tested, count(*) - count(rolling_mean) AS n_untested, count(*) FILTER (WHERE is_anomaly) AS n_flagged,
  count(*) FILTER (WHERE is_anomaly AND z_score < 0) AS n_drops FROM (SELECT *, 'all' AS stratum FROM flags UNION ALL SELECT *, mode FROM flags) GROUP BY 1)""", "rate", _ANOMALY)
TWINS["most_flagged"] = q("otp routes", """
SELECT route_id, month, otp, z_score, is_anomaly FROM flags WHERE route_id IN (SELECT route_id FROM flags WHERE is_anomaly GROUP BY 1 ORDER BY count(*) DESC, route_id LIMIT 5)""",
    "otp z_score", _ANOMALY)

_RECOVERY = f"""
rec AS MATERIALIZED (SELECT *, {gap('current_otp', 'baseline_otp')} AS recovery_delta, current_otp / nullif(baseline_otp, 0) AS recovery_ratio,
  CASE WHEN mode = 'BUS' THEN {sub('route_id')} ELSE lower(mode) END AS subtype FROM (
  SELECT o.route_id, r.route_name, r.mode, avg(otp) AS baseline_otp, count(*) AS baseline_months FROM otp o JOIN routes r USING (route_id)
  WHERE month BETWEEN '{BASE[0]}' AND '{BASE[1]}' GROUP BY 1, 2, 3 HAVING count(*) >= 6)
  JOIN (SELECT route_id, avg(otp) AS current_otp, count(*) AS current_months FROM otp WHERE month IN (SELECT DISTINCT month FROM otp ORDER BY 1 DESC LIMIT 12)
  GROUP BY 1 HAVING count(*) >= 6) USING (route_id) LEFT JOIN stop_counts USING (route_id))"""
TWINS["recovery"] = q("otp routes stop_counts", """SELECT route_id, route_name, mode, baseline_otp, baseline_months, current_otp, current_months, stop_count,
 recovery_delta, recovery_ratio, subtype FROM rec""", "baseline_otp current_otp recovery_delta recovery_ratio", _RECOVERY)
TWINS["recovery_tests"] = q("otp routes stop_counts", f"""
SELECT n_routes, median_delta, mean_delta, n_improved, n_declined, rtm_r, {r_p('rtm_r', 'n_routes')} AS rtm_p,
 CASE WHEN n_bus > 5 THEN stops_r END AS stops_recovery_r, {r_p('stops_r', 'n_bus')} AS stops_recovery_p, k.h AS kruskal_h, k.p AS kruskal_p
FROM (SELECT count(*) AS n_routes, median(round(recovery_delta, 12)) AS median_delta, avg(recovery_delta) AS mean_delta,
 count(*) FILTER (WHERE round(recovery_delta, 12) > 0) AS n_improved, count(*) FILTER (WHERE round(recovery_delta, 12) < 0) AS n_declined,
 {corr('baseline_otp', 'recovery_delta')} AS rtm_r FROM rec),
 (SELECT count(*) AS n_bus, {corr('stop_count', 'recovery_delta')} AS stops_r FROM rec WHERE mode = 'BUS' AND stop_count IS NOT NULL),
 ({kruskal('rec', 'recovery_delta', 'subtype')}) k""", "median_delta mean_delta rtm_r rtm_p stops_recovery_r stops_recovery_p kruskal_h kruskal_p", _RECOVERY)

_DUAL = _WEIGHTING + f""",
dual AS MATERIALIZED (SELECT *, {gap('recovery_otp', 'baseline_otp')} AS otp_delta, (recovery_riders - baseline_riders) / nullif(baseline_riders, 0) AS ridership_pct_change,
  CASE WHEN mode = 'BUS' THEN {sub('route_id')} ELSE lower(mode) END AS subtype FROM (
  SELECT p.route_id, r.route_name, r.mode, avg(otp) AS baseline_otp, avg(avg_riders) AS baseline_riders, count(*) AS baseline_months
  FROM paired p JOIN routes r USING (route_id) WHERE month BETWEEN '{BASE[0]}' AND '{BASE[1]}' GROUP BY 1, 2, 3 HAVING count(*) >= 6)
  JOIN (SELECT route_id, avg(otp) AS recovery_otp, avg(avg_riders) AS recovery_riders, count(*) AS recovery_months
  FROM paired WHERE month BETWEEN '{RECOVERY[0]}' AND '{RECOVERY[1]}' GROUP BY 1 HAVING count(*) >= 6) USING (route_id))"""
TWINS["dual_recovery"] = q("otp weekday routes", """SELECT route_id, route_name, mode, baseline_otp, recovery_otp, baseline_riders, recovery_riders, baseline_months,
 recovery_months, otp_delta, ridership_pct_change, subtype FROM dual""",
    "baseline_otp recovery_otp baseline_riders recovery_riders otp_delta ridership_pct_change", _DUAL)
TWINS["dual_recovery_tests"] = q("otp weekday routes", f"""
SELECT {CORR}, n_both_up, n_both_down, n_x_up_y_down, n_x_down_y_up, kruskal_h, kruskal_p FROM ({correlation('dual', 'ridership_pct_change', 'otp_delta')}),
 (SELECT count(*) FILTER (WHERE x > 0 AND y > 0) AS n_both_up, count(*) FILTER (WHERE x < 0 AND y < 0) AS n_both_down,
  count(*) FILTER (WHERE x > 0 AND y < 0) AS n_x_up_y_down, count(*) FILTER (WHERE x < 0 AND y > 0) AS n_x_down_y_up
  FROM (SELECT round(ridership_pct_change, 12) AS x, round(otp_delta, 12) AS y FROM dual)),
 (SELECT h AS kruskal_h, p AS kruskal_p FROM ({kruskal('dual', 'otp_delta', 'subtype')}))""", f"{CORR_FLOATS} kruskal_h kruskal_p", _DUAL)

_LATE = """
lt AS MATERIALIZED (SELECT o.route_id, r.route_name, o.month, o.otp, w.avg_riders, w.avg_riders * w.day_count * (1.0 - o.otp) AS late, w.avg_riders * w.day_count AS total
  FROM otp o JOIN weekday w USING (route_id, month) JOIN routes r USING (route_id)),
burden AS MATERIALIZED (SELECT *, 1.0 - total_late / nullif(total_trips, 0) AS effective_otp, row_number() OVER (ORDER BY total_late DESC, route_id) AS burden_rank,
  row_number() OVER (ORDER BY avg_otp, route_id) AS otp_rank FROM (
  SELECT route_id, route_name, round(sum(late), 12) AS total_late, avg(late) AS avg_monthly_late, sum(total) AS total_trips, round(avg(otp), 12) AS avg_otp,
   avg(avg_riders) AS avg_riders, count(*) AS n_months FROM lt GROUP BY 1, 2))"""
TWINS["delay_burden"] = q("otp weekday routes", """SELECT route_id, total_late, avg_monthly_late, total_trips, avg_otp, avg_riders, n_months, effective_otp, burden_rank, otp_rank FROM burden""",
    "total_late:3 avg_monthly_late:3 total_trips:3 avg_otp avg_riders:4 effective_otp", _LATE)
TWINS["delay_monthly"] = q("otp weekday routes", f"""SELECT month, sum(late) AS system_late, sum(total) AS system_total, {wavg('otp', 'avg_riders')} AS system_otp,
 count(DISTINCT route_id) AS route_count FROM lt GROUP BY 1""", "system_late:3 system_total:3 system_otp", _LATE)
TWINS["burden_summary"] = q("otp weekday routes", f"""
SELECT s.*, spearman_r, spearman_p FROM (SELECT sum(total_late) AS system_late, sum(total_trips) AS system_total, sum(total_late) / sum(total_trips) AS late_share,
 sum(total_late) FILTER (WHERE burden_rank <= 10) / sum(total_late) AS top_share FROM burden) s, ({correlation('burden', 'burden_rank', 'otp_rank')})""",
    "system_late:2 system_total:2 late_share top_share spearman_r spearman_p", _LATE)

_GARAGE = _WEIGHTING + """,
gr AS MATERIALIZED (SELECT k.route_id, k.current_garage, r.mode, avg(otp) AS avg_otp, avg(avg_riders) AS avg_riders, count(*) AS n_months
  FROM kept12 k JOIN routes r USING (route_id) GROUP BY 1, 2, 3)"""
TWINS["garage_summary"] = q("otp weekday routes", f"""SELECT current_garage, count(*) AS n_routes, avg(avg_otp) AS mean_otp, median(avg_otp) AS median_otp, stddev_samp(avg_otp) AS std_otp,
 min(avg_otp) AS min_otp, max(avg_otp) AS max_otp, sum(avg_riders) AS total_riders, {wavg('avg_otp', 'avg_riders')} AS weighted_otp FROM gr GROUP BY 1""",
    "mean_otp median_otp std_otp min_otp max_otp total_riders:4 weighted_otp", _GARAGE)
TWINS["garage_monthly"] = q("otp weekday routes", f"""SELECT current_garage, month, {wavg('otp', 'avg_riders')} AS weighted_otp, avg(otp) AS unweighted_otp, sum(avg_riders) AS total_riders,
 count(DISTINCT route_id) AS n_routes FROM kept12 GROUP BY 1, 2""", "weighted_otp unweighted_otp total_riders", _GARAGE)
TWINS["garage_tests"] = q("otp weekday routes", kruskal(strata("gr"), "avg_otp", "current_garage", "stratum"), "h p", _GARAGE)
_GARAGES = [f"garage_Garage_{i}" for i in range(1, 5)]
_GARAGE_OLS = _GARAGE + """,
gm AS MATERIALIZED (SELECT g.*, stop_count, span_km, """ + ", ".join(
    f"CASE WHEN current_garage = 'Garage {i}' THEN 1.0 ELSE 0.0 END AS garage_Garage_{i}" for i in range(1, 5)) + """
  FROM gr g JOIN stop_counts USING (route_id) JOIN spans USING (route_id) WHERE mode = 'BUS'),
""" + ols("gb", "gm", "avg_otp", ["stop_count", "span_km"]) + ",\n" + ols("gf", "gm", "avg_otp", ["stop_count", "span_km", *_GARAGES])
TWINS["garage_models"] = q("otp weekday routes stop_counts spans", f"SELECT 'structure' AS model, {FIT} FROM gb_fit UNION ALL SELECT 'with_garages', {FIT} FROM gf_fit", FIT_FLOATS, _GARAGE_OLS)
TWINS["garage_nested_test"] = q("otp weekday routes stop_counts spans", f"SELECT {NESTED} FROM ({nested('gb', 'gf')})", NESTED_FLOATS, _GARAGE_OLS)

_CONC = _WEIGHTING + f""",
cr AS (SELECT k.route_id, r.mode, round(avg(otp), 12) AS avg_otp, avg(avg_riders) AS avg_riders, count(*) AS n_months FROM kept12 k JOIN routes r USING (route_id) GROUP BY 1, 2),
placed AS MATERIALIZED (SELECT *, row_number() OVER o AS position, count(*) OVER (PARTITION BY stratum) AS total, sum(avg_riders) OVER o AS cum, sum(avg_riders) OVER (PARTITION BY stratum) AS whole
  FROM {strata('cr')} WINDOW o AS (PARTITION BY stratum ORDER BY avg_otp, route_id ROWS UNBOUNDED PRECEDING))"""
TWINS["concentration_index"] = q("otp weekday routes", """
SELECT stratum, 2 * (sum(CASE WHEN position > 1 THEN (cum / whole + (cum - avg_riders) / whole) / 2 / total END) - 0.5) AS gini,
 first(avg_otp ORDER BY position) FILTER (WHERE round(cum / whole, 12) >= 0.5) AS otp_at_50_pct, min(position) FILTER (WHERE round(cum / whole, 12) >= 0.5) AS routes_for_50_pct,
 count(*) AS n_routes FROM placed GROUP BY 1""", "gini otp_at_50_pct", _CONC)
TWINS["value_quintiles"] = q("otp weekday routes", """
SELECT stratum, 'Q' || CAST(tile AS VARCHAR) AS quintile, count(*) AS n_routes, avg(avg_otp) AS mean_otp, min(avg_otp) AS min_otp, max(avg_otp) AS max_otp, sum(avg_riders) AS total_riders,
 avg(avg_riders) AS mean_riders, sum(avg_riders) * 100 / nullif(max(whole), 0) AS ridership_share_pct FROM (
 SELECT *, ntile(5) OVER (PARTITION BY stratum ORDER BY avg_otp, route_id) AS tile FROM placed) GROUP BY 1, 2""",
    "mean_otp min_otp max_otp total_riders:4 mean_riders:4 ridership_share_pct", _CONC)

_WEEKEND = """
wk AS MATERIALIZED (SELECT *, CASE WHEN weekend_ratio < 0.3 THEN 'weekday-heavy (<0.3)' WHEN weekend_ratio <= 0.7 THEN 'balanced (0.3-0.7)' ELSE 'weekend-heavy (>0.7)' END AS service_tier FROM (
  SELECT a.*, max_wd, max_sa, max_su, CASE WHEN max_wd > 0 THEN (max_sa + max_su) / (2.0::DOUBLE * max_wd) ELSE 0.0 END AS weekend_ratio FROM route_avg a
  JOIN (SELECT route_id, max(trips_wd) AS max_wd, max(trips_sa) AS max_sa, max(trips_su) AS max_su FROM route_stops GROUP BY 1) USING (route_id)))"""
TWINS["weekend_profile"] = q("route_avg route_stops", "SELECT route_id, mode, avg_otp, max_wd, max_sa, max_su, weekend_ratio, service_tier FROM wk", "avg_otp weekend_ratio", _WEEKEND)
TWINS["weekend_profile_correlation"] = q("route_avg route_stops", f"SELECT stratum, {CORR} FROM ({correlation(strata('(SELECT * FROM wk WHERE max_wd > 0)'), 'weekend_ratio', 'avg_otp', 'stratum')})", CORR_FLOATS, _WEEKEND)
TWINS["weekend_tiers"] = q("route_avg route_stops", "SELECT service_tier, count(*) AS n, avg(avg_otp) AS mean_otp, median(avg_otp) AS median_otp FROM wk GROUP BY 1", "mean_otp median_otp", _WEEKEND)

_DELTAS = """
deltas AS MATERIALIZED (SELECT *, delta_otp - avg(delta_otp) OVER (PARTITION BY month) AS detrended_delta_otp FROM (
  SELECT *, otp - lag(otp) OVER w AS delta_otp, daily_trips - lag(daily_trips) OVER w AS delta_daily_trips FROM (
   SELECT o.route_id, o.month, r.mode, o.otp, s.daily_trips FROM otp o JOIN schedule s ON s.route_id = o.route_id AND s.month = o.month AND s.day_type = 'WEEKDAY'
   LEFT JOIN routes r ON r.route_id = o.route_id) WINDOW w AS (PARTITION BY route_id ORDER BY month)) WHERE delta_otp IS NOT NULL),
subsets AS MATERIALIZED (SELECT *, 'all' AS subset FROM deltas UNION ALL SELECT *, 'bus' FROM deltas WHERE mode = 'BUS'
  UNION ALL SELECT *, 'pre' FROM deltas WHERE month < '1998-03' UNION ALL SELECT *, 'post' FROM deltas WHERE month >= '1998-03')"""
TWINS["panel_deltas"] = q("otp schedule routes", "SELECT route_id, month, mode, otp, daily_trips, delta_otp, delta_daily_trips, detrended_delta_otp FROM deltas",
                          "otp delta_otp detrended_delta_otp", _DELTAS)
TWINS["delta_regressions"] = q("otp schedule routes", f"""
SELECT subset, slope, intercept, se, {CORR} FROM (SELECT subset, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept,
 sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)) AS se
 FROM (SELECT subset, detrended_delta_otp AS y, CAST(delta_daily_trips AS DOUBLE) AS x FROM subsets) GROUP BY 1 HAVING count(*) > 10)
JOIN ({correlation('subsets', 'delta_daily_trips', 'detrended_delta_otp', 'subset', steps=20000)}) USING (subset)""", f"slope intercept se {CORR_FLOATS}", _DELTAS)

_CHANGES = f"""
wd AS (SELECT route_id, month AS change_month, lag(pick_id) OVER w AS old_pick, pick_id AS new_pick, lag(daily_trips) OVER w AS trips_before, daily_trips AS trips_after
  FROM schedule WHERE day_type = 'WEEKDAY' WINDOW w AS (PARTITION BY route_id ORDER BY month)),
mi AS (SELECT month, row_number() OVER (ORDER BY month) AS i FROM (SELECT DISTINCT month FROM otp)),
ch AS MATERIALIZED (SELECT e.route_id, change_month, old_pick, new_pick, trips_before, trips_after, trips_after - trips_before AS trip_delta,
  avg(otp) FILTER (WHERE m.i < c.i) AS otp_before, avg(otp) FILTER (WHERE m.i >= c.i) AS otp_after, {gap('avg(otp) FILTER (WHERE m.i >= c.i)', 'avg(otp) FILTER (WHERE m.i < c.i)')} AS otp_delta,
  count(*) FILTER (WHERE m.i < c.i) AS n_before, count(*) FILTER (WHERE m.i >= c.i) AS n_after,
  CASE WHEN trips_after > trips_before THEN 'increase' WHEN trips_after < trips_before THEN 'cut' ELSE 'neutral' END AS event_type, change_month IN ('1998-04', '1998-07') AS is_covid
  FROM wd e JOIN mi c ON c.month = e.change_month JOIN otp o ON o.route_id = e.route_id JOIN mi m ON m.month = o.month AND m.i BETWEEN c.i - 3 AND c.i + 2
  WHERE old_pick IS NOT NULL AND old_pick <> new_pick GROUP BY ALL HAVING n_before >= 2 AND n_after >= 2),
chs AS MATERIALIZED (SELECT *, 'all' AS subset FROM ch UNION ALL SELECT *, 'excluding_covid' FROM ch WHERE NOT is_covid)"""
TWINS["schedule_change_impact"] = q("schedule otp", "SELECT * FROM ch", "otp_before otp_after otp_delta", _CHANGES)
TWINS["schedule_change_summary"] = q("schedule otp", """SELECT event_type, count(*) AS n, avg(otp_delta) AS mean_otp_delta, median(otp_delta) AS median_otp_delta,
 stddev_samp(otp_delta) AS std_otp_delta, avg(trip_delta) AS mean_trip_delta FROM ch GROUP BY 1""", "mean_otp_delta median_otp_delta std_otp_delta mean_trip_delta", _CHANGES)
TWINS["schedule_change_tests"] = q("schedule otp", f"""
SELECT subset, mean_delta, t, t_p, kruskal_h, kruskal_p, {CORR} FROM (SELECT subset, mean_delta, t, {t_p('t', '(c - 1.0)', 20000)} AS t_p FROM (
  SELECT subset, count(*) AS c, avg(otp_delta) AS mean_delta, avg(otp_delta) / (stddev_samp(otp_delta) / sqrt(count(*))) AS t FROM chs GROUP BY 1))
LEFT JOIN (SELECT subset, h AS kruskal_h, p AS kruskal_p FROM ({kruskal('chs', 'otp_delta', 'event_type', 'subset', 2)})) USING (subset)
JOIN ({correlation('chs', 'trip_delta', 'otp_delta', 'subset', steps=20000)}) USING (subset)""", f"mean_delta t t_p kruskal_h kruskal_p {CORR_FLOATS}", _CHANGES)
