"""DuckDB SQL of point derivation and of what is computed from derived points, for comparison."""

from __future__ import annotations

from .adapters import view_sql

_MAX = "(80e0 / 36e-1)"
_SLOW = "(2e0 / 36e-1)"


def hav(a: str, b: str, c: str, d: str) -> str:
    x = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * 6371008.8e0 * atan2(sqrt({x}), sqrt(1 - {x})))"


_RISE = "CASE WHEN {up} >= 3 THEN {up} ELSE 0e0 END AS gain_m, CASE WHEN {up} <= -3 THEN -({up}) ELSE 0e0 END AS loss_m"

#: No reading follows the cadence: in the view ``points`` the two are never within 8 of each other.
_FREE = "flagged AS (SELECT *, false AS locked FROM derived)"


def derived_sql(source: str = "points", flagged: str = _FREE) -> str:
    """The derived points of a view as a chain of common tables that ends with ``sensor``; the acceptance pass is a recursion over positions."""
    return f"""
WITH RECURSIVE points AS ({view_sql(source)}
), w1 AS (
  SELECT *, lag(ms) OVER s AS pms, lag(latitude) OVER s AS plat, lag(longitude) OVER s AS plon, first_value(ms) OVER s AS fms FROM points
  WINDOW s AS (PARTITION BY track_id, segment_position ORDER BY position)
), w2 AS (
  SELECT *, CASE WHEN ms - fms <= 60000 AND ms > pms AND {hav("plat", "plon", "latitude", "longitude")} / ((ms - pms) / 1000e0) > {_MAX} THEN position END AS cut FROM w1
), pts AS (SELECT * EXCLUDE (pms, plat, plon, fms, cut), coalesce(position < max(cut) OVER (PARTITION BY track_id, segment_position), false) AS gps_warmup FROM w2
), rec AS (
  SELECT track_id, position, NOT gps_warmup AS valid, NULL::DOUBLE AS derived_speed_mps, 0e0 AS gps_delta_m, NULL::BIGINT AS gps_delta_ms, NULL::DOUBLE AS up,
    CASE WHEN NOT gps_warmup THEN segment_position END AS a_seg, latitude AS a_lat, longitude AS a_lon, ms AS a_ms, elevation_m AS a_ele, NULL::DOUBLE AS q_lat, NULL::DOUBLE AS q_lon, NULL::BIGINT AS q_ms, NULL::DOUBLE AS q_ele
  FROM pts WHERE position = 0
  UNION ALL
  SELECT track_id, position, verdict IN ('fresh', 'anchor', 'pending'),
    CASE verdict WHEN 'anchor' THEN va WHEN 'reject' THEN va WHEN 'pending' THEN vq END, CASE verdict WHEN 'anchor' THEN da WHEN 'pending' THEN dq ELSE 0e0 END,
    CASE verdict WHEN 'anchor' THEN ms - a_ms WHEN 'pending' THEN ms - q_ms END, CASE verdict WHEN 'anchor' THEN elevation_m - a_ele WHEN 'pending' THEN elevation_m - q_ele END,
    CASE WHEN verdict IN ('fresh', 'anchor', 'pending') THEN segment_position ELSE a_seg END, CASE WHEN verdict IN ('fresh', 'anchor', 'pending') THEN latitude ELSE a_lat END,
    CASE WHEN verdict IN ('fresh', 'anchor', 'pending') THEN longitude ELSE a_lon END, CASE WHEN verdict IN ('fresh', 'anchor', 'pending') THEN ms ELSE a_ms END, CASE WHEN verdict IN ('fresh', 'anchor', 'pending') THEN elevation_m ELSE a_ele END,
    CASE verdict WHEN 'reject' THEN latitude WHEN 'warm' THEN q_lat END, CASE verdict WHEN 'reject' THEN longitude WHEN 'warm' THEN q_lon END, CASE verdict WHEN 'reject' THEN ms WHEN 'warm' THEN q_ms END, CASE verdict WHEN 'reject' THEN elevation_m WHEN 'warm' THEN q_ele END
  FROM (
    SELECT *, CASE WHEN gps_warmup THEN 'warm' WHEN a_seg IS DISTINCT FROM segment_position THEN 'fresh' WHEN NOT coalesce(va > {_MAX}, false) THEN 'anchor'
      WHEN q_ms IS NOT NULL AND NOT coalesce(vq > {_MAX}, false) THEN 'pending' ELSE 'reject' END AS verdict
    FROM (SELECT *, CASE WHEN ms > a_ms THEN da / ((ms - a_ms) / 1000e0) END AS va, CASE WHEN ms > q_ms THEN dq / ((ms - q_ms) / 1000e0) END AS vq
      FROM (SELECT p.*, a_seg, a_lat, a_lon, a_ms, a_ele, q_lat, q_lon, q_ms, q_ele, {hav("a_lat", "a_lon", "p.latitude", "p.longitude")} AS da, {hav("q_lat", "q_lon", "p.latitude", "p.longitude")} AS dq
        FROM rec JOIN pts p ON p.track_id = rec.track_id AND p.position = rec.position + 1))
  )
), acc AS (
  SELECT pts.*, rec.valid, derived_speed_mps, gps_delta_m, gps_delta_ms, {_RISE.format(up="up")},
    CASE WHEN count(sensor_distance_m) OVER t >= 9e-1 * count(*) OVER t THEN 'odometer' WHEN count(sensor_speed_mps) OVER t >= 9e-1 * count(*) OVER t THEN 'wheel_speed' ELSE 'gps' END AS distance_source,
    CASE WHEN count(sensor_speed_mps) OVER t >= 9e-1 * count(*) OVER t THEN 'sensor' ELSE 'gps' END AS speed_source,
    CASE WHEN lag(segment_position) OVER o = segment_position THEN ms - lag(ms) OVER o END AS dt, sensor_distance_m - lag(sensor_distance_m) OVER o AS odo, lag(rec.valid) OVER o AS was_valid,
    coalesce(lag(segment_position) OVER o = segment_position, false) AS same
  FROM pts JOIN rec ON rec.track_id = pts.track_id AND rec.position = pts.position
  WINDOW t AS (PARTITION BY pts.track_id), o AS (PARTITION BY pts.track_id ORDER BY pts.position)
), cred AS (
  SELECT *, CASE WHEN distance_source = 'gps' THEN CASE WHEN valid THEN gps_delta_m ELSE 0e0 END
      WHEN dt > 0 THEN CASE WHEN odo >= 0 AND odo / (dt / 1000e0) <= {_MAX} THEN odo WHEN sensor_speed_mps <= {_MAX} AND dt <= 30000 THEN sensor_speed_mps * (dt / 1000e0) WHEN valid AND was_valid AND gps_delta_ms = dt THEN gps_delta_m ELSE 0e0 END
      ELSE 0e0 END AS delta_m,
    CASE WHEN distance_source = 'gps' THEN CASE WHEN valid THEN gps_delta_ms END WHEN dt > 0 THEN dt END AS delta_ms
  FROM acc
), cum AS (
  SELECT *, sum(delta_m) OVER (PARTITION BY track_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS cumulative_m,
    CASE WHEN delta_ms > 0 AND delta_m / (delta_ms / 1000e0) >= {_SLOW} THEN delta_ms ELSE 0 END AS moving_ms,
    CASE WHEN valid THEN coalesce(derived_speed_mps, recorded_speed_mps) END AS gps_speed_mps
  FROM cred
), derived AS (
  SELECT * EXCLUDE (back), CASE WHEN sensor_speed_mps <= {_MAX} THEN sensor_speed_mps ELSE gps_speed_mps END AS speed_mps,
    greatest(least((elevation_m - back.e) / (cumulative_m - back.c) * 100, 40e0), -40e0) + CASE WHEN elevation_m - back.e IS NULL THEN NULL ELSE 0 END AS grade_percent
  FROM (SELECT *, max({{'p': position, 'c': cumulative_m, 'e': elevation_m}}) OVER (PARTITION BY track_id, segment_position ORDER BY cumulative_m RANGE BETWEEN UNBOUNDED PRECEDING AND 100 PRECEDING) AS back FROM cum)
), timing AS (SELECT * FROM derived WHERE valid OR distance_source <> 'gps'
), {flagged}, spans AS (
  SELECT *, coalesce(both_hr, false) AS hr_ok, CASE WHEN both_hr THEN (h0 + h1) / 2 * dt_ms / 1000e0 END AS area,
    coalesce(both_hr AND moving AND start_ms >= 300000 AND start_ms - since >= 60000 AND NOT jumped, false) AS eligible
  FROM (
    SELECT *, max(CASE WHEN moving AND NOT coalesce(was_moving, false) THEN start_ms END) OVER (PARTITION BY track_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS since
    FROM (
      SELECT *, lag(moving) OVER (PARTITION BY track_id ORDER BY position) AS was_moving FROM (
        SELECT *, ok AND coalesce(speed >= {_SLOW}, false) AS moving FROM (
          SELECT *, coalesce(same AND dt_ms > 0 AND dt_ms <= 30000, false) AS ok, h0 IS NOT NULL AND h1 IS NOT NULL AND NOT locked AND NOT was_locked AS both_hr, jump OR coalesce(lag(jump) OVER (PARTITION BY track_id ORDER BY position), false) AS jumped
          FROM (
            SELECT track_id, segment_position, position, same, lag(ms) OVER o - min(ms) OVER (PARTITION BY track_id) AS start_ms, ms - min(ms) OVER (PARTITION BY track_id) AS end_ms, ms - lag(ms) OVER o AS dt_ms,
              lag(heart_rate_bpm) OVER o AS h0, heart_rate_bpm AS h1, locked, coalesce(lag(locked) OVER o, false) AS was_locked, lag(cumulative_m) OVER o AS d0, cumulative_m AS d1, CASE WHEN sensor_speed_mps <= {_MAX} THEN sensor_speed_mps WHEN valid THEN derived_speed_mps END AS speed, grade_percent AS grade,
              coalesce(same AND ms - lag(ms) OVER o BETWEEN 1 AND 10000 AND abs(heart_rate_bpm - lag(heart_rate_bpm) OVER o) > 30, false) AS jump
            FROM flagged WINDOW o AS (PARTITION BY track_id ORDER BY position)
          )
        )
      )
    )
  ) WHERE ok
), bins AS (
  SELECT track_id, CAST(bpm AS INTEGER) AS bpm, sum(s * CASE WHEN hi = lo THEN 1e0 ELSE greatest(least(hi, bpm + 1) - greatest(lo, bpm), 0e0) / (hi - lo) END) AS seconds
  FROM (SELECT track_id, least(h0, h1) AS lo, greatest(h0, h1) AS hi, dt_ms / 1000e0 AS s, unnest(generate_series(CAST(floor(least(h0, h1)) AS BIGINT), CAST(floor(greatest(h0, h1)) AS BIGINT))) AS bpm FROM spans WHERE hr_ok)
  GROUP BY ALL HAVING seconds > 0
), sensor AS (
  SELECT *, cadence IS NOT NULL AND moving AS turning, coalesce(moving AND cadence >= 1, false) AS pedalling FROM (
    SELECT *, coalesce(device_speed, gps_speed) AS speed, coalesce(coalesce(device_speed, gps_speed) >= {_SLOW}, false) AS moving FROM (
      SELECT track_id, position, same, (ms - lag(ms) OVER o) / 1000e0 AS s, cadence_rpm AS cadence, sensor_speed_mps AS device_speed, lag(sensor_speed_mps) OVER o AS device_before,
        CASE WHEN sensor_distance_m - lag(sensor_distance_m) OVER o >= 0 THEN sensor_distance_m - lag(sensor_distance_m) OVER o END AS device_m, valid AND derived_speed_mps IS NOT NULL AS located,
        CASE WHEN valid THEN derived_speed_mps END AS gps_speed, gps_delta_m AS gps_m, grade_percent AS grade
      FROM derived WINDOW o AS (PARTITION BY track_id ORDER BY position)
    ) WHERE same AND s > 0 AND s <= 30
  )
)
"""


def _linked(name: str, match: str, within: str) -> str:
    """Runs of matching points: neighbours at most 4 s apart, and all between them pedalled and ``within`` 3 s."""
    return f"""{name}_pair AS (SELECT track_id, position, segment_position, ms, lead(position) OVER w AS nxt, lead(ms) OVER w AS nms, lead(segment_position) OVER w AS nseg FROM near WHERE {match} WINDOW w AS (PARTITION BY track_id ORDER BY position)
), {name}_link AS (SELECT i.track_id, i.nxt FROM {name}_pair i LEFT JOIN near k ON k.track_id = i.track_id AND k.position > i.position AND k.position < i.nxt AND NOT (k.turned AND k.segment_position = i.segment_position AND {within} BETWEEN 1 AND 3000)
  WHERE i.nseg = i.segment_position AND i.nms - i.ms BETWEEN 1 AND 4000 GROUP BY i.track_id, i.nxt HAVING count(k.position) = 0
), {name} AS (SELECT *, min(position) OVER (PARTITION BY track_id, run) AS a, max(position) OVER (PARTITION BY track_id, run) AS b FROM (
  SELECT p.track_id, p.position, p.ms, sum(CASE WHEN l.nxt IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.track_id ORDER BY p.position) AS run FROM {name}_pair p LEFT JOIN {name}_link l ON l.track_id = p.track_id AND l.nxt = p.position))"""


_LOCKED = f"""near AS (SELECT track_id, position, segment_position, ms, coalesce(cadence_rpm > 0 AND heart_rate_bpm IS NOT NULL, false) AS turned, coalesce(cadence_rpm > 0, false) AND coalesce(abs(heart_rate_bpm - cadence_rpm), 99) <= 3 AS tight, coalesce(cadence_rpm > 0, false) AND coalesce(abs(heart_rate_bpm - cadence_rpm), 99) <= 8 AS loose FROM derived
), {_linked("core", "tight", "k.ms - i.ms")}, {_linked("ahead", "loose", "k.ms - i.ms")}, {_linked("behind", "loose", "i.nms - k.ms")}
, reach AS (SELECT c.track_id, x.a, y.b FROM (SELECT track_id, min(position) AS p, max(position) AS q FROM core GROUP BY track_id, run HAVING max(ms) - min(ms) >= 60000) c JOIN behind x ON x.track_id = c.track_id AND x.position = c.p JOIN ahead y ON y.track_id = c.track_id AND y.position = c.q
), flagged AS (SELECT *, EXISTS (SELECT 1 FROM reach r WHERE r.track_id = derived.track_id AND derived.position BETWEEN r.a AND r.b) AS locked FROM derived)"""
RIDES = derived_sql("rides", _LOCKED)

_GAIN = """
climbed AS (SELECT *, sum(rise) OVER (PARTITION BY track_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS up FROM (
  SELECT *, greatest(coalesce(elevation_m - lag(elevation_m) OVER (PARTITION BY track_id ORDER BY position), 0e0), 0e0) AS rise FROM timing))
"""


def mean(value: str, which: str = "true", weight: str = "s") -> str:
    """The weighted mean over rows that are ``which``."""
    return f"sum({value} * {weight}) FILTER ({which}) / nullif(sum({weight}) FILTER ({which} AND {value} IS NOT NULL), 0)"


_N = 4
_R = lambda x, name: f"round({x}, {_N}) AS {name}"

POINTS = {
    "points_derived": f"SELECT track_id, position, valid, gps_warmup, {_R('derived_speed_mps', 'derived_speed_mps')}, {_R('delta_m', 'delta_m')}, delta_ms, {_R('cumulative_m', 'cumulative_m')}, moving_ms, {_R('grade_percent', 'grade_percent')}, distance_source, speed_source, {_R('gain_m', 'gain_m')}, {_R('loss_m', 'loss_m')}, {_R('speed_mps', 'speed_mps')} FROM derived",
    "kilometre_splits": f""", {_GAIN}, marks AS (
  SELECT track_id, k, min(position) AS first_at, max(total) AS total FROM (SELECT *, max(cumulative_m) OVER (PARTITION BY track_id) AS total FROM climbed), generate_series(0, 200) g(k) WHERE cumulative_m >= k * 1000 AND k * 1000 <= total GROUP BY ALL
), marked AS (SELECT m.track_id, k, ms, up FROM marks m JOIN climbed c ON c.track_id = m.track_id AND c.position = m.first_at)
SELECT a.track_id, CAST(b.k AS INTEGER) AS position, {_R('a.k * 1000e0', 'start_distance_m')}, {_R('b.k * 1000e0', 'end_distance_m')}, {_R('(b.ms - a.ms) / 1000e0', 'duration_s')}, 1000e0 AS distance_m, {_R('1000e0 / ((b.ms - a.ms) / 1000e0)', 'avg_speed_mps')},
  {_R('greatest((SELECT max(c.up) FROM climbed c WHERE c.track_id = a.track_id AND c.cumulative_m <= b.k * 1000) - a.up, 0e0)', 'elevation_gain_m')}
FROM marked a JOIN marked b ON a.track_id = b.track_id AND b.k = a.k + 1""",
    "best_efforts": f""", {_GAIN}, ends AS (
  SELECT a.track_id, d, a.position AS i, a.ms AS ms, a.cumulative_m AS c, min(b.position) AS j FROM climbed a JOIN climbed b ON a.track_id = b.track_id AND a.segment_position = b.segment_position AND b.position > a.position,
    (VALUES (1000), (5000), (10000), (20000), (40000)) t(d) WHERE b.cumulative_m >= a.cumulative_m + d GROUP BY ALL
), best AS (SELECT e.*, b.ms - e.ms AS took, b.cumulative_m AS c2, row_number() OVER (PARTITION BY e.track_id, d ORDER BY b.ms - e.ms, i) AS rn FROM ends e JOIN climbed b ON b.track_id = e.track_id AND b.position = j WHERE b.ms > e.ms)
SELECT track_id, d AS position, {_R('c', 'start_distance_m')}, {_R('c2', 'end_distance_m')}, {_R('took / 1000e0', 'duration_s')}, CAST(d AS DOUBLE) AS distance_m, {_R('d / (took / 1000e0)', 'avg_speed_mps')},
  {_R('(SELECT max(up) - min(up) FROM climbed c WHERE c.track_id = best.track_id AND cumulative_m BETWEEN c AND c2)', 'elevation_gain_m').replace('BETWEEN c AND', 'BETWEEN best.c AND')} FROM best WHERE rn = 1""",
    "stops": f""", isl AS (SELECT *, position - row_number() OVER (PARTITION BY track_id ORDER BY position) AS g FROM derived WHERE delta_ms > 0 AND coalesce(speed_mps, 0) < {_SLOW}
), runs AS (SELECT track_id, min(position) AS start_point_position, max(position) AS end_point_position, arg_min(cumulative_m, position) AS start_distance_m, arg_max(cumulative_m, position) AS end_distance_m, sum(delta_ms) AS took FROM isl GROUP BY track_id, g)
SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY start_point_position) - 1 AS INTEGER) AS position, start_point_position, end_point_position, {_R('start_distance_m', 'start_distance_m')}, {_R('end_distance_m', 'end_distance_m')}, {_R('took / 1000e0', 'duration_s')} FROM runs WHERE took >= 30000""",
    "climbs": f""", isl AS (SELECT *, position - row_number() OVER (PARTITION BY track_id ORDER BY position) AS g FROM derived WHERE grade_percent >= 2
), runs AS (SELECT track_id, min(position) AS start_point_position, max(position) AS end_point_position, arg_min(cumulative_m, position) AS a, arg_max(cumulative_m, position) AS b, arg_min(elevation_m, position) AS low, max(elevation_m) AS top, max(grade_percent) AS max_grade FROM isl GROUP BY track_id, g)
SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY start_point_position) - 1 AS INTEGER) AS position, start_point_position, end_point_position, {_R('a', 'start_distance_m')}, {_R('b', 'end_distance_m')}, {_R('top - low', 'gain_m')}, {_R('b - a', 'distance_m')}, {_R('(top - low) / (b - a) * 100', 'average_grade')}, {_R('max_grade', 'max_grade')} FROM runs WHERE b - a >= 300 AND top - low >= 20""",
    "segment_summary": f"SELECT track_id, track_position, segment_position, count(*) AS point_count, min(ms) AS started_ms, max(ms) AS ended_ms, {_R('sum(delta_m)', 'distance_m')} FROM derived GROUP BY ALL",
    "track_summary": f""", ends AS (SELECT track_id, arg_min(latitude, position) AS a, arg_min(longitude, position) AS b, arg_max(latitude, position) AS c, arg_max(longitude, position) AS d FROM derived WHERE valid GROUP BY track_id
), moved AS (SELECT track_id, {hav('a', 'b', 'c', 'd')} AS displacement_m FROM ends
), sums AS (SELECT track_id, count(*) AS point_count, count(DISTINCT segment_position) AS segment_count, sum(delta_m) AS distance_m, (max(ms) - min(ms)) / 1000e0 AS elapsed_s, sum(moving_ms) / 1000e0 AS moving_s, sum(gain_m) AS gain, sum(loss_m) AS loss, min(elevation_m) AS lo, max(elevation_m) AS hi,
  count(*) FILTER (NOT valid) AS bad, count(*) FILTER (gps_warmup) AS warm, count(*) FILTER (elevation_m IS NULL) AS no_ele, count(*) FILTER (hdop > 10) AS far FROM derived GROUP BY track_id)
SELECT track_id, point_count, segment_count, {_R('distance_m', 'distance_m')}, {_R('elapsed_s', 'elapsed_s')}, {_R('moving_s', 'moving_s')}, {_R('greatest(elapsed_s - moving_s, 0)', 'stopped_s')}, {_R('CASE WHEN moving_s > 0 THEN distance_m / moving_s END', 'avg_speed_mps')}, {_R('gain', 'elevation_gain_m')}, {_R('loss', 'elevation_loss_m')}, {_R('lo', 'min_elevation_m')}, {_R('hi', 'max_elevation_m')},
  {_R('greatest(0e0, 100 - 40e0 * bad / point_count - 15e0 * no_ele / point_count - 15e0 * far / point_count)', 'quality_score')}, bad - warm AS invalid_spike_points, warm AS gps_warmup_points, {_R('coalesce(displacement_m, 0e0)', 'displacement_m')},
  CASE WHEN point_count < 10 THEN 'only ' || point_count || CASE WHEN point_count = 1 THEN ' point' ELSE ' points' END WHEN distance_m < 200 THEN 'only ' || CAST(round(distance_m) AS BIGINT) || ' m long' WHEN moving_s < 60 THEN 'only ' || CAST(round(moving_s) AS BIGINT) || ' s of movement' END AS skip_reason
FROM sums LEFT JOIN moved USING (track_id)""",
    "peak_speeds": f""", nb AS (SELECT *, CASE WHEN speed_source = 'sensor' THEN CASE WHEN sensor_speed_mps <= {_MAX} THEN sensor_speed_mps END ELSE gps_speed_mps END AS readable, coalesce(sensor_speed_mps, CASE WHEN derived_speed_mps IS NOT NULL THEN recorded_speed_mps END) AS device FROM derived
), nb2 AS (SELECT *, CASE WHEN lag(segment_position) OVER o = segment_position THEN lag(readable) OVER o END AS l, CASE WHEN lead(segment_position) OVER o = segment_position THEN lead(readable) OVER o END AS r,
  CASE WHEN speed_source = 'sensor' THEN CASE WHEN sensor_speed_mps <= {_MAX} THEN sensor_speed_mps END WHEN gps_speed_mps <= {_MAX} AND (device IS NULL OR device >= gps_speed_mps * 8e-1) THEN gps_speed_mps END AS peak FROM nb WINDOW o AS (PARTITION BY track_id ORDER BY position)
), ok AS (SELECT *, coalesce(l >= peak * 8e-1, false) OR coalesce(r >= peak * 8e-1, false) AS near, coalesce(gps_delta_ms BETWEEN 1000 AND 15000, false) AS timed, coalesce(hdop <= 10, true) AS precise, coalesce(device >= gps_speed_mps * 8e-1, false) AS agrees FROM nb2 WHERE peak > 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY peak DESC, position) AS rn, quantile_disc(peak, 0.95) OVER (PARTITION BY track_id) AS p95 FROM ok)
SELECT track_id, {_R('peak', 'max_speed_mps')}, position AS max_speed_point_position, {_R('p95', 'speed_p95_mps')}, CASE WHEN speed_source = 'sensor' THEN CASE WHEN near THEN 'high' ELSE 'medium' END WHEN timed AND precise AND (agrees OR near) THEN 'high' WHEN timed AND precise THEN 'medium' ELSE 'low' END AS max_speed_confidence FROM ranked WHERE rn = 1""",
    "median_sample_seconds": f", gaps AS (SELECT track_id, ms - lag(ms) OVER (PARTITION BY track_id ORDER BY position) AS gap FROM derived), l AS (SELECT track_id, list_sort(list(gap)) AS g FROM gaps WHERE gap > 0 GROUP BY track_id) SELECT track_id, {_R('g[len(g) // 2 + 1] / 1000e0', 'median_sample_seconds')} FROM l",
    "downsampled": f"""SELECT track_id, position, hr_break FROM (SELECT *, max(brk) OVER (PARTITION BY track_id, ceil(i / step)) AS hr_break FROM (
  SELECT *, ceil(n / 20e0) AS step FROM (SELECT track_id, position, position AS i, count(*) OVER (PARTITION BY track_id) AS n,
    NOT coalesce(same AND ms - lag(ms) OVER o BETWEEN 1 AND 30000 AND lag(heart_rate_bpm) OVER o IS NOT NULL AND heart_rate_bpm IS NOT NULL, false) AS brk FROM derived WINDOW o AS (PARTITION BY track_id ORDER BY position))))
WHERE i % step = 0 OR i = n - 1""",
    "hr_summary": f""", own AS (SELECT track_id, count(heart_rate_bpm) AS sample_count, min(heart_rate_bpm) AS minimum_bpm, max(heart_rate_bpm) AS maximum_bpm, (max(ms) - min(ms)) / 1000e0 AS elapsed, min(ms) AS t0 FROM derived GROUP BY track_id
), peak AS (SELECT track_id, position AS peak_position, row_number() OVER (PARTITION BY track_id ORDER BY heart_rate_bpm DESC, position) AS rn FROM derived WHERE heart_rate_bpm IS NOT NULL
), cov AS (SELECT track_id, coalesce(sum(dt_ms) FILTER (hr_ok), 0) / 1000e0 AS covered_s, coalesce(sum(dt_ms) FILTER (hr_ok AND moving), 0) / 1000e0 AS moving_covered_s, sum(area) FILTER (hr_ok) / (sum(dt_ms) FILTER (hr_ok) / 1000e0) AS a, sum(area) FILTER (hr_ok AND moving) / (sum(dt_ms) FILTER (hr_ok AND moving) / 1000e0) AS b FROM spans GROUP BY track_id)
SELECT track_id, sample_count, minimum_bpm, maximum_bpm, peak_position, {_R('coalesce(covered_s, 0)', 'covered_s')}, {_R('coalesce(moving_covered_s, 0)', 'moving_covered_s')}, {_R('a', 'average_bpm')}, {_R('b', 'moving_average_bpm')}, {_R('CASE WHEN elapsed > 0 THEN coalesce(covered_s, 0) * 100 / elapsed ELSE 0e0 END', 'coverage_percent')}
FROM own LEFT JOIN (SELECT * FROM peak WHERE rn = 1) USING (track_id) LEFT JOIN cov USING (track_id)""",
    "hr_histogram": f"SELECT track_id, bpm, {_R('seconds', 'seconds')} FROM bins",
    "hr_zones": f"SELECT track_id, zone, lower, CASE WHEN zone < 5 THEN upper END AS upper, {_R('coalesce(sum(seconds) FILTER (bpm >= lower AND bpm < upper), 0e0)', 'seconds')} FROM bins, (VALUES (1, 30, 114), (2, 114, 133), (3, 133, 152), (4, 152, 171), (5, 171, 241)) z(zone, lower, upper) GROUP BY ALL",
    "hr_load": f"SELECT track_id, {_R('sum(seconds / 60 * zone)', 'load')} FROM bins JOIN (VALUES (1, 30, 114), (2, 114, 133), (3, 133, 152), (4, 152, 171), (5, 171, 241)) z(zone, lower, upper) ON bpm >= lower AND bpm < upper GROUP BY track_id",
    "hr_distribution": f"SELECT track_id, CAST(bpm // 10 * 10 AS INTEGER) AS bpm, {_R('sum(seconds)', 'seconds')}, (bpm // 10 * 10) || '–' || (bpm // 10 * 10 + 9) AS label FROM bins GROUP BY track_id, bpm // 10",
    "hr_cumulative": f"SELECT track_id, bpm, {_R('sum(seconds) OVER (PARTITION BY track_id ORDER BY bpm DESC)', 'seconds_at_or_above')} FROM bins",
    "hr_sectors": f""", total AS (SELECT track_id, max(cumulative_m) AS d FROM derived GROUP BY track_id)
SELECT track_id, CAST(least(floor(round((d0 + d1) / 2 / d * 64, 9)), 63) AS INTEGER) AS "index", {_R('sum(dt_ms) / 1000e0', 'moving_s')}, {_R('coalesce(sum(dt_ms) FILTER (eligible), 0) / 1000e0', 'eligible_s')}, {_R('sum(area) FILTER (eligible) / (sum(dt_ms) FILTER (eligible) / 1000e0)', 'average_bpm')}, {_R('sum(speed * dt_ms) FILTER (eligible) / sum(dt_ms) FILTER (eligible) * 36e-1', 'speed_kmh')}, {_R('min(start_ms) / 1000e0', 'start_s')}, {_R('max(end_ms) / 1000e0', 'end_s')}
FROM spans JOIN total USING (track_id) WHERE moving AND start_ms >= 300000 AND d > 0 GROUP BY track_id, 2""",
    "hr_selection": f""", cl AS (SELECT track_id, hr_ok, moving, speed, a, b, h0 + (h1 - h0) * ((a - start_ms) / dt_ms) AS h0, h0 + (h1 - h0) * ((b - start_ms) / dt_ms) AS h1, (d1 - d0) * ((b - start_ms) / dt_ms) - (d1 - d0) * ((a - start_ms) / dt_ms) AS d
  FROM (SELECT *, greatest(start_ms, 63000e0) AS a, least(end_ms, 240500e0) AS b FROM spans WHERE end_ms > 63000 AND start_ms < 240500))
SELECT track_id, 177.5e0 AS duration_s, {_R('coalesce(sum(b - a) FILTER (hr_ok), 0) / 1000e0', 'covered_s')}, {_R('sum((h0 + h1) / 2 * (b - a)) FILTER (hr_ok) / sum(b - a) FILTER (hr_ok)', 'average_bpm')}, {_R('max(greatest(h0, h1)) FILTER (hr_ok)', 'maximum_bpm')}, {_R('arg_max(h1, a) FILTER (hr_ok) - arg_min(h0, a) FILTER (hr_ok)', 'change_bpm')}, {_R('sum(greatest(d, 0e0))', 'distance_m')}, {_R('sum(speed * (b - a)) FILTER (moving) / sum(b - a) FILTER (moving) * 36e-1', 'speed_kmh')} FROM cl GROUP BY track_id""",
    "cadence_summary": f""", own AS (SELECT track_id, count(cadence_rpm) AS sample_count, max(cadence_rpm) AS maximum_rpm FROM derived GROUP BY track_id HAVING count(cadence_rpm) > 0
), c AS (SELECT track_id, sum(s) FILTER (cadence IS NOT NULL) AS covered_s, sum(s) FILTER (turning) AS moving_s, sum(s) FILTER (pedalling) AS pedaling_s, {mean('cadence', 'pedalling')} AS a, {mean('cadence', 'turning')} AS b, sum(cadence * s / 60) AS revolutions FROM sensor GROUP BY track_id)
SELECT track_id, sample_count, maximum_rpm, {_R('coalesce(covered_s, 0e0)', 'covered_s')}, {_R('coalesce(moving_s, 0e0)', 'moving_s')}, {_R('coalesce(pedaling_s, 0e0)', 'pedaling_s')}, {_R('coalesce(moving_s, 0e0) - coalesce(pedaling_s, 0e0)', 'coasting_s')}, {_R('a', 'average_rpm')}, {_R('b', 'moving_average_rpm')}, {_R('coalesce(revolutions, 0e0)', 'revolutions')}, {_R('(moving_s - coalesce(pedaling_s, 0)) * 100 / nullif(moving_s, 0)', 'coasting_percent')} FROM own LEFT JOIN c USING (track_id)""",
    "cadence_histogram": f"SELECT track_id, CAST(floor(cadence / 10) * 10 AS INTEGER) AS rpm, {_R('sum(s)', 'seconds')}, {_R(mean('speed') + ' * 36e-1', 'speed_kmh')} FROM sensor WHERE pedalling GROUP BY track_id, 2",
    "terrain": f"""SELECT track_id, band, {_R('coalesce(sum(s) FILTER (inside), 0e0)', 'seconds')}, {_R(mean('cadence', 'inside AND pedalling'), 'average_rpm')}, {_R('(sum(s) FILTER (inside) - coalesce(sum(s) FILTER (inside AND pedalling), 0)) / nullif(sum(s) FILTER (inside), 0) * 100', 'coasting_percent')}, {_R(mean('speed', 'inside') + ' * 36e-1', 'speed_kmh')}
FROM (SELECT *, coalesce(grade >= coalesce(low, -1000) AND grade < coalesce(high, 1000), false) AS inside FROM sensor, (VALUES ('descent', NULL, -2), ('flat', -2, 2), ('rolling', 2, 5), ('climb', 5, NULL)) t(band, low, high) WHERE turning) GROUP BY track_id, band""",
    "development": f"SELECT track_id, round(floor(m / 25e-2) * 25e-2, 2) AS meters, {_R('sum(s)', 'seconds')} FROM (SELECT track_id, s, speed * 60 / cadence AS m FROM sensor WHERE pedalling AND cadence >= 30 AND speed >= 2) WHERE m BETWEEN 1 AND 12 GROUP BY track_id, 2",
    "speed_sensor": f""", c AS (SELECT track_id, sum(s) AS covered_s, sum(s) FILTER (device_speed >= {_SLOW}) AS moving_s, count(device_m) >= 9e-1 * count(*) AND count(device_m) > 0 AS by_odo, sum(device_m) AS odo, sum(gps_m) FILTER (device_m IS NOT NULL) AS odo_gps, sum((coalesce(device_before, device_speed) + device_speed) / 2 * s) AS integ, sum(gps_m) AS gps,
  median(abs(device_speed - gps_speed) * 36e-1) FILTER (device_speed >= {_SLOW} AND gps_speed > 0) AS diff, sum(s) FILTER (NOT located AND device_speed >= {_SLOW}) AS gap FROM sensor WHERE device_speed IS NOT NULL GROUP BY track_id)
SELECT track_id, {_R('covered_s', 'covered_s')}, {_R('coalesce(moving_s, 0e0)', 'moving_s')}, CASE WHEN by_odo THEN 'device' ELSE 'integrated' END AS distance_source, {_R('CASE WHEN by_odo THEN odo ELSE integ END', 'distance_m')}, {_R('CASE WHEN by_odo THEN odo_gps ELSE gps END', 'gps_distance_m')}, {_R('diff', 'median_difference_kmh')}, {_R('coalesce(gap, 0e0)', 'gps_gap_s')} FROM c""",
}

_BITS = "CAST(floor((longitude + 180) / 360 * 262144) AS BIGINT) AS x, CAST(floor((latitude + 90) / 180 * 131072) AS BIGINT) AS y"
_DIGITS = "'0123456789bcdefghjkmnpqrstuvwxyz'"
_HASH = " || ".join("substr(" + _DIGITS + ", CAST(1 + " + " + ".join(f"(({'y' if i % 2 else 'x'} >> {(16 if i % 2 else 17) - i // 2}) & 1) * {16 >> j}" for j, i in enumerate(range(5 * k, 5 * k + 5))) + " AS BIGINT), 1)" for k in range(7))


def _number(x: str) -> str:
    """A signed number of a polyline."""
    z = f"(CASE WHEN {x} < 0 THEN -2 * ({x}) - 1 ELSE 2 * ({x}) END)"
    return f"array_to_string(list_transform(list_filter(range(0, 7), lambda k: k = 0 OR ({z} >> CAST(5 * k AS INTEGER)) > 0), lambda k: chr(CAST(63 + (({z} >> CAST(5 * k AS INTEGER)) & 31) + CASE WHEN ({z} >> CAST(5 * k + 5 AS INTEGER)) > 0 THEN 32 ELSE 0 END AS INTEGER))), '')"


def _rendering(level: str, most: int) -> str:
    return f"""SELECT track_id, '{level}' AS level, CAST(count(*) AS INTEGER) AS point_count, string_agg({_number("x - px")} || {_number("y - py")}, '' ORDER BY position) AS encoded_polyline, CAST(count(*) AS INTEGER) AS n_series
FROM (SELECT *, coalesce(lag(x) OVER o, 0) AS px, coalesce(lag(y) OVER o, 0) AS py FROM (SELECT track_id, position, CAST(round(latitude * 100000) AS BIGINT) AS x, CAST(round(longitude * 100000) AS BIGINT) AS y, count(*) OVER (PARTITION BY track_id) AS n FROM derived)
  WHERE position % CAST(ceil(n / {most}e0) AS BIGINT) = 0 OR position = n - 1 WINDOW o AS (PARTITION BY track_id ORDER BY position)) GROUP BY track_id"""


POINTS |= {
    "route_cells": f"SELECT track_id, cell, round(avg(latitude), 9) AS latitude, round(avg(longitude), 9) AS longitude, count(*) AS point_count, 7 AS precision FROM (SELECT track_id, latitude, longitude, {_HASH} AS cell FROM (SELECT *, {_BITS} FROM derived WHERE valid)) GROUP BY track_id, cell",
    "renderings": _rendering("overview", 600) + " UNION ALL " + _rendering("detail", 2500),
    "pedaling_overview": POINTS["cadence_summary"].replace("SELECT track_id, sample_count", ", per AS (SELECT track_id, coalesce(pedaling_s, 0e0) AS pedaling_s, coalesce(moving_s, 0e0) AS moving_s, a, coalesce(revolutions, 0e0) AS revolutions FROM own LEFT JOIN c USING (track_id)), ignored AS (SELECT track_id, sample_count", 1)
    + f") SELECT count(*) AS tracks, {_R('sum(pedaling_s)', 'pedaling_s')}, {_R('sum(a * pedaling_s) / nullif(sum(pedaling_s), 0)', 'average_rpm')}, {_R('sum(moving_s - pedaling_s) / nullif(sum(moving_s), 0) * 100', 'coasting_percent')}, {_R('sum(revolutions)', 'revolutions')} FROM per",
    "hr_weekly_load": f""", z AS (SELECT track_id, sum(seconds) AS covered, coalesce(sum(seconds / 60 * zone), 0) AS load FROM bins LEFT JOIN (VALUES (1, 30, 114), (2, 114, 133), (3, 133, 152), (4, 152, 171), (5, 171, 241)) z(zone, lower, upper) ON bpm >= lower AND bpm < upper GROUP BY track_id
), t AS (SELECT track_id, CAST(date_trunc('week', DATE '1970-01-01' + CAST(min(ms) // 86400000 AS INTEGER) + CAST(track_id % 60 AS INTEGER)) AS DATE) AS week FROM derived GROUP BY track_id
), w AS (SELECT week, count(*) AS tracks, sum(covered) AS covered, sum(load) AS load FROM t JOIN z USING (track_id) GROUP BY week
), c AS (SELECT CAST(unnest(generate_series(greatest((SELECT min(week) FROM w), DATE '2024-04-01' - 721), DATE '2024-04-01', INTERVAL 7 DAY)) AS DATE) AS week)
SELECT CAST(c.week AS STRING) AS week, tracks, {_R('covered', 'covered_s')}, {_R('load', 'load')} FROM c LEFT JOIN w USING (week)""",
}
#: A rolling integral peaks at a sample's edge or where its slope, linear in between, is zero; places are found by as-of joins.
POINTS["hr_duration_curve"] = f""", joined AS (SELECT track_id, segment_position, position, start_ms / 1000e0 AS s, end_ms / 1000e0 AS e, h0, h1, CASE WHEN lag(end_ms) OVER o = start_ms AND lag(segment_position) OVER o = segment_position THEN 0 ELSE 1 END AS opens FROM spans WHERE hr_ok WINDOW o AS (PARTITION BY track_id ORDER BY position)
), runs AS (SELECT *, sum(opens) OVER (PARTITION BY track_id ORDER BY position) AS run FROM joined
), pre AS MATERIALIZED (SELECT *, coalesce(sum((h0 + h1) / 2 * (e - s)) OVER (PARTITION BY track_id, run ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before, min(s) OVER (PARTITION BY track_id, run) AS f, max(e) OVER (PARTITION BY track_id, run) AS l FROM runs
), d AS (SELECT unnest([60, 300, 600, 1200]) AS d
), edges AS (SELECT DISTINCT track_id, run, d, t FROM (SELECT track_id, run, d, f, l, unnest([f, l - d, e, e - d]) AS t FROM pre CROSS JOIN d) WHERE t >= f AND t + d <= l
), slope AS (SELECT g.track_id, g.run, g.d, t, b.h0 + (b.h1 - b.h0) * least(greatest(t + g.d - b.s, 0), b.e - b.s) / (b.e - b.s) - a.h0 - (a.h1 - a.h0) * least(greatest(t - a.s, 0), a.e - a.s) / (a.e - a.s) AS rise
  FROM (SELECT *, t + d AS u FROM edges) g ASOF JOIN pre a ON a.track_id = g.track_id AND a.run = g.run AND g.t <= a.e ASOF JOIN pre b ON b.track_id = g.track_id AND b.run = g.run AND g.u <= b.e
), turns AS (SELECT track_id, run, d, t + (t2 - t) * rise / (rise - rise2) AS t FROM (SELECT *, lead(t) OVER o AS t2, lead(rise) OVER o AS rise2 FROM slope WINDOW o AS (PARTITION BY track_id, run, d ORDER BY t)) WHERE rise * rise2 < 0
), starts AS (SELECT *, t + d AS u FROM (SELECT * FROM edges UNION ALL SELECT * FROM turns)
), area AS (SELECT g.track_id, g.run, g.d, t,
  (b.before + b.h0 * least(greatest(u - b.s, 0), b.e - b.s) + (b.h1 - b.h0) / (b.e - b.s) * pow(least(greatest(u - b.s, 0), b.e - b.s), 2) / 2 - a.before - a.h0 * least(greatest(t - a.s, 0), a.e - a.s) - (a.h1 - a.h0) / (a.e - a.s) * pow(least(greatest(t - a.s, 0), a.e - a.s), 2) / 2) / g.d AS mean
  FROM starts g ASOF JOIN pre a ON a.track_id = g.track_id AND a.run = g.run AND g.t <= a.e ASOF JOIN pre b ON b.track_id = g.track_id AND b.run = g.run AND g.u <= b.e
), top AS (SELECT * FROM area QUALIFY row_number() OVER (PARTITION BY track_id, d ORDER BY mean DESC, t) = 1
), wanted AS (SELECT DISTINCT track_id, d.d FROM pre CROSS JOIN d)
SELECT track_id, w.d AS duration_s, {_R('mean', 'average_bpm')}, {_R('t', 'start_s')}, {_R('t + w.d', 'end_s')} FROM wanted w LEFT JOIN top USING (track_id, d)"""
POINTS = {name: derived_sql() + sql for name, sql in POINTS.items()}

POINTS |= {
    "hr_cadence_lock": f"""{RIDES}, l AS (SELECT *, ms - min(ms) OVER (PARTITION BY track_id) AS t FROM flagged), runs AS (SELECT *, position - row_number() OVER (PARTITION BY track_id ORDER BY position) AS g FROM l WHERE locked)
SELECT track_id, {_R('arg_min(t, position) / 1000e0', 'start_s')}, {_R('arg_max(t, position) / 1000e0', 'end_s')}, {_R('arg_min(cumulative_m, position)', 'start_distance_m')}, {_R('arg_max(cumulative_m, position)', 'end_distance_m')}, {_R('avg(heart_rate_bpm)', 'average_bpm')}, {_R('avg(cadence_rpm)', 'average_rpm')}, count(*) AS samples FROM runs GROUP BY track_id, g""",
    "hr_drift": f"""{RIDES}, joined AS (SELECT *, CASE WHEN lag(end_ms) OVER o = start_ms AND lag(segment_position) OVER o = segment_position THEN 0 ELSE 1 END AS opens FROM spans WHERE eligible WINDOW o AS (PARTITION BY track_id ORDER BY position)
), runs AS (SELECT *, sum(opens) OVER (PARTITION BY track_id ORDER BY position) AS run FROM joined
), even AS (SELECT *, sum(dt_ms) OVER r AS took, sum(speed * dt_ms) OVER r / sum(dt_ms) OVER r AS pace FROM runs WINDOW r AS (PARTITION BY track_id, run)
), judged AS (SELECT track_id, run, max(took) AS took, sqrt(sum(pow(speed - pace, 2) * dt_ms) / max(took)) / max(pace) AS cv, coalesce(sum(dt_ms) FILTER (abs(grade) <= 2), 0) / max(took) AS flat, min(start_ms) AS f, max(end_ms) AS t FROM even GROUP BY track_id, run
), best AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY took DESC, f, run) AS rn FROM judged WHERE took >= 1800000 AND cv <= 15e-2 AND flat >= 9e-1
), half AS (SELECT track_id, run, f, t, 1 AS half, f * 1e0 AS lo, (f + t) / 2e0 AS hi FROM best WHERE rn = 1 UNION ALL SELECT track_id, run, f, t, 2, (f + t) / 2e0, t * 1e0 FROM best WHERE rn = 1
), cl AS (SELECT *, h0 + (h1 - h0) * (a - start_ms) / dt_ms AS p, h0 + (h1 - h0) * (b - start_ms) / dt_ms AS q FROM (SELECT *, greatest(start_ms, lo) AS a, least(end_ms, hi) AS b FROM runs JOIN half USING (track_id, run) WHERE end_ms > lo AND start_ms < hi)
), part AS (SELECT track_id, half, max(f) AS f, max(t) AS t, sum((p + q) / 2 * (b - a)) / sum(b - a) AS bpm, sum(speed * (b - a)) / sum(b - a) * 36e-1 AS kmh FROM cl GROUP BY track_id, half)
SELECT track_id, {_R('(x.kmh / x.bpm - y.kmh / y.bpm) / (x.kmh / x.bpm) * 100', 'percent')}, {_R('x.f / 1000e0', 'start_s')}, {_R('x.t / 1000e0', 'end_s')}, {_R('x.bpm', 'first_bpm')}, {_R('y.bpm', 'second_bpm')} FROM (SELECT * FROM part WHERE half = 1) x JOIN (SELECT * FROM part WHERE half = 2) y USING (track_id)""",
}
