"""DuckDB SQL of round routes, stored routes and their heart rates."""

from __future__ import annotations

from .adapters import view_sql
from .library_sql import LIBRARY
from .points_sql import RIDES, hav

_LOOPS = f"""riders AS ({view_sql("riders")}
), sample AS (SELECT *, i, 55 + cluster_id * 1e-1 + sin((i + track_id) % 64 * (2 * pi() / 64)) * 1e-2 + track_id % 3 * 1e-4 AS lat, 12 + cos((i + track_id) % 64 * (2 * pi() / 64)) * 2e-2 AS lon FROM riders, generate_series(0, 63) g(i)
), pair AS (SELECT a.track_id AS left_id, b.track_id AS right_id, least(a.distance_m, b.distance_m) / greatest(a.distance_m, b.distance_m) AS ratio FROM riders a JOIN riders b ON a.cluster_id = b.cluster_id
  WHERE CASE WHEN a.activity_type IS NOT NULL AND b.activity_type IS NOT NULL THEN a.activity_type = b.activity_type ELSE least(a.avg_speed_mps, b.avg_speed_mps) / greatest(a.avg_speed_mps, b.avg_speed_mps) >= 5e-1 END
), turn AS (SELECT left_id, right_id, ratio, shift, list_sort(list({hav("a.lat", "a.lon", "b.lat", "b.lon")})) AS d FROM pair CROSS JOIN generate_series(0, 63) s(shift) JOIN sample a ON a.track_id = left_id JOIN sample b ON b.track_id = right_id AND b.i = (a.i + shift) % 64 WHERE ratio >= 9e-1 GROUP BY ALL
), loop AS (SELECT left_id, right_id, ratio, shift AS alignment, d[32] AS med, d[58] AS p90 FROM turn QUALIFY row_number() OVER (PARTITION BY left_id, right_id ORDER BY d[32], d[58], shift) = 1)"""

_STORED = """a AS (SELECT *, min(track_id) OVER (PARTITION BY cluster_id) AS representative_id, count(*) OVER (PARTITION BY cluster_id) AS track_count, min(name) OVER (PARTITION BY cluster_id) AS route FROM dated)"""
_TRACKS = LIBRARY["route_history"][: LIBRARY["route_history"].index(" SELECT cluster_id, track_id")]
_TREND = LIBRARY["route_trends"]
_TREND = _TREND[_TREND.index("a AS (") : _TREND.index("SELECT cluster_id, attempt_count, round(x")].replace("a AS (", "b AS (", 1).replace("FROM a GROUP", "FROM b GROUP")

_RIDDEN = f"""{RIDES}, {_LOOPS}, own AS (SELECT track_id, count(heart_rate_bpm) FILTER (NOT locked) AS sample_count, (max(ms) - min(ms)) / 1000e0 AS elapsed, max(cumulative_m) AS d FROM flagged GROUP BY track_id
), cov AS (SELECT track_id, sum(dt_ms) FILTER (hr_ok) / 1000e0 AS covered_s FROM spans GROUP BY track_id
), sector AS (SELECT track_id, CAST(least(floor(round((d0 + d1) / 2 / d * 64, 9)), 63) AS INTEGER) AS i, sum(dt_ms) AS moving, coalesce(sum(dt_ms) FILTER (eligible), 0) / 1000e0 AS eligible_s, sum(area) FILTER (eligible) / (sum(dt_ms) FILTER (eligible) / 1000e0) AS bpm, sum(speed * dt_ms) FILTER (eligible) / sum(dt_ms) FILTER (eligible) * 36e-1 AS kmh
  FROM spans JOIN own USING (track_id) WHERE moving AND start_ms >= 300000 AND d > 0 GROUP BY track_id, 2
), lead AS (SELECT cluster_id, min(track_id) AS representative_id, count(*) AS track_count, min(name) AS name FROM riders GROUP BY cluster_id
), fit AS (SELECT r.cluster_id, r.track_id, r.started_at, alignment FROM riders r JOIN lead l USING (cluster_id) JOIN riders p ON p.track_id = l.representative_id AND p.activity_type = r.activity_type JOIN loop ON left_id = l.representative_id AND right_id = r.track_id AND med <= 120 AND p90 <= 250
  JOIN own ON own.track_id = r.track_id JOIN cov ON cov.track_id = r.track_id WHERE r.quality_score >= 70 AND r.distance_m >= 500 AND r.moving_s >= 1 AND covered_s * 100 / elapsed >= 90
), usable AS (SELECT f.cluster_id, f.track_id, f.started_at, (s.i - alignment + 64) % 64 AS i, eligible_s, bpm, kmh FROM sector s JOIN fit f USING (track_id) WHERE moving > 0 AND eligible_s / (moving / 1000e0) >= 9e-1 AND bpm IS NOT NULL AND kmh IS NOT NULL
), attempt AS (SELECT DISTINCT cluster_id, track_id, started_at FROM usable)"""

ROUTES = {
    "loop_matches": f"WITH {_LOOPS} SELECT left_id, right_id, round(4e-1 * ratio + 35e-2 * (1 - med / 120) + 25e-2 * (1 - p90 / 250), 4) AS similarity, round(med, 4) AS median_distance_m, round(p90, 4) AS p90_distance_m, alignment FROM loop WHERE left_id < right_id AND med <= 120 AND p90 <= 250",
    "route_list": f"{_TRACKS}, {_STORED}, {_TREND} SELECT DISTINCT cluster_id, route AS name, track_count, representative_id, round((x - y) / y * 100, 4) AS delta_percent, 'faster' AS direction FROM a JOIN t USING (cluster_id) WHERE track_count >= 3 AND (x - y) / y * 100 > f",
    "route_details": f"{_TRACKS}, {_STORED} SELECT cluster_id, track_id, track_count, CASE WHEN track_id = representative_id THEN 1e0 ELSE 9e-1 END AS similarity, track_id = representative_id AS representative, round(avg_speed_mps, 4) AS avg_speed_mps, epoch_ms(started_at) AS started_ms, epoch_ms(min(started_at) OVER (PARTITION BY cluster_id)) AS first_attempt_ms, epoch_ms(max(started_at) OVER (PARTITION BY cluster_id)) AS latest_attempt_ms FROM a",
    "route_of_track": f"{_TRACKS}, {_STORED} SELECT cluster_id, track_id, track_count, track_id = representative_id AS representative, epoch_ms(started_at) AS started_ms FROM a WHERE cluster_id = (SELECT cluster_id FROM a WHERE track_id = 1)",
    "hr_routes": f"{_RIDDEN}, recorded AS (SELECT cluster_id, count(*) AS recorded_count FROM riders JOIN own USING (track_id) WHERE sample_count > 0 GROUP BY cluster_id), e AS (SELECT cluster_id, count(*) AS n FROM attempt GROUP BY cluster_id) SELECT cluster_id, name, track_count, recorded_count, coalesce(n, 0) AS eligible_count FROM lead JOIN recorded USING (cluster_id) LEFT JOIN e USING (cluster_id)",
    "hr_route_pairs": f"""{_RIDDEN}, ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY started_at DESC, track_id DESC) AS r FROM attempt
), both_of AS (SELECT x.cluster_id, x.track_id AS before_id, y.track_id AS after_id FROM ranked x JOIN ranked y ON x.cluster_id = y.cluster_id AND x.r = 2 AND y.r = 1
), seen AS (SELECT p.cluster_id, before_id, after_id, median(x.bpm) AS b0, median(y.bpm) AS b1, median(x.kmh) AS v0, median(y.kmh) AS v1, least(sum(x.eligible_s), sum(y.eligible_s)) AS support_s, count(*) AS n FROM both_of p JOIN usable x ON x.track_id = before_id JOIN usable y ON y.track_id = after_id AND y.i = x.i GROUP BY ALL
), ch AS (SELECT *, b1 - b0 AS dh, (v1 - v0) / v0 * 100 AS dv FROM seen WHERE support_s >= 180 AND least(v0, v1) > 0)
SELECT cluster_id, before_id, after_id, round(b0, 4) AS before_bpm, round(v0, 4) AS before_speed, round(b1, 4) AS after_bpm, round(v1, 4) AS after_speed, round(support_s, 4) AS support_s, n AS sector_count, 5e0 AS hr_noise, 2e0 AS speed_noise, round(dh, 4) AS hr_delta, round(dv, 4) AS speed_delta,
  CASE WHEN abs(dv) <= 5 AND dh < -5 THEN 'Lower HR at similar speed' WHEN abs(dv) <= 5 AND dh > 5 THEN 'Higher HR at similar speed' WHEN abs(dh) <= 5 AND dv > 2 THEN 'Faster at similar HR' WHEN abs(dh) <= 5 AND dv < -2 THEN 'Slower at similar HR' WHEN abs(dv) <= 5 OR abs(dh) <= 5 THEN 'No clear change' ELSE 'Different effort — not comparable' END AS label FROM ch""",
}
