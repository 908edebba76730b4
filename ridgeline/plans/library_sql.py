"""DuckDB SQL of the library, import and route queries."""

from __future__ import annotations

from .adapters import view_sql
from .points_sql import hav

_AS_OF = "TIMESTAMP '2001-08-01 00:00:00'"
_TRACKS = f"WITH tracks AS ({view_sql('tracks')}), done AS (SELECT * FROM tracks WHERE status = 'complete'), dated AS (SELECT * FROM done WHERE started_at IS NOT NULL)"
_CELLS = f"WITH cells AS ({view_sql('cells')})"
_IMPORTS = f"WITH archives AS ({view_sql('archives')}), items AS ({view_sql('items')})"


def _history(rows: str, metric: str) -> str:
    return f"""{_TRACKS}, h AS (SELECT track_id, started_at, {metric} AS metric_mps FROM {rows})
SELECT track_id, epoch_ms(started_at) AS started_ms, round(metric_mps, 4) AS metric_mps,
  round(median(metric_mps) OVER (ORDER BY started_at, track_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), 4) AS rolling_median_mps,
  round(max(metric_mps) OVER (ORDER BY started_at, track_id ROWS UNBOUNDED PRECEDING), 4) AS record_mps FROM h"""


_COUNTERS = f"""{_IMPORTS}, c AS (
  SELECT archive_id, count(*) AS n, count(*) FILTER (status IN ('complete', 'duplicate', 'insufficient_data')) AS good, count(*) FILTER (status = 'failed') AS bad, count(*) FILTER (status = 'duplicate') AS dup, count(*) FILTER (status = 'skipped') AS skip FROM items GROUP BY archive_id
), k AS (SELECT archive_id, batch_id, greatest(item_count, coalesce(n, 0)) AS item_count, coalesce(good, 0) AS complete_count, coalesce(bad, 0) AS failed_count, coalesce(dup, 0) AS duplicate_count, coalesce(good, 0) + coalesce(bad, 0) + coalesce(skip, 0) AS done FROM archives LEFT JOIN c USING (archive_id)
), counted AS (SELECT archive_id, batch_id, item_count, complete_count, failed_count, duplicate_count,
  CASE WHEN item_count = 0 THEN 'processing' WHEN done < item_count THEN 'processing' WHEN failed_count = item_count THEN 'failed' WHEN failed_count > 0 THEN 'partial' ELSE 'complete' END AS status,
  CASE WHEN item_count = 0 THEN 'Reading upload' WHEN done < item_count THEN 'Analyzing tracks' WHEN failed_count = item_count THEN 'Import failed' WHEN failed_count > 0 THEN 'Completed with issues' ELSE 'Ready to explore' END AS stage,
  CASE WHEN item_count > 0 THEN least(100, 35 + CAST(round(done / item_count * 65) AS INTEGER)) ELSE 10 END AS progress FROM k)"""

_FEATURES = f"WITH v AS ({view_sql('vectors')})"
_PAIRS = f"""{_FEATURES}, p AS (
  SELECT a.track_id AS left_id, b.track_id AS right_id, least(a.distance_m, b.distance_m) / greatest(a.distance_m, b.distance_m) AS ratio,
    list_sort(list_transform(generate_series(1, 64), lambda i: {hav("(55 + a.embedding[i]::DOUBLE * 8e-3)", "(12 + (i - 1) * 1e-3)", "(55 + b.embedding[i]::DOUBLE * 8e-3)", "(12 + (i - 1) * 1e-3)")})) AS d,
    {hav("(55 + a.embedding[1]::DOUBLE * 8e-3)", "12", "(55 + b.embedding[1]::DOUBLE * 8e-3)", "12")} AS e1, {hav("(55 + a.embedding[64]::DOUBLE * 8e-3)", "12.063", "(55 + b.embedding[64]::DOUBLE * 8e-3)", "12.063")} AS e2
  FROM v a JOIN v b ON a.track_id < b.track_id AND a.activity_type = b.activity_type
), m AS (SELECT *, d[32] AS med, d[58] AS p90 FROM p WHERE ratio >= 9e-1 AND e1 <= 250 AND e2 <= 250)"""

#: Tracks are taken one after the other; the list has the group of each so far.  Means are of whole billionths.
GROUPS = f"""{_PAIRS.replace("WITH ", "WITH RECURSIVE ", 1)}
, link AS MATERIALIZED (SELECT left_id, right_id, 4e-1 * ratio + 35e-2 * (1 - med / 120) + 25e-2 * (1 - p90 / 250) AS similarity FROM m WHERE med <= 120 AND p90 <= 250
), node AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS k FROM (SELECT left_id AS id FROM link UNION SELECT right_id FROM link)
), edge AS MATERIALIZED (SELECT a.k AS u, b.k AS t, CAST(round(similarity * 1e9) AS BIGINT) AS units FROM link JOIN node a ON a.id = left_id JOIN node b ON b.id = right_id
), fold AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS held
  UNION ALL
  SELECT k + 1, list_append(held, coalesce(list_sort(list({{'below': -units / n, 'g': g}}) FILTER (n = len(list_filter(held, lambda x: x = g))))[1].g, k + 1))
  FROM (SELECT f.k, f.held, f.held[e.u] AS g, count(*) AS n, sum(units) AS units FROM fold f LEFT JOIN edge e ON e.t = f.k + 1 WHERE f.k < (SELECT count(*) FROM node) GROUP BY ALL) GROUP BY k, held
), member AS (SELECT n.id AS track_id, g.id AS group_id, count(*) OVER (PARTITION BY g.id) AS size FROM (SELECT unnest(held) AS g, unnest(range(1, len(held) + 1)) AS k FROM fold WHERE k = (SELECT count(*) FROM node)) o JOIN node n ON n.k = o.k JOIN node g ON g.k = o.g
), near AS (SELECT a.group_id, a.track_id, b.track_id AS other_id, similarity FROM (SELECT left_id AS x, right_id AS y, similarity FROM link UNION ALL SELECT right_id, left_id, similarity FROM link) JOIN member a ON a.track_id = x JOIN member b ON b.track_id = y AND a.group_id = b.group_id
), lead AS (SELECT group_id, track_id AS representative_id FROM near GROUP BY group_id, track_id QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY sum(similarity) DESC, track_id) = 1)"""

LIBRARY = {
    "speed_history": _history("dated", "best_1km_speed_mps"),
    "speed_history_year": _history(f"(SELECT * FROM dated WHERE started_at >= {_AS_OF} - INTERVAL 365 DAY)", "best_5km_speed_mps"),
    "records": f"{_TRACKS} SELECT metric, track_id, epoch_ms(started_at) AS started_ms, round(v, 4) AS speed_mps FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY v DESC, started_at, track_id) AS rn FROM (SELECT 'instantaneous' AS metric, track_id, started_at, max_speed_mps AS v FROM dated UNION ALL SELECT '1km', track_id, started_at, best_1km_speed_mps FROM dated UNION ALL SELECT '5km', track_id, started_at, best_5km_speed_mps FROM dated) WHERE v IS NOT NULL) WHERE rn = 1",
    "leaders": f"{_TRACKS} SELECT track_id, epoch_ms(started_at) AS started_ms, round(best_1km_speed_mps, 4) AS speed_mps FROM dated ORDER BY best_1km_speed_mps DESC, started_at, track_id LIMIT 10",
    "recent_delta": f"{_TRACKS}, l AS (SELECT best_5km_speed_mps AS v, row_number() OVER (ORDER BY started_at DESC, track_id DESC) AS r FROM dated WHERE best_5km_speed_mps IS NOT NULL) SELECT round(median(v) FILTER (r <= 15), 4) AS recent_mps, round(median(v) FILTER (r BETWEEN 16 AND 30), 4) AS previous_mps, round((median(v) FILTER (r <= 15) - median(v) FILTER (r BETWEEN 16 AND 30)) / median(v) FILTER (r BETWEEN 16 AND 30) * 100, 4) AS delta_percent FROM l",
    "list_tracks": f"{_TRACKS} SELECT track_id, name, status, epoch_ms(started_at) AS started_ms FROM tracks ORDER BY started_at DESC NULLS LAST, inserted_at DESC, track_id LIMIT 500",
    "search_processing": f"{_TRACKS} SELECT track_id, name, status, epoch_ms(started_at) AS started_ms FROM tracks WHERE status IN ('queued', 'parsing', 'cleaning', 'analyzing', 'indexing') AND (name ILIKE '%ide 1%' OR source_filename ILIKE '%ide 1%') ORDER BY started_at DESC NULLS LAST, inserted_at DESC, track_id LIMIT 500",
    "compare_tracks": f"{_TRACKS} SELECT track_id, round(coalesce(distance_m, 0) / 1000, 2) AS distance_km, round(coalesce(moving_s, 0) / 3600, 2) AS moving_h, round(coalesce(avg_speed_mps, 0) * 36e-1, 2) AS avg_kmh, round(coalesce(max_speed_mps, 0) * 36e-1, 2) AS max_kmh, round(coalesce(elevation_gain_m, 0), 0) AS gain_m FROM done WHERE track_id IN (7, 3, 1, 5)",
    "latest_track": f"{_TRACKS} SELECT track_id, epoch_ms(started_at) AS started_ms FROM done ORDER BY started_at DESC NULLS LAST, inserted_at DESC, track_id LIMIT 1",
    "portfolio_summary": f"{_TRACKS}, cells AS ({view_sql('cells')}) SELECT (SELECT count(*) FROM done) AS track_count, round(coalesce(sum(distance_m), 0), 4) AS distance_m, round(coalesce(sum(moving_s), 0), 4) AS moving_s, round(coalesce(sum(elevation_gain_m), 0), 4) AS elevation_gain_m, epoch_ms(min(started_at)) AS earliest_ms, epoch_ms(max(ended_at)) AS latest_ms, (SELECT count(*) FROM tracks WHERE status = 'analyzing') AS processing_count, round(avg(quality_score), 4) AS quality_score, (SELECT count(*) FROM cells) AS route_cells, (SELECT count(DISTINCT cell) FROM cells) AS distinct_cells FROM done",
    "monthly_totals": f"{_TRACKS} SELECT strftime(started_at, '%Y-%m') AS month, round(coalesce(sum(distance_m), 0), 4) AS distance_m, round(coalesce(sum(moving_s), 0), 4) AS moving_s, round(coalesce(sum(elevation_gain_m), 0), 4) AS elevation_gain_m, count(*) AS track_count FROM dated GROUP BY 1",
    "share_summary": f"{_TRACKS}, r AS (SELECT * FROM dated WHERE started_at >= TIMESTAMP '1998-03-01' AND started_at < TIMESTAMP '1998-04-01') SELECT count(*) AS track_count, round(sum(distance_m), 4) AS distance_m, round(sum(moving_s), 4) AS moving_s, round(sum(elevation_gain_m), 4) AS elevation_gain_m, round(sum(distance_m) / sum(moving_s), 4) AS avg_speed_mps, round(max(max_speed_mps), 4) AS max_speed_mps, (SELECT max_speed_confidence FROM r ORDER BY max_speed_mps DESC, track_id LIMIT 1) AS max_speed_confidence, round(max(best_1km_speed_mps), 4) AS best_1km_speed_mps, round(max(best_5km_speed_mps), 4) AS best_5km_speed_mps, round(max(distance_m), 4) AS longest_distance_m, round(max(elevation_gain_m), 4) AS highest_elevation_gain_m, round(max(moving_s), 4) AS longest_moving_s, round(avg(quality_score), 4) AS quality_score FROM r",
    "share_activity": f"{_TRACKS} SELECT track_id, epoch_ms(started_at) AS started_ms, round(coalesce(distance_m, 0), 4) AS distance_m FROM dated",
    "heatmap": f"{_CELLS} SELECT cell, latitude, longitude, CAST(sum(point_count) AS BIGINT) AS weight, count(track_id) AS visits FROM cells GROUP BY cell, latitude, longitude ORDER BY weight DESC, cell, latitude, longitude LIMIT 8000",
    "explore_insights": f"{_CELLS}, h AS (SELECT count(*) AS visits FROM cells GROUP BY cell) SELECT count(*) AS cells, count(*) FILTER (visits > 1) AS revisited, max(visits) AS most_visits FROM h",
    "longest_tracks": f"{_TRACKS} SELECT track_id, round(distance_m, 4) AS distance_m FROM done ORDER BY distance_m DESC, track_id LIMIT 12",
    "stale_analyses": f"{_TRACKS} SELECT track_id FROM done WHERE analysis_version < 6",
    "weekly_volume": f"{_TRACKS}, c AS (SELECT CAST(unnest(generate_series(date_trunc('week', {_AS_OF}) - INTERVAL 77 DAY, date_trunc('week', {_AS_OF}), INTERVAL 7 DAY)) AS DATE) AS week), s AS (SELECT CAST(date_trunc('week', started_at) AS DATE) AS week, sum(distance_m) AS d, sum(moving_s) AS m, count(*) AS n FROM dated GROUP BY 1) SELECT CAST(week AS STRING) AS week, round(coalesce(d, 0), 4) AS distance_m, round(coalesce(m, 0), 4) AS moving_s, coalesce(n, 0) AS track_count FROM c LEFT JOIN s USING (week)",
    "volume_delta": f"{_TRACKS} SELECT round(a, 4) AS recent_m, round(b, 4) AS prior_m, round((a - b) / b * 100, 4) AS delta_percent FROM (SELECT coalesce(sum(distance_m) FILTER (started_at >= w - INTERVAL 21 DAY AND started_at < w + INTERVAL 7 DAY), 0) AS a, coalesce(sum(distance_m) FILTER (started_at >= w - INTERVAL 49 DAY AND started_at < w - INTERVAL 21 DAY), 0) AS b FROM dated, (SELECT date_trunc('week', {_AS_OF}) AS w))",
    "effort_trends": f"{_TRACKS}, l AS (SELECT '1 km' AS label, best_1km_speed_mps AS v, started_at, track_id FROM dated UNION ALL SELECT '5 km', best_5km_speed_mps, started_at, track_id FROM dated), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY started_at DESC, track_id DESC) AS r FROM l WHERE v IS NOT NULL) SELECT label, round(median(v) FILTER (r <= 5), 4) AS recent_speed_mps, round((median(v) FILTER (r <= 5) - median(v) FILTER (r BETWEEN 6 AND 10)) / median(v) FILTER (r BETWEEN 6 AND 10) * 100, 4) AS delta_percent, round(max(v), 4) AS record_speed_mps FROM r GROUP BY label",
    "weekly_streak": f"{_TRACKS}, w AS (SELECT DISTINCT CAST(date_trunc('week', started_at) AS DATE) AS week FROM dated), r AS (SELECT week, row_number() OVER (ORDER BY week DESC) AS r, max(week) OVER () AS latest FROM w) SELECT CAST(max(latest) AS STRING) AS latest_week, count(*) FILTER (latest - week = (r - 1) * 7) AS weeks FROM r",
    "recap_year": f"{_TRACKS}, c AS (SELECT CAST(unnest(generate_series(DATE '1998-01-01', DATE '1998-12-01', INTERVAL 1 MONTH)) AS DATE) AS bucket) SELECT CAST(bucket AS STRING) AS bucket, round(coalesce(sum(distance_m), 0), 4) AS distance_m FROM c LEFT JOIN dated ON date_trunc('month', started_at) = bucket GROUP BY 1",
    "recap_all_time": f"{_TRACKS}, c AS (SELECT CAST(unnest(generate_series((SELECT date_trunc('year', min(started_at)) FROM dated), (SELECT max(started_at) FROM dated), INTERVAL 1 YEAR)) AS DATE) AS bucket) SELECT CAST(bucket AS STRING) AS bucket, round(coalesce(sum(distance_m), 0), 4) AS distance_m FROM c LEFT JOIN dated ON date_trunc('year', started_at) = bucket GROUP BY 1",
    "import_counters": f"{_COUNTERS} SELECT * FROM counted",
    "import_batches": f"{_COUNTERS} SELECT batch_id, CASE WHEN NOT bool_and(status IN ('complete', 'partial', 'failed', 'duplicate')) THEN 'processing' WHEN sum(failed_count) > 0 THEN 'partial' ELSE 'complete' END AS status, count(*) AS archive_count, CAST(sum(item_count) AS BIGINT) AS item_count, CAST(sum(complete_count) AS BIGINT) AS complete_count, CAST(sum(duplicate_count) AS BIGINT) AS duplicate_count, CAST(sum(failed_count) AS BIGINT) AS failed_count FROM counted GROUP BY batch_id",
    "recent_archives": f"{_IMPORTS}, l AS (SELECT archive_id FROM archives ORDER BY inserted_at DESC, archive_id DESC LIMIT 20) SELECT archive_id, count(item_id) AS n_skipped FROM l LEFT JOIN (SELECT * FROM items WHERE status = 'insufficient_data') i USING (archive_id) GROUP BY archive_id",
    "new_recordings": f"WITH r AS ({view_sql('recordings')}), k AS (SELECT DISTINCT CAST(o_orderkey AS STRING) AS sha256 FROM orders WHERE o_orderkey % 5 = 0) SELECT sha256, min(path) AS path FROM r WHERE sha256 NOT IN (SELECT sha256 FROM k) GROUP BY sha256",
    "route_trends": f"""{_TRACKS}, a AS (SELECT cluster_id, avg_speed_mps AS v, row_number() OVER (PARTITION BY cluster_id ORDER BY started_at DESC, track_id DESC) AS r, count(*) OVER (PARTITION BY cluster_id) AS n, median(avg_speed_mps) OVER (PARTITION BY cluster_id) AS m FROM dated
), s AS (SELECT cluster_id, max(n) AS n, max(m) AS m, median(abs(v - m)) AS mad, median(v) FILTER (r <= 3) AS a3, median(v) FILTER (r BETWEEN 4 AND 6) AS b3, max(v) FILTER (r = 1) AS last, median(v) FILTER (r > 1) AS earlier FROM a GROUP BY cluster_id
), t AS (SELECT cluster_id, n AS attempt_count, CASE WHEN n >= 6 THEN a3 WHEN n >= 2 THEN last END AS x, CASE WHEN n >= 6 THEN b3 WHEN n >= 2 THEN earlier END AS y, greatest(2e-2, 14826e-4 * mad / m) * 100 AS f FROM s)
SELECT cluster_id, attempt_count, round(x, 4) AS recent_speed_mps, round(y, 4) AS baseline_speed_mps, round(f, 4) AS noise_floor_percent, round((x - y) / y * 100, 4) AS delta_percent, CASE WHEN x IS NULL THEN 'building' WHEN (x - y) / y * 100 > f THEN 'faster' WHEN (x - y) / y * 100 < -f THEN 'slower' ELSE 'steady' END AS direction FROM t""",
    "route_history": f"{_TRACKS} SELECT cluster_id, track_id, epoch_ms(started_at) AS started_ms, round(avg_speed_mps * 36e-1, 2) AS speed_kmh, round(distance_m / 1000, 2) AS distance_km, row_number() OVER (PARTITION BY cluster_id ORDER BY avg_speed_mps DESC, started_at, track_id) = 1 AS fastest FROM dated",
    "route_groups": f"{GROUPS} SELECT member.group_id, member.track_id, representative_id, member.track_id = representative_id AS representative, round(CASE WHEN member.track_id = representative_id THEN 1e0 ELSE similarity END, 4) AS similarity FROM member JOIN lead ON lead.group_id = member.group_id LEFT JOIN near ON near.group_id = member.group_id AND near.track_id = member.track_id AND other_id = representative_id WHERE size > 1",
    "route_matches": f"{_PAIRS} SELECT left_id, right_id, round(4e-1 * ratio + 35e-2 * (1 - med / 120) + 25e-2 * (1 - p90 / 250), 4) AS similarity, round(med, 4) AS median_distance_m, round(p90, 4) AS p90_distance_m, 0 AS alignment FROM m WHERE med <= 120 AND p90 <= 250",
    "geo_functions": f"SELECT c_custkey, round({hav('c_custkey % 90 * 1e0', 'c_custkey % 180 * 1e0', 'c_nationkey * 1e0', 'c_nationkey * 2e0')}, 4) AS distance_m, round(fmod(fmod(degrees(atan2(sin(radians(c_nationkey * 2e0 - c_custkey % 180)) * cos(radians(c_nationkey * 1e0)), cos(radians(c_custkey % 90 * 1e0)) * sin(radians(c_nationkey * 1e0)) - sin(radians(c_custkey % 90 * 1e0)) * cos(radians(c_nationkey * 1e0)) * cos(radians(c_nationkey * 2e0 - c_custkey % 180)))) + 360, 360) + 360, 360), 4) AS bearing_degrees FROM customer",
    "activity_ids": "SELECT p_partkey, nullif(trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '_'), '') AS activity_type FROM part",
}
