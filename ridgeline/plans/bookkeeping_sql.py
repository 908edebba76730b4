"""DuckDB SQL of validation, lifecycles, zones by revision, display and smaller lookups."""

from __future__ import annotations

from .adapters import view_sql
from .library_sql import GROUPS
from .points_sql import derived_sql, hav

_STORED = f"tracks AS ({view_sql('stored_tracks')}), items AS ({view_sql('stored_items')}), memberships AS ({view_sql('stored_memberships')}), points AS ({view_sql('points')})"


def _blank(table: str, *columns: str) -> list[str]:
    return [f"SELECT '{table}' AS \"table\", '{c} required' AS rule, count(*) FILTER ({c} IS NULL OR trim({c}::VARCHAR) = '') AS breaches FROM {table}" for c in columns]


def _beyond(table: str, rule: str, condition: str) -> str:
    return f"SELECT '{table}', '{rule}', count(*) FILTER ({condition}) FROM {table}"


def _once(table: str, *key: str) -> str:
    some = " AND ".join(f"{c} IS NOT NULL" for c in key)
    return f"SELECT '{table}', '{', '.join(key)} once', count(*) - count(DISTINCT ({', '.join(key)})) FROM {table} WHERE {some}"


_REPORT = [
    *_blank("tracks", "sha256", "original_path", "source_filename", "name"),
    _beyond("tracks", "progress in range", "progress < 0 OR progress > 100"),
    _beyond("tracks", "status allowed", "status = 'lost'"),
    _beyond("tracks", "source_format allowed", "source_format = 'tcx'"),
    _once("tracks", "sha256"),
    *_blank("items", "archive_id", "position", "path", "type"),
    _beyond("items", "status allowed", "status = 'gone'"),
    _once("items", "archive_id", "path"),
    *_blank("memberships", "cluster_id", "track_id", "similarity"),
    _beyond("memberships", "similarity in range", "similarity < 0 OR similarity > 1"),
    _once("memberships", "track_id"),
    _once("memberships", "cluster_id", "track_id"),
    *_blank("points", "track_id", "segment_position", "position", "latitude", "longitude"),
    _beyond("points", "latitude in range", "latitude NOT BETWEEN -90 AND 90"),
    _beyond("points", "longitude in range", "longitude NOT BETWEEN -180 AND 180"),
    _once("points", "track_id", "position"),
]

_LEGAL = """CASE coalesce(state, '') WHEN '' THEN status = 'queued' WHEN 'queued' THEN status IN ('parsing', 'failed') WHEN 'parsing' THEN status IN ('analyzing', 'failed') WHEN 'analyzing' THEN status IN ('indexing', 'failed')
  WHEN 'indexing' THEN status IN ('complete', 'insufficient_data', 'failed') ELSE status = 'queued' END"""
_FOLLOWED = f"""WITH RECURSIVE step AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY happened_at, event_id) AS k FROM ({view_sql('item_events')})
), walk AS (
  SELECT item_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::VARCHAR AS status, NULL::VARCHAR AS error, NULL::VARCHAR AS before, NULL::VARCHAR AS state, true AS legal FROM (SELECT DISTINCT item_id FROM step)
  UNION ALL
  SELECT item_id, k, event_id, status, error, state, CASE WHEN ok THEN status ELSE state END, ok FROM (SELECT s.item_id, s.k, s.event_id, s.status, s.error, w.state, {_LEGAL.replace('status', 's.status')} AS ok FROM walk w JOIN step s ON s.item_id = w.item_id AND s.k = w.k + 1)
)"""

BOOKKEEPING = {
    "constraint_report": f"WITH {_STORED} {' UNION ALL '.join(_REPORT)}",
    "quarantined_rows": f"""WITH {_STORED}, marked AS (SELECT *, CASE WHEN track_id IS NOT NULL THEN count(*) OVER (PARTITION BY track_id) END AS n1, CASE WHEN track_id IS NOT NULL THEN count(*) OVER (PARTITION BY cluster_id, track_id) END AS n2 FROM memberships
), named AS (SELECT cluster_id, track_id, similarity, list_sort(list_filter([CASE WHEN n2 > 1 THEN 'cluster_id, track_id once' END, CASE WHEN similarity IS NULL THEN 'similarity required' END, CASE WHEN similarity > 1 THEN 'similarity in range' END, CASE WHEN n1 > 1 THEN 'track_id once' END, CASE WHEN track_id IS NULL THEN 'track_id required' END], lambda x: x IS NOT NULL)) AS broken FROM marked)
SELECT cluster_id, track_id, round(similarity, 4) AS similarity, array_to_string(broken, ';') AS broken FROM named WHERE len(broken) > 0""",
    "lifecycle_states": f"""{_FOLLOWED}, last AS (SELECT item_id, status, error FROM walk WHERE legal AND k > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY k DESC) = 1), n AS (SELECT item_id, count(*) FILTER (legal) AS n_steps, count(*) FILTER (NOT legal) AS n_illegal FROM walk WHERE k > 0 GROUP BY item_id)
SELECT n.item_id, status, CASE status WHEN 'queued' THEN 0 WHEN 'parsing' THEN 12 WHEN 'analyzing' THEN 48 WHEN 'indexing' THEN 82 WHEN 'complete' THEN 100 WHEN 'insufficient_data' THEN 100 WHEN 'failed' THEN 100 END AS progress, CASE WHEN status = 'failed' THEN error END AS error, n_steps, n_illegal FROM n LEFT JOIN last USING (item_id)""",
    "lifecycle_quarantine": f"""{_FOLLOWED} SELECT event_id, item_id, status, before, CASE WHEN status = 'lost' THEN 'no such status' WHEN status = before THEN 'already there' WHEN before IS NULL THEN 'not queued yet' ELSE 'not from ' || before END AS reason FROM walk WHERE NOT legal""",
    "zone_revisions": f"""WITH tracks AS ({view_sql('tracks')}), profiles AS ({view_sql('profiles')}), beats AS ({view_sql('beats')}
), held AS (SELECT track_id, revision, maximum FROM tracks JOIN profiles ON valid_from <= started_at QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY valid_from DESC, revision DESC) = 1 AND mode = 'maximum'
), zoned AS (SELECT track_id, revision AS zone_revision, seconds, CASE WHEN bpm < 30 OR bpm >= 241 THEN 0 ELSE 1 + (bpm >= floor(maximum * 6 / 10 + 5e-1))::INT + (bpm >= floor(maximum * 7 / 10 + 5e-1))::INT + (bpm >= floor(maximum * 8 / 10 + 5e-1))::INT + (bpm >= floor(maximum * 9 / 10 + 5e-1))::INT END AS zone FROM beats JOIN held USING (track_id))
SELECT track_id, zone_revision, {', '.join(f"round(coalesce(sum(seconds) FILTER (zone = {z}), 0e0), 4) AS zone_{z}" for z in range(1, 6))} FROM zoned GROUP BY track_id, zone_revision""",
}

_TRACKS = f"WITH tracks AS ({view_sql('tracks')})"
_DONE = f"{_TRACKS}, dated AS (SELECT * FROM tracks WHERE status = 'complete' AND started_at IS NOT NULL)"


def _number(value: str, decimals: int, unit: str) -> str:
    return f"coalesce(printf('%.{decimals}f', round(({value})::DOUBLE, {decimals})) || '{unit}', '—')"


_MOVED, _TOOK, _MANY, _CHANGE = "greatest(round(moving_s), 0)::BIGINT", "greatest(round(moving_s - 300), 0)::BIGINT", "distance_m * 37", "(elevation_gain_m - 350) / 7"
_ELIGIBLE = f"{_TRACKS}, e AS (SELECT count(*) AS n FROM tracks WHERE status = 'complete' AND started_at IS NOT NULL AND distance_m >= 500 AND moving_s >= 1 AND quality_score >= 70)"

BOOKKEEPING |= {
    "display_formats": f"""{_TRACKS} SELECT track_id, CASE WHEN distance_m >= 1000 THEN {_number("distance_m / 1000", 1, " km")} ELSE {_number("distance_m", 0, " m")} END AS distance, {_number("elevation_gain_m", 0, " m")} AS elevation, {_number("best_5km_speed_mps * 36e-1", 1, " km/h")} AS speed, {_number("quality_score * 2", 0, " bpm")} AS bpm, {_number("quality_score", 0, " rpm")} AS rpm,
  CASE WHEN abs({_CHANGE}) < 5e-2 THEN '0%' ELSE CASE WHEN {_CHANGE} > 0 THEN '+' ELSE '−' END || printf('%.1f', round(abs({_CHANGE}), 1)) || '%' END AS change, printf('%d:%02d', {_MOVED} // 60, {_MOVED} % 60) AS elapsed,
  CASE WHEN {_TOOK} >= 3600 THEN printf('%dh %02dm', {_TOOK} // 3600, {_TOOK} % 3600 // 60) WHEN {_TOOK} >= 60 THEN printf('%dm', {_TOOK} // 60) ELSE printf('%ds', {_TOOK}) END AS duration,
  CASE WHEN {_MANY} >= 1000000 THEN {_number(f"{_MANY} / 1000000", 1, "m")} WHEN {_MANY} >= 1000 THEN {_number(f"{_MANY} / 1000", 1, "k")} ELSE {_number(_MANY, 0, "")} END AS compact, {_number("quality_score", 0, "%")} AS percent,
  coalesce(strftime(started_at, '%b %-d, %Y · %-I:%M %p'), 'No timestamp') AS local_date, coalesce(strftime(started_at, '%b %-d, %Y'), 'Undated') AS short_date, CASE WHEN track_id % 2 = 0 THEN 'Needs data' WHEN status = 'complete' THEN 'Complete' ELSE 'Analyzing' END AS label FROM tracks""",
    "track_lookup": f"{_TRACKS} SELECT track_id, name, status, round(distance_m, 4) AS distance_m FROM tracks WHERE track_id = 7",
    "marked_items": f"{_TRACKS}, items AS ({view_sql('items')}) SELECT archive_id, coalesce(t.status, i.status) AS status, count(*) AS n FROM items i LEFT JOIN (SELECT * FROM tracks WHERE track_id % 3 > 0) t ON t.track_id = i.track_id GROUP BY ALL",
    "route_status": f"""{_ELIGIBLE} SELECT 'ready' AS "case", 'ready' AS status, n AS eligible_count FROM e UNION ALL SELECT 'old', 'stale', n FROM e UNION ALL SELECT 'grown', 'stale', n + 1 FROM e UNION ALL SELECT 'none', 'missing', n FROM e""",
    "speed_chart": f"""{_DONE} SELECT track_id, epoch_ms(started_at) AS started_ms, round(best_1km_speed_mps * 36e-1, 2) AS speed_kmh, round(median(best_1km_speed_mps) OVER (ORDER BY started_at, track_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) * 36e-1, 2) AS median_kmh,
  round(max(best_1km_speed_mps) OVER (ORDER BY started_at, track_id ROWS UNBOUNDED PRECEDING) * 36e-1, 2) AS record_kmh FROM dated""",
    "sector_comparison": f"""WITH riders AS ({view_sql('riders')}), speeds AS ({view_sql('sector_speeds')}), ranked AS (SELECT cluster_id, track_id, row_number() OVER (PARTITION BY cluster_id ORDER BY started_at DESC, track_id DESC) AS r FROM riders
), both_of AS (SELECT cluster_id, number, max(speed_mps) FILTER (r = 1) AS x, median(speed_mps) FILTER (r > 1) AS y FROM ranked JOIN speeds USING (track_id) WHERE r <= 6 GROUP BY ALL
), d AS (SELECT *, CASE WHEN y > 0 THEN (x - y) / y * 100 END AS p FROM both_of)
SELECT cluster_id, number, round(x, 4) AS latest_speed_mps, round(y, 4) AS baseline_speed_mps, round(p, 4) AS delta_percent, CASE WHEN p IS NULL THEN 'building' WHEN p > 2 THEN 'faster' WHEN p < -2 THEN 'slower' ELSE 'steady' END AS direction FROM d""",
    "focus_window": f"""{derived_sql()}, s AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY position) - 1 AS i, cumulative_m / 1000 AS km FROM derived WHERE valid
), n AS (SELECT *, first_value(i) OVER (PARTITION BY track_id ORDER BY abs(km - 2), i) AS nearest FROM s)
SELECT track_id, i::INTEGER AS i, round(km, 4) AS distance_km FROM n WHERE abs(km - 2) <= 1e-1 OR abs(i - nearest) <= 1""",
    "route_features": f"""WITH points AS ({view_sql('points')}), step AS (SELECT track_id, position, latitude AS lat, longitude AS lon, coalesce({hav('lag(latitude) OVER o', 'lag(longitude) OVER o', 'latitude', 'longitude')}, 0e0) AS m FROM points WINDOW o AS (PARTITION BY track_id ORDER BY position)
), along AS (SELECT *, sum(m) OVER (PARTITION BY track_id ORDER BY position) AS a FROM step
), kept AS MATERIALIZED (SELECT track_id, lat, lon, a, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(a) OVER w AS a2 FROM (SELECT * FROM along QUALIFY row_number() OVER (PARTITION BY track_id, a ORDER BY position) = 1) WINDOW w AS (PARTITION BY track_id ORDER BY a)
), wanted AS (SELECT track_id, i, total * i / 63 AS t FROM (SELECT track_id, max(a) AS total FROM along GROUP BY track_id HAVING max(a) > 0) CROSS JOIN generate_series(0, 63) g(i)
), sample AS (SELECT w.track_id, i, CASE WHEN a2 IS NULL THEN lat ELSE lat + (lat2 - lat) * (t - a) / (a2 - a) END AS lat, CASE WHEN a2 IS NULL THEN lon ELSE lon + (lon2 - lon) * (t - a) / (a2 - a) END AS lon FROM wanted w ASOF JOIN kept k ON k.track_id = w.track_id AND w.t >= k.a
), turn AS (SELECT a.track_id, sum(a.lon * b.lat - b.lon * a.lat) AS area FROM sample a JOIN sample b ON b.track_id = a.track_id AND b.i = (a.i + 1) % 64 GROUP BY a.track_id)
SELECT track_id, 9e-1 + track_id % 10 / 1e2 >= 95e-2 AS is_loop, CASE WHEN area >= 0 THEN 'counterclockwise' ELSE 'clockwise' END AS direction, i::INTEGER AS i, round(lat, 7) AS latitude, round(lon, 7) AS longitude FROM sample JOIN turn USING (track_id)""",
}

BOOKKEEPING |= {
    "scalar_functions": f"""WITH o AS ({view_sql('odd_texts')}), p AS (SELECT *, CASE WHEN regexp_full_match(trim(number), '[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') THEN try_cast(trim(number) AS DOUBLE) END AS value, CASE WHEN regexp_full_match(instant, '.*T.*(Z|[+-][0-9:]+)') THEN epoch_ms(try_cast(instant AS TIMESTAMPTZ)) END AS ms FROM o)
SELECT k, round(value, 4) AS number, ms AS read_ms, round((ms - 1704067230000) / 1e3, 4) AS seconds, CASE WHEN ms >= 1704067230000 THEN round((ms - 1704067230000) / 1e3, 4) END AS duration, CASE WHEN x <= 250 THEN x END AS cadence, CASE WHEN x * 90000 < 10000000 THEN x * 90000 END AS odometer,
  round(CASE WHEN y > 0 THEN greatest(0e0, 1 - least(x / y, 1e0)) ELSE 0e0 END, 4) AS loop_score, round(CASE WHEN x > 50 THEN y / x END, 4) AS sinuosity, replace(regexp_replace(regexp_extract(file, '[^/]*$'), '[.][^.]*$', ''), '_', ' ') AS name,
  CASE WHEN abs(x / 10 - 12) < 1 THEN 'agrees with GPS' WHEN x / 10 > 12 THEN printf('reads %.1f %% long', x / 10 - 12) ELSE printf('reads %.1f %% short', 12 - x / 10) END AS hint, round(y / 50 / 21e-1, 2) AS gear, CAST(CAST(date_trunc('week', epoch_ms(ms)) AS DATE) AS STRING) AS week FROM p""",
    "feature_fingerprints": f"""WITH v AS ({view_sql('vectors')}) SELECT track_id, sha256(array_to_string(list_transform(range(1, 65), lambda i: printf('%.3f', 55 + embedding[i]::DOUBLE * 8e-3) || ':' || printf('%.3f', 12 + (i - 1) * 1e-3)), ',')) AS fingerprint FROM v""",
    "route_clusters": f"""{GROUPS}, lone AS (SELECT group_id, count(*) AS track_count, min(70e0 + track_id % 31) AS least_quality, sha256('v1:' || string_agg(track_id::VARCHAR, ',' ORDER BY track_id::VARCHAR)) AS fingerprint FROM member WHERE size > 1 GROUP BY group_id
), mean AS (SELECT group_id, avg(similarity) AS average_similarity FROM near WHERE track_id < other_id GROUP BY group_id
), kind AS (SELECT group_id, CASE WHEN count(DISTINCT activity_type) = 1 THEN max(activity_type) END AS activity_type FROM member JOIN v USING (track_id) GROUP BY group_id)
SELECT group_id, track_count, representative_id, least_quality, activity_type, fingerprint, round(average_similarity, 4) AS average_similarity, CASE WHEN representative_id % 4 > 0 THEN 'Ride ' || representative_id ELSE 'Matched route ' || group_id END AS name, 1 AS matcher_version,
  CASE WHEN track_count >= 10 AND average_similarity >= 85e-2 AND least_quality >= 85 THEN 'high' WHEN track_count >= 6 AND average_similarity >= 78e-2 AND least_quality >= 75 THEN 'medium' ELSE 'low' END AS confidence FROM lone JOIN lead USING (group_id) JOIN mean USING (group_id) JOIN kind USING (group_id)""",
}
