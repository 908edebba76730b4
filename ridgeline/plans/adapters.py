"""The engine's tables as views of the driver's tables.

A view is one SELECT that Spark and DuckDB both read, so that a query and its SQL start from the same rows;
``//`` is whole division.  Coordinates and measures are closed formulas of ids, with spikes, relocations, stale
starts, gaps and nulls put in.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import routes

VIEWS = {
    "points": """
SELECT track_id, 0 AS track_position, CAST(p // 50 AS INTEGER) AS segment_position, CAST(p AS INTEGER) AS position,
  55e0 + p * 25e-5 + CASE WHEN event_id % 53 = 0 THEN 1e-2 ELSE 0e0 END + 1e-2 * moves + CASE WHEN p < 3 AND track_id % 4 = 1 THEN -5e-3 ELSE 0e0 END AS latitude,
  12e0 + (track_id % 10) * 1e-3 AS longitude,
  CASE WHEN event_id % 29 <> 0 THEN 20e0 + (p % 40) * (1 + track_id % 3) * 1e0 + least(value, 400e0) / 193 END AS elevation_m,
  CAST(1 + event_id % 12 AS DOUBLE) AS hdop,
  CASE WHEN event_id % 3 <> 0 THEN 43e-1 + (event_id % 10) * 5e-2 END AS recorded_speed_mps,
  CASE WHEN event_id % 17 <> 0 THEN CAST(110 + (p * 3 + event_id % 5) % 60 AS DOUBLE) END AS heart_rate_bpm,
  CASE WHEN event_type = 'error' THEN 0e0 WHEN track_id % 7 <> 0 THEN CAST(70 + event_id % 30 AS DOUBLE) END AS cadence_rpm,
  CASE WHEN track_id % 3 = 0 THEN CASE WHEN p % 25 >= 18 THEN 2e-1 ELSE 46e-1 + (event_id % 7) * 1e-2 END END AS sensor_speed_mps,
  CASE WHEN track_id % 6 = 0 THEN p * 276e-1 END AS sensor_distance_m,
  1704067200000 + (p * 6 + (p // 20) * 40) * 1000 AS ms
FROM (
  SELECT user_id AS track_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p,
    sum(CASE WHEN event_id % 997 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS moves
  FROM events
) e""",
    "tracks": """
SELECT *, distance_m / avg_speed_mps AS moving_s, avg_speed_mps * 11e-1 AS best_1km_speed_mps, CASE WHEN distance_m >= 5000 THEN avg_speed_mps END AS best_5km_speed_mps, avg_speed_mps * 16e-1 AS max_speed_mps
FROM (
  SELECT o_orderkey AS track_id, o_custkey AS cluster_id, concat('Ride ', CAST(o_orderkey AS STRING)) AS name, concat('ride_', CAST(o_custkey AS STRING), '.gpx') AS source_filename,
    CASE o_orderstatus WHEN 'P' THEN 'analyzing' ELSE 'complete' END AS status,
    CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS started_at, CAST(o_orderdate AS TIMESTAMP) AS ended_at, CAST(o_orderdate AS TIMESTAMP) AS inserted_at,
    o_totalprice / 10 AS distance_m, 3e0 + (o_orderkey % 50) / 10e0 AS avg_speed_mps, (o_orderkey % 700) * 1e0 AS elevation_gain_m,
    CASE WHEN o_orderkey % 13 <> 0 THEN 60e0 + o_orderkey % 41 END AS quality_score, CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS max_speed_confidence,
    o_orderpriority AS activity_type, 5 + o_orderkey % 2 AS analysis_version
  FROM orders
) o""",
    "cells": "SELECT l_orderkey AS track_id, CAST(l_partkey AS STRING) AS cell, (l_partkey % 90) * 1e0 AS latitude, (l_partkey % 180) * 1e0 AS longitude, CAST(l_quantity AS BIGINT) AS point_count FROM lineitem",
    "items": """
SELECT l_orderkey * 10 + l_linenumber AS item_id, l_orderkey AS track_id, l_suppkey AS archive_id, concat('rides/', CAST(l_partkey AS STRING), '.gpx') AS path, 'only 3 points' AS reason,
  CASE WHEN l_suppkey % 4 = 0 AND l_linestatus = 'O' THEN 'queued' WHEN l_suppkey % 9 = 1 THEN 'failed' WHEN l_returnflag = 'A' THEN 'duplicate' WHEN l_returnflag = 'R' AND l_suppkey % 3 = 0 THEN 'failed' WHEN l_linenumber = 3 THEN 'insufficient_data' WHEN l_linenumber = 4 THEN 'skipped' ELSE 'complete' END AS status
FROM lineitem""",
    "archives": "SELECT s_suppkey AS archive_id, s_suppkey % 7 AS batch_id, CASE WHEN s_suppkey % 5 = 0 THEN 2000000 ELSE 0 END AS item_count, 'processing' AS status, 'Reading upload' AS stage, 10 AS progress, s_suppkey AS inserted_at FROM supplier",
    "recordings": "SELECT item_id, path, track_id, CAST(track_id % 4000 AS STRING) AS sha256 FROM (SELECT l_orderkey * 10 + l_linenumber AS item_id, concat('r/', CAST(l_orderkey * 10 + l_linenumber AS STRING)) AS path, l_orderkey AS track_id FROM lineitem) r",
    "rides": """
SELECT track_id, 0 AS track_position, CAST(CASE WHEN track_id % 8 = 3 THEN p // 300 ELSE 0 END AS INTEGER) AS segment_position, CAST(p AS INTEGER) AS position,
  55e0 + s * (5e-5 - 1e-9 * s) AS latitude, 12e0 + track_id % 10 * 1e-3 AS longitude, 20e0 + p // 100 % 2 AS elevation_m, 1e0 AS hdop, CAST(NULL AS DOUBLE) AS recorded_speed_mps,
  CASE WHEN NOT (track_id % 4 = 1 AND p = 320) THEN bpm END AS heart_rate_bpm,
  CASE WHEN track_id % 4 = 0 AND p BETWEEN 180 AND 299 THEN bpm + CASE WHEN p % 37 = 5 THEN 9e0 ELSE 2e0 - p % 3 END WHEN track_id % 4 = 0 AND p BETWEEN 170 AND 310 THEN bpm - 6 ELSE 85e0 + p % 7 END AS cadence_rpm,
  CAST(NULL AS DOUBLE) AS sensor_speed_mps, CAST(NULL AS DOUBLE) AS sensor_distance_m, 1704067200000 + s * 1000 AS ms
FROM (
  SELECT track_id, p, 4 * p - 4 * (p // 37) - CASE WHEN p % 37 >= 6 THEN 4 WHEN p % 37 = 5 THEN 2 ELSE 0 END AS s, CAST(118 + p // 40 + track_id % 3 AS DOUBLE) AS bpm
  FROM (SELECT l_suppkey AS track_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS p FROM lineitem) n
) r""",
    "riders": """
SELECT s_suppkey AS track_id, s_suppkey % 20 AS cluster_id, concat('Loop ', CAST(s_suppkey AS STRING)) AS name, 'complete' AS status, CAST(DATE '2024-01-01' + INTERVAL '1' DAY * (s_suppkey % 300) AS TIMESTAMP) AS started_at,
  10000e0 + s_suppkey % 4 * 300 AS distance_m, 2000e0 AS moving_s, 5e0 AS avg_speed_mps, 65e0 + s_suppkey % 31 AS quality_score, CASE WHEN s_suppkey % 9 = 1 THEN 'run' WHEN s_suppkey % 9 > 0 THEN 'ride' END AS activity_type
FROM supplier""",
    "stored_tracks": """
SELECT CAST(track_id % 4000 AS STRING) AS sha256, concat('r/', CAST(item_id AS STRING)) AS original_path, concat(CAST(item_id AS STRING), '.gpx') AS source_filename, CASE WHEN track_id % 31 = 0 THEN ' ' WHEN track_id % 37 <> 0 THEN 'Ride' END AS name,
  CAST(track_id % 104 - 1 AS INTEGER) AS progress, CASE WHEN track_id % 50 = 7 THEN 'lost' WHEN track_id % 50 <> 8 THEN 'complete' END AS status, CASE WHEN track_id % 3 = 0 THEN 'gpx' WHEN track_id % 61 = 1 THEN 'tcx' ELSE 'fit' END AS source_format
FROM (SELECT l_orderkey * 10 + l_linenumber AS item_id, l_orderkey AS track_id FROM lineitem) r""",
    "stored_items": "SELECT l_suppkey AS archive_id, l_linenumber AS position, CASE WHEN l_orderkey % 43 <> 0 THEN concat('rides/', CAST(l_partkey AS STRING), '.gpx') END AS path, CASE WHEN l_orderkey % 29 <> 0 THEN 'GPX' END AS type, CASE l_returnflag WHEN 'A' THEN 'extracted' WHEN 'R' THEN 'gone' ELSE 'complete' END AS status FROM lineitem",
    "stored_memberships": "SELECT o_custkey AS cluster_id, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderkey - o_orderkey % 2 END AS track_id, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey % 23 * 5e-2 END AS similarity FROM orders",
    "item_events": """
SELECT item_id, happened_at, event_id, CASE WHEN event_id % 41 = 0 THEN 'failed' WHEN event_id % 97 = 0 THEN 'lost' ELSE CASE (r + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) % 5 WHEN 1 THEN 'queued' WHEN 2 THEN 'parsing' WHEN 3 THEN 'analyzing' WHEN 4 THEN 'indexing' ELSE CASE WHEN event_id % 3 = 0 THEN 'insufficient_data' ELSE 'complete' END END END AS status,
  CASE WHEN event_id % 41 = 0 THEN concat('error ', CAST(event_id % 9 AS STRING)) END AS error
FROM (SELECT user_id AS item_id, ts AS happened_at, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) e""",
    "profiles": "SELECT CAST(n_nationkey + 1 AS BIGINT) AS revision, CAST(DATE '1992-03-01' + INTERVAL '1' DAY * (n_nationkey * 90) AS TIMESTAMP) AS valid_from, CASE WHEN n_nationkey % 7 = 3 THEN 'none' ELSE 'maximum' END AS mode, CAST(160 + n_nationkey * 3 AS INTEGER) AS maximum FROM nation",
    "sector_speeds": "SELECT l_suppkey AS track_id, l_linenumber AS number, avg(l_quantity) / 5 AS speed_mps FROM lineitem GROUP BY l_suppkey, l_linenumber",
    "odd_texts": """
SELECT c_custkey AS k, c_custkey % 270 * 1e0 AS x, c_custkey % 190 * 1e0 AS y, CASE c_custkey % 7 WHEN 0 THEN concat(' ', CAST(c_custkey AS STRING), ' ') WHEN 1 THEN concat('-', CAST(c_custkey AS STRING), '.5') WHEN 2 THEN '1e3' WHEN 3 THEN '12 km' WHEN 4 THEN '' WHEN 5 THEN '.5' END AS number,
  CASE c_custkey % 5 WHEN 0 THEN concat('2024-01-01T00:00:', CAST(10 + c_custkey % 50 AS STRING), 'Z') WHEN 1 THEN concat('2024-03-0', CAST(1 + c_custkey % 9 AS STRING), 'T10:00:00.250+02:00') WHEN 2 THEN '2024-01-01 00:00:00' WHEN 3 THEN '2024-13-01T00:00:00Z' END AS instant,
  CASE c_custkey % 3 WHEN 0 THEN concat('a/b_', CAST(c_custkey AS STRING), '_c.d.gpx') WHEN 1 THEN 'plain' ELSE concat('x_', c_mktsegment, '.FIT') END AS file
FROM customer""",
    "beats": "SELECT l_orderkey AS track_id, CAST(25 + l_partkey % 220 AS INTEGER) AS bpm, l_quantity * 1e0 AS seconds FROM lineitem",
    "vectors": "SELECT vec_id AS track_id, embedding, CAST(label AS STRING) AS activity_type, 10000e0 + (vec_id % 13) * 50 AS distance_m, 5e0 AS avg_speed_mps FROM embeddings",
}


def view_sql(name: str) -> str:
    """The view for DuckDB."""
    return VIEWS[name].strip()


_FROM = {"points": "events", "tracks": "orders", "cells": "lineitem", "items": "lineitem", "archives": "supplier", "recordings": "lineitem", "rides": "lineitem", "riders": "supplier", "vectors": "embeddings", "stored_tracks": "lineitem", "stored_items": "lineitem", "stored_memberships": "orders", "item_events": "events", "profiles": "nation", "beats": "lineitem", "odd_texts": "customer", "sector_speeds": "lineitem"}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    table = _FROM[name]
    rows = spark.read.parquet(f"{folder}/{table}.parquet")
    own = VIEWS[name].replace("//", "div")
    found = spark.sql(own.replace(f"FROM {table}", "FROM {source}"), source=rows)
    return found.withColumn("recorded_at", F.timestamp_millis("ms")).drop("ms") if "ms" in found.columns else found


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Routes of 64 samples: a vector's elements move the latitude; every third is a loop's label without being one."""
    rows = view(spark, folder, "vectors")
    samples = F.transform("embedding", lambda x, i: F.struct((55 + x.cast("double") * 0.008).alias("lat"), (12 + i * F.lit(0.001)).alias("lon")))
    return rows.select("track_id", samples.alias("samples"), "distance_m", "avg_speed_mps", "activity_type", F.lit(False).alias("is_loop"), F.lit("counterclockwise").alias("direction"))


def loops(spark: SparkSession, folder: str) -> DataFrame:
    """Round routes of 64 samples about 20 centres, each starting further along the circle."""
    angle = lambda i: (i + F.col("track_id")) % 64 * (2 * math.pi / 64)
    at = lambda i: F.struct((55 + F.col("cluster_id") * F.lit(0.1) + F.sin(angle(i)) * 0.01 + F.col("track_id") % 3 * F.lit(1e-4)).alias("lat"), (12 + F.cos(angle(i)) * 0.02).alias("lon"))
    samples = F.transform(F.sequence(F.lit(0), F.lit(63)), at)
    return view(spark, folder, "riders").select("track_id", samples.alias("samples"), "distance_m", "avg_speed_mps", "activity_type", F.lit(True).alias("is_loop"), routes.direction(samples).alias("direction"))
