"""A synthetic library by closed formulas, for trying things out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def demo_points(spark: SparkSession, tracks: int = 36, points: int = 220) -> DataFrame:
    """Points of loops, out-and-backs and straight rides, one every 15 seconds, a week apart."""
    rows = spark.range(tracks * points)
    t, p = F.floor(F.col("id") / points), F.col("id") % points
    rows = rows.select(t.alias("track_id"), p.cast("int").alias("position"))
    turn = 2 * 3.141592653589793 * F.col("position") / (points - 1)
    shape = F.col("track_id") % 3
    along = F.when(shape == 1, F.lit(0.5) - F.abs(F.col("position") / (points - 1) - 0.5)).otherwise(F.col("position") / (points - 1))
    return rows.select(
        "track_id",
        F.lit(0).alias("track_position"),
        F.lit(0).alias("segment_position"),
        "position",
        (55.6 + F.when(shape == 0, 0.02 * F.sin(turn)).otherwise(0.1 * along) + 0.00001 * (F.col("track_id") % 5)).alias("latitude"),
        (12.5 + F.when(shape == 0, 0.035 * (1 - F.cos(turn))).otherwise(0.02 * along)).alias("longitude"),
        (40 + 18 * F.sin(turn) + 4 * F.cos(3 * turn)).alias("elevation_m"),
        F.timestamp_seconds(F.lit(1735722000) + F.col("track_id") * 604_800 + F.col("position") * 15).alias("recorded_at"),
        (1.5 + F.col("position") % 4).cast("double").alias("hdop"),
        F.lit(None).cast("double").alias("recorded_speed_mps"),
        (125 + 20 * F.sin(turn) + F.col("position") % 3).alias("heart_rate_bpm"),
        F.lit(None).cast("double").alias("cadence_rpm"),
        F.lit(None).cast("double").alias("sensor_speed_mps"),
        F.lit(None).cast("double").alias("sensor_distance_m"),
    )
