"""Structured Streaming over arriving points: riding sessions by event time, and analysis of finished batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.points import derive_points
from ..operators.summary import analysed_tracks


def sessions(stream: DataFrame, gap: str = "30 seconds", late: str = "60 seconds") -> DataFrame:
    """Runs of a track's points without a gap: ``track_id, started_at, ended_at, point_count, average_bpm, top_mps``.

    Points later than ``late`` behind the newest are left out; a session is final once the watermark is past it.
    """
    windows = stream.withWatermark("recorded_at", late).groupBy("track_id", F.session_window("recorded_at", gap).alias("w"))
    rows = windows.agg(F.count(F.lit(1)).alias("point_count"), F.avg("heart_rate_bpm").alias("average_bpm"), F.max("recorded_speed_mps").alias("top_mps"))
    return rows.select("track_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "point_count", "average_bpm", "top_mps")


def analyse_arrivals(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Analyse each micro-batch of whole recordings into track rows below ``folder``; a batch done again replaces its own part."""

    def write(batch: DataFrame, number: int) -> None:
        analysed_tracks(derive_points(batch)).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
