"""Bookkeeping of imports: counters, status ladders, recent archives, validation, status changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C

# Statuses of files and archives.
DONE_WELL = ("complete", "duplicate", "insufficient_data")
TERMINAL = ("complete", "partial", "failed", "duplicate")
PROGRESS = {"queued": 0, "parsing": 12, "analyzing": 48, "indexing": 82, "complete": 100, "insufficient_data": 100}


def archive_counters(archives: DataFrame, items: DataFrame) -> DataFrame:
    """Per archive: counts by outcome, status, stage and progress.  ``archives``: ``archive_id, batch_id, item_count, status, stage, progress``; ``items``: ``archive_id, status``."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    counts = items.groupBy("archive_id").agg(F.count(F.lit(1)).alias("_rows"), is_(*DONE_WELL).alias("complete_count"), is_("failed").alias("failed_count"), is_("duplicate").alias("duplicate_count"), is_("skipped").alias("_skipped"))
    rows = archives.join(counts, "archive_id", "left").fillna(0, ["_rows", "complete_count", "failed_count", "duplicate_count", "_skipped"])
    rows = rows.withColumn("item_count", F.greatest("item_count", "_rows")).withColumn("_done", F.col("complete_count") + F.col("failed_count") + F.col("_skipped"))
    n, failed = F.col("item_count"), F.col("failed_count")
    settled = (n == 0) & F.col("status").isin("failed", "complete")

    def ladder(column: str, empty: str, busy: str, bad: str, mixed: str, good: str) -> Column:
        return F.when(settled, F.col(column)).when(n == 0, empty).when(F.col("_done") < n, busy).when(failed == n, bad).when(failed > 0, mixed).otherwise(good)

    return rows.withColumns(
        {
            "status": ladder("status", "processing", "processing", "failed", "partial", "complete"),
            "stage": ladder("stage", "Reading upload", "Analyzing tracks", "Import failed", "Completed with issues", "Ready to explore"),
            "progress": F.when(n > 0, F.least(F.lit(100), F.lit(35) + F.round(F.col("_done") / n * 65).cast("int"))).otherwise(F.col("progress")),
        }
    ).drop("_rows", "_skipped", "_done")


def batch_rollup(batches: DataFrame, archives: DataFrame) -> DataFrame:
    """Per batch the sums over its archives and its status.  ``batches``: ``batch_id, status``."""
    counts = ("item_count", "complete_count", "duplicate_count", "failed_count")
    sums = archives.groupBy("batch_id").agg(F.count(F.lit(1)).alias("archive_count"), *[F.sum(c).alias(c) for c in counts], F.bool_and(F.col("status").isin(*TERMINAL)).alias("_over"))
    rows = batches.select("batch_id", "status").join(sums, "batch_id", "left").fillna(0, ["archive_count", *counts])
    over = F.coalesce("_over", F.lit(False))
    return rows.withColumn("status", F.when(F.col("status") == "uploading", "uploading").when(~over, "processing").when(F.col("failed_count") > 0, "partial").otherwise("complete")).drop("_over")


def recent_archives(archives: DataFrame, items: DataFrame, n: int = 20) -> DataFrame:
    """The newest archives with the files left out as too empty, and why."""
    newest = archives.orderBy(F.desc("inserted_at"), F.desc("archive_id")).limit(n)
    skipped = items.where(F.col("status") == "insufficient_data").join(newest.select("archive_id"), "archive_id", "left_semi").groupBy("archive_id").agg(F.array_sort(F.collect_list(F.struct("path", "reason"))).alias("skipped"))
    return newest.join(skipped, "archive_id", "left").withColumn("skipped", F.coalesce("skipped", F.array().cast(skipped.schema["skipped"].dataType)))


def mark_items(items: DataFrame, tracks: DataFrame) -> DataFrame:
    """Items with the status of their track, where it has one."""
    of = tracks.select("track_id", F.col("status").alias("_status"))
    return items.join(of, "track_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def touched_archives(items: DataFrame, track_ids: DataFrame) -> DataFrame:
    return items.join(track_ids, "track_id", "left_semi").select("archive_id").distinct()


def with_status(rows: DataFrame, status: str, error: str | None = None) -> DataFrame:
    """Rows moved to a status, with its progress and, on failure, the error's text."""
    step = PROGRESS.get(status)
    return rows.withColumns({"status": F.lit(status), "progress": F.lit(step) if step is not None else F.col("progress"), "error": F.lit(error).cast("string")})


def new_recordings(recordings: DataFrame, known: DataFrame) -> DataFrame:
    """Recordings whose content is not known yet, one of each: ``sha256`` decides, the smallest ``path`` is kept."""
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("path"))
    return recordings.withColumn("_r", first).where("_r = 1").drop("_r").join(known.select("sha256"), "sha256", "left_anti")


def duplicates(recordings: DataFrame, known: DataFrame) -> DataFrame:
    """The other recordings, with the track that has their content if there is one."""
    first = F.row_number().over(Window.partitionBy("sha256").orderBy("path"))
    rows = recordings.withColumn("_r", first).join(known.select("sha256", F.col("track_id").alias("existing_track_id")), "sha256", "left")
    return rows.where((F.col("_r") > 1) | F.col("existing_track_id").isNotNull()).drop("_r")


def problems(tracks: DataFrame) -> DataFrame:
    """``problems``: which rules a track row breaks; empty if none."""
    rules = {
        "status": F.col("status").isin(*C.PROCESSING_STATUSES, "complete", "insufficient_data", "failed", "duplicate"),
        "confidence": F.col("max_speed_confidence").isNull() | F.col("max_speed_confidence").isin("high", "medium", "low"),
        "distance": F.col("distance_m").isNull() | (F.col("distance_m") >= 0),
        "quality": F.col("quality_score").isNull() | F.col("quality_score").between(0, 100),
    }
    return tracks.withColumn("problems", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))


def replace_tracks(stored: DataFrame, analysed: DataFrame) -> DataFrame:
    """The stored rows with those of newly analysed tracks replaced."""
    return stored.join(analysed.select("track_id").distinct(), "track_id", "left_anti").unionByName(analysed, allowMissingColumns=True)


def delete_tracks(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("track_id"), "track_id", "left_anti")
