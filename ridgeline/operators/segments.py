"""Splits, best efforts, stops, climbs and segment summaries of derived points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .points import SEGMENT, by_track, timing_points


def _with_climbed(points: DataFrame) -> DataFrame:
    """Adds ``_up``: metres climbed so far, without a noise floor."""
    w = by_track()
    rise = F.greatest(F.coalesce(F.col("elevation_m") - F.lag("elevation_m").over(w), F.lit(0.0)), F.lit(0.0))
    return points.withColumn("_rise", rise).withColumn("_up", F.sum("_rise").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_rise")


def kilometre_splits(derived: DataFrame) -> DataFrame:
    """``track_id, position, start_distance_m, end_distance_m, duration_s, distance_m, avg_speed_mps, elevation_gain_m``.

    A kilometre lasts from the first point at or past its start to the first at or past its end.  Each point
    yields the boundaries that it is first to reach, so the work is linear in points and kilometres.
    """
    w = by_track()
    points = _with_climbed(timing_points(derived)).select("track_id", "position", "cumulative_m", F.unix_millis("recorded_at").alias("ms"), "_up")
    before = F.coalesce(F.lag("cumulative_m").over(w), F.lit(-1.0))
    whole = lambda c: F.floor(F.col(c) / 1000)
    held = points.withColumns({"_before": before, "_up_before": F.lag("_up").over(w), "_total": F.max("cumulative_m").over(Window.partitionBy("track_id")), "_up_total": F.max("_up").over(Window.partitionBy("track_id"))})
    reached = held.where(whole("cumulative_m") > whole("_before")).select("track_id", "_total", "_up_total", F.explode(F.sequence(whole("_before") + 1, whole("cumulative_m"))).alias("k"), "ms", "_up", F.lit(None).cast("double").alias("_last_up"))
    # The boundaries that a point is first to be beyond: up to them the climb counts.
    beyond = held.where(F.ceil(F.col("cumulative_m") / 1000) > F.ceil(F.greatest(F.col("_before"), F.lit(0.0)) / 1000)).select(
        "track_id", "_total", "_up_total", F.explode(F.sequence(F.ceil(F.greatest(F.col("_before"), F.lit(0.0)) / 1000), F.ceil(F.col("cumulative_m") / 1000) - 1)).alias("k"), F.lit(None).cast("bigint").alias("ms"), F.lit(None).cast("double").alias("_up"), F.coalesce("_up_before", F.lit(0.0)).alias("_last_up")
    )
    bounds = reached.unionByName(beyond).groupBy("track_id", "k").agg(F.max("ms").alias("ms"), F.max("_up").alias("first_up"), F.max("_last_up").alias("last_up"), F.max("_total").alias("total"), F.max("_up_total").alias("up_total"))
    by_k = Window.partitionBy("track_id").orderBy("k")
    duration = F.col("ms") - F.col("_ms")
    return (
        bounds.withColumns({"_ms": F.lag("ms").over(by_k), "_from_up": F.lag("first_up").over(by_k)})
        .where((F.col("k") >= 1) & (F.col("k") <= F.floor(F.col("total") / 1000)))
        .select(
            "track_id",
            F.col("k").cast("int").alias("position"),
            ((F.col("k") - 1) * 1000.0).alias("start_distance_m"),
            (F.col("k") * 1000.0).alias("end_distance_m"),
            F.when(duration >= 0, duration / 1000.0).alias("duration_s"),
            F.lit(1000.0).alias("distance_m"),
            F.when(duration > 0, 1000.0 / (duration / 1000.0)).alias("avg_speed_mps"),
            F.greatest(F.coalesce("last_up", "up_total") - F.col("_from_up"), F.lit(0.0)).alias("elevation_gain_m"),
        )
    )


def best_efforts(derived: DataFrame) -> DataFrame:
    """The fastest stretch of each effort distance, within one segment; columns as for kilometre splits, ``position`` being the distance.

    From each point the first one that is far enough is found by a growing window over falling distance;
    the shortest positive duration wins, the earliest start on ties.
    """
    points = _with_climbed(timing_points(derived)).select(*SEGMENT, "position", "cumulative_m", F.unix_millis("recorded_at").alias("ms"), "_up")
    peers = Window.partitionBy("track_id").orderBy("cumulative_m").rangeBetween(0, 0)
    points = points.withColumns({"_low": F.min("_up").over(peers), "_high": F.max("_up").over(peers)})
    falling = Window.partitionBy(*SEGMENT).orderBy(F.desc("cumulative_m"))
    far = {f"_{d}": F.min(F.struct("position", "ms", "cumulative_m", "_high")).over(falling.rangeBetween(Window.unboundedPreceding, -d)) for d in C.EFFORT_DISTANCES_M}
    ends = points.withColumns(far)

    def best(d: int) -> Column:
        end = F.col(f"_{d}")
        took = end["ms"] - F.col("ms")
        return F.min(F.when(took > 0, F.struct(took.alias("took"), F.col("position"), F.col("cumulative_m").alias("start_m"), end["cumulative_m"].alias("end_m"), (end["_high"] - F.col("_low")).alias("up")))).alias(f"_{d}")

    rows = ends.groupBy("track_id").agg(*[best(d) for d in C.EFFORT_DISTANCES_M])
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"_{d}").alias("b")) for d in C.EFFORT_DISTANCES_M])).alias("e")
    return (
        rows.select("track_id", each)
        .where("e.b IS NOT NULL")
        .select(
            "track_id",
            F.col("e.d").alias("position"),
            F.col("e.b.start_m").alias("start_distance_m"),
            F.col("e.b.end_m").alias("end_distance_m"),
            (F.col("e.b.took") / 1000.0).alias("duration_s"),
            F.col("e.d").cast("double").alias("distance_m"),
            (F.col("e.d") / (F.col("e.b.took") / 1000.0)).alias("avg_speed_mps"),
            F.greatest(F.col("e.b.up"), F.lit(0.0)).alias("elevation_gain_m"),
        )
    )


def splits(derived: DataFrame) -> DataFrame:
    """Kilometre splits and best efforts together, by ``kind``."""
    return kilometre_splits(derived).withColumn("kind", F.lit("kilometer")).unionByName(best_efforts(derived).withColumn("kind", F.lit("best_effort")))


def _islands(points: DataFrame, inside: Column) -> DataFrame:
    """The rows inside, with ``_island`` numbering runs of consecutive ones in a track."""
    w = by_track()
    marked = points.withColumn("_in", F.coalesce(inside, F.lit(False)))
    opens = F.when(F.col("_in") & ~F.coalesce(F.lag("_in").over(w), F.lit(False)), 1).otherwise(0)
    return marked.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_in").drop("_in", "_opens")


def _numbered(events: DataFrame) -> DataFrame:
    return events.withColumn("position", F.row_number().over(Window.partitionBy("track_id").orderBy("start_point_position")) - 1)


_ENDS = (F.min, F.max)


def _span() -> list[Column]:
    return [
        F.min("position").alias("start_point_position"),
        F.max("position").alias("end_point_position"),
        F.min_by("cumulative_m", "position").alias("start_distance_m"),
        F.max_by("cumulative_m", "position").alias("end_distance_m"),
    ]


def stops(derived: DataFrame) -> DataFrame:
    """Runs of points slower than 2 km/h that last 30 s or more; a point without credited time ends a run."""
    slow = (F.col("delta_ms") > 0) & (F.coalesce("speed_mps", F.lit(0.0)) < C.MOVING_MPS)
    rows = _islands(derived, slow).groupBy("track_id", "_island").agg(*_span(), F.sum("delta_ms").alias("_ms"))
    return _numbered(rows.where(F.col("_ms") >= C.STOP_MINIMUM_MS)).withColumn("duration_s", F.col("_ms") / 1000.0).drop("_ms", "_island")


def climbs(derived: DataFrame) -> DataFrame:
    """Runs of points at a grade of 2 per cent or more, 300 m or longer, that gain 20 m or more."""
    rows = _islands(derived, F.col("grade_percent") >= C.CLIMB_GRADE).groupBy("track_id", "_island").agg(
        *_span(), F.min_by("elevation_m", "position").alias("_from"), F.max("elevation_m").alias("_top"), F.max("grade_percent").alias("max_grade")
    )
    length = F.col("end_distance_m") - F.col("start_distance_m")
    shaped = rows.withColumns({"gain_m": F.greatest(F.col("_top") - F.col("_from"), F.lit(0.0)), "distance_m": length})
    kept = shaped.where((F.col("distance_m") >= C.CLIMB_LENGTH_M) & (F.col("gain_m") >= C.CLIMB_GAIN_M))
    return _numbered(kept).withColumn("average_grade", F.col("gain_m") / F.col("distance_m") * 100).drop("_island", "_from", "_top")


def track_events(derived: DataFrame) -> DataFrame:
    """Stops and climbs together, by ``kind``, with the measures of a climb in ``metrics``."""
    climb = climbs(derived).withColumns({"kind": F.lit("climb"), "duration_s": F.lit(None).cast("double"), "metrics": F.create_map(*[x for c in ("gain_m", "distance_m", "average_grade", "max_grade") for x in (F.lit(c), F.col(c))])})
    stop = stops(derived).withColumns({"kind": F.lit("stop"), "metrics": F.create_map().cast("map<string,double>")})
    columns = ["track_id", "kind", "position", "start_point_position", "end_point_position", "start_distance_m", "end_distance_m", "duration_s", "metrics"]
    return stop.select(*columns).unionByName(climb.select(*columns))


def segment_summary(segments: DataFrame, derived: DataFrame) -> DataFrame:
    """Per segment: point count, first and last time, distance; segments without points have zero."""
    sums = derived.groupBy(*SEGMENT).agg(F.count(F.lit(1)).alias("point_count"), F.min("recorded_at").alias("started_at"), F.max("recorded_at").alias("ended_at"), F.sum("delta_m").alias("distance_m"))
    return segments.select(*SEGMENT).distinct().join(sums, list(SEGMENT), "left").fillna({"point_count": 0, "distance_m": 0.0})
