"""Track summaries, peak speed and its confidence, coverage cells, renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.geo import bearing, geohash, haversine, polyline_encode
from ..functions.scalars import loop_score, plausible_reading, sinuosity, skip_reason
from ..functions.stats import upper_median
from .points import SEGMENT, by_track, same_segment
from .segments import best_efforts


def _device_speed() -> Column:
    return F.coalesce(F.col("sensor_speed_mps"), F.when(F.col("derived_speed_mps").isNotNull(), F.col("recorded_speed_mps")))


def device_check() -> Column:
    """Whether the recorder's own speed confirms the one between fixes: agrees, disagrees or unavailable."""
    device, gps = _device_speed(), F.col("gps_speed_mps")
    return F.when(device.isNull() | gps.isNull(), "unavailable").when(device >= gps * C.PEAK_AGREEMENT, "agrees").otherwise("disagrees")


def _peak_speed() -> Column:
    """A point's speed if it may be the peak: with a wheel sensor its readings, else fixes that the device doesn't contradict."""
    sensor = F.when(plausible_reading(F.col("sensor_speed_mps")), F.col("sensor_speed_mps"))
    gps = F.when(plausible_reading(F.col("gps_speed_mps")) & (device_check() != "disagrees"), F.col("gps_speed_mps"))
    speed = F.when(F.col("speed_source") == "sensor", sensor).otherwise(gps)
    return F.when(speed > 0, speed)


def peak_speeds(derived: DataFrame) -> DataFrame:
    """``track_id, max_speed_mps, max_speed_point_position, speed_p95_mps, max_speed_confidence, confidence_reasons``; the first maximum is the peak."""
    w = by_track()
    same, following = same_segment(), F.coalesce((F.lead("track_position").over(w) == F.col("track_position")) & (F.lead("segment_position").over(w) == F.col("segment_position")), F.lit(False))
    readable = F.when(F.col("speed_source") == "sensor", F.when(plausible_reading(F.col("sensor_speed_mps")), F.col("sensor_speed_mps"))).otherwise(F.col("gps_speed_mps"))
    own = F.when(F.col("speed_source") == "sensor", F.col("sensor_speed_mps")).otherwise(F.col("gps_speed_mps"))
    beside = derived.withColumns({"_peak": _peak_speed(), "_readable": readable, "_own": own}).withColumns({"_left": F.when(same, F.lag("_readable").over(w)), "_right": F.when(following, F.lead("_readable").over(w))})
    near = F.coalesce(F.col("_left") >= F.col("_own") * C.PEAK_AGREEMENT, F.lit(False)) | F.coalesce(F.col("_right") >= F.col("_own") * C.PEAK_AGREEMENT, F.lit(False))
    timed = F.coalesce(F.col("gps_delta_ms").between(1_000, 15_000), F.lit(False))
    precise = F.coalesce(F.col("hdop") <= C.MAX_HDOP, F.lit(True))
    sure = (device_check() == "agrees") | near
    by_sensor = F.col("speed_source") == "sensor"
    confidence = F.when(by_sensor, F.when(near, "high").otherwise("medium")).when(timed & precise & sure, "high").when(timed & precise, "medium").otherwise("low")
    reasons = F.when(by_sensor, F.when(near, F.array().cast("array<string>")).otherwise(F.array(F.lit("no adjacent wheel-sensor reading within 80% of the peak")))).otherwise(
        F.array_compact(
            F.array(
                F.when(~timed, F.lit("sample interval outside 1–15 seconds")),
                F.when(~precise, F.lit("HDOP above 10")),
                F.when(~sure, F.lit("no adjacent sample within 80% of the peak")),
            )
        )
    )
    judged = beside.where("_peak IS NOT NULL").select("track_id", "position", F.col("_peak").alias("speed"), confidence.alias("confidence"), reasons.alias("reasons"))
    first = F.min(F.struct((-F.col("speed")).alias("below"), "position", "confidence", "reasons")).alias("top")
    return judged.groupBy("track_id").agg(first, F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY speed)").alias("speed_p95_mps")).select(
        "track_id",
        (-F.col("top.below")).alias("max_speed_mps"),
        F.col("top.position").alias("max_speed_point_position"),
        "speed_p95_mps",
        F.col("top.confidence").alias("max_speed_confidence"),
        F.col("top.reasons").alias("confidence_reasons"),
    )


def quality_score(invalid: Column, missing_time: Column, missing_elevation: Column, high_hdop: Column, n: Column) -> Column:
    """A hundred, less what shares of bad points cost; zero at least."""
    return F.greatest(F.lit(0.0), 100.0 - 40 * invalid / n - 30 * missing_time / n - 15 * missing_elevation / n - 15 * high_hdop / n)


def median_sample_seconds(derived: DataFrame) -> DataFrame:
    """Per track the upper median of positive times between consecutive points, across segments.

    Counted by distinct gap first, so a track's gaps are never gathered row by row.
    """
    gap = F.unix_millis("recorded_at") - F.lag(F.unix_millis("recorded_at")).over(by_track())
    counts = derived.select("track_id", gap.alias("gap")).where("gap > 0").groupBy("track_id", "gap").agg(F.count(F.lit(1)).alias("n"))
    running = counts.withColumns({"_to": F.sum("n").over(Window.partitionBy("track_id").orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(Window.partitionBy("track_id"))})
    return running.where(F.col("_to") > F.floor(F.col("_all") / 2)).groupBy("track_id").agg((F.min("gap") / 1000.0).alias("median_sample_seconds"))


def track_summary(derived: DataFrame) -> DataFrame:
    """One row per track: times, distance, speeds, elevation, bounds, quality and shape."""
    located = lambda c: F.when(F.col("valid"), F.col(c))
    ends = lambda f, c: f(located(c), F.when(F.col("valid"), F.col("position")))
    n = F.count(F.lit(1))
    missing = lambda c: F.count_if(F.col(c).isNull())
    rows = derived.groupBy("track_id").agg(
        n.alias("point_count"),
        F.count_distinct(*SEGMENT[1:]).alias("segment_count"),
        F.sum("delta_m").alias("distance_m"),
        ((F.unix_millis(F.max("recorded_at")) - F.unix_millis(F.min("recorded_at"))) / 1000.0).alias("elapsed_s"),
        (F.sum("moving_ms") / 1000.0).alias("moving_s"),
        F.sum("gain_m").alias("elevation_gain_m"),
        F.sum("loss_m").alias("elevation_loss_m"),
        F.min("elevation_m").alias("min_elevation_m"),
        F.max("elevation_m").alias("max_elevation_m"),
        F.min("recorded_at").alias("started_at"),
        F.max("recorded_at").alias("ended_at"),
        F.min(located("latitude")).alias("min_lat"),
        F.max(located("latitude")).alias("max_lat"),
        F.min(located("longitude")).alias("min_lon"),
        F.max(located("longitude")).alias("max_lon"),
        *[ends(f, c).alias(f"_{name}_{c}") for f, name in ((F.min_by, "first"), (F.max_by, "last")) for c in ("latitude", "longitude")],
        F.count_if(~F.col("valid")).alias("_invalid"),
        F.count_if("gps_warmup").alias("gps_warmup_points"),
        missing("recorded_at").alias("missing_time_points"),
        missing("elevation_m").alias("missing_elevation_points"),
        F.count_if(F.col("hdop") > C.MAX_HDOP).alias("high_hdop_points"),
        (F.count("recorded_speed_mps") / n).alias("recorded_speed_coverage"),
        (F.count("elevation_m") / n).alias("elevation_coverage"),
        F.first("distance_source").alias("distance_source"),
        F.first("speed_source").alias("speed_source"),
    )
    corners = [F.col(f"_{name}_{c}") for name in ("first", "last") for c in ("latitude", "longitude")]
    moved = F.coalesce(haversine(*corners), F.lit(0.0))
    return (
        rows.withColumn("displacement_m", moved)
        .withColumns(
            {
                "analysis_version": F.lit(C.ANALYSIS_VERSION),
                "stopped_s": F.greatest(F.col("elapsed_s") - F.col("moving_s"), F.lit(0.0)),
                "avg_speed_mps": F.when(F.col("moving_s") > 0, F.col("distance_m") / F.col("moving_s")),
                "quality_score": quality_score(F.col("_invalid"), F.col("missing_time_points"), F.col("missing_elevation_points"), F.col("high_hdop_points"), F.col("point_count")),
                "invalid_spike_points": F.col("_invalid") - F.col("gps_warmup_points"),
                "loop_score": loop_score(F.col("displacement_m"), F.col("distance_m")),
                "sinuosity": sinuosity(F.col("displacement_m"), F.col("distance_m")),
                "dominant_bearing_degrees": bearing(*corners),
                "skip_reason": skip_reason(F.col("point_count"), F.col("distance_m"), F.col("moving_s")),
            }
        )
        .withColumn("status", F.when(F.col("skip_reason").isNull(), "complete").otherwise("insufficient_data"))
        .drop("_invalid", *[f"_{name}_{c}" for name in ("first", "last") for c in ("latitude", "longitude")])
    )


def analysed_tracks(derived: DataFrame) -> DataFrame:
    """The summary with peak speed, 1 km and 5 km bests and the median sample time: the full track row."""
    efforts = best_efforts(derived).groupBy("track_id").agg(*[F.max(F.when(F.col("position") == d, F.col("avg_speed_mps"))).alias(f"best_{d // 1000}km_speed_mps") for d in C.EFFORT_DISTANCES_M[:2]])
    return track_summary(derived).join(peak_speeds(derived), "track_id", "left").join(efforts, "track_id", "left").join(median_sample_seconds(derived), "track_id", "left")


def route_cells(derived: DataFrame, precision: int = 7) -> DataFrame:
    """The geohash cells that a track's accepted fixes visit: mean position and count."""
    rows = derived.where("valid").withColumn("cell", geohash(F.col("latitude"), F.col("longitude"), precision))
    return rows.groupBy("track_id", "cell").agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.count(F.lit(1)).alias("point_count")).withColumn("precision", F.lit(precision))


def downsample(derived: DataFrame, most: int) -> DataFrame:
    """Every step-th point of a track and its last one, step = ceil(points / most).

    A kept point takes over the ``hr_break`` and ``hr_jump`` flags of those left out since the one kept before.
    """
    w, whole = by_track(), Window.partitionBy("track_id")
    rows = derived.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(whole)})
    rows = rows.withColumn("_step", F.ceil(F.col("_n") / most)).withColumn("_bucket", F.ceil(F.col("_i") / F.col("_step")))
    bucket = Window.partitionBy("track_id", "_bucket")
    flags = {c: F.coalesce(F.max(c).over(bucket), F.lit(False)) for c in ("hr_break", "hr_jump") if c in derived.columns}
    kept = (F.col("_i") % F.col("_step") == 0) | (F.col("_i") == F.col("_n") - 1)
    return rows.withColumns(flags).where(kept).drop("_i", "_n", "_step", "_bucket")


def renderings(derived: DataFrame) -> DataFrame:
    """``track_id, level, point_count, encoded_polyline, series``: at most 601 or 2,501 points a row, so its arrays are bounded.

    Points are derived once for both levels and kept as in ``downsample``.  Only kept points, with the columns of a
    series, go on to be gathered, in tasks of their own; flags of points left out come with them as running counts.
    """
    w = by_track()
    flags = [c for c in ("hr_jump", "hr_break") if c in derived.columns]
    running = {f"_{c}": F.sum(F.coalesce(F.col(c), F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in flags}
    rows = derived.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("track_id")), **running})
    kept = [F.when((F.col("_i") % F.ceil(F.col("_n") / most) == 0) | (F.col("_i") == F.col("_n") - 1), level) for level, most in C.RENDERING_SIZES.items()]
    point = F.struct(
        "position",
        F.round(F.col("cumulative_m") / 1000, 3).alias("distance_km"),
        F.round("elevation_m", 1).alias("elevation_m"),
        F.round(F.col("speed_mps") * 3.6, 1).alias("speed_kmh"),
        F.round("grade_percent", 1).alias("grade_percent"),
        "heart_rate_bpm",
        *[F.col(f"_{c}").alias(c) if c in flags else F.lit(None).cast("boolean").alias(c) for c in ("hr_jump", "hr_break")],
        F.round("cadence_rpm", 0).alias("cadence_rpm"),
        F.round(F.col("sensor_speed_mps") * 3.6, 1).alias("sensor_speed_kmh"),
        F.col("recorded_at").alias("time"),
        "latitude",
        "longitude",
    )
    levels = rows.select("track_id", F.array_compact(F.array(*kept)).alias("levels"), point.alias("point")).where(F.size("levels") > 0).select("track_id", F.explode("levels").alias("level"), "point")
    found = levels.repartition("track_id", "level").groupBy("track_id", "level").agg(F.array_sort(F.collect_list("point")).alias("points"))
    if flags:
        before = F.concat(F.slice("points", 1, 1), F.slice("points", F.lit(1), F.size("points") - 1))

        def own(p, q, c):
            """Whether a flag was set since the point before; the first point has its own alone."""
            return F.when(p["position"] == q["position"], p[c] > 0).otherwise(p[c] > q[c]).alias(c)

        fields = [f.name for f in found.schema["points"].dataType.elementType.fields]
        found = found.withColumn("points", F.zip_with("points", before, lambda p, q: F.struct(*[own(p, q, c) if c in flags else p[c].alias(c) for c in fields])))
    at = F.transform("points", lambda p: F.struct(p["latitude"].alias("lat"), p["longitude"].alias("lon")))
    series = F.transform("points", lambda p: p.dropFields("latitude", "longitude"))
    return found.select("track_id", "level", F.size("points").alias("point_count"), polyline_encode(at).alias("encoded_polyline"), series.alias("series"), at.alias("path"))


def sample_seconds_of(values: Column) -> Column:
    """The upper median of an array of sample times."""
    return upper_median(values)
