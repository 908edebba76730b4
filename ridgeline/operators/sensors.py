"""Cadence and wheel-sensor measures over derived points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .points import by_track, same_segment


def sensor_spans(derived: DataFrame) -> DataFrame:
    """Pairs of consecutive points of a segment up to 30 s apart; the later one's values hold for the span."""
    w = by_track()
    dt = F.unix_millis("recorded_at") - F.lag(F.unix_millis("recorded_at")).over(w)
    odometer = F.col("sensor_distance_m") - F.lag("sensor_distance_m").over(w)
    located = F.col("valid") & F.col("derived_speed_mps").isNotNull()
    rows = derived.select(
        "track_id",
        "position",
        same_segment().alias("_same"),
        dt.alias("dt_ms"),
        F.col("cadence_rpm").alias("cadence"),
        F.col("sensor_speed_mps").alias("device_speed"),
        F.lag("sensor_speed_mps").over(w).alias("device_speed_before"),
        F.when(odometer >= 0, odometer).alias("device_m"),
        located.alias("located"),
        F.when(located, F.col("derived_speed_mps")).alias("gps_speed"),
        F.coalesce("gps_delta_m", "delta_m", F.lit(0.0)).alias("gps_m"),
        F.col("grade_percent").alias("grade"),
    )
    rows = rows.where(F.col("_same") & (F.col("dt_ms") > 0) & (F.col("dt_ms") <= C.GAP_MS)).drop("_same")
    rows = rows.withColumn("speed", F.coalesce("device_speed", "gps_speed"))
    moving = F.coalesce(F.col("speed") >= C.MOVING_MPS, F.lit(False))
    has = F.col("cadence").isNotNull()
    return rows.withColumns({"s": F.col("dt_ms") / 1000.0, "moving": moving, "turning": has & moving, "pedalling": F.coalesce(moving & (F.col("cadence") >= 1), F.lit(False))})


def _sum(x: Column, which: Column) -> Column:
    return F.coalesce(F.sum(F.when(which, x)), F.lit(0.0))


def weighted(x: str, which: Column) -> Column:
    """Aggregate: the time-weighted mean over the spans that are ``which``; null without any."""
    seconds = F.sum(F.when(which & F.col(x).isNotNull(), F.col("s")))
    return F.when(seconds > 0, F.sum(F.when(which, F.col(x) * F.col("s"))) / seconds)


def cadence_summary(derived: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per track that has cadence readings."""
    elapsed = (F.unix_millis(F.max("recorded_at")) - F.unix_millis(F.min("recorded_at"))) / 1000.0
    own = derived.groupBy("track_id").agg(F.count("cadence_rpm").alias("sample_count"), F.max("cadence_rpm").alias("maximum_rpm"), elapsed.alias("_elapsed")).where("sample_count > 0")
    has, turning, pedalling, s = F.col("cadence").isNotNull(), F.col("turning"), F.col("pedalling"), F.col("s")
    sums = spans.groupBy("track_id").agg(
        _sum(s, has).alias("covered_s"),
        _sum(s, turning).alias("moving_s"),
        _sum(s, pedalling).alias("pedaling_s"),
        weighted("cadence", pedalling).alias("average_rpm"),
        weighted("cadence", turning).alias("moving_average_rpm"),
        _sum(F.col("cadence") * s / 60, has).alias("revolutions"),
    )
    rows = own.join(sums, "track_id", "left").fillna(0.0, ["covered_s", "moving_s", "pedaling_s", "revolutions"]).withColumn("coasting_s", F.col("moving_s") - F.col("pedaling_s"))
    return rows.withColumns({"coverage_percent": F.when(F.col("_elapsed") > 0, F.col("covered_s") * 100 / F.col("_elapsed")), "coasting_percent": F.when(F.col("moving_s") > 0, F.col("coasting_s") * 100 / F.col("moving_s"))}).drop("_elapsed")


def cadence_histogram(spans: DataFrame) -> DataFrame:
    """Pedalled seconds and speed in bins of ten revolutions a minute."""
    rpm = (F.floor(F.col("cadence") / 10) * 10).cast("int")
    return spans.where("pedalling").groupBy("track_id", rpm.alias("rpm")).agg(F.sum("s").alias("seconds"), (weighted("speed", F.lit(True)) * 3.6).alias("speed_kmh"))


def terrain(spans: DataFrame) -> DataFrame:
    """Four bands of grade, always all of them, for each track with cadence on the move."""
    moving = spans.where("turning")
    bands = []
    for order, (key, label, low, high) in enumerate(C.TERRAIN):
        inside = F.col("grade").isNotNull()
        inside = inside if low is None else inside & (F.col("grade") >= low)
        inside = inside if high is None else inside & (F.col("grade") < high)
        pedalled, total = _sum(F.col("s"), inside & F.col("pedalling")), _sum(F.col("s"), inside)
        bands.append(
            F.struct(
                F.lit(order).alias("band_order"),
                F.lit(key).alias("band"),
                F.lit(label).alias("label"),
                total.alias("seconds"),
                weighted("cadence", inside & F.col("pedalling")).alias("average_rpm"),
                F.when(total > 0, (total - pedalled) / total * 100).alias("coasting_percent"),
                (weighted("speed", inside) * 3.6).alias("speed_kmh"),
            )
        )
    return moving.groupBy("track_id").agg(F.array(*bands).alias("bands")).select("track_id", F.inline("bands"))


def development(spans: DataFrame) -> DataFrame:
    """Seconds by metres travelled a crank turn, in bins of a quarter metre: peaks are the gears ridden."""
    metres = F.col("speed") * 60 / F.col("cadence")
    fits = F.col("pedalling") & (F.col("cadence") >= C.DEVELOPMENT_RPM) & (F.col("speed") >= C.DEVELOPMENT_MPS)
    rows = spans.where(fits).select("track_id", "s", metres.alias("m")).where(F.col("m").between(*C.DEVELOPMENT_RANGE_M))
    return rows.groupBy("track_id", F.round(F.floor(F.col("m") / C.DEVELOPMENT_BIN_M) * C.DEVELOPMENT_BIN_M, 2).alias("meters")).agg(F.sum("s").alias("seconds"))


def development_mode(bins: DataFrame) -> DataFrame:
    """The middle of the fullest bin, the smallest on ties."""
    return bins.groupBy("track_id").agg(F.min(F.struct((-F.col("seconds")).alias("below"), "meters")).alias("top")).select("track_id", (F.col("top.meters") + C.DEVELOPMENT_BIN_M / 2).alias("development_mode_m"))


def speed_sensor_summary(derived: DataFrame, spans: DataFrame) -> DataFrame:
    """The wheel sensor against GPS, one row per track that has readings.

    Distance is the odometer's if nine tenths of the spans with device speed carry it, else the speed integrated;
    GPS distance is over the same spans.  The difference needs a kilometre by GPS.
    """
    elapsed = (F.unix_millis(F.max("recorded_at")) - F.unix_millis(F.min("recorded_at"))) / 1000.0
    own = derived.groupBy("track_id").agg(F.count("sensor_speed_mps").alias("sample_count"), (F.max("sensor_speed_mps") * 3.6).alias("maximum_kmh"), elapsed.alias("_elapsed")).where("sample_count > 0")
    rows = spans.where("device_speed IS NOT NULL")
    quick = F.col("device_speed") >= C.MOVING_MPS
    compared = quick & (F.col("gps_speed") > 0)
    apart = F.abs(F.col("device_speed") - F.col("gps_speed"))
    counted = F.col("device_m").isNotNull()
    sums = rows.groupBy("track_id").agg(
        F.sum("s").alias("covered_s"),
        _sum(F.col("s"), quick).alias("moving_s"),
        (weighted("device_speed", quick) * 3.6).alias("average_moving_kmh"),
        (F.count_if(counted) >= 0.9 * F.count(F.lit(1))).alias("_by_odometer"),
        F.sum("device_m").alias("_odometer_m"),
        _sum(F.col("gps_m"), counted).alias("_odometer_gps_m"),
        F.sum((F.coalesce("device_speed_before", "device_speed") + F.col("device_speed")) / 2 * F.col("s")).alias("_integrated_m"),
        F.sum("gps_m").alias("_gps_m"),
        _sum(F.col("s"), compared).alias("compared_s"),
        F.median(F.when(compared, apart * 3.6)).alias("median_difference_kmh"),
        (F.count_if(compared & (apart <= 0.1 * F.col("gps_speed"))) * 100 / F.nullif(F.count_if(compared), F.lit(0))).alias("within_10_percent"),
        _sum(F.col("s"), ~F.col("located") & quick).alias("gps_gap_s"),
    )
    rows = own.join(sums, "track_id", "left").fillna(0.0, ["covered_s", "moving_s", "compared_s", "gps_gap_s"])
    by_odometer = F.coalesce(F.col("_by_odometer"), F.lit(False)) & F.col("_odometer_m").isNotNull()
    rows = rows.withColumns({"distance_source": F.when(by_odometer, "device").otherwise("integrated"), "distance_m": F.coalesce(F.when(by_odometer, F.col("_odometer_m")).otherwise(F.col("_integrated_m")), F.lit(0.0)), "gps_distance_m": F.coalesce(F.when(by_odometer, F.col("_odometer_gps_m")).otherwise(F.col("_gps_m")), F.lit(0.0))})
    fits = (F.col("gps_distance_m") >= 1000) & (F.col("distance_m") > 0)
    return rows.withColumns(
        {
            "coverage_percent": F.when(F.col("_elapsed") > 0, F.col("covered_s") * 100 / F.col("_elapsed")),
            "distance_difference_percent": F.when(fits, (F.col("distance_m") - F.col("gps_distance_m")) / F.col("gps_distance_m") * 100),
            "calibration_factor": F.when(fits, F.col("gps_distance_m") / F.col("distance_m")),
        }
    ).drop(*[c for c in rows.columns if c.startswith("_")])


def sensor_quality(points: DataFrame) -> DataFrame:
    """Invalid and missing cadence samples, by the recording's own text in ``extras``."""
    raw = F.coalesce(*[F.col("extras")[k] for k in ("cadence", "cad", "bike_cadence")])
    return points.groupBy("track_id").agg(F.count_if(raw.isNotNull() & F.col("cadence_rpm").isNull()).alias("cadence_invalid_samples"), F.count_if(raw.isNull() & F.col("cadence_rpm").isNull()).alias("cadence_missing_samples"))


def pedaling_overview(summaries: DataFrame) -> DataFrame:
    """Totals over all tracks' cadence summaries: the mean weighted by pedalled time, coasting share of moving time."""
    pedalled = F.sum("pedaling_s")
    return summaries.agg(
        F.count(F.lit(1)).alias("tracks"),
        pedalled.alias("pedaling_s"),
        F.when(pedalled > 0, F.sum(F.col("average_rpm") * F.col("pedaling_s")) / pedalled).alias("average_rpm"),
        F.when(F.sum("moving_s") > 0, F.sum("coasting_s") / F.sum("moving_s") * 100).alias("coasting_percent"),
        F.sum("revolutions").alias("revolutions"),
    )


def combined_terrain(bands: DataFrame) -> DataFrame:
    """Terrain bands over all tracks, in their order; pedalled time is what isn't coasted."""
    pedalled = F.col("seconds") * (1 - F.coalesce("coasting_percent", F.lit(0.0)) / 100)
    sums = bands.withColumn("_p", pedalled).groupBy("band_order", "band", "label").agg(F.sum("seconds").alias("seconds"), F.sum("_p").alias("pedaling_s"), F.sum(F.col("average_rpm") * F.col("_p")).alias("_turns"))
    return sums.withColumns({"average_rpm": F.when(F.col("pedaling_s") > 0, F.col("_turns") / F.col("pedaling_s")), "coasting_percent": F.when(F.col("seconds") > 0, (F.col("seconds") - F.col("pedaling_s")) / F.col("seconds") * 100)}).drop("_turns")


def display_rows(summary: DataFrame, histogram: DataFrame) -> DataFrame:
    """Rows for a cadence chart: coasting first, then the bins by label."""
    first = summary.select("track_id", F.lit(-1).alias("rpm"), F.lit("Coasting").alias("label"), F.col("coasting_s").alias("seconds"))
    bins = histogram.select("track_id", "rpm", F.concat(F.col("rpm").cast("string"), F.lit("–"), (F.col("rpm") + 9).cast("string")).alias("label"), "seconds")
    w = Window.partitionBy("track_id").orderBy("rpm")
    return first.unionByName(bins).withColumn("row", F.row_number().over(w))
