"""From recorded points to derived ones: warm-up, accepted fixes, credited distance and time, grade.

Points are rows ``track_id, track_position, segment_position, position, latitude, longitude, elevation_m,
recorded_at, hdop, recorded_speed_mps, heart_rate_bpm, cadence_rpm, sensor_speed_mps, sensor_distance_m``; other
columns are passed through.  Everything here is partitioned by ``track_id`` alone, so that one shuffle serves all
windows before the sequential pass and one serves all after it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.geo import haversine
from ..functions.scalars import effective_speed, gps_speed, plausible_reading, plausible_step

SEGMENT = ("track_id", "track_position", "segment_position")


def by_track():
    return Window.partitionBy("track_id").orderBy("position")


def by_segment():
    return Window.partitionBy(*SEGMENT).orderBy("position")


def same_segment() -> Column:
    """Whether the row before, in the track's order, is of the same segment; false for the first."""
    w = by_track()
    return F.coalesce((F.lag("track_position").over(w) == F.col("track_position")) & (F.lag("segment_position").over(w) == F.col("segment_position")), F.lit(False))


def with_sources(points: DataFrame) -> DataFrame:
    """Adds ``distance_source`` (odometer, wheel_speed or gps) and ``speed_source`` (sensor or gps).

    A channel is taken if nine tenths of the track's points carry it.
    """
    w = Window.partitionBy("track_id")
    share = lambda c: F.count(c).over(w) >= C.SENSOR_COVERAGE * F.count(F.lit(1)).over(w)
    return points.withColumns(
        {
            "distance_source": F.when(share("sensor_distance_m"), "odometer").when(share("sensor_speed_mps"), "wheel_speed").otherwise("gps"),
            "speed_source": F.when(share("sensor_speed_mps"), "sensor").otherwise("gps"),
        }
    )


def with_warmup(points: DataFrame) -> DataFrame:
    """Adds ``gps_warmup``: fixes before the last implausible step within a segment's first minute."""
    w, whole = by_segment(), Window.partitionBy(*SEGMENT)
    now = F.unix_millis("recorded_at")
    dt = now - F.lag(now).over(w)
    step = F.when(dt > 0, haversine(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude")) / (dt / 1000.0))
    early = now - F.first(now).over(w) <= C.GPS_WARMUP_MS
    return (
        points.withColumn("_cut", F.when(early & ~plausible_step(step), F.col("position")))
        .withColumn("gps_warmup", F.coalesce(F.col("position") < F.max("_cut").over(whole), F.lit(False)))
        .drop("_cut")
    )


def _distance(lat1, lon1, lat2, lon2):
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * C.EARTH_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


_PASS = [("valid", pa.bool_(), "boolean"), ("derived_speed_mps", pa.float64(), "double"), ("gps_delta_m", pa.float64(), "double"), ("gps_delta_ms", pa.int64(), "bigint"), ("gain_m", pa.float64(), "double"), ("loss_m", pa.float64(), "double")]


class Acceptance:
    """The acceptance pass over rows in order of track and position, batch by batch; a track may span batches.

    Runs of fixes that each follow plausibly from the one before are judged together; only where one doesn't
    is the anchor (the last accepted fix) and the pending fix (rejected, but maybe the new place) followed singly.
    Both are ``(key, latitude, longitude, milliseconds, elevation)`` or None, and are all that lasts between batches.
    """

    def __init__(self, anchor: tuple | None = None, pending: tuple | None = None):
        self.anchor, self.pending = anchor, pending

    def run(self, batch: pa.RecordBatch) -> pa.RecordBatch | None:
        """The batch without ``_ms`` and with the new columns; None if it has no rows."""
        anchor, pending = self.anchor, self.pending
        n = batch.num_rows
        if not n:
            return None
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        number = lambda c: column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
        keys = list(zip(*(column(c).to_pylist() for c in SEGMENT), strict=True))
        lat, lon, ele, ms = number("latitude"), number("longitude"), number("elevation_m"), number("_ms")
        warm = column("gps_warmup").to_numpy(zero_copy_only=False).astype(bool)
        same = np.zeros(n, dtype=bool)
        same[1:] = [a == b for a, b in zip(keys, keys[1:], strict=False)]
        dist, dt, climb = np.zeros(n), np.full(n, np.nan), np.full(n, np.nan)
        dist[1:], dt[1:], climb[1:] = _distance(lat[:-1], lon[:-1], lat[1:], lon[1:]), np.diff(ms), np.diff(ele)
        speed = np.full(n, np.nan)
        np.divide(dist, dt / 1000, out=speed, where=dt > 0)
        ok = ~(speed > C.MAX_PLAUSIBLE_MPS)
        valid = np.ones(n, dtype=bool)
        out_speed, out_dist, out_ms, out_climb = np.where(same, speed, np.nan), np.where(same, dist, 0.0), np.where(same, dt, np.nan), np.where(same, climb, np.nan)

        def step(start, i):
            d = float(_distance(start[1], start[2], lat[i], lon[i]))
            seconds = (ms[i] - start[3]) / 1000
            return d, seconds, d / seconds if seconds > 0 else math.nan

        def put(i, accepted, v=math.nan, d=0.0, seconds=math.nan, up=math.nan):
            valid[i], out_speed[i], out_dist[i], out_ms[i], out_climb[i] = accepted, v, d, seconds * 1000, up

        irregular = np.flatnonzero(warm | (same & ~ok))
        i = 0
        while i < n:
            at = np.searchsorted(irregular, i)
            k = int(irregular[at]) if at < len(irregular) else n
            if i == 0:
                k = 0  # what comes before is in an earlier batch
            elif k > i:
                anchor, pending = (keys[k - 1], lat[k - 1], lon[k - 1], ms[k - 1], ele[k - 1]), None
            i = k
            while i < n:
                here = (keys[i], lat[i], lon[i], ms[i], ele[i])
                accepted = False
                if warm[i]:
                    put(i, False)
                elif anchor is None or anchor[0] != keys[i]:
                    put(i, True)
                    accepted = True
                else:
                    held = step(anchor, i)
                    start = anchor
                    if held[2] > C.MAX_PLAUSIBLE_MPS and pending is not None:
                        again = step(pending, i)
                        if not again[2] > C.MAX_PLAUSIBLE_MPS:
                            held, start = again, pending
                    if held[2] > C.MAX_PLAUSIBLE_MPS:
                        put(i, False, held[2])
                        pending = here
                    else:
                        put(i, True, held[2], held[0], held[1], ele[i] - start[4])
                        accepted = True
                i += 1
                if accepted:
                    anchor, pending = here, None
                    break
        gain = np.where(out_climb >= C.ELEVATION_FLOOR_M, out_climb, 0.0)
        loss = np.where(out_climb <= -C.ELEVATION_FLOOR_M, -out_climb, 0.0)
        maybe = lambda x: pa.array(x, pa.float64(), from_pandas=True)
        whole = pa.array(np.where(np.isnan(out_ms), 0, np.round(out_ms)).astype(np.int64), pa.int64(), mask=np.isnan(out_ms))
        new = [pa.array(valid), maybe(out_speed), pa.array(out_dist, pa.float64()), whole, pa.array(gain, pa.float64()), pa.array(loss, pa.float64())]
        kept = [c for c in batch.schema.names if c != "_ms"]
        self.anchor, self.pending = anchor, pending
        return pa.RecordBatch.from_arrays([*(column(c) for c in kept), *new], names=[*kept, *(x[0] for x in _PASS)])


def _accept_fixes(batches):
    held = Acceptance()
    for batch in batches:
        found = held.run(batch)
        if found is not None:
            yield found


def accept_fixes(points: DataFrame) -> DataFrame:
    """Adds ``valid, derived_speed_mps, gps_delta_m, gps_delta_ms, gain_m, loss_m``.

    Each fix is measured from the last accepted one of its segment.  A step too fast to be true is rejected, so
    that a lone spike never moves the track; if the next fix is plausible from the rejected one, the receiver has
    moved for good and the track goes on from there, the jump itself uncredited.  Rows are dealt out by track and
    sorted by Spark, which spills; the pass holds one batch and two fixes.
    """
    sent = points.withColumn("_ms", F.unix_millis("recorded_at"))
    kept = [f for f in sent.schema.fields if f.name != "_ms"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{name} {kind}" for name, _, kind in _PASS)])
    return sent.sortWithinPartitions("track_id", "position").mapInArrow(_accept_fixes, schema)


def with_credit(points: DataFrame) -> DataFrame:
    """Adds ``delta_m, delta_ms`` (credited to the span that ends at the point), ``cumulative_m`` and ``moving_ms``.

    By GPS, accepted fixes have their own; by sensor, the odometer's difference counts, after a reset or dropout
    the wheel speed, then the GPS step if it spans the same time.
    """
    w = by_track()
    dt = F.when(same_segment(), F.unix_millis("recorded_at") - F.lag(F.unix_millis("recorded_at")).over(w))
    odometer = F.col("sensor_distance_m") - F.lag("sensor_distance_m").over(w)
    seconds = F.col("_dt") / 1000.0
    sensor = (
        F.when((F.col("_odometer") >= 0) & plausible_reading(F.col("_odometer") / seconds), F.col("_odometer"))
        .when(plausible_reading(F.col("sensor_speed_mps")) & (F.col("_dt") <= C.MAX_SENSOR_GAP_MS), F.col("sensor_speed_mps") * seconds)
        .when(F.col("valid") & F.col("_was_valid") & (F.col("gps_delta_ms") == F.col("_dt")), F.col("gps_delta_m"))
        .otherwise(0.0)
    )
    by_gps = F.col("distance_source") == "gps"
    return (
        points.withColumns({"_dt": dt, "_odometer": odometer, "_was_valid": F.lag("valid").over(w)})
        .withColumns(
            {
                "delta_m": F.when(by_gps, F.when(F.col("valid"), F.col("gps_delta_m")).otherwise(0.0)).when(F.col("_dt") > 0, sensor).otherwise(0.0),
                "delta_ms": F.when(by_gps, F.when(F.col("valid"), F.col("gps_delta_ms"))).when(F.col("_dt") > 0, F.col("_dt")),
            }
        )
        .withColumns(
            {
                "cumulative_m": F.sum("delta_m").over(w.rowsBetween(Window.unboundedPreceding, 0)),
                "moving_ms": F.when((F.col("delta_ms") > 0) & (F.col("delta_m") / (F.col("delta_ms") / 1000.0) >= C.MOVING_MPS), F.col("delta_ms")).otherwise(0),
            }
        )
        .drop("_dt", "_odometer", "_was_valid")
    )


def with_grade(points: DataFrame) -> DataFrame:
    """Adds ``grade_percent`` against the nearest earlier point of the segment at least 100 m back, within 40 per cent either way.

    Null if there is none or either elevation is missing; it doesn't look further back.
    """
    back = Window.partitionBy(*SEGMENT).orderBy("cumulative_m").rangeBetween(Window.unboundedPreceding, -int(C.GRADE_WINDOW_M))
    reference = F.max(F.struct("position", "cumulative_m", "elevation_m")).over(back)
    grade = (F.col("elevation_m") - F.col("_back.elevation_m")) / (F.col("cumulative_m") - F.col("_back.cumulative_m")) * 100
    return points.withColumn("_back", reference).withColumn("grade_percent", F.when(grade.isNotNull(), F.greatest(F.least(grade, F.lit(C.GRADE_LIMIT)), F.lit(-C.GRADE_LIMIT)))).drop("_back")


def derive_points(points: DataFrame) -> DataFrame:
    """All of the above.  An empty table stays empty; a track without times is credited its GPS distance and no time."""
    dealt = points.repartition("track_id")
    accepted = accept_fixes(with_warmup(with_sources(dealt)))
    return with_grade(with_credit(accepted.repartition("track_id"))).withColumns({"gps_speed_mps": gps_speed(), "speed_mps": effective_speed()})


def timing_points(derived: DataFrame) -> DataFrame:
    """The points whose times count: accepted fixes if distance is by GPS, else all."""
    return derived.where(F.col("valid") | (F.col("distance_source") != "gps"))
