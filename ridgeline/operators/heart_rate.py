"""Heart rate over derived points: flags, spans, histogram, zones, duration curve, sectors, drift, selection.

Times are whole milliseconds since the track's first one, so runs meet exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.scalars import normal_heart_rate, plausible_reading
from .points import SEGMENT, by_track, same_segment


def _running():
    return by_track().rowsBetween(Window.unboundedPreceding, 0)


def with_heart_rate(points: DataFrame) -> DataFrame:
    """Normalises ``heart_rate_bpm`` and adds ``hr_jump`` and ``hr_break`` against the point before."""
    w = by_track()
    dt = F.unix_millis("recorded_at") - F.lag(F.unix_millis("recorded_at")).over(w)
    before = F.lag("heart_rate_bpm").over(w)
    rows = points.withColumn("heart_rate_bpm", normal_heart_rate(F.col("heart_rate_bpm")))
    jump = same_segment() & (dt > 0) & (dt <= C.HR_JUMP_MS) & (F.abs(F.col("heart_rate_bpm") - before) > C.HR_JUMP_BPM)
    joined = same_segment() & (dt > 0) & (dt <= C.GAP_MS) & before.isNotNull() & F.col("heart_rate_bpm").isNotNull()
    return rows.withColumns({"hr_jump": F.coalesce(jump, F.lit(False)), "hr_break": ~F.coalesce(joined, F.lit(False))})


def _chains(rows: DataFrame, match: str, forward: bool, name: str) -> DataFrame:
    """Numbers the runs of matching rows: two follow on if at most 4 s apart and everything between is pedalled and at most 3 s from the nearer-by match."""
    order = Window.partitionBy("track_id").orderBy("position" if forward else F.desc("position"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    good = F.last(F.when(F.col(match), F.struct("_ms", *SEGMENT[1:])), ignorenulls=True).over(earlier)
    rows = rows.withColumn("_good", good)
    gap = (F.col("_ms") - F.col("_good._ms")) * (1 if forward else -1)
    near = lambda most: F.coalesce((gap > 0) & (gap <= most) & (F.col("_good.track_position") == F.col("track_position")) & (F.col("_good.segment_position") == F.col("segment_position")), F.lit(False))
    broken = ~F.col(match) & ~(F.col("_pedalling") & near(C.LOCK_BREAK_MS))
    rows = rows.withColumns({"_near": near(C.LOCK_BREAK_MS + 1_000), "_breaks": F.sum(F.when(broken, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    was = F.last(F.when(F.col(match), F.col("_breaks")), ignorenulls=True).over(earlier)
    opens = F.col(match) & ~F.coalesce(F.col("_near") & (was == F.col("_breaks")), F.lit(False))
    rows = rows.withColumn("_opens", F.when(opens, 1).otherwise(0))
    return rows.withColumn(name, F.when(F.col(match), F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_good", "_near", "_breaks", "_opens")


def with_cadence_lock(points: DataFrame) -> DataFrame:
    """Adds ``hr_cadence_lock``: readings that follow the cadence, not the heart.

    A core is a run within 3 bpm of the cadence for a minute or more; it spreads either way while within 8 bpm.
    """
    apart = F.abs(F.col("heart_rate_bpm") - F.col("cadence_rpm"))
    pedalling = F.coalesce((F.col("cadence_rpm") > 0) & F.col("heart_rate_bpm").isNotNull(), F.lit(False))
    rows = points.select(*SEGMENT, "position", F.unix_millis("recorded_at").alias("_ms"), pedalling.alias("_pedalling"), F.coalesce(pedalling & (apart <= C.LOCK_BPM), F.lit(False)).alias("_tight"), F.coalesce(pedalling & (apart <= C.LOCK_EDGE_BPM), F.lit(False)).alias("_loose"))
    rows = _chains(rows, "_tight", True, "_core")
    rows = _chains(_chains(rows, "_loose", True, "_on"), "_loose", False, "_back")
    rows = rows.withColumns({"_end": F.max("position").over(Window.partitionBy("track_id", "_on")), "_start": F.min("position").over(Window.partitionBy("track_id", "_back"))})
    cores = rows.where("_tight").groupBy("track_id", "_core").agg((F.max_by("_ms", "position") - F.min_by("_ms", "position")).alias("_took"), F.min_by("_start", "position").alias("a"), F.max_by("_end", "position").alias("b"))
    ranges = cores.where(F.col("_took") >= C.LOCK_MS).groupBy("track_id").agg(F.collect_list(F.struct("a", "b")).alias("_locked"))
    inside = F.exists("_locked", lambda r: (r["a"] <= F.col("position")) & (F.col("position") <= r["b"]))
    return points.join(ranges, "track_id", "left").withColumn("hr_cadence_lock", F.coalesce(inside, F.lit(False))).drop("_locked")


def prepare_heart_rate(points: DataFrame) -> DataFrame:
    return with_cadence_lock(with_heart_rate(points))


def lock_summary(prepared: DataFrame) -> DataFrame:
    """The locked runs: ``track_id, start_s, end_s, start_distance_m, end_distance_m, average_bpm, average_rpm, samples``."""
    w = by_track()
    origin = F.min(F.unix_millis("recorded_at")).over(Window.partitionBy("track_id"))
    rows = prepared.withColumns({"_s": (F.unix_millis("recorded_at") - origin) / 1000.0, "_new": F.when(F.col("hr_cadence_lock") & ~F.coalesce(F.lag("hr_cadence_lock").over(w), F.lit(False)), 1).otherwise(0)})
    rows = rows.withColumn("_run", F.sum("_new").over(_running())).where("hr_cadence_lock")
    return rows.groupBy("track_id", "_run").agg(
        F.min_by("_s", "position").alias("start_s"),
        F.max_by("_s", "position").alias("end_s"),
        F.min_by("cumulative_m", "position").alias("start_distance_m"),
        F.max_by("cumulative_m", "position").alias("end_distance_m"),
        F.avg("heart_rate_bpm").alias("average_bpm"),
        F.avg("cadence_rpm").alias("average_rpm"),
        F.count(F.lit(1)).alias("samples"),
    ).drop("_run")


def spans(prepared: DataFrame) -> DataFrame:
    """The intervals between consecutive points of a segment, up to 30 s long; ``position`` is that of the later point.

    ``hr_ok``: both readings can be used.  ``eligible``: it also moves, 5 minutes or more after the start and a
    minute or more after setting off, with no jump at either end.
    """
    w, whole = by_track(), Window.partitionBy("track_id")
    ms = F.unix_millis("recorded_at")
    usable = F.col("heart_rate_bpm").isNotNull() & ~F.col("hr_cadence_lock")
    speed = F.when(plausible_reading(F.col("sensor_speed_mps")), F.col("sensor_speed_mps")).when(F.col("valid"), F.col("derived_speed_mps"))
    rows = prepared.select(
        *SEGMENT,
        "position",
        (F.lag(ms).over(w) - F.min(ms).over(whole)).alias("start_ms"),
        (ms - F.min(ms).over(whole)).alias("end_ms"),
        F.lag("heart_rate_bpm").over(w).alias("h0"),
        F.col("heart_rate_bpm").alias("h1"),
        F.lag("cumulative_m").over(w).alias("d0"),
        F.col("cumulative_m").alias("d1"),
        speed.alias("speed"),
        F.col("grade_percent").alias("grade"),
        same_segment().alias("_same"),
        (usable & F.lag(usable).over(w)).alias("_both"),
        (F.col("hr_jump") | F.lag("hr_jump").over(w)).alias("_jump"),
    )
    dt = F.col("end_ms") - F.col("start_ms")
    rows = rows.withColumn("dt_ms", dt).withColumn("_ok", F.coalesce(F.col("_same") & (dt > 0) & (dt <= C.GAP_MS), F.lit(False)))
    rows = rows.withColumn("moving", F.col("_ok") & F.coalesce(F.col("speed") >= C.MOVING_MPS, F.lit(False)))
    sets_off = F.when(F.col("moving") & ~F.coalesce(F.lag("moving").over(w), F.lit(False)), F.col("start_ms"))
    rows = rows.withColumn("_since", F.last(sets_off, ignorenulls=True).over(_running())).where("_ok")
    hr_ok = F.coalesce(F.col("_both"), F.lit(False))
    eligible = hr_ok & F.col("moving") & (F.col("start_ms") >= C.HR_WARMUP_MS) & (F.col("start_ms") - F.col("_since") >= C.HR_SETTLE_MS) & ~F.col("_jump")
    return rows.withColumns({"hr_ok": hr_ok, "area": F.when(hr_ok, (F.col("h0") + F.col("h1")) / 2 * F.col("dt_ms") / 1000.0), "eligible": F.coalesce(eligible, F.lit(False))}).drop("_same", "_both", "_jump", "_ok", "_since")


def mean_bpm(which: Column) -> Column:
    """Aggregate: the time-weighted mean over the spans that are ``which``."""
    seconds = F.sum(F.when(which, F.col("dt_ms") / 1000.0))
    return F.when(seconds > 0, F.sum(F.when(which, F.col("area"))) / seconds)


def mean_kmh(which: Column) -> Column:
    seconds = F.sum(F.when(which, F.col("dt_ms")))
    return F.when(seconds > 0, F.sum(F.when(which, F.col("speed") * F.col("dt_ms"))) / seconds * 3.6)


def histogram(timeline: DataFrame, *keys: str) -> DataFrame:
    """``*keys, bpm, seconds``: each span's time spread over the whole beats between its readings in proportion."""
    keys = keys or ("track_id",)
    low, high = F.least("h0", "h1"), F.greatest("h0", "h1")
    rows = timeline.where("hr_ok").select(*keys, low.alias("low"), high.alias("high"), (F.col("dt_ms") / 1000.0).alias("s"), F.explode(F.sequence(F.floor(low), F.floor(high))).alias("bpm"))
    share = F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise(F.greatest(F.least(F.col("high"), F.col("bpm") + 1) - F.greatest(F.col("low"), F.col("bpm").cast("double")), F.lit(0.0)) / (F.col("high") - F.col("low")))
    return rows.groupBy(*keys, F.col("bpm").cast("int").alias("bpm")).agg(F.sum(F.col("s") * share).alias("seconds")).where("seconds > 0")


def zones(bins: DataFrame, edges: list[int]) -> DataFrame:
    """``track_id, zone, lower, upper, seconds`` for all five zones of every track that has bins; beats below the first edge are in none."""
    bounds = [*edges, 241]
    sums = [F.coalesce(F.sum(F.when((F.col("bpm") >= a) & (F.col("bpm") < b), F.col("seconds"))), F.lit(0.0)) for a, b in zip(bounds, bounds[1:], strict=False)]
    rows = [F.struct(F.lit(i + 1).alias("zone"), F.lit(bounds[i]).alias("lower"), F.lit(bounds[i + 1] if i < 4 else None).cast("int").alias("upper"), s.alias("seconds")) for i, s in enumerate(sums)]
    return bins.groupBy("track_id").agg(F.array(*rows).alias("zones")).select("track_id", F.inline("zones"))


def training_load(bins: DataFrame, edges: list[int]) -> DataFrame:
    """Minutes in each zone times its number, summed."""
    return zones(bins, edges).groupBy("track_id").agg(F.sum(F.col("seconds") / 60 * F.col("zone")).alias("load"))


def distribution(bins: DataFrame) -> DataFrame:
    """Seconds in bands of ten beats."""
    band = (F.floor(F.col("bpm") / 10) * 10).cast("int")
    return bins.groupBy("track_id", band.alias("bpm")).agg(F.sum("seconds").alias("seconds")).withColumn("label", F.concat(F.col("bpm").cast("string"), F.lit("–"), (F.col("bpm") + 9).cast("string")))


def cumulative_curve(bins: DataFrame) -> DataFrame:
    """Seconds at or above each bpm."""
    w = Window.partitionBy("track_id").orderBy(F.desc("bpm")).rowsBetween(Window.unboundedPreceding, 0)
    return bins.select("track_id", "bpm", F.sum("seconds").over(w).alias("seconds_at_or_above"))


def _with_runs(rows: DataFrame) -> DataFrame:
    """Numbers the runs of rows that each start when the one before ends, in one segment."""
    w = by_track()
    joins = (F.lag("end_ms").over(w) == F.col("start_ms")) & (F.lag("track_position").over(w) == F.col("track_position")) & (F.lag("segment_position").over(w) == F.col("segment_position"))
    return rows.withColumn("_opens", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("_opens").over(_running())).drop("_opens")


def _best_window(start: np.ndarray, end: np.ndarray, h0: np.ndarray, h1: np.ndarray, duration: float) -> tuple[float, float] | None:
    """(mean, start) of the best window of a run: a rolling integral peaks at a sample's edge or where its slope, linear in between, is zero."""
    first, last = start[0], end[-1]
    if last - first < duration:
        return None
    length = end - start
    before = np.concatenate([[0.0], np.cumsum((h0 + h1) / 2 * length)])

    def at(t):
        k = np.minimum(np.searchsorted(end, t, "left"), len(end) - 1)
        own = np.clip(t - start[k], 0, length[k])
        slope = (h1[k] - h0[k]) / length[k]
        return before[k] + h0[k] * own + slope * own * own / 2, h0[k] + slope * own

    edges = np.unique(np.concatenate([[first, last - duration], end, end - duration]))
    edges = edges[(edges >= first) & (edges + duration <= last)]
    rise = at(edges + duration)[1] - at(edges)[1]
    a, b, da, db = edges[:-1], edges[1:], rise[:-1], rise[1:]
    turn = da * db < 0
    starts = np.concatenate([edges, a[turn] + (b[turn] - a[turn]) * da[turn] / (da[turn] - db[turn])])
    mean = (at(starts + duration)[0] - at(starts)[0]) / duration
    k = int(np.argmax(mean))
    return float(mean[k]), float(starts[k])


def duration_curve(timeline: DataFrame) -> DataFrame:
    """``track_id, duration_s, average_bpm, start_s, end_s``: the highest mean over each duration within one run, null if none is long enough.

    Runs shorter than the shortest duration are left out before they are dealt out, sorted; a recording bounds a run.
    """

    kind = dict(timeline.dtypes)["track_id"]
    columns = ["start_ms", "end_ms", "h0", "h1"]

    def of_runs(frames):
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            number = (held.track_id.ne(held.track_id.shift()) | held.run.ne(held.run.shift())).cumsum()
            last = number.to_numpy() == (number.iloc[-1] if len(number) else 0)  # may go on in the next frame
            yield best_of(held[~last], number[~last])
            held = held[last]
        if held is not None:
            yield best_of(held, pd.Series(0, index=held.index))

    def best_of(rows, number):
        found = []
        for _, own in rows.groupby(number, sort=False):
            start, end, h0, h1 = (own[c].to_numpy(float) for c in columns)
            for d in C.HR_DURATIONS_S:
                best = _best_window(start / 1000, end / 1000, h0, h1, float(d))
                if best:
                    found.append((own.track_id.iloc[0], d, *best))
        return pd.DataFrame(found, columns=["track_id", "duration_s", "average_bpm", "start_s"])

    usable = timeline.where("hr_ok")
    tracks = usable.select("track_id").distinct()
    whole = Window.partitionBy("track_id", "run")
    runs = _with_runs(usable).withColumn("_took", F.max("end_ms").over(whole) - F.min("start_ms").over(whole))
    long = runs.where(F.col("_took") >= min(C.HR_DURATIONS_S) * 1000).select("track_id", "run", *columns)
    best = long.repartition("track_id", "run").sortWithinPartitions("track_id", "run", "start_ms").mapInPandas(of_runs, f"track_id {kind}, duration_s int, average_bpm double, start_s double")
    top = best.groupBy("track_id", "duration_s").agg(F.min(F.struct((-F.col("average_bpm")).alias("below"), "start_s")).alias("top"))
    wanted = tracks.select("track_id", F.explode(F.array(*map(F.lit, C.HR_DURATIONS_S))).alias("duration_s"))
    return wanted.join(top, ["track_id", "duration_s"], "left").select("track_id", "duration_s", (-F.col("top.below")).alias("average_bpm"), F.col("top.start_s").alias("start_s"), (F.col("top.start_s") + F.col("duration_s")).alias("end_s"))


def sectors(timeline: DataFrame, totals: DataFrame) -> DataFrame:
    """64 sectors of equal distance: ``track_id, index, moving_s, eligible_s, average_bpm, speed_kmh, start_s, end_s``.

    ``totals`` has ``track_id, distance_m``; tracks without distance have no sectors.  A span lies in the sector of
    its middle, to 1e-9 of a sector, so that middles on a boundary don't depend on the last bit of a running sum.
    """
    rows = timeline.where(F.col("moving") & (F.col("start_ms") >= C.HR_WARMUP_MS)).join(totals.where("distance_m > 0").select("track_id", "distance_m"), "track_id")
    index = F.least(F.floor(F.round((F.col("d0") + F.col("d1")) / 2 / F.col("distance_m") * C.SECTORS, 9)), F.lit(C.SECTORS - 1)).cast("int")
    fits = F.col("eligible")
    return rows.groupBy("track_id", index.alias("index")).agg(
        (F.sum("dt_ms") / 1000.0).alias("moving_s"),
        (F.coalesce(F.sum(F.when(fits, F.col("dt_ms"))), F.lit(0)) / 1000.0).alias("eligible_s"),
        mean_bpm(fits).alias("average_bpm"),
        mean_kmh(fits).alias("speed_kmh"),
        (F.min("start_ms") / 1000.0).alias("start_s"),
        (F.max("end_ms") / 1000.0).alias("end_s"),
    )


def clip(timeline: DataFrame, start_ms: Column, end_ms: Column) -> DataFrame:
    """The parts of spans within the times, readings and distances interpolated."""
    a, b = F.greatest("start_ms", start_ms), F.least("end_ms", end_ms)
    f0, f1 = ((x - F.col("start_ms")) / F.col("dt_ms") for x in (a, b))
    mix = lambda p, q, f: F.col(p) + (F.col(q) - F.col(p)) * f
    rows = timeline.where((F.col("end_ms") > start_ms) & (F.col("start_ms") < end_ms))
    rows = rows.withColumns({"_a": a, "_b": b, "_h0": mix("h0", "h1", f0), "_h1": mix("h0", "h1", f1), "_d0": mix("d0", "d1", f0), "_d1": mix("d0", "d1", f1)})
    new = {"start_ms": F.col("_a"), "end_ms": F.col("_b"), "dt_ms": F.col("_b") - F.col("_a"), "h0": F.col("_h0"), "h1": F.col("_h1"), "d0": F.col("_d0"), "d1": F.col("_d1"), "area": F.when(F.col("hr_ok"), (F.col("_h0") + F.col("_h1")) / 2 * (F.col("_b") - F.col("_a")) / 1000.0)}
    return rows.withColumns(new).drop("_a", "_b", "_h0", "_h1", "_d0", "_d1")


def drift(timeline: DataFrame) -> DataFrame:
    """``track_id, percent, start_s, end_s, first_bpm, second_bpm`` of the longest steady run: half an hour or more, eligible throughout, even in speed and flat.

    The change is that of speed per beat from the first half to the second; tracks without such a run have no row.
    """
    runs = _with_runs(timeline.where("eligible"))
    w = Window.partitionBy("track_id", "run")
    took, average = F.sum("dt_ms").over(w), F.sum(F.col("speed") * F.col("dt_ms")).over(w) / F.sum("dt_ms").over(w)
    rows = runs.withColumns({"_took": took, "_avg": average})
    judged = rows.groupBy("track_id", "run").agg(
        F.first("_took").alias("took"),
        (F.sqrt(F.sum(F.pow(F.col("speed") - F.col("_avg"), 2) * F.col("dt_ms")) / F.first("_took")) / F.first("_avg")).alias("cv"),
        (F.coalesce(F.sum(F.when(F.abs("grade") <= C.DRIFT_GRADE, F.col("dt_ms"))), F.lit(0)) / F.first("_took")).alias("flat"),
        F.min("start_ms").alias("from_ms"),
        F.max("end_ms").alias("to_ms"),
    )
    steady = judged.where((F.col("took") >= C.DRIFT_MS) & (F.col("cv") <= C.DRIFT_CV) & (F.col("flat") >= C.DRIFT_FLAT_SHARE))
    best = steady.groupBy("track_id").agg(F.min(F.struct((-F.col("took")).alias("below"), "from_ms", "run", "to_ms")).alias("b")).select("track_id", "b.run", "b.from_ms", "b.to_ms")
    held = runs.join(best, ["track_id", "run"]).withColumn("_middle", (F.col("from_ms") + F.col("to_ms")) / 2)
    halves = clip(held, F.col("from_ms"), F.col("_middle")).withColumn("half", F.lit(1)).unionByName(clip(held, F.col("_middle"), F.col("to_ms")).withColumn("half", F.lit(2)))
    one, two = F.col("half") == 1, F.col("half") == 2
    sums = halves.groupBy("track_id").agg(F.first("from_ms").alias("from_ms"), F.first("to_ms").alias("to_ms"), mean_bpm(one).alias("first_bpm"), mean_bpm(two).alias("second_bpm"), mean_kmh(one).alias("_v1"), mean_kmh(two).alias("_v2"))
    r1, r2 = F.col("_v1") / F.col("first_bpm"), F.col("_v2") / F.col("second_bpm")
    return sums.select("track_id", ((r1 - r2) / r1 * 100).alias("percent"), (F.col("from_ms") / 1000.0).alias("start_s"), (F.col("to_ms") / 1000.0).alias("end_s"), "first_bpm", "second_bpm")


def selection(timeline: DataFrame, from_s: float, until_s: float) -> DataFrame:
    """Measures of each track between two times: covered time, mean, maximum, change, distance, moving speed.  Raises ValueError unless 0 <= from < until."""
    if not 0 <= from_s < until_s:
        raise ValueError("a selection needs 0 <= from < until")
    rows = clip(timeline, F.lit(float(from_s * 1000)), F.lit(float(until_s * 1000)))
    ok = F.col("hr_ok")
    return rows.groupBy("track_id").agg(
        F.lit(float(until_s - from_s)).alias("duration_s"),
        (F.coalesce(F.sum(F.when(ok, F.col("dt_ms"))), F.lit(0.0)) / 1000.0).alias("covered_s"),
        mean_bpm(ok).alias("average_bpm"),
        F.max(F.when(ok, F.greatest("h0", "h1"))).alias("maximum_bpm"),
        (F.max_by(F.when(ok, F.col("h1")), F.when(ok, F.col("start_ms"))) - F.min_by(F.when(ok, F.col("h0")), F.when(ok, F.col("start_ms")))).alias("change_bpm"),
        F.sum(F.greatest(F.col("d1") - F.col("d0"), F.lit(0.0))).alias("distance_m"),
        mean_kmh(F.col("moving")).alias("speed_kmh"),
    )


def heart_rate_summary(prepared: DataFrame, timeline: DataFrame) -> DataFrame:
    """One row per track: samples, coverage, means, extremes and what is wrong with the data."""
    usable = F.col("heart_rate_bpm").isNotNull() & ~F.col("hr_cadence_lock")
    ms = F.unix_millis("recorded_at")
    hr = F.when(usable, F.col("heart_rate_bpm"))
    own = prepared.groupBy("track_id").agg(
        F.count(hr).alias("sample_count"),
        F.min(hr).alias("minimum_bpm"),
        F.max(hr).alias("maximum_bpm"),
        F.min(F.when(usable, F.struct((-F.col("heart_rate_bpm")).alias("below"), "position", ms.alias("ms")))).alias("_peak"),
        F.min(ms).alias("_from"),
        F.max(ms).alias("_to"),
        F.count_if("hr_jump").alias("suspect_transitions"),
        F.count_if("hr_cadence_lock").alias("cadence_lock_samples"),
        F.count_if(F.col("heart_rate_bpm").isNull()).alias("missing_samples"),
    )
    ok = F.col("hr_ok")
    seconds = lambda which: F.coalesce(F.sum(F.when(which, F.col("dt_ms"))), F.lit(0)) / 1000.0
    covered = timeline.groupBy("track_id").agg(seconds(ok).alias("covered_s"), seconds(ok & F.col("moving")).alias("moving_covered_s"), mean_bpm(ok).alias("average_bpm"), mean_bpm(ok & F.col("moving")).alias("moving_average_bpm"))
    elapsed = F.coalesce((F.col("_to") - F.col("_from")) / 1000.0, F.lit(0.0))
    rows = own.join(covered, "track_id", "left").fillna({"covered_s": 0.0, "moving_covered_s": 0.0})
    return rows.withColumns(
        {
            "peak_position": F.col("_peak.position"),
            "peak_s": (F.col("_peak.ms") - F.col("_from")) / 1000.0,
            "coverage_percent": F.when(elapsed > 0, F.col("covered_s") * 100 / elapsed).otherwise(0.0),
            "uncovered_s": F.greatest(elapsed - F.col("covered_s"), F.lit(0.0)),
        }
    ).drop("_peak", "_from", "_to")


def jumps(prepared: DataFrame) -> DataFrame:
    """The flagged transitions: ``track_id, position, start_s, end_s, bpm``."""
    origin = F.min(F.unix_millis("recorded_at")).over(Window.partitionBy("track_id"))
    end = (F.unix_millis("recorded_at") - origin) / 1000.0
    rows = prepared.select("track_id", "position", end.alias("end_s"), F.col("heart_rate_bpm").alias("bpm"), "hr_jump", "delta_ms")
    return rows.where("hr_jump").select("track_id", "position", F.greatest(F.col("end_s") - F.coalesce(F.col("delta_ms"), F.lit(0)) / 1000.0, F.lit(0.0)).alias("start_s"), "end_s", "bpm")


def weekly_overview(tracks: DataFrame, bins: DataFrame, edges: list[int], as_of: str, weeks: int = 104) -> DataFrame:
    """The last weeks to ``as_of`` (a date), weeks without recordings having nulls: ``week, tracks, covered_s, load``.  ``tracks``: ``track_id, started_at``."""
    held = tracks.join(training_load(bins, edges), "track_id").join(bins.groupBy("track_id").agg(F.sum("seconds").alias("covered_s")), "track_id")
    sums = held.groupBy(F.date_trunc("week", "started_at").cast("date").alias("week")).agg(F.count(F.lit(1)).alias("tracks"), F.sum("covered_s").alias("covered_s"), F.sum("load").alias("load"))
    first = held.agg(F.min(F.date_trunc("week", "started_at")).cast("date").alias("first"))
    last = F.date_trunc("week", F.to_date(F.lit(as_of))).cast("date")
    start = F.greatest("first", F.date_sub(last, 7 * (weeks - 1)))
    calendar = first.where("first IS NOT NULL").select(F.explode(F.sequence(start, last, F.expr("INTERVAL 7 DAYS"))).alias("week"))
    return calendar.join(sums, "week", "left")


def rolling_load(daily: DataFrame) -> DataFrame:
    """``day, load`` with the sums of the last 7 and 28 days; days without recordings are absent."""
    day = F.unix_date("day")
    w = Window.partitionBy(F.lit(1)).orderBy(day)
    return daily.withColumns({"load_7": F.sum("load").over(w.rangeBetween(-6, 0)), "load_28": F.sum("load").over(w.rangeBetween(-27, 0))})


def pending_recalibration(summaries: DataFrame, revision: int) -> DataFrame:
    """How many summaries have zones of another profile revision: ``count, pending_count``."""
    return summaries.agg(F.count(F.lit(1)).alias("count"), F.count_if(~F.col("zone_revision").eqNullSafe(F.lit(revision))).alias("pending_count"))
