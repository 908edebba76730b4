"""Point derivation, splits, events, heart rate and sensors on closed-form rides."""

import math
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ridgeline.config import heart_rate_edges
from ridgeline.functions import geo
from ridgeline.operators import heart_rate as H
from ridgeline.operators import points as P
from ridgeline.operators import segments, sensors, summary

START = datetime(2025, 6, 1, 8, tzinfo=UTC)
METRE = 180 / (math.pi * 6_371_008.8)
SCHEMA = "track_id long, track_position int, segment_position int, position int, latitude double, longitude double, elevation_m double, recorded_at timestamp, hdop double, recorded_speed_mps double, heart_rate_bpm double, cadence_rpm double, sensor_speed_mps double, sensor_distance_m double"


def ride(spark, n, track=1, seconds=1.0, metres=None, **columns):
    """n points; each option is a value or a function of the position."""
    rows = []
    for i in range(n):
        v = {k: (f(i) if callable(f) else f) for k, f in columns.items()}
        north = (metres or (lambda k: 6.0 * k))(i)
        at = START + timedelta(milliseconds=round(1000 * (seconds(i) if callable(seconds) else seconds * i))) if v.get("timed", True) else None
        rows.append((track, 0, v.get("segment", 0), i, 55 + north * METRE, 12.0, v.get("elevation"), at, v.get("hdop"), v.get("recorded"), v.get("hr"), v.get("cadence"), v.get("sensor"), v.get("odometer")))
    return spark.createDataFrame(rows, SCHEMA)


def total(derived):
    return derived.agg(F.sum("delta_m"), F.count_if(~F.col("valid")), F.count_if("gps_warmup")).first()


@pytest.mark.parametrize(
    ("name", "shift", "distance", "invalid", "warm"),
    [
        ("plain", lambda i: 0, 399 * 6, 0, 0),
        ("lone spike", lambda i: 220 * (i == 200), 399 * 6, 1, 0),
        ("moved for good", lambda i: 220 * (i >= 200), 398 * 6, 1, 0),
        ("stale start", lambda i: -550 * (i < 10), 389 * 6, 10, 10),
    ],
)
def test_fixes(spark, name, shift, distance, invalid, warm):
    found = total(P.derive_points(ride(spark, 400, metres=lambda i: 6.0 * i + shift(i))))
    assert found[0] == pytest.approx(distance, abs=0.01)
    assert (found[1], found[2]) == (invalid, warm)


def test_the_odometer_is_credited_and_a_reset_falls_back_to_speed(spark):
    derived = P.derive_points(ride(spark, 100, odometer=lambda i: 6.12 * (i if i < 50 else i - 50), sensor=6.12))
    assert total(derived)[0] == pytest.approx(99 * 6.12)
    assert {r.distance_source for r in derived.select("distance_source").distinct().collect()} == {"odometer"}


def test_points_without_time_and_empty_tables(spark):
    derived = P.derive_points(ride(spark, 20, timed=lambda i: i != 7))
    assert total(derived)[1] == 0
    empty = P.derive_points(ride(spark, 1).limit(0))
    assert empty.count() == 0 and summary.track_summary(empty).count() == 0 and segments.splits(empty).count() == 0


def test_splits_efforts_and_summary(spark):
    derived = P.derive_points(ride(spark, 401, seconds=lambda i: i + (10 if i > 300 else 0), metres=lambda i: 10.0 * i, elevation=lambda i: float(i % 2)))
    kms = {r.position: r for r in segments.kilometre_splits(derived).collect()}
    assert sorted(kms) == [1, 2, 3] or sorted(kms) == [1, 2, 3, 4]
    assert kms[1].duration_s == 100 and kms[1].elevation_gain_m == pytest.approx(50, abs=1)
    effort = {r.position: r for r in segments.best_efforts(derived).collect()}
    assert effort[1000].avg_speed_mps == pytest.approx(10, abs=0.1) and set(effort) == {1000}
    row = summary.analysed_tracks(derived).first()
    assert row.distance_m == pytest.approx(4000, abs=1) and row.quality_score == 100 and row.status == "complete"
    assert row.elevation_gain_m == 0  # below the noise floor
    assert row.median_sample_seconds == 1 and row.best_1km_speed_mps == pytest.approx(10, abs=0.1)


def test_grade_stops_and_climbs(spark):
    derived = P.derive_points(ride(spark, 300, metres=lambda i: 5.0 * min(i, 100) + 5.0 * max(0, i - 150), elevation=lambda i: 0.05 * 5.0 * max(0, i - 150)))
    stop = segments.stops(derived).collect()
    assert len(stop) == 1 and stop[0].duration_s == pytest.approx(50, abs=1)
    climb = segments.climbs(derived).collect()
    assert len(climb) == 1 and climb[0].max_grade == pytest.approx(5, abs=0.1) and climb[0].position == 0
    kinds = {(r.kind, r.position) for r in segments.track_events(derived).collect()}
    assert kinds == {("stop", 0), ("climb", 0)}


def test_skip_reasons(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (9, 5000.0, 900.0), (25, 77.4, 66.0), (40, 450.0, 45.0), (10, 200.0, 60.0)], "n int, d double, m double")
    from ridgeline.functions.scalars import skip_reason

    assert [r[0] for r in rows.select(skip_reason(F.col("n"), F.col("d"), F.col("m"))).collect()] == ["only 1 point", "only 9 points", "only 77 m long", "only 45 s of movement", None]


def test_downsampling_keeps_breaks(spark):
    derived = P.derive_points(H.with_heart_rate(ride(spark, 1201, hr=lambda i: None if i == 101 else 140.0)))
    kept = {r.position: r.hr_break for r in summary.downsample(derived, 600).collect()}
    assert kept[102] and not kept[99] and 1200 in kept and len(kept) == 401


def test_renderings_keep_flags_and_derive_points_once(spark):
    derived = P.derive_points(H.with_heart_rate(ride(spark, 1201, hr=lambda i: None if i == 101 else 140.0 + 50 * (i == 500))))
    found = summary.renderings(derived)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # not once a level
    for level, most in summary.C.RENDERING_SIZES.items():
        kept = [(r.position, r.hr_jump, r.hr_break) for r in summary.downsample(derived, most).orderBy("position").collect()]
        assert [(p.position, p.hr_jump, p.hr_break) for p in found.where(F.col("level") == level).first().series] == kept
        assert any(jump for _, jump, _ in kept)
    plain = summary.renderings(derived.drop("hr_jump", "hr_break")).where("level = 'overview'").first()
    assert plain.point_count == 401 and {(p.hr_jump, p.hr_break) for p in plain.series} == {(None, None)}


def prepared(rows):
    return H.prepare_heart_rate(P.derive_points(rows))


def test_mean_histogram_and_zones(spark):
    timeline = H.spans(prepared(ride(spark, 11, seconds=6.0, hr=135.0)))
    bins = H.histogram(timeline)
    assert [(r.bpm, r.seconds) for r in bins.collect()] == [(135, 60.0)]
    zones = {r.zone: r.seconds for r in H.zones(bins, [30, 100, 120, 140, 160]).collect()}
    assert zones == {1: 0, 2: 0, 3: 60, 4: 0, 5: 0}
    assert H.training_load(bins, [30, 100, 120, 140, 160]).first().load == 3.0


def test_gaps_are_not_covered(spark):
    timeline = H.spans(prepared(ride(spark, 4, seconds=lambda i: [0, 6, 46, 52][i], hr=lambda i: [110.0, 110.0, 140.0, 140.0][i])))
    assert timeline.agg(F.sum("dt_ms")).first()[0] == 12_000
    rising = H.spans(prepared(ride(spark, 3, seconds=lambda i: [0, 20, 40][i], hr=lambda i: [100.0, 120.0, 140.0][i])))
    spread = H.histogram(rising)
    assert spread.agg(F.sum("seconds")).first()[0] == pytest.approx(40)
    assert spread.where("bpm = 110").first().seconds == pytest.approx(1)


def test_duration_curve_on_a_fractional_clock(spark):
    curve = {r.duration_s: r.average_bpm for r in H.duration_curve(H.spans(prepared(ride(spark, 250, seconds=6.037, metres=lambda i: 30.0 * i, hr=135.0)))).collect()}
    assert curve == {d: pytest.approx(135) for d in (60, 300, 600, 1200)}


def test_a_best_window_lies_between_samples():
    import numpy as np

    start, end = np.array([0.0, 30.0]), np.array([30.0, 60.0])
    mean, at = H._best_window(start, end, np.array([100.0, 160.0]), np.array([160.0, 100.0]), 30.0)
    assert at == pytest.approx(15) and mean == pytest.approx(145)
    assert H._best_window(start, end, np.array([1.0, 1.0]), np.array([1.0, 1.0]), 61.0) is None


def test_cadence_lock(spark):
    hr = lambda i: 90.0 if 300 <= i < 390 else 140.0 + i % 3
    rows = prepared(ride(spark, 690, hr=hr, cadence=lambda i: 90.0 if 300 <= i < 390 else 80.0))
    locked = [r.position for r in rows.where("hr_cadence_lock").collect()]
    assert sorted(locked) == list(range(300, 390))
    assert prepared(ride(spark, 100, hr=lambda i: 90.0 if i < 50 else 150.0, cadence=90.0)).where("hr_cadence_lock").count() == 0
    one = H.lock_summary(rows).first()
    assert one.samples == 90 and one.start_s == 300 and one.average_bpm == 90


def test_drift_needs_half_an_hour(spark):
    long = ride(spark, 401, seconds=6.0, metres=lambda i: 30.0 * i, elevation=10.0, hr=lambda i: 130 + i / 20)
    found = H.drift(H.spans(prepared(long))).first()
    assert found is not None and found.percent > 0
    assert H.drift(H.spans(prepared(ride(spark, 300, seconds=6.0, metres=lambda i: 30.0 * i, elevation=10.0, hr=130.0)))).count() == 0


def test_profile_edges():
    assert heart_rate_edges("maximum", 180) == [30, 108, 126, 144, 162]
    assert heart_rate_edges("none") is None
    for bad in ({"mode": "maximum", "maximum": 99}, {"mode": "custom", "edges": [30, 100, 100, 140, 160]}, {"mode": "x"}):
        with pytest.raises(ValueError):
            heart_rate_edges(**bad)


def test_cadence_and_wheel(spark):
    rows = P.derive_points(ride(spark, 601, sensor=6.12, odometer=lambda i: 6.12 * i, cadence=lambda i: 85.0 if i % 10 < 8 else 0.0))
    spans = sensors.sensor_spans(rows)
    one = sensors.cadence_summary(rows, spans).first()
    assert one.coasting_percent == pytest.approx(20, abs=0.2) and one.average_rpm == 85
    assert sensors.development_mode(sensors.development(spans)).first().development_mode_m == pytest.approx(4.375)
    wheel = sensors.speed_sensor_summary(rows, spans).first()
    assert wheel.distance_difference_percent == pytest.approx(2, abs=0.05) and wheel.distance_source == "device"
    assert sensors.terrain(spans).count() == 4


def test_geo(spark):
    row = spark.range(1).select(
        geo.geohash(F.lit(57.64911), F.lit(10.40744), 7).alias("g"),
        geo.polyline_encode(F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in ((38.5, -120.2), (40.7, -120.95), (43.252, -126.453))])).alias("p"),
        geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"),
    ).first()
    assert row.g == "u4pruyd" and row.p == "_p~iF~ps|U_ulLnnqC_mqNvxq`@" and row.d == pytest.approx(111_195.08, abs=0.1)
    assert geo.decode_polyline(row.p) == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]


def test_a_kilometre_without_time_has_the_speed_of_its_sql(spark):
    from ridgeline.plans import _without_time

    rows = spark.createDataFrame([(1, 0.0, 1000.0, None), (2, 50.0, 1000.0, 20.0), (3, None, 1000.0, None)], "position int, duration_s double, distance_m double, avg_speed_mps double")
    assert {r.position: r.avg_speed_mps for r in _without_time(rows).collect()} == {1: float("inf"), 2: 20.0, 3: None}


def test_rides_are_derived_once(spark, monkeypatch):
    from ridgeline import plans

    seen = []
    monkeypatch.setattr(plans, "written", lambda rows: seen.append(rows.columns) or rows)
    plans._rides(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and "grade_percent" in seen[0] and "hr_jump" not in seen[0]
