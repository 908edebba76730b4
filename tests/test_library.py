"""Routes, progress, portfolio, imports, sources and streams."""

import io
import json
import struct
import zipfile
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import imports, portfolio, progress, routes
from ridgeline.operators import points as P
from ridgeline.operators.summary import analysed_tracks, renderings
from ridgeline.sources import demo, fit, recordings

DAY = datetime(2025, 1, 6, 9, tzinfo=UTC)
FEATURE = "track_id long, samples array<struct<lat:double,lon:double>>, distance_m double, avg_speed_mps double, activity_type string, is_loop boolean, direction string"


def feature(i, path, distance=6_300.0, loop=False, way="open", activity="ride", speed=5.0):
    return i, path, distance, speed, activity, loop, way


def line(shift=0.0):
    return [(55 + shift, 12 + 0.001 * k) for k in range(64)]


def square(turn=0):
    corner = [(55 + 0.01 * min(k, 16) - 0.01 * max(0, min(k - 32, 16)), 12 + 0.01 * max(0, min(k - 16, 16)) - 0.01 * max(0, k - 48)) for k in range(64)]
    return corner[turn:] + corner[:turn]


def test_matching(spark):
    rows = [feature(1, line()), feature(2, line(0.0002)), feature(3, line()[::-1]), feature(4, line(), activity="run"), feature(5, line(), distance=5_000.0), feature(6, square(), loop=True, way="clockwise"), feature(7, square(11), loop=True, way="clockwise"), feature(8, square(), loop=True, way="counterclockwise")]
    found = {(r.left_id, r.right_id): r for r in routes.matches(spark.createDataFrame(rows, FEATURE)).collect()}
    assert set(found) == {(1, 2), (6, 7)}
    assert found[1, 2].similarity > 0.8 and found[6, 7].similarity > 0.99 and found[6, 7].alignment == 53


def test_groups_are_complete_links(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (1, 4, 0.7), (2, 4, 0.9), (5, 6, 0.6), (3, 9, 0.9)], "left_id long, right_id long, similarity double")
    found = {r.track_id: r.group_id for r in routes.groups(pairs).collect()}
    assert found == {1: 1, 2: 1, 4: 1, 3: 3, 9: 3, 5: 5, 6: 5}
    members = spark.createDataFrame(list(found.items()), "track_id long, group_id long")
    medoid = {r.group_id: r.representative_id for r in routes.memberships(members, pairs).collect()}
    assert medoid == {1: 2, 3: 3, 5: 5}
    existing = spark.createDataFrame([(70, 1), (70, 2), (71, 4), (72, 5)], "cluster_id long, track_id long")
    assert {r.group_id: r.cluster_id for r in routes.reconcile(members, existing).collect()} == {1: 70, 3: None, 5: 72}


def tracks(spark, rows):
    schema = "track_id long, name string, source_filename string, status string, started_at timestamp, ended_at timestamp, inserted_at timestamp, distance_m double, moving_s double, elevation_gain_m double, avg_speed_mps double, max_speed_mps double, best_1km_speed_mps double, best_5km_speed_mps double, max_speed_confidence string, quality_score double, cluster_id long"
    names = [x.split(" ")[0] for x in schema.split(", ")]
    plain = {"name": "Ride", "source_filename": "a.gpx", "status": "complete"}
    return spark.createDataFrame([tuple({**plain, **r}.get(n) for n in names) for r in rows], schema)


def test_speed_history(spark):
    rows = tracks(spark, [{"track_id": i, "started_at": DAY + timedelta(weeks=i), "best_1km_speed_mps": 8 + i / 10, "max_speed_mps": 10 + i / 10} for i in range(31)])
    history = portfolio.speed_history(rows).orderBy("started_at").collect()
    assert len(history) == 31 and history[-1].rolling_median_mps == pytest.approx(10.3) and history[-1].record_mps == 11.0
    assert portfolio.leaders(rows, "instantaneous").first().speed_mps == 13.0
    assert portfolio.speed_history(rows, span="90d", as_of="2025-08-06").count() == 13
    from ridgeline.operators import ordered

    small = ordered.numbered(rows, "started_at", "track_id")
    blocks = ordered.in_blocks(small, 3, block=4)
    assert blocks.where("NOT _context").count() == 31 and blocks.where("_context").count() == 23  # all but the first of each four
    assert [r.m for r in ordered.running_max(small, "best_1km_speed_mps", "m", block=4).orderBy("_n").collect()] == [8 + i / 10 for i in range(31)]


def test_recap(spark):
    rows = tracks(spark, [{"track_id": 1, "started_at": DAY, "distance_m": 1000.0, "moving_s": 100.0, "max_speed_mps": 5.0, "max_speed_confidence": "low", "quality_score": 90.0}, {"track_id": 2, "started_at": DAY + timedelta(days=7), "distance_m": 2000.0, "moving_s": 400.0, "max_speed_mps": 6.0, "max_speed_confidence": "medium", "quality_score": 100.0}])
    one = portfolio.share_summary(rows).first()
    assert (one.distance_m, one.moving_s, one.avg_speed_mps, one.max_speed_mps, one.max_speed_confidence, one.quality_score) == (3000, 500, 6, 6, "medium", 95)
    assert portfolio.share_summary(rows, "2025-01-06 09:00:00", "2025-01-13 09:00:00").first().track_count == 1
    week = {str(r.bucket): r.distance_m for r in portfolio.recap_rhythm(rows, "week", "2025-01-13").collect()}
    assert len(week) == 7 and week["2025-01-13"] == 2000
    assert portfolio.period_days_ok("week", 7) and not portfolio.period_days_ok("month", 40)
    empty = rows.limit(0)
    assert portfolio.share_summary(empty).first().track_count == 0 and portfolio.speed_history(empty).count() == 0
    assert portfolio.recap_rhythm(empty, "month", "2025-02-10").count() == 28 and portfolio.all_time_rhythm(empty).count() == 0


def test_trend_and_streak(spark):
    rows = tracks(spark, [{"track_id": i, "cluster_id": 1, "started_at": DAY + timedelta(days=i), "avg_speed_mps": v} for i, v in enumerate([5.0, 5.1, 4.9, 5.6, 5.7, 5.8])])
    one = progress.trends(rows).first()
    assert one.direction == "faster" and one.signal == "recent 3 vs prior 3" and one.recent_speed_mps == 5.7
    assert progress.trends(rows.where("track_id = 0")).first().direction == "building"
    weeks = tracks(spark, [{"track_id": i, "started_at": DAY + timedelta(weeks=w)} for i, w in enumerate([0, 2, 3, 3, 4])])
    assert progress.weekly_streak(weeks).first().weeks == 3
    assert progress.weekly_volume(weeks, "2025-02-05").count() == 12


def test_sectors_and_effort(spark):
    series = spark.createDataFrame([(1, i, i / 10, 18.0, i * 20_000) for i in range(101)], "track_id long, i int, distance_km double, speed_kmh double, ms long")
    speeds = progress.sector_speeds(series, "track_id").collect()
    assert len(speeds) == 10 and all(r.speed_mps == pytest.approx(5) for r in speeds)
    sectors = [(t, k, 60.0, 60.0, 140.0 - 10 * t, 20.0, 60.0 * k, 60.0 * k + 60) for t in (0, 1) for k in range(5)]
    frame = spark.createDataFrame(sectors, "track_id long, index int, moving_s double, eligible_s double, average_bpm double, speed_kmh double, start_s double, end_s double")
    attempts = spark.createDataFrame([(7, 0, DAY), (7, 1, DAY + timedelta(days=3))], "cluster_id long, track_id long, started_at timestamp")
    usable = progress.usable_sectors(frame, attempts.select("track_id", F.lit(0).alias("alignment")))
    one = progress.effort_pairs(attempts, usable).first()
    assert one.label == "Lower HR at similar speed" and one.hr_delta == -10 and one.support_s == 300
    assert progress.effort_trends_by_route(attempts, usable).count() == 0


def test_imports(spark):
    archives = spark.createDataFrame([(1, 1, 2, "processing", "", 0), (2, 1, 0, "processing", "", 5)], "archive_id long, batch_id long, item_count long, status string, stage string, progress int")
    items = spark.createDataFrame([(1, "complete"), (1, "failed")], "archive_id long, status string")
    found = {r.archive_id: r for r in imports.archive_counters(archives, items).collect()}
    assert (found[1].status, found[1].progress, found[2].status, found[2].progress) == ("partial", 100, "processing", 5)
    batches = imports.batch_rollup(spark.createDataFrame([(1, "processing"), (2, "processing")], "batch_id long, status string"), imports.archive_counters(archives, items))
    assert {r.batch_id: r.status for r in batches.collect()} == {1: "processing", 2: "processing"}
    new = imports.new_recordings(spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "c")], "sha256 string, path string"), spark.createDataFrame([("y", 4)], "sha256 string, track_id long"))
    assert [(r.sha256, r.path) for r in new.collect()] == [("x", "a")]


GPX = """<?xml version="1.0"?><gpx creator="T" xmlns:o="x"><metadata><extensions><o:route>Mountain Bike</o:route></extensions></metadata><trk><name>Loop</name><trkseg>
{points}</trkseg><trkseg><trkpt lat="91" lon="12"/></trkseg></trk></gpx>"""


def gpx(n=12):
    return GPX.format(points="".join(f'<trkpt lat="{55.6761 + i * 0.001}" lon="{12.5683 + i * 0.001}"><ele>{12 + i}</ele><time>2025-01-01T10:00:{i:02d}Z</time><extensions><o:hr>{"broken" if i == 3 else 120 + i}</o:hr></extensions></trkpt>' for i in range(n))).encode()


def fit_file(n=20):
    body = struct.pack("<BBBHB", 0x40, 0, 0, 20, 5) + bytes([253, 4, 0x86, 0, 4, 0x85, 1, 4, 0x85, 3, 1, 0x02, 5, 4, 0x86])
    for i in range(n):
        body += struct.pack("<BIiiBI", 0, 1_000_000_000 + i, round((55 + i * 1e-4) * 2**31 / 180), round(12 * 2**31 / 180), 255 if i == 4 else 130, i * 612)
    head = struct.pack("<BBHI4s", 14, 16, 100, len(body), b".FIT")
    head += struct.pack("<H", fit.crc16(head))
    return head + body + struct.pack("<H", fit.crc16(head + body))


def test_sources(spark, tmp_path):
    (tmp_path / "a_ride.gpx").write_bytes(gpx())
    (tmp_path / "copy.gpx").write_bytes(gpx())
    (tmp_path / "ride.FIT").write_bytes(fit_file())
    (tmp_path / "cut.fit").write_bytes(fit_file()[:-40])
    (tmp_path / "evil.gpx").write_bytes(b'<!DOCTYPE x><gpx></gpx>')
    (tmp_path / "empty.gpx").write_bytes(b"")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("items.json", json.dumps({"version": 4, "items": [{"type": "GPX", "file": "/tracks/b.gpx"}, {"type": "PHOTO", "file": "x"}]}))
        z.writestr("tracks/b.gpx", gpx(5))
    (tmp_path / "all.osf").write_bytes(packed.getvalue())
    (tmp_path / "bad.osf").write_bytes(b"PK nothing")
    rows = recordings.read(spark, f"file://{tmp_path}").cache()
    found = {r.path.rpartition("/")[2]: r for r in recordings.recordings(rows).collect()}
    assert found["a_ride.gpx"].activity_type == "mountain_bike" and found["a_ride.gpx"].invalid_point_count == 1 and found["a_ride.gpx"].name == "Loop"
    assert found["ride.FIT"].point_count == 20 and found["ride.FIT"].warnings == [] and found["cut.fit"].point_count < 20 and found["cut.fit"].warnings
    assert "document type" in found["evil.gpx"].error and "empty.gpx" not in found and found["bad.osf"].error and found["all.osf"].entry == "tracks/b.gpx"
    points = recordings.points(rows)
    per = {r.track_id: r.n for r in points.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per[found["a_ride.gpx"].sha256] == 12 and len(per) == 4
    one = points.where(F.col("track_id") == found["a_ride.gpx"].sha256).orderBy("position").collect()
    assert one[3].heart_rate_bpm is None and one[4].heart_rate_bpm == 124 and one[3].extras["hr"] == "broken" and one[0].elevation_m == 12
    ridden = points.where(F.col("track_id") == found["ride.FIT"].sha256).orderBy("position").collect()
    assert ridden[4].heart_rate_bpm is None and ridden[1].sensor_distance_m == 6.12 and ridden[0].latitude == pytest.approx(55, abs=1e-6)


def test_demo_library(spark):
    derived = P.derive_points(demo.demo_points(spark, 3))
    rows = analysed_tracks(derived).collect()
    assert len(rows) == 3 and all(r.point_count == 220 and r.best_1km_speed_mps and r.best_5km_speed_mps for r in rows)
    levels = {(r.track_id, r.level): r.point_count for r in renderings(derived).collect()}
    assert set(levels.values()) == {220}
    paths = renderings(derived).where("level = 'overview'").select("track_id", "path")
    found = routes.features(routes.eligible(analysed_tracks(derived).withColumns({"activity_type": F.lit("ride"), "name": F.lit("x")})), paths).collect()
    assert len(found) == 3 and all(len(r.samples) == 64 for r in found)


def test_streams(spark, tmp_path):
    from ridgeline.streaming.recordings import analyse_arrivals, sessions

    demo.demo_points(spark, 2).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(demo.demo_points(spark, 1).schema).parquet(f"{tmp_path}/in")
    analyse_arrivals(source, f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    query = sessions(source).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT * FROM found").where("track_id = 0").first().point_count == 220
