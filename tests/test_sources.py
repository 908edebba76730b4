"""Archives read entry by entry, and files beyond what Spark holds as one value."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ridgeline.sources import archives, recordings


def track(first: int) -> str:
    points = "".join(f'<trkpt lat="55.{i:03d}" lon="12.0"><time>2024-01-01T00:00:{i:02d}Z</time></trkpt>' for i in range(first, 30))
    return f"<gpx><trk><trkseg>{points}</trkseg></trk></gpx>"


def pack(path, entries, listed=None):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("items.json", json.dumps({"version": 1, "items": [{"type": "GPX", "file": n} for n in listed or entries]}))
        for name, text in entries.items():
            z.writestr(name, text)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    for k in range(3):
        pack(tmp_path / "sub" / f"a{k}.osf", {f"tracks/r{i}.gpx": track(3 * k + i) for i in range(3)})
    pack(tmp_path / "short.OSF", {"r.gpx": track(20)}, listed=["r.gpx", "gone.gpx"])
    (tmp_path / "bad.osf").write_bytes(b"PK nothing")
    (tmp_path / "tiny.osf").write_bytes(b"")
    (tmp_path / "ride.gpx").write_text(track(15))
    return tmp_path


def test_entries_land_in_several_partitions(spark, folder):
    found = archives.read(spark, f"file://{folder}", partition_bytes=1)
    rows = found.withColumn("part", F.spark_partition_id()).collect()
    good = [r for r in rows if r.error is None]
    assert len(good) == 9 and len({r.part for r in good}) == 9
    assert {r.content.decode() for r in good} == {track(3 * k + i) for k in range(3) for i in range(3)} and all(r.size == len(r.content) for r in good)
    wrong = {r.path.rpartition("/")[2]: r.error for r in rows if r.error}
    assert set(wrong) == {"short.OSF", "bad.osf", "tiny.osf"} and "gone.gpx" in wrong["short.OSF"]
    assert archives.read(spark, f"file://{folder}").withColumn("part", F.spark_partition_id()).where("error is null").select("part").distinct().count() == 3
    assert archives.read(spark, f"file://{folder}", glob="none*").count() == 0


def test_filters_decide_what_is_opened(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = archives.read(spark, f"file://{folder}", partition_bytes=1)
        one = found.where(F.col("path").endswith("a1.osf") & F.col("entry").isin("tracks/r2.gpx", "none"))
        assert one.rdd.getNumPartitions() == 1
        assert [(r.entry, r.content.decode()) for r in one.collect()] == [("tracks/r2.gpx", track(5))]
        assert found.where("error is not null").count() == 3 and found.where(F.col("entry").startswith("tracks/")).count() == 9
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_damaged_entry_is_an_error_row(spark, tmp_path):
    pack(tmp_path / "a.osf", {"x.gpx": track(1), "y.gpx": track(2)})
    with zipfile.ZipFile(tmp_path / "a.osf") as z:
        at = z.getinfo("x.gpx").header_offset + 30 + len("x.gpx")
    raw = bytearray((tmp_path / "a.osf").read_bytes())
    raw[at : at + 4] = b"\xff\xff\xff\xff"
    (tmp_path / "a.osf").write_bytes(bytes(raw))
    found = {r.entry: r for r in archives.read(spark, f"file://{tmp_path}").collect()}
    assert found["x.gpx"].content is None and found["x.gpx"].error and found["y.gpx"].content.decode() == track(2)


def test_files_beyond_one_value_are_error_rows(spark, folder):
    (folder / "long.gpx").write_text(track(0) + " " * 5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "4000")
    try:
        rows = recordings.recordings(recordings.read(spark, f"file://{folder}")).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    errors = {r.path.rpartition("/")[2]: r.error for r in rows if r.error}
    assert errors["long.gpx"] == "file too large" and set(errors) == {"long.gpx", "short.OSF", "bad.osf", "tiny.osf"}
    assert sorted(r.point_count for r in rows if not r.error) == sorted([15, *(30 - 3 * k - i for k in range(3) for i in range(3))])
    assert recordings.recordings(recordings.read(spark, f"file://{folder}", "a?.osf")).count() == 9
