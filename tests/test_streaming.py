"""Recordings that arrive in pieces give what the batch pass gives, however they are cut."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import points as P
from ridgeline.streaming.accepted import accepted_fixes

SCHEMA = "track_id string, track_position int, segment_position int, position int, latitude double, longitude double, elevation_m double, recorded_at timestamp, note string"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ride(name, rng, n=160):
    rows, at, lat, segment = [], 0, 55.0, 0
    for k in range(n):
        at += rng.choice([1, 2, 5, 5, 20])
        lat += 4e-5 * rng.random()
        if rng.random() < 0.03:
            segment, at = segment + 1, at + 90
        jump = 0.05 if rng.random() < 0.06 else 0.0
        if rng.random() < 0.01:
            lat += 0.03  # moved for good
        rows.append((name, 0, segment, k, lat + jump, 12.0 + rng.random() * 1e-4, None if rng.random() < 0.1 else 20 + 5 * rng.random(), START + datetime.timedelta(seconds=at), "x"))
    return rows


def batch_rows(spark, rows):
    points = spark.createDataFrame(rows, SCHEMA).withColumns({"distance_source": F.lit("gps"), **{c: F.lit(None).cast("double") for c in ("sensor_distance_m", "sensor_speed_mps")}})
    found = P.with_credit(P.accept_fixes(P.with_warmup(points.repartition("track_id"))).repartition("track_id"))
    return found.drop("distance_source", "sensor_distance_m", "sensor_speed_mps", "delta_m", "delta_ms")


def plain(row):
    return tuple(round(x, 7) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("seed", range(2))
def test_any_cut_gives_the_batch_rows(spark, tmp_path, seed):
    rng = random.Random(seed)
    tracks = [ride(f"t{k}", rng) for k in range(4)]
    cuts = sorted(rng.sample(range(1, 160), 4 if seed else 1))
    (tmp_path / "in").mkdir()
    for a, b in zip([0, *cuts], [*cuts, 160]):
        part = [r for t in tracks for r in t[a:b]]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    later = START + datetime.timedelta(days=3)
    for k in range(2):  # time goes on, so that tracks end
        spark.createDataFrame([("clock", 0, 0, k, 0.0, 0.0, None, later + datetime.timedelta(days=k), "x")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = accepted_fixes(stream, late="1 day").writeStream.format("memory").queryName(f"accepted{seed}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = batch_rows(spark, [r for t in tracks for r in t])
    columns = want.columns
    found = spark.table(f"accepted{seed}").where("track_id <> 'clock'").select(*columns)
    mine, theirs = sorted(map(plain, found.collect())), sorted(map(plain, want.collect()))
    assert mine == theirs and len(mine) == 640
    assert any(not r[columns.index("valid")] for r in theirs) and any(r[columns.index("gps_warmup")] for r in theirs)
