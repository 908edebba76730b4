"""Functions registered for SQL against their column versions."""

import pytest
from pyspark.sql import functions as F

from ridgeline.functions import geo, register
from ridgeline.operators import heart_rate

SPAN = "track_id long, start_ms long, end_ms long, dt_ms double, h0 double, h1 double, d0 double, d1 double, speed double, hr_ok boolean, moving boolean"


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    register(spark)


def timeline(spark):
    rows = []
    for t in (1, 2, 3):
        for k in range(60):
            dt = 1000 * (1 + (k * t) % 5)
            start = 5000 * k
            ok = (k + t) % 4 > 0
            rows.append((t, start, start + dt, float(dt), 100.0 + k if ok else None, 101.0 + k if ok else None, k * 10.0, k * 10.0 + (8 if k % 7 else -1), 2.0 if ok else None, ok, k % 3 > 0))
    rows.append((4, 10**9, 10**9 + 1000, 1000.0, 90.0, 91.0, 0.0, 1.0, 1.0, True, True))
    return spark.createDataFrame(rows, SPAN).withColumn("area", F.when(F.col("hr_ok"), (F.col("h0") + F.col("h1")) / 2 * F.col("dt_ms") / 1000)).repartition(7)


def test_interval_selection(spark):
    rows = timeline(spark)
    rows.createOrReplaceTempView("spans")
    plain = lambda table: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in (r[c] for c in sorted(table.columns))) for r in table.collect())
    found = spark.sql("SELECT * FROM interval_selection(TABLE(spans), 63.2, 240.5D)")
    assert plain(found) == plain(heart_rate.selection(rows, 63.2, 240.5)) and found.count() == 3
    named = rows.withColumn("track_id", F.concat(F.lit("t"), "track_id"))
    named.createOrReplaceTempView("named")
    assert dict(spark.sql("SELECT * FROM interval_selection(TABLE(named), 0, 10)").dtypes)["track_id"] == "string"
    for wrong in ("interval_selection(TABLE(spans), 5, 5)", "interval_selection(TABLE(SELECT 1 AS track_id), 1, 5)"):
        with pytest.raises(Exception, match="0 <= from < until|lacks"):
            spark.sql(f"SELECT * FROM {wrong}").collect()


def test_geohash_and_polyline(spark):
    rows = spark.createDataFrame([(57.64911, 10.40744), (-90.0, -180.0), (90.0, 180.0), (0.0, 0.0), (-33.8688, 151.2093)], "lat double, lon double")
    rows.createOrReplaceTempView("places")
    for precision in (1, 5, 7, 8):
        got = [r.g for r in spark.sql(f"SELECT geohash_at(lat, lon, {precision}) AS g FROM places").collect()]
        assert got == [r.g for r in rows.select(geo.geohash(F.col("lat"), F.col("lon"), precision).alias("g")).collect()]
    assert spark.sql("SELECT geohash_at(57.64911D, 10.40744D, 7) AS g").first().g == "u4pruyd"
    path = rows.agg(F.collect_list(F.struct("lat", "lon")).alias("path"))
    path.createOrReplaceTempView("paths")
    assert spark.sql("SELECT polyline_encode(path) AS p FROM paths").first().p == path.select(geo.polyline_encode(F.col("path")).alias("p")).first().p
    assert spark.sql("SELECT polyline_encode(array(named_struct('lat', 38.5D, 'lon', -120.2D), named_struct('lat', 40.7D, 'lon', -120.95D), named_struct('lat', 43.252D, 'lon', -126.453D))) AS p").first().p == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
