"""Column functions, and their registration for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import udtf
from .geo import encode_polyline, polyline_decode

_SQL_FUNCTIONS = """
CREATE OR REPLACE TEMPORARY FUNCTION haversine_m(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE
RETURN 2 * 6371008.8D * atan2(
  sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)),
  sqrt(1 - (pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))));
CREATE OR REPLACE TEMPORARY FUNCTION bearing_degrees(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE
RETURN pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)),
  cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360, 360D);
CREATE OR REPLACE TEMPORARY FUNCTION geohash_at(lat DOUBLE, lon DOUBLE, precision INT) RETURNS STRING
RETURN array_join(transform(sequence(0, precision - 1), k -> substring('0123456789bcdefghjkmnpqrstuvwxyz', 1 + aggregate(sequence(5 * k, 5 * k + 4), 0, (v, i) -> 2 * v + CAST(
  CASE WHEN i % 2 = 0 THEN shiftright(least(floor((lon + 180) / 360 * shiftleft(1L, (5 * precision + 1) div 2)), shiftleft(1L, (5 * precision + 1) div 2) - 1), CAST((5 * precision + 1) div 2 - 1 - i div 2 AS INT)) & 1
  ELSE shiftright(least(floor((lat + 90) / 180 * shiftleft(1L, 5 * precision div 2)), shiftleft(1L, 5 * precision div 2) - 1), CAST(5 * precision div 2 - 1 - i div 2 AS INT)) & 1 END AS INT)), 1)), '')
"""


@F.pandas_udf(T.StringType())
def _encoded(paths: pd.Series) -> pd.Series:
    return paths.map(lambda path: None if path is None else encode_polyline([(p["lat"], p["lon"]) for p in path]))


def register(spark: SparkSession) -> None:
    """Make haversine_m, bearing_degrees, geohash_at, polyline_encode, polyline_decode and the table function interval_selection callable from SQL in this session."""
    for statement in _SQL_FUNCTIONS.split(";"):
        spark.sql(statement)
    spark.udf.register("polyline_decode", polyline_decode)
    spark.udf.register("polyline_encode", _encoded)
    udtf.register(spark)
