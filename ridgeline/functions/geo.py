"""Geodesy as Column functions: distance, bearing, geohash, polylines."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EARTH_RADIUS_M

#: The type of a path.  Workers import this module without a session, so it isn't parsed from text.
PATH = T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
#: Fixed value: the geohash digits.
GEOHASH_DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres; null if any coordinate is."""
    a1, o1, a2, o2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    a1, o1, a2, o2 = (F.radians(c) for c in (lat1, lon1, lat2, lon2))
    y = F.sin(o2 - o1) * F.cos(a2)
    x = F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(o2 - o1)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def geohash(lat: Column, lon: Column, precision: int = 7) -> Column:
    """Geohash of a position, from its two quantised coordinates; even bits are longitude."""
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2

    def quantise(value: Column, low: float, span: float, n: int) -> Column:
        return F.least(F.floor((value - low) / span * (1 << n)), F.lit((1 << n) - 1)).cast("bigint")

    held = {0: (quantise(lon, -180.0, 360.0, n_lon), n_lon), 1: (quantise(lat, -90.0, 180.0, n_lat), n_lat)}
    digits = []
    for k in range(precision):
        value = F.lit(0)
        for j in range(5):
            at = 5 * k + j
            source, n = held[at % 2]
            value = value + F.shiftright(source, n - 1 - at // 2).bitwiseAND(1) * (1 << (4 - j))
        digits.append(F.substring(F.lit(GEOHASH_DIGITS), value.cast("int") + 1, F.lit(1)))
    return F.concat(*digits)


def _chunks(value: Column) -> Column:
    """One signed number of a polyline, five bits a character, lowest first."""
    zigzag = F.when(value < 0, -2 * value - 1).otherwise(2 * value).cast("bigint")
    parts = []
    for i in range(6):
        left, more = F.shiftright(zigzag, 5 * i), F.shiftright(zigzag, 5 * (i + 1))
        parts.append(F.when((left > 0) | F.lit(i == 0), F.char((left.bitwiseAND(31) + F.when(more > 0, 32).otherwise(0) + 63).cast("bigint"))).otherwise(""))
    return F.concat(*parts)


def polyline_encode(points: Column, precision: int = 5) -> Column:
    """Encoded polyline of an array of structs (lat, lon): the differences of the scaled, rounded coordinates."""
    scale = float(10**precision)
    scaled = F.transform(points, lambda p: F.struct(F.round(p["lat"] * scale).cast("bigint").alias("lat"), F.round(p["lon"] * scale).cast("bigint").alias("lon")))
    before = F.concat(F.array(F.struct(F.lit(0).cast("bigint").alias("lat"), F.lit(0).cast("bigint").alias("lon"))), scaled)
    steps = F.zip_with(scaled, F.slice(before, 1, F.size(scaled)), lambda b, a: F.concat(_chunks(b["lat"] - a["lat"]), _chunks(b["lon"] - a["lon"])))
    return F.array_join(steps, "")


def encode_polyline(points: list[tuple[float, float]], precision: int = 5) -> str:
    """``polyline_encode`` of a list of (lat, lon), for SQL."""
    out, before = [], (0, 0)
    for point in points:
        scaled = tuple(int(math.copysign(math.floor(abs(x) * 10**precision + 0.5), x)) for x in point)
        for a, b in zip(before, scaled, strict=True):
            value = (b - a) * 2 if b >= a else (a - b) * 2 - 1
            while value > 31:
                out.append(chr((value & 31 | 32) + 63))
                value >>= 5
            out.append(chr(value + 63))
        before = scaled
    return "".join(out)


def decode_polyline(text: str, precision: int = 5) -> list[tuple[float, float]]:
    """(lat, lon) pairs of an encoded polyline; a truncated last number is left out."""
    numbers, value, shift = [], 0, 0
    for c in text:
        part = ord(c) - 63
        value |= (part & 31) << shift
        shift += 5
        if part < 32:
            numbers.append(-(value >> 1) - 1 if value & 1 else value >> 1)
            value, shift = 0, 0
    lat = lon = 0
    out = []
    for a, b in zip(numbers[::2], numbers[1::2], strict=False):
        lat, lon = lat + a, lon + b
        out.append((lat / 10**precision, lon / 10**precision))
    return out


@F.pandas_udf(PATH)
def polyline_decode(encoded: pd.Series) -> pd.Series:
    """Positions of encoded polylines; null stays null."""
    return encoded.map(lambda s: None if s is None else [{"lat": a, "lon": b} for a, b in decode_polyline(s)])
