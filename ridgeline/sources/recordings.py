"""Recordings from files: GPX, FIT and zipped exports, one task a file, errors kept as a column.

``read`` lists files through Spark's binaryFile source, so any file system that Spark reads will do.  A file
becomes a header row and rows of up to ``CHUNK`` points, so a long recording is never one value; write the result
once, then take ``recordings`` and ``points`` from it.  Spark's source doesn't list files without content.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import scalars as S
from . import archives, fit, gpx, osf
from .errors import Unreadable

CHUNK = 10_000
_POINT = "struct<track_position:int,segment_position:int,position:int,latitude:double,longitude:double,elevation_m:string,recorded_at:string,hdop:string,recorded_speed_mps:string,heart_rate_bpm:string,cadence_rpm:string,sensor_speed_mps:string,sensor_distance_m:string,extras:map<string,string>>"
_SCHEMA = f"path string, entry string, sha256 string, source_format string, name string, creator string, activity_type string, invalid_point_count int, records_without_position int, point_count int, warnings array<string>, error string, points array<{_POINT}>"


def format_of(path):
    """osf, gpx or fit by the file name's extension, in either case; else null."""
    found = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(found.isin("osf", "gpx", "fit"), found)


def _parse(kind: str, content: bytes) -> dict:
    if not content:
        raise Unreadable("empty file")
    if kind == "fit":
        return fit.parse(content)
    if b"<gpx" not in content[:4096]:
        raise Unreadable("not a GPX file")
    return gpx.parse(content)


def _rows(path: str, entry: str | None, kind: str, content: bytes | None, error: str | None = None) -> Iterator[dict]:
    head = {"path": path, "entry": entry, "sha256": hashlib.sha256(content).hexdigest() if content else None, "source_format": kind, "points": None, "warnings": [], "error": error}
    if error is None:
        try:
            found = _parse(kind, content)
            points = found.pop("points")
            yield {**head, **found, "point_count": len(points)}
            for i in range(0, len(points), CHUNK):
                yield {**head, "points": points[i : i + CHUNK]}
            return
        except Unreadable as problem:
            head["error"] = str(problem)
    yield head


_COLUMNS = [part.split(" ")[0] for part in _SCHEMA.split(", ")][:12] + ["points"]


def _frames(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    for row in rows:
        yield pd.DataFrame([row]).reindex(columns=_COLUMNS).astype(object).where(lambda x: x.notna(), None)


def _of_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, kind, content in frame.itertuples(index=False):
            if content is None:
                yield from _frames(_rows(path, None, kind, None, "file too large"))
            elif kind == "osf":
                yield from _frames(row for entry, body, error in osf.entries(content) for row in _rows(path, entry, "gpx", body, error))
            else:
                yield from _frames(_rows(path, None, kind, content))


def _of_entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, entry, content, error in frame.itertuples(index=False):
            yield from _frames(_rows(path, entry, "gpx", content, error))


def read(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Header and point rows of all recordings below a folder; archives give one recording an entry.

    Archives are read entry by entry, whatever their size, in stores that ``archives`` opens; in others as one value
    each.  Files beyond their kind's limit, or beyond what Spark holds as one value, are error rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    files = files.withColumn("kind", format_of(F.col("path"))).where("kind IS NOT NULL")
    apart = archives.opens(folder)
    if apart:
        files = files.where("kind <> 'osf'")
    held = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    limit = F.least(F.lit(held), F.when(F.col("kind") == "fit", C.MAX_FIT_BYTES).when(F.col("kind") == "gpx", C.MAX_FILE_BYTES).otherwise(C.MAX_EXPANDED_BYTES))
    # a filter on the length alone reaches the source, which then doesn't open what is longer
    small = files.where((F.col("length") <= held) & (F.col("length") <= limit)).select("path", "kind", "content")
    large = files.where(F.col("length") > limit).select("path", "kind", F.lit(None).cast("binary").alias("content"))
    found = small.unionAll(large).mapInPandas(_of_files, _SCHEMA)
    if not apart:
        return found
    entries = archives.read(spark, folder).where(_like(F.col("path"), glob)).select("path", "entry", "content", "error")
    return found.unionAll(entries.mapInPandas(_of_entries, _SCHEMA))


def _like(path, glob: str):
    """Whether the file name matches a pattern of ``*`` and ``?``, as ``pathGlobFilter`` would have it."""
    own = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)
    return F.regexp_extract(path, r"([^/]*)$", 1).rlike(f"^{own}$")


def recordings(read_rows: DataFrame) -> DataFrame:
    """One row a recording, with the activity as an id and a default name."""
    rows = read_rows.where("points IS NULL").drop("points")
    source = F.coalesce("entry", "path")
    return rows.withColumns({"source_filename": F.regexp_extract(source, r"([^/]*)$", 1), "name": F.coalesce(F.nullif(F.trim("name"), F.lit("")), S.default_name(source)), "activity_type": S.activity_id(F.col("activity_type")), "status": F.when(F.col("error").isNull(), "queued").otherwise("failed")})


def points(read_rows: DataFrame) -> DataFrame:
    """The points of all recordings, ``track_id`` being the content's hash; a content that comes twice counts once."""
    rows = read_rows.where("points IS NOT NULL")
    first = F.dense_rank().over(Window.partitionBy("sha256").orderBy("path", F.coalesce("entry", F.lit(""))))
    each = rows.withColumn("_r", first).where("_r = 1").select(F.col("sha256").alias("track_id"), F.explode("points").alias("p"))
    number = lambda c: S.parse_number(F.col(f"p.{c}"))
    return each.select(
        "track_id",
        *[F.col(f"p.{c}").alias(c) for c in ("track_position", "segment_position", "position", "latitude", "longitude")],
        number("elevation_m").alias("elevation_m"),
        S.parse_instant(F.col("p.recorded_at")).alias("recorded_at"),
        number("hdop").alias("hdop"),
        number("recorded_speed_mps").alias("recorded_speed_mps"),
        S.normal_heart_rate(number("heart_rate_bpm")).alias("heart_rate_bpm"),
        S.normal_cadence(number("cadence_rpm")).alias("cadence_rpm"),
        S.normal_speed(number("sensor_speed_mps")).alias("sensor_speed_mps"),
        S.normal_odometer(number("sensor_distance_m")).alias("sensor_distance_m"),
        F.col("p.extras").alias("extras"),
    )


def store(read_rows: DataFrame, folder: str) -> None:
    """Write once, by the first two digits of the content's hash; rows of a hash that comes again replace its own part."""
    read_rows.withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(folder)
