"""Heart-rate profiles that change over time: each track has the zones of the revision that held when it was ridden."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import heart_rate_edges

#: More revisions than this are refused: they are written into the plan.
MOST_REVISIONS = 1_000


def revisions(profiles: DataFrame) -> list[dict]:
    """The revisions by date: ``revision, valid_from`` and the five lower ``edges``, None for mode none.

    ``profiles``: ``revision, valid_from, mode, maximum, edges``.  Of several of one date the highest revision holds.
    An invalid profile, or more than MOST_REVISIONS, raise ValueError.
    """
    rows = profiles.orderBy("valid_from", "revision").limit(MOST_REVISIONS + 1).collect()
    if len(rows) > MOST_REVISIONS:
        raise ValueError(f"more than {MOST_REVISIONS} revisions")
    return [{"revision": r.revision, "valid_from": r.valid_from, "edges": heart_rate_edges(r.mode, r.maximum, r.edges)} for r in rows]


def with_profile(tracks: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds ``zone_revision`` and ``zone_edges`` of the last revision not after ``started_at``; revision 0 without edges before the first, or without a date."""
    array = "array<struct<valid_from:timestamp,revision:bigint,edges:array<int>>>"
    edges = lambda r: F.array(*[F.lit(e) for e in r["edges"]]) if r["edges"] else F.lit(None).cast("array<int>")
    listed = F.array(*[F.struct(F.lit(r["valid_from"]).alias("valid_from"), F.lit(r["revision"]).alias("revision"), edges(r).alias("edges")) for r in revisions(profiles)]).cast(array)
    last = F.try_element_at(F.filter(listed, lambda r: r["valid_from"] <= F.col("started_at")), F.lit(-1))
    return tracks.withColumn("_p", last).withColumns({"zone_revision": F.coalesce("_p.revision", F.lit(0).cast("bigint")), "zone_edges": F.col("_p.edges")}).drop("_p")


def zones(histogram: DataFrame, profiled: DataFrame) -> DataFrame:
    """``track_id, zone_revision, zone_seconds`` (five, from the histogram's ``bpm, seconds``) of each track whose profile has zones; beats below the first edge are in none.  No recording is read again."""
    rows = histogram.join(profiled.where("zone_edges is not null").select("track_id", "zone_revision", "zone_edges"), "track_id").withColumn("zone", F.when(F.col("bpm") < 241, F.size(F.filter("zone_edges", lambda e: e <= F.col("bpm")))))
    sums = [F.coalesce(F.sum(F.when(F.col("zone") == z, F.col("seconds"))), F.lit(0.0)) for z in range(1, 6)]
    return rows.groupBy("track_id", "zone_revision").agg(F.array(*sums).alias("zone_seconds"))


def pending(stored: DataFrame, profiled: DataFrame) -> DataFrame:
    """The tracks whose stored ``zone_revision`` isn't the one that holds now."""
    return profiled.join(stored.select("track_id", F.col("zone_revision").alias("_held")), "track_id", "left").where(~F.col("zone_revision").eqNullSafe(F.coalesce("_held", F.lit(-1).cast("bigint")))).drop("_held")


def recalibrate(stored: DataFrame, histogram: DataFrame, profiled: DataFrame) -> DataFrame:
    """``stored`` (``track_id, zone_revision, zone_seconds``) with only the pending tracks' zones computed anew; tracks that went are left out."""
    todo = pending(stored, profiled)
    fresh = zones(histogram, todo)
    without = todo.join(fresh, "track_id", "left_anti").select("track_id", "zone_revision", F.lit(None).cast("array<double>").alias("zone_seconds"))
    kept = stored.join(todo, "track_id", "left_anti").join(profiled, "track_id", "left_semi")
    return functools.reduce(DataFrame.unionByName, [kept.select("track_id", "zone_revision", "zone_seconds"), fresh, without])
