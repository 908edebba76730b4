"""Queries over the library of tracks: lists, totals, speed history, records, heat map, recaps.

``tracks``: ``track_id, name, source_filename, status, started_at, ended_at, inserted_at, ...`` with the summary's
measures.  What depends on today takes it as ``as_of``.  Ties are broken by ``track_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.scalars import search_term
from ..functions.stats import framed_median, percent_delta
from .ordered import in_blocks, numbered, running_max

METRICS = {"instantaneous": "max_speed_mps", "1km": "best_1km_speed_mps", "5km": "best_5km_speed_mps"}


def complete(tracks: DataFrame) -> DataFrame:
    return tracks.where(F.col("status") == "complete")


def list_tracks(tracks: DataFrame, status: str | None = None, term: str | None = None, limit: int = C.LIST_LIMIT) -> DataFrame:
    """The newest tracks, undated last, by status group and by part of a name or file name."""
    rows = tracks
    if status == "processing":
        rows = rows.where(F.col("status").isin(*C.PROCESSING_STATUSES))
    elif status:
        rows = rows.where(F.col("status") == status)
    if term:
        rows = rows.where(F.col("name").ilike(search_term(term)) | F.col("source_filename").ilike(search_term(term)))
    return rows.orderBy(F.desc_nulls_last("started_at"), F.desc("inserted_at"), "track_id").limit(limit)


def track_by_id(tracks: DataFrame, track_id) -> DataFrame:
    """The track of an id, one row or none."""
    return tracks.where(F.col("track_id") == F.lit(track_id))


def fetch_track(tracks: DataFrame, track_id) -> Row:
    """The track of an id.  Raises LookupError if there is none."""
    found = track_by_id(tracks, track_id).first()
    if found is None:
        raise LookupError(f"no track {track_id}")
    return found


def compare_tracks(tracks: DataFrame, ids: list[int]) -> DataFrame:
    """Up to four analysed tracks in the order asked for."""
    wanted = ids[: C.COMPARE_LIMIT]
    place = F.array_position(F.array(*[F.lit(i) for i in wanted]), F.col("track_id")) if wanted else F.lit(0)
    return tracks.where(F.col("track_id").isin(wanted) & F.col("status").isin("complete", "insufficient_data")).withColumn("place", place).orderBy("place")


def compare_payload(tracks: DataFrame) -> DataFrame:
    """Units for comparing: km, hours, km/h; unknown counts as 0."""
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return tracks.select("track_id", F.round(known("distance_m") / 1000, 2).alias("distance_km"), F.round(known("moving_s") / 3600, 2).alias("moving_h"), F.round(known("avg_speed_mps") * 3.6, 2).alias("avg_kmh"), F.round(known("max_speed_mps") * 3.6, 2).alias("max_kmh"), F.round(known("elevation_gain_m"), 0).alias("gain_m"))


def latest_complete(tracks: DataFrame) -> DataFrame:
    return complete(tracks).orderBy(F.desc_nulls_last("started_at"), F.desc("inserted_at"), "track_id").limit(1)


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0)).alias(c)


def portfolio_summary(tracks: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: totals of complete tracks, how many are being processed, visited cells as rows and as distinct cells."""
    done = F.col("status") == "complete"
    of = lambda f, c, name: f(F.when(done, F.col(c))).alias(name)
    totals = tracks.agg(
        F.count_if(done).alias("track_count"),
        *[F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0.0)).alias(c) for c in ("distance_m", "moving_s", "elevation_gain_m")],
        of(F.min, "started_at", "earliest_at"),
        of(F.max, "ended_at", "latest_at"),
        F.count_if(F.col("status").isin(*C.PROCESSING_STATUSES)).alias("processing_count"),
        of(F.avg, "quality_score", "quality_score"),
    )
    return totals.crossJoin(cells.agg(F.count(F.lit(1)).alias("route_cells"), F.count_distinct("cell").alias("distinct_cells")))  # one row each


def monthly_totals(tracks: DataFrame) -> DataFrame:
    rows = complete(tracks).where("started_at IS NOT NULL")
    return rows.groupBy(F.date_format("started_at", "yyyy-MM").alias("month")).agg(_total("distance_m"), _total("moving_s"), _total("elevation_gain_m"), F.count(F.lit(1)).alias("track_count")).orderBy("month")


def share_summary(tracks: DataFrame, start: str | None = None, until: str | None = None) -> DataFrame:
    """Totals and bests of complete tracks, of all or of those from a time up to, not at, another."""
    rows = complete(tracks)
    if start is not None:
        rows = rows.where((F.col("started_at") >= F.to_timestamp(F.lit(start))) & (F.col("started_at") < F.to_timestamp(F.lit(until))))
    peak = F.min(F.when(F.col("max_speed_mps").isNotNull(), F.struct((-F.col("max_speed_mps")).alias("below"), "track_id", "max_speed_confidence")))
    sums = rows.agg(
        F.count(F.lit(1)).alias("track_count"),
        _total("distance_m"),
        _total("moving_s"),
        _total("elevation_gain_m"),
        peak.alias("_peak"),
        *[F.max(c).alias(name) for c, name in (("best_1km_speed_mps", "best_1km_speed_mps"), ("best_5km_speed_mps", "best_5km_speed_mps"), ("distance_m", "longest_distance_m"), ("elevation_gain_m", "highest_elevation_gain_m"), ("moving_s", "longest_moving_s"))],
        F.avg("quality_score").alias("quality_score"),
    )
    return sums.withColumns({"avg_speed_mps": F.when(F.col("moving_s") > 0, F.col("distance_m") / F.col("moving_s")), "max_speed_mps": -F.col("_peak.below"), "max_speed_confidence": F.col("_peak.max_speed_confidence")}).drop("_peak")


def share_activity(tracks: DataFrame) -> DataFrame:
    """Dated complete tracks with their distances, oldest first."""
    return complete(tracks).where("started_at IS NOT NULL").select("track_id", "started_at", F.coalesce("distance_m", F.lit(0.0)).alias("distance_m")).orderBy("started_at", "track_id")


def heatmap(cells: DataFrame, limit: int = C.HEATMAP_LIMIT, by_cell: bool = False) -> DataFrame:
    """The most visited cells.  Cells of different mean position count apart unless ``by_cell``."""
    sums = [F.sum("point_count").alias("weight"), F.count("track_id").alias("visits")]
    if by_cell:
        rows = cells.groupBy("cell").agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), *sums)
    else:
        rows = cells.groupBy("cell", "latitude", "longitude").agg(*sums)
    return rows.orderBy(F.desc("weight"), "cell", "latitude", "longitude").limit(limit)


def explore_insights(heat: DataFrame) -> DataFrame:
    """Over heat map rows: how many cells, how many visited again, and the most visits."""
    return heat.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("visits") > 1).alias("revisited"), F.max("visits").alias("most_visits"))


def longest_tracks(tracks: DataFrame, n: int = 12) -> DataFrame:
    return complete(tracks).where("distance_m IS NOT NULL").orderBy(F.desc("distance_m"), "track_id").limit(n)


def in_range(tracks: DataFrame, span: str, as_of: str) -> DataFrame:
    """Complete, dated tracks of the last 90 days, 12 months or all time."""
    rows = complete(tracks).where("started_at IS NOT NULL")
    days = {"90d": 90, "12m": 365}.get(span)
    return rows if days is None else rows.where(F.col("started_at") >= F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(F.lit(days)))


def speed_history(tracks: DataFrame, metric: str = "1km", span: str = "all", as_of: str = "1970-01-01") -> DataFrame:
    """``track_id, started_at, metric_mps, rolling_median_mps, record_mps``, in order of time.

    The median is over the last 15 tracks' known values; the record is the best so far.  The order is global, but
    blocks of it are dealt out.
    """
    column = METRICS.get(metric, METRICS["1km"])
    rows = numbered(in_range(tracks, span, as_of).select("track_id", "started_at", F.col(column).alias("metric_mps")), "started_at", "track_id")
    blocks = in_blocks(rows, C.ROLLING_ROWS - 1)
    frame = Window.partitionBy("_block").orderBy("_n").rowsBetween(-(C.ROLLING_ROWS - 1), 0)
    medians = blocks.withColumn("rolling_median_mps", framed_median("metric_mps", frame)).where(~F.col("_context")).drop("_block", "_context")
    return running_max(medians, "metric_mps", "record_mps").drop("_n")


def records(tracks: DataFrame) -> DataFrame:
    """The best track by each metric over all time, the earliest on ties."""
    rows = complete(tracks).where("started_at IS NOT NULL")
    best = [F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("below"), "started_at", "track_id"))).alias(name) for name, c in METRICS.items()]
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name).alias("b")) for name in METRICS])).alias("e")
    return rows.agg(*best).select(each).where("e.b IS NOT NULL").select("e.metric", "e.b.track_id", "e.b.started_at", (-F.col("e.b.below")).alias("speed_mps"))


def leaders(tracks: DataFrame, metric: str = "1km", span: str = "all", as_of: str = "1970-01-01", n: int = C.LEADERS) -> DataFrame:
    column = METRICS.get(metric, METRICS["1km"])
    return in_range(tracks, span, as_of).where(F.col(column).isNotNull()).orderBy(F.desc(column), "started_at", "track_id").limit(n).select("track_id", "started_at", F.col(column).alias("speed_mps"))


def recent_delta(tracks: DataFrame, metric: str = "1km") -> DataFrame:
    """The median of the last 15 known values against that of the 15 before."""
    column = METRICS.get(metric, METRICS["1km"])
    newest = [F.desc("started_at"), F.desc("track_id")]
    last = complete(tracks).where(F.col("started_at").isNotNull() & F.col(column).isNotNull()).orderBy(*newest).limit(2 * C.DELTA_ROWS)
    rows = last.withColumn("r", F.row_number().over(Window.orderBy(*newest)))
    sums = rows.agg(F.median(F.when(F.col("r") <= C.DELTA_ROWS, F.col(column))).alias("recent_mps"), F.median(F.when(F.col("r") > C.DELTA_ROWS, F.col(column))).alias("previous_mps"))
    return sums.withColumn("delta_percent", percent_delta(F.col("recent_mps"), F.col("previous_mps")))


def stale_analyses(tracks: DataFrame, version: int = C.ANALYSIS_VERSION) -> DataFrame:
    """Analysed tracks of an earlier version."""
    return tracks.where(F.col("status").isin("complete", "insufficient_data") & (F.col("analysis_version") < version))


def interesting_splits(splits: DataFrame) -> DataFrame:
    """Per track its best efforts by distance, then its five fastest kilometres."""
    efforts = splits.where(F.col("kind") == "best_effort").withColumn("rank", F.row_number().over(Window.partitionBy("track_id").orderBy("position")))
    quick = splits.where((F.col("kind") == "kilometer") & F.col("avg_speed_mps").isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("avg_speed_mps"), "position"))).where("rank <= 5")
    return efforts.unionByName(quick)


def route_history(attempts: DataFrame) -> DataFrame:
    """Attempts in display units, with the fastest of each route marked."""
    w = Window.partitionBy("cluster_id").orderBy(F.desc_nulls_last("avg_speed_mps"), "started_at", "track_id")
    return attempts.select("cluster_id", "track_id", "started_at", F.round(F.col("avg_speed_mps") * 3.6, 2).alias("speed_kmh"), F.round(F.col("distance_m") / 1000, 2).alias("distance_km"), (F.row_number().over(w) == 1).alias("fastest"))


def speed_chart(history: DataFrame) -> DataFrame:
    kmh = lambda c: F.round(F.col(c) * 3.6, 2)
    return history.select("track_id", "started_at", kmh("metric_mps").alias("speed_kmh"), kmh("rolling_median_mps").alias("median_kmh"), kmh("record_mps").alias("record_kmh"))


def recap_period(kind: str, as_of: str) -> tuple[Column, Column]:
    """From and until of the week (from Monday), month or year of a date."""
    if kind not in ("week", "month", "year"):
        raise ValueError(f"unknown period {kind!r}")
    start = F.date_trunc(kind, F.to_timestamp(F.lit(as_of)))
    return start, start + F.expr({"week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}[kind])


def period_days_ok(kind: str, days: float) -> bool:
    """Whether a window's length fits its kind, clock changes allowed for."""
    low, high = {"week": (6, 8), "month": (27, 32), "year": (364, 367)}[kind]
    return low <= days <= high


def recap_rhythm(tracks: DataFrame, kind: str, as_of: str) -> DataFrame:
    """Distance by day of the week or month, or by month of the year, empty buckets with 0: ``bucket, distance_m``."""
    start, until = recap_period(kind, as_of)
    unit, step = ("month", "INTERVAL 1 MONTH") if kind == "year" else ("day", "INTERVAL 1 DAY")
    calendar = tracks.sparkSession.range(1).select(F.explode(F.sequence(start.cast("date"), F.date_sub(until.cast("date"), 1), F.expr(step))).alias("bucket"))
    inside = complete(tracks).where((F.col("started_at") >= start) & (F.col("started_at") < until))
    sums = inside.groupBy(F.date_trunc(unit, "started_at").cast("date").alias("bucket")).agg(F.sum("distance_m").alias("distance_m"))
    return calendar.join(sums, "bucket", "left").fillna(0.0)


def all_time_rhythm(tracks: DataFrame) -> DataFrame:
    """Distance by month if all lie within 24 months, else by year, empty buckets with 0."""
    dated = complete(tracks).where("started_at IS NOT NULL")
    months = dated.groupBy(F.date_trunc("month", "started_at").cast("date").alias("m")).agg(F.coalesce(F.sum("distance_m"), F.lit(0.0)).alias("d"))
    span = months.agg(F.min("m").alias("a"), F.max("m").alias("b")).where("a IS NOT NULL").withColumn("short", F.months_between("b", "a") < 24)
    unit = lambda c: F.when(F.col("short"), F.col(c)).otherwise(F.trunc(F.col(c), "year"))
    calendar = span.select(F.explode(F.when(F.col("short"), F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).otherwise(F.sequence(F.trunc("a", "year"), F.trunc("b", "year"), F.expr("INTERVAL 1 YEAR")))).alias("bucket"))
    sums = months.crossJoin(span.select("short")).groupBy(unit("m").alias("bucket")).agg(F.sum("d").alias("distance_m"))  # span has one row
    return calendar.join(sums, "bucket", "left").fillna(0.0)


def focus_window(series: DataFrame, at_km: float, reach_km: float = 0.1) -> DataFrame:
    """Per track the samples within a reach of a distance, with the nearest sample and its neighbours at least."""
    w = Window.partitionBy("track_id")
    nearest = F.min(F.struct(F.abs(F.col("distance_km") - at_km).alias("off"), "i")).over(w)["i"]
    rows = series.withColumn("nearest", nearest)
    return rows.where((F.abs(F.col("distance_km") - at_km) <= reach_km) | (F.abs(F.col("i") - F.col("nearest")) <= 1))
