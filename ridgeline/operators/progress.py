"""Progress on repeated routes and over the library: trends, sectors, weekly volume, streaks, effort, heart rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.stats import percent_delta
from .routes import by_recency, eligible


def direction(delta: Column, threshold: Column) -> Column:
    return F.when(delta.isNull(), "building").when(delta > threshold, "faster").when(delta < -threshold, "slower").otherwise("steady")


def trends(attempts: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Per route: the median of the last three attempts against the three before, or the last against the median of all earlier.

    ``attempts``: ``key, track_id, started_at, avg_speed_mps``; those without speed or date don't count.  A change
    within the noise floor of the route's speeds is steady.
    """
    held = attempts.where(F.col("avg_speed_mps").isNotNull() & F.col("started_at").isNotNull())
    whole = Window.partitionBy(key)
    rows = held.withColumns({"r": F.row_number().over(by_recency(key)), "n": F.count(F.lit(1)).over(whole), "m": F.median("avg_speed_mps").over(whole)})
    v = F.col("avg_speed_mps")
    sums = rows.groupBy(key).agg(
        F.max("n").alias("attempt_count"),
        F.max("m").alias("m"),
        F.median(F.abs(v - F.col("m"))).alias("mad"),
        F.median(F.when(F.col("r") <= 3, v)).alias("recent3"),
        F.median(F.when(F.col("r").between(4, 6), v)).alias("prior3"),
        F.max(F.when(F.col("r") == 1, v)).alias("last"),
        F.median(F.when(F.col("r") > 1, v)).alias("earlier"),
    )
    n = F.col("attempt_count")
    floor = F.when(F.col("m") > 0, F.greatest(F.lit(C.TREND_FLOOR), C.MAD_SCALE * F.col("mad") / F.col("m"))).otherwise(C.TREND_FLOOR)
    rows = sums.select(
        key,
        "attempt_count",
        F.when(n >= 6, F.col("recent3")).when(n >= 2, F.col("last")).alias("recent_speed_mps"),
        F.when(n >= 6, F.col("prior3")).when(n >= 2, F.col("earlier")).alias("baseline_speed_mps"),
        (floor * 100).alias("noise_floor_percent"),
        F.when(n >= 6, "recent 3 vs prior 3").when(n >= 2, "latest vs earlier attempts").otherwise("more attempts needed").alias("signal"),
    )
    rows = rows.withColumn("delta_percent", percent_delta(F.col("recent_speed_mps"), F.col("baseline_speed_mps")))
    return rows.withColumn("direction", direction(F.col("delta_percent"), F.col("noise_floor_percent")))


def sector_speeds(series: DataFrame, *keys: str, sectors: int = 10) -> DataFrame:
    """``*keys, number, speed_mps`` of equal parts of a route.

    ``series``: ``*keys, i, distance_km, speed_kmh, ms``.  A part takes from the first sample at or past its start
    to the first at or past its end; where a time is missing, the mean of the speeds inside counts.  Each sample
    yields the bounds that it is first to reach.
    """
    w = Window.partitionBy(*keys).orderBy("i")
    held = series.where("distance_km IS NOT NULL").withColumn("total", F.max("distance_km").over(Window.partitionBy(*keys)))
    most = F.max("distance_km").over(w.rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("_before", most)
    bounds = F.filter(F.sequence(F.lit(0), F.lit(sectors)), lambda k: (F.col("distance_km") >= F.col("total") * k / sectors) & (F.col("_before").isNull() | (F.col("_before") < F.col("total") * k / sectors)))
    reached = held.select(*keys, "total", "ms", F.explode(bounds).alias("k"))
    by_k = Window.partitionBy(*keys).orderBy("k")
    timed = reached.select(*keys, F.col("k").alias("number"), ((F.col("ms") - F.lag("ms").over(by_k)) / 1000.0).alias("s"), (F.col("total") * F.col("k") / sectors - F.col("total") * (F.col("k") - 1) / sectors).alias("km")).where("number >= 1")
    inside = F.filter(F.sequence(F.lit(1), F.lit(sectors)), lambda k: (F.col("distance_km") >= F.col("total") * (k - 1) / sectors) & (F.col("distance_km") <= F.col("total") * k / sectors))
    means = held.where("speed_kmh IS NOT NULL").select(*keys, "speed_kmh", F.explode(inside).alias("number")).groupBy(*keys, "number").agg((F.avg("speed_kmh") / 3.6).alias("mean"))
    rows = timed.join(means, [*keys, "number"], "left")
    return rows.select(*keys, "number", F.when(F.col("s") > 0, F.col("km") * 1000 / F.col("s")).otherwise(F.col("mean")).alias("speed_mps"))


def sector_comparison(attempts: DataFrame, speeds: DataFrame, key: str = "cluster_id") -> DataFrame:
    """The latest attempt's parts against the median of up to five before.  ``attempts``: ``key, track_id, started_at``; ``speeds``: ``track_id, number, speed_mps``."""
    ranked = attempts.where("started_at IS NOT NULL").withColumn("r", F.row_number().over(by_recency(key))).where("r <= 6")
    rows = ranked.select(key, "track_id", "r").join(speeds, "track_id").groupBy(key, "number").agg(F.max(F.when(F.col("r") == 1, F.col("speed_mps"))).alias("latest_speed_mps"), F.median(F.when(F.col("r") > 1, F.col("speed_mps"))).alias("baseline_speed_mps"))
    rows = rows.withColumn("delta_percent", percent_delta(F.col("latest_speed_mps"), F.col("baseline_speed_mps")))
    return rows.withColumn("direction", direction(F.col("delta_percent"), F.lit(2.0)))


def cluster_summaries(clusters: DataFrame, route_trends: DataFrame, activity: str | None = None, trend: str | None = None, least_attempts: int = 2) -> DataFrame:
    """Routes with their trends, most attempts first, then by name."""
    rows = clusters.join(route_trends.drop("attempt_count"), "cluster_id", "left").where(F.col("track_count") >= least_attempts)
    rows = rows if activity is None else rows.where(F.col("activity_type") == activity)
    rows = rows if trend is None else rows.where(F.col("direction") == trend)
    return rows.orderBy(F.desc("track_count"), "name", "cluster_id")


def cluster_details(clusters: DataFrame, memberships: DataFrame, tracks: DataFrame, cluster_id: int | None = None) -> DataFrame:
    """One row per attempt of a route (of all, without ``cluster_id``): the route's columns, then ``track_id, started_at, similarity, representative, avg_speed_mps, first_attempt_at, latest_attempt_at``.

    ``memberships``: ``cluster_id, track_id, similarity, representative``.
    """
    clusters = clusters if cluster_id is None else clusters.where(F.col("cluster_id") == cluster_id)
    rows = clusters.join(memberships.select("cluster_id", "track_id", "similarity", "representative"), "cluster_id").join(tracks.select("track_id", "started_at", "avg_speed_mps"), "track_id")
    whole = Window.partitionBy("cluster_id")
    return rows.withColumns({"first_attempt_at": F.min("started_at").over(whole), "latest_attempt_at": F.max("started_at").over(whole)})


def cluster_of_track(clusters: DataFrame, memberships: DataFrame, tracks: DataFrame, track_id: int) -> DataFrame:
    """The details of the route that a track belongs to; no rows if it is in none."""
    own = memberships.where(F.col("track_id") == track_id).select("cluster_id")
    return cluster_details(clusters.join(own, "cluster_id", "left_semi"), memberships, tracks)


def weekly_volume(tracks: DataFrame, as_of: str, weeks: int = 12) -> DataFrame:
    """The last weeks to the date ``as_of``, from Monday, empty ones with zeros: ``week, distance_m, moving_s, track_count``."""
    last = F.date_trunc("week", F.to_date(F.lit(as_of))).cast("date")
    first = F.date_sub(last, 7 * (weeks - 1))
    calendar = tracks.sparkSession.range(1).select(F.explode(F.sequence(first, last, F.expr("INTERVAL 7 DAYS"))).alias("week"))
    recent = tracks.where((F.col("started_at") >= first.cast("timestamp")) & (F.col("started_at") < F.date_add(last, 7).cast("timestamp")))
    sums = recent.groupBy(F.date_trunc("week", "started_at").cast("date").alias("week")).agg(F.coalesce(F.sum("distance_m"), F.lit(0.0)).alias("distance_m"), F.coalesce(F.sum("moving_s"), F.lit(0.0)).alias("moving_s"), F.count(F.lit(1)).alias("track_count"))
    return calendar.join(sums, "week", "left").fillna(0)


def volume_delta(volume: DataFrame) -> DataFrame:
    """The last four weeks' distance against the four before; ``volume`` has a dozen rows."""
    rank = F.row_number().over(Window.orderBy(F.desc("week")))
    sums = volume.withColumn("r", rank).agg(F.sum(F.when(F.col("r") <= 4, F.col("distance_m"))).alias("recent_m"), F.sum(F.when(F.col("r").between(5, 8), F.col("distance_m"))).alias("prior_m"))
    return sums.withColumn("delta_percent", percent_delta(F.col("recent_m"), F.col("prior_m")))


def effort_trends(tracks: DataFrame, columns: dict[str, str]) -> DataFrame:
    """For each label and column: the median of the last five known values against that of the five before, and the record."""
    found = None
    for label, column in columns.items():
        known = tracks.where(F.col(column).isNotNull() & F.col("started_at").isNotNull())
        last = known.orderBy(F.desc("started_at"), F.desc("track_id")).limit(10).select(F.row_number().over(Window.orderBy(F.desc("started_at"), F.desc("track_id"))).alias("r"), F.col(column).alias("v"))
        recent = last.agg(F.median(F.when(F.col("r") <= 5, F.col("v"))).alias("recent_speed_mps"), F.median(F.when(F.col("r") > 5, F.col("v"))).alias("prior"))
        record = known.agg(F.max(column).alias("record_speed_mps"))
        row = recent.crossJoin(record).select(F.lit(label).alias("label"), "recent_speed_mps", percent_delta(F.col("recent_speed_mps"), F.col("prior")).alias("delta_percent"), "record_speed_mps")  # one row each
        found = row if found is None else found.unionByName(row)
    return found


def weekly_streak(tracks: DataFrame) -> DataFrame:
    """How many weeks in a row, up to the latest one with a track, have one: ``latest_week, weeks``.  Weeks are distinct first, so few rows meet."""
    weeks = tracks.where("started_at IS NOT NULL").select(F.date_trunc("week", "started_at").cast("date").alias("week")).distinct()
    rank = F.row_number().over(Window.orderBy(F.desc("week")))
    numbered = weeks.withColumn("r", rank).withColumn("latest", F.max("week").over(Window.partitionBy()))
    unbroken = F.datediff("latest", "week") == (F.col("r") - 1) * 7
    return numbered.agg(F.max("latest").alias("latest_week"), F.count_if(unbroken).alias("weeks"))


def staleness(built: DataFrame, current_count: int, as_of: str) -> DataFrame:
    """``missing``, ``stale`` or ``ready`` of a build record ``eligible_count, matcher_version, built_at`` (one row or none)."""
    row = built.agg(F.max("eligible_count").alias("n"), F.max("matcher_version").alias("v"), F.max("built_at").alias("at"))
    old = F.unix_seconds(F.to_timestamp(F.lit(as_of))) - F.unix_seconds("at") >= 86_400
    return row.select(F.when(F.col("at").isNull(), "missing").when((F.col("n") != current_count) | (F.col("v") != C.MATCHER_VERSION) | old, "stale").otherwise("ready").alias("status"))


def usable_sectors(sectors: DataFrame, alignments: DataFrame) -> DataFrame:
    """Sectors fit for comparison, nine tenths eligible, at their place on the representative's route.  ``alignments``: ``track_id, alignment``."""
    fits = (F.col("moving_s") > 0) & (F.col("eligible_s") / F.col("moving_s") >= 0.9) & F.col("average_bpm").isNotNull() & F.col("speed_kmh").isNotNull()
    return sectors.where(fits).join(alignments, "track_id").withColumn("index", F.pmod(F.col("index") - F.col("alignment"), F.lit(C.SECTORS))).drop("alignment")


def heart_rate_attempts(clusters: DataFrame, memberships: DataFrame, tracks: DataFrame, summaries: DataFrame, sectors: DataFrame, alignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``cluster_id, track_id, started_at`` of the attempts whose heart rates can be compared, and their usable sectors.

    An attempt counts if nine tenths of it have heart rates (``summaries``: ``track_id, coverage_percent``), its
    activity is known and that of the route's representative, it is eligible and matches the representative
    (``alignments``: ``cluster_id, track_id, alignment`` of those that do), and a sector of it is usable.
    """
    activity = F.col("activity_type")
    leads = clusters.select("cluster_id", F.col("representative_id").alias("track_id")).join(tracks.select("track_id", activity.alias("_own")), "track_id").drop("track_id")
    held = eligible(tracks).where(activity.isNotNull()).select("track_id", "started_at", "activity_type").join(memberships.select("cluster_id", "track_id"), "track_id").join(leads, "cluster_id").where(activity == F.col("_own"))
    covered = summaries.where(F.col("coverage_percent") >= 90).select("track_id")
    held = held.join(covered, "track_id", "left_semi").join(alignments.select("cluster_id", "track_id", "alignment"), ["cluster_id", "track_id"])
    usable = usable_sectors(sectors, held.select("track_id", "alignment"))
    return held.select("cluster_id", "track_id", "started_at").join(usable.select("track_id").distinct(), "track_id", "left_semi"), usable


def routes_with_heart_rate(clusters: DataFrame, memberships: DataFrame, summaries: DataFrame, attempts: DataFrame) -> DataFrame:
    """Routes with an attempt that has heart rates, most attempts first: ``cluster_id, name, track_count, recorded_count, eligible_count``.  ``summaries``: ``track_id, sample_count``."""
    recorded = memberships.join(summaries.where("sample_count > 0").select("track_id"), "track_id", "left_semi").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("recorded_count"))
    fit = attempts.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("eligible_count"))
    rows = clusters.join(recorded, "cluster_id").join(fit, "cluster_id", "left").fillna(0, ["eligible_count"])
    return rows.select("cluster_id", "name", "track_count", "recorded_count", "eligible_count").orderBy(F.desc("track_count"), "cluster_id")


def _observed(attempts: DataFrame, sectors: DataFrame, key: str, last: int) -> DataFrame:
    """Medians over the sectors that all of a route's last attempts share: one row per attempt, ``r`` 1 being the latest."""
    ranked = attempts.withColumns({"r": F.row_number().over(by_recency(key)), "n": F.count(F.lit(1)).over(Window.partitionBy(key))}).where((F.col("r") <= last) & (F.col("n") >= last))
    rows = ranked.select(key, "track_id", "started_at", "r").join(sectors, "track_id").withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(key, "index"))).where(F.col("_all") == last)
    return rows.groupBy(key, "track_id", "started_at", "r").agg(F.median("average_bpm").alias("bpm"), F.median("speed_kmh").alias("speed"), F.sum("eligible_s").alias("support_s"), F.count(F.lit(1)).alias("sector_count"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))


def effort_label(hr_delta: Column, speed_delta: Column, hr_noise: Column, speed_noise: Column) -> Column:
    """What a change of heart rate and speed says; a change within the noise says nothing."""
    even, calm = F.abs(speed_delta) <= 5, F.abs(hr_delta) <= 5
    return (
        F.when(even & (hr_delta < -hr_noise), "Lower HR at similar speed")
        .when(even & (hr_delta > hr_noise), "Higher HR at similar speed")
        .when(calm & (speed_delta > speed_noise), "Faster at similar HR")
        .when(calm & (speed_delta < -speed_noise), "Slower at similar HR")
        .when(even | calm, "No clear change")
        .otherwise("Different effort — not comparable")
    )


def _changes(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"hr_delta": F.col("after_bpm") - F.col("before_bpm"), "speed_delta": (F.col("after_speed") - F.col("before_speed")) / F.col("before_speed") * 100})
    return rows.withColumn("label", effort_label(F.col("hr_delta"), F.col("speed_delta"), F.col("hr_noise"), F.col("speed_noise")))


def effort_pairs(attempts: DataFrame, sectors: DataFrame, key: str = "cluster_id") -> DataFrame:
    """The last two attempts of each route over their shared sectors, three minutes or more of them; routes without have no row."""
    rows = _observed(attempts, sectors, key, 2)
    of = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    pairs = rows.groupBy(key).agg(of(2, "track_id").alias("before_id"), of(1, "track_id").alias("after_id"), *[of(r, c).alias(f"{p}_{c}") for r, p in ((2, "before"), (1, "after")) for c in ("bpm", "speed")], F.min("support_s").alias("support_s"), F.max("sector_count").alias("sector_count"), F.min("speed").alias("_least"), F.count(F.lit(1)).alias("_n"))
    fits = pairs.where((F.col("_n") == 2) & (F.col("support_s") >= 180) & (F.col("_least") > 0)).drop("_n", "_least")
    return _changes(fits.withColumns({"hr_noise": F.lit(5.0), "speed_noise": F.lit(2.0)}))


def effort_trends_by_route(attempts: DataFrame, sectors: DataFrame, key: str = "cluster_id") -> DataFrame:
    """The last six attempts of each route, three against three, if they span 14 days; noise is twice their deviation at least."""
    rows = _observed(attempts, sectors, key, 6).withColumn("half", F.when(F.col("r") <= 3, "after").otherwise("before"))
    whole = Window.partitionBy(key, "half")
    rows = rows.withColumns({"_mb": F.median("bpm").over(whole), "_ms": F.median("speed").over(whole)})
    halves = rows.groupBy(key, "half").agg(F.max("_mb").alias("bpm"), F.max("_ms").alias("speed"), F.median(F.abs(F.col("bpm") - F.col("_mb"))).alias("mad_bpm"), F.median(F.abs(F.col("speed") - F.col("_ms"))).alias("mad_speed"), F.min("support_s").alias("support_s"), F.min("speed").alias("least"), F.min("started_at").alias("from_at"), F.max("started_at").alias("to_at"), F.count(F.lit(1)).alias("n"), F.max("sector_count").alias("sector_count"))
    of = lambda h, c: F.max(F.when(F.col("half") == h, F.col(c)))
    both = halves.groupBy(key).agg(*[of(h, c).alias(f"{h}_{c}") for h in ("before", "after") for c in ("bpm", "speed")], F.max("mad_bpm").alias("_mad_bpm"), F.max("mad_speed").alias("_mad_speed"), F.min("support_s").alias("support_s"), F.min("least").alias("_least"), F.min("from_at").alias("_from"), F.max("to_at").alias("_to"), F.sum("n").alias("_n"), F.max("sector_count").alias("sector_count"))
    fits = both.where((F.col("_n") == 6) & (F.col("support_s") >= 180) & (F.col("_least") > 0) & (F.unix_seconds("_to") - F.unix_seconds("_from") >= 14 * 86_400))
    noise = {"hr_noise": F.greatest(F.lit(5.0), 2 * F.col("_mad_bpm")), "speed_noise": F.greatest(F.lit(2.0), 200 * F.col("_mad_speed") / F.col("before_speed"))}
    return _changes(fits.withColumns(noise)).drop("_mad_bpm", "_mad_speed", "_least", "_from", "_to", "_n")
