"""Scalar rules: parsing, plausibility, labels.  Null always means unknown, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

_NUMBER = r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"


def parse_number(text: Column) -> Column:
    """A number if the whole trimmed text is one, else null."""
    own = F.trim(text)
    return F.when(own.rlike(_NUMBER), own.try_cast("double"))


def parse_instant(text: Column) -> Column:
    """An ISO 8601 instant with its zone, else null."""
    own = F.trim(text)
    return F.when(own.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:?\d\d)$"), own.try_cast("timestamp"))


def within(x: Column, bounds: tuple[float, float]) -> Column:
    return F.when(x.between(*bounds), x.cast("double"))


def normal_heart_rate(x: Column) -> Column:
    return within(x, C.HR_RANGE)


def normal_cadence(x: Column) -> Column:
    return within(x, C.CADENCE_RANGE)


def normal_speed(x: Column) -> Column:
    return within(x, C.SPEED_RANGE_MPS)


def normal_odometer(x: Column) -> Column:
    return F.when((x >= 0) & (x < C.ODOMETER_LIMIT_M), x.cast("double"))


def activity_id(text: Column) -> Column:
    """Lower-case words joined by underscores; null if nothing is left."""
    plain = F.trim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(plain != "", plain)


def seconds_between(a: Column, b: Column) -> Column:
    """Whole milliseconds between two instants, in seconds."""
    return (F.unix_millis(b) - F.unix_millis(a)) / F.lit(1000.0)


def duration_between(a: Column, b: Column) -> Column:
    d = seconds_between(a, b)
    return F.when(d >= 0, d)


def plausible_step(speed: Column) -> Column:
    """A step whose speed is unknown can't be judged and is kept."""
    return F.coalesce(speed <= C.MAX_PLAUSIBLE_MPS, F.lit(True))


def plausible_reading(speed: Column) -> Column:
    return F.coalesce(speed <= C.MAX_PLAUSIBLE_MPS, F.lit(False))


def gps_speed() -> Column:
    """Speed of an accepted fix: between fixes, else as recorded."""
    return F.when(F.col("valid"), F.coalesce("derived_speed_mps", "recorded_speed_mps"))


def effective_speed() -> Column:
    """A plausible sensor reading, else the fix's speed."""
    return F.coalesce(F.when(plausible_reading(F.col("sensor_speed_mps")), F.col("sensor_speed_mps")), gps_speed())


def loop_score(displacement: Column, distance: Column) -> Column:
    return F.when(distance > 0, F.greatest(F.lit(0.0), 1 - F.least(displacement / distance, F.lit(1.0)))).otherwise(0.0)


def sinuosity(displacement: Column, distance: Column) -> Column:
    return F.when(displacement > 50, distance / displacement)


def similarity_ratio(a: Column, b: Column) -> Column:
    """The smaller over the larger of two positive numbers, else 0."""
    return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b)).otherwise(0.0)


def skip_reason(points: Column, distance: Column, moving: Column) -> Column:
    """Why a track is too empty to count, or null."""
    d, m = F.coalesce(distance, F.lit(0.0)), F.coalesce(moving, F.lit(0.0))
    return (
        F.when(points < C.MIN_POINTS, F.concat(F.lit("only "), points.cast("string"), F.when(points == 1, " point").otherwise(" points")))
        .when(d < C.MIN_DISTANCE_M, F.concat(F.lit("only "), F.round(d).cast("bigint").cast("string"), F.lit(" m long")))
        .when(m < C.MIN_MOVING_S, F.concat(F.lit("only "), F.round(m).cast("bigint").cast("string"), F.lit(" s of movement")))
    )


def search_term(term: str) -> str:
    """A LIKE pattern that finds the term anywhere; wildcards in it are left out."""
    return "%" + term.replace("%", "").replace("_", "") + "%"


def calibration_hint(difference_percent: Column) -> Column:
    """What a wheel sensor's difference from GPS says about its wheel size."""
    d = difference_percent
    return F.when(F.abs(d) < 1, F.lit("agrees with GPS")).when(d > 0, F.format_string("reads %.1f %% long", d)).when(d < 0, F.format_string("reads %.1f %% short", -d))


def cluster_fingerprint(ids: Column) -> Column:
    return F.sha2(F.concat(F.lit("v1:"), F.array_join(F.array_sort(ids), ",")), 256)


def feature_fingerprint(samples: Column) -> Column:
    """SHA-256 of a route's samples, rounded to three decimals."""
    return F.sha2(F.array_join(F.transform(samples, lambda s: F.concat_ws(":", F.format_string("%.3f", s["lat"]), F.format_string("%.3f", s["lon"]))), ","), 256)


def month_key(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def week_key(at: Column) -> Column:
    return F.date_trunc("week", at).cast("date")


def local_date(at: Column, zone: Column | None = None) -> Column:
    return (at if zone is None else F.from_utc_timestamp(at, F.coalesce(zone, F.lit("UTC")))).cast("date")


def default_name(filename: Column) -> Column:
    """The file's base name without its extension, underscores as spaces."""
    return F.replace(F.regexp_replace(F.regexp_extract(filename, r"([^/]*)$", 1), r"\.[^.]*$", ""), F.lit("_"), F.lit(" "))


def gear_ratio(development: Column, wheel_m: float = 2.1) -> Column:
    """Metres a crank turn over metres a wheel turn."""
    return F.round(development / wheel_m, 2)
