"""Values as people read them; a missing one is a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for a missing value, and a status that reads differently.
MISSING, NO_TIME, NO_DATE = "—", "No timestamp", "Undated"
LABELS = {"insufficient_data": "Needs data"}


def _number(value: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", F.round(value.cast("double"), decimals))


def _or_dash(value: Column, text: Column) -> Column:
    return F.when(value.isNull(), MISSING).otherwise(text)


def _with_unit(value: Column, decimals: int, unit: str) -> Column:
    return _or_dash(value, F.concat(_number(value, decimals), F.lit(unit)))


def distance(m: Column) -> Column:
    return F.when(m >= 1000, _with_unit(m / 1000, 1, " km")).otherwise(_with_unit(m, 0, " m"))


def elevation(m: Column) -> Column:
    return _with_unit(m, 0, " m")


def speed(mps: Column) -> Column:
    return _with_unit(mps * 3.6, 1, " km/h")


def bpm(value: Column) -> Column:
    return _with_unit(value, 0, " bpm")


def rpm(value: Column) -> Column:
    return _with_unit(value, 0, " rpm")


def percent(value: Column) -> Column:
    return _with_unit(value, 0, "%")


def percent_change(value: Column) -> Column:
    """With its sign; what would read as nothing is 0%."""
    signed = F.concat(F.when(value > 0, "+").otherwise("−"), _number(F.abs(value), 1), F.lit("%"))
    return _or_dash(value, F.when(F.abs(value) < 0.05, "0%").otherwise(signed))


def compact_number(value: Column) -> Column:
    return F.when(value >= 1_000_000, _with_unit(value / 1_000_000, 1, "m")).when(value >= 1000, _with_unit(value / 1000, 1, "k")).otherwise(_with_unit(value, 0, ""))


def _whole_seconds(value: Column) -> Column:
    return F.greatest(F.round(value), F.lit(0)).cast("bigint")


def elapsed_time(seconds: Column) -> Column:
    """Minutes and seconds, 75:03."""
    s = _whole_seconds(seconds)
    return _or_dash(seconds, F.format_string("%d:%02d", (s / 60).cast("bigint"), s % 60))


def duration(seconds: Column) -> Column:
    """The largest two units: hours and minutes, else minutes, else seconds."""
    s = _whole_seconds(seconds)
    hours, minutes = (s / 3600).cast("bigint"), (s % 3600 / 60).cast("bigint")
    return _or_dash(seconds, F.when(hours > 0, F.format_string("%dh %02dm", hours, minutes)).when(s >= 60, F.format_string("%dm", minutes)).otherwise(F.format_string("%ds", s)))


def local_date(at: Column, zone: str | None = None) -> Column:
    """Date and time in a zone that Spark knows; as it is without one."""
    shown = at if zone is None else F.from_utc_timestamp(at, zone)
    return F.when(at.isNull(), NO_TIME).otherwise(F.date_format(shown, "MMM d, yyyy '·' h:mm a"))


def short_date(at: Column) -> Column:
    return F.when(at.isNull(), NO_DATE).otherwise(F.date_format(at, "MMM d, yyyy"))


def status_label(status: Column) -> Column:
    own = F.replace(status, F.lit("_"), F.lit(" "))
    text = F.concat(F.upper(F.substring(own, 1, 1)), F.lower(F.substring(own, 2, 1_000)))
    for value, label in LABELS.items():
        text = F.when(status == value, label).otherwise(text)
    return text
