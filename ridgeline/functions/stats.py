"""Order statistics.  There are four definitions; results depend on which one is taken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MAD_SCALE, TREND_FLOOR


def midpoint_median(x) -> Column:
    """Aggregate: the mean of the two middle values."""
    return F.median(x)


def nearest_rank(x: str, share: float) -> Column:
    """Aggregate over a column by name: the value of rank ceil(n * share)."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {x})")


def upper_median(values: Column) -> Column:
    """Of an array: the sorted value at index n div 2; null if it has none."""
    held = F.array_sort(F.array_compact(values))
    return F.when(F.size(held) > 0, F.element_at(held, (F.floor(F.size(held) / 2) + 1).cast("int")))


def array_median(values: Column) -> Column:
    """Of a bounded array: the mean of the two middle values, nulls left out; null if none is left."""
    held = F.array_sort(F.array_compact(values))
    n = F.size(held)
    low, high = F.floor((n + 1) / 2).cast("int"), (F.floor(n / 2) + 1).cast("int")
    return F.when(n > 0, (F.element_at(held, low) + F.element_at(held, high)) / 2)


def framed_median(x, window) -> Column:
    """The midpoint median over a bounded window frame."""
    return array_median(F.collect_list(x).over(window))


def mad(values: Column) -> Column:
    """Median absolute deviation of a bounded array."""
    middle = array_median(values)
    return array_median(F.transform(values, lambda v: F.abs(v - middle)))


def noise_floor(values: Column) -> Column:
    """The share of the median below which a change is noise: two hundredths at least."""
    middle = array_median(values)
    return F.when(middle > 0, F.greatest(F.lit(TREND_FLOOR), MAD_SCALE * mad(values) / middle)).otherwise(F.lit(TREND_FLOOR))


def percent_delta(value: Column, base: Column) -> Column:
    """Change in per cent; null unless both are known and the base is above zero."""
    return F.when(base > 0, (value - base) / base * 100)
