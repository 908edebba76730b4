"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

_SPAN = ("track_id", "start_ms", "end_ms", "dt_ms", "h0", "h1", "d0", "d1", "speed", "hr_ok", "moving")
_MEASURES = ("duration_s", "covered_s", "average_bpm", "maximum_bpm", "change_bpm", "distance_m", "speed_kmh")


class IntervalSelection:
    """``interval_selection(TABLE(spans), from_s, until_s)``: the measures of ``heart_rate.selection``, a row for each track.

    The table is dealt out by track and read in order of time; a track's measures are running sums.  ``track_id`` has
    the type that the table gives it.
    """

    def __init__(self):
        self.track, self.covered_ms, self.area, self.distance, self.moving_ms, self.way = None, 0.0, 0.0, 0.0, 0.0, 0.0
        self.first = self.last = self.highest = None
        self.seen = False

    @staticmethod
    def analyze(spans: AnalyzeArgument, from_s: AnalyzeArgument, until_s: AnalyzeArgument) -> AnalyzeResult:
        if not spans.isTable:
            raise ValueError("the first argument is a table of spans: interval_selection(TABLE(spans), from_s, until_s)")
        kinds = {f.name: f.dataType for f in spans.dataType.fields}
        missing = [c for c in _SPAN if c not in kinds]
        if missing:
            raise ValueError(f"the table of spans lacks {', '.join(missing)}")
        if from_s.value is None or until_s.value is None or not 0 <= from_s.value < until_s.value:
            raise ValueError("a selection needs 0 <= from < until")
        schema = StructType().add("track_id", kinds["track_id"])
        for name in _MEASURES:
            schema = schema.add(name, DoubleType())
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("track_id")], orderBy=[OrderingColumn("start_ms")])

    def eval(self, span: Row, from_s: float, until_s: float) -> None:
        low, high = float(from_s) * 1000, float(until_s) * 1000
        self.duration = float(until_s) - float(from_s)
        start, end = max(span.start_ms, low), min(span.end_ms, high)
        if not (span.end_ms > low and span.start_ms < high):
            return
        self.seen, self.track = True, span.track_id
        f0, f1 = (start - span.start_ms) / span.dt_ms, (end - span.start_ms) / span.dt_ms
        way = (span.d1 - span.d0) * f1 - (span.d1 - span.d0) * f0
        self.distance += max(way, 0.0)
        if span.hr_ok:
            h0, h1 = span.h0 + (span.h1 - span.h0) * f0, span.h0 + (span.h1 - span.h0) * f1
            self.covered_ms += end - start
            self.area += (h0 + h1) / 2 * (end - start) / 1000
            self.highest = max(x for x in (self.highest, h0, h1) if x is not None)
            self.first = h0 if self.first is None else self.first
            self.last = h1
        if span.moving:
            self.moving_ms += end - start
            self.way += (span.speed or 0.0) * (end - start)

    def terminate(self) -> Iterator[tuple]:
        if self.seen:
            average = self.area / (self.covered_ms / 1000) if self.covered_ms > 0 else None
            change = self.last - self.first if self.first is not None else None
            yield self.track, self.duration, self.covered_ms / 1000, average, self.highest, change, self.distance, self.way / self.moving_ms * 3.6 if self.moving_ms > 0 else None


def register(spark: SparkSession) -> None:
    """Make interval_selection callable from SQL in this session."""
    spark.udtf.register("interval_selection", udtf(IntervalSelection))
