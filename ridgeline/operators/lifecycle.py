"""Status of items from their events: legal steps move an item on, illegal ones go to quarantine with the reason."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# Where an item may go from each status ("" before its first event), and how far along it is.
STEPS = {
    "": ("queued",),
    "queued": ("parsing", "failed"),
    "parsing": ("analyzing", "failed"),
    "analyzing": ("indexing", "failed"),
    "indexing": ("complete", "insufficient_data", "failed"),
    "complete": ("queued",),
    "insufficient_data": ("queued",),
    "failed": ("queued",),
}
PROGRESS = {"queued": 0, "parsing": 12, "analyzing": 48, "indexing": 82, "complete": 100, "insufficient_data": 100, "failed": 100}


def _fold(columns: list[str], schema: pa.Schema):
    """Follows each item's events, which come in order; holds one item's status between batches."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, at = object(), ""
        for batch in batches:
            before, reasons = [], []
            for own, wanted in zip(batch.column(batch.schema.get_field_index("item_id")).to_pylist(), batch.column(batch.schema.get_field_index("status")).to_pylist(), strict=True):
                if own != item:
                    item, at = own, ""
                before.append(at or None)
                if wanted in STEPS.get(at, ()):
                    reasons.append(None)
                    at = wanted
                else:
                    reasons.append("no such status" if wanted not in PROGRESS else "already there" if wanted == at else f"not from {at}" if at else "not queued yet")
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(before, pa.string()), pa.array(reasons, pa.string())], schema=schema)

    return task


def steps(events: DataFrame) -> DataFrame:
    """The events (``item_id, happened_at, event_id, status, error``) with ``before``, the item's status then, and ``reason``, null where the step is legal.

    An item's events count in order of ``happened_at``, then ``event_id``.  An illegal one changes nothing.  Rows are dealt
    out by item and sorted by Spark; events without an item are left out.
    """
    rows = events.where("item_id is not null").repartition("item_id").sortWithinPartitions("item_id", "happened_at", "event_id")
    made = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, before string, reason string"
    schema = to_arrow_schema(rows.schema).append(pa.field("before", pa.string())).append(pa.field("reason", pa.string()))
    return rows.mapInArrow(_fold(rows.columns, schema), made)


def quarantined(followed: DataFrame) -> DataFrame:
    """The illegal steps of ``steps``."""
    return followed.where("reason is not null")


def states(followed: DataFrame) -> DataFrame:
    """Of each item ``status, progress, error, entered_at, n_steps, n_illegal``: where its legal steps have led; status null if there were none."""
    legal = F.col("reason").isNull()
    last = F.max(F.when(legal, F.struct("happened_at", "event_id", "status", "error")))
    rows = followed.groupBy("item_id").agg(last.alias("l"), F.count_if(legal).alias("n_steps"), F.count_if(~legal).alias("n_illegal"))
    progress = F.create_map(*[F.lit(x) for pair in PROGRESS.items() for x in pair])
    return rows.select("item_id", F.col("l.status").alias("status"), F.try_element_at(progress, F.col("l.status")).alias("progress"), F.when(F.col("l.status") == "failed", F.col("l.error")).alias("error"), F.col("l.happened_at").alias("entered_at"), "n_steps", "n_illegal")
