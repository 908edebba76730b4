"""Connected components by hooking and pointer jumping: union-find as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, component`` for every id of ``edges(a, b)``; the component is its smallest id.

    Each round, an id takes the smallest label among itself and its neighbours, then its label's own label
    (pointer jumping), so a chain of n edges takes about log n rounds.  The minima combine map-side, so a
    hub costs one row per task; each round's labels are written to the shared folder.  Loops are allowed,
    null ends are not.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.write(both, "edges")
    held = labels = scratch.write(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        offered = both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("_to")).agg(F.min("component").alias("_offer"))
        hooked = labels.join(offered, F.col("id") == F.col("_to"), "left").select("id", F.col("component").alias("_old"), F.least("component", F.coalesce("_offer", "component")).alias("_label"))
        above = labels.select(F.col("id").alias("_label"), F.col("component").alias("_above"))
        jumped = hooked.join(above, "_label", "left").select("id", F.least("_label", F.coalesce("_above", "_label")).alias("component"), "_old")
        new = scratch.write(jumped, "labels")
        moved = not new.where("component != _old").isEmpty()
        scratch.drop(held)
        held, labels = new, new.select("id", "component")
        if not moved:
            scratch.drop(both)
            return labels
