"""Windows over one global order, without dealing all rows to one task.

Rows are numbered by their day's offset plus their place in the day, and cut into blocks of equal length; a block
also gets the rows just before it as context.  Only counts per day and maxima per block meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 8_192


def numbered(rows: DataFrame, at: str, tie: str) -> DataFrame:
    """Adds ``_n``, the row's number from 0 in the order of ``at``, then ``tie``; rows without ``at`` are left out."""
    dated = rows.where(F.col(at).isNotNull()).withColumn("_day", F.unix_date(F.col(at).cast("date")))
    days = dated.groupBy("_day").agg(F.count(F.lit(1)).alias("_count"))
    offsets = days.withColumn("_before", F.coalesce(F.sum("_count").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_count")
    place = F.row_number().over(Window.partitionBy("_day").orderBy(at, tie)) - 1
    return dated.withColumn("_place", place).join(offsets, "_day").withColumn("_n", F.col("_before") + F.col("_place")).drop("_day", "_place", "_before")


def in_blocks(rows: DataFrame, context: int, block: int = BLOCK) -> DataFrame:
    """Adds ``_block`` and ``_context``: each block's rows, and copies of the ``context`` rows before it."""
    own = F.floor(F.col("_n") / block)
    tail = F.col("_n") % block >= block - context
    blocks = F.when(tail, F.array(F.struct(own.alias("b"), F.lit(False).alias("c")), F.struct((own + 1).alias("b"), F.lit(True).alias("c")))).otherwise(F.array(F.struct(own.alias("b"), F.lit(False).alias("c"))))
    return rows.withColumn("_at", F.explode(blocks)).withColumns({"_block": F.col("_at.b"), "_context": F.col("_at.c")}).drop("_at")


def running_max(rows: DataFrame, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """Adds the largest ``value`` so far in the order of ``_n``; null until there is one."""
    held = rows.withColumn("_b", F.floor(F.col("_n") / block))
    tops = held.groupBy("_b").agg(F.max(value).alias("_top"))
    before = tops.withColumn("_top", F.max("_top").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy("_b").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    return held.withColumn("_own", F.max(value).over(w)).join(before, "_b").withColumn(name, F.greatest("_own", "_top")).drop("_b", "_own", "_top")
