"""Packing: length buckets whose boundaries minimise padding, and token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

#: Buckets, and tokens that a batch may hold, padding included.
BUCKETS, BUDGET = 16, 65_536
#: Rows that share a numbering group inside a bucket, on average.
GROUP_ROWS = 20_000


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """(bucket lengths ascending, padding): at most ``buckets`` of the given lengths, each length padded to the next.

    Dynamic programming over the sorted distinct lengths.  The padding of putting lengths i..j-1 into one bucket
    is lengths[j-1] * count - sum; its best split point moves right with j, so a layer is filled by divide and
    conquer: all middles of a depth at once, each within the splits of its neighbours, O(n log n) in all.
    """
    if not len(lengths):
        return [], 0
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    n = len(lengths)
    rows, tokens = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * lengths)]
    pad = lambda i, j: lengths[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])
    best = np.r_[0, pad(np.zeros(n, np.int64), np.arange(1, n + 1))]
    splits = []
    for _ in range(1, min(buckets, n)):
        new, split = best.copy(), np.zeros(n + 1, dtype=np.int64)
        low, high, first, last = (np.array([x]) for x in (1, n, 0, n))
        while len(low):
            middle = (low + high) // 2
            sizes = np.minimum(last, middle - 1) - first + 1
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            i = np.arange(sizes.sum()) - np.repeat(starts - first, sizes)
            cost = best[i] + pad(i, np.repeat(middle, sizes))
            least = np.minimum.reduceat(cost, starts)
            hits = np.flatnonzero(cost == np.repeat(least, sizes))
            chosen = i[hits[np.searchsorted(hits, starts)]]  # the first of equal ones
            new[middle], split[middle] = least, chosen
            low, high, first, last = np.r_[low, middle + 1], np.r_[middle - 1, high], np.r_[first, chosen], np.r_[chosen, last]
            left = low <= high
            low, high, first, last = low[left], high[left], first[left], last[left]
        splits.append(split)
        best = new
    ends, j = [], n
    for split in reversed(splits):
        ends.append(int(lengths[j - 1]))
        j = int(split[j])
        if j == 0:
            break
    else:
        ends.append(int(lengths[j - 1]))
    return sorted(ends), int(best[n])


def word_tokens(text: Column) -> Column:
    """Tokens counted as runs of other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def pack(documents: DataFrame, id_col: str = "doc_id", tokens: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``id_col, n_tokens, bucket_tokens, batch_id, slot, padding``, a row for each document.

    The histogram of token counts over all documents decides ``buckets`` boundaries of least total padding; a
    document is padded to its bucket's boundary.  Inside a bucket, documents are numbered and each batch takes
    budget // boundary of them (at least one: a document longer than the budget is a batch of its own), so all
    batches but the bucket's last are full.  Documents without tokens form a bucket of length 0 in batches of
    ``budget`` rows.  ``tokens`` gives each row's token count, null counting as 0 (default: words of the column
    ``text``).  Repeated rows and null ids each get a slot.  The driver holds the histogram: a row for each
    distinct length, so at most as many as the longest document has tokens.

    Numbering: each row gets a number of its own, by whose hash a bucket's rows are dealt into groups of about
    GROUP_ROWS whatever their ids are; they are numbered inside each group and shifted by the sizes of the groups
    before, so no task sees a whole bucket.
    """
    scratch = Scratch(documents.sparkSession, "packing")
    own = word_tokens(F.col("text")) if tokens is None else F.coalesce(tokens.cast("bigint"), F.lit(0).cast("bigint"))
    counted = scratch.write(documents.select(F.col(id_col).alias("id"), own.alias("n"), F.monotonically_increasing_id().alias("row")), "counted")
    held = {r["n"]: r["rows"] for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).collect()}
    inner = np.array(sorted(n for n in held if n > 0), dtype=np.int64)
    ends, _ = optimal_boundaries(inner, np.array([held[n] for n in inner.tolist()], dtype=np.int64), buckets)
    ends = ([0] if min(held, default=1) <= 0 else []) + ends
    rows = np.bincount(np.searchsorted(ends, list(held)), weights=list(held.values()), minlength=len(ends)).astype(np.int64).tolist()
    bucket, groups = F.lit(None).cast("bigint"), F.lit(1)
    for e, n in zip(reversed(ends), reversed(rows)):
        bucket = F.when(F.col("n") <= e, F.lit(e)).otherwise(bucket)
        groups = F.when(F.col("bucket") == e, F.lit(max(1, -(-n // GROUP_ROWS)))).otherwise(groups)
    dealt = counted.withColumn("bucket", bucket).withColumn("grp", F.pmod(F.xxhash64("row"), groups.cast("bigint")))
    sizes = dealt.groupBy("bucket", "grp").agg(F.count(F.lit(1)).alias("size"))  # a row for each GROUP_ROWS documents
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy("bucket").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1))).select("bucket", "grp", F.coalesce("before", F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("bucket", "grp").orderBy("id", "row")).cast("bigint") - 1
    numbered = dealt.withColumn("number", number).join(before, ["bucket", "grp"]).withColumn("number", F.col("number") + F.col("before"))
    size = F.when(F.col("bucket") == 0, F.lit(budget)).otherwise(F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket")))).cast("bigint")
    batch = F.floor(F.col("number") / size).cast("bigint")
    return numbered.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("bucket").alias("bucket_tokens"), F.concat_ws("-", F.col("bucket").cast("string"), batch.cast("string")).alias("batch_id"), (F.col("number") - batch * size).alias("slot"), (F.col("bucket") - F.col("n")).alias("padding"))
