"""Exact end of a search over buckets: every pair of two groups that share a bucket is tried or ruled out.

A set is sketched by how many of its hashes fall into each of some cells.  Two sets have no more in common than
the sum of the smaller counts, cell by cell; a pair whose bound stays below the similarity can't be a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a cell's number: 2 ** CELL_BITS cells, a byte each; a full byte counts as any number.
CELL_BITS = 7
#: Ids of a bucket that a task compares at a time with as many others, and cells compared at once.
CHUNK, AT_ONCE = 512, 1 << 21


def sketches(of: np.ndarray, hashes: np.ndarray, n: int, bits: int = CELL_BITS) -> pa.Array:
    """The sketches (binary) of n sets whose distinct elements are ``hashes`` with owners ``of``."""
    cells = 1 << bits
    counts = np.bincount(of * cells + (hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=n * cells)
    data = np.minimum(counts, 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * cells), pa.py_buffer(data)])


def possible(x: np.ndarray, y: np.ndarray, size_x: np.ndarray, size_y: np.ndarray, percent: int) -> np.ndarray:
    """x by y: whether sets with these sketches and sizes can reach the similarity."""
    out = np.empty((len(x), len(y)), dtype=bool)
    full_x, full_y = (x == 255).any(axis=1), (y == 255).any(axis=1)
    step = max(1, AT_ONCE // max(1, y.size))
    for i in range(0, len(x), step):
        common = np.minimum(x[i : i + step, None, :], y[None, :, :]).sum(axis=2, dtype=np.int32).astype(np.int64)
        total = size_x[i : i + step, None] + size_y[None, :]
        least = np.minimum(size_x[i : i + step, None], size_y[None, :])
        common = np.where(full_x[i : i + step, None] & full_y[None, :], least, common)
        out[i : i + step] = 100 * common >= percent * (total - common)
    return out


def cross_pairs(grouped: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of all pairs of different groups that share a bucket and that the bound doesn't rule out.

    ``grouped(key, id, component)``, ``sketched(id, size, cells)``.  Of a bucket only ids outside
    its largest group meet all of its ids, in squares of about CHUNK by CHUNK that are dealt out apart, so no
    task takes a bucket as a whole; pairs that are ruled out never become rows.  Buckets of two ids are left to
    the caller.
    """
    counted = grouped.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = counted.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.max(F.struct("n", "component")).alias("top")).where("groups > 1 and n > 2")
    mixed = mixed.select("key", "top.component", F.ceil(F.col("n") / CHUNK).cast("int").alias("wide"), F.ceil((F.col("n") - F.col("top.n")) / CHUNK).cast("int").alias("high")).withColumnRenamed("component", "largest")
    place = lambda r, s, side: F.struct(r.cast("int").alias("r"), s.cast("int").alias("s"), F.lit(side).alias("side"))
    own = lambda salt, parts: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(parts))
    every = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    right = F.transform(every("high"), lambda r: place(r, own(1, "wide"), 1))
    left = F.transform(every("wide"), lambda s: place(own(2, "high"), s, 0))
    dealt = grouped.join(mixed, "key").select("key", "id", "component", F.explode(F.when(F.col("component") != F.col("largest"), F.concat(left, right)).otherwise(right)).alias("p"))
    rows = dealt.select("key", "p.r", "p.s", "p.side", "id", "component").join(sketched, "id").select("key", "r", "s", "side", "id", "component", F.col("size").cast("bigint").alias("size"), "cells")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(table: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        side, ids, groups, sizes = (table.column(c).to_numpy() for c in ("side", "id", "component", "size"))
        cells = table.column("cells").combine_chunks()
        cells = cells.chunk(0) if isinstance(cells, pa.ChunkedArray) else cells
        start, end = np.frombuffer(cells.buffers()[1], dtype=np.int32)[[cells.offset, cells.offset + len(cells)]]
        sketch = np.frombuffer(cells.buffers()[2], dtype=np.uint8)[start:end].reshape(len(cells), -1)
        out = [np.zeros((2, 0), np.int64)]
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            m = i + int(np.searchsorted(side[i:j], 1))
            if i < m < j:
                p, q = np.nonzero(possible(sketch[i:m], sketch[m:j], sizes[i:m], sizes[m:j], percent) & (groups[i:m, None] != groups[None, m:j]))
                out.append(np.sort(np.stack([ids[i:m][p], ids[m:j][q]]), axis=0))
        found = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], schema=schema)

    def task(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            at = [held.column(c).to_numpy() for c in ("key", "r", "s")]
            cuts = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in at])) + 1
            if len(cuts):  # the last square may go on in the next batch
                yield pairs(held.slice(0, int(cuts[-1])), np.r_[0, cuts])
                held = held.slice(int(cuts[-1]))
        if held is not None:
            yield pairs(held, np.array([0, held.num_rows]))

    return rows.repartition("key", "r", "s").sortWithinPartitions("key", "r", "s", "side").mapInArrow(task, "a bigint, b bigint").distinct()
