"""Count-min sketches of hashed items: each task's cells, merged by chunk, and kept as a bit a cell that says whether it is full.

Counts stop at the threshold, so a full cell's count is at least that and a cell that isn't full proves that its
items occur less often.  What the driver fetches and broadcasts is ``rows`` times 2 ** ``bits`` bits, whatever the
size of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

#: Cells of a chunk, which is one row of a sketch.
CHUNK_BITS = 16
SCHEMA = "chunk int, cells binary, counts binary"
ARROW = pa.schema([("chunk", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])


def cells_of(hashes: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """An item's cell in each row of the sketch, rows one after the other."""
    out = [K.mix(hashes + K.U64((2 * r + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) >> K.U64(64 - bits) | K.U64(r << bits) for r in range(rows)]
    return np.stack(out).astype(np.int64) if out else np.zeros((0, len(hashes)), np.int64)


class Filled:
    """The merged sketch: which cells are full."""

    def __init__(self, rows: int, bits: int):
        self.rows, self.bits, self.data = rows, bits, np.zeros((rows << bits) + 7 >> 3, dtype=np.uint8)

    def often(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each item may occur as often as the threshold: all its cells are full."""
        cells = cells_of(hashes, self.rows, self.bits)
        return ((self.data[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def sketch_rows(hashes: np.ndarray, counts: np.ndarray | None, rows: int, bits: int, threshold: int) -> pa.RecordBatch:
    """The cells of some items as chunk rows; ``counts`` are theirs, one each if None."""
    cells = cells_of(hashes, rows, bits).ravel()
    if counts is None:
        found, total = np.unique(cells, return_counts=True)
    else:
        found, inverse = np.unique(cells, return_inverse=True)
        total = np.bincount(inverse, weights=np.tile(counts, rows), minlength=len(found)).astype(np.int64)
    held = np.minimum(total, threshold).astype(np.uint16)
    chunks = found >> CHUNK_BITS
    cuts = np.flatnonzero(np.diff(chunks, prepend=-1, append=-2)) if len(chunks) else np.zeros(1, np.int64)
    low = (found & ((1 << CHUNK_BITS) - 1)).astype(np.uint16)
    pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
    columns = [pa.array(chunks[cuts[:-1]].astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in pairs], pa.binary()), pa.array([held[a:b].tobytes() for a, b in pairs], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


def _merge(threshold: int):
    """Adds up the rows of each chunk, which come one after the other; returns the chunk's full cells as bits."""

    def full(chunk: int, total: np.ndarray) -> pa.RecordBatch:
        bits = np.packbits(total >= threshold, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([bits], pa.binary())], ["chunk", "bits"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(1 << CHUNK_BITS, dtype=np.int64)
        for batch in batches:
            for chunk, cells, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if chunk != at:
                    if at is not None and (total >= threshold).any():
                        yield full(at, total)
                    at, total = chunk, np.zeros(1 << CHUNK_BITS, dtype=np.int64)
                total[np.frombuffer(cells, dtype=np.uint16)] += np.frombuffer(counts, dtype=np.uint16)  # a row has each cell once
        if at is not None and (total >= threshold).any():
            yield full(at, total)

    return task


def merged(sketches: DataFrame, rows: int, bits: int, threshold: int) -> Filled:
    """The sketch of all chunk rows together; a task holds one chunk at a time."""
    if not CHUNK_BITS <= bits <= 40 or not 0 < threshold < 1 << 16:
        raise ValueError("a sketch has 2 ** 16 to 2 ** 40 cells a row and a threshold below 2 ** 16")
    out = Filled(rows, bits)
    size = 1 << CHUNK_BITS - 3
    dealt = sketches.repartition("chunk").sortWithinPartitions("chunk")
    for r in dealt.mapInArrow(_merge(threshold), "chunk int, bits binary").collect():
        out.data[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.bits, dtype=np.uint8)
    return out
