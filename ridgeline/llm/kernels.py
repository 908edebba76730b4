"""Vectorised text kernels on Arrow string columns, used inside ``mapInArrow`` tasks.

A task gets record batches; the UTF-8 buffer of the text column is viewed as a
numpy byte array without making Python strings.  Work goes block by block
(``blocks``), cut between documents, so that the temporary arrays stay a small
multiple of ``BLOCK_BYTES`` however long a batch is; the hash of long texts is
computed in slices for the same reason.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

BLOCK_BYTES = 1 << 17
SLICE_BYTES = 1 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _seeded_table(seed: int, size: int = 256) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, size, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def byte_values(fold_ascii_case: bool) -> np.ndarray:
    """The random value that stands for each byte in a hash; with folding, A-Z count as a-z."""
    values = _seeded_table(7).copy()
    if fold_ascii_case:
        values[65:91] = values[97:123]
    return values


def byte_class(*members: tuple[int, int]) -> np.ndarray:
    """A 256-entry mask of the bytes in the given closed ranges."""
    mask = np.zeros(256, dtype=bool)
    for low, high in members:
        mask[low : high + 1] = True
    return mask


#: Fixed value: ASCII white space, the complement of which makes ``[^\x20\x09-\x0D]+`` words.
SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
NOT_SPACE = ~SPACE
#: Fixed value: digits, letters and every byte of a non-ASCII character; once A-Z are folded this is ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM_OR_WIDE = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

FOLDED = byte_values(True)
EXACT = byte_values(False)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores appended as it takes to differ from all columns of ``df`` (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        kind = np.int32
    else:
        kind = np.int64
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + len(column) + 1] if buffers[1] else np.zeros(len(column) + 1, kind)
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive documents of about ``most`` bytes: (first, end, bytes, offsets)."""
    n, first = len(offsets) - 1, 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values, which end where a document ends."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(inside), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(inside)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(inside), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            x = np.full(size, base, dtype=U64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=U64)
    return _powers["up"], _powers["down"]


def prefix_sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = the polynomial hash of bytes i..j-1, shifted by i."""
    up, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, dtype=U64)
    out[0] = 0
    np.cumsum(values[data] * up[: len(data)], dtype=U64, out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in ascending order.

    The prefix sums cover at most about SLICE_BYTES (or one span, if that is longer) at a time.
    """
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        sums = prefix_sums(data[low:high], values)
        a, b = starts[i:j] - low, ends[i:j] - low
        _, down = powers(high - low + 1)
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U64))
        i = j
    return out


def span_hashes_any(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``span_hashes`` of spans of a block in any order, which may overlap."""
    sums = prefix_sums(data, values)
    _, down = powers(len(data) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


class Words:
    """The words of a block of documents: spans, hashes and each document's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, values: np.ndarray):
        self.data, self.offsets = data, offsets
        self.starts, self.ends = runs(inside[data], offsets)
        self.hashes = span_hashes(data, self.starts, self.ends, values)
        self.bounds = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def documents(self) -> np.ndarray:
        """The block's document number of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of ``size`` words that lies in one document."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        left = np.repeat(self.bounds[1:], self.counts)[:n] - np.arange(n)  # words from here to the document's end
        first = np.flatnonzero(left >= size)
        total = np.zeros(n, dtype=U64)
        for k in range(size):
            total = total * U64(_BASE) + self.hashes[k : k + n]
        return first, mix(total[first])


def window_hash(words: list[int]) -> int:
    """The hash that ``Words.windows`` gives a window of words with these hashes."""
    total = 0
    for h in words:
        total = (total * _BASE + int(h)) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([total], dtype=U64))[0])


def words_of(text: str, inside: np.ndarray, values: np.ndarray) -> Words:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return Words(data, np.array([0, len(data)]), inside, values)


def starts_of_characters(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each UTF-8 character."""
    return (data & 0xC0) != 0x80


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    values = np.sort(values)
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def sums_by_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of values[bounds[d]:bounds[d+1]] for each d."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def map_texts(columns: list[str], text: str, work: Callable, schema: pa.Schema, most: int = BLOCK_BYTES) -> Callable:
    """A function for ``mapInArrow``.

    ``work(bytes, offsets, batch)`` gets blocks of documents with the matching rows of the batch and
    returns the block's output columns in the order of ``schema`` after the columns that are passed through.
    ``most``: bytes in a block.
    """

    def task(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
            for first, end, block, own in blocks(data, offsets, most):
                rows = batch.slice(first, end - first)
                made = work(block, own, rows)
                kept = [rows.column(rows.schema.get_field_index(c)) for c in columns]
                arrays = kept + [x if isinstance(x, pa.Array) else pa.array(x, type=schema.field(len(columns) + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return task
