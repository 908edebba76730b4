"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, verified hits, span or document removal."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import Scratch

#: Consecutive words in a window.
WINDOW = 10
#: The benchmark's windows are broadcast as a hash set; one of more bytes than this is dealt into parts that are
#: built and scanned one after the other.
PART_BYTES = 64_000_000
#: One bit per slot of the filter that a window's hash passes before it is looked up.
FILTER_BITS = 22


def _normalised(words: K.Words, first: int, size: int) -> bytes:
    """The words from ``first`` on, A-Z lowered, with a space between."""
    return b" ".join(words.data[words.starts[k] : words.ends[k]].tobytes() for k in range(first, first + size)).lower()


class WindowSet:
    """A hash set of windows: their sorted hashes by number of words, and for each its words and an item it occurs in."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("size", "ascending"), ("hash", "ascending")]).combine_chunks()
        sizes, hashes = rows.column("size").to_numpy(), rows.column("hash").to_numpy().view(np.uint64)
        self.words, self.items, self.sizes = rows.column("words").combine_chunks(), rows.column("item").combine_chunks(), {}
        for size in np.unique(sizes).tolist():
            low, high = np.searchsorted(sizes, [size, size + 1]).tolist()
            own = np.sort(hashes[low:high])
            order = low + np.argsort(hashes[low:high], kind="stable")
            slots = np.zeros(1 << FILTER_BITS, dtype=bool)
            slots[(own >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.sizes[size] = (own, order, slots)

    def hits(self, words: K.Words) -> list[tuple[int, int, set[str]]]:
        """(first word, end, items) of every verified occurrence in a block of documents."""
        out = []
        for size, (hashes, order, slots) in self.sizes.items():
            first, values = words.windows(size)
            maybe = np.flatnonzero(slots[(values >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            low, high = np.searchsorted(hashes, values[maybe], "left"), np.searchsorted(hashes, values[maybe], "right")
            some = high > low
            for i, a, b in zip(first[maybe[some]].tolist(), low[some].tolist(), high[some].tolist()):
                own = _normalised(words, i, size)
                items = {self.items[k].as_py() for k in order[a:b].tolist() if self.words[k].as_py() == own}
                if items:
                    out.append((i, i + size, items))
        return out


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``size, hash, words binary, item``: the distinct windows of each item; an item of fewer words is one window."""
    schema = pa.schema([("size", pa.int32()), ("hash", pa.int64()), ("words", pa.binary()), ("item", pa.string())])

    def task(batches):
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            for first, end, block, own in K.blocks(data, offsets):
                words = K.Words(block, own, K.ALNUM_OR_WIDE, K.FOLDED)
                sizes = np.minimum(words.counts, window)
                for size in np.unique(sizes[sizes > 0]).tolist():
                    places, hashes = words.windows(size)
                    of = words.documents()[places]
                    fits = sizes[of] == size
                    texts = [_normalised(words, i, size) for i in places[fits].tolist()]
                    columns = [pa.array(np.full(len(texts), size, np.int32)), pa.array(hashes[fits].view(np.int64)), pa.array(texts, pa.binary()), batch.column(0).take(pa.array(of[fits] + first))]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInArrow(task, "size int, hash bigint, words binary, item string").distinct()


def _parts(windows: DataFrame, part_bytes: int) -> tuple[int, Callable[[int], WindowSet]]:
    """The number of parts that hold about ``part_bytes`` each, and a function that fetches one of them."""
    total = windows.agg(F.coalesce(F.sum(F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)) + 24), F.lit(0)).alias("n")).first().n
    parts = -(-total // part_bytes)
    return parts, lambda p: WindowSet(windows.where(F.pmod(F.xxhash64("hash", "item"), F.lit(parts)) == p).toArrow())


def contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Verified occurrences of benchmark windows in whole documents.

    Returns ``id_col, n_words, n_hit, items, spans``: the words of the document, those inside any
    occurrence, the items (distinct, sorted as strings) and the hit ranges as byte offsets
    ``array<struct<start,end>>`` of the UTF-8 text, merged where they touch.  Null and empty texts have no
    words.  Items with fewer words than a window form one window of their own; items without words never
    hit.  Repeated item rows count once; the windows of rows without an item_id hit words but name no item; repeated
    documents give a row each.

    The driver holds and broadcasts one part of about ``part_bytes`` of windows at a time; with several parts, the
    documents are written between parts with the hits so far.
    """
    kind = dict(documents.dtypes)[id_col]
    state = "items array<string>, ranges array<bigint>"
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.expr("cast(array() as array<string>)").alias("items"), F.expr("cast(array() as array<bigint>)").alias("ranges"))
    id_type = K.arrow_type(documents, id_col)
    found = pa.schema([("id", id_type), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    carried = pa.schema([("id", id_type), ("text", pa.string()), ("items", pa.list_(pa.string())), ("ranges", pa.list_(pa.int64()))])
    scratch = Scratch(documents.sparkSession, "decontamination")
    parts, part = _parts(scratch.write(benchmark_windows(benchmark, item_col, item_text_col, window), "windows"), part_bytes)
    for p in range(parts - 1):
        done, rows = rows, scratch.write(rows.mapInArrow(K.map_texts(["id", "text"], "text", _scan(_broadcast(documents, part(p)), True), carried), f"id {kind}, text string, {state}"), "part")
        scratch.drop(done)
    last = _scan(_broadcast(documents, part(parts - 1) if parts else None), False)
    scratch.keep(*[rows] * (parts > 1))
    ddl = f"id {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"
    return rows.mapInArrow(K.map_texts(["id"], "text", last, found), ddl).withColumnRenamed("id", id_col)


def _broadcast(documents: DataFrame, index: WindowSet | None):
    held = documents.sparkSession.sparkContext.broadcast(index)
    return lambda: held.value


def _scan(index_of, carry: bool):
    """Work on a block: the hits of one part of the benchmark, added to those that the rows bring along."""

    def work(data, offsets, batch):
        words = K.Words(data, offsets, K.ALNUM_OR_WIDE, K.FOLDED)
        index, n = index_of(), len(offsets) - 1
        items = {d: set(own) for d, own in enumerate(batch.column("items").to_pylist()) if own}
        marked = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        for d, own in enumerate(batch.column("ranges").to_pylist()):
            for i, j in zip(own[::2], own[1::2]):
                marked[words.bounds[d] + i] += 1
                marked[words.bounds[d] + j] -= 1
        found = index.hits(words) if index else []
        of = np.searchsorted(words.bounds, [f[0] for f in found], "right") - 1
        for d, (i, j, own) in zip(of.tolist(), found):
            marked[i] += 1
            marked[j] -= 1
            items.setdefault(d, set()).update(own - {None})
        hit = np.cumsum(marked[:-1]) > 0
        ranges: dict[int, list[tuple[int, int]]] = {}
        for d in np.unique(words.documents()[hit]).tolist():
            a, b = words.bounds[d], words.bounds[d + 1]
            own = np.flatnonzero(hit[a:b])
            cut = np.flatnonzero(np.diff(own) > 1)
            ranges[d] = [(int(own[i]), int(own[j]) + 1) for i, j in zip(np.r_[0, cut + 1], np.r_[cut, len(own) - 1])]
        listed = [sorted(items.get(d, ())) for d in range(n)]
        if carry:
            return listed, [[x for pair in ranges.get(d, ()) for x in pair] for d in range(n)]
        place = lambda d, i, j: {"start": int(words.starts[words.bounds[d] + i] - offsets[d]), "end": int(words.ends[words.bounds[d] + j - 1] - offsets[d])}
        spans = [[place(d, i, j) for i, j in ranges.get(d, ())] for d in range(n)]
        return words.counts, K.sums_by_document(hit.astype(np.int64), words.bounds), listed, spans

    return work


def remove_spans(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", drop_share: float = 0.5, window: int = WINDOW) -> DataFrame:
    """Documents without their contaminated spans, all columns kept.

    A document with more than ``drop_share`` of its words hit is dropped; from others the hit spans are cut
    out.  Cuts are keyed by id and text, so rows with the same id and different texts each get their own.
    Null texts and rows without an id are judged like all others.
    """
    key, n_words, n_hit, spans = K.unused(documents, "hit_key", "hit_words", "hit_count", "hit_spans")
    of = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"))
    found = contamination(documents.select(of.alias("key"), F.col(text_col).alias("text")), benchmark, "key", "text", item_col, item_text_col, window)
    hits = found.where("n_hit > 0").groupBy("key").agg(*[F.first(c).alias(new) for c, new in (("n_words", n_words), ("n_hit", n_hit), ("spans", spans))]).withColumnRenamed("key", key)
    joined = documents.join(hits, of == F.col(key), "left")
    kept = joined.where(F.col(n_hit).isNull() | (F.col(n_hit) <= drop_share * F.col(n_words)))
    hit = F.col(n_hit).isNotNull()
    cut = _cut(F.when(hit, F.col(text_col)), F.col(spans))  # texts without hits don't leave the JVM
    return kept.withColumn(text_col, F.when(hit, cut).otherwise(F.col(text_col))).drop(key, n_words, n_hit, spans)


def _cut(text, spans):
    """The texts without the byte ranges of their spans."""

    def cut(texts: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for t, own in zip(texts, lists):
            if t is None:
                out.append(None)
                continue
            raw, kept, at = t.encode("utf-8", "surrogatepass"), [], 0
            for span in own if own is not None else ():
                kept.append(raw[at : span["start"]])
                at = span["end"]
            out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(cut, "string")(text, spans)
