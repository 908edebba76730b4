"""Removal of passages that an earlier document holds: a count-min prefilter, then exact groups of the windows left."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import countmin
from . import kernels as K
from .storage import Scratch

#: Consecutive words in a window, and in the word n-gram that stands for it in the sketch.
WINDOW, GRAM = 50, 8
#: The sketch's rows and cells a row; 32 MB of bits are broadcast.  More documents only make it pass more windows on.
ROWS, BITS = 2, 27
#: Items that a task gathers before it writes its cells.
ITEMS = 1 << 20


class Anchors:
    """The anchor of each window of a block: the n-gram of smallest hash among the window's, the first of several.

    Equal windows have equal anchors, so the number of documents with an anchor is at least that of the documents with
    any of its windows.  Neighbouring windows mostly share one: an anchor stands for the windows ``first`` to
    ``end - 1`` by number of their first word.
    """

    def __init__(self, words: K.Words, window: int, gram: int):
        self.words, self.window = words, window
        n = len(words.hashes)
        if n < window:
            self.first = self.end = np.zeros(0, np.int64)
            self.hashes = self.documents = np.zeros(0, K.U64)
            return
        up, _ = K.powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=K.U64)
        np.cumsum(words.hashes * up[:n], dtype=K.U64, out=self.sums[1:])
        grams = self.spans(np.arange(n - gram + 1), gram)
        at, span, width = np.arange(len(grams)), 1, window - gram + 1
        while span < width:  # the place of the smallest hash of 2, 4, 8, ... n-grams, then of all of the window
            step = min(span, width - span)
            left, right = at[:-step], at[step:]
            at, span = np.where(grams[right] < grams[left], right, left), span + step
        room = np.repeat(words.bounds[1:], words.counts)[: len(at)] - np.arange(len(at)) >= window
        starts = np.flatnonzero(room)
        place = at[starts]
        new = np.ones(len(place), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
        heads = np.flatnonzero(new)
        self.first, self.end = starts[heads], starts[np.append(heads[1:], len(place)) - 1] + 1
        self.hashes = grams[place[heads]]
        self.documents = words.documents()[self.first]

    def spans(self, first: np.ndarray, size: int) -> np.ndarray:
        """A hash of ``size`` words from each place on."""
        _, down = K.powers(len(self.sums))
        return K.mix((self.sums[first + size] - self.sums[first]) * down[first] + K.U64(size))

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the windows of the chosen anchors one after the other, bounds)."""
        sizes = (self.end - self.first)[chosen]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        each = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - self.first[chosen], sizes)
        return self.spans(each, self.window), bounds


def _anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Anchors:
    return Anchors(K.Words(data, offsets, K.NOT_SPACE, K.EXACT), window, gram)


def _sketch(window: int, gram: int, rows: int, bits: int):
    """Each task's cells of the anchors of its documents; an anchor counts once a document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(0))
            for _, _, block, own in K.blocks(data, offsets, K.SLICE_BYTES):
                found = _anchors(block, own, window, gram)
                order = np.lexsort((found.hashes, found.documents))
                hashes, documents = found.hashes[order], found.documents[order]
                new = np.ones(len(hashes), dtype=bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (documents[1:] != documents[:-1])
                held.append(hashes[new])
                if sum(map(len, held)) >= ITEMS:
                    yield countmin.sketch_rows(np.concatenate(held), None, rows, bits, 2)
                    held = []
        if held:
            yield countmin.sketch_rows(np.concatenate(held), None, rows, bits, 2)

    return task


def _repeated(filled: Broadcast, window: int, gram: int, schema: pa.Schema):
    """The anchors that may occur in a second document, with the hashes of their windows."""

    def work(data: np.ndarray, offsets: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
        found = _anchors(data, offsets, window, gram)
        chosen = np.flatnonzero(filled.value.often(found.hashes))
        windows, bounds = found.windows(chosen) if len(chosen) else (np.zeros(0, K.U64), np.zeros(1, np.int64))
        documents = found.documents[chosen].astype(np.int64)
        first = found.first[chosen] - found.words.bounds[documents]
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(windows.view(np.int64)))
        extents = K.mix(windows * K.U64(0x9E3779B97F4A7C15) + np.arange(len(windows), dtype=K.U64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(K.U64))
        extent = np.concatenate([[0], np.cumsum(extents, dtype=K.U64)]).astype(K.U64)
        columns = [batch.column(i).take(pa.array(documents)) for i in range(2)]
        columns += [pa.array(found.hashes[chosen].view(np.int64)), pa.array((extent[bounds[1:]] - extent[bounds[:-1]]).view(np.int64)), pa.array(first.astype(np.int64)), lists]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(2))
            for begin, end, block, own in K.blocks(data, offsets, K.SLICE_BYTES):
                yield work(block, own, batch.slice(begin, end - begin))

    return task


def repeated_windows(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """``id, digest, ranges``: of each text with windows that start in a document of a smaller id as well, these windows.

    A text is known by its id and its xxhash64; ``ranges`` are ``array<struct<first,end>>`` of numbers of the windows'
    first words, unordered.  Texts of less than ``window`` words, null and empty ones and rows without an id have no
    windows; a text isn't compared with itself or others of its id, however often it is there.

    First pass: every task counts the anchors of its windows, and the merged sketch tells which anchors may occur in
    a second document.  Second pass: only their windows are grouped, by the 64-bit hashes of anchor and window
    together.  The windows of an anchor go together, as an extent: equal extents are one row before windows are
    compared, so neither copies nor shared passages multiply rows, and where an anchor has but one extent its windows
    need no comparison.
    """
    spark = documents.sparkSession
    kind, scratch = dict(documents.dtypes)[id_col], Scratch(spark, "substrings")
    texts = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    sketches = texts.select("text").mapInArrow(_sketch(window, gram, rows, bits), countmin.SCHEMA)
    filled = spark.sparkContext.broadcast(countmin.merged(sketches, rows, bits, 2))
    schema = pa.schema([("id", K.arrow_type(documents, id_col)), ("digest", pa.int64()), ("anchor", pa.int64()), ("extent", pa.int64()), ("first", pa.int64()), ("windows", pa.list_(pa.int64()))])
    ddl = f"id {kind}, digest bigint, anchor bigint, extent bigint, first bigint, windows array<bigint>"
    held = scratch.write(texts.mapInArrow(_repeated(filled, window, gram, schema), ddl), "held")
    extents = scratch.write(held.groupBy("anchor", "extent").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.any_value("windows").alias("windows")), "extents")
    places = scratch.write(held.drop("windows"), "places")
    scratch.drop(held)
    count = extents.groupBy("anchor").agg((F.count(F.lit(1)) > 1).alias("several"))
    judged = scratch.write(extents.join(count, "anchor").where("several or least < most"), "judged")
    scratch.drop(extents)
    several = judged.where("several")
    windows = several.select("anchor", "least", F.explode("windows").alias("window"))
    shared = scratch.write(windows.groupBy("anchor", "window").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "shared")
    places_of = several.select("anchor", "extent", F.posexplode("windows").alias("k", "window"))
    met = places_of.join(shared, ["anchor", "window"]).groupBy("anchor", "extent").agg(F.map_from_entries(F.collect_list(F.struct("k", "first"))).alias("firsts"))
    own = judged.select("anchor", "extent", "least", "most", F.size("windows").alias("n"))
    earliest = lambda k: F.coalesce(F.try_element_at("firsts", k), F.col("least"))
    known = own.join(met, ["anchor", "extent"], "left").withColumn("known", F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(k.alias("k"), earliest(k).alias("earliest"))))
    known = scratch.write(known.where(F.exists("known", lambda x: x["earliest"] < F.col("most"))).select("anchor", "extent", "known"), "known")
    scratch.drop(judged, shared)
    found = places.join(known, ["anchor", "extent"])
    ks = F.transform(F.filter("known", lambda x: x["earliest"] < F.col("id")), lambda x: F.col("first") + x["k"])
    found = found.select("id", "digest", ks.alias("ks")).where(F.size("ks") > 0)
    whole = F.element_at("ks", -1) - F.element_at("ks", 1) + 1 == F.size("ks")
    span = lambda a, b: F.struct(a.alias("first"), b.alias("end"))
    ranges = F.when(whole, F.array(span(F.element_at("ks", 1), F.element_at("ks", -1) + 1))).otherwise(F.transform("ks", lambda k: span(k, k + 1)))
    found = scratch.write(found.select("id", "digest", F.explode(ranges).alias("range")).groupBy("id", "digest").agg(F.collect_set("range").alias("ranges")), "ranges")
    scratch.keep(found)
    return found


def _kept(window: int, schema: pa.Schema):
    """The words outside the ranges of windows, joined by one space, and how many there were."""

    def work(data: np.ndarray, offsets: np.ndarray, batch: pa.RecordBatch) -> list:
        words = K.Words(data, offsets, K.NOT_SPACE, K.EXACT)
        lists = batch.column(batch.schema.get_field_index("ranges"))
        marks = np.zeros(len(words.starts) + 1, dtype=np.int64)
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], dtype=np.int64)
        if sizes.sum():
            flat, base = lists.flatten(), np.repeat(words.bounds[:-1], sizes)
            np.add.at(marks, base + flat.field("first").to_numpy(), 1)
            np.add.at(marks, base + flat.field("end").to_numpy() + window - 1, -1)
        gone = np.cumsum(marks[:-1]) > 0
        stay, of = ~gone, words.documents()
        last = np.full(len(offsets) - 1, -1, dtype=np.int64)
        last[of[stay]] = np.flatnonzero(stay)
        edges = np.zeros(len(data) + 1, dtype=np.int64)
        edges[words.starts[stay]] += 1
        edges[words.ends[stay]] -= 1
        mask = np.cumsum(edges[:-1]) > 0
        spaces = stay.copy()
        spaces[last[last >= 0]] = False  # no space behind a document's last kept word
        after = words.ends[spaces]
        out = data.copy()
        out[after] = 0x20
        mask[after] = True
        cuts = np.concatenate([[0], np.cumsum(mask)])[offsets]
        kept = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out[mask])).cast(pa.string())
        return [words.counts, K.sums_by_document(gone.astype(np.int64), words.bounds), kept]

    return K.map_texts(["id"], "text", work, schema, K.SLICE_BYTES)


def drop_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """``id_col, n_words, n_removed, text_col``: the words of each text that no repeated window covers, one space between.

    Windows are judged on the input, not on what is left.  Every row of the input gives one row; null and empty texts
    have no words and become empty; rows without an id lose nothing and take nothing from others; rows of one id and
    text have the same result.
    """
    found = repeated_windows(documents, id_col, text_col, window, gram, rows, bits).withColumnRenamed("id", "owner").withColumnRenamed("digest", "of")
    kind = dict(documents.dtypes)[id_col]
    texts = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    joined = texts.join(found, (F.col("id") == F.col("owner")) & (F.col("digest") == F.col("of")), "left").select("id", "text", "ranges")
    schema = pa.schema([("id", K.arrow_type(documents, id_col)), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    done = joined.mapInArrow(_kept(window, schema), f"id {kind}, n_words bigint, n_removed bigint, kept string")
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").alias(text_col))
