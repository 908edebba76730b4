"""Phrase collocations: n-grams counted level by level, each pass hashing the next level's into buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import countmin
from . import kernels as K
from .storage import Scratch

#: What ends a piece of text, and what parts its words.
ENDS = K.byte_class((0x0A, 0x0D), (0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F))
BLANKS = K.byte_class((0x20, 0x20), (0x09, 0x09))
#: Occurrences of a candidate; words in the longest phrase; phrases reported of each language.
LEAST_COUNT, LONGEST, TOP = 10, 3, 2000
#: The share of a phrase's occurrences, in percent, that lie in a longer candidate which takes its place.
ABSORBED_PERCENT = 50
#: Buckets of a level, as a power of two: 16 MB of bits are broadcast for the buckets and as much for the phrases before.
BITS = 27
#: Bytes of text that are counted together in a task.
COUNTED_BYTES = 1 << 22
#: First cut of the ranking of a language, so that no task sorts all of its candidates.
SHARDS = 64
UNKNOWN = "und"

_GRAMS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), *countmin.ARROW])
_GRAMS_DDL = f"lang string, phrase string, n bigint, {countmin.SCHEMA}"


class Phrases:
    """The runs of one to ``longest`` words inside the pieces of a block, hashed with the language of their document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, languages: np.ndarray, longest: int):
        self.words = words = K.Words(data, offsets, ~(ENDS | BLANKS), K.FOLDED)
        self.language = languages[words.documents()] if len(words.starts) else np.zeros(0, K.U64)
        ends = np.concatenate([[0], np.cumsum(ENDS[data])])
        joint = np.zeros(len(words.starts), dtype=bool)
        if len(joint):
            joint[:-1] = (ends[words.starts[1:]] == ends[words.ends[:-1]]) & (words.documents()[1:] == words.documents()[:-1])
        self.inside = [np.ones(len(joint), dtype=bool)]  # by length - 1: whether the words from here on are in one piece
        for n in range(1, longest):
            after = np.zeros(len(joint), dtype=bool)
            after[: len(joint) - n] = joint[n - 1 : len(joint) - 1]
            self.inside.append(self.inside[-1] & after)

    def hashes(self, first: np.ndarray, size: int) -> np.ndarray:
        total = self.language[first].copy()
        for k in range(size):
            total = total * K.U64(0x9E3779B97F4A7C15) + self.words.hashes[first + k]
        return K.mix(total)

    def text(self, i: int, size: int) -> bytes:
        words = self.words
        return b" ".join(words.data[words.starts[k] : words.ends[k]].tobytes() for k in range(i, i + size)).lower()


def _language_hashes(column: pa.Array) -> np.ndarray:
    """A hash of each row's language."""
    data, offsets = K.text_buffers(column)
    return K.span_hashes_any(data, offsets[:-1], offsets[1:], K.EXACT)


def _level(size: int, before: Callable, buckets: Callable, longest: int, least: int, bits: int):
    """Counts the phrases of ``size`` words that may be frequent, and hashes the longer ones that still may be into buckets.

    ``before``: the frequent phrases of one word less; ``buckets``: the full buckets of this size.
    """

    def work(data: np.ndarray, offsets: np.ndarray, languages: pa.Array) -> Iterator[pa.RecordBatch]:
        found = Phrases(data, offsets, _language_hashes(languages), longest)
        first = np.flatnonzero(found.inside[size - 1])
        if size > 1:
            shorter = np.zeros(len(found.words.starts) + 1, dtype=bool)
            whole = np.flatnonzero(found.inside[size - 2])
            shorter[whole] = before().often(found.hashes(whole, size - 1))
            first = first[shorter[first] & shorter[first + 1]]  # both parts of one word less are frequent
            hashes = found.hashes(first, size)
            may = buckets().often(hashes)
            first, hashes = first[may], hashes[may]
        else:
            hashes = found.hashes(first, 1)
        _, at, n = np.unique(hashes, return_index=True, return_counts=True)
        texts = pa.array([found.text(i, size) for i in first[at].tolist()], pa.binary()).cast(pa.string())
        owners = languages.take(pa.array(found.words.documents()[first[at]]))
        nothing = [pa.nulls(len(at), t) for t in countmin.ARROW.types]
        yield pa.RecordBatch.from_arrays([owners, texts, pa.array(n.astype(np.int64)), *nothing], schema=_GRAMS)
        if size < longest:
            kept = np.zeros(len(found.words.starts) + 1, dtype=bool)
            kept[first] = True
            longer = np.flatnonzero(found.inside[size] & kept[:-1] & kept[1:])
            cells = countmin.sketch_rows(found.hashes(longer, size + 1), None, 1, bits, least)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(cells), t) for t in _GRAMS.types[:3]], *cells.columns], schema=_GRAMS)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            for begin, end, block, own in K.blocks(data, offsets, COUNTED_BYTES):
                yield from work(block, own, batch.column(0).slice(begin, end - begin))

    return task


def _phrase_cells(size: int, least: int, bits: int):
    """Full cells for the frequent phrases themselves, hashed as in texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            found = Phrases(data, offsets, _language_hashes(batch.column(0)), size)
            hashes = found.hashes(found.words.bounds[:-1], size)
            yield countmin.sketch_rows(hashes, np.full(len(hashes), least), 1, bits, least)

    return task


def frequent_phrases(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST_COUNT, bits: int = BITS) -> tuple[list[DataFrame], DataFrame]:
    """Exact counts of all phrases that occur ``least`` times in a language: (``lang, phrase, n`` by number of words, ``lang, n`` of all words).

    One pass over the texts for each length.  A pass counts its phrases, of which both parts of one word less are
    frequent and whose bucket is full, and hashes the phrases of one word more into buckets.  Buckets and frequent
    phrases are broadcast as bits of fixed size; they hold too much at worst, never too little.
    """
    spark = documents.sparkSession
    scratch, held, tables = Scratch(spark, "phrases"), [], []
    texts = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    before = buckets = None
    for size in range(1, longest + 1):
        rows = scratch.write(texts.mapInArrow(_level(size, _value(before), _value(buckets), longest, least, bits), _GRAMS_DDL), "pass")
        counts = rows.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if size == 1:
            totals = scratch.write(counts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        tables.append(scratch.write(counts.where(F.col("n") >= least), "frequent"))
        if size < longest:
            buckets = spark.sparkContext.broadcast(countmin.merged(rows.where("chunk is not null").select("chunk", "cells", "counts"), 1, bits, least))
            before = spark.sparkContext.broadcast(countmin.merged(tables[-1].select("lang", "phrase").mapInArrow(_phrase_cells(size, least, bits), countmin.SCHEMA), 1, bits, least))
            held += [buckets, before]
        scratch.drop(rows)
    for b in held:
        b.destroy()
    return tables, totals


def _value(broadcast) -> Callable:
    return lambda: broadcast.value


def _parts(tables: list[DataFrame], size: int) -> DataFrame:
    """``lang, phrase, a, l, r, score, k`` of the candidates of ``size`` words, each with its lowest-scoring cut."""
    rows = tables[size - 1].withColumnRenamed("n", "a")
    for k in range(1, size):
        for name, words, part in ((f"l{k}", k, F.substring_index("phrase", " ", k)), (f"r{k}", size - k, F.substring_index("phrase", " ", k - size))):
            other = tables[words - 1].select("lang", F.col("phrase").alias("part"), F.col("n").alias(name))
            rows = rows.withColumn("part", part).join(other, ["lang", "part"]).drop("part")
    best = F.array_min(F.array(*[F.struct(_score(f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)]))
    return rows.select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def _score(left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) in whole numbers of up to 38 digits; it is at most 1000000."""
    wide = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"({wide('a')} * {wide('a')} * 1000000) div ({wide(left)} * {wide(right)})")


def collocations(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST_COUNT, absorbed_percent: int = ABSORBED_PERCENT, top: int = TOP, bits: int = BITS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``longest`` words.

    A phrase of ``a`` occurrences, cut into parts of ``l`` and ``r``, scores floor(1000000 a a / (l r)); the cut of the
    lowest score counts, of several the first.  A phrase is dropped if a longer candidate with ``absorbed_percent`` of
    its occurrences holds it.  Ranks go by score, then a, both descending, then phrase in byte order.  Null texts count
    as empty, a null language as ``und``; no phrase of ``least`` occurrences: no rows.
    """
    tables, totals = frequent_phrases(documents, text_col, lang_col, longest, least, bits)
    scored = [_parts(tables, size) for size in range(2, longest + 1)]
    kept = scored[-1]
    for size in range(2, longest):  # phrases inside longer ones
        inner = None
        for more in range(size + 1, longest + 1):
            starts = F.explode(F.array(*[F.array_join(F.slice(F.split("phrase", " "), i, size), " ") for i in range(1, more - size + 2)]))
            held = tables[more - 1].select("lang", starts.alias("phrase"), F.col("n").alias("longer"))
            inner = held if inner is None else inner.union(held)
        longer = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        own = scored[size - 2].join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed_percent * F.col("a"))).drop("longer")
        kept = own.unionByName(kept)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shard = F.pmod(F.xxhash64("phrase"), F.lit(SHARDS))
    first = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", shard).orderBy(*order))).where(F.col("place") <= top).drop("place")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
