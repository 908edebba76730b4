"""Quality rules: thresholds from mergeable quantile sketches per language and source, then a joined filter."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .storage import Scratch

#: Fixed values of the base rules.
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
#: Fixed value: the symbols that are counted.
SYMBOLS = b"#*$%&|<>"

#: Measures that a threshold is learnt for: numerator, denominator, sketch steps per unit, the least spread (in the
#: measure's unit) that a fence allows for, and the limit of what can still pass the base rules (None: none).
MEASURES = {
    "symbol_share": ("n_symbols", "word_chars", 4096, 0.02, 1.0),
    "repeat_share": ("n_repeat_words", "n_words", 4096, 0.04, MAX_REPEAT_PERCENT / 100),
    "dup_line_share": ("n_dup_lines", "n_lines", 4096, 0.10, 1.0),
    "mean_word": ("word_chars", "n_words", 256, 1.0, None),
}
#: A document fails beyond quartile +- FENCE * max(interquartile range, least spread) of its group, and at the
#: latest at REACH of the way from the quartile to the limit, so each rule can reject something in each group.
FENCE, REACH = 4.0, 0.75
#: A group's sketch counts as much more by this many documents, spread as those of its language are.
PRIOR = 30
#: Bits of a sketch cell's value: cells are at most 2 ** -(CELL_BITS - 1) of their value wide.
CELL_BITS = 9


def statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Counts over each whole text: ``id_col, *keep, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``.

    Null and empty texts have zero everywhere.  Words are runs of other than ASCII white space, compared exactly;
    a line counts if it has a word and as a duplicate if it equals an earlier line, white space included.
    """
    dtypes = dict(documents.dtypes)
    passed = [id_col, *keep]
    rows = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(passed)], F.col(text_col).alias("text"))
    numbers = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([(f"c{i}", K.arrow_type(documents, c)) for i, c in enumerate(passed)] + [(c, pa.int64()) for c in numbers])
    ddl = ", ".join([f"c{i} {dtypes[c]}" for i, c in enumerate(passed)] + [f"{c} bigint" for c in numbers])
    made = rows.mapInArrow(K.map_texts([f"c{i}" for i in range(len(passed))], "text", _count, schema), ddl)
    return made.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(passed)], *numbers)


_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(SYMBOLS)] = 1


def _count(data, offsets, batch):
    words = K.Words(data, offsets, K.NOT_SPACE, K.EXACT)
    in_word = K.NOT_SPACE[data] & K.starts_of_characters(data)
    n_words, lines, repeated = words.counts, _lines(data, offsets, words), _repeated(words)
    return n_words, K.sums_by_document(in_word.astype(np.int64), offsets), K.sums_by_document(_SYMBOL[data], offsets), *lines, repeated


def _lines(data, offsets, words):
    """Lines with a word and, of these, the ones that equal an earlier line of the document."""
    starts, ends = K.runs(data != 10, offsets)
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[has_word], ends[has_word]
    bounds = np.searchsorted(starts, offsets)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return np.diff(bounds), K.sums_by_document(_seen_before(of, K.span_hashes(data, starts, ends, K.EXACT)).astype(np.int64), bounds)


def _seen_before(of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where an earlier entry of the same document has the same hash."""
    order = np.lexsort((np.arange(len(of)), hashes, of))
    same = np.zeros(len(of), dtype=bool)
    same[order[1:]] = (of[order[1:]] == of[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
    return same


def _repeated(words: K.Words) -> np.ndarray:
    """Words inside windows that occur twice or more in their document."""
    first, hashes = words.windows(REPEAT_WINDOW)
    of = words.documents()[first] if len(first) else first
    key = K.mix(hashes + K.mix(of.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    twin = key[order[1:]] == key[order[:-1]]
    many = np.zeros(len(first), dtype=bool)
    many[order[1:]] |= twin
    many[order[:-1]] |= twin
    marked = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    np.add.at(marked, first[many], 1)
    np.add.at(marked, first[many] + REPEAT_WINDOW, -1)
    return K.sums_by_document((np.cumsum(marked[:-1]) > 0).astype(np.int64), words.bounds)


def with_measures(stats: DataFrame) -> DataFrame:
    """The scale-free measures of MEASURES; null where a text has no words."""
    return stats.withColumns({m: F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)) for m, (top, bottom, *_) in MEASURES.items()})


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))


def sketches(measured: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``*groups, measure, cell, n``: quantile sketches, the documents of each group by cell of each measure.

    Cells are fixed and counts are whole numbers, so sketches built map-side merge to the same result in any
    order.  A group has at most a few thousand cells, whatever its size.  Documents that fail the base rules don't count.
    """
    values = [F.struct(F.lit(m).alias("measure"), F.expr(f"({top} * {steps}L) div {bottom}").alias("value")) for m, (top, bottom, steps, *_) in MEASURES.items()]
    rows = measured.where(~base_failed()).select(*groups, F.inline(F.array(*values))).where("value is not null")
    spare = f"CAST(greatest(length(bin(value)) - {CELL_BITS}, 0) AS INT)"
    return rows.groupBy(*groups, "measure", F.expr(f"shiftleft(shiftright(value, {spare}), {spare})").alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def thresholds(measured: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``*groups, low_*, high_*``: the fences of each group with documents that pass the base rules.

    Quartiles come from the group's sketch, to which PRIOR documents spread as its language's (the first of
    ``groups``) are added: small groups lean on their language, large ones don't, without a switch of size.
    All in whole numbers, so the same rows give the same fences.  Null languages and sources are groups.
    """
    own = sketches(measured, groups)
    top = F.struct(F.col(groups[0]))  # a struct, so that null equals null
    by_lang = own.groupBy(top.alias("_lang"), "measure", "cell").agg(F.sum("n").alias("m"))
    sums = by_lang.groupBy("_lang", "measure").agg(F.sum("m").alias("total"))
    every = own.select(F.struct(*groups).alias("_group"), top.alias("_lang"), "measure").distinct()
    spread = every.join(by_lang, ["_lang", "measure"]).join(sums, ["_lang", "measure"])
    held = spread.join(own.select(F.struct(*groups).alias("_group"), "measure", "cell", "n"), ["_group", "measure", "cell"], "left")
    wide = lambda c: c.cast("decimal(38,0)")
    # decimals keep the products of counts exact
    rows = held.withColumn("weight", wide(wide(F.coalesce("n", F.lit(0))) * F.col("total")) + wide(F.lit(PRIOR) * wide(F.col("m"))))
    w = Window.partitionBy("_group", "measure")  # a row for each cell of a sketch
    rows = rows.withColumns({"upto": F.sum("weight").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("weight").over(w)})
    at = lambda quarters: F.min(F.when(F.col("upto") * 4 >= F.col("all") * quarters, F.col("cell")))
    quartiles = rows.groupBy("_group", "measure").agg(at(1).alias("q1"), at(3).alias("q3"))
    wanted = quartiles.groupBy("_group").agg(*[F.max(F.when(F.col("measure") == m, F.struct("q1", "q3"))).alias(m) for m in MEASURES])
    out = []
    for m, (_, _, steps, least, limit) in MEASURES.items():
        low, high = (F.col(f"{m}.{q}") / F.lit(float(steps)) for q in ("q1", "q3"))
        width = F.lit(FENCE) * F.greatest(high - low, F.lit(least))
        above = width if limit is None else F.least(width, (F.lit(limit) - high) * REACH)
        out += [(low - width).alias(f"low_{m}"), (high + above).alias(f"high_{m}")]
    return wanted.select("_group.*", *out)


def verdicts(measured: DataFrame, fences: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Adds ``base_failed``, ``failed_rules`` (names of the adaptive rules that a document breaks) and ``kept``.

    A document without words has no measures and breaks no adaptive rule.
    """
    right = fences.select(*[F.col(g).alias(f"_{g}") for g in groups], *[c for c in fences.columns if c not in groups])
    on = [measured[g].eqNullSafe(right[f"_{g}"]) for g in groups]
    joined = measured.join(right, functools.reduce(lambda a, b: a & b, on), "left")
    broken = [F.when((F.col(m) > F.col(f"high_{m}")) | ((F.col(m) < F.col(f"low_{m}")) if m == "mean_word" else F.lit(False)), F.lit(m)) for m in MEASURES]
    judged = joined.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.filter(F.array(*broken), lambda x: x.isNotNull()))
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return judged.drop(*right.columns)


def quality_rules(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Statistics, base verdict, adaptive verdict and ``kept`` of every document; repeated rows each get theirs."""
    scratch = Scratch(documents.sparkSession, "rules")
    measured = scratch.write(with_measures(statistics(documents, id_col, text_col, groups)), "measured")
    return verdicts(measured, scratch.write(thresholds(measured, groups), "fences"), groups)
