"""Spelling variants: words at edit distance one, found by the three rarest of their positional bigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

#: The letters of a word, the capitals that are lowered, and one in how many runs loses a code point.
LETTERS = r"[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DELETED_ONE_IN = 199
#: Words have at least so many code points and occurrences; a form occurs at least so many times as often as its variant.
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 6, 5, 5
#: One edit destroys at most two bigrams, so of a word's three rarest one is left in every word one edit away.
PREFIX = 3


def _lowered(run: Column) -> Column:
    """A-Z lowered and nothing else; plain ASCII, the usual case, takes the faster way."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, CAPITALS, SMALL))


def word_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, deleted_one_in: int = DELETED_ONE_IN) -> DataFrame:
    """``word, n`` of all runs of letters of whole texts.

    Where ``deleted_one_in`` divides the crc32 of ``<id>:<run>``, the run loses the code point at that number modulo
    its length, which plants misspellings; a null id counts as empty there.  Null and empty texts have no words.
    Only words of ``least_length`` code points and ``least_count`` occurrences are returned.
    """
    owner = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"))
    runs = documents.select(owner.alias("owner"), F.explode(F.regexp_extract_all(text_col, F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= least_length).select("owner", _lowered(F.col("run")).alias("run"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    hashed = runs.select("run", F.crc32(F.concat("owner", "run")).alias("h")).withColumn("at", at)
    words = hashed.select(F.when(F.col("h") % deleted_one_in == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def rarest_bigrams(words: DataFrame) -> DataFrame:
    """``word, n, gram, pos``: of each word the bigrams, counted from 0, that the fewest places of all words hold.

    The frequencies have a row for each pair of letters, so they are broadcast whatever the number of words.
    """
    places = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.struct(F.substring(F.col("word"), i, F.lit(2)).alias("gram"), (i - 1).alias("pos")))
    grams = words.select("word", "n", F.explode(places).alias("at")).select("word", "n", "at.*")
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    rare = grams.join(F.broadcast(often), "gram").groupBy("word", "n").agg(F.slice(F.sort_array(F.collect_list(F.struct("often", "gram", "pos"))), 1, PREFIX).alias("rare"))
    return rare.select("word", "n", F.explode("rare").alias("at")).select("word", "n", "at.gram", "at.pos")


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: every ordered pair of words that one inserted, deleted or replaced code point parts.

    Words one edit apart share one of their three rarest bigrams at positions at most one apart, and the edit lies on
    one side of it: the other side, bigram included, is equal, which fixes the positions.  The side with the edit is
    halved at the middle of the shorter word's, and the half without it is equal too.  All this is the key of a join;
    every pair found is verified.  Spark counts an exploded row once, so it would broadcast the keys of many words: the
    join is a merge join.
    """
    before = F.struct(F.lit("before").alias("side"), F.expr("substring(word, 1, pos + 2)").alias("part"), F.expr("substring(word, pos + 3)").alias("rest"))
    behind = F.struct(F.lit("behind").alias("side"), F.expr("substring(word, pos + 1)").alias("part"), F.expr("substring(word, 1, pos)").alias("rest"))
    index = rarest_bigrams(words).select("word", "n", F.char_length("word").alias("size"), F.explode(F.array(before, behind)).alias("at")).select("word", "n", "size", "at.*")

    def keyed(rows: DataFrame, size: Column, left: Column) -> DataFrame:
        """A row for each half of ``rest``, of which the shorter word, of ``size``, has ``left`` code points."""
        halves = F.array(F.struct(F.lit("first").alias("half"), F.expr("substring(rest, 1, left div 2)").alias("same")), F.struct(F.lit("last").alias("half"), F.expr("right(rest, left - left div 2)").alias("same")))
        rows = rows.withColumn("size", size).withColumn("left", left).where("left >= 0")
        return rows.select("word", "n", "side", "part", "size", F.explode(halves).alias("h")).select("word", "n", F.xxhash64("side", "part", "size", "h.half", "h.same").alias("key"))

    own = F.char_length("rest")
    shorter = keyed(index, F.col("size"), own)
    other = shorter.union(keyed(index, F.col("size") - 1, own - 1)).select(F.col("word").alias("other"), F.col("n").alias("other_n"), "key")
    met = shorter.join(other.hint("merge"), "key").where((F.char_length("word") < F.char_length("other")) | (F.col("word") < F.col("other")))
    pairs = met.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").distinct()
    both = F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return pairs.select(both.alias("pair")).select("pair.*")


def group_variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO, deleted_one_in: int = DELETED_ONE_IN) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of each word of the corpus.

    ``form`` is the near word of the largest n (of several, the first in code-point order) if that is at least
    ``ratio`` times the word's own; ``root`` is where following forms ends, the word itself where it has none.
    ``ratio`` must be over 1, so forms can't lead in a circle.  No text, or none with such words: no rows.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1")
    scratch = Scratch(documents.sparkSession, "spelling")
    words = scratch.write(word_counts(documents, id_col, text_col, least_length, least_count, deleted_one_in), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other")))
    near = near_pairs(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    common = -F.col("best.rank") >= ratio * F.col("n")
    near = scratch.write(near.select("word", "n_near", F.when(common, F.col("best.other")).alias("form"), F.when(common, -F.col("best.rank")).alias("form_n")), "near")
    roots = scratch.write(near.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    moved = True
    while moved:  # each round doubles the steps taken; n grows by the ratio with each step, so there are at most 63 / log2(ratio) steps
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = scratch.write(roots.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        scratch.drop(roots)
        moved = bool(further.where("moved").take(1))
        roots = further.drop("moved")
        roots._scratch_path = further._scratch_path
    scratch.keep(words, near, roots)
    found = words.join(near.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left")  # their files are much smaller than their rows
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
