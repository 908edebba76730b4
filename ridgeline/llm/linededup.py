"""Line dedup: MinHash over character shingles, banding, exact confirmation, union-find, one line kept per component."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .minhash import band_keys, signatures
from .pairs import sketches
from .search import connected, distinct_buckets
from .storage import Scratch

#: Characters in a shingle and the similarity (percent) from which lines are linked.
SHINGLE, PERCENT = 8, 80
#: 12 bands of 3 bins: a pair at similarity 0.8 shares no bucket with probability (1 - 0.8^3)^12 = 0.0002.
BANDS, ROWS = 12, 3
#: Lines of fewer characters (without white space at the ends) all stay.
LEAST_CHARS = 1
#: Slots (a power of two) of a task's table of classes that it has already given keys for.
SEEN_BITS = 18
#: A bucket of more than this share of all rows is hot: its rows are dealt out instead of streaming through one task.
HOT_SHARE = 1 / 2048
#: Cells of a line's sketch: 2 ** SKETCH_BITS.
SKETCH_BITS = 9
#: One row in this many, by hash, is counted to find the hot buckets.
HOT_SAMPLE = 64
#: (Key, class) pairs that a task deals out at a time, and about as many that a part gets.
DEAL_ROWS, PART_ROWS = 1 << 20, 1 << 17
#: Shingles of pairs of lines (or one pair) that are compared at a time.
PAIR_ITEMS = 1 << 18
#: Parts that a task takes, one after the other.
PARTS_A_TASK = 4


#: Factors of a character's second to fourth byte in its value.
_CONTINUED = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Characters:
    """The characters of a block of UTF-8 bytes: how many start before each byte (and the end), and prefix sums of their values.

    A-Z are lowered.  Sums are those of ``K.prefix_sums``, over characters instead of bytes.
    """

    def __init__(self, data: np.ndarray):
        values = K.FOLDED.take(data)
        if not len(data) or data.max() < 0x80:
            self.before = np.arange(len(data) + 1)
        else:
            values, self.before = self._wide(data, values)
        self.n = n = len(values)
        up, self.down = K.powers(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        values *= up[:n]
        np.cumsum(values, out=self.sums[1:])

    @staticmethod
    def _wide(data: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        heads = np.append(K.starts_of_characters(data), True)
        before = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(heads[:-1], out=before[1:])
        wide = np.flatnonzero(data >= 0xC0)
        own, which, at = values[wide], np.arange(len(wide)), wide
        for factor in _CONTINUED:  # continuation bytes count into their character's value
            on = np.flatnonzero(~heads[at + 1])
            which, at = which[on], at[on] + 1
            own[which] += values[at] * factor
        values[wide] = K.mix(own)
        return values[heads[:-1]], before

    def hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each run of characters."""
        return K.mix((self.sums[last] - self.sums[first]) * self.down[first] + (last - first).astype(np.uint64))


def _trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without ASCII white space at their ends; those of white space alone are left out."""
    some = np.flatnonzero(ends > starts)
    starts, ends = starts[some], ends[some]
    if not (K.SPACE[data[starts]] | K.SPACE[data[ends - 1]]).any():
        return starts, ends
    inked = np.flatnonzero(K.NOT_SPACE[data])
    a, b = np.searchsorted(inked, starts), np.searchsorted(inked, ends)
    some = np.flatnonzero(b > a)
    return inked[a[some]], inked[b[some] - 1] + 1


class Lines:
    """The lines of a block that are long enough: spans trimmed of ASCII white space, hash with A-Z lowered."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, least: int):
        self.characters = Characters(data)
        newlines = np.flatnonzero(data == 10)
        starts, ends = _trimmed(data, np.sort(np.r_[offsets[:-1], newlines + 1]), np.sort(np.r_[newlines, offsets[1:]]))
        before = self.characters.before
        self.first, self.last = before[starts], before[ends]
        long = self.last - self.first >= least
        starts, self.first, self.last = starts[long], self.first[long], self.last[long]
        self.of = np.searchsorted(offsets, starts, "right") - 1
        self.numbers = np.searchsorted(newlines, starts) - np.searchsorted(newlines, offsets[:-1])[self.of]
        self.classes = self.characters.hashes(self.first, self.last).view(np.int64)

    def at_least(self, size: int) -> np.ndarray:
        """Which lines have as many characters."""
        return self.last - self.first >= size

    def shingles(self, size: int, which: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(line, hash) of the shingles of the lines, or of those named, which are then counted from 0; a shorter line is one shingle."""
        own, first, last = self.characters, self.first[which], self.last[which]
        counts = last - first - (size - 1)
        short = np.flatnonzero(counts < 1)
        counts = np.maximum(counts, 0)
        of = np.repeat(np.arange(len(first)), counts)
        whole = own.sums[size:] - own.sums[:-size] if own.n >= size else own.sums[:0]
        whole *= own.down[: len(whole)]
        turns = np.stack([first, first + counts], axis=1).ravel()  # the places where shingles of a line begin and stop
        inside = np.repeat(np.arange(len(turns) + 1) % 2 == 1, np.diff(np.r_[0, turns, max(len(whole), turns[-1] if len(turns) else 0)]))
        hashes = K.mix(whole[inside[: len(whole)]])
        if len(short):
            of, hashes = np.r_[of, short], np.r_[hashes, own.hashes(first[short], last[short])]
        return of, hashes


def _scan(rows: DataFrame, least: int, size: int) -> DataFrame:
    """``cls, id, digest, line, keys``: every line that is long enough with its class (hash), and its class's band keys
    where the task hasn't given them before.

    A table of fixed size holds the last class of each slot, so a line that is everywhere gives few keys per task.
    A line shorter than a shingle has no keys: only an equal line, which is of its class, has its set.
    """
    schema = pa.schema([("cls", pa.int64()), ("id", pa.int64()), ("digest", pa.int64()), ("line", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def task(batches):
        last = np.zeros(1 << SEEN_BITS, dtype=np.int64)
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(2))
            for first, end, block, own in K.blocks(data, offsets):
                lines = Lines(block, own, least)
                slot = lines.classes & ((1 << SEEN_BITS) - 1)
                fresh = (last[slot] != lines.classes) & lines.at_least(size)
                new = np.flatnonzero(fresh)
                last[slot[new]] = lines.classes[new]
                of, hashes = lines.shingles(size, new)
                keys = band_keys(signatures(of, hashes, len(new), BANDS * ROWS), BANDS)
                listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(fresh * BANDS)].astype(np.int32)), pa.array(keys.ravel()))
                at = pa.array(lines.of + first)
                yield pa.RecordBatch.from_arrays([pa.array(lines.classes), batch.column(0).take(at), batch.column(1).take(at), pa.array(lines.numbers.astype(np.int32)), listed], schema=schema)

    return rows.select("id", "digest", "text").mapInArrow(task, "cls bigint, id bigint, digest bigint, line int, keys array<bigint>")


def _dealt(lines: DataFrame, hot: list[int], parts: int) -> DataFrame:
    """``part, keys, classes``: the (key, class) pairs of the lines as int64 arrays, dealt by key into parts.

    Pairs of hot buckets are dealt by key and class into as many parts more.
    """
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("classes", pa.binary())])
    hot_keys = np.array(sorted(hot), dtype=np.int64)

    def deal(keys: np.ndarray, classes: np.ndarray) -> pa.RecordBatch:
        hashed = keys.view(np.uint64)
        part = ((hashed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        if len(hot_keys):
            often = np.flatnonzero(hot_keys[np.minimum(np.searchsorted(hot_keys, keys), len(hot_keys) - 1)] == keys)
            part[often] = parts + ((K.mix(hashed[often] ^ classes[often].view(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(part.astype(np.uint16) if 2 * parts <= 1 << 16 else part, kind="stable")
        counts = np.bincount(part, minlength=2 * parts)
        there = np.flatnonzero(counts)
        bounds = pa.py_buffer((np.r_[0, np.cumsum(counts[there])] * 8).astype(np.int32))
        arrays = [pa.Array.from_buffers(pa.binary(), len(there), [None, bounds, pa.py_buffer(x[order])]) for x in (keys, classes)]
        return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), *arrays], schema=schema)

    def task(batches):
        held, n = [], 0
        for batch in batches:
            lists = batch.column(1)
            keys = lists.flatten().to_numpy()
            held.append((keys, np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy())))
            n += len(keys)
            if n >= DEAL_ROWS:
                yield deal(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield deal(*map(np.concatenate, zip(*held)))

    return lines.select("cls", "keys").mapInArrow(task, "part int, keys binary, classes binary")


def _shared(dealt: DataFrame, parts: int) -> DataFrame:
    """``key, cls``: the distinct pairs of dealt(part, keys, classes) in the buckets that hold two classes or more, and of hot ones."""
    schema = pa.schema([("key", pa.int64()), ("cls", pa.int64())])

    def found(part: int, keys: list[bytes], classes: list[bytes]) -> pa.RecordBatch:
        keys, classes = (np.frombuffer(b"".join(x), dtype=np.int64) for x in (keys, classes))
        if part < parts:  # most buckets hold one pair
            order = np.argsort(keys)
            keys, classes = keys[order], classes[order]
            twice = _repeated(keys)
            keys, classes = keys[twice], classes[twice]
        order = np.lexsort((classes, keys))
        keys, classes = keys[order], classes[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (classes[1:] != classes[:-1])
        keys, classes = keys[new], classes[new]
        if part < parts:
            twice = _repeated(keys)
            keys, classes = keys[twice], classes[twice]
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(classes)], schema=schema)

    def task(batches):
        part, held = None, ([], [])
        for batch in batches:
            for own, keys, classes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if own != part and part is not None:
                    yield found(part, *held)
                    held = ([], [])
                part = own
                held[0].append(keys.as_py())
                held[1].append(classes.as_py())
        if part is not None:
            yield found(part, *held)

    return dealt.repartition(1 + parts // PARTS_A_TASK, "part").sortWithinPartitions("part").mapInArrow(task, "key bigint, cls bigint")


def _repeated(values: np.ndarray) -> np.ndarray:
    """Which elements are equal to the one before or after."""
    out = np.zeros(len(values), dtype=bool)
    out[1:] = values[1:] == values[:-1]
    out[:-1] |= out[1:]
    return out


def _members(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, n, id`` of the different buckets that n >= 2 classes share.

    Keys travel in arrays, dealt into parts of about PART_ROWS pairs by the number of rows, which a hashed sample
    estimates.  Hot buckets, which the sample names (at most 1 / HOT_SHARE of them), are dealt out over all
    parts.  Which way a bucket goes doesn't change its rows.
    """
    bands = lines.select(F.explode("keys").alias("key"), "cls")
    sample = scratch.write(bands.where(F.pmod("cls", F.lit(HOT_SAMPLE)) == 0).groupBy("key").count(), "sample")
    sampled = sample.agg(F.sum("count")).first()[0] or 0
    hot = [r.key for r in sample.where(F.col("count") > max(HOT_SHARE * sampled, HOT_SAMPLE)).select("key").collect()]
    parts = 1 + sampled * HOT_SAMPLE // PART_ROWS
    found = scratch.write(_shared(_dealt(lines, hot, parts), parts).select("key", F.col("cls").alias("id")), "shared")
    return scratch.write(found.join(distinct_buckets(found), "key").select("key", "n", "id"), "members")


def _line_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id`` (the class), ``text`` of the wanted(cls, id, digest, line) lines, from rows(id, digest, text).

    A document's wanted lines are gathered beside its text, so a row is bounded by a document.
    """
    listed = wanted.groupBy("id", "digest").agg(F.collect_list(F.struct("line", "cls")).alias("lines"))
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def task(batches):
        for batch in batches:
            lists = batch.column(1)
            wanted, bounds = lists.flatten(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())].tolist()
            numbers, found = wanted.field("line").to_pylist(), []
            for text, i, j in zip(batch.column(0), bounds, bounds[1:]):
                parts = text.as_py().split("\n")
                found += [parts[k] for k in numbers[i:j]]
            yield pa.RecordBatch.from_arrays([wanted.field("cls"), pa.array(found, pa.string())], schema=schema)

    return rows.join(listed.hint("shuffle_hash"), ["id", "digest"]).select("text", "lines").mapInArrow(task, "id bigint, text string").dropDuplicates(["id"])


def _line_sets(texts: DataFrame, size: int) -> DataFrame:
    """``id, size, cells``: the size and sketch of each line's set of shingles."""
    schema = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("cells", pa.binary())])

    def work(data, offsets, batch):
        lines, n = Lines(data, offsets, 0), len(offsets) - 1
        of, hashes = _sets(lines, size)
        return np.bincount(of, minlength=n), sketches(of, hashes, n, SKETCH_BITS)

    return texts.mapInArrow(K.map_texts(["id"], "text", work, schema), "id bigint, size bigint, cells binary")


def _sets(lines: Lines, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of one-line documents, ascending; hashes have their 48 high bits.

    Lines with a key have ``size`` characters or more, so a block has fewer than 2 ** 16 of them.
    """
    of, hashes = lines.shingles(size)
    keyed = K.distinct(lines.of[of].astype(np.uint64) << np.uint64(48) | hashes >> np.uint64(16))
    return (keyed >> np.uint64(48)).astype(np.int64), keyed << np.uint64(16)


def _confirmed(edges: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The edges(a, b) whose lines' whole shingle sets reach the similarity."""
    left, right = (texts.select(F.col("id").alias(end), F.col("text").alias(f"text_{end}")) for end in "ab")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def sets(column) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, bounds) of the distinct shingles of each text."""
        data, offsets = K.text_buffers(column)
        hashes, counts = [np.zeros(0, np.uint64)], []
        for first, end, block, own in K.blocks(data, offsets):
            of, found = _sets(Lines(block, own, 0), size)
            hashes.append(found)
            counts.append(np.bincount(of, minlength=end - first))
        return np.concatenate(hashes), np.r_[0, np.cumsum(np.concatenate(counts))]

    def numbered(hashes, bounds, texts):
        """The hashes of each of these texts, with the text's place in the list in the 16 high bits."""
        counts = bounds[texts + 1] - bounds[texts]
        place = np.repeat(np.arange(len(texts)), counts)
        at = np.arange(len(place)) + np.repeat(bounds[texts] - np.r_[0, np.cumsum(counts)[:-1]], counts)
        return place.astype(np.uint64) << np.uint64(48) | hashes[at] >> np.uint64(16)

    def links(batch: pa.RecordBatch) -> np.ndarray:
        """Which edges are links; a text of many edges is taken apart once."""
        ends = [batch.column(i).to_numpy() for i in (0, 1)]
        _, at, own = np.unique(np.concatenate(ends), return_index=True, return_inverse=True)
        hashes, bounds = sets(pa.concat_arrays([batch.column(2), batch.column(3)]).take(pa.array(at)))
        a, b = own[: batch.num_rows], own[batch.num_rows :]
        sizes = np.diff(bounds)
        total, out = sizes[a] + sizes[b], np.zeros(batch.num_rows, dtype=bool)
        near = np.flatnonzero(100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b]))
        ends = np.cumsum(total[near])
        start = 0
        while start < len(near):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIR_ITEMS, "right")))
            own = near[start:end]
            both = np.concatenate([numbered(hashes, bounds, a[own]), numbered(hashes, bounds, b[own])])
            both.sort(kind="stable")
            common = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(48)).astype(np.int64), minlength=len(own))
            out[own] = 100 * common >= percent * (total[own] - common)
            start = end
        return out

    def task(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 1 << 14):
                batch = whole.slice(start, 1 << 14)
                yield batch.select(["a", "b"]).filter(pa.array(links(batch))).cast(schema)

    return edges.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(task, "a bigint, b bigint")


def repeated_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, least: int = LEAST_CHARS) -> DataFrame:
    """``id, digest, removed array<int>``: per document, the numbers (from 0) of the lines that repeat a kept one.

    A document is an id and a text, whose xxhash64 is the digest.  Lines (split at ``\\n``) of at least ``least``
    characters are compared without ASCII white space at their ends and with A-Z lowered.  Equal lines are one
    class; classes are linked if their sets of ``shingle``-character shingles have a Jaccard similarity of at
    least ``percent`` / 100, confirmed on the whole lines; a line shorter than a shingle is only linked with equal
    ones.  Every two classes that share a band are compared or ruled out by a bound (``search.connected``).  Of
    each connected component the line with the smallest (id, digest, number) stays.

    Null and empty texts have no lines.  Rows with the same id and text are one document and share its cuts;
    rows with the same id and different texts are documents of their own.  Rows without an id are neither kept
    lines nor removed from.  ``id_col`` is an integer column.
    """
    scratch = Scratch(documents.sparkSession, "linededup")
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    lines = scratch.write(_scan(rows, least, shingle), "lines")
    members = _members(lines, scratch)
    classes = scratch.write(lines.groupBy("cls").agg(F.min(F.struct("id", "digest", "line")).alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    wanted = classes.join(members.select(F.col("id").alias("cls")).distinct(), "cls", "left_semi").select("cls", "first.*")
    texts = scratch.write(_line_texts(rows, wanted), "texts")
    labels = connected(members, lambda ids: _line_sets(texts.join(ids, "id", "left_semi"), shingle), lambda edges: _confirmed(edges, texts, shingle, percent), scratch, percent)
    united = classes.join(labels.withColumnRenamed("id", "cls"), "cls")
    keepers = united.groupBy("component").agg(F.min("first").alias("keeper"))
    linked = united.join(keepers, "component").select("cls", "keeper")
    alone = classes.where("n > 1").join(labels.select(F.col("id").alias("cls")), "cls", "left_anti").select("cls", F.col("first").alias("keeper"))
    repeated = scratch.write(linked.union(alone), "repeated")
    gone = lines.join(repeated, "cls").where(F.struct("id", "digest", "line") != F.col("keeper"))
    found = scratch.write(gone.groupBy("id", "digest").agg(F.array_sort(F.collect_set("line")).alias("removed")), "removed")
    scratch.keep(found)
    return found


def drop_repeated_lines(documents: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without their repeated lines, all columns kept, with ``n_lines`` and ``n_removed`` added.

    ``removed`` is the result of ``repeated_lines``.  A document all of whose lines with ink were removed keeps
    an empty text.  Null texts stay null, with 0 lines.  Where the documents have columns of these names, they
    stay and the added names get an underscore.
    """
    gone_id, digest, gone, total, cut = K.unused(documents, "gone_id", "gone_digest", "gone", "n_lines", "n_removed")
    found = removed.select(F.col("id").alias(gone_id), F.col("digest").alias(digest), F.col("removed").alias(gone))
    joined = documents.join(found.hint("shuffle_hash"), (F.col(id_col) == F.col(gone_id)) & (F.xxhash64(text_col) == F.col(digest)), "left")
    newlines = F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(newlines + 1).cast("bigint")
    counted = joined.withColumns({total: n_lines, cut: F.greatest(F.coalesce(F.size(gone), F.lit(0)), F.lit(0)).cast("bigint")})
    hit = F.col(gone).isNotNull()
    left = _without(F.when(hit, F.col(text_col)), F.col(gone))  # texts without cuts don't leave the JVM
    return counted.withColumn(text_col, F.when(hit, left).otherwise(F.col(text_col))).drop(gone_id, digest, gone)


def _without(text, numbers):
    """The texts without the lines of these numbers; empty if no ink is left."""

    def cut(texts: pd.Series, lists: pd.Series) -> pd.Series:
        def one(text, own):
            if text is None:
                return None
            gone = set(own.tolist())
            left = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
            return left if left.strip(" \t\n\v\f\r") else ""

        return pd.Series([one(t, own) for t, own in zip(texts, lists)], dtype=object)

    return F.pandas_udf(cut, "string")(text, numbers)
