"""MinHash near-duplicates: one-permutation signatures, banded buckets, star-shaped candidate edges, all pairs of groups left, exact confirmation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .minhash import band_keys, signatures
from .pairs import sketches
from .search import WORTHWHILE, connected
from .storage import Scratch

#: Words in a shingle and the similarity (percent) from which documents are linked.
SHINGLE, PERCENT = 5, 80
#: 32 bands of 4 bins: a pair at similarity 0.8 shares no bucket with probability (1 - 0.8^4)^32 = 5e-8.
BANDS, ROWS = 32, 4


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each document's distinct shingles, ascending by both.

    Words are runs of other than ASCII white space with A-Z lowered; a text of fewer words has its whole
    word sequence as one shingle, one without words has none.
    """
    words = K.Words(data, offsets, K.NOT_SPACE, K.FOLDED)
    counts = words.counts
    first, hashes = words.windows(size)
    of = words.documents()[first] if len(first) else first
    extra_of, extra = [], []
    for k in range(1, size):
        own = np.flatnonzero(counts == k)
        if len(own):
            starts, values = words.windows(k)
            at = np.searchsorted(starts, words.bounds[own])
            extra_of.append(own)
            extra.append(K.mix(values[at] + np.uint64(k)))
    of, hashes = np.concatenate([of, *extra_of]), np.concatenate([hashes, *extra])
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])
    return of[new], hashes[new]


def _sign(size: int):
    """Set size, fingerprint of the whole set and band keys of each document."""

    def work(data, offsets, batch):
        n = len(offsets) - 1
        of, hashes = shingle_sets(data, offsets, size)
        bounds = np.searchsorted(of, np.arange(n + 1))
        sizes = np.diff(bounds)
        prints = [_sum(K.mix(hashes ^ np.uint64(salt)), bounds) for salt in (0x1234567, 0x89ABCDEF0)]
        keys = band_keys(signatures(of, hashes, n, BANDS * ROWS), BANDS)
        listed = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(sizes > 0, BANDS, 0))].astype(np.int32)), pa.array(keys[sizes > 0].ravel()))
        return sizes, *[x.view(np.int64) for x in prints], listed

    return work


def _sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:], dtype=np.uint64)
    return K.mix(total[bounds[1:]] - total[bounds[:-1]])


def _sets(documents: DataFrame, size: int) -> DataFrame:
    """``id, set, cells`` (the set's sketch) of documents(id, text)."""
    kind = dict(documents.dtypes)["id"]
    schema = pa.schema([("id", K.arrow_type(documents, "id")), ("set", pa.list_(pa.int64())), ("cells", pa.binary())])

    def work(data, offsets, batch):
        of, hashes = shingle_sets(data, offsets, size)
        listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(offsets))).astype(np.int32)), pa.array(hashes.view(np.int64)))
        return listed, sketches(of, hashes, len(offsets) - 1)

    return documents.mapInArrow(K.map_texts(["id"], "text", work, schema), f"id {kind}, set array<bigint>, cells binary")


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges(a, b) whose whole sets reach the similarity."""
    left, right = (sets.select(F.col("id").alias(end), F.col("set").alias(f"set_{end}")) for end in "ab")
    pairs = edges.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.where(F.lit(100) * common >= F.lit(percent) * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def _members(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, n, id`` of the buckets that n >= 2 ids share."""
    rows = keys.select(F.explode("keys").alias("key"), "id")
    shared = scratch.write(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    return scratch.write(rows.join(shared, "key").select("key", "n", "id"), "members")


def _same_id(signed: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Links between the classes of ids that have texts of several classes; None without such ids."""
    of = F.struct("f1", "f2", "n")
    several = scratch.write(signed.groupBy("id").agg(F.min(of).alias("low"), F.max(of).alias("high")).where("low != high").select("id"), "several")
    if several.isEmpty():
        return None
    held = signed.join(several, "id").join(classes, ["f1", "f2", "n"]).select("id", "first").distinct()
    return scratch.write(held.join(held.groupBy("id").agg(F.min("first").alias("a")), "id").where("a != first").select("a", F.col("first").alias("b")).distinct(), "links")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, worthwhile: float = WORTHWHILE) -> DataFrame:
    """``id_col, n_shingles, component_id, kept``, a row for each document.

    Documents whose sets of word shingles have a Jaccard similarity of at least ``percent`` / 100 are linked;
    a component is what links connect, named by its smallest id, which is the one kept.  Equal sets are one
    class and only the class's smallest id is compared, so exact copies cost a row each.  Every link is
    confirmed on the whole sets; candidates are searched as ``search.connected`` says, so each pair that shares a
    bucket is linked if it is similar enough, whatever the other members of the bucket are.

    Null and empty texts have no shingles and are linked with nothing.  Rows with the same id count as one
    document whose texts may each give links.  Rows without an id are not linked and are kept.  ``id_col``
    is an integer column.
    """
    scratch = Scratch(documents.sparkSession, "neardup")
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("keys", pa.list_(pa.int64()))])
    signed = scratch.write(rows.mapInArrow(K.map_texts(["id"], "text", _sign(shingle), schema), "id bigint, n bigint, f1 bigint, f2 bigint, keys array<bigint>"), "signed")
    inner = signed.where("n > 0 and id is not null")
    classes = scratch.write(inner.groupBy("f1", "f2", "n").agg(F.min("id").alias("first")), "classes")
    firsts = classes.select(F.col("first").alias("id"), "f1", "f2", "n")
    members = _members(inner.select("id", "f1", "f2", "n", "keys").join(firsts, ["id", "f1", "f2", "n"], "left_semi").select("id", "keys").distinct(), scratch)
    sets = scratch.write(_sets(rows.join(members.select("id").distinct(), "id", "left_semi"), shingle).distinct(), "sets")
    labels = connected(members, lambda ids: sets.join(ids, "id", "left_semi").select("id", F.size("set").alias("size"), "cells"), lambda edges: _confirmed(edges, sets, percent), scratch, percent, worthwhile, _same_id(inner, classes, scratch))
    grouped = classes.join(labels, classes["first"] == labels["id"], "left").select("f1", "f2", "n", F.coalesce("component", "first").alias("component"))
    grouped = scratch.write(grouped, "grouped")
    scratch.keep(signed, grouped)
    out = signed.select("id", "n", "f1", "f2").join(grouped, ["f1", "f2", "n"], "left").withColumn("component", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
