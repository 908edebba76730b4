"""Search for linked pairs over buckets: stars, bridges between groups, then every pair of groups that is left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .pairs import cross_pairs
from .storage import Scratch

#: Rounds of bridges go on while at least this share of a round's edges are links.
WORTHWHILE = 0.2


def distinct_buckets(rows: DataFrame) -> DataFrame:
    """``key, n`` of the buckets of rows(key, id) with n >= 2 rows; of buckets that hold the same ids one.

    Two sets of ids count as the same if their sizes and two sums of 31-bit hashes agree.
    """
    prints = [F.sum(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 31))).alias(f"h{salt}") for salt in (1, 2)]
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *prints).where("n > 1")
    return shared.groupBy("n", "h1", "h2").agg(F.min("key").alias("key")).select("key", "n")


def _stars(members: DataFrame) -> DataFrame:
    """Edges from each bucket's centre to its other ids.

    The centre is the id that meets most others over all its buckets (ties: the smallest), which in a group
    of variants of one text is the text that they vary, so that most of the group is similar to it.
    """
    weights = members.groupBy("id").agg(F.sum("n").alias("weight"))
    weighted = members.join(weights, "id")
    centres = weighted.groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("top")).select("key", (-F.col("top.id")).alias("centre"))
    return members.join(centres, "key").where("id != centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, id, component`` of the buckets of three ids or more that are not all in one component yet; in smaller
    buckets the star has compared all there is."""
    grouped = members.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    still = grouped.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("n > 2 and low != high")
    return grouped.join(still.select("key"), "key", "left_semi")


def _bridges(grouped: DataFrame, turn: int) -> DataFrame:
    """Edges between the groups that share a bucket: from one id of its largest group to one of each other group.

    The ids are drawn by a hash of bucket and turn, so the buckets that two groups share, and later turns,
    try different ones.  A bucket gives at most as many edges as it holds groups.
    """
    drawn = grouped.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("id", "key", F.lit(turn)).alias("h"), "id")).alias("d")).select("key", "component", "n", F.col("d.id").alias("id"))
    hubs = drawn.groupBy("key").agg(F.max(F.struct("n", "component", "id")).alias("hub")).select("key", F.col("hub.id").alias("hub"))
    return drawn.join(hubs, "key").where("id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _united(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """The labels(id, component) when ``links`` connect some of the components; ids that had no label get one."""
    of = labels.select(F.col("id"), F.col("component"))
    ends = [F.coalesce(F.col(f"{e}_of"), F.col(e)).alias(e) for e in "ab"]
    named = links.join(of.toDF("a", "a_of"), "a", "left").join(of.toDF("b", "b_of"), "b", "left").select(*ends).where("a != b").distinct()
    moved = components(named, scratch).withColumnRenamed("id", "old").withColumnRenamed("component", "new")
    kept = labels.join(moved, labels["component"] == moved["old"], "left").select("id", F.coalesce("new", "component").alias("component"))
    fresh = moved.select(F.col("old").alias("id"), F.col("new").alias("component")).join(labels, "id", "left_anti")
    return scratch.write(kept.union(fresh), "labels")


def connected(members: DataFrame, sketched: Callable[[DataFrame], DataFrame], confirmed: Callable[[DataFrame], DataFrame], scratch: Scratch, percent: int, worthwhile: float = WORTHWHILE, known: DataFrame | None = None) -> DataFrame:
    """``id, component`` of the ids that confirmed links connect.

    ``members(key, n, id)``: the ids of each bucket of n >= 2 ids; ``sketched(ids(id))``: their ``id, size, cells``, see
    ``pairs``;
    ``confirmed(edges(a, b))``: the edges that are links; ``known(a, b)``: links given beforehand.  Candidate
    edges are stars: each bucket links its centre with its other ids; then, round by round, one id of its largest
    group with one of each other group, while the share ``worthwhile`` of a round's edges are links.  These rounds
    only make groups large quickly: afterwards every pair of different groups that share a bucket is compared, or
    ruled out by a bound on what it has in common, so the result doesn't depend on them.
    """
    tried = scratch.write(_stars(members), "candidates")
    links = scratch.write(confirmed(tried), "links")
    labels = components(links if known is None else links.union(known), scratch)
    grouped, turn = scratch.write(_mixed(members, labels), "mixed"), 0
    while not grouped.isEmpty():
        fresh = scratch.write(_bridges(grouped, turn).join(tried, ["a", "b"], "left_anti"), "candidates")
        more = scratch.write(confirmed(fresh), "links")
        asked, found = fresh.count(), more.count()
        tried, turn = tried.union(fresh), turn + 1
        if found:
            labels = _united(labels, more, scratch)
            before, grouped = grouped, scratch.write(_mixed(grouped.select("key", "id"), labels), "mixed")
            scratch.drop(before)
        if found <= worthwhile * asked:
            break
    held = scratch.write(sketched(grouped.select("id").distinct()), "sketches")
    last = scratch.write(cross_pairs(grouped, held, percent).join(tried, ["a", "b"], "left_anti"), "candidates")
    more = scratch.write(confirmed(last), "links")
    return labels if more.isEmpty() else _united(labels, more, scratch)
