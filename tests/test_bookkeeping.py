"""Tables that change together, validation, lifecycles and profiles by date."""

import datetime

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import constraints, lifecycle, profiles
from ridgeline.operators.tables import Conflict, Tables

NAMES = ("tracks", "segments", "points", "splits", "renderings", "cells")


def rows_of(spark, ids, note):
    return {name: spark.createDataFrame([(i, k, note) for i in ids for k in range(1 + n)], "track_id long, k int, note string") for n, name in enumerate(NAMES)}


def state(store):
    return {name: sorted(map(tuple, store.read(name).collect())) for name in NAMES}


def ids(spark, *own):
    return spark.createDataFrame([(i,) for i in own], "track_id long")


def test_six_tables_change_together(spark, tmp_path, monkeypatch):
    store = Tables(spark, f"file://{tmp_path}", buckets=4)
    assert store.version() == 0
    store.replace(ids(spark, *range(20)), rows_of(spark, range(20), "first"))
    first = state(store)
    assert [len(first[n]) for n in NAMES] == [20 * (1 + n) for n in range(6)]
    own, written = Tables._write, []

    def failing(self, name, *rest):
        written.append(name)
        if name == "splits":
            raise OSError("lost")
        return own(self, name, *rest)

    monkeypatch.setattr(Tables, "_write", failing)
    with pytest.raises(OSError, match="lost"):
        store.replace(ids(spark, 3), rows_of(spark, [3], "second"))
    monkeypatch.setattr(Tables, "_write", own)
    assert len(written) > 2 and state(store) == first and store.version() == 1  # what was written is not seen
    store.replace(ids(spark, 3, 4, 99), rows_of(spark, [3, 99], "second"))
    want = {n: sorted([r for r in first[n] if r[0] not in (3, 4)] + [(i, k, "second") for i in (3, 99) for k in range(1 + j)]) for j, n in enumerate(NAMES)}
    assert state(store) == want and {n: sorted(map(tuple, store.read(n, 1).collect())) for n in NAMES} == first
    assert store.sweep() > 0 and state(store) == want


def test_only_touched_buckets_are_written_and_conflicts_are_seen(spark, tmp_path):
    store = Tables(spark, f"file://{tmp_path}", buckets=8)
    store.replace(ids(spark, *range(40)), {"tracks": rows_of(spark, range(40), "a")["tracks"]})
    before = store.commit_of()["tables"]["tracks"]["folders"]
    store.replace(ids(spark, 5), {"tracks": rows_of(spark, [5], "b")["tracks"]})
    after = store.commit_of()["tables"]["tracks"]["folders"]
    assert sum(before[b] != after[b] for b in before) == 1 and set(before) == set(after)
    with pytest.raises(ValueError, match="changed ones"):
        store.replace(ids(spark, 5), {"tracks": rows_of(spark, [6], "c")["tracks"]})
    late = Tables(spark, f"file://{tmp_path}")
    late.version = lambda: 1
    with pytest.raises(Conflict):
        late.replace(ids(spark, 5), {"tracks": rows_of(spark, [5], "late")["tracks"]})
    assert store.read("tracks").where("note = 'late'").isEmpty() and store.version() == 2
    with pytest.raises(KeyError):
        store.read("none")


def test_constraints(spark):
    rows = spark.createDataFrame([(1, 2, 0.5), (1, 2, 1.5), (2, None, None), (None, 3, float("nan")), (1, 3, -0.1)], "cluster_id long, track_id long, similarity double")
    rules = constraints.CATALOGUE["memberships"]
    assert {r.rule: r.breaches for r in constraints.breaches(rows, rules).collect()} == {"cluster_id required": 1, "track_id required": 1, "similarity required": 1, "similarity in range": 3, "track_id once": 2, "cluster_id, track_id once": 1}
    found = [sorted(r.broken) for r in constraints.quarantine(rows, rules).orderBy(F.col("similarity").isNull(), "similarity").collect()]
    assert found == [["similarity in range", "track_id once"], ["cluster_id, track_id once", "track_id once"], ["cluster_id, track_id once", "similarity in range", "track_id once"], ["cluster_id required", "similarity in range", "track_id once"], ["similarity required", "track_id required"]]
    assert {r.breaches for r in constraints.report({"batches": spark.createDataFrame([], "status string"), "settings": spark.createDataFrame([("a", None), ("a", "x")], "key string, value string")}).collect()} == {0, 1}
    assert {r.rule: r.breaches for r in constraints.breaches(rows.select("cluster_id"), constraints.Rules(("gone",))).collect()} == {"gone required": 5}


def test_lifecycles(spark):
    steps = ["queued", "parsing", "parsing", "complete", "lost", "analyzing", "failed", "parsing", "queued"]
    events = [("a", k, k, s, "no" if s == "failed" else None) for k, s in enumerate(steps)] + [("b", 0, 2, "parsing", None), ("b", 0, 1, "queued", None), ("c", 0, 0, "complete", None), (None, 0, 0, "queued", None), ("d", 1, 1, "queued", None), ("d", 2, 1, "failed", "broken"), ("e", 1, 1, None, None)]
    followed = lifecycle.steps(spark.createDataFrame(events, "item_id string, happened_at long, event_id long, status string, error string").repartition(3)).cache()
    reasons = [r.reason for r in followed.where("item_id = 'a'").orderBy("event_id").collect()]
    assert reasons == [None, None, "already there", "not from parsing", "no such status", None, None, "not from failed", None]
    found = {r.item_id: (r.status, r.progress, r.error, r.n_steps, r.n_illegal) for r in lifecycle.states(followed).collect()}
    assert found == {"a": ("queued", 0, None, 5, 4), "b": ("parsing", 12, None, 2, 0), "c": (None, None, None, 0, 1), "d": ("failed", 100, "broken", 2, 0), "e": (None, None, None, 0, 1)}
    assert lifecycle.quarantined(followed).count() == 6


def test_profiles_by_date(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    held = spark.createDataFrame([(1, day(5), "maximum", 200, None), (2, day(10), "none", None, None), (3, day(10), "custom", None, [30, 100, 120, 140, 160])], "revision long, valid_from timestamp, mode string, maximum int, edges array<int>")
    tracks = spark.createDataFrame([(1, day(1)), (2, day(5)), (3, day(9)), (4, day(10)), (5, None)], "track_id long, started_at timestamp")
    rows = profiles.with_profile(tracks, held)
    assert {r.track_id: (r.zone_revision, r.zone_edges) for r in rows.collect()} == {1: (0, None), 2: (1, [30, 120, 140, 160, 180]), 3: (1, [30, 120, 140, 160, 180]), 4: (3, [30, 100, 120, 140, 160]), 5: (0, None)}
    assert {r.zone_revision for r in profiles.with_profile(tracks, held.where("false")).collect()} == {0}
    beats = spark.createDataFrame([(t, b, 10.0 * t) for t in range(1, 6) for b in (20, 119, 120, 185, 245)], "track_id long, bpm int, seconds double")
    stored = spark.createDataFrame([(3, 1, [7.0] * 5), (4, 1, [8.0] * 5), (9, 1, [9.0] * 5)], "track_id long, zone_revision long, zone_seconds array<double>")
    assert {r.track_id for r in profiles.pending(stored, rows).collect()} == {1, 2, 4, 5}
    found = {r.track_id: (r.zone_revision, r.zone_seconds) for r in profiles.recalibrate(stored, beats, rows).collect()}
    assert found == {1: (0, None), 2: (1, [20.0, 20.0, 0.0, 0.0, 20.0]), 3: (1, [7.0] * 5), 4: (3, [0.0, 40.0, 40.0, 0.0, 40.0]), 5: (0, None)}
    with pytest.raises(ValueError):
        profiles.with_profile(tracks, held.withColumn("maximum", F.lit(20)))
