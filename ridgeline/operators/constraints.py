"""What rows must hold: a catalogue of rules, counted in one pass and one shuffle a table, and a quarantine for rows that break some."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Columns that must be there, closed ranges, allowed values (null passes both), and keys that come once."""

    required: tuple[str, ...] = ()
    ranges: dict[str, tuple[float, float | None]] = field(default_factory=dict)
    values: dict[str, tuple[str, ...]] = field(default_factory=dict)
    keys: tuple[tuple[str, ...], ...] = ()


# What is accepted into each table.
CATALOGUE = {
    "points": Rules(("track_id", "segment_position", "position", "latitude", "longitude"), {"latitude": (-90, 90), "longitude": (-180, 180)}, {}, (("track_id", "position"),)),
    "tracks": Rules(
        ("sha256", "original_path", "source_filename", "name"),
        {"progress": (0, 100)},
        {"status": ("queued", "parsing", "cleaning", "analyzing", "indexing", "complete", "insufficient_data", "failed", "cancelled"), "source_format": ("gpx", "fit"), "max_speed_confidence": ("high", "medium", "low")},
        (("sha256",),),
    ),
    "segments": Rules(("track_id", "track_position", "position"), keys=(("track_id", "track_position", "position"),)),
    "clusters": Rules(("name", "fingerprint", "track_count", "matcher_version"), {"track_count": (0, None)}, {}, (("fingerprint",),)),
    "memberships": Rules(("cluster_id", "track_id", "similarity"), {"similarity": (0, 1)}, {}, (("track_id",), ("cluster_id", "track_id"))),
    "items": Rules(("archive_id", "position", "path", "type"), {}, {"status": ("queued", "extracted", "processing", "complete", "duplicate", "insufficient_data", "skipped", "failed", "ignored")}, (("archive_id", "path"),)),
    "batches": Rules((), {"archive_count": (0, None), "item_count": (0, None)}, {"status": ("uploading", "processing", "complete", "partial", "failed")}),
    "archives": Rules(("sha256", "original_filename", "storage_path", "byte_size"), {"progress": (0, 100)}, {"status": ("queued", "inspecting", "processing", "complete", "partial", "duplicate", "failed"), "format": ("osf", "gpx", "fit")}),
    "settings": Rules(("key", "value"), keys=(("key",),)),
}


def _broken(rows: DataFrame, rules: Rules) -> dict[str, Column]:
    """By rule, whether a row breaks it; a column that the table lacks is missing in every row."""
    have, out = dict(rows.dtypes), {}
    for c in rules.required:
        blank = F.lit(True) if c not in have else F.col(c).isNull()
        out[f"{c} required"] = blank | (F.trim(c) == "") if have.get(c) == "string" else blank
    for c, (low, high) in rules.ranges.items():
        if c in have:
            fits = (F.col(c) >= low) & (F.lit(True) if high is None else F.col(c) <= high) & ~F.isnan(F.col(c).cast("double"))
            out[f"{c} in range"] = ~F.coalesce(fits, F.lit(True))
    for c, allowed in rules.values.items():
        if c in have:
            out[f"{c} allowed"] = ~F.coalesce(F.col(c).isin(*allowed), F.lit(True))
    return out


def _key_name(key: tuple[str, ...]) -> str:
    return f"{', '.join(key)} once"


def _repeated(rows: DataFrame, keys: tuple[tuple[str, ...], ...]) -> DataFrame:
    """``rule, key, n`` of the keys that come more than once, of all constraints in one shuffle; a key with a null is none."""
    named = [F.when(functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key]), F.struct(F.lit(_key_name(key)).alias("rule"), _key(key).alias("key"))) for key in keys]
    each = rows.select(F.explode(F.array_compact(F.array(*named))).alias("k")).select("k.*")
    return each.groupBy("rule", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _key(key: tuple[str, ...]) -> Column:
    return F.to_json(F.array(*[F.col(c).cast("string") for c in key]))


def breaches(rows: DataFrame, rules: Rules) -> DataFrame:
    """``rule, breaches``: the rows that break each rule, 0 included; of a key that comes n times all but one do."""
    broken = _broken(rows, rules)
    counts = rows.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(broken.values())]) if broken else None
    parts = []
    if broken:
        listed = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("breaches")) for i, name in enumerate(broken)])
        parts.append(counts.select(F.inline(listed)))
    if rules.keys:
        none = rows.sparkSession.createDataFrame([(_key_name(k),) for k in rules.keys], "rule string")
        extra = _repeated(rows, rules.keys).groupBy("rule").agg(F.sum(F.col("n") - 1).alias("breaches"))
        parts.append(none.join(extra, "rule", "left").select("rule", F.coalesce("breaches", F.lit(0)).cast("bigint").alias("breaches")))
    return functools.reduce(DataFrame.unionByName, parts)


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, rule, breaches`` of tables of the catalogue."""
    return functools.reduce(DataFrame.unionByName, [breaches(rows, CATALOGUE[name]).select(F.lit(name).alias("table"), "rule", "breaches") for name, rows in tables.items()])


def quarantine(rows: DataFrame, rules: Rules) -> DataFrame:
    """The rows with ``broken``, the rules that each breaks: empty for those to keep.  All rows of a repeated key break its rule."""
    own = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in _broken(rows, rules).items()])) if _broken(rows, rules) else F.array().cast("array<string>")
    out = rows.withColumn("broken", own)
    for key in rules.keys:
        twice = _repeated(rows, (key,)).select(F.col("key").alias("_key"), F.lit(_key_name(key)).alias("_rule"))
        out = out.withColumn("_key", _key(key)).join(twice, "_key", "left")
        out = out.withColumn("broken", F.when(F.col("_rule").isNotNull(), F.array_append("broken", F.col("_rule"))).otherwise(F.col("broken"))).drop("_key", "_rule")
    return out
