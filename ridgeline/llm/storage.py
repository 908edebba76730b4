"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that deletes an execution's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local: dict[str, str] = {}
_open: list[list[Scratch]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset, a temporary folder if Spark runs on this machine alone.

    Raises RuntimeError where it is unset on a cluster, whose executors don't share this machine's folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="ridgeline-")
        folder = _local[context.applicationId]
    return folder.rstrip("/")


class Scratch:
    """Tables written once and read several times, which also cuts lineage.

    They are Parquet files below the shared folder, so a lost executor loses none of them.  Shuffle files are
    deleted with the write that needed them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: set[str] = set()
        for held in _open:
            held.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count:03d}-{name}"
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        self.paths.add(path)
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete written tables that no later step reads; others, and None, are passed over."""
        for table in tables:
            path = getattr(table, "_scratch_path", "")
            if path in self.paths:
                self.paths.remove(path)
                self._delete(path)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but these, which the operator's result reads."""
        kept = {table._scratch_path for table in tables}
        for path in self.paths - kept:
            self._delete(path)
        self.paths &= kept

    def close(self) -> None:
        """Delete all tables."""
        self._delete(self.folder)

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def discarded() -> Iterator[None]:
    """Deletes the tables of all scratch folders opened inside, at the end; their readers must have run by then."""
    held: list[Scratch] = []
    _open.append(held)
    try:
        yield
    finally:
        _open[:] = [x for x in _open if x is not held]
        for scratch in held:
            scratch.close()


def within_bytes(rows: DataFrame, text: str, most: int) -> list[Row]:
    """Of a sample of a bounded number of rows, those whose texts ``most`` bytes hold together, taken by hash of the
    text; rows that no longer fit are left out, so the driver holds no more than that however long texts are."""
    h = "text_hash"
    scratch = Scratch(rows.sparkSession, "sample")
    held = scratch.write(rows.withColumn(h, F.xxhash64(text)), "sample")
    chosen, total = [], 0
    for r in sorted(held.groupBy(h).agg(F.sum(F.octet_length(text)).alias("n")).collect()):
        if total + r.n <= most:
            chosen.append(r[h])
            total += r.n
    found = held.where(F.col(h).isin(chosen)).collect()
    scratch.close()
    return found
