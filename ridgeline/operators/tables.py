"""Several tables replaced together by key: all of a track's rows in all tables change at once, or none does.

A table is dealt into buckets by the hash of ``track_id``; a bucket is a folder that is written once.  A commit is
one small file that names, for every table, the folder of each bucket; files are numbered, and readers take the last.
A writer leaves what it replaces in place, writes new folders, and creates the next file as its last step, which
fails if another writer has been there first.  So readers never see half of a change, and a failure leaves only
folders that nothing names, which ``sweep`` deletes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has committed since; nothing of this change can be seen."""


class Tables:
    """The tables below a folder of a file system whose creation of a file fails if it is there (HDFS, local)."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _fs(self, path: str):
        jvm_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return jvm_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm_path

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        fs, path = self._fs(f"{self.folder}/_commits")
        if not fs.exists(path):
            return 0
        return max((int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()), default=0)

    def commit_of(self, version: int | None = None) -> dict:
        """``buckets``, and by table its ``schema`` and the folder of each bucket."""
        version = self.version() if version is None else version
        if version == 0:
            return {"buckets": self.buckets, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/_commits/{version:012d}", wholetext=True).first().value)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of the last commit, or of an earlier one whose folders are still there.  Raises KeyError if there is none of the name."""
        held = self.commit_of(version)["tables"][table]
        return self._folders(held, list(held["folders"]))

    def _folders(self, held: dict, buckets: list[str]) -> DataFrame:
        reader = self.spark.read.schema(held["schema"])
        paths = [f"{self.folder}/{held['folders'][b]}" for b in buckets if b in held["folders"]]
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], held["schema"])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("track_id"), F.lit(self.buckets)).cast("int")

    def replace(self, changed: DataFrame, tables: dict[str, DataFrame]) -> int:
        """Put the rows of ``tables`` (each with ``track_id``) in the place of all rows of the ``changed`` tracks, in one commit.

        Only buckets that hold a changed track are written.  Rows of tracks that aren't among the changed ones raise
        ValueError before anything is written.  Returns the commit's number.  Raises Conflict if another writer was first.
        """
        start = self.version()
        before = self.commit_of(start)
        self.buckets = before["buckets"]
        ids = changed.select("track_id").distinct()
        touched = sorted(str(r.b) for r in ids.select(self._bucket().alias("b")).distinct().collect())
        for name, rows in tables.items():
            if not rows.join(ids, "track_id", "left_anti").isEmpty():
                raise ValueError(f"{name} has rows of tracks that aren't among the changed ones")
        now = {name: {"schema": held["schema"], "folders": dict(held["folders"])} for name, held in before["tables"].items()}
        for name, rows in {**{n: None for n in now}, **tables}.items():
            held = now.get(name)
            if rows is None:  # a known table without new rows loses those of the changed tracks
                rows = self.spark.createDataFrame([], held["schema"])
            if held:
                rows = self._folders(held, touched).join(ids, "track_id", "left_anti").unionByName(rows, allowMissingColumns=True)
            now[name] = self._write(name, rows, held, touched)
        self._commit(start + 1, {"buckets": self.buckets, "tables": now})
        return start + 1

    def _write(self, name: str, rows: DataFrame, held: dict | None, touched: list[str]) -> dict:
        at = f"{name}/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{at}")
        fs, path = self._fs(f"{self.folder}/{at}")
        made = {n.removeprefix("_bucket="): f"{at}/{n}" for n in (s.getPath().getName() for s in fs.listStatus(path)) if n.startswith("_bucket=")}
        folders = {b: f for b, f in (held["folders"] if held else {}).items() if b not in touched}
        return {"schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "folders": folders | made}

    def _commit(self, number: int, content: dict) -> None:
        fs, path = self._fs(f"{self.folder}/_commits/{number:012d}")
        draft, whole = self._fs(f"{self.folder}/_commits/_draft-{uuid.uuid4().hex}")[1], json.dumps(content).encode()
        out = fs.create(draft, False)
        out.write(whole)
        out.close()
        if fs.exists(path) or not fs.rename(draft, path):  # a rename onto a file that is there fails
            fs.delete(draft, False)
            raise Conflict(f"commit {number} is there already")

    def sweep(self) -> int:
        """Delete the folders that the last commit doesn't name, once no reader or writer uses them; returns how many."""
        named = {"/".join(f.split("/")[:2]) for held in self.commit_of()["tables"].values() for f in held["folders"].values()}
        fs, root = self._fs(self.folder)
        gone = 0
        for table in fs.listStatus(root):
            if table.getPath().getName().startswith("_"):
                continue
            for made in fs.listStatus(table.getPath()):
                if f"{table.getPath().getName()}/{made.getPath().getName()}" not in named:
                    fs.delete(made.getPath(), True)
                    gone += 1
        return gone
