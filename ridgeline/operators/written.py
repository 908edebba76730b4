"""Tables written below the folder that the cluster shares, which cuts lineage and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that deletes an execution's shuffle files as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder if Spark runs on this machine alone, else RuntimeError."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _local.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="ridgeline-"))
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def written(rows: DataFrame) -> DataFrame:
    """The rows, written once as Parquet and read from there; shuffle files are deleted with the write that needed them."""
    path = f"{shared_folder(rows.sparkSession)}/table-{uuid.uuid4().hex}"
    before = rows.sparkSession.conf.get(_CLEANUP, "false")
    rows.sparkSession.conf.set(_CLEANUP, "true")
    try:
        rows.write.parquet(path)
    finally:
        rows.sparkSession.conf.set(_CLEANUP, before)
    table = rows.sparkSession.read.schema(rows.schema).parquet(path)
    table._written_path = path
    return table


def read_all(tables: list[DataFrame]) -> DataFrame:
    """The rows of written tables of one schema, read as one table."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*[table._written_path for table in tables])


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more; others are passed over."""
    for table in tables:
        if hasattr(table, "_written_path"):
            delete(table.sparkSession, table._written_path)
