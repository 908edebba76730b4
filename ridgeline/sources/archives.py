"""A data source of the recordings inside zipped exports, ``ridgeline_archives``.

Archives are never read whole.  Planning reads each one's central directory and manifest by ranges; their entries
become input partitions of about ``partitionBytes`` (an option; larger entries get their own), and a task reads the
ranges of its entries one after the other, so it holds one entry.  An archive may be of any size.  Filters on ``path``
and ``entry`` decide before anything is opened, or inflated, where ``spark.sql.python.filterPushdown.enabled`` is set.

Stores are those that pyarrow opens by address (local, hdfs, s3, gs).
"""

from __future__ import annotations

import fnmatch
import os
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from . import osf
from .errors import Unreadable

SCHEMA = "path string, entry string, size bigint, content binary, error string"
PARTITION_BYTES = 64 << 20
#: Archives whose directories are read at the same time while planning.
PLANNED_AT_ONCE = 16
_WRONG = (zipfile.BadZipFile, zlib.error, EOFError, ValueError, NotImplementedError, RuntimeError, OSError)


def _why(problem: Exception) -> str:
    own = isinstance(problem, Unreadable | zipfile.BadZipFile | NotImplementedError | RuntimeError)
    return str(problem) if own and str(problem) else "not a readable archive"


#: Addresses as Spark writes them, by what pyarrow calls them.
_SAME = {"s3a": "s3", "s3n": "s3"}


def opens(folder: str) -> bool:
    """Whether pyarrow opens addresses of this kind."""
    scheme = folder.split(":", 1)[0] if ":" in folder else "file"
    return _SAME.get(scheme, scheme) in ("file", "hdfs", "s3", "gs")


def _store(address: str) -> tuple[fs.FileSystem, str, str]:
    """(store, path in it, what stands before paths in addresses)."""
    scheme, _, rest = address.partition(":") if ":" in address else ("file", "", address)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if address.startswith("file:") else os.path.abspath(rest), "file:"
    store, path = fs.FileSystem.from_uri(f"{_SAME.get(scheme, scheme)}:{rest}")
    authority = rest[2:].split("/", 1)[0] if rest.startswith("//") and not path.startswith(rest[2:].split("/", 1)[0]) else ""
    return store, path, f"{scheme}://{authority}"


@dataclass
class Entries(InputPartition):
    """Entries of one archive, or what is wrong with it."""

    path: str
    names: list[str] = field(default_factory=list)
    error: str | None = None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.glob = options["path"], options.get("pathglobfilter", "*.osf")
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))
        self.wanted: list[tuple[str, Filter]] = []

    def _wants(self, column: str, value: str | None) -> bool:
        def holds(f: Filter) -> bool:
            if isinstance(f, EqualTo | In):
                return value in (f.value if isinstance(f, In) else (f.value,))
            return value is not None and (value.startswith(f.value) if isinstance(f, StringStartsWith) else value.endswith(f.value))

        return all(holds(f) for c, f in self.wanted if c == column)

    def _archives(self) -> list[str]:
        store, path, before = _store(self.folder)
        found = store.get_file_info(path)
        files = [found] if found.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        return sorted(before + f.path for f in files if f.is_file and fnmatch.fnmatch(f.base_name.lower(), self.glob.lower()))

    def _plan(self, path: str) -> list[Entries]:
        try:
            store, inside, _ = _store(path)
            with store.open_input_file(inside) as file, zipfile.ZipFile(file) as archive:
                names = [n for n in osf.inspect(archive) if self._wants("entry", n)]
                sizes = {osf.safe_path(x.filename): x.file_size for x in archive.infolist() if not x.is_dir()}
        except _WRONG as problem:
            return [Entries(path, error=_why(problem))] if self._wants("entry", None) else []
        parts: list[Entries] = []
        room = 0
        for name in names:
            if sizes[name] > room:
                parts.append(Entries(path))
                room = self.partition_bytes
            parts[-1].names.append(name)
            room -= sizes[name]
        return parts

    def partitions(self) -> Sequence[Entries]:
        with ThreadPoolExecutor(PLANNED_AT_ONCE) as pool:
            return [part for parts in pool.map(self._plan, filter(lambda p: self._wants("path", p), self._archives())) for part in parts]

    def read(self, partition: Entries) -> Iterator[tuple]:
        if partition is None or partition.error is not None:  # without archives there is one empty partition
            yield from () if partition is None else ((partition.path, None, None, None, partition.error),)
            return
        store, inside, _ = _store(partition.path)
        with store.open_input_file(inside) as file, zipfile.ZipFile(file) as archive:
            held = {osf.safe_path(x.filename): x for x in archive.infolist() if not x.is_dir()}
            for name in partition.names:
                try:
                    content, error = archive.read(held[name]), None
                except _WRONG as problem:
                    content, error = None, _why(problem)
                yield partition.path, name, held[name].file_size, content, error


class FilteringReader(ArchiveReader):
    """Takes filters on path and entry; Spark lets a reader do so only where its setting says so."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith) and f.attribute in (("path",), ("entry",)):
                self.wanted.append((f.attribute[0], f))
            else:
                yield f


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ridgeline_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return (FilteringReader if self.options.get("filters") == "true" else ArchiveReader)(self.options)


def read(spark: SparkSession, folder: str, glob: str = "*.osf", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``path, entry, size, content, error`` of the recordings that the manifests of a folder's archives list; an archive that breaks a rule gives one row."""
    spark.dataSource.register(ArchiveSource)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(ArchiveSource.name()).option("pathGlobFilter", glob).option("partitionBytes", partition_bytes).option("filters", filters).load(folder)
