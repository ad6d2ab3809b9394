"""Members of zip archives as a data source: ``spark.read.format("zip_members").load(path)``.

An archive's directory stands at its end, so runs of members are planned without reading the members: a large
archive is many partitions, and no task or cell holds it whole. Paths are those that pyarrow's file systems open
(local and mounted folders, object stores, HDFS); ``path`` is an archive or a folder of them.

Options: ``split`` (bytes of packed members in a partition, 16 MiB), ``suffix`` (members to read, all without it),
``most`` (bytes of an unpacked member above which it is a row with an error, 1 GiB).
"""

from __future__ import annotations

import datetime as dt
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SPLIT, MOST = 16 << 20, 1 << 30
MEMBER = "path string, member string, size_bytes long, modified_at timestamp, content binary, error string"
_FIELDS = [("path", pa.string()), ("member", pa.string()), ("size_bytes", pa.int64()), ("modified_at", pa.timestamp("us", tz="UTC")), ("content", pa.binary()), ("error", pa.string())]


@dataclass
class Run(InputPartition):
    """Members of one archive (by their place in its directory), or a whole small archive."""

    path: str
    first: int
    last: int | None


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def archives(path: str) -> list[tuple[str, int]]:
    """Path and bytes of the archives at a path, in order."""
    system, own = _system(path.replace("file:///", "/") if path.startswith("file:///") else path)
    info = system.get_file_info(own)
    if info.type == fs.FileType.File:
        return [(own, info.size)]
    found = system.get_file_info(fs.FileSelector(own, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.extension.lower() == "zip")


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", "").lower()
        self.split, self.most = int(options.get("split", SPLIT)), int(options.get("most", MOST))

    def partitions(self) -> list[Run]:
        """Small archives are one partition each and are only opened by their task; large ones are cut by their
        directories, and one without a readable directory is a partition that reports it."""
        out: list[Run] = []
        system, _ = _system(self.path.replace("file:///", "/") if self.path.startswith("file:///") else self.path)
        for path, size in archives(self.path):
            if size <= self.split:
                out.append(Run(path, 0, None))
                continue
            try:
                with system.open_input_file(path) as file, zipfile.ZipFile(file) as z:
                    members = z.infolist()
            except (zipfile.BadZipFile, OSError):
                out.append(Run(path, 0, None))
                continue
            first, held = 0, 0
            for i, member in enumerate(members):
                held += member.compress_size
                if held >= self.split or i == len(members) - 1:
                    out.append(Run(path, first, i + 1))
                    first, held = i + 1, 0
        return out or [Run("", 0, 0)]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = _system(self.path.replace("file:///", "/") if self.path.startswith("file:///") else self.path)
        try:
            with system.open_input_file(partition.path) as file, zipfile.ZipFile(file) as z:
                for member in z.infolist()[partition.first : partition.last]:
                    if not member.is_dir() and member.filename.lower().endswith(self.suffix):
                        yield self._row(z, partition.path, member)
        except (zipfile.BadZipFile, OSError) as error:
            yield _batch(partition.path, None, None, None, None, f"{type(error).__name__}: {error}")

    def _row(self, z: zipfile.ZipFile, path: str, member: zipfile.ZipInfo) -> pa.RecordBatch:
        try:
            at = dt.datetime(*member.date_time, tzinfo=dt.UTC)
        except ValueError:
            at = None
        content = error = None
        try:
            if member.file_size > self.most:
                raise ValueError(f"{member.file_size} bytes, more than {self.most}")
            content = z.read(member)
        except Exception as e:  # noqa: BLE001  (any bad member becomes a row)
            error = f"{type(e).__name__}: {e}"
        return _batch(path, member.filename, member.file_size, at, content, error)


def _batch(*row: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, (_, kind) in zip(row, _FIELDS, strict=True)], [n for n, _ in _FIELDS])


class ZipMembers(DataSource):
    """path, member, size_bytes, modified_at, content, error of the members of zip archives."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(dict(self.options))


def write(rows: DataFrame, folder: str, count: int) -> DataFrame:
    """path, members of ``count`` archives in ``folder`` that hold the rows (member, content), dealt by member. A task
    streams its rows into its own archive under a name of its own and renames it when it is whole, so a task that is
    run again replaces itself. Members without a name are left out; a null content is empty."""
    system, own = _system(folder.replace("file:///", "/") if folder.startswith("file:///") else folder)
    system.create_dir(own)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        place, _ = _system(folder.replace("file:///", "/") if folder.startswith("file:///") else folder)
        path, n = f"{own}/part-{task.partitionId():05d}.zip", 0
        with place.open_output_stream(f"{path}.{task.taskAttemptId()}") as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in batches:
                for member, content in zip(batch.column("member").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    z.writestr(member, content or b"")
                    n += 1
        place.move(f"{path}.{task.taskAttemptId()}", path)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "members"])

    dealt = rows.filter("member is not null").select("member", F.col("content").cast("binary").alias("content")).repartition(count, "member")
    return dealt.mapInArrow(pack, "path string, members long")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipMembers)


def members(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """A row for each member of the archives at ``path``. A member that can't be unpacked has no
    content and an error, as has an archive that can't be opened (without a member). No archives give no rows."""
    register(spark)
    return spark.read.format("zip_members").options(**{k: str(v) for k, v in options.items()}).load(path)


def as_files(rows: DataFrame) -> DataFrame:
    """Members as files (path, content) under "archive::member", for readers of single files; bad ones are left out."""
    return rows.filter("error is null").select(F.concat_ws("::", "path", "member").alias("path"), "content")
