"""Package archives as a Spark data source: ``spark.read.format("package_archives").load(folder)``.

Archives lie below a folder as a registry lays them out, ``<package>/-/<name>-<version>.tgz``, or flat as
``<name>-<version>.tgz``. A partition is a run of archives of about ``targetBytes``, or one larger archive.
Archives are read as streams and members as parts of at most ``partBytes``, so neither an archive nor a
member need fit in memory. The option ``packages``, names joined by commas, leaves other archives unopened. It is an
option and no pushed filter because Spark keeps what one query of a DataFrame has pushed for the next one without filters.

Columns: package, version, path, size (of the whole member), parts (how many it has), part (from 0), data, error.
Defined cases: an archive that can't be read to its end gives what came before, and a row with the error and no
path; an empty member has one empty part; links, folders and devices are left out; a member that stands twice
comes twice; a folder without archives gives no rows; a missing folder is an error.
"""

from __future__ import annotations

import io
import re
import sys
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "package_archives"
SCHEMA = "package string, version string, path string, size bigint, parts int, part int, data binary, error string"
_ARROW = pa.schema([("package", pa.string()), ("version", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("parts", pa.int32()), ("part", pa.int32()), ("data", pa.binary()), ("error", pa.string())])
PART_BYTES, TARGET_BYTES = 16 << 20, 128 << 20
#: Rows of a batch, beside its bytes.
BATCH_ROWS = 4096
_SUFFIX = (".tgz", ".tar.gz", ".tar")


def named(path: str) -> tuple[str, str] | None:
    """(package, version) of an archive's path below the folder; None if it is no archive."""
    suffix = next((s for s in _SUFFIX if path.endswith(s)), None)
    if suffix is None:
        return None
    stem = path[: -len(suffix)]
    if "/-/" in stem:
        package, _, file = stem.rpartition("/-/")
        base = package.rpartition("/")[2] + "-"
        return package, file[len(base) :] if file.startswith(base) else file
    m = re.fullmatch(r"(.+?)-v?(\d+\.\d+.*)", stem.rpartition("/")[2])
    return (m[1], m[2]) if m else (stem.rpartition("/")[2], "")


@dataclass
class Run(InputPartition):
    """Archives (path, package, version) that one task reads."""

    archives: list

    def __init__(self, archives: list) -> None:
        self.archives = archives


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.part_bytes = int(options.get("partBytes", PART_BYTES))
        self.target = int(options.get("targetBytes", TARGET_BYTES))
        self.packages = {x for x in options.get("packages", "").split(",") if x}

    def partitions(self) -> list[Run]:
        system, root = fs.FileSystem.from_uri(self.folder)
        runs, size = [], self.target
        for info in sorted(system.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            key = named(info.path[len(root) :].lstrip("/")) if info.type == fs.FileType.File else None
            if key is None or self.packages and key[0] not in self.packages:
                continue
            if size + info.size > self.target:
                runs.append(Run([]))
                size = 0
            runs[-1].archives.append((info.path, *key))
            size += info.size
        return runs or [Run([])]

    def rows(self, system: fs.FileSystem, path: str, package: str, version: str) -> Iterator[tuple]:
        try:
            with system.open_input_stream(path, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
                for m in tar:
                    if not m.isfile():
                        continue
                    parts = max(1, -(-m.size // self.part_bytes))
                    body = tar.extractfile(m)
                    for k in range(parts):
                        data = body.read(self.part_bytes)
                        if len(data) < min(self.part_bytes, m.size - k * self.part_bytes):
                            raise EOFError("the archive ends within a member")
                        yield package, version, m.name, m.size, parts, k, data, None
        except (tarfile.TarError, EOFError, OSError, zlib.error) as e:
            yield package, version, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.folder)
        held, size = [], 0
        for archive in partition.archives:
            for row in self.rows(system, *archive):
                held.append(row)
                size += len(row[6] or b"")
                if size >= self.part_bytes or len(held) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session. Workers get the classes by value, so they need not import this package."""
    module = sys.modules[__name__]
    cloudpickle.register_pickle_by_value(module)
    try:
        spark.dataSource.register(ArchiveSource)
    finally:
        cloudpickle.unregister_pickle_by_value(module)


def read(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).options(**options).load(folder)


def whole(entries: DataFrame) -> DataFrame:
    """(package, version, path, data, error): members as one value each, as ``sources.packages`` takes them. Only
    members of several parts are shuffled; one whose archive breaks off within it is left out. A member that
    stands twice in an archive and has several parts comes once."""
    out = ["package", "version", "path", "data", "error"]
    single = entries.where(F.coalesce(F.col("parts"), F.lit(1)) <= 1).select(out)
    pieces = F.array_sort(F.collect_set(F.struct("part", "data")))
    many = entries.where("parts > 1").groupBy("package", "version", "path", "parts").agg(pieces.alias("p")).where("size(p) = parts")
    data = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["data"]))
    return single.unionByName(many.select("package", "version", "path", data.alias("data"), F.lit(None).cast("string").alias("error")))


def pack(files: DataFrame, folder: str, package: str = "bundle", most_bytes: int = 8 << 20) -> int:
    """Writes files (path, data) as archives of about ``most_bytes`` below ``folder``, and gives their number. The version
    of an archive is its task and place in it; a task that is run again replaces what it wrote."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(f"{root}/{package}/-", recursive=True)
        task, attempt, written = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), []
        held, size = [], 0

        def flush() -> None:
            nonlocal held, size
            buffer = io.BytesIO()
            with tarfile.open(fileobj=buffer, mode="w:gz", compresslevel=1) as tar:
                for path, data in held:
                    info = tarfile.TarInfo(path)
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
            version = f"{task}.{len(written)}.0"
            draft, final = (f"{root}/{package}/-/{x}" for x in (f"{version}.{attempt}.draft", f"{package}-{version}.tgz"))
            with system.open_output_stream(draft, compression=None) as out:
                out.write(buffer.getvalue())
            system.move(draft, final)
            written.append(version)
            held, size = [], 0

        for frame in frames:
            for path, data in zip(frame["path"], frame["data"], strict=True):
                held.append((path, bytes(data or b"")))
                size += len(held[-1][1])
                if size >= most_bytes:
                    flush()
        if held:
            flush()
        yield pd.DataFrame({"version": written}, dtype="object")

    return files.select("path", "data").mapInPandas(run, "version string").count()
