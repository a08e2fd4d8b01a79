"""Tables whose files never change: a manifest names the files of each version.

Tasks write new files beside the old ones and report their names. Only when all
tasks have succeeded does the driver write the manifest of the next version, in one
rename; readers take the newest manifest. A lost task, executor or driver thus
leaves at most unnamed files, and the version before stays readable, also after the
next one is there. Upserts write the touched partitions anew and name all other
files again.

Layout below the table's folder: ``data/<write>/<file>.parquet`` and
``versions/<number>.json``. The folder is reached through pyarrow's file systems, on
executors and driver alike. One writer at a time: a writer that finds the version
after its own base taken fails and leaves the table as it is.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Name of the column that carries a row's partition to the writer.
PARTITION = "__partition"
#: Bytes of a row group, and of a file, after which a task begins the next one.
GROUP_BYTES = 32 << 20
FILE_BYTES = 512 << 20

APPEND, REPLACE_ALL, REPLACE_PARTITIONS = "append", "replace all", "replace partitions"


class VersionConflict(RuntimeError):
    """Another writer has made the next version first."""


@dataclass
class Manifest:
    """The files of one version: ``path`` below the table, ``partition`` and ``rows``."""

    version: int
    schema: str
    files: list[dict] = field(default_factory=list)


def store(root: str) -> tuple[fs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root


def versions(root: str) -> list[int]:
    """The numbers of all complete versions, ascending."""
    files, base = store(root)
    found = files.get_file_info(fs.FileSelector(f"{base}/versions", allow_not_found=True))
    names = [f.base_name for f in found if f.base_name.endswith(".json")]
    return sorted(int(name.removesuffix(".json")) for name in names)


def manifest(root: str, version: int | None = None) -> Manifest | None:
    """The manifest of a version, of the newest one by default; None where there is none."""
    known = versions(root)
    if version is None and not known:
        return None
    number = known[-1] if version is None else version
    if number not in known:
        raise FileNotFoundError(f"no version {number} of {root}")
    files, base = store(root)
    with files.open_input_stream(f"{base}/versions/{number:010d}.json") as stream:
        return Manifest(**json.loads(stream.read()))


def commit(root: str, new: Manifest) -> None:
    """Make ``new`` the newest version by one rename."""
    if new.version in versions(root):
        raise VersionConflict(f"version {new.version} of {root} exists")
    files, base = store(root)
    files.create_dir(f"{base}/versions")
    draft = f"{base}/versions/{uuid.uuid4().hex}.draft"
    with files.open_output_stream(draft) as stream:
        stream.write(json.dumps(vars(new)).encode())
    files.move(draft, f"{base}/versions/{new.version:010d}.json")


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict]


class _Files:
    """The Parquet files a task writes, one partition at a time."""

    def __init__(self, root: str, folder: str) -> None:
        self.store, self.base = store(root)
        self.folder, self.files = folder, []
        self.writer: pq.ParquetWriter | None = None
        self.partition: str | None = None
        self.held: list[pa.RecordBatch] = []
        self.held_bytes = self.file_bytes = 0

    def add(self, partition: str | None, rows: pa.RecordBatch) -> None:
        if self.writer is None or partition != self.partition or self.file_bytes > FILE_BYTES:
            self.close()
            self.partition = partition
            path = f"{self.folder}/{uuid.uuid4().hex}.parquet"
            self.store.create_dir(f"{self.base}/{self.folder}")
            self.writer = pq.ParquetWriter(f"{self.base}/{path}", rows.schema, filesystem=self.store)
            self.files.append({"path": path, "partition": partition, "rows": 0})
        self.held.append(rows)
        self.held_bytes += rows.nbytes
        self.files[-1]["rows"] += rows.num_rows
        if self.held_bytes > GROUP_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.writer.write_table(pa.Table.from_batches(self.held))
            self.file_bytes += self.held_bytes
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.writer is not None:
            self.flush()
            self.writer.close()
        self.writer, self.file_bytes = None, 0


class VersionWriter(DataSourceArrowWriter):
    """First phase in the tasks: new files. Second phase in the driver: the manifest."""

    def __init__(self, root: str, schema: T.StructType, change: str, base: int, folder: str) -> None:
        self.root, self.change, self.base, self.folder = root, change, base, folder
        self.schema = T.StructType([f for f in schema if f.name != PARTITION]).json()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        out = _Files(self.root, self.folder)
        for batch in iterator:
            names = batch.schema.names
            if PARTITION not in names:
                if batch.num_rows:
                    out.add(None, batch)
                continue
            marks = batch.column(names.index(PARTITION)).to_pylist()
            rows = batch.select([n for n in names if n != PARTITION])
            start = 0
            for at in range(1, len(marks) + 1):
                if at == len(marks) or marks[at] != marks[start]:
                    out.add(marks[start], rows.slice(start, at - start))
                    start = at
        out.close()
        return _Written(out.files)

    def commit(self, messages: list[_Written | None]) -> None:
        new = [f for m in messages if m is not None for f in m.files]
        old = [] if self.base == 0 else manifest(self.root, self.base).files
        if self.change == REPLACE_ALL:
            old = []
        elif self.change == REPLACE_PARTITIONS:
            touched = {f["partition"] for f in new}
            old = [f for f in old if f["partition"] not in touched]
        commit(self.root, Manifest(self.base + 1, self.schema, old + new))

    def abort(self, messages: list[_Written | None]) -> None:
        """Remove the files of this write, also those of tasks that never reported."""
        files, base = store(self.root)
        if files.get_file_info(f"{base}/{self.folder}").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/{self.folder}")


class VersionSource(DataSource):
    """The ``versioned`` format for ``df.write``; see :func:`write_version`."""

    @classmethod
    def name(cls) -> str:
        return "versioned"

    def writer(self, schema: T.StructType, overwrite: bool) -> VersionWriter:
        get = self.options.get
        return VersionWriter(get("path"), schema, get("change"), int(get("base")), get("folder"))


def partition_key(columns: Sequence[str]) -> Column:
    """The values of the partition columns as one text; NULL differs from every value."""
    return F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in columns]), {"ignoreNullFields": "false"})


def write_version(
    df: DataFrame,
    root: str,
    change: str = REPLACE_ALL,
    partition_by: Sequence[str] = (),
    base: int | None = None,
) -> int:
    """Write ``df`` as the next version of the table and return its number.

    ``change`` says what becomes of the files of version ``base`` (the newest by
    default): ``APPEND`` keeps all, ``REPLACE_ALL`` none, ``REPLACE_PARTITIONS``
    those of partitions without a new row. Rows of a partition go to as many tasks
    as their size asks for, so a hot partition does not end in one.
    """
    if change not in (APPEND, REPLACE_ALL, REPLACE_PARTITIONS):
        raise ValueError(f"no change {change!r}")
    if change == REPLACE_PARTITIONS and not partition_by:
        raise ValueError("which partitions to replace follows from partition columns")
    if base is None:
        known = versions(root)
        base = known[-1] if known else 0
    if base and T.StructType.fromJson(json.loads(manifest(root, base).schema)).names != df.columns and change != REPLACE_ALL:
        raise ValueError("the table has other columns")
    if partition_by:
        marked = df.withColumn(PARTITION, partition_key(partition_by))
        df = marked.hint("rebalance", F.col(PARTITION)).sortWithinPartitions(PARTITION)
    spark = df.sparkSession
    spark.dataSource.register(VersionSource)
    options = {"path": root, "change": change, "base": base, "folder": f"data/{uuid.uuid4().hex}"}
    df.write.format("versioned").options(**options).mode("append").save()
    return base + 1


def read_version(
    spark: SparkSession, root: str, version: int | None = None, partitions: set[str] | None = None
) -> DataFrame:
    """A version of the table, the newest by default, or only its rows in ``partitions``."""
    found = manifest(root, version)
    if found is None:
        raise FileNotFoundError(f"no version of {root}")
    schema = T.StructType.fromJson(json.loads(found.schema))
    chosen = [f["path"] for f in found.files if partitions is None or f["partition"] in partitions]
    if not chosen:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root.rstrip('/')}/{path}" for path in chosen])
