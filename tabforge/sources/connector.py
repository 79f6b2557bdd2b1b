"""A saved feature set as a Python data source, for batch and stream readers.

    spark.dataSource.register(FeatureSetSource)
    spark.read.format("feature_set").load(path)
    spark.readStream.format("feature_set").load(path)

``path`` is the folder of one version, or any folder of Parquet files that only grows.  It is reached with Arrow's file
systems, on the driver to plan and in tasks to read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

# Fixed value: where Spark writes the schema of a Parquet file.
ROW_METADATA = b"org.apache.spark.sql.parquet.row.metadata"
#: Bytes of the row groups that one task reads, unless one group is larger.
PARTITION_BYTES = 64 << 20
#: Filters that a scan tests, by the function of Arrow that does it; rows without a value fail it.
_COMPARE = {EqualTo: "equal", GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", LessThan: "less", LessThanOrEqual: "less_equal"}


@dataclass
class RowGroups(InputPartition):
    """Some row groups of one file."""

    file: str
    groups: list[int] = field(default_factory=list)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def data_files(path: str) -> list[tuple[int, str]]:
    """(time of the last change, file), in that order; folders and files that start with ``_`` or ``.`` are no data."""
    fs, root = opened(path)
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    shown = lambda p: not any(part[:1] in "_." for part in p[len(root):].strip("/").split("/"))
    return sorted((f.mtime_ns or 0, f.path) for f in found if f.is_file and f.size and shown(f.path))


def planned(path: str, files: list[str], most: int) -> list[RowGroups]:
    """Row groups in parts of about ``most`` bytes; a file with large groups is split between its groups."""
    fs, _ = opened(path)
    out: list[RowGroups] = []
    for file in files:
        with fs.open_input_file(file) as source:
            footer = pq.ParquetFile(source).metadata
        part, size = RowGroups(file), 0
        for g in range(footer.num_row_groups):
            size += footer.row_group(g).total_byte_size
            part.groups.append(g)
            if size >= most:
                out.append(part)
                part, size = RowGroups(file), 0
        if part.groups:
            out.append(part)
    return out


def batches(path: str, part: RowGroups, schema: StructType, tests: list[tuple[str, str | None, object]] = ()) -> Iterator[pa.RecordBatch]:
    """The wanted columns of some row groups; columns that a file lacks are null."""
    fs, _ = opened(path)
    wanted = to_arrow_schema(schema)
    with fs.open_input_file(part.file) as source:
        file = pq.ParquetFile(source)
        there = set(file.schema_arrow.names)
        columns = list(dict.fromkeys(n for n in [*wanted.names, *(t[0] for t in tests)] if n in there))
        for batch in file.iter_batches(row_groups=part.groups, columns=columns):
            for name, compare, value in tests:
                column = batch.column(name) if name in there else pa.nulls(len(batch))
                batch = batch.filter(column.is_valid() if compare is None else getattr(pc, compare)(column, pa.scalar(value)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name).cast(f.type) if f.name in there else pa.nulls(len(batch), f.type) for f in wanted], schema=wanted)


class FeatureSetSource(DataSource):
    """``feature_set``: options ``path`` and ``partitionBytes``; ``filters`` if the scan shall test filters, which needs
    the session to allow it (``spark.sql.python.filterPushdown.enabled``).

    A schema given to the reader prunes columns in the scan, and may name columns that only later files have.
    """

    @classmethod
    def name(cls) -> str:
        return "feature_set"

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("a path is needed")
        return self.options["path"].rstrip("/")

    def schema(self) -> StructType:
        files = data_files(self._path())
        if not files:
            raise FileNotFoundError(self._path())
        fs, _ = opened(self._path())
        with fs.open_input_file(files[-1][1]) as source:  # the newest file has all columns
            found = pq.ParquetFile(source).schema_arrow
        written = (found.metadata or {}).get(ROW_METADATA)
        return StructType.fromJson(json.loads(written)) if written else from_arrow_schema(found, prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> FeatureSetReader:
        kind = FilteringReader if str(self.options.get("filters", "")).lower() == "true" else FeatureSetReader
        return kind(self._path(), schema, int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def streamReader(self, schema: StructType) -> FeatureSetStreamReader:
        return FeatureSetStreamReader(self._path(), schema, int(self.options.get("partitionBytes", PARTITION_BYTES)))


class FeatureSetReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, most: int):
        self.path, self.wanted, self.most, self.tests = path, schema, most, []

    def partitions(self) -> list[RowGroups]:
        return planned(self.path, [f for _, f in data_files(self.path)], self.most)

    def read(self, partition: RowGroups) -> Iterator[pa.RecordBatch]:
        yield from batches(self.path, partition, self.wanted, self.tests)


class FilteringReader(FeatureSetReader):
    """Tests comparisons with constants in the scan; Spark keeps the other filters."""

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _COMPARE and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)):
                self.tests.append((f.attribute[0], _COMPARE[type(f)], f.value))
            elif isinstance(f, IsNotNull) and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], None, None))
            else:
                yield f


class FeatureSetStreamReader(DataSourceStreamReader):
    """Files in the order of their last change; the offset is the last file that was planned.

    The offset is kept in the checkpoint, so a restarted stream goes on after it, and a replayed batch reads the same files.
    """

    def __init__(self, path: str, schema: StructType, most: int):
        self.path, self.wanted, self.most = path, schema, most

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        files = data_files(self.path)
        return {"time": files[-1][0], "file": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[RowGroups]:
        first, last = ((o["time"], o["file"]) for o in (start, end))
        return planned(self.path, [f for _, f in [x for x in data_files(self.path) if first < x <= last]], self.most)

    def read(self, partition: RowGroups) -> Iterator[pa.RecordBatch]:
        yield from batches(self.path, partition, self.wanted)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeatureSetSource)
