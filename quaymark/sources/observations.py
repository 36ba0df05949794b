"""Dated folders of observation files as a Spark data source, for batches and streams (section 2.1)."""

from __future__ import annotations

import datetime
import posixpath
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from ..shipping import ship

FOLDER = re.compile(r"day=(\d{4}-\d{2}-\d{2})")
FIRST = {"at": 0, "file": ""}


@dataclass
class ObservationFile(D.InputPartition):
    """One file, the day of its folder, and when it came."""

    path: str
    day: datetime.date
    at: int

    @property
    def place(self) -> tuple[int, str]:
        return self.at, self.path


def file_system(path: str):
    """The file system of a path and the path in it; a plain path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, keep=lambda day: True) -> list[ObservationFile]:
    """The parquet files of all dated folders whose day passes, in the order in which they came."""
    from pyarrow import fs

    system, top = file_system(path)
    out = []
    for folder in system.get_file_info(fs.FileSelector(top)):
        named = FOLDER.fullmatch(posixpath.basename(folder.path.rstrip("/")))
        if folder.type != fs.FileType.Directory or not named or not keep(day := datetime.date.fromisoformat(named[1])):
            continue  # other folders are not even listed
        for f in system.get_file_info(fs.FileSelector(folder.path)):
            if f.type == fs.FileType.File and f.path.endswith(".parquet") and not posixpath.basename(f.path).startswith(("_", ".")):
                out.append(ObservationFile(f.path, day, f.mtime_ns))
    return sorted(out, key=lambda x: x.place)


def batches(path: str, schema: T.StructType, file: ObservationFile) -> Iterator[pa.RecordBatch]:
    """The file's rows in Arrow batches, with its day; columns that it lacks are null."""
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import to_arrow_schema

    system, _ = file_system(path)
    wanted = to_arrow_schema(schema)
    with system.open_input_file(file.path) as f:
        there = pq.ParquetFile(f)
        names = [n for n in wanted.names if n != "day" and n in there.schema_arrow.names]
        for b in there.iter_batches(columns=names):
            day = pa.array([file.day] * b.num_rows, pa.date32())
            columns = [day if n == "day" else b.column(names.index(n)).cast(t) if n in names else pa.nulls(b.num_rows, t) for n, t in zip(wanted.names, wanted.types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=wanted)


class Days:
    """Tests on the day that filters of a query state."""

    KINDS = {D.EqualTo: lambda a, b: a == b, D.GreaterThan: lambda a, b: a > b, D.GreaterThanOrEqual: lambda a, b: a >= b, D.LessThan: lambda a, b: a < b, D.LessThanOrEqual: lambda a, b: a <= b, D.In: lambda a, b: a in b}

    def __init__(self):
        self.tests: list[tuple[type, object]] = []

    def take(self, f: D.Filter) -> bool:
        if type(f) in self.KINDS and f.attribute == ("day",):
            self.tests.append((type(f), f.value))
            return True
        return isinstance(f, D.IsNotNull) and f.attribute == ("day",)

    def keep(self, day: datetime.date) -> bool:
        return all(self.KINDS[kind](day, value) for kind, value in self.tests)


class ObservationReader(D.DataSourceReader):
    """A batch: a task for each file of the days that the query's filters leave."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema, self.days = path, schema, Days()

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        return [f for f in filters if not self.days.take(f)]

    def partitions(self) -> list[ObservationFile]:
        return listed(self.path, self.days.keep)

    def read(self, partition: ObservationFile | None) -> Iterator[pa.RecordBatch]:
        return batches(self.path, self.schema, partition) if partition is not None else iter(())


class ObservationStream(D.DataSourceStreamReader):
    """A stream: an offset is the time and name of the last file seen, so a batch is the files that came after one and up to another."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return dict(FIRST)

    def latestOffset(self) -> dict:
        files = listed(self.path)
        return {"at": files[-1].at, "file": files[-1].path} if files else dict(FIRST)

    def partitions(self, start: dict, end: dict) -> list[ObservationFile]:
        place = lambda o: (o["at"], o["file"])
        return [f for f in listed(self.path) if place(start) < f.place <= place(end)]

    def read(self, partition: ObservationFile) -> Iterator[pa.RecordBatch]:
        return batches(self.path, self.schema, partition)


class ObservationSource(D.DataSource):
    """Format ``observations``: parquet files in folders named day=YYYY-MM-DD; the given schema may have the column day."""

    @classmethod
    def name(cls) -> str:
        return "observations"

    def schema(self) -> T.StructType:
        raise ValueError("observations need a schema")

    def reader(self, schema: T.StructType) -> ObservationReader:
        return ObservationReader(self.options["path"], schema)

    def streamReader(self, schema: T.StructType) -> ObservationStream:
        return ObservationStream(self.options["path"], schema)


def register_observations(spark: SparkSession) -> SparkSession:
    """Make the format known to a session, with filters on the day pushed into it."""
    ship(spark).conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ObservationSource)
    return spark


def dated(schema: T.StructType) -> T.StructType:
    """The schema with the day; every column may be null, as a file may lack it."""
    return T.StructType([*(T.StructField(f.name, f.dataType) for f in schema.fields), T.StructField("day", T.DateType())])


def read_observation_folders(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Observations of all days, with the column ``day``; a filter on it leaves other folders unread."""
    return register_observations(spark).read.format("observations").schema(dated(schema)).load(path)


def stream_observation_folders(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The same as a stream of the files that come, whatever their day; a file counts by the time at which it came."""
    return register_observations(spark).readStream.format("observations").schema(dated(schema)).load(path)
