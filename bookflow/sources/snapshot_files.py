"""Snapshot files as a data source of Spark, for batches and streams: a format that knows what file names say.

Filters on names (instrument, day, session, file) are taken by the source, so files that they leave out are never opened. Files
are put together up to ``partition_bytes`` a partition, in the order of day, session and instrument; a task streams its files
in batches of ``BATCH`` rows. A file is read by one task: :func:`bookflow.sources.snapshots.read` splits files of many gigabytes,
this source serves many small ones. Both give the same rows. A second pass over a DataFrame reads the files again.

As a stream, a micro-batch takes the files that have come since the last one. Its offset is the time and path of the newest file
and how many files there were up to it. Files stay where they are while a stream reads their folder: one that comes under an older
time, whose rows would be missed, or one that goes, which would hide that, ends the query with an error. On stores that keep whole
seconds, ``settle_seconds`` leaves the newest files to the next batch. Empty files and files with a header only have no rows.
"""

from __future__ import annotations

import io
import re
import time
from collections.abc import Iterator
from itertools import islice, zip_longest

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from bookflow.schema import SNAPSHOT
from bookflow.sources import snapshots

FORMAT = "snapshot_files"
#: Rows of an Arrow batch.
BATCH = 8192
TAGS = T.StructType([T.StructField(n, k) for n, k in (("source_file", T.StringType()), ("sym_id", T.IntegerType()), ("date_id", T.IntegerType()), ("session", T.StringType()), ("session_nr", T.IntegerType()), ("row_nr", T.IntegerType()))])


def texts(schema: T.StructType) -> T.StructType:
    """Tags of a row and its cells as text."""
    return T.StructType([*TAGS.fields, *(T.StructField(f.name, T.StringType()) for f in schema.fields)])


def tags(path: str) -> dict[str, str | int | None]:
    """What a file's name says, as :func:`bookflow.sources.snapshots.parsed` reads it."""
    file = path.rsplit("/", 1)[-1]
    found = re.search(snapshots.NAME, file, re.ASCII)
    number = lambda k: int(found[k]) if found and int(found[k]) < 2**31 else None
    session = found[3] if found else None
    return {"source_file": file, "sym_id": number(1), "date_id": number(2), "session": session, "session_nr": {"am": 0, "pm": 1}.get(session)}


def _cells(line: str) -> list[str]:
    if '"' not in line:
        return [c.strip(" ") for c in line.split(",")]
    bare = (c.strip(" ") for c in re.split(snapshots.COMMA, line))
    return [re.sub(snapshots.QUOTED, r"\1", c).replace('""', '"') for c in bare]


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if re.match(r"[a-z0-9]+:/|/", folder) else "/" + folder)


def read_file(system: pafs.FileSystem, path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A file's rows in batches; cells by the header's names, NULL where there is none."""
    said = tags(path)
    with system.open_input_stream(path) as raw:
        lines = (c for line in io.TextIOWrapper(raw, "utf-8-sig", "replace") if (c := line.rstrip("\r\n")))
        head = [re.sub(r"^label(\d+)$", r"label_\1", c, flags=re.ASCII) for c in _cells(next(lines, ""))]
        row = 0
        while chunk := list(islice(lines, BATCH)):
            columns = list(zip_longest(*map(_cells, chunk), fillvalue=""))
            n = len(chunk)
            arrays = []
            for field in schema:
                if field.name == "row_nr":
                    arrays.append(pa.array(range(row + 1, row + n + 1), field.type))
                elif field.name in said:
                    arrays.append(pa.array([said[field.name]] * n, field.type))
                else:
                    at = head.index(field.name) if field.name in head else len(columns)
                    arrays.append(pa.array([c or None for c in columns[at]], field.type) if at < len(columns) else pa.nulls(n, field.type))
            row += n
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


class Part(ds.InputPartition):
    """Files of one task."""

    def __init__(self, paths: list[str]):
        self.paths = paths


class _Folder:
    """What batch and stream share: listing, grouping into partitions and reading."""

    def __init__(self, options: dict, schema: T.StructType):
        if "path" not in options:
            raise ValueError("a folder must be given")
        self.folder = options["path"]
        self.most = int(options.get("partition_bytes", 64 << 20))
        self.settle = float(options.get("settle_seconds", 0))
        self.schema = schema

    def listed(self) -> list[pafs.FileInfo]:
        system, top = _open(self.folder)
        return [f for f in system.get_file_info(pafs.FileSelector(top, recursive=True)) if f.is_file and f.path.endswith(".csv")]

    def parts(self, files: list[pafs.FileInfo]) -> list[Part]:
        order = lambda f: tuple((v is None, v or 0) for v in (tags(f.path)[n] for n in ("date_id", "session_nr", "sym_id"))) + (f.path,)
        out, held = [], 0
        for f in sorted(files, key=order):
            if not out or held + f.size > self.most:
                out.append(Part([]))
                held = 0
            out[-1].paths.append(f.path)
            held += f.size
        return out or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = _open(self.folder)
        for path in partition.paths:
            yield from read_file(system, path, to_arrow_schema(self.schema))


class Reader(_Folder, ds.DataSourceReader):
    """One pass over the files that the filters on names leave."""

    def __init__(self, options: dict, schema: T.StructType):
        super().__init__(options, schema)
        self.kept: list = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        # A name that lacks the value never meets a comparison with it.
        tests = {
            ds.EqualTo: lambda v, f: v == f.value,
            ds.GreaterThan: lambda v, f: v > f.value,
            ds.GreaterThanOrEqual: lambda v, f: v >= f.value,
            ds.LessThan: lambda v, f: v < f.value,
            ds.LessThanOrEqual: lambda v, f: v <= f.value,
            ds.In: lambda v, f: v in f.value,
            ds.IsNotNull: lambda v, f: True,
        }
        for f in filters:
            if type(f) in tests and len(f.attribute) == 1 and f.attribute[0] in TAGS.names[:-1]:
                self.kept.append((f, tests[type(f)]))
            else:
                yield f

    def partitions(self) -> list[Part]:
        def meets(said: dict) -> bool:
            return all((v := said[f.attribute[0]]) is not None and test(v, f) for f, test in self.kept)

        found = self.parts([f for f in self.listed() if meets(tags(f.path))])
        self.kept = []  # done with; tasks get no functions
        return found


class StreamReader(_Folder, ds.DataSourceStreamReader):
    """Files as they come, each in one micro-batch."""

    def _sorted(self) -> list[tuple[tuple[int, str], pafs.FileInfo]]:
        return sorted((((f.mtime_ns, f.path), f) for f in self.listed()), key=lambda x: x[0])

    def initialOffset(self) -> dict:
        return {"time": 0, "path": "", "files": 0}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)
        found = [key for key, _ in self._sorted() if not self.settle or key[0] <= until]
        if not found:
            return self.initialOffset()
        return {"time": found[-1][0], "path": found[-1][1], "files": len(found)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        files = self._sorted()
        after, last = (start["time"], start["path"]), (end["time"], end["path"])
        read = sum(key <= after for key, _ in files)
        found = [f for key, f in files if after < key <= last]
        if read != start["files"] or len(found) != end["files"] - start["files"]:
            raise ValueError(f"{self.folder}: files came under older times than those read, or are gone")
        return self.parts(found)


class SnapshotFiles(ds.DataSource):
    """``spark.read.format("snapshot_files")``; cells are text, :func:`rows` and :func:`stream` give them types."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return texts(SNAPSHOT)

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> StreamReader:
        return StreamReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SnapshotFiles)


def rows(spark: SparkSession, folder: str, schema: T.StructType = SNAPSHOT, **options) -> DataFrame:
    """As :func:`bookflow.sources.snapshots.read`; columns that ``schema`` leaves out aren't made."""
    register(spark)
    return snapshots.typed(spark.read.format(FORMAT).schema(texts(schema)).options(**options).load(folder), schema)


def stream(spark: SparkSession, folder: str, schema: T.StructType = SNAPSHOT, **options) -> DataFrame:
    """The same rows as a stream."""
    register(spark)
    return snapshots.typed(spark.readStream.format(FORMAT).schema(texts(schema)).options(**options).load(folder), schema)
