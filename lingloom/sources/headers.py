"""A data source of the headers of sound files: of each file only the chunks before its samples are read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lingloom.sources.wav import layout

SCHEMA = "path string, filename string, split string, bytes long, rate int, channels int, width int, frames long, seconds double, bytes_read long, error string"
#: Files whose headers travel together, and tasks that share the files of a folder unless the option tasks says otherwise.
ROWS, TASKS = 4096, 4


class Counted:
    """A file that counts the bytes that are read from it."""

    def __init__(self, f: BinaryIO):
        self.f, self.n = f, 0

    def seek(self, at: int) -> None:
        self.f.seek(at)

    def read(self, n: int) -> bytes:
        out = self.f.read(n)
        self.n += len(out)
        return out


class Share(InputPartition):
    """The files of a folder whose names fall to one of so many tasks; deep: also those in folders below."""

    def __init__(self, folder: str, part: int, parts: int, deep: bool):
        self.folder, self.part, self.parts, self.deep = folder, part, parts, deep


def opened(path: str):
    """The file system of a path or URI, and the path in it; any store that pyarrow knows will do."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, deep: bool):
    from pyarrow import fs

    store, root = opened(path)
    return store, store.get_file_info(fs.FileSelector(root, recursive=deep))


class HeaderReader(DataSourceReader):
    def __init__(self, path: str, tasks: int):
        self.path, self.tasks = path.rstrip("/"), tasks

    def partitions(self) -> list[Share]:
        """The driver sees the folders right below the path; tasks list the files of theirs."""
        from pyarrow import fs

        _, found = listed(self.path, False)
        folders = [(f"{self.path}/{x.base_name}", True) for x in found if x.type == fs.FileType.Directory]
        return [Share(folder, k, self.tasks, deep) for folder, deep in [(self.path, False), *folders] for k in range(self.tasks)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        store, found = listed(partition.folder, partition.deep)
        own = (x for x in found if x.extension == "wav" and zlib.crc32(x.path.encode()) % partition.parts == partition.part)
        rows = []
        for info in own:
            rows.append(self.header(store, info))
            if len(rows) == ROWS:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def header(self, store, info) -> tuple:
        scheme = self.path.partition("://")[0] + "://" if "://" in self.path else ""
        folder = info.path.rstrip("/").split("/")[-2]
        with store.open_input_file(info.path) as f:
            counted = Counted(f)
            try:
                x, error = layout(counted, info.size), None
            except ValueError as e:
                x, error = None, str(e)
        return (scheme + info.path, info.base_name, folder, info.size, *((x.rate, x.channels, x.width, x.frames, x.seconds) if x else (None,) * 5), counted.n, error)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = [x.split() for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


class WavHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_headers"

    def schema(self) -> StructType | str:
        return SCHEMA

    def reader(self, schema: StructType) -> HeaderReader:
        return HeaderReader(self.options["path"], int(self.options.get("tasks", TASKS)))


def read_headers(spark: SparkSession, path: str, tasks: int = TASKS) -> DataFrame:
    """path, filename, split (the folder), bytes, rate, channels, width, frames, seconds, bytes_read, error of all wav files
    below path. A file that is none has an error and nulls. What is read follows the number of files, not their length."""
    spark.dataSource.register(WavHeaders)
    return spark.read.format("wav_headers").option("tasks", str(tasks)).load(path)
