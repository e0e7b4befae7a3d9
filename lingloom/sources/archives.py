"""Ingest of downloaded archives: members of tar.gz files as rows, read in tasks; nothing is unpacked to a disk."""

from __future__ import annotations

import gzip
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lingloom.sources.headers import listed, opened
from lingloom.sources.languages import RENAMED
from lingloom.sources.readers import remaining
from lingloom.sources.sinks import STATUS, done, write_by
from lingloom.sources.tables import delete

SCHEMA = "folder string, lang string, split string, filename string, content binary, error string"
ENDING = ".tar.gz"
#: Bytes of members that a task hands over at a time; a larger one goes alone.
HELD = 16 << 20


def inner(name: str, folder: str) -> list[str]:
    """The path of a member without the folders of the one who packed it: what stands after the archive's own name."""
    parts = [x for x in name.split("/") if x not in ("", ".")]
    return parts[parts.index(folder) + 1 :] if folder in parts[:-1] else parts


class Archive(InputPartition):
    def __init__(self, path: str, folder: str):
        self.path, self.folder = path, folder


class ArchiveReader(DataSourceReader):
    """A task for each archive, as gzip can only be read from its beginning."""

    def __init__(self, path: str, only: list[str] | None):
        self.path, self.only = path.rstrip("/"), only

    def partitions(self) -> list[Archive]:
        _, found = listed(self.path, False)
        names = sorted(x.base_name.removesuffix(ENDING) for x in found if x.base_name.endswith(ENDING))
        return [Archive(f"{self.path}/{n}{ENDING}", n) for n in names if self.only is None or n in self.only] or [Archive("", "")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, path = opened(partition.path)
        rows, held = [], 0
        try:
            # gzip tells a file that is cut off, where tarfile would take it for the end.
            with store.open_input_stream(path, compression=None) as raw, gzip.open(raw) as plain, tarfile.open(fileobj=plain, mode="r|") as tar:
                for member in tar:
                    if not member.isfile():
                        continue
                    content, where = tar.extractfile(member).read(), inner(member.name, partition.folder)
                    stem = where[-1].rpartition(".")[0] or where[-1]
                    rows.append((where[-2] if len(where) > 1 else stem, where[-1], content, None))
                    held += len(content)
                    if held > HELD:
                        yield self.batch_of(partition.folder, rows)
                        rows, held = [], 0
                while plain.read(HELD):
                    pass
        except (tarfile.TarError, EOFError, OSError, zlib.error) as e:
            rows.append((None, None, None, f"{type(e).__name__}: {e}"))
        if rows:
            yield self.batch_of(partition.folder, rows)

    def batch_of(self, folder: str, rows: list[tuple]) -> pa.RecordBatch:
        split, filename, content, error = zip(*rows, strict=True)
        lang = RENAMED.get(folder, folder)
        columns = [pa.array(c, pa.string()) for c in ([folder] * len(rows), [lang] * len(rows), split, filename)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(content, pa.binary()), pa.array(error, pa.string())], [x.split()[0] for x in SCHEMA.split(", ")])


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tar_gz_members"

    def schema(self) -> StructType | str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        only = self.options.get("only")
        return ArchiveReader(self.options["path"], None if only is None else only.split(","))


def read_archives(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """folder, lang, split, filename, content, error of the files in all {folder}.tar.gz below path, or in some of them.

    lang is the speech corpus's code of the folder. split is the folder that a file lies in, or its own name for a file right
    below the language (train.tsv). A damaged archive has a row with the error, after the files that could be read.
    """
    spark.dataSource.register(Archives)
    reader = spark.read.format("tar_gz_members")
    return (reader if only is None else reader.option("only", ",".join(only))).load(path)


def ingested(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Writes the files of the archives below path to out, as Parquet by lang, and returns the status(lang, split, n, error)
    of this run; languages that are there are not read again.

    split of the status is null. An archive that is damaged leaves nothing in out: its language has an error, and the next
    run tries it again. The status is appended to {out}_status. Archives are read once, each by one task.
    """
    _, found = listed(path, False)
    folders = sorted(x.base_name.removesuffix(ENDING) for x in found if x.base_name.endswith(ENDING))  # a name a language
    work = spark.createDataFrame([(f, RENAMED.get(f, f)) for f in folders], "folder string, lang string")
    todo = [r.folder for r in remaining(work, done(spark, out), ["lang"]).collect()]
    if not todo:
        return spark.createDataFrame([], STATUS)
    write_by(read_archives(spark, path, todo).drop("folder"), out, "lang")
    kept = spark.read.schema("split string, filename string, error string, lang string").parquet(out)
    kept = kept.where(F.col("lang").isin([RENAMED.get(f, f) for f in todo]))
    error = F.max("error")
    status = kept.groupBy("lang").agg(F.when(error.isNull(), F.count(F.lit(1))).alias("n"), error.alias("error")).collect()
    for r in status:
        if r.error:
            delete(spark, f"{out}/lang={r.lang}")
    rows = spark.createDataFrame([(r.lang, None, r.n, r.error) for r in status], STATUS)
    rows.coalesce(1).write.mode("append").json(f"{out}_status")
    return rows
