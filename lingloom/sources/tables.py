"""Tables between the steps of a plan: written once to the folder that all executors share, and read back.

A step that is read twice is so worked out once, and a lost executor costs its tasks only: what they read lies in files.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local master, whose tasks see one disk, may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/lingloom"


def delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


class Steps:
    """The tables of one run of a plan. clear() deletes them, once what reads them is written."""

    made: ClassVar[list[Steps]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/steps-{uuid.uuid4().hex}"
        self.made.append(self)

    def keep(self, frame: DataFrame, name: str, *by: str) -> DataFrame:
        """frame, written below the root under that name (in folders by some columns) and read back with the same columns."""
        path = f"{self.root}/{name}"
        frame.write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path).select(*frame.columns)

    def clear(self) -> None:
        delete(self.spark, self.root)
        if self in self.made:
            self.made.remove(self)


def clear_all() -> None:
    """Clears the steps of all plans so far; what still reads them must be saved first."""
    for own in list(Steps.made):
        own.clear()


@contextmanager
def steps(spark: SparkSession) -> Iterator[Steps]:
    """Steps that are cleared at the end, also after an error."""
    own = Steps(spark)
    try:
        yield own
    finally:
        own.clear()
