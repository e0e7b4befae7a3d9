"""Tables that cut lineage, and values for all tasks; each call of an operator keeps its own, and takes them back.

A table is written once to the shared folder that the cluster names, and read back: it survives the loss of executors,
which cached or locally checkpointed blocks do not.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

_written: dict[int, tuple[DataFrame, str]] = {}


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master, whose tasks all see one disk, may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='lingloom-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read back with the same schema."""
    spark = df.sparkSession
    path = f"{folder(spark)}/lingloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (out, path)
    return out


def place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for other files than tables; sweep() deletes what lies there."""
    path = f"{folder(spark)}/lingloom-{uuid.uuid4().hex}/{name}"
    mark = spark.range(0)
    _written[id(mark)] = (mark, path)
    return path


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that stored() gave; nothing that is still to be computed may need them."""
    for table in tables:
        found = _written.pop(id(table), None)
        if found:
            jvm, conf = table.sparkSession._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(found[1])
            path.getFileSystem(conf).delete(path, True)


def sweep() -> None:
    """Deletes the tables written so far; results that still read them must be saved first."""
    dropped(*(table for table, _ in list(_written.values())))


class Shared:
    """Values that one call gives to all tasks, and takes back when all that used them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.given = spark, []

    def give(self, value: object) -> Broadcast:
        self.given.append(self.spark.sparkContext.broadcast(value))
        return self.given[-1]

    def release(self) -> None:
        while self.given:
            self.given.pop().destroy()
