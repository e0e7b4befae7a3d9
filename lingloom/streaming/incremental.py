"""The same transforms over new files only: each run takes what has arrived since the last, and ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_available(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Applies transform to the new Parquet files below source and appends its rows to out."""
    rows = spark.readStream.schema(schema).parquet(source)
    query = transform(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def run_batches(spark: SparkSession, source: str, schema: str, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands each new batch to write(batch, number), for plans that no single stream can express."""
    spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_repeatable(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *keys: str) -> None:
    """Applies transform, which may join and aggregate, to each batch of new Parquet files, and writes its rows below
    {out}/batch={number}, in folders by keys.

    A batch that failed, even after its write, runs again under its number and replaces all that it wrote: each row is there
    once. out belongs to the checkpoint, which numbers the batches.
    """

    def write(rows: DataFrame, number: int) -> None:
        transform(rows).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*keys).parquet(f"{out}/batch={number}")

    run_batches(spark, source, schema, write, checkpoint)
