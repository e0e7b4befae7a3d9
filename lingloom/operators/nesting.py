"""Many rows under one: nesting into arrays of structs in a fixed order, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nest(frame: DataFrame, keys: list[str], order: list[str], nested: list[str], name: str = "items", first: list[str] | None = None) -> DataFrame:
    """keys, the first non-null value (in order) of each column of `first`, and an array of structs of the nested columns, in order."""
    ranked = F.struct(*order)
    kept = [F.min_by(c, F.when(F.col(c).isNotNull(), ranked)).alias(c) for c in first or []]
    items = F.array_sort(F.collect_list(F.struct(ranked.alias("order_"), F.struct(*nested).alias("item_"))))
    return frame.groupBy(*keys).agg(*kept, F.transform(items, lambda x: x["item_"]).alias(name))


def parallel_arrays(frame: DataFrame, nested: list[str], name: str = "items") -> DataFrame:
    """The array of structs as one array for each field."""
    return frame.select("*", *(F.col(name)[c].alias(c) for c in nested)).drop(name)


def unnest(frame: DataFrame, name: str = "items") -> DataFrame:
    """One row for each element, with its fields as columns."""
    return frame.select(*(c for c in frame.columns if c != name), F.inline(name))


def unnest_arrays(frame: DataFrame, names: list[str]) -> DataFrame:
    """Parallel arrays flattened in step, by one generator."""
    return frame.select(*(c for c in frame.columns if c not in names), F.inline(F.arrays_zip(*names)))


def is_constant(values: Column) -> Column:
    """Whether an array holds one different value only."""
    return F.size(F.array_distinct(values)) == 1


def numbered(frame: DataFrame, keys: list[str], order: list[str], name: str = "sentence_idx") -> DataFrame:
    """Rows numbered from 0 within their group."""
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def with_media(items: Column, prefix: Column, rate: int = 16000) -> Column:
    """Elements with a field audio: path and sampling rate of each file of their field recordings (split, filename, ...)."""

    def path(recording: Column) -> Column:
        return F.struct(F.concat_ws("/", prefix, recording["split"], recording["filename"]).alias("path"), F.lit(rate).alias("sampling_rate"))

    return F.transform(items, lambda x: x.withField("audio", F.transform(x["recordings"], path)))
