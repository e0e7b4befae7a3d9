"""Which paragraphs are covered in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_completeness(linked: DataFrame, reference: DataFrame, keys: list[str], distinct_on: str | None = None) -> DataFrame:
    """linked (without rows of null keys) with full_paragraph: as many rows of its group as reference has. distinct_on: compare
    different values of it instead."""
    group = Window.partitionBy(*keys)
    have = F.size(F.collect_set(distinct_on).over(group)) if distinct_on else F.count(F.lit(1)).over(group)
    need = reference.groupBy(*keys).agg((F.countDistinct(distinct_on) if distinct_on else F.count(F.lit(1))).alias("need_"))
    # A window keeps linked in the plan once; a join with its own counts would have it worked out twice.
    counted = linked.dropna(subset=keys).withColumn("have_", have).join(need, keys, "left")
    return counted.select(*linked.columns, F.coalesce(F.col("have_") == F.col("need_"), F.lit(False)).alias("full_paragraph"))


def paragraph_counts(flagged: DataFrame, keys: list[str], paragraph: str) -> DataFrame:
    """keys, total_paragraphs (with a linked row), retained_paragraphs (in full), missing_paragraphs."""
    one = flagged.groupBy(*keys, paragraph).agg(F.bool_and("full_paragraph").alias("whole"))
    return one.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_paragraphs"),
        F.count_if("whole").alias("retained_paragraphs"),
        F.count_if(~F.col("whole")).alias("missing_paragraphs"),
    )


def widest_count(frame: DataFrame, key: str) -> DataFrame:
    """key and the largest number of non-null values over the other columns."""
    counts = [F.count(c) for c in frame.columns if c != key]
    return frame.groupBy(key).agg((F.greatest(*counts) if len(counts) > 1 else counts[0]).alias("rows"))
