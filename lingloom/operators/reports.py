"""Summaries of error rates, and the choice of one hypothesis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_mean(values: Column) -> Column:
    """The mean of an array without its nulls and NaNs; null if nothing is left."""
    real = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.try_divide(F.aggregate(real, F.lit(0.0), lambda acc, x: acc + x), F.size(real).cast("double"))


def best_hypothesis(texts: Column, errors: Column, select: str = "min_cer") -> Column:
    """The text of the smallest error, the first of equals; or always the first one (select='first')."""
    if select == "first":
        return F.get(texts, F.lit(0))
    ranked = F.transform(F.arrays_zip(texts.alias("text"), errors.alias("error")), lambda x, i: F.struct(F.coalesce(x["error"], F.lit(float("inf"))).alias("error"), i.alias("at"), x["text"].alias("text")))
    return F.array_min(ranked)["text"]


def pivot_summary(rows: DataFrame, key: str, split: str, measures: list[str], splits: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """key and {split}_{measure}_mean and _std (sample) for every split and measure."""
    out = []
    for s in splits:
        for m in measures:
            value = F.when((F.col(split) == s) & ~F.isnan(m), F.col(m))
            out += [F.avg(value).alias(f"{s}_{m}_mean"), F.stddev_samp(value).alias(f"{s}_{m}_std")]
    return rows.groupBy(key).agg(*out)
