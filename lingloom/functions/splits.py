"""Names of data splits, resolved from the splits of the recordings of one sentence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resolve(splits: Column) -> Column:
    """train if any is; else dev or test if all are; else the more frequent one, dev on a tie. Null for an empty array."""
    count = lambda name: F.size(F.filter(splits, lambda x: x == name))
    return (
        F.when(F.size(splits) == 0, F.lit(None).cast("string"))
        .when(F.array_contains(splits, "train"), "train")
        .when(F.forall(splits, lambda x: x == "dev"), "dev")
        .when(F.forall(splits, lambda x: x == "test"), "test")
        .otherwise(F.when(count("dev") >= count("test"), "dev").otherwise("test"))
    )


def route(splits: Column) -> Column:
    """train if any is, validation if all are dev, test if all are test; null for mixtures, which are published nowhere."""
    return (
        F.when(F.array_contains(splits, "train"), "train")
        .when((F.size(splits) > 0) & F.forall(splits, lambda x: x == "dev"), "validation")
        .when((F.size(splits) > 0) & F.forall(splits, lambda x: x == "test"), "test")
    )
