"""Links between sentences of two corpora: exact, then by normalised text within a few edits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingloom.functions.text import normalise
from lingloom.operators.similarity import nearest
from lingloom.sources.tables import Steps


def voiced(recordings: DataFrame, activity: DataFrame) -> DataFrame:
    """Recordings that some row of activity(filename, is_silent) calls not silent; files without a row go."""
    return recordings.join(activity.where(~F.col("is_silent")).select("filename").distinct(), "filename", "left_semi").select(*recordings.columns)


def rewritten(frame: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """frame with column replaced by mapping.new where mapping.old equals it, all at once. Of several rows of one old value the
    smallest new one counts."""
    one = mapping.groupBy(F.col("old").alias(column)).agg(F.min("new").alias("new_"))
    return frame.join(one, column, "left").withColumn(column, F.coalesce("new_", column)).drop("new_").select(*frame.columns)


def unmatched(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rows of left whose column a no row of right has in column b."""
    return left.join(right.select(*keys, F.col(b).alias(a)).distinct(), [*keys, a], "left_anti").select(*left.columns)


def links(left: DataFrame, right: DataFrame, a: str, b: str, keys: list[str], order: str, k: int = 3, steps: Steps | None = None) -> DataFrame:
    """keys, a, b, match_type (exact or fuzzy), distance: for each different text of left.a its text of right.b.

    Only texts without an exact match go on to the fuzzy join, which compares normalised texts. Where several right texts
    have one normalised form, the last by order stands for it. Left and right are read once, into tables of the steps.
    """
    steps, name = steps or Steps(left.sparkSession), uuid.uuid4().hex[:8]
    wanted = steps.keep(left.select(*keys, F.col(a).alias("a")).where("a IS NOT NULL").distinct(), f"wanted-{name}")
    have = right.select(*keys, F.col(b).alias("b"), F.col(order).alias("ord")).where("b IS NOT NULL").groupBy(*keys, "b").agg(F.min("ord").alias("ord"))
    have = steps.keep(have, f"have-{name}")
    exact = wanted.join(have.select(*keys, F.col("b").alias("a")), [*keys, "a"], "left_semi").select(*keys, "a", F.col("a").alias("b"), F.lit("exact").alias("match_type"), F.lit(0).alias("distance"))
    rest = wanted.join(have.select(*keys, F.col("b").alias("a")), [*keys, "a"], "left_anti").withColumn("text", normalise(F.col("a")))
    named = have.withColumn("text", normalise(F.col("b"))).groupBy(*keys, "text").agg(F.max(F.struct("ord", "b")).alias("last")).select(*keys, "text", F.col("last.b").alias("original"), F.col("last.ord").alias("ord"))
    near = nearest(rest.select(*keys, "text"), named.select(*keys, "text", "ord"), k, keys, steps=steps)
    fuzzy = (
        rest.join(near.withColumnsRenamed({"a": "text", "b": "near"}), [*keys, "text"])
        .join(named.select(*keys, F.col("text").alias("near"), "original"), [*keys, "near"])
        .select(*keys, "a", F.col("original").alias("b"), F.lit("fuzzy").alias("match_type"), "distance")
    )
    return exact.unionByName(fuzzy)
