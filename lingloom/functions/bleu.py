"""Corpus BLEU (13a tokens, n-grams of 1 to 4, exponential smoothing) as sums of columns and a closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = (1, 2, 3, 4)
DEPTH = 3  # times that an n-gram is counted by set operations; what stands in both texts oftener is counted one by one
#: Replacements of the public mteval-v13a tokeniser, in its order (fixed values).
STEPS = (
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
)
RULES = (
    (r"([\x7b-\x7e\x5b-\x60\x20-\x26\x28-\x2b\x3a-\x40/])", " $1 "),
    (r"([^0-9])([.,])", "$1 $2 "),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)


def tokens_13a(text: Column) -> Column:
    """Tokens of a text by the public 13a rules; case stays."""
    for old, new in STEPS:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for old, new in RULES:
        text = F.regexp_replace(text, old, new)
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def ngrams(words: Column, order: int) -> Column:
    """64-bit hashes of all runs of `order` words of an array, sorted; runs of different length never meet."""
    last = F.size(words) - order + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, order)))
    return F.sort_array(F.when(last > 0, grams).otherwise(F.array().cast("array<bigint>")))


def repeated(grams: Column) -> Column:
    """Of sorted n-grams, one entry less of each different one."""
    return F.filter(grams, lambda g, i: (i > 0) & (g == F.get(grams, i - 1)))


def shared(a: Column, b: Column) -> Column:
    """How many different n-grams both have."""
    return F.size(F.array_intersect(a, b))


def shared_counts(a: Column, b: Column) -> Column:
    """How many n-grams of a are in b, each as often at most as there. For the few that stand in a text many times."""
    count = lambda grams, g: F.size(F.filter(grams, lambda x: x == g))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda total, g: total + F.least(count(a, g), count(b, g)))


def statistics(pairs: DataFrame, hypothesis: str, reference: str, keys: list[str]) -> DataFrame:
    """keys, hyp_len, ref_len, match1..match4, total1..total4: sums over the rows of each group.

    An n-gram counts as often as it stands in both texts: once if both have it, once more if both have it again, and so
    on. Each step is a set operation of one row, so nothing but the sums is shuffled.
    """
    frame = pairs.select(*keys, tokens_13a(F.col(hypothesis)).alias("h_"), tokens_13a(F.col(reference)).alias("r_"))
    sums = [F.sum(F.size("h_")).alias("hyp_len"), F.sum(F.size("r_")).alias("ref_len")]
    frame = frame.select("*", *(ngrams(F.col(f"{side}_"), n).alias(f"{side}{n}_0") for n in ORDERS for side in "hr"))
    for step in range(DEPTH):
        frame = frame.select("*", *(repeated(F.col(f"{side}{n}_{step}")).alias(f"{side}{n}_{step + 1}") for n in ORDERS for side in "hr"))
    for n in ORDERS:
        match = sum((shared(F.col(f"h{n}_{step}"), F.col(f"r{n}_{step}")) for step in range(DEPTH)), shared_counts(F.col(f"h{n}_{DEPTH}"), F.col(f"r{n}_{DEPTH}")))
        sums += [F.sum(match).alias(f"match{n}"), F.sum(F.size(f"h{n}_0")).alias(f"total{n}")]
    return frame.groupBy(*keys).agg(*sums)


def score() -> Column:
    """BLEU from 0 to 100, of the columns of statistics()."""
    zeros = F.lit(0)
    logs = F.lit(0.0)
    for n in ORDERS:
        match, total = F.col(f"match{n}"), F.col(f"total{n}")
        zeros = zeros + F.when(match == 0, 1).otherwise(0)
        smooth = F.when(match == 0, F.try_divide(F.lit(1.0), F.pow(F.lit(2.0), zeros) * total)).otherwise(F.try_divide(match.cast("double"), total.cast("double")))
        logs = logs + F.ln(smooth)
    brevity = F.when(F.col("hyp_len") >= F.col("ref_len"), 1.0).otherwise(F.exp(1 - F.try_divide(F.col("ref_len").cast("double"), F.col("hyp_len").cast("double"))))
    none = F.col("match1") + F.col("match2") + F.col("match3") + F.col("match4") == 0
    return F.when(none, 0.0).otherwise(F.coalesce(100 * brevity * F.exp(logs / 4), F.lit(0.0)))


def corpus_bleu(pairs: DataFrame, hypothesis: str, reference: str, keys: list[str]) -> DataFrame:
    """keys, bleu."""
    return statistics(pairs, hypothesis, reference, keys).withColumn("bleu", score()).select(*keys, "bleu")
