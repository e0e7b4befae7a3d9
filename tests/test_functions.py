"""Scalar functions on hand-made cases and against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lingloom.functions import bleu, splits, text


def value(spark, column, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in columns.items())).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(("given", "want"), [("a-b、c$ «d»", "abc d"), ("a - b", "a  b"), ("  a　\tb \x1c", "a b"), ("", "")])
def test_normalise(spark, given, want):
    assert value(spark, text.normalise(F.col("x")), x=given) == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates_are_brute_force(spark):
    rng = random.Random(1)
    words = ["a", "b", "cé", "日本", "dd"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(1, 9))), " ".join(rng.choices(words, k=rng.randint(0, 9)))) for _ in range(200)]
    got = spark.createDataFrame(rows, "r string, h string").select("r", "h", text.char_error_rate(F.col("r"), F.col("h")).alias("c"), text.word_error_rate(F.col("r"), F.col("h")).alias("w")).collect()
    for x in got:
        assert x.c == pytest.approx(distance(x.r, x.h) / len(x.r)) and x.w == pytest.approx(distance(x.r.split(), x.h.split()) / len(x.r.split()))
    assert value(spark, text.word_error_rate(F.col("r"), F.col("h")), r="the cat sat on the mat", h="the cat sit on mat now") == 0.5
    assert value(spark, text.char_error_rate(F.col("r"), F.col("h")), r="", h="x") is None


def test_word_distance_past_the_surrogates(spark):
    a = [f"w{k}" for k in range(60000)]
    frame = spark.createDataFrame([(a[:200], a[100:300])], "a array<string>, b array<string>")
    assert frame.select(text.token_distance(F.col("a"), F.col("b"))).first()[0] == 200


@pytest.mark.parametrize(("given", "want"), [("12", 12), ("sp12a3", 123), ("unknown", -1)])
def test_speaker_number(spark, given, want):
    assert value(spark, text.speaker_number(F.col("x")), x=given) == want


@pytest.mark.parametrize(("given", "resolved", "routed"), [(["train", "dev"], "train", "train"), (["dev", "dev"], "dev", "validation"), (["test"], "test", "test"), (["dev", "dev", "test"], "dev", None), (["dev", "test"], "dev", None), ([], None, None)])
def test_splits(spark, given, resolved, routed):
    assert value(spark, splits.resolve(F.col("x")), x=given) == resolved and value(spark, splits.route(F.col("x")), x=given) == routed


def test_class_code_and_distance(spark):
    assert value(spark, text.class_code(["a", "b"], F.col("x")), x="b") == 1 and value(spark, text.class_code(["a", "b"], F.col("x")), x="z") is None
    assert value(spark, text.normalised_distance(F.col("x"), F.col("y")), x="añb", y="anb") == pytest.approx(1 / 3)
    assert value(spark, text.normalised_distance(F.col("x"), F.col("y")), x="", y="") is None


def test_loudness(spark):
    row = spark.range(1).select(F.array(F.lit(0.5), F.lit(-0.5)).alias("x")).select(text.root_mean_square(F.col("x")).alias("r")).withColumn("d", text.decibels(F.col("r"))).select("r", "d", text.gain_to(-25.0, F.col("d")).alias("g")).first()
    assert row.r == pytest.approx(0.5) and row.d == pytest.approx(20 * math.log10(0.5), abs=1e-6) and row.r * row.g == pytest.approx(10 ** (-25 / 20), rel=1e-6)


def test_bleu_by_hand(spark):
    rows = [("k", "the cat sat on the mat", "the cat sat on the mat"), ("none", "x", "y"), ("part", "the the the the cat", "the cat is on the mat")]
    got = {r.k: r.bleu for r in bleu.corpus_bleu(spark.createDataFrame(rows, "k string, h string, r string"), "h", "r", ["k"]).collect()}
    assert got["k"] == pytest.approx(100) and got["none"] == 0
    # 3 of 5 words, 1 of 4 pairs, then none of 3 and 2 smoothed by 1/2 and 1/4; shorter than its reference.
    assert got["part"] == pytest.approx(100 * math.exp(1 - 6 / 5) * (3 / 5 * 1 / 4 * 1 / (2 * 3) * 1 / (4 * 2)) ** 0.25)


def test_13a_tokens(spark):
    assert value(spark, bleu.tokens_13a(F.col("x")), x="Hi, it's 1,000.5 (ok)-yes &amp; 5-6.") == ["Hi", ",", "it's", "1,000.5", "(", "ok", ")", "-yes", "&", "5", "-", "6", "."]


def test_near_distance_is_the_distance_up_to_k(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(600):
        a = "".join(rng.choice("abé🙂") for _ in range(rng.choice([0, 1, 5, 12, 40])))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "é"])
        rows.append((a, "".join(b)))
    rows += [("", ""), ("same", "same"), ("a" * 3000, "a" * 1500 + "b" + "a" * 1500), ("ab" * 40, "ba" * 40)]
    frame = spark.createDataFrame(rows, "a string, b string")
    for k in (0, 2, 3):
        bad = frame.withColumn("d", F.levenshtein("a", "b")).withColumn("want", F.when(F.col("d") <= k, F.col("d")).otherwise(-1))
        assert bad.where(~F.col("want").eqNullSafe(text.near_distance(F.col("a"), F.col("b"), k))).collect() == []
    one = spark.createDataFrame([("abcd", "abxd"), ("", "x"), ("ab", "abc"), ("abc", "abc")], "a string, b string")
    assert [r[0] for r in one.select(text.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 0, 2, 3]
