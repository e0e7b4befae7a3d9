"""The similarity join against all pairs, with pieces that very many texts share."""

import random

import pytest
from pyspark.sql import functions as F

from lingloom.operators import similarity
from lingloom.sources import tables


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited(rng, text, edits, letters="abcd"):
    out = list(text)
    for _ in range(edits):
        at = rng.randint(0, len(out))
        kind = rng.randint(0, 2)
        if kind == 0 or not out:
            out.insert(at, rng.choice(letters))
        elif kind == 1:
            del out[min(at, len(out) - 1)]
        else:
            out[min(at, len(out) - 1)] = rng.choice(letters)
    return "".join(out)


def frame(spark, texts):
    return spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "text string, ord int")


def found(df):
    rows = [(r.a, r.b, r.distance) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def brute(left, right, k):
    return {(a, b, d) for a in set(left) for b in set(right) if a is not None and b is not None and abs(len(a) - len(b)) <= k and (d := distance(a, b)) <= k}


@pytest.mark.parametrize("hot", [0, 2, 64])
@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_all_pairs_within_k(spark, k, hot):
    """Few letters and a shared beginning: nearly every piece is hot for small limits."""
    rng = random.Random(10 * k + hot)
    right = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(40)]
    right += ["common start " + "".join(rng.choice("abcd") for _ in range(8)) for _ in range(25)] + ["", "é", None, "aaaaaaaaaaaa"]
    left = [edited(rng, rng.choice(right) or "", rng.randint(0, 4)) for _ in range(70)] + [None, "", "🙂b"]
    assert found(similarity.within_distance(frame(spark, left), frame(spark, right), k, hot=hot)) == brute(left, right, k)


def test_keys_keep_hot_pieces_apart(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["x", "y", None]), "shared beginning " + "".join(rng.choice("abc") for _ in range(7))) for _ in range(80)]
    table = spark.createDataFrame(rows, "lang string, text string")
    got = {(r.lang, r.a, r.b, r.distance) for r in similarity.within_distance(table, table, 2, ["lang"], hot=3).collect()}
    assert got == {(x, a, b, distance(a, b)) for x, a in set(rows) for y, b in set(rows) if x == y and x is not None and distance(a, b) <= 2}


def test_a_piece_that_all_texts_share(spark):
    """5,000 texts of one length with one piece in common, against edited copies: no key has more than a few pairs."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    right = ["a beginning in all " + word(61) for _ in range(5000)]
    left = [edited(rng, rng.choice(right), rng.randint(0, 3), "abcdefgh") for _ in range(5000)]
    a = frame(spark, left).select(F.col("text").alias("a")).distinct().withColumn("a_id", F.xxhash64("a"))
    b = frame(spark, right).select(F.col("text").alias("b")).distinct().withColumn("b_id", F.xxhash64("b"))
    sizes = similarity.meetings(a, b, 3, [], tables.Steps(spark)).groupBy("piece").count()
    assert sizes.agg(F.max("count")).first()[0] <= similarity.HOT
    assert sizes.agg(F.sum("count")).first()[0] < 40 * 5000
    got = found(similarity.within_distance(frame(spark, left), frame(spark, right), 3))
    # What this makes is checked from the other side: each left text has the text it was made from, and nothing is over 3.
    assert {a for a, _, _ in got} == set(left) and all(d == distance(a, b) for a, b, d in list(got)[:300])
    few = rng.sample(sorted(set(left)), 40)
    pairs = frame(spark, few).select(F.col("text").alias("a")).crossJoin(frame(spark, right).select(F.col("text").alias("b")).distinct())
    near = found(pairs.select("a", "b", F.levenshtein("a", "b").alias("distance")).where("distance <= 3"))
    assert {x for x in got if x[0] in set(few)} == near
