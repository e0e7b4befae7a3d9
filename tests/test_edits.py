"""Edit distances of any length against plain Python, and the time that long or many texts take."""

import random
import time

from pyspark.sql import functions as F

from lingloom import plan_queries
from lingloom.functions import bounded, text
from lingloom.sources import tables


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rng, a, most):
    b = list(a)
    for _ in range(rng.randint(0, most)):
        at = rng.randint(0, len(b))
        b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "é", "c🙂"])
    return "".join(b)


def test_distances_of_any_length_are_brute_force(monkeypatch):
    rng = random.Random(31)
    pairs = []
    for _ in range(250):
        a = "".join(rng.choices("abcé🙂", k=rng.choice([0, 1, 5, 63, 64, 65, 130])))
        b = changed(rng, a, 20) if rng.random() < 0.7 else "".join(rng.choices("bcdx", k=rng.randint(0, 140)))
        pairs += [(a, b), (list(a), list(b))]
    want = [plain(a, b) for a, b in pairs]
    assert [bounded.edits(*p) for p in pairs] == want and bounded.all_edits([*pairs, None]) == [*want, None]
    monkeypatch.setattr(bounded, "TOGETHER", 50_000)
    assert bounded.all_edits(pairs) == want
    for name, low in (("WHOLE", 4), ("BLOCK", 8), ("FIRST", 2)):  # bands that grow, and tables of places that slide
        monkeypatch.setattr(bounded, name, low)
    assert bounded.all_edits(pairs) == want


def test_a_long_passage_takes_seconds(spark):
    """The whole matrix has 40,000,000,000 cells."""
    rng = random.Random(5)
    a = "".join(rng.choices("abcdefg ", k=200_000))
    rows = [(a, a[:50_000] + "x" + a[50_003:150_000] + "yz" + a[150_000:])]
    begin = time.time()
    got = spark.createDataFrame(rows, "a string, b string").select(text.normalised_distance(F.col("a"), F.col("b")).alias("d")).first()
    assert got.d == 5 / 200_000 and time.time() - begin < 30


def test_many_sentences_are_measured_in_a_fraction_of_their_cells():
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefgh ", k=1000)) for _ in range(400)]
    begin = time.time()
    got = bounded.all_edits([(t, t.replace("a", "e")) for t in texts])
    assert time.time() - begin < 4 and got[:2] == [plain(t, t.replace("a", "e")) for t in texts[:2]]


def test_white_space_is_that_of_columns(spark):
    """Error rates strip and split by Python, the other columns by Java's classes."""
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).isspace() or c in (0x180E, 0x200B, 0x2060, 0xFEFF, 0x1F, 0x7F))]
    rows = [(c, f"{chr(c)}a{chr(c)}b{chr(c)}") for c in codes]
    for r in spark.createDataFrame(rows, "c int, t string").select("c", "t", text.strip(F.col("t")).alias("s"), text.tokens(F.col("t")).alias("w")).collect():
        assert r.s == r.t.strip() and r.w == r.t.split(), hex(r.c)


def test_only_the_error_rates_that_are_read_are_worked_out(spark):
    for errors in (("cer",), ("wer",), ()):
        fields = plan_queries.scored(spark, "/root/testdata/sf0.001", *errors).schema["recordings"].dataType.elementType.names
        want = errors or ("cer", "wer")
        assert [n for n in fields if n.endswith(("_cer", "_wer"))] == [f"{m}_asr_{e}" for m in ("whisper", "seamlessm4t") for e in want]
    tables.clear_all()
