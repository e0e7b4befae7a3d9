"""Rows whose tasks hold nothing that counts, and numbers that are too long for int()."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from lingloom.llm import jaccard_join, pii

LONG = " ".join(f"w{k}" for k in range(40))


def partitions(spark, *parts):
    """Documents with one partition for each list of (doc_id, text)."""
    rows = spark.sparkContext.parallelize([[(i, t, "en") for i, t in p] for p in parts], len(parts)).flatMap(lambda p: p)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def linked(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in jaccard_join.link_components(df).collect())


def test_jaccard_join_with_a_partition_of_blanks(spark):
    docs = partitions(spark, [(1, LONG), (2, LONG + " x")], [(3, ""), (4, " \n")], [(5, LONG)], [(None, None)])
    assert linked(docs) == [(-1, 0, -1), (1, 36, 1), (2, 37, 1), (3, 0, 3), (4, 0, 4), (5, 36, 1)]
    kept = jaccard_join.representatives(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept if r.doc_id is not None) == [(False, 1), (False, 3), (False, 4)]
    assert sum(r.doc_id is None for r in kept) == 1


def test_jaccard_join_of_blanks_only(spark):
    docs = partitions(spark, [(1, ""), (2, None)], [(None, None)])
    assert linked(docs) == [(-1, 0, -1), (1, 0, 1), (2, 0, 2)]
    assert jaccard_join.representatives(docs).count() == 3


def test_jaccard_join_of_known_classes_only_after_a_send(spark, monkeypatch):
    """The second part of the task has copies of the first part's texts and nothing new."""
    monkeypatch.setattr(jaccard_join, "PART", 30)
    monkeypatch.setattr(jaccard_join, "SLICE", 64)
    docs = partitions(spark, [(k, LONG) for k in range(6)], [(7, LONG + " y")])
    assert linked(docs) == [*((k, 36, 0) for k in range(6)), (7, 37, 0)]


def test_jaccard_join_with_null_ids(spark):
    docs = partitions(spark, [(None, LONG), (3, LONG)], [(None, LONG + " z")])
    got = jaccard_join.link_components(docs).collect()
    assert sorted(r.n_shingles for r in got) == [36, 36, 37]
    assert {r.component_id for r in got if r.doc_id == 3} == {3}


def test_pii_numbers_of_any_length_in_an_address(spark):
    texts = []
    for digits in ("0" * 5000 + "7", "7" * 5000, "0" * 5000):
        for place in range(4):
            parts = ["1", "2", "3", "4"]
            parts[place] = digits
            texts.append("see " + ".".join(parts) + " now")
    got = {r.doc_id: r for r in pii.find_pii(partitions(spark, list(enumerate(texts)))).collect()}

    def small(x):
        x = re.sub("^0+", "", x)
        return len(x) < 3 or (len(x) == 3 and x <= "255")

    for k, text in enumerate(texts):
        spans = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(map(small, m[0].split(".")))]
        assert got[k].n_ip == len(spans)
        assert got[k].base_sha256 == hashlib.sha256(",".join(f"ip:{a}:{b}" for a, b in spans).encode()).hexdigest()
    assert sum(r.n_ip for r in got.values()) == 8


def test_pii_plausible_takes_numbers_of_any_length():
    assert pii.plausible("ip", "0" * 6000 + "1.2.3.4")
    assert not pii.plausible("ip", "9" * 6000 + ".2.3.4")


def test_partitions_are_apart(spark):
    assert partitions(spark, [(1, "a")], [(2, "b")]).select(F.spark_partition_id().alias("p")).distinct().count() == 2


def test_pii_labels_of_long_texts_are_those_of_one_pass():
    """Texts of all lengths together, against a plain Viterbi of each alone; many steps, many and few texts a step."""
    rng, labels = np.random.default_rng(8), len(pii.LABELS)
    banned = np.zeros((labels, labels))
    for b in range(2, labels, 2):
        banned[[a for a in range(labels) if a not in (b - 1, b)], b] = -1e4
    field = pii.Field(rng.normal(0, 1, (5, pii.SHAPES, labels)), rng.normal(0, 1, (labels, labels)) + banned)
    size = np.array([0, 700, 3, 1, *rng.integers(1, 40, 90), 0, 250, 2])
    bounds = np.concatenate([[0], np.cumsum(size)])
    shape = rng.integers(0, pii.SHAPES - 1, bounds[-1])
    got = field.labels(shape, bounds)
    move, inner = field.move.astype(float), (np.arange(labels) > 0) & (np.arange(labels) % 2 == 0)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        seen = np.concatenate([[pii.SHAPES - 1] * 2, shape[a:b], [pii.SHAPES - 1] * 2])
        emit = sum(field.emit[k].astype(float)[seen[k : k + b - a]] for k in range(5)) if b > a else np.zeros((0, labels))
        total = 0.0
        for t in range(b - a):
            total += emit[t, got[a + t]] + (move[got[a + t - 1], got[a + t]] if t else -1e4 * inner[got[a]])
        best = emit[0] - 1e4 * inner if b > a else np.zeros(1)
        for t in range(1, b - a):
            best = (best[:, None] + move).max(0) + emit[t]
        assert abs(best.max() - total) < 1e-2
