"""Learned operators against plain solvers and loops, and on odd rows."""

import math
import random
import zlib

import numpy as np
import pytest

from lingloom.llm import decontaminate, language_id, mixing, pii, pseudo_likelihood, quality, token_counts


def bytes_of(text):
    return np.frombuffer(text.encode(), np.uint8)


def test_dual_coordinate_descent_is_the_hinge_loss_solution():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(40, 6, replace=False)) for _ in range(60)]
    ratio, scale = rng.normal(0, 1, 40), rng.uniform(0.3, 1, 60)
    y = np.where(rng.random(60) < 0.6, 1.0, -1.0)
    cost = np.where(y > 0, 0.7, 1.3)
    weight, bias = quality.descend(rows, scale, ratio, y, cost, 4000, np.random.default_rng(2))
    x = np.zeros((60, 41))
    for k, at in enumerate(rows):
        x[k, at], x[k, 40] = ratio[at] * scale[k], 1
    # The dual by projected gradient: least 1/2 a'Qa - sum a, 0 <= a <= cost.
    q, dual = (x * y[:, None]) @ (x * y[:, None]).T, np.zeros(60)
    step = 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(60000):
        dual = np.clip(dual - step * (q @ dual - 1), 0, cost)
    want = (dual * y) @ x
    primal = lambda w: 0.5 * w @ w + cost @ np.maximum(0, 1 - y * (x @ w))
    got = np.append(weight, bias)
    assert primal(got) == pytest.approx(primal(want), rel=1e-3) and np.allclose(got, want, atol=0.02)


def test_quality_features_are_a_plain_loop():
    text = "The cat cat CAT sat. X9 x9 ### the the the the the the end"
    words = text.split()
    shape = lambda w: "".join(c for k, c in enumerate("".join("a" if x.islower() else "A" if x.isupper() else "9" if x.isdigit() else x for x in w)) if k == 0 or c != "".join("a" if x.islower() else "A" if x.isupper() else "9" if x.isdigit() else x for x in w)[k - 1])
    low = [w.lower() for w in words]
    shapes = [shape(w) for w in words]
    runs, longest = set(), 1
    for k in range(1, len(low)):
        longest = longest + 1 if low[k] == low[k - 1] else 1
        runs |= {n for n in range(2, 6) if longest >= n}
    want = len(set(low)) + len(set(zip(low, low[1:]))) + len(set(shapes)) + len(set(zip(shapes, shapes[1:]))) + len(runs)
    assert len(quality.presence(bytes_of(text))[0]) == want


def test_naive_bayes_ratios_decide_a_single_feature():
    """With one word a text, the sign of a word's weight is that of its log-count ratio."""
    found = [quality.presence(bytes_of(w))[0] for w in ["good"] * 30 + ["bad"] * 30 + ["good"] * 3]
    model = quality.train(found, [1] * 30 + [0] * 33)
    scores = model.scores(bytes_of("goodbad"), np.array([0, 4, 7]))
    assert scores[0] > 0.5 > scores[1]


def plain_bucket(gram):
    key = int.from_bytes(gram, "little")
    return ((key + len(gram)) * 2654435761 % 2**32) >> (32 - language_id.BITS)


def test_language_scores_are_a_plain_loop():
    rng = np.random.default_rng(3)
    model = language_id.Model(["a", "b", "c"], rng.normal(0, 1, (1 << language_id.BITS, 3)), rng.normal(0, 1, 3), 1.7, 0.0)
    texts = ["Der  Hund\nläuft", "x", "", "the cat, the CAT", "日本語 text " * 40]
    raw = [t.encode() for t in texts]
    got = model.probabilities(model.logits(bytes_of("".join(texts)), np.concatenate([[0], np.cumsum([len(x) for x in raw])])))
    for text, p in zip(raw, got, strict=True):
        norm = bytes(32 if c in b" \t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in text)
        grams = [plain_bucket(norm[k : k + n]) for n in language_id.SIZES for k in range(len(norm) - n + 1)]
        z = 1.7 * (model.bias + (sum(model.table[g] for g in grams) / len(grams) if grams else 0))
        assert np.allclose(p, np.exp(z - z.max()) / np.exp(z - z.max()).sum())


def test_language_training_lowers_its_loss_to_that_of_a_plain_softmax():
    """Texts of bytes that only one language has: the averaged embeddings tell them apart, and the temperature is calibrated."""
    rng = random.Random(4)
    texts = [("".join(rng.choice("abc" if k % 2 else "xyz") for _ in range(40)), "uv"[k % 2]) for k in range(400)]
    model = language_id.train([language_id.gram_counts(bytes_of(t)) for t, _ in texts], [x for _, x in texts])
    data = [t.encode() for t, _ in texts]
    p = model.probabilities(model.logits(bytes_of("".join(t for t, _ in texts)), np.concatenate([[0], np.cumsum([len(x) for x in data])])))
    right = p[np.arange(400), [model.languages.index(x) for _, x in texts]]
    assert -np.log(right).mean() < 0.05 and 0 < model.least <= 1


@pytest.mark.parametrize(("low", "high", "share"), [(0.0, 1.0, [0.7, 0.2, 0.1]), (0.2, 0.5, [0.9, 0.05, 0.05])])
def test_mixing_is_the_dense_least_squares_solution(spark, low, high, share):
    """Targets within reach, and some out of it."""
    rng = np.random.default_rng(5)
    p = rng.uniform(low, high, (200, 3))
    p /= p.sum(1, keepdims=True)
    n, share = rng.integers(1, 50, 200), np.array(share)
    small = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, posteriors array<double>").repartition(3)
    rate, _ = mixing.replayed(p, mixing.fitted(small, share, most=400, tolerance=1e-9))
    weight = 1 / np.maximum((n @ p) / n.sum(), 1e-3)
    dense = p * (n[:, None] / n.sum()) * np.sqrt(weight)
    want, step = np.ones(200), 1 / np.linalg.eigvalsh(dense.T @ dense)[-1]
    for _ in range(20000):
        want = np.maximum(0, want - step * dense @ (want @ dense - share * np.sqrt(weight)))
    loss = lambda r: float(((r @ dense - share * np.sqrt(weight)) ** 2).sum())
    assert (rate >= 0).all() and loss(rate) == pytest.approx(loss(want), abs=1e-5)
    assert np.allclose((n * rate) @ p / n.sum(), (n * want) @ p / n.sum(), atol=2e-3)


def test_field_likelihood_by_enumeration():
    """Training on one short sequence raises the likelihood that enumeration of all labellings gives."""
    table = [("call ann at b dot org now", [(5, 23, "email")])]
    few, many = pii.trained(table, rounds=1), pii.trained(table, rounds=40)
    start, end, shape, _ = pii.shaped(bytes_of(table[0][0]), np.array([0, len(table[0][0])]))
    gold = np.array([0, 1, 2, 2, 2, 2, 0])

    def likelihood(field):
        shapes = np.concatenate([[pii.SHAPES - 1] * 2, shape, [pii.SHAPES - 1] * 2])[None]
        emit, move = field.scores(shapes)[0].astype(float), field.move.astype(float)
        first = np.where((np.arange(9) > 0) & (np.arange(9) % 2 == 0), -1e4, 0.0)
        total = {(): 0.0}
        score = lambda y: first[y[0]] + sum(emit[t, l] for t, l in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:]))
        # All labellings of O and the two labels of one kind: others have next to no share after training.
        total = [score(y) for y in np.stack(np.meshgrid(*[[0, 1, 2]] * 7, indexing="ij"), -1).reshape(-1, 7)]
        top = max(total)
        return score(gold) - top - math.log(sum(math.exp(x - top) for x in total))

    assert likelihood(many) > likelihood(few) and likelihood(many) > math.log(0.8)


ODD = [(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (None, "a dog ran"), (None, None), (2, None), (3, ""), (4, " \n "), (5, "word " * 30000), (6, "x" * 100000), (7, "ein Hund läuft im Wald")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ["en", None][(i or 0) % 2], f"s{i}", len(t or ""), "e", 0.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, embed string, rate double")


def run(name, spark, docs):
    marks = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    if name == "pii":
        return pii.find_pii(docs)
    if name == "quality":
        return quality.classify(docs, marks)
    if name == "pseudo_likelihood":
        return pseudo_likelihood.score(docs)
    if name == "mixing":
        return mixing.mixed_rates(docs, marks.select("doc_id", mixing.label_domain().alias("domain")), mixing.TARGETS)
    if name == "language_id":
        return language_id.identify(docs)
    if name == "token_counts":
        return token_counts.token_counts(docs, pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    items = spark.createDataFrame([(1, "cat sat on the mat"), (1, "cat sat on the mat")], "item_id long, text string")
    return decontaminate.overlaps(docs, items)


@pytest.mark.parametrize("name", ["pii", "quality", "pseudo_likelihood", "mixing", "language_id", "token_counts", "decontaminate"])
def test_odd_rows(spark, odd, name):
    """One row a row, repeated rows alike, null ids carried through, and nothing on an empty table."""
    got = [tuple(r.asDict().values()) for r in run(name, spark, odd).collect()]
    if name == "decontaminate":
        assert [r[:2] for r in got] == [(1, 1), (1, 1)]
    else:
        assert sorted(str(r[0]) for r in got) == sorted(str(i) for i, _ in ODD)
        assert len({str(r) for r in got if r[0] == 1}) == 1
    assert run(name, spark, odd.limit(0)).collect() == []


def test_a_label_column_of_very_many_values(spark):
    """Only the most frequent values are learned, and neither plan nor driver follows the number of values."""
    rows = [(k, f"text {k} of some words", f"x{k}") for k in range(1500)] + [(5000 + k, f"the water {k}", "en") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = language_id.sample(docs, "lang", 10, 1, most=3).collect()
    assert 0 < len(drawn) <= 60 and len({r.lang for r in drawn}) <= 3 and sum(zlib.crc32(b"") for _ in drawn) == 0
