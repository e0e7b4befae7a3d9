"""Quality classifier: support vectors on indicators of n-grams, scaled by naive Bayes log-count ratios.

Features of a text are the presence of its word unigrams and bigrams and of unigrams and bigrams of word shapes
(runs of small letters, capitals or digits as one sign each, other signs as they are), and of runs of one repeated
word of two to five, hashed. Each is scaled by the
log ratio of its smoothed share in the two classes. A linear model with hinge loss is fitted by dual coordinate
descent, and a logistic curve over margins of a part of the sample that the fit does not see makes them probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingloom.llm.language_id import featured, fold, sample
from lingloom.llm.words import SLICE, lowered, mixed, powers, slices, u64, words

BITS = 17
FOLDS, HELD = 4, 2
THRESHOLD = 0.7
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = SHAPE[128:] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("9")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every different feature of each text, in order of rows."""
    w = words(data, offsets)
    if not len(w.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = w.rows()
    shape = SHAPE[data]
    kept = np.ones(len(data), bool)
    kept[1:] = shape[1:] != shape[:-1]
    kept[w.starts] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    signs = shape[kept].astype(np.uint64)
    up, down = powers(1, len(signs))
    total = np.zeros(len(signs) + 1, np.uint64)
    np.cumsum(signs * up[: len(signs)], out=total[1:])
    a, b = place[w.starts], place[w.ends]
    shapes = mixed((total[b] - total[a]) * down[a])
    plain = type(w)(lowered(data), w.starts, w.ends, w.first).hashes()
    keys, rows = [], []
    inner = row[1:] == row[:-1]
    for h in (plain, shapes + u64(1)):
        keys += [h, mixed(h[:-1] * u64(3) + h[1:])[inner]]
        rows += [row, row[1:][inner]]
    same = inner & (plain[1:] == plain[:-1])
    for length in range(2, 6):  # a word repeated so often in a row
        if length > 2:
            same = same[1:] & same[:-1]
        at = np.flatnonzero(same)
        keys.append(np.full(len(at), mixed(np.array([length], np.uint64))[0]))
        rows.append(row[at])
    pair = np.unique(np.concatenate(rows).astype(np.int64) << BITS | (np.concatenate(keys) >> u64(64 - BITS)).astype(np.int64))
    return pair >> BITS, pair & ((1 << BITS) - 1)


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, at = features(data, offsets)
        rows = len(offsets) - 1
        number = np.maximum(np.bincount(row, minlength=rows), 1)
        return np.bincount(row, self.weight[at], rows) / np.sqrt(number) + self.bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(data, offsets) + self.shift, -30, 30)))


def descend(rows: list[np.ndarray], scale: np.ndarray, ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model, by dual coordinate descent.

    Row k has the features ratio[rows[k]] * scale[k] and a constant 1; only the buckets are held.
    """
    weight, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    square = np.array([(ratio[at] ** 2).sum() * s * s + 1 for at, s in zip(rows, scale, strict=True)])
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(len(rows)):
            at = rows[k]
            value = ratio[at] * scale[k]
            slope = y[k] * (weight[at] @ value + bias) - 1
            new = min(max(dual[k] - slope / square[k], 0.0), cost[k])
            if new != dual[k]:
                weight[at] += (new - dual[k]) * y[k] * value
                bias += (new - dual[k]) * y[k]
                moved = max(moved, abs(new - dual[k]))
                dual[k] = new
        if moved < 1e-4:
            break
    return weight, bias


def presence(data: np.ndarray) -> tuple[np.ndarray]:
    """The buckets of one text's features."""
    return (features(data, np.array([0, len(data)]))[1],)


def train(texts: list[np.ndarray], labels: list[int], cost: float = 1.0, epochs: int = 20, smooth: float = 1.0, seed: int = 3) -> Model:
    """A model of labelled texts (their buckets); a quarter of them (in a fixed shuffle) only fits the curve over the margins."""
    if len(set(labels)) < 2:
        only = float(labels[0]) if labels else 1.0
        return Model(np.zeros(1 << BITS), 0.0, 0.0, 20.0 * (2 * only - 1))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    y = np.where(np.array(labels)[order] > 0, 1.0, -1.0)
    found = [texts[k] for k in order]
    cut = max(2, len(texts) - len(texts) // 4)
    if len(set(y[:cut])) < 2:
        cut = len(texts)
    share = []
    for sign in (1, -1):
        count = np.full(1 << BITS, smooth)
        for k in np.flatnonzero(y[:cut] == sign):
            count[found[k]] += 1
        share.append(count / count.sum())
    ratio = np.log(share[0] / share[1])
    scale = np.array([1 / np.sqrt(max(1, len(at))) for at in found])
    cost_of = np.where(y > 0, 0.5 / max(1, (y[:cut] > 0).sum()), 0.5 / max(1, (y[:cut] < 0).sum())) * cut * cost
    weight, bias = descend(found[:cut], scale[:cut], ratio, y[:cut], cost_of[:cut], epochs, rng)
    test = range(cut, len(found)) if cut < len(found) else range(len(found))
    margin = np.array([weight[found[k]] @ ratio[found[k]] * scale[k] + bias for k in test])
    target = (y[cut:] if cut < len(y) else y) > 0
    # Smoothed targets keep the curve finite where classes are apart.
    aim = np.where(target, (target.sum() + 1) / (target.sum() + 2), 1 / ((~target).sum() + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        d, h = p - aim, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(d * margin).sum() + 1e-3 * slope, d.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        move *= min(1.0, 2.0 / np.abs(move).max()) if np.abs(move).max() else 1.0
        slope, shift = slope - move[0], shift - move[1]
    return Model(weight * ratio, float(bias), float(slope), float(shift))


def learned(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> Model:
    """A model of about per_class labelled texts of each class outside the held-out fold (crc32(doc_id) mod 4 = 2)."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD)).groupBy("doc_id").agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("quality"))
    draws = sample(marks.withColumn("text", F.lit("")), "quality", per_class, 31).select("doc_id", "quality")
    # At most 4 * per_class ids of 8 bytes and their labels: bounded whatever the tables hold.
    # Of rows that share an id the smallest text counts.
    rows = docs.select("doc_id", "text").join(F.broadcast(draws), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = featured(rows, "quality", presence)
    return train([x for _, (x,) in rows], [label for label, _ in rows])


def classify(docs: DataFrame, labels: DataFrame, per_class: int = 2500, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text, ...), learned from labels(doc_id, quality, ...).

    score: 0 to 1, higher if label 1 is likelier; a null text counts as empty, and empty texts get the score of a text
    without features. predicted: 1 if score >= threshold. A document labelled twice counts as its lowest label; labels
    without a document, null labels and null ids are not learned from; with one class only, every score is that class.
    held_out of a null doc_id is that of an empty text. Repeated rows give repeated rows; other columns are ignored; an
    empty table gives an empty result.
    """
    model = learned(docs, labels, per_class)
    held = fold(F.col("doc_id"), FOLDS) == HELD

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.concatenate([np.zeros(0), *(model.scores(data, offsets) for _, _, data, offsets in slices(batch.column("text"), SLICE))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got), pa.array((got >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(score, f"doc_id {id_type}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, per_class: int = 2500, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that classify() predicts 1 for, with all their columns, in one pass."""
    model = learned(docs, labels, per_class)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.concatenate([np.zeros(0), *(model.scores(data, offsets) for _, _, data, offsets in slices(batch.column("text"), SLICE))])
            yield batch.filter(pa.array(got >= threshold))

    return docs.mapInArrow(keep, docs.schema)
