"""Language identification: averaged hashed embeddings of byte n-grams and a linear softmax.

The vector of a text is the mean of the embeddings of all its n-grams (2, 3 and 4 bytes, A-Z in lower case, white
space as one blank); a linear layer and a softmax give languages. Embeddings and layer are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled texts; a part of the sample that training does
not see fits the temperature of the softmax and the probability under which a prediction is marked as rejected.
As both layers are linear, a trained model is one table of scores [bucket, language] that is averaged over n-grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingloom.llm.words import SLICE, SPACE, lowered, slices

SIZES = (2, 3, 4)
BITS = 15
FOLDS, HELD = 3, 1
UNKNOWN = "und"
MOST_LABELS = 500  # values of a label that are learned, the most frequent first


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def buckets(data: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte of normalised data (the last size - 1 bytes start none)."""
    n = max(0, len(data) - size + 1)
    key = np.zeros(n, np.uint32)
    for k in range(size):
        key |= data[k : k + n].astype(np.uint32) << np.uint32(8 * k)
    return ((key + np.uint32(size)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def normalised(data: np.ndarray) -> np.ndarray:
    out = lowered(data)
    out[SPACE[out]] = 32
    return out


def gram_sums(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of table[bucket] over the n-grams of each text, and their number."""
    rows = len(offsets) - 1
    total, number = np.zeros((rows, table.shape[1])), np.zeros(rows, np.int64)
    data = normalised(data)
    for size in SIZES:
        idx = buckets(data, size)
        lo, hi = offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - size + 1)
        number += hi - lo
        for c in range(table.shape[1]):
            sums = np.concatenate([[0.0], np.cumsum(table[:, c][idx], dtype=np.float64)])
            total[:, c] += sums[np.minimum(hi, len(idx))] - sums[np.minimum(lo, len(idx))]
    return total, number


def any_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    lower = lowered(data)
    seen = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122))])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for k in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[k] = any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8"))
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # scores [bucket, language]
    bias: np.ndarray
    scale: float  # one over the temperature
    least: float  # predictions of a lower probability are rejected

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, number = gram_sums(data, offsets, self.table)
        return total / np.maximum(number, 1)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = np.exp(self.scale * (logits - logits.max(1, keepdims=True)))
        return z / z.sum(1, keepdims=True)


def gram_counts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams, each once, and how often it has them."""
    data = normalised(data)
    return np.unique(np.concatenate([buckets(data, size) for size in SIZES]).astype(np.int32), return_counts=True)


def train(texts: list[tuple[np.ndarray, np.ndarray]], langs: list[str], dim: int = 16, epochs: int = 6, rate: float = 0.5, batch: int = 32, seed: int = 5) -> Model:
    """A model of the labelled texts (as gram_counts() gives them); the last fifth (in a fixed shuffle) only calibrates it."""
    languages = sorted(set(langs))
    if not languages:
        return Model([], np.zeros((1 << BITS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    label = np.array([languages.index(x) for x in langs])[order]
    grams = [(at, (counts / max(1, counts.sum())).astype(np.float32)) for at, counts in (texts[k] for k in order)]
    cut = max(1, len(texts) - len(texts) // 5)
    embed = rng.normal(0, 0.1, (1 << BITS, dim)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (dim, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    steps, step = epochs * -(-cut // batch), 0
    for _ in range(epochs):
        for lo in range(0, cut, batch):
            now = rate * (1 - step / steps)
            step += 1
            rows = rng.integers(0, cut, min(batch, cut)) if lo else np.arange(min(batch, cut))
            at, weight = np.concatenate([grams[k][0] for k in rows]), np.concatenate([grams[k][1] for k in rows])
            row = np.repeat(np.arange(len(rows)), [len(grams[k][0]) for k in rows])
            own = embed[at]
            vector = np.stack([np.bincount(row, own[:, d] * weight, len(rows)) for d in range(dim)], 1).astype(np.float32)
            z = vector @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), label[rows]] -= 1
            back = p @ layer.T
            layer -= now * vector.T @ p / len(rows) * 8
            bias -= now * p.mean(0)
            # A mean of many n-grams moves each of them little; the embeddings take a larger step for it.
            np.subtract.at(embed, at, (now * 8) * weight[:, None] * back[row])
    table = embed @ layer
    z = np.array([bias + (table[a] * w[:, None]).sum(0) if len(a) else bias for a, w in (grams[cut:] or grams)])
    y = label[cut:] if cut < len(label) else label
    aim = np.full(z.shape, 1 / (len(y) + len(languages)))  # smoothed, so that a sample without errors gives no certainty
    aim[np.arange(len(y)), y] += 1 - aim.sum(1)

    def loss(scale: float) -> float:
        s = scale * z
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - (aim * s).sum(1)).mean())

    scale = min((0.25 * 1.25**k for k in range(28)), key=loss)
    model = Model(languages, table, bias, scale, 0.0)
    model.least = float(np.quantile(model.probabilities(z).max(1), 0.01))
    return model


def sample(docs: DataFrame, label: str, bound: int, salt: int, most: int = MOST_LABELS) -> DataFrame:
    """About `bound` rows of docs with each value of the label, and never above twice as many rows as that in all.

    Rows are taken by a hash of their text, at a rate from the exact counts of the values, so no group meets in one task;
    the first by the hash, should there be too many. Of labels beyond the `most` most frequent none is taken.
    """
    counts = docs.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(most)
    rates = counts.select(F.col(label), F.least(F.lit(1.0), F.lit(float(bound)) / F.col("count")).alias("rate_"))  # `most` rows at most
    draw = F.pmod(F.xxhash64(F.lit(salt), F.col("text"), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    drawn = docs.join(F.broadcast(rates), label).withColumn("draw_", draw).where("draw_ < rate_")
    return drawn.orderBy("draw_", "doc_id").limit(2 * bound * max(1, counts.count())).select(*docs.columns)


def featured(rows: DataFrame, label: str, features: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> list[tuple[object, tuple[np.ndarray, ...]]]:
    """(label, arrays) of each row (text, label), in an order of their own, so that a model does not hang on how rows arrive.

    The tasks turn texts into arrays of whole numbers, of as many entries as there are buckets at most: the driver gets
    no text, however long.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                arrays = features(np.frombuffer((text.as_py() or "").encode(), np.uint8))
                out.append([x.astype(np.int32).tobytes() for x in arrays])
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.list_(pa.binary()))], ["label", "arrays"])

    kind = rows.schema[label].dataType.simpleString()
    got = rows.select(F.col(label).alias("label"), "text").mapInArrow(find, f"label {kind}, arrays array<binary>").collect()
    got = sorted((tuple(map(bytes, r["arrays"])), r["label"]) for r in got)
    return [(value, tuple(np.frombuffer(x, np.int32) for x in arrays)) for arrays, value in got]


def identify(docs: DataFrame, per_language: int = 800) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs(doc_id, text, lang, ...).

    It learns from about `per_language` texts of each non-null lang (of the MOST_LABELS most frequent) outside the held-out fold (crc32(doc_id) mod 3 = 1;
    a null doc_id counts as an empty text). lang_pred is a learned language, or `und` with score 0 if the text is null,
    empty or has no letter, or nothing could be learned. score: the calibrated probability. rejected: it is `und` or
    the score is under that of the lowest hundredth of the calibration texts. Repeated rows give repeated rows; other
    columns are ignored; an empty table gives an empty result.
    """
    held = fold(F.col("doc_id"), FOLDS) == HELD
    known = docs.select("doc_id", "text", "lang").where(~held & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = featured(sample(known, "lang", per_language, 29), "lang", gram_counts)
    model = train([x for _, x in rows], [lang for lang, _ in rows])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            best, score = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, data, offsets in slices(batch.column("text"), SLICE):
                p = model.probabilities(model.logits(data, offsets))
                known = any_letter(data, offsets) & bool(model.languages)
                best.append(np.where(known, p.argmax(1), len(model.languages)))
                score.append(np.where(known, p.max(1), 0.0))
            which, value = np.concatenate(best), np.concatenate(score)
            rejected = (which == len(model.languages)) | (value < model.least)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names[which], pa.string()), pa.array(value), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(predict, f"doc_id {id_type}, held_out boolean, lang_pred string, score double, rejected boolean")
