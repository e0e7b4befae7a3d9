"""Mixing to target weights with soft membership of documents in domains.

A softmax classifier, trained on a bounded sample of a labelled table, gives each document a posterior over domains.
Documents get rates r >= 0 (how often a mix holds them); the expected tokens of domain k are the sum over documents of
r * tokens * posterior_k. The rates fit these to the targets by least squares, where the squares of domain k weigh one
over its share of the tokens, starting from 1, by accelerated projected gradient steps: r <- max(0, y - posterior . s),
y <- r + momentum * (change of r). As s is all that a step needs, the rate of a document follows from the list of steps:
an iteration is one distributed pass that replays them over the small table (tokens, posteriors) and sums a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingloom.llm.language_id import featured, sample
from lingloom.llm.quality import BITS, features, presence
from lingloom.llm.scratch import stored
from lingloom.llm.words import SLICE, slices, words

#: Domains of the labels table, and the share of the tokens that each should have.
TARGETS = {"clean": 0.88, "poor": 0.07, "toxic": 0.05}


MOST = 60  # steps, each of which is a pass over tokens and posteriors


def label_domain() -> Column:
    return F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "clean").when((F.col("quality") <= 0) & (F.col("toxic") <= 0), "poor")


class Classifier:
    """weight [bucket, domain] and bias of a softmax over the presence of hashed n-grams."""

    def __init__(self, domains: list[str], weight: np.ndarray, bias: np.ndarray, scale: float):
        self.domains, self.weight, self.bias, self.scale = domains, weight, bias, scale

    def posteriors(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, at = features(data, offsets)
        rows = len(offsets) - 1
        norm = np.sqrt(np.maximum(np.bincount(row, minlength=rows), 1))
        z = np.stack([np.bincount(row, self.weight[at, k], rows) / norm for k in range(len(self.domains))], 1) + self.bias
        z = np.exp(self.scale * (z - z.max(1, keepdims=True)))
        return z / z.sum(1, keepdims=True)


def trained(texts: list[np.ndarray], labels: list[str], domains: list[str], share: np.ndarray, epochs: int = 12, rate: float = 0.5, seed: int = 11) -> Classifier:
    """Softmax regression on texts (their buckets) by adaptive gradient steps; a fifth of the texts (in a fixed shuffle) fits its temperature.

    share: of each domain among all labelled rows; the sample may hold other shares, and the bias makes up for it.
    """
    weight, bias = np.zeros((1 << BITS, len(domains))), np.log(np.maximum(share, 1e-9))
    if not texts:
        return Classifier(domains, weight, np.zeros(len(domains)), 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    y = np.array([domains.index(labels[k]) for k in order])
    rows = [texts[k] for k in order]
    cut = max(1, len(texts) - len(texts) // 5)
    # Buckets of one text only say nothing about other texts, and a text of new words must not stand out by them.
    count = np.zeros(1 << BITS, np.int32)
    for at in rows[:cut]:
        count[at] += 1
    rare = count < 3
    own = np.log(np.maximum(np.bincount(y[:cut], minlength=len(domains)), 0.5) / cut)
    free = own.copy()
    square, square_free = np.full(weight.shape, 1e-2), np.full(len(domains), 1e-2)
    for _ in range(epochs):
        for k in rng.permutation(cut):
            at = rows[k][~rare[rows[k]]]
            norm = np.sqrt(max(1, len(rows[k])))
            z = weight[at].sum(0) / norm + free
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            square[at] += (p / norm) ** 2
            weight[at] -= rate * (p / norm) / np.sqrt(square[at])
            square_free += p * p
            free -= 0.1 * rate * p / np.sqrt(square_free)
    bias = free - own + np.log(np.maximum(share, 1e-9))
    test, target = (rows[cut:], y[cut:]) if cut < len(y) else (rows, y)
    z = np.stack([weight[at].sum(0) / np.sqrt(max(1, len(at))) for at in test]) + free
    aim = np.full(z.shape, 1 / (len(target) + len(domains)))
    aim[np.arange(len(target)), target] += 1 - aim.sum(1)

    def loss(scale: float) -> float:
        s = scale * (z - z.max(1, keepdims=True))
        return float((np.log(np.exp(s).sum(1)) - (aim * s).sum(1)).mean())

    return Classifier(domains, weight, bias, min((0.1 * 1.25**k for k in range(20)), key=loss))


def learned(docs: DataFrame, labelled: DataFrame, domains: list[str], per_domain: int) -> Classifier:
    """A classifier of about per_domain texts of each domain; labelled(doc_id, domain)."""
    marks = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    total = {r[0]: r[1] for r in marks.groupBy("domain").count().collect()}
    share = np.array([total.get(d, 0) for d in domains], float)
    draws = sample(marks.withColumn("text", F.lit("")), "domain", per_domain, 37).select("doc_id", "domain")
    # Twice per_domain ids for each domain at most, so the side has a fixed bound.
    # Of rows that share an id the smallest text counts.
    rows = docs.select("doc_id", "text").join(F.broadcast(draws), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text"))
    rows = featured(rows, "domain", presence)
    return trained([x for _, (x,) in rows], [domain for domain, _ in rows], domains, share / max(1.0, share.sum()))


def replayed(posteriors: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps, and the point of which the next step takes the gradient."""
    rate = ahead = np.ones(len(posteriors))
    for t, s in enumerate(steps):
        new = np.maximum(0.0, ahead - posteriors @ s)
        ahead, rate = new + t / (t + 3) * (new - rate), new
    return rate, ahead


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fitted(small: DataFrame, share: np.ndarray, most: int = MOST, tolerance: float = 1e-5) -> list[np.ndarray]:
    """The steps to rates whose expected domain tokens are nearest to share * all tokens; small(n_tokens, posteriors)."""
    width = len(share)

    def sums(steps: list[np.ndarray]) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + 2 * width + width * width)
            for batch in batches:
                p, n = matrix(batch.column("posteriors"), width), batch.column("n_tokens").to_numpy().astype(float)
                rate, ahead = replayed(p, steps)
                total += np.concatenate([[n.sum()], (n * rate) @ p, (n * ahead) @ p, ((p * n[:, None]).T @ p).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "v"])

        out = np.zeros(1 + 2 * width + width * width)
        # Partial sums meet in fixed point, so that their order does not show in the last digits.
        for r in small.select("n_tokens", "posteriors").mapInArrow(add, "k int, v double").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,9)")).cast("double").alias("v")).collect():
            out[r["k"]] = r["v"]
        return out

    steps: list[np.ndarray] = []
    best, kept = np.inf, 0
    while True:
        total = sums(steps)
        all_ = max(total[0], 1.0)
        metric = total[1 + 2 * width :].reshape(width, width) / all_
        weight = 1 / np.maximum(metric.sum(1), 1e-3)
        off = total[1 : 1 + width] / all_ - share
        if (loss := float((weight * off * off).sum())) < best:
            best, kept = loss, len(steps)
        if len(steps) == most or np.abs(off).max() < tolerance:
            return steps[:kept]
        root = np.sqrt(weight)
        size = 1 / max(np.linalg.eigvalsh(metric * root[:, None] * root[None, :])[-1], 1e-9)
        steps = [*steps, size * weight * (total[1 + width : 1 + 2 * width] / all_ - share)]


def mixed_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], per_domain: int = 1200, keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, n_tokens, posteriors, rate, copies for every row of docs(doc_id, text, source, ...).

    labelled(doc_id, domain); targets: weight of each domain, brought to sum 1. The targets of expected domain tokens
    are these shares of all tokens (words) of docs. copies: how often a mix holds the document, the whole part of its
    rate and one more by a hash of its doc_id (of its text too if the id is null) in the share of the rest. Null and
    empty texts have no tokens and the posteriors of a text without features. Labels of unknown domains or without
    documents are ignored; a document labelled twice counts by its largest name. With no labelled text all posteriors
    are equal. Targets that no rates can reach are met as nearly as least squares allows; where posteriors hardly differ
    between documents, the MOST steps end before that. Repeated rows give repeated
    rows; an empty table gives an empty result. keep: columns to carry (doc_id and source by default); one that has the name
    of a column of the result is called {name}_kept.
    """
    domains = sorted(targets)
    share = np.array([targets[d] for d in domains], float)
    share /= share.sum()
    model = learned(docs, labelled, domains, per_domain)
    keep = keep or ["doc_id", "source"]
    name = lambda c: f"`{c.replace('`', '``')}`"
    carried = [f"keep_{k}" for k in range(len(keep))]
    fields = ", ".join(f"{c} {docs.schema[given].dataType.simpleString()}" for c, given in zip(carried, keep, strict=True))

    def member(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text_"), SLICE):
                p = model.posteriors(data, offsets)
                n = words(data, offsets).counts
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in carried), pa.array(n), pa.ListArray.from_arrays(np.arange(0, p.size + 1, len(domains), dtype=np.int32), p.ravel()), batch.column("draw_").slice(lo, hi - lo)], [*carried, "n_tokens", "posteriors", "draw_"])

    draw = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.lit(41), "doc_id")), F.lit(1 << 30)) / float(1 << 30)
    small = docs.select(*(F.col(name(given)).alias(c) for c, given in zip(carried, keep, strict=True)), F.col("text").alias("text_"), draw.alias("draw_")).mapInArrow(member, f"{fields}, n_tokens bigint, posteriors array<double>, draw_ double")
    small = stored(small, "posteriors")
    steps = fitted(small, share)
    width = len(domains)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, _ = replayed(matrix(batch.column("posteriors"), width), steps)
            more = np.floor(r) + (batch.column("draw_").to_numpy() < r - np.floor(r))
            names = [*carried, "n_tokens", "posteriors"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(r), pa.array(more.astype(np.int64))], [*names, "rate", "copies"])

    result = ["n_tokens", "posteriors", "rate", "copies"]
    found = small.mapInArrow(rate, f"{fields}, n_tokens bigint, posteriors array<double>, rate double, copies bigint")
    return found.select(*(F.col(c).alias(f"{given}_kept" if given in result else given) for c, given in zip(carried, keep, strict=True)), *result)
