"""Masked pseudo-likelihood of texts under a bidirectional window network.

The network predicts every word from both sides, and its vocabulary grows with the corpus: every word that occurs more
than once is its own. Words that occur once are one entry, which each has an equal share of.

The output layer is a hierarchical softmax. Its first step is a softmax over 128 classes: the most frequent words are a
class each, the others fall into the rest by their hash. The words of a class are the leaves of a binary tree, split by
their counts. Nodes above enough occurrences (thresholds()) have weights, and start from the counts of their sides; below, words
have the share of their counts, which so few occurrences would not change. The probabilities of all words add up to one.
The hidden layer sees the classes of the two words before and after, by place, and a vector of each word of enough
occurrences. As enough grows with the root of the number of words, so do the numbers of nodes and vectors.

All is gathered from all documents. Words (by 64-bit hashes) are counted exactly in a shuffle. Documents are dealt to
splits by a hash, a number of splits that follows the number of words. A split masks each of its words once, in short runs
whose order is drawn from its number, and learns to predict it, from common weights; the weights of the splits of a round are averaged,
those of a node or word by the words that met it, and the next round starts from there. The first start has the
probabilities of counts alone. Averages are sums of whole numbers, so neither the partitions of the input nor the order
of sums shows in the weights: scores differ by rounding in single precision only. A round that predicts words it has not
learned from worse than their counts do is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingloom.llm.scratch import Shared
from lingloom.llm.words import SLICE, lowered, slices, u64, words

CLASSES = 128
FREQUENT = 64
LEAST = 64  # occurrences of the words below a node that has weights, at the least
SHARDS = 1024  # of hashes
ROWS = 1 << 13  # nodes or words of which weights travel together
CHUNK = 8 * 1024  # words whose paths are found together
HIDDEN = 16
AROUND = (-2, -1, 1, 2)
GAP = max(AROUND)
RUN = 16  # places of a text that are learned together: their neighbours are read once
BATCH = 1024
NONE = CLASSES  # beyond the text
WORDS = 1 << 22  # words of a split, about
SHARES = (0.125, 0.5, 1.0)  # of the splits, by the end of each round
RATE = 0.03
ROW_RATE = 0.1
ONES = np.ones(HIDDEN, np.float32)  # a product with these sums each row
FIXED = float(1 << 20)  # steps of one in sums of whole numbers


def hashes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts (A-Z in lower case), and the index of each text's first word."""
    w = words(lowered(data), offsets)
    return w.hashes(), w.first


def begins(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return np.flatnonzero(new)


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, in order, and how often it is there."""
    hashes = np.sort(hashes)
    first = begins(hashes)
    return hashes[first], np.diff(first, append=len(hashes))


def added(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows of x from each of first up to the next. Two columns are added as one complex number: half the steps."""
    return np.add.reduceat(x.view(np.result_type(x.dtype, np.complex64)), first).view(x.dtype)


def ordered(values: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (32 bits) in order, and their places; sorted as one number, which is several times faster than by an index."""
    key = np.sort(values.astype(np.int64) << 32 | places)
    return key >> 32, key & 0xFFFFFFFF


def summed(hashes: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once, in order, and the sum of its numbers."""
    order = np.argsort(hashes)
    hashes = hashes[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(number[order], first) if len(first) else np.zeros(0, np.int64)


def counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes, in order, and numbers of the words that occur more than once; and how many words occur once."""
    names = ["shard", "hashes", "counts", "once"]
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def packed(shards: np.ndarray, h: np.ndarray, n: np.ndarray, cut: np.ndarray, once: int) -> pa.RecordBatch:
        columns = [pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in shards], pa.binary()) for x in (h, n)]
        return pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), *columns, pa.array([once] * len(shards), pa.int64())], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [none], 0

        def send() -> pa.RecordBatch:
            h, n = summed(*map(np.concatenate, zip(*held, strict=True)))
            cut = np.searchsorted(h >> u64(54), np.arange(SHARDS + 1, dtype=np.uint64))
            return packed(np.flatnonzero(np.diff(cut)), h, n, cut, 0)

        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text"), SLICE):
                h, _ = hashes_of(data, offsets)
                held.append(counted(h))
                size += len(held[-1][0])
                if size > 1 << 21:
                    held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                    size = 0
                    if len(held[0][0]) > 1 << 21:
                        yield send()
                        held = [none]
        yield send()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault(r["shard"], []).append((np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["counts"], np.int64)))
        for shard in held:
            h, n = summed(*map(np.concatenate, zip(*held[shard], strict=True)))
            more = n > 1
            yield packed(np.array([shard]), h[more], n[more], {shard: 0, shard + 1: int(more.sum())}, int((~more).sum()))

    schema = "shard int, hashes binary, counts binary, once long"
    rows = docs.select("text").mapInArrow(count, schema).repartition("shard").mapInArrow(add, schema).collect()
    rows.sort(key=lambda r: r["shard"])
    h, n = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[name], kind) for r in rows)]) for name, kind in (("hashes", np.uint64), ("counts", np.int64)))
    return h, n, sum(r["once"] for r in rows)


@dataclass
class Vocabulary:
    """Words by their hashes, in order, and one entry more for those that occur once.

    Of each word: its class, its leaf, the log of its share below the last node, and the row of its vector (the last row
    is of no word). Of each node: the first leaf on its right, the nodes on its left and right (-1: none has weights), and
    the log odds of its right side by counts. top: the highest node of each class.
    """

    hashes: np.ndarray
    of_word: np.ndarray
    leaf: np.ndarray
    rest: np.ndarray
    row: np.ndarray
    rows: int
    middle: np.ndarray
    below: np.ndarray
    prior: np.ndarray
    top: np.ndarray
    of_class: np.ndarray
    start: np.ndarray | None = None

    def find(self, hashes: np.ndarray) -> np.ndarray:
        n = len(self.hashes)
        if self.start is None:  # where the hashes of the same first bits begin: one each, about
            self.shift = u64(64 - max(n.bit_length(), 1))
            self.start = np.append(0, np.cumsum(np.bincount((self.hashes >> self.shift).astype(np.int64), minlength=1 << n.bit_length()))).astype(np.int32)
            self.ended = np.append(self.hashes, u64(-1))
        at = self.start.take((hashes >> self.shift).astype(np.int64))
        on, own = np.arange(len(at)), at
        while len(on):
            less = np.flatnonzero(self.ended.take(own) < hashes.take(on))
            on, own = on.take(less), own.take(less) + np.int32(1)
            at[on] = own
        at[self.ended.take(at) != hashes] = n
        return at

    def levels(self, found: np.ndarray, hidden: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(which words, their nodes, whether they go right, their rows of hidden) for each level of the trees from the top.
        Words come in the order of their leaves, so the nodes of a level are in order too."""
        top = self.top.take(self.of_word.take(found))
        some = np.flatnonzero(top >= 0)
        leaf, which = ordered(self.leaf.take(found.take(some)), some)
        node, own, below = top.take(which), hidden.take(which, 0), self.below.ravel()
        while len(which):
            right = leaf >= self.middle.take(node)
            yield which, node, right, own
            node = below.take(2 * node + right)
            on = np.flatnonzero(node >= 0)
            if len(on) < len(node):
                which, node, leaf, own = which.take(on), node.take(on), leaf.take(on), own.take(on, 0)


def thresholds(size: int) -> tuple[int, int]:
    """In a corpus of so many words: the occurrences from which on a word has a vector, and a node has weights."""
    branch = max(LEAST, int(size**0.5 / 12))
    return branch // 4, branch


def vocabulary(hashes: np.ndarray, number: np.ndarray, once: int) -> Vocabulary:
    n = len(hashes)
    learn_from, branch_from = thresholds(int(number.sum()) + once)
    of_word = np.append(FREQUENT + ((hashes >> u64(32)) * u64(CLASSES - FREQUENT) >> u64(32)).astype(np.int16), np.int16(FREQUENT)).astype(np.int16)
    frequent = np.lexsort((hashes, -number))[:FREQUENT]
    of_word[frequent] = np.arange(len(frequent))
    count = np.append(number, once)
    order = np.argsort(of_word, kind="stable")
    leaf = np.empty(n + 1, np.int32)
    leaf[order] = np.arange(n + 1)
    total = np.concatenate([[0], np.cumsum(count[order])])
    bounds = np.searchsorted(of_word[order], np.arange(CLASSES + 1))
    lo, hi = bounds[:-1], bounds[1:]
    levels, middle, prior, ends, number_of = [], [], [], [], 0
    while len(lo):
        on = np.flatnonzero((hi - lo > 1) & (total[hi] - total[lo] >= branch_from))
        named = np.full(len(lo), -1, np.int32)
        named[on] = number_of + np.arange(len(on))
        levels.append(named)
        off = np.setdiff1d(np.arange(len(lo)), on)
        ends.append(np.stack([lo[off], hi[off]]))
        lo, hi = lo[on], hi[on]
        mid = np.clip(np.searchsorted(total, (total[lo] + total[hi]) / 2), lo + 1, hi - 1)
        middle.append(mid)
        prior.append(np.log(np.maximum(total[hi] - total[mid], 0.5) / np.maximum(total[mid] - total[lo], 0.5)))
        number_of += len(on)
        lo, hi = np.stack([lo, mid], 1).ravel(), np.stack([mid, hi], 1).ravel()
    below = np.concatenate([np.zeros((0, 2), np.int32), *(x.reshape(-1, 2) for x in levels[1:])])
    lo, hi = np.concatenate(ends, 1)
    by = np.argsort(lo, kind="stable")
    lo, hi = lo[by], hi[by]
    share = np.empty(n + 1)
    share[order] = np.log(np.maximum(count[order], 0.5)) - np.repeat(np.log(np.maximum(total[hi] - total[lo], 0.5)), hi - lo)
    share[n] -= np.log(max(once, 1))
    learned = np.flatnonzero(number >= learn_from)
    row = np.full(n + 1, len(learned), np.int32)
    row[learned] = np.arange(len(learned))
    of_class = np.bincount(of_word, count, CLASSES)
    return Vocabulary(hashes, of_word, leaf, share.astype(np.float32), row, len(learned) + 1, np.concatenate(middle).astype(np.int32), below, np.concatenate(prior).astype(np.float32), levels[0], of_class)


def with_one(h: np.ndarray) -> np.ndarray:
    """A column of ones beside the hidden layer, for the bias."""
    return np.hstack([h, np.ones((len(h), 1), h.dtype)])


class Network:
    """Weights: embed [place, class, hidden], inner bias, layer [hidden, class], bias."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights
        self.buffer = np.empty((BATCH, CLASSES), weights[2].dtype)

    @staticmethod
    def start(number: np.ndarray, seed: int = 13) -> Network:
        """The probabilities of the classes by their counts, whatever stands around."""
        rng = np.random.default_rng(seed)
        bias = np.log((number + 1e-2) / (number + 1e-2).sum())
        weights = (rng.normal(0, 0.3, (len(AROUND), CLASSES + 1, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, CLASSES)), bias)
        return Network([x.astype(np.float32) for x in weights])

    def hidden(self, around: np.ndarray, more: np.ndarray | float = 0) -> np.ndarray:
        embed, inner = self.weights[:2]
        return np.tanh(inner + sum(embed[k].take(around[:, k], 0) for k in range(len(AROUND))) + more)

    def exponentials(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the scores of all classes, less a bound of theirs where they could grow too large, in the one buffer; and their sums."""
        layer, bias = self.weights[2:]
        z = np.matmul(h, layer, out=self.buffer[: len(h)])
        z += bias - z.dtype.type(max(0.0, float((np.abs(layer).sum(0) + bias).max()) - 60))
        np.exp(z, out=z)
        return z, z @ np.ones(CLASSES, z.dtype)

    def of_hidden(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probabilities of the classes of at most BATCH words."""
        z, total = self.exponentials(h)
        return np.log(np.maximum(z[np.arange(len(z)), target], z.dtype.type(1e-30)) / total)

    def gradients(self, around: np.ndarray, target: np.ndarray, more: np.ndarray | float = 0) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Gradients of the summed loss of at most BATCH words by the weights; the hidden layer; the gradient by each word's sum below it."""
        embed, inner, layer, bias = self.weights
        h = self.hidden(around, more)
        z, total = self.exponentials(h)
        z.ravel()[np.arange(0, z.size, CLASSES) + target] -= total  # the gradient times the total, which is taken out where there are fewer columns
        part = (1 / total)[:, None]
        back = (z @ layer.T) * part * (1 - h * h)
        by_layer = (z.T @ (with_one(h) * part)).T
        # The rows of a class at a place are summed by sorting: far faster than adding one at a time.
        keys = (around + np.arange(len(AROUND), dtype=np.int16) * np.int16(CLASSES + 1)).T.ravel()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = begins(keys)
        by_embed = np.zeros_like(embed)
        of = np.tile(np.arange(len(back)), len(AROUND)).take(order)
        by_embed.reshape(-1, HIDDEN)[keys[first]] = added(back.take(of, 0), first)
        return [by_embed, np.ones(len(back), back.dtype) @ back, by_layer[:-1], by_layer[-1]], h, back


class Steps:
    """Steps against gradients, shorter the more a weight has moved: one scale a weight, or one a row."""

    def __init__(self, shapes: list[tuple[int, ...]]):
        self.square = [np.full(s, 1e-2, np.float32) for s in shapes]

    def move(self, weights: list[np.ndarray], gradients: list[np.ndarray], size: int) -> None:
        for w, g, s in zip(weights, gradients, self.square, strict=True):
            g = g * np.float32(1 / np.sqrt(size))
            s += g * g
            w -= np.float32(RATE) * g / np.sqrt(s)


class Rows:
    """A vector for each node or word, and how many words have met it since the start."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.float32)
        self.met, self.square = np.zeros(len(vectors), np.int32), np.full(len(vectors), 1e-2, np.float32)

    def move(self, rows: np.ndarray, g: np.ndarray, number: np.ndarray) -> None:
        """One step of each of these rows against its gradient summed over so many words, shorter the more a row has moved."""
        square = self.square.take(rows) + (g * g) @ ONES / number.astype(np.float32)
        self.square[rows] = square
        g *= (np.float32(ROW_RATE) / np.sqrt(square * number.astype(np.float32)))[:, None]
        whole = np.dtype((np.void, g.itemsize * HIDDEN))  # a row is set as one value
        self.vectors.view(whole).ravel()[rows] = np.subtract(self.vectors.take(rows, 0), g, out=g).view(whole).ravel()
        self.met[rows] = self.met.take(rows) + number

    def packed(self) -> Iterator[tuple[int, bytes]]:
        """Rows that were met, in shards: their places, times met, and vectors times that."""
        for lo in range(0, len(self.met), ROWS):
            used = np.flatnonzero(self.met[lo : lo + ROWS])
            if len(used):
                yield lo // ROWS, pack(used, self.met[lo + used], self.vectors[lo + used])


def pack(at: np.ndarray, met: np.ndarray, vectors: np.ndarray) -> bytes:
    return at.astype(np.int16).tobytes() + met.astype(np.int64).tobytes() + vectors.astype(np.float16).tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) // (10 + 2 * HIDDEN)
    return np.frombuffer(data, np.int16, n).astype(np.int64), np.frombuffer(data, np.int64, n, 2 * n), np.frombuffer(data, np.float16, n * HIDDEN, 10 * n).reshape(n, HIDDEN)


def seen(vectors: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The sum of the vectors of the words around, each turned by its place."""
    out = vectors.take(near[:, 0], 0).astype(np.float32)
    for k in range(1, len(AROUND)):
        v = vectors.take(near[:, k], 0)
        out[:, 4 * k :] += v[:, : HIDDEN - 4 * k]
        out[:, : 4 * k] += v[:, HIDDEN - 4 * k :]
    return out


def turned(x: np.ndarray) -> np.ndarray:
    """[place, hidden] to [hidden // 4, (place, hidden % 4)]: places lie together, and turning is by whole rows."""
    return x.view(np.complex128).T.copy().view(np.float32)


def straight(x: np.ndarray) -> np.ndarray:
    """What turned() was given."""
    return x.view(np.complex128).T.copy().view(np.float32)


def along(vectors: np.ndarray, rows: np.ndarray, runs: int = 1) -> np.ndarray:
    """seen() of the places of runs of one length, but for GAP at both ends; a vector is read once for all words around.
    Places are in order, those of all runs together."""
    v, size = turned(vectors.take(rows, 0)), 4 * (len(rows) - 2 * GAP * runs)
    out = v[:, :size].copy()
    for k, step in enumerate(AROUND[1:], 1):
        here = v[:, 4 * runs * (GAP + step) :][:, :size]
        out[k:] += here[:-k]
        out[:k] += here[-k:]
    return straight(out)


def across(back: np.ndarray, runs: int = 1) -> np.ndarray:
    """Gradients by the vectors of all places of runs, from those by what along() gives."""
    b, size = turned(back), 4 * len(back)
    out = np.zeros((len(b), size + 8 * GAP * runs), np.float32)
    for k, step in enumerate(AROUND):
        here = out[:, 4 * runs * (GAP + step) :][:, :size]
        here[: len(b) - k] += b[k:]
        here[len(b) - k :] += b[:k]
    return straight(out)


def beside(values: np.ndarray, runs: int = 1) -> list[np.ndarray]:
    """For each of AROUND, the values there of the places of runs but for GAP at both ends."""
    return [values[runs * (GAP + step) : len(values) - runs * (GAP - step)] for step in AROUND]


def context(values: np.ndarray, first: np.ndarray, none: int) -> np.ndarray:
    """Values around each word [word, place]; none beyond its text."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at, lo, hi = np.arange(len(values)), first[row], first[row + 1]
    out = np.full((len(at), len(AROUND)), none, values.dtype)
    for k, step in enumerate(AROUND):
        ok = (at + step >= lo) & (at + step < hi)
        out[ok, k] = values[at[ok] + step]
    return out


def apart(values: np.ndarray, first: np.ndarray, none: int) -> np.ndarray:
    """Values with enough of none between two texts that no word has a neighbour of another text."""
    out = np.full(len(values) + GAP * len(first), none, values.dtype)
    out[places(first)] = values
    return out


def places(first: np.ndarray) -> np.ndarray:
    """Where the words stand in what apart() gives."""
    return np.arange(first[-1]) + GAP * (1 + np.repeat(np.arange(len(first) - 1), np.diff(first)))


@dataclass
class Weights:
    """All that is learned: the network's weights, and the vectors of nodes and of words."""

    dense: list[np.ndarray]
    nodes: np.ndarray
    near: np.ndarray


def started(vocab: Vocabulary) -> Weights:
    return Weights(Network.start(vocab.of_class).weights, np.zeros((len(vocab.middle), HIDDEN), np.float16), np.zeros((vocab.rows, HIDDEN), np.float16))


class Model:
    """Log-probabilities of words under the weights."""

    def __init__(self, vocab: Vocabulary, weights: Weights):
        self.vocab, self.net = vocab, Network(weights.dense)
        self.nodes, self.near = weights.nodes.astype(np.float32), weights.near.astype(np.float32)

    def of_hidden(self, found: np.ndarray, hidden: np.ndarray) -> np.ndarray:
        vocab = self.vocab
        out, target = vocab.rest[found].astype(np.float64), vocab.of_word[found]
        for lo in range(0, len(out), BATCH):
            out[lo : lo + BATCH] += self.net.of_hidden(hidden[lo : lo + BATCH], target[lo : lo + BATCH])
        lost = np.zeros(len(out), np.float32)
        for which, node, right, own in vocab.levels(found, hidden):
            z = vocab.prior.take(node) + np.einsum("ij,ij->i", own, self.nodes.take(node, 0))  # the same wherever a row stands
            np.negative(z, out=z, where=right)
            lost[which] += np.maximum(z, 0) + np.log(1 + np.exp(-np.abs(z)))
        return out - lost

    def scores(self, found: np.ndarray, around: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Of words (by their places in the vocabulary) with the classes and rows of the words around them."""
        chunks = [slice(lo, lo + CHUNK) for lo in range(0, len(found), CHUNK)]
        return np.concatenate([np.zeros(0), *(self.of_hidden(found[c], self.net.hidden(around[c], seen(self.near, near[c]))) for c in chunks)])

    def of_texts(self, found: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of all words of texts, in their order."""
        vocab, at, out = self.vocab, places(first), [np.zeros(0)]
        classes, rows = apart(vocab.of_word[found], first, NONE), apart(vocab.row[found], first, vocab.rows - 1)
        for lo in range(0, len(found), CHUNK):
            own = at[lo : lo + CHUNK]
            run = slice(own[0] - GAP, own[-1] + GAP + 1)
            own = own - own[0]
            around = np.stack([x.take(own) for x in beside(classes[run])]).T
            out.append(self.of_hidden(found[lo : lo + CHUNK], self.net.hidden(around, along(self.near, rows[run]).take(own, 0))))
        return np.concatenate(out)


def learn(vocab: Vocabulary, weights: Weights, found: np.ndarray, first: np.ndarray, split: int) -> tuple[Weights, Rows, Rows, np.ndarray]:
    """The weights after all words of a split; the rows of nodes and words; and, of some words before they are learned: how
    many, and the sums of their log-probabilities by the weights so far and by counts."""
    rng = np.random.default_rng([19, split])
    end = -len(found) - GAP * (len(first) - 1)  # up to the next whole run
    filled = lambda values, none: np.append(apart(values, first, none), np.full(end % RUN + GAP, none, values.dtype))
    words_, classes, rows = filled(found.astype(np.int32), -1), filled(vocab.of_word[found], NONE), filled(vocab.row[found], vocab.rows - 1)
    order = RUN * rng.permutation((len(words_) - 2 * GAP) // RUN)
    window = np.arange(RUN + 2 * GAP)[:, None]
    at = (order[: CHUNK // RUN] + window).ravel()
    runs = len(at) // len(window)
    inner = words_[at][GAP * runs : -GAP * runs]
    own, *near = inner[inner >= 0], *(np.stack([x[inner >= 0] for x in beside(values[at], runs)], 1) for values in (classes, rows))
    sums = np.array([len(own), *(m.scores(own, *near).sum() for m in (Model(vocab, weights), Model(vocab, started(vocab))))])
    net = Network([w.copy() for w in weights.dense])
    steps, nodes, vectors = Steps([w.shape for w in net.weights]), Rows(weights.nodes), Rows(weights.near)
    for begin in range(0, len(order), CHUNK // RUN):
        targets, hiddens = [], []
        for lo in range(begin, min(begin + CHUNK // RUN, len(order)), BATCH // RUN):
            at = (order[lo : min(lo + BATCH // RUN, begin + CHUNK // RUN)] + window).ravel()
            runs = len(at) // len(window)
            around, near, inner = classes.take(at), rows.take(at), slice(GAP * runs, -GAP * runs)
            own = words_.take(at[inner])
            real = np.flatnonzero(own >= 0)
            if not len(real):
                continue
            target = own.take(real)
            classes_ = np.stack([x.take(real) for x in beside(around, runs)]).T
            gradients, hidden, below = net.gradients(classes_, around[inner].take(real), along(vectors.vectors, near, runs).take(real, 0))
            steps.move(net.weights, gradients, len(target))
            targets.append(target)
            hiddens.append(hidden)
            met, back = np.zeros(len(at), np.int32), np.zeros((len(own), HIDDEN), np.float32)
            back[real] = below
            for x in beside(met, runs):
                x += own >= 0
            on = np.flatnonzero((near < vocab.rows - 1) & (met > 0))  # words without a vector of their own stay at zero
            if len(on):
                row, on = ordered(near.take(on), on)
                first_ = begins(row)
                vectors.move(row[first_], added(across(back, runs).take(on, 0), first_), np.add.reduceat(met.take(on), first_))
        if not targets:
            continue
        for _, node, right, own in vocab.levels(np.concatenate(targets), np.concatenate(hiddens)):
            z = vocab.prior.take(node) + (own * nodes.vectors.take(node, 0)) @ ONES
            off = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - right.astype(np.float32)
            first_ = begins(node)
            nodes.move(node.take(first_), added(own * off[:, None], first_), np.diff(first_, append=len(node)))
    return Weights(net.weights, nodes.vectors, vectors.vectors), nodes, vectors, sums


def averaged(docs: DataFrame, known: Broadcast, weights: Weights, splits: int, low: int, high: int) -> tuple[Weights, np.ndarray]:
    """The mean of the weights that splits low to high reach, by their numbers of words; and the sums of learn()."""
    given = Shared(docs.sparkSession)
    begin = given.give(weights)
    shapes = [w.shape for w in weights.dense]
    shards = [-(-len(x) // ROWS) for x in (weights.nodes, weights.near)]
    names = ["k", "lane", "number", "weights"]

    def sent(rows: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(rows), 64):
            columns = zip(*rows[lo : lo + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, held, now = known.value, [], None

        def settle() -> Iterator[pa.RecordBatch]:
            found, size = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if not len(found):
                return
            after, nodes, vectors, sums = learn(vocab, begin.value, found, np.concatenate([[0], np.cumsum(size)]), now)
            rows = [(-1, now % 8, 0, np.rint(sums * 2**10).astype(np.int64).tobytes())]
            rows += [(k, now % 8, len(found), np.rint(w.astype(np.float64) * (len(found) * FIXED)).astype(np.int64).tobytes()) for k, w in enumerate(after.dense)]
            for k, own in enumerate((nodes, vectors)):
                rows += [(len(shapes) + k * shards[0] + shard, 0, 0, data) for shard, data in own.packed()]
            yield from sent(rows)

        for batch in batches:
            split = batch.column("split").to_numpy()
            bounds = np.flatnonzero(np.diff(split, prepend=-1, append=-1))
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if split[lo] != now and held:
                    yield from settle()
                now = int(split[lo])
                for _, _, data, offsets in slices(batch.column("text").slice(lo, hi - lo), SLICE):
                    h, first = hashes_of(data, offsets)
                    held.append((vocab.find(h), np.diff(first)))
        if held:
            yield from settle()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["k"], r["lane"])
                if r["k"] < len(shapes):
                    old = total.setdefault(key, [0, 0])
                    old[0], old[1] = old[0] + r["number"], old[1] + np.frombuffer(r["weights"], np.int64)
                else:
                    met, vectors = total.setdefault(key, [np.zeros(ROWS, np.int64), np.zeros((ROWS, HIDDEN), np.int64)])
                    at, n, v = unpacked(r["weights"])
                    met[at] += n
                    vectors[at] += np.rint(v.astype(np.float64) * (n[:, None] * FIXED)).astype(np.int64)
        for (k, lane), (n, x) in total.items():
            if k >= len(shapes):
                used = np.flatnonzero(n)
                yield from sent([(k, lane, 0, pack(used, n[used], x[used] / (n[used][:, None] * FIXED)))])
            else:
                yield from sent([(k, lane, n, x.tobytes())])

    schema = "k int, lane int, number long, weights binary"
    split = F.pmod(F.xxhash64(F.lit(43), "doc_id", "text"), F.lit(splits))
    own = docs.select(split.cast("int").alias("split"), F.xxhash64("doc_id", "text").alias("place"), "text").where((F.col("split") >= low) & (F.col("split") < high))
    dealt = own.repartition(high - low, "split").sortWithinPartitions("split", "place").select("split", "text")
    dense, sums = [[0, 0] for _ in shapes], np.zeros(3)
    nodes, near = weights.nodes.copy(), weights.near.copy()
    for r in dealt.mapInArrow(train, schema).repartition("k", "lane").mapInArrow(add, schema).toLocalIterator():
        if r["k"] < 0:
            sums += np.frombuffer(r["weights"], np.int64)
        elif r["k"] < len(shapes):
            old = dense[r["k"]]
            old[0], old[1] = old[0] + r["number"], old[1] + np.frombuffer(r["weights"], np.int64)
        else:
            k = r["k"] - len(shapes)
            at, _, v = unpacked(r["weights"])
            (nodes if k < shards[0] else near)[(k if k < shards[0] else k - shards[0]) * ROWS + at] = v
    given.release()
    if not dense[0][0]:
        return weights, sums
    return Weights([(x / (n * FIXED)).astype(np.float32).reshape(s) for (n, x), s in zip(dense, shapes, strict=True)], nodes, near), sums


def trained(docs: DataFrame, vocab: Vocabulary, known: Broadcast, number: int) -> Weights:
    splits = max(len(SHARES), -(-number // WORDS))
    cuts = [0, *sorted({max(k + 1, int(splits * s)) for k, s in enumerate(SHARES)})]
    before = weights = started(vocab)
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        after, (size, net, plain) = averaged(docs, known, weights, splits, low, high)
        if size and net < plain:  # what the round before has reached is no good: counts alone predict better
            weights = before
            after, _ = averaged(docs, known, weights, splits, low, high)
        before, weights = weights, after
    return weights


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood, least_log_probability for every row of docs(doc_id, text, ...).

    Tokens are words in lower case (A-Z). log_likelihood is the sum over them of the log-probability of the word given
    the two words before and after it; least_log_probability is that of the least likely word. Null texts and texts
    without words have 0 tokens, the sum 0 and a null mean and least; a
    text of one word is scored without context. Repeated rows give repeated rows and count as often in training; a null
    doc_id is carried through; other columns are ignored; an empty table gives an empty result.
    """
    given = Shared(docs.sparkSession)
    hashes, number, once = counts(docs)
    vocab = vocabulary(hashes, number, once)
    known = given.give(vocab)
    weights = trained(docs, vocab, known, int(number.sum()) + once)
    shared = given.give(weights)
    del vocab, weights, hashes, number

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = known.value
        model = Model(vocab, shared.value)
        for batch in batches:
            number, total, least = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
            for _, _, data, offsets in slices(batch.column("text"), SLICE):
                h, first = hashes_of(data, offsets)
                found = vocab.find(h)
                own = model.of_texts(found, first)
                sums = np.concatenate([[0.0], np.cumsum(own)])
                number.append(np.diff(first))
                total.append(sums[first[1:]] - sums[first[:-1]])
                some = np.diff(first) > 0
                least.append(np.zeros(len(some)))
                least[-1][some] = np.minimum.reduceat(own, first[:-1][some]) if some.any() else 0
            number, total, least = np.concatenate(number), np.concatenate(total), np.concatenate(least)
            mean = pa.array(total / np.maximum(number, 1), mask=number == 0)
            columns = [batch.column("doc_id"), pa.array(number), pa.array(total), mean, pa.array(least, mask=number == 0)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood", "least_log_probability"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rate, f"doc_id {id_type}, n_tokens bigint, log_likelihood double, mean_log_likelihood double, least_log_probability double")
