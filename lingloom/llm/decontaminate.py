"""Benchmark decontamination by spaced seeds that lose nothing.

A text overlaps an item if, laid against each other word by word, some stretch of SPAN words of the item (or the whole
item, if it is shorter) has at least 80 % equal words; words beyond the text's ends are not equal. A mask says which words
of a run count and which are ignored. The masks of MASKS are chosen, by the size of the item, so that every way in which
a fifth of the words may differ leaves one mask at one place with equal words only (tests go through all of them). Masked
words of the test items and of the training texts are hashed and joined: item seeds, in parts of a bounded number, go to
all tasks as sorted arrays, and every part is one pass over the texts. What stands around a hit is then counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingloom.llm.scratch import Shared, stored
from lingloom.llm.words import SLICE, Words, lowered, mixed, slices, u64, words

SPAN = 16
SHARE = 0.8
#: Masks for items of so many words (the last also for longer ones): 1 counts, 0 is ignored. Found by a search over all
#: masks for few of many counted words that lose no pattern of substitutions.
MASKS = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("111", "1101"),
    6: ("1111", "11011"),
    7: ("11011",),
    8: ("111011", "110111"),
    9: ("1111011", "1101111"),
    10: ("111011", "11010011", "11111"),
    11: ("1101011", "1110011"),
    12: ("11101011", "101100111", "1111011"),
    13: ("11101011", "110100111"),
    14: ("11110111", "1110100111"),
    15: ("1111011", "11001000111", "11010100011"),
    16: ("11101011", "11001000111"),
}
SEEDS = 1 << 21  # seeds of items that a pass takes: 64 MB at most with what goes with them
FILTER_BITS = 22
HITS = 1 << 15  # looked at together
PUNCT = np.zeros(256, bool)
PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def spoken(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words in lower case without ASCII punctuation; those of nothing else vanish."""
    kept = ~PUNCT[data]
    place = np.concatenate([[0], np.cumsum(kept)])
    return words(lowered(data[kept]), place[offsets])


def seeds(hashes: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of the mask's length that stays in its row."""
    n = len(hashes)
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + len(mask) <= last)
    total = np.full(len(at), u64(int("1" + mask, 2)))
    for k in (k for k, sign in enumerate(mask) if sign == "1"):
        total = mixed(total * u64(0x9FB21C651E98DF25) + hashes[at + k])
    return total, at


def masks(size: int) -> tuple[str, ...]:
    """The masks of an item of that many words."""
    return MASKS[min(size, SPAN)]


@dataclass
class Part:
    """Seeds of some items, sorted: for each its item and place; and the words of the items."""

    masks: list[str]
    key: np.ndarray
    item: np.ndarray
    place: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    ids: np.ndarray
    filter: np.ndarray


def parts(benchmark: DataFrame) -> Iterator[Part]:
    """Test items in parts of at most SEEDS seeds (a longer item of its own has a part); the driver holds one part at a time."""
    held, number = [], 0
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    for r in items.orderBy("item_id", "text").toLocalIterator():
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        h = spoken(raw, np.array([0, len(raw)])).hashes()
        if not len(h):
            continue
        own = len(masks(len(h))) * len(h)
        if held and number + own > SEEDS:
            yield part_of(held)
            held, number = [], 0
        held.append((r["item_id"], h))
        number += own
    if held:
        yield part_of(held)


def part_of(items: list[tuple[int, np.ndarray]]) -> Part:
    hashes = np.concatenate([h for _, h in items])
    first = np.concatenate([[0], np.cumsum([len(h) for _, h in items])])
    size = np.diff(first)
    key, item, place = [], [], []
    used = sorted({mask for n in set(size.tolist()) for mask in masks(n)})
    for mask in used:
        own = np.array([mask in masks(n) for n in size.tolist()])
        h, word = seeds(hashes, first, mask)
        row = np.searchsorted(first, word, "right") - 1
        h, word, row = h[own[row]], word[own[row]], row[own[row]]
        key.append(h)
        item.append(row)
        place.append(word - first[row])
    key, item, place = np.concatenate(key), np.concatenate(item), np.concatenate(place)
    order = np.argsort(key, kind="stable")
    key = key[order]
    flags = np.zeros(1 << FILTER_BITS, bool)
    flags[(key >> u64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Part(used, key, item[order].astype(np.int32), place[order].astype(np.int32), hashes, first, np.array([i for i, _ in items], np.int64), flags)


def best_stretch(equal: np.ndarray, size: int) -> tuple[int, int]:
    """The most equal words of a stretch of that size, and where it starts."""
    total = np.concatenate([[0], np.cumsum(equal)])
    sums = total[size:] - total[:-size]
    k = int(sums.argmax())
    return int(sums[k]), k


def likely(part: Part, hashes: np.ndarray, first: np.ndarray, word: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Row, item, and place of the item's start among the words, once each, of those hits around which enough words are equal."""
    item, place = part.item[entry], part.place[entry].astype(np.int64)
    row = np.searchsorted(first, word, "right") - 1
    step = np.arange(2 - SPAN, SPAN)
    at, other = place[:, None] + step, word[:, None] + step
    size = np.diff(part.first)[item]
    inside = (at >= 0) & (at < size[:, None]) & (other >= first[row][:, None]) & (other < first[row + 1][:, None])
    equal = inside & (hashes[np.where(inside, other, 0)] == part.hashes[np.where(inside, at + part.first[item][:, None], 0)])
    total = np.concatenate([np.zeros((len(word), 1), np.int64), np.cumsum(equal, 1)], 1)
    # A shorter item lies within the steps as a whole.
    most = np.where(size < SPAN, total[:, -1], (total[:, SPAN:] - total[:, :-SPAN]).max(1))
    ok = most >= SHARE * np.minimum(size, SPAN)
    return np.unique(np.stack([row[ok], item[ok], (word - place)[ok]]), axis=1)


def hits(part: Part, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item id, first word of the text in the best stretch, words of the stretch, equal words), once for a row and item."""
    w = spoken(data, offsets)
    h = w.hashes()
    found = []
    for mask in part.masks:
        key, at = seeds(h, w.first, mask)
        maybe = np.flatnonzero(part.filter[(key >> u64(64 - FILTER_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(part.key, key[maybe], "left"), np.searchsorted(part.key, key[maybe], "right")
        total = np.concatenate([[0], np.cumsum(hi - lo)])  # a mask with more hits than are looked at together takes turns
        for begin in range(0, int(total[-1]), HITS):
            n = np.arange(begin, min(begin + HITS, int(total[-1])))
            which = np.searchsorted(total, n, "right") - 1
            entry = lo[which] + n - total[which]
            found.append(likely(part, h, w.first, at[maybe][which], entry))
    if not found:
        return []
    best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    for row, item, start in np.unique(np.concatenate(found, 1), axis=1).T:
        a, b = part.first[item], part.first[item + 1]
        lo, hi = max(start, w.first[row]), min(start + b - a, w.first[row + 1])
        size = min(SPAN, int(b - a))
        equal = np.zeros(b - a, bool)
        equal[lo - start : hi - start] = h[lo:hi] == part.hashes[a + lo - start : a + hi - start]
        same, k = best_stretch(equal, size)
        if same >= SHARE * size:
            whole = (int(equal.sum()), -int(start), int(max(start + k, w.first[row]) - w.first[row]), size, same)
            key_ = (int(row), int(part.ids[item]))
            if key_ not in best or whole > best[key_]:
                best[key_] = whole
    return [(row, item, x[2], x[3], x[4]) for (row, item), x in best.items()]


PAIRS = "item_id long, word long, stretch long, equal long"


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, word, stretch, equal for every document and test item that overlap: the place of the best stretch in
    the text (counted in words), its length, and how many of its words are the item's.

    Words are in lower case (A-Z) and without ASCII punctuation. Null and empty texts overlap nothing; items without an id, of
    null text or without words are left out; items of fewer than five words are found whole only; equal items count once. A
    repeated row gives its pairs again; a null doc_id is carried through; other columns are ignored; an empty table on either
    side gives an empty result. With more than one part of items, the pairs of each are written before the next is searched.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {PAIRS}"

    def searched(part: Broadcast) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, _, data, offsets in slices(batch.column("text"), SLICE):
                    got = hits(part.value, data, offsets)
                    if got:
                        row, *rest = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.array(row) + lo)), *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "item_id", "word", "stretch", "equal"])

        return docs.select("doc_id", "text").mapInArrow(search, schema)

    rest, out = parts(benchmark), spark.createDataFrame([], schema)
    part = next(rest, None)
    while part is not None:
        given = Shared(spark)
        found, part = searched(given.give(part)), next(rest, None)
        if part is not None:
            found = stored(found, "overlaps")
            given.release()
        out = out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs(text, ...) that overlap no test item, with all their columns; cases as in overlaps()."""
    names = docs.columns

    def cleaned(part: Broadcast) -> DataFrame:
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = np.ones(batch.num_rows, bool)
                for lo, _, data, offsets in slices(batch.column(names.index("text")), SLICE):
                    kept[[lo + x[0] for x in hits(part.value, data, offsets)]] = False
                yield batch.filter(pa.array(kept))

        return left.mapInArrow(clean, left.schema)

    rest, left = parts(benchmark), docs
    part = next(rest, None)
    while part is not None:
        given = Shared(docs.sparkSession)
        left, part = cleaned(given.give(part)), next(rest, None)
        if part is not None:  # of several parts, each is done and its seeds taken back before the next goes to the tasks
            left = stored(left, "decontaminated")
            given.release()
    return left


def sql_words(text: str) -> str:
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"list_filter(string_split_regex(regexp_replace({low}, '[!-/:-@\[-`{{-~]', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


# Equal words of a text and an item meet; of every place at which one may lie against the other, the stretches are counted.
SQL = f"""
WITH d AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM (SELECT doc_id, {sql_words('text')} AS ws FROM documents)),
i AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, unnest(range(0, len(ws))) AS p FROM (SELECT DISTINCT item_id, {sql_words('text')} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
j AS (SELECT doc_id, item_id, n, d.p - i.p AS start, list(i.p) AS eq FROM d JOIN i ON d.w = i.w GROUP BY ALL HAVING count(*) >= {SHARE} * least(n, {SPAN})),
k AS (SELECT *, list_transform(range(0, greatest(n - {SPAN}, 0) + 1), lambda k: len(list_filter(eq, lambda x: x >= k AND x < k + {SPAN}))) AS c FROM j),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY len(eq) DESC, start) AS r FROM k WHERE list_max(c) >= {SHARE} * least(n, {SPAN}))
SELECT doc_id, item_id, greatest(start + list_position(c, list_max(c)) - 1, 0) AS word, least(n, {SPAN})::bigint AS stretch, list_max(c)::bigint AS equal FROM b WHERE r = 1
"""
