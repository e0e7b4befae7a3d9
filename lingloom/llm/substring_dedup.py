"""Removal of repeated passages: a count-min sketch finds windows that may repeat, and exact grouping decides.

Pass 1 takes the minimizer of every window, its run of 10 words of the smallest hash: equal windows have equal
minimizers at equal distances, so there are at least as many places of a minimizer as of a window, and about a sixth as
many places as windows. A task sends the cells that its minimizers hit in each row of the sketch, with a mark on those
hit twice; cells merge by shard, streaming, into the bits "hit at least twice". The merged bits are sized by the corpus,
four cells or more to a minimizer, up to 2**MOST_BITS cells a row (64 MB in all), and go to all tasks.
Pass 2 keeps the windows whose minimizer has the bit in all rows: every repeated window is among them, as the sketch
never underestimates. Where a window occurs again inside one part of a task, only its first place travels and the others
are marked at once, so a passage that a third of all rows share sends one row a part. Exact grouping by minimizer and
window hash (128 bits) marks all but the first place. Windows are dealt by their minimizer, those of minimizers of very
many windows (pass 1 counts them in 2**16 cells) by their own hash: a line that is common but stands in ever new
surroundings fills no task. With far more minimizers than cells the sketch lets more windows through; results stay the
same and only the second pass grows.
Pass 3 brings marks and texts together and removes the words.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingloom.llm.scratch import Shared, dropped, stored
from lingloom.llm.words import SLICE, SPACE, mixed, sequences, slices, u64, words

WINDOW = 20
GRAM = 10
SHARD_BITS = 16
PART = 1 << 21  # windows that a task gathers before it sends their cells or places
MOST_BITS = 28
HEAVY = 1 << 18  # windows of a cell of minimizers from which on they are dealt by their own hash
COUNTS = -1  # in place of a row of the sketch
SHARE = 1 << 11  # cells of minimizers that are counted together


def order_key() -> Column:
    """Documents in order; those without an id come last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def row_key() -> Column:
    """Tells rows of one doc_id apart unless their texts are equal too."""
    return F.xxhash64("doc_id", "text")


def cells(hashes: np.ndarray, depth: int, bits: int) -> Iterator[np.ndarray]:
    """The cell of each hash in each row of the sketch."""
    for row in range(depth):
        yield (mixed(hashes * u64(2 * row + 1)) >> u64(64 - bits)).astype(np.uint32)


def minimizers(hashes: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of the run of GRAM words at each word, the first word of each window, and the word at which its smallest run is.

    Windows of GRAM words or fewer are their own minimizers. The word is that of the first of equal runs.
    """
    size = min(GRAM, window)
    h, at = sequences(hashes, first, size, 1)
    gram = np.full(len(hashes), u64(-1))
    gram[at] = h
    _, start = sequences(hashes, first, window)
    best, reach = np.arange(len(hashes)), 1
    while 2 * reach <= window - size + 1:  # best: the word of the smallest of the next `reach` runs
        later = np.append(best[reach:], best[-1:].repeat(reach))[: len(best)]
        best, reach = np.where(gram[later] < gram[best], later, best), 2 * reach
    low, high = best[start], best[start + window - size + 1 - reach]
    return gram, start, np.where(gram[high] < gram[low], high, low)


def packed(hit: list[np.ndarray], row: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(row, shard, low bits of the cells hit, which of them were hit again) of one part."""
    cell, count = np.unique(np.concatenate(hit), return_counts=True)
    shard = cell >> SHARD_BITS
    low, again = (cell & ((1 << SHARD_BITS) - 1)).astype(np.uint16), count > 1
    bounds = np.flatnonzero(np.diff(shard, prepend=np.uint32(0xFFFFFFFF), append=np.uint32(0xFFFFFFFF)))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield row, int(shard[a]), low[a:b].tobytes(), np.packbits(again[a:b]).tobytes()


def sketches(docs: DataFrame, window: int, depth: int, bits: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(depth)]

        def send() -> Iterator[pa.RecordBatch]:
            for row in range(depth):
                out = list(packed(held[row], row)) if held[row] else []
                held[row].clear()
                for lo in range(0, len(out), 2048):
                    columns = zip(*out[lo : lo + 2048], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["row", "shard", "low", "again"])

        number, windows = 0, np.zeros(1 << 16, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text"), SLICE):
                w = words(data, offsets)
                gram, _, place = minimizers(w.hashes(), w.first, window)
                windows += np.bincount((gram[place] >> u64(48)).astype(np.int64), minlength=1 << 16)
                for row, cell in enumerate(cells(gram[place[np.diff(place, prepend=-1) > 0]], depth, bits)):
                    held[row].append(cell)
                number += len(place)
                if number >= PART:
                    yield from send()
                    number = 0
        yield from send()
        shards = range(0, 1 << 16, SHARE)
        used = [np.flatnonzero(windows[k : k + SHARE]) for k in shards]
        columns = [pa.array([COUNTS] * len(used), pa.int32()), pa.array([k // SHARE for k in shards], pa.int32()), pa.array([x.astype(np.uint16).tobytes() for x in used]), pa.array([windows[k + x].tobytes() for k, x in zip(shards, used, strict=True)])]
        yield pa.RecordBatch.from_arrays(columns, ["row", "shard", "low", "again"])

    return docs.select("text").mapInArrow(sketch, "row int, shard int, low binary, again binary")


def merged(parts: DataFrame, tasks: int) -> DataFrame:
    """row, shard, bits: which cells were hit at least twice over all parts; and how many windows each cell of minimizers has. A task holds its share of the sketch, at two bytes a cell."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        windows: dict[int, np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["row"] == COUNTS:
                    windows.setdefault(r["shard"], np.zeros(SHARE, np.int64))[np.frombuffer(r["low"], np.uint16)] += np.frombuffer(r["again"], np.int64)
                    continue
                once, twice = seen.setdefault((r["row"], r["shard"]), (np.zeros(1 << SHARD_BITS, bool), np.zeros(1 << SHARD_BITS, bool)))
                low = np.frombuffer(r["low"], np.uint16)
                twice[low] |= once[low] | np.unpackbits(np.frombuffer(r["again"], np.uint8), count=len(low)).astype(bool)
                once[low] = True
        out = [(row, shard, np.packbits(twice).tobytes()) for (row, shard), (_, twice) in seen.items() if twice.any()]
        out += [(COUNTS, shard, x.tobytes()) for shard, x in windows.items()]
        for lo in range(0, len(out), 64):
            columns = zip(*out[lo : lo + 64], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["row", "shard", "bits"])

    return parts.repartition(max(tasks, 16), "row", "shard").mapInArrow(merge, "row int, shard int, bits binary")


def gathered(parts: DataFrame, depth: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits of the merged sketch [row, byte], of a bounded size, so the driver may hold them; and which cells of minimizers are heavy."""
    out, heavy = np.zeros((depth, 1 << bits >> 3), np.uint8), np.zeros(1 << 16, bool)
    size = 1 << SHARD_BITS >> 3
    table = stored(parts, "sketch")
    for r in table.toLocalIterator():  # from the written table, a few rows at a time
        if r["row"] == COUNTS:
            heavy[r["shard"] * SHARE : (r["shard"] + 1) * SHARE] = np.frombuffer(r["bits"], np.int64) >= HEAVY
        else:
            out[r["row"], r["shard"] * size : (r["shard"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    dropped(table)
    return out, heavy


def first_places(gram: np.ndarray, h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries that are the first of their window, and those of later places (a repeated row has the places of the first)."""
    order = np.lexsort((place, h, gram))
    a, b = gram[order], h[order]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    own = place[order]
    late = own != own[np.flatnonzero(first)][np.cumsum(first) - 1]
    return order[first], order[late]


MARK = np.dtype([("ord", np.int64), ("rid", np.int64), ("start", np.int32), ("length", np.int32)])
RUN = np.dtype([("gram", np.uint64), ("doc", np.uint32), ("start", np.uint32), ("length", np.uint16)])
FOUND = "kind int, bucket int, docs int, runs int, payload binary"


def found_rows(rows: list[tuple[int, int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(rows), 256):
        columns = zip(*rows[lo : lo + 256], strict=True)
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in FOUND.split(", ")])


def marks(docs: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows that repeat earlier ones, as runs of starts, packed by a hash of their document. docs: (ord, rid) by number."""
    place = np.sort(place)
    new = np.flatnonzero(np.diff(place, prepend=-2) != 1)
    out = np.zeros(len(new), MARK)
    out["ord"], out["rid"] = docs[:, place[new] >> 32]
    out["start"], out["length"] = place[new] & 0xFFFFFFFF, np.diff(np.append(new, len(place)))
    bucket = (mixed(out["rid"].view(np.uint64) ^ mixed(out["ord"].view(np.uint64))) % u64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    out, bounds = out[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
    yield from found_rows([(1, int(k), 0, 0, out[bounds[k] : bounds[k + 1]].tobytes()) for k in np.flatnonzero(np.diff(bounds))])


def numbered(ord_: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different documents in order, and the number of each entry's document."""
    order = np.lexsort((rid, ord_))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(ord_[order]) != 0) | (np.diff(rid[order]) != 0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return np.stack([ord_[order][new], rid[order][new]]), number


def places(docs: DataFrame, window: int, depth: int, bits: int, sketch, tasks: int) -> DataFrame:
    """Of the windows that may repeat: the first places of each part (kind 0), and marks of the others (kind 1)."""
    buckets = 8 * tasks

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit, heavy = sketch.value
        held: list[tuple[np.ndarray, ...]] = []

        def send() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            gram, h, ord_, rid, start = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            docs_at, number = numbered(ord_, rid)
            place = number << 32 | start
            only, late = first_places(gram, h, place)
            if len(late):
                yield from marks(docs_at, place[late], buckets)
            own = heavy[(gram[only] >> u64(48)).astype(np.int64)]
            dealt = (np.where(own, mixed(h[only]), gram[only]) >> u64(32)).astype(np.int64) * buckets >> 32
            order = np.lexsort((place[only], gram[only], dealt))
            only, own, dealt = only[order], own[order], dealt[order]
            gram, h, place = gram[only], h[only], place[only]
            new = np.flatnonzero(own | (np.diff(gram, prepend=~gram[:1]) != 0) | (np.diff(place, prepend=-2) != 1))
            runs = np.zeros(len(new), RUN)
            runs["gram"], runs["doc"], runs["start"] = gram[new], place[new] >> 32, place[new] & 0xFFFFFFFF
            ends = np.append(new[1:], len(gram))
            runs["length"] = ends - new
            bounds = np.searchsorted(dealt[new], np.arange(buckets + 1))
            out = []
            for k in np.flatnonzero(np.diff(bounds)):
                own = runs[bounds[k] : bounds[k + 1]].copy()
                used, own["doc"] = np.unique(own["doc"], return_inverse=True)
                out.append((0, int(k), len(used), len(own), docs_at[:, used].tobytes() + own.tobytes() + h[new[bounds[k]] : ends[bounds[k + 1] - 1]].tobytes()))
            yield from found_rows(out)

        number = 0
        for batch in batches:
            ids, rids = batch.column("ord").to_numpy(), batch.column("rid").to_numpy()
            for lo, _, data, offsets in slices(batch.column("text"), SLICE):
                w = words(data, offsets)
                hashes = w.hashes()
                gram, start, place = minimizers(hashes, w.first, window)
                number += len(start)
                step = np.diff(place, prepend=-1) > 0
                own = gram[place[step]]
                ok = np.ones(len(own), bool)
                for row, cell in enumerate(cells(own, depth, bits)):
                    ok &= (bit[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
                if ok.any():
                    h, _ = sequences(hashes, w.first, window)
                    ok = ok[np.cumsum(step) - 1]
                    row = np.searchsorted(w.first, start[ok], "right") - 1
                    held.append((gram[place[ok]], h[ok], ids[lo + row], rids[lo + row], start[ok] - w.first[row]))
                if number >= PART:
                    yield from send()
                    number = 0
        yield from send()

    return docs.select(order_key().alias("ord"), row_key().alias("rid"), "text").mapInArrow(find, FOUND)


def late_places(found: DataFrame, tasks: int) -> DataFrame:
    """ord, rid, late (runs of starts, packed) for documents with windows that repeat earlier ones."""

    def in_buckets(batches: Iterator[pa.RecordBatch], kind: int) -> Iterator[list[dict]]:
        """Rows of a kind, a bucket at a time; those of the other kind one by one."""
        now, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] != kind:
                    yield [r]
                    continue
                if r["bucket"] != now and held:
                    yield held
                    held = []
                now = r["bucket"]
                held.append(r)
        if held:
            yield held

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_buckets(batches, 0):
            if rows[0]["kind"] == 1:
                yield from found_rows([tuple(rows[0].values())])
                continue
            gram, h, ord_, rid, start = [], [], [], [], []
            for r in rows:
                ids = np.frombuffer(r["payload"], np.int64, 2 * r["docs"]).reshape(2, -1)
                runs = np.frombuffer(r["payload"], RUN, r["runs"], 16 * r["docs"])
                length = runs["length"].astype(np.int64)
                doc = np.repeat(runs["doc"], length)
                h.append(np.frombuffer(r["payload"], np.uint64, -1, 16 * r["docs"] + runs.nbytes))
                gram.append(np.repeat(runs["gram"], length))
                start.append(np.repeat(runs["start"].astype(np.int64) - np.cumsum(length) + length, length) + np.arange(length.sum()))
                ord_.append(ids[0][doc])
                rid.append(ids[1][doc])
            docs_at, number = numbered(np.concatenate(ord_), np.concatenate(rid))
            place = number << 32 | np.concatenate(start)
            _, late = first_places(np.concatenate(gram), np.concatenate(h), place)
            if len(late):
                yield from marks(docs_at, place[late], buckets)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_buckets(batches, 1):
            all_ = np.frombuffer(b"".join(r["payload"] for r in rows), MARK)
            all_ = all_[np.lexsort((all_["start"], all_["rid"], all_["ord"]))]
            new = np.flatnonzero((np.diff(all_["ord"], prepend=~all_["ord"][:1]) != 0) | (np.diff(all_["rid"], prepend=~all_["rid"][:1]) != 0))
            ends = np.append(new[1:], len(all_))
            pairs = np.stack([all_["start"], all_["length"]], 1)
            for lo in range(0, len(new), 4096):
                part = slice(lo, lo + 4096)
                runs = [pairs[a:b].tobytes() for a, b in zip(new[part], ends[part], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(all_["ord"][new[part]]), pa.array(all_["rid"][new[part]]), pa.array(runs, pa.binary())], ["ord", "rid", "late"])

    buckets = 8 * tasks
    late = found.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(group, FOUND)
    return late.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(collect, "ord long, rid long, late binary")


def cleaned(data: np.ndarray, offsets: np.ndarray, late: list[bytes | None], window: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words, removed words and kept text (words joined by one blank) of each text; late: packed runs of starts of its windows."""
    w = words(data, offsets)
    cover = np.zeros(len(w.starts) + 1, np.int32)
    for row, runs in enumerate(late):
        if runs:
            start, length = np.frombuffer(runs, np.int32).reshape(-1, 2).T
            np.add.at(cover, start + w.first[row], 1)
            np.subtract.at(cover, start + w.first[row] + length - 1 + window, 1)
    removed = np.cumsum(cover[:-1]) > 0
    row = w.rows()
    number = np.diff(w.first)
    gone = np.bincount(row, removed, len(number)).astype(np.int64)
    kept = np.flatnonzero(~removed)
    last = np.ones(len(kept), bool)
    last[:-1] = row[kept[1:]] != row[kept[:-1]]
    step = np.zeros(len(data) + 2, np.int8)
    step[w.starts[kept]] += 1
    step[w.ends[kept] + ~last] -= 1  # a word that another follows takes one blank with it
    inside = np.cumsum(step[: len(data)], dtype=np.int8) > 0
    out = np.where(SPACE[data], np.uint8(32), data)[inside]
    places_ = np.concatenate([[0], np.cumsum(inside)])[offsets]
    return number, gone, [out[a:b].tobytes() for a, b in zip(places_[:-1], places_[1:], strict=True)]


def remove_repeats(docs: DataFrame, window: int = WINDOW, depth: int = 2, bits: int | None = None, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by blanks), kept_sha256 for every row of docs(doc_id, text, ...).

    Words are runs of characters other than space and tab to carriage return, unchanged. A word is removed if a window of
    `window` words of its document covers it whose words also start earlier: in a document of smaller doc_id, or earlier
    in the same one. Windows are judged on the input. Null texts have no words. doc_id is an integer; rows without one
    come after all others. Rows of one doc_id with different texts are separate documents, in the order of a hash;
    rows equal in id and text are judged as one and get the same result. Texts shorter than a window lose nothing.
    Other columns are ignored; an empty table gives an empty result. bits: of the cells of a row of the sketch, by default
    by the size of the texts; docs is read three times and must give the same rows each time. texts: whether to return kept, the texts themselves.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if bits is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, math.ceil(math.log2(size // 10 + 1)))
    bits = max(bits, SHARD_BITS)
    given = Shared(spark)
    sketch = given.give(gathered(merged(sketches(docs, window, depth, bits), tasks), depth, bits))
    late = stored(late_places(places(docs, window, depth, bits, sketch, tasks), tasks), "late")
    given.release()
    rows = docs.select("doc_id", order_key().alias("ord"), row_key().alias("rid"), "text").join(late, ["ord", "rid"], "left")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text"), SLICE):
                number, gone, kept = cleaned(data, offsets, batch.column("late").slice(lo, hi - lo).to_pylist(), window)
                columns = {"doc_id": batch.column("doc_id").slice(lo, hi - lo), "n_words": pa.array(number), "n_removed": pa.array(gone), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept])}
                if texts:
                    columns["kept"] = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "late").mapInArrow(clean, f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * texts)


SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS p FROM w WHERE len(ws) >= {WINDOW}),
h AS (SELECT doc_id, p, row_number() OVER (PARTITION BY md5(array_to_string(ws[p:p + {WINDOW - 1}], ' ')) ORDER BY doc_id, p) AS k FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + {WINDOW})) AS p FROM h WHERE k > 1),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
t AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM a ANTI JOIN g USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(t.n, 0) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256 FROM w LEFT JOIN t ON t.doc_id = w.doc_id
"""
