"""Links between documents of similar word shingles, by a token-group matrix.

1. A document with fewer than 0.8 of its shingles in other documents has no partner. Shingles are hashed to cells, about
   twenty times as many as there are shingles; a part of the texts sends each of its cells once, as sorted differences,
   with the text whose only it is; the cells meet by ranges, and each text learns how many of its cells others have.
   Nothing of that is held in one place, and cells in common by chance only let a document through.
   Documents with equal sets are one class; the sets of classes that go on are found again from their texts.
2. Classes are dealt to groups by a minimum hash; in a group each class joins the first leader that it is similar to.
   Leaders are dealt again by another hash, a few times. What comes out are groups of documents that verified links
   hold together; large hash groups are split, so none is gathered in one task.
   The leaders' links make components, which need no more comparing inside.
3. Token-group matrix: classes are dealt to groups of similar ones by their most frequent shingles. The rarest shingles of
   every class (those that any partner must share at least one of) are stored with its group; a class visits every group
   of a greater number that has one of its own. So rows follow classes and groups, never pairs of classes.
4. There the union of the group's tokens bounds the overlap of a visitor with any member; only if the bound allows 0.8
   is the group opened and its members counted exactly. The links that connect components are kept. The visitors of a
   group of many are dealt over several tasks, each with the group's members.
Steps 2 to 4 lose no link that matters for components: whatever step 2 misses, step 3 finds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingloom.llm.components import components
from lingloom.llm.scratch import Shared, dropped, stored
from lingloom.llm.words import SLICE, lowered, mixed, sequences, slices, u64, words

SHINGLE = 5
ROUNDS = 3
LEADERS = 48  # leaders of a hash group that a class is compared with; step 3 finds what this misses
SPLIT = 1024  # classes of a group that one task takes
VISITORS = 256  # of a group that one task takes
LEVEL_BITS = 21  # cells of shingles, and of groups, whose counts all tasks know
GROUP_BITS = 18
PART = 1 << 21  # shingles that a task gathers before it sends their cells
TEXTS = 1 << 16  # texts of a part
RANGE = 1 << 20  # cells that meet at once, about


def similar(inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """100 * intersection >= 80 * union, in integers."""
    return 9 * inter >= 4 * (a + b)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every different shingle, by row and hash; a text of fewer words has one, of all its words."""
    w = words(lowered(data), offsets)
    hashes = w.hashes()
    h, at = sequences(hashes, w.first, size)
    row = np.searchsorted(w.first, at, "right") - 1
    counts = w.counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = np.array([mixed(np.array([np.bitwise_xor.reduce(mixed(hashes[w.first[k] : w.first[k + 1]] + np.arange(1, counts[k] + 1, dtype=np.uint64)))], np.uint64))[0] for k in short], np.uint64)
    row, h = np.concatenate([row, short]), np.concatenate([h, whole])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def batch_of(schema: str, columns: list) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


TEXT = np.dtype([("doc_id", np.int64), ("known", bool), ("n", np.int64), ("cls", np.int64), ("rid", np.int64), ("at", np.int32), ("common", np.int32)])
TEXT_ROWS, CELL_ROWS, COUNT_ROWS = range(3)
PARTS = "kind int, spot long, part long, texts int, payload binary"
ROWS = "doc_id long, n long, cls long, rid long, alive boolean"


class Cells:
    """Sorted cells of a range, packed as differences of 16 or 32 bits, each with the number of a text."""

    def __init__(self, size: int, tasks: int):
        """For that many bytes of text: as many cells as three times that, and ranges for all tasks."""
        self.bits = max(16, math.ceil(math.log2(3 * size + 1)))
        least = math.ceil(math.log2(max(8 * tasks, size // 6 // RANGE)))
        self.ranges = 1 << min(least, 17, self.bits)
        self.width = self.bits - min(least, 17, self.bits)
        self.step = np.dtype(np.uint16 if (1 << self.bits) // PART < 1 << 15 else np.uint32)
        self.most = np.iinfo(self.step).max

    def marks(self, texts: int) -> tuple[np.dtype, int, int]:
        """Type of the numbers of so many texts, and the numbers that stand for several texts and for a mere step."""
        kind = np.dtype(np.uint16 if texts < 65534 else np.uint32)
        return kind, np.iinfo(kind).max, np.iinfo(kind).max - 1

    def packed(self, cell: np.ndarray, text: np.ndarray, texts: int) -> Iterator[tuple[int, bytes]]:
        """(range, payload) of cells in order, each once; text -1: several have it. No cells give nothing."""
        if not len(cell):
            return
        kind, several, skip = self.marks(texts)
        which = cell >> self.width
        head = np.diff(which, prepend=-1) > 0
        gap = np.where(head, cell - (which << self.width), np.diff(cell, prepend=0))
        steps = gap // self.most
        last = np.cumsum(steps + 1) - 1
        step, name = np.full(last[-1] + 1 if len(last) else 0, self.most, self.step), np.full(last[-1] + 1 if len(last) else 0, skip, kind)
        step[last], name[last] = gap % self.most, np.where(text < 0, several, text)
        heads = np.flatnonzero(head)
        lo, hi = (last - steps)[heads], np.append((last - steps)[heads[1:]], len(step))
        for k, a, b in zip(heads, lo, hi, strict=True):
            yield int(which[k]), step[a:b].tobytes() + name[a:b].tobytes()

    def unpacked(self, which: int, texts: int, payload: bytes) -> tuple[np.ndarray, np.ndarray]:
        kind, several, skip = self.marks(texts)
        n = len(payload) // (self.step.itemsize + kind.itemsize)
        cell = (which << self.width) + np.cumsum(np.frombuffer(payload, self.step, n), dtype=np.int64)
        name = np.frombuffer(payload, kind, n, n * self.step.itemsize)
        real = name != skip
        return cell[real], np.where(name[real] == several, -1, name[real].astype(np.int64))


def part_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    for lo in range(0, len(rows), 256):
        columns = zip(*rows[lo : lo + 256], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in PARTS.split(", ")])


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys begins, and one more."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)


def classed(docs: DataFrame, tasks: int) -> DataFrame:
    """doc_id, size, class, row key of every row, and alive for one row at least of each class that may have a partner."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    space = Cells(size, tasks)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, texts, used, number, parts = [], [], 0, 0, 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal used, number, parts
            part = TaskContext.get().partitionId() << 32 | parts
            cell, text = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 2
            own = np.concatenate(texts)
            order = np.argsort(cell, kind="stable")
            cell, text = cell[order], text[order]
            begin = runs(cell)
            alone = np.diff(begin) == 1
            common = np.bincount(text[~np.repeat(alone, np.diff(begin))], minlength=used)
            own["common"] = np.where(own["at"] < 0, 0, common[own["at"]] if used else 0)
            yield from part_rows([(TEXT_ROWS, -1 - part % 1009, part, used, own.tobytes())])
            begin = begin[:-1]
            yield from part_rows([(CELL_ROWS, k, part, used, x) for k, x in space.packed(cell[begin], np.where(alone, text[begin], -1), used)])
            held.clear(), texts.clear()
            used, number, parts = 0, 0, parts + 1

        for batch in batches:
            ids, rids = batch.column("doc_id"), batch.column("rid").to_numpy()
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            for lo, hi, data, offsets in slices(batch.column("text"), SLICE):
                row, h = shingles(data, offsets)
                n = np.bincount(row, minlength=hi - lo)
                cls = class_hashes(row, h, n)
                first = np.zeros(hi - lo, bool)
                for k in np.flatnonzero(n):
                    if int(cls[k]) not in seen:
                        if len(seen) > 1 << 18:
                            seen.clear()
                        seen.add(int(cls[k]))
                        first[k] = True
                own = np.zeros(hi - lo, TEXT)
                own["doc_id"], own["known"], own["n"], own["cls"], own["rid"] = ids[lo:hi], known[lo:hi], n, cls, rids[lo:hi]
                own["at"] = np.where(first, used + np.cumsum(first) - 1, -1)
                mine = first[row]
                held.append(((h[mine] >> u64(64 - space.bits)).astype(np.int64), own["at"][row[mine]].astype(np.int64)))
                texts.append(own)
                used, number = used + int(first.sum()), number + len(held[-1][0])
                if number >= PART or used >= TEXTS - 1024 or sum(map(len, texts)) >= 4 * TEXTS:
                    yield from send()
        if texts:
            yield from send()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, counts = None, [], {}

        def settle() -> None:
            cell, text = (np.concatenate(x) for x in zip(*((c, t) for _, _, c, t in held), strict=True))
            which = np.repeat(np.arange(len(held)), [len(c) for _, _, c, _ in held])
            order = np.argsort(cell, kind="stable")
            size = np.diff(runs(cell[order]))
            found = order[np.repeat(size > 1, size)]
            found = found[text[found] >= 0]
            found = found[np.argsort(which[found], kind="stable")]
            begin = runs(which[found])
            for a, b in zip(begin[:-1], begin[1:], strict=True):
                part, texts = held[which[found[a]]][:2]
                counts.setdefault(part, [texts, 0])[1] += np.bincount(text[found[a:b]], minlength=texts).astype(np.int32)
            held.clear()

        def send() -> Iterator[pa.RecordBatch]:
            rows = []
            for part, (texts, number) in counts.items():
                at = np.flatnonzero(number)
                rows.append((COUNT_ROWS, 0, part, texts, at.astype(np.int32).tobytes() + number[at].astype(np.int32).tobytes()))
            counts.clear()
            yield from part_rows(rows)

        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == TEXT_ROWS:
                    yield from part_rows([tuple(r.values())])
                    continue
                if r["spot"] != now and held:
                    settle()
                    if sum(x for x, _ in counts.values()) > 1 << 22:
                        yield from send()
                now = r["spot"]
                held.append((r["part"], r["texts"], *space.unpacked(now, r["texts"], r["payload"])))
        if held:
            settle()
        yield from send()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, counts = None, [], []

        def result() -> pa.RecordBatch:
            rows = np.concatenate(own)
            common = np.zeros(int(rows["at"].max(initial=0)) + 1, np.int64)
            for at, number in counts:
                np.add.at(common, at, number)
            total = rows["common"] + np.where(rows["at"] < 0, 0, common[rows["at"]])
            alive = (rows["at"] >= 0) & (5 * total >= 4 * rows["n"])
            columns = [pa.array(rows["doc_id"], mask=~rows["known"]), pa.array(rows["n"]), pa.array(rows["cls"], mask=rows["n"] == 0), pa.array(rows["rid"]), pa.array(alive)]
            own.clear(), counts.clear()
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ROWS.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != now and own:
                    yield result()
                now = r["part"]
                if r["kind"] == TEXT_ROWS:
                    own.append(np.frombuffer(r["payload"], TEXT))
                else:
                    both = np.frombuffer(r["payload"], np.int32)
                    counts.append((both[: len(both) // 2], both[len(both) // 2 :]))
        if own:
            yield result()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("rid"), "text")
    met = texts.mapInArrow(find, PARTS).repartition(max(tasks, space.ranges // 8), "spot").sortWithinPartitions("spot").mapInArrow(meet, PARTS)
    return met.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(judge, ROWS)


def row_key():
    """Tells rows apart unless they are equal in id and text."""
    return F.xxhash64("doc_id", "text")


def class_hashes(row: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each row's set of shingles, which are given by row and hash."""
    bounds = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(len(h)) - bounds[row]
    sums = np.concatenate([[u64(0)], np.cumsum(mixed(h + mixed(place.astype(np.uint64))))])
    return mixed(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(np.uint64)).view(np.int64)


CLASSES = "cls long, n long, tokens binary"


def token_sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """cls, n, tokens (all shingles, packed, in order) of classes that go on, from the texts of some rows of theirs."""
    picked = rows.where("alive").groupBy("cls").agg(F.min("rid").alias("rid")).select("rid")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text"), SLICE):
                row, h = shingles(data, offsets)
                n = np.bincount(row, minlength=hi - lo)
                bounds, some = np.concatenate([[0], np.cumsum(n)]), np.flatnonzero(n)
                yield batch_of(CLASSES, [class_hashes(row, h, n)[some], n[some], [h[bounds[k] : bounds[k + 1]].tobytes() for k in some]])

    return docs.select(row_key().alias("rid"), "text").join(picked, "rid", "left_semi").select("text").mapInArrow(find, CLASSES)


def group_hashes(tokens: np.ndarray, starts: np.ndarray, turn: int) -> np.ndarray:
    return np.minimum.reduceat(mixed(tokens * u64(2 * turn + 3)), starts).view(np.int64)


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a binary column, and where each row begins (and one more). No row is null or empty."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(raw.tobytes(), np.uint64), (offsets - offsets[0]) // 8


def counted(frame: DataFrame, hashes, bits: int = GROUP_BITS) -> np.ndarray:
    """How many hashes of the rows fall into each of 2**bits cells: a table of fixed size. A task's count of a cell stops at 65535."""
    shards = 8
    width = (1 << bits) // shards

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int32)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount((hashes(batch).view(np.uint64) >> u64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int32)
        total = np.minimum(total, 65535).astype(np.uint16)
        for k in range(shards):
            own = total[k * width : (k + 1) * width]
            used = np.flatnonzero(own)
            if 3 * len(used) < width:  # places and counts are shorter than all counts
                yield batch_of("shard int, places int, counts binary", [[k], [len(used)], [used.astype(np.uint32).tobytes() + own[used].tobytes()]])
            else:
                yield batch_of("shard int, places int, counts binary", [[k], [-1], [own.tobytes()]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, places, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "places", "counts")), strict=True):
                own = total.setdefault(shard, np.zeros(width, np.int64))
                if places < 0:
                    own += np.frombuffer(raw, np.uint16)
                else:
                    own[np.frombuffer(raw, np.uint32, places)] += np.frombuffer(raw, np.uint16, places, 4 * places)
        yield batch_of("shard int, places int, counts binary", [list(total), [-1] * len(total), [np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in total.values()]])

    schema = "shard int, places int, counts binary"
    out = np.zeros((shards, width), np.uint32)
    for r in frame.mapInArrow(count, schema).repartition(shards, "shard").mapInArrow(add, schema).collect():
        out[r["shard"]] = np.frombuffer(r["counts"], np.uint32)
    return out.ravel()


LED = "cls long, n long, tokens binary, lead long"


def led(classes: DataFrame, turn: int, tasks: int, given: Shared) -> DataFrame:
    """cls, n, tokens, lead: classes (each once) and the leader that a verified link joins them to, or themselves.

    A hash group of over SPLIT classes is split by class; those whose cell of the counts has one class stay apart.
    """

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        tokens, at = unpacked(batch.column("tokens"))
        return mixed(group_hashes(tokens, at[:-1], turn).view(np.uint64))

    counts = given.give(counted(classes, keys))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = counts.value
        for batch in batches:
            if batch.num_rows:
                tokens, at = unpacked(batch.column("tokens"))
                g = group_hashes(tokens, at[:-1], turn)
                split = 1 + number[(mixed(g.view(np.uint64)) >> u64(64 - GROUP_BITS)).astype(np.int64)].astype(np.int64) // SPLIT
                salt = (mixed(batch.column("cls").to_numpy().view(np.uint64)) % split.astype(np.uint64)).astype(np.int32)
                yield batch_of("g long, salt int, cls long, n long, tokens binary", [g, salt, batch.column("cls"), batch.column("n"), batch.column("tokens")])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, leaders = None, None, []
        for batch in batches:
            lead, keep = [], []
            for k, (g, salt, cls, n, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "salt", "cls", "n", "tokens")), strict=True)):
                if (g, salt) != key:
                    key, last, leaders = (g, salt), None, []
                if cls == last:
                    continue
                last = cls
                keep.append(k)
                tokens = np.frombuffer(raw, np.uint64)
                for other, size, own in leaders:
                    if 4 * n <= 5 * size and 4 * size <= 5 * n and similar(len(np.intersect1d(tokens, own, assume_unique=True)), n, size):
                        lead.append(other)
                        break
                else:
                    lead.append(cls)
                    if len(leaders) < LEADERS:
                        leaders.append((cls, n, tokens))
            if keep:
                part = batch.take(pa.array(keep))
                yield batch_of(LED, [part.column("cls"), part.column("n"), part.column("tokens"), lead])

    grouped = classes.select("cls", "n", "tokens").mapInArrow(keyed, "g long, salt int, cls long, n long, tokens binary")
    return grouped.repartition(tasks, "g", "salt").sortWithinPartitions("g", "salt", "cls").mapInArrow(join, LED)


HOMES = "cls long, comp long, n long, tokens binary, grp long"


def in_groups(members: DataFrame, levels, given: Shared) -> DataFrame:
    """members with the group that each class lives in: by the smallest hash of its most frequent tokens (those of the two
    highest levels), which an edit seldom makes, so similar classes share it whether linked or not. Large groups are split."""

    def key(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        level = levels.value[(tokens >> u64(64 - LEVEL_BITS)).astype(np.int64)]
        top = np.maximum.reduceat(level, at[:-1])
        often = level + 1 >= np.repeat(top, np.diff(at))
        return np.minimum.reduceat(np.where(often, mixed(tokens * u64(0xA24BAED4963EE407)), u64(-1)), at[:-1])

    counts = given.give(counted(members, lambda b: mixed(key(*unpacked(b.column("tokens"))))))

    def house(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                g = key(*unpacked(batch.column("tokens")))
                split = 1 + counts.value[(mixed(g) >> u64(64 - GROUP_BITS)).astype(np.int64)].astype(np.uint64) // u64(SPLIT)
                part = mixed(batch.column("cls").to_numpy().view(np.uint64) + u64(1)) % split
                yield batch_of(HOMES, [*(batch.column(c) for c in ("cls", "comp", "n", "tokens")), mixed(g + mixed(part)).view(np.int64)])

    return members.select("cls", "comp", "n", "tokens").mapInArrow(house, HOMES)


ENTRY = np.dtype([("token", np.uint64), ("grp", np.int64), ("cls", np.int64), ("comp", np.int64), ("n", np.int32)])


def visits(homes: DataFrame, levels, tasks: int) -> DataFrame:
    """cls, grp: the groups of a greater number than its own that share a token with a class among those of which partners
    must share one. So of two groups, the classes of one visit the other.

    These tokens are the first of the class in an order that is the same for all documents: by level, so that frequent ones
    come last, and then by hash. A group whose classes with the token are all linked to the visitor already, or cannot be
    of its size, is not visited.
    """
    buckets = 8 * tasks

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            rows = np.sort(np.concatenate(held), order="token") if held else np.zeros(0, ENTRY)
            held.clear()
            bounds = np.searchsorted((rows["token"] >> u64(32)).astype(np.int64) * buckets >> 32, np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(bounds))
            for lo in range(0, len(used), 256):
                part = used[lo : lo + 256]
                yield batch_of("bucket int, rows binary", [part, [rows[bounds[k] : bounds[k + 1]].tobytes() for k in part]])

        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, at = unpacked(batch.column("tokens"))
            n, size = batch.column("n").to_numpy(), np.diff(at)
            row = np.repeat(np.arange(len(n)), size)
            order = np.lexsort((tokens, levels.value[(tokens >> u64(64 - LEVEL_BITS)).astype(np.int64)], row))
            # Shingles of one document only come first in the order; the prefix goes on after them.
            prefix = size - -(-4 * n // 5) + 1
            kept = order[(np.arange(len(tokens)) - at[row]) < prefix[row]]
            rows = np.zeros(len(kept), ENTRY)
            rows["token"] = tokens[kept]
            for c in ("grp", "cls", "comp", "n"):
                rows[c] = batch.column(c).to_numpy()[row[kept]]
            held.append(rows)
            number += len(rows)
            if number >= PART // 4:
                yield from send()
                number = 0
        yield from send()

    def met(raw: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([np.frombuffer(x, ENTRY) for x in raw])
        rows = rows[np.lexsort((rows["grp"], rows["token"]))]
        # The matrix: for each token the groups that have it, with the span of their classes' sizes and components.
        token = np.diff(rows["token"], prepend=~rows["token"][:1]) != 0
        head = np.flatnonzero(token | (np.diff(rows["grp"], prepend=~rows["grp"][:1]) != 0))
        low, high = np.minimum.reduceat(rows["n"], head), np.maximum.reduceat(rows["n"], head)
        least, most = np.minimum.reduceat(rows["comp"], head), np.maximum.reduceat(rows["comp"], head)
        begin = np.append(np.flatnonzero(token), len(rows))
        first = np.searchsorted(head, begin)
        held, number = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            found = np.unique(np.concatenate(held, 1), axis=1)
            held.clear()
            yield batch_of("cls long, grp long", [found[0], found[1]])

        for k in np.flatnonzero(np.diff(first) > 1):
            own = rows[begin[k] : begin[k + 1]]
            for j in range(first[k], first[k + 1]):
                ok = (own["grp"] < rows["grp"][head[j]]) & ((own["comp"] != least[j]) | (own["comp"] != most[j]))
                ok &= (5 * high[j].astype(np.int64) >= 4 * own["n"]) & (4 * low[j].astype(np.int64) <= 5 * own["n"].astype(np.int64))
                guests = own["cls"][ok]
                if len(guests):
                    held.append(np.stack([guests, np.full(len(guests), rows["grp"][head[j]])]))
                    number += len(guests)
            if number > 1 << 21:
                yield from send()
                number = 0
        if held:
            yield from send()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, raw = None, []
        for batch in batches:
            for bucket, rows in zip(batch.column("bucket").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                if bucket != now and raw:
                    yield from met(raw)
                    raw.clear()
                now = bucket
                raw.append(rows)
        if raw:
            yield from met(raw)

    posted = homes.mapInArrow(post, "bucket int, rows binary").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return posted.mapInArrow(meet, "cls long, grp long").distinct()


class Sets:
    """Disjoint sets of components, as far as one task knows."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.top(x), self.top(y)
        self.up[max(a, b)] = min(a, b)
        return a != b


class Group:
    """The members of a group, the union of their tokens, and who has each of them."""

    def __init__(self, members: list[tuple[int, int, np.ndarray]]):
        self.comps, self.sizes = [c for c, _, _ in members], np.array([n for _, n, _ in members])
        all_, who = np.concatenate([t for _, _, t in members]), np.repeat(np.arange(len(members)), [len(t) for _, _, t in members])
        order = np.argsort(all_, kind="stable")
        self.union, first = np.unique(all_[order], return_index=True)
        self.first, self.who = np.append(first, len(all_)), who[order]

    def partners(self, n: int, tokens: np.ndarray) -> np.ndarray:
        """Members that link with a set; none is looked at if the union holds too few of its tokens."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        hit = at[self.union[at] == tokens]
        if 5 * len(hit) < 4 * n:
            return np.zeros(0, np.int64)
        length = self.first[hit + 1] - self.first[hit]
        spread = np.repeat(self.first[hit] - np.cumsum(length) + length, length) + np.arange(length.sum())
        return np.flatnonzero(similar(np.bincount(self.who[spread], minlength=len(self.sizes)), self.sizes, n))


def opened(homes: DataFrame, found: DataFrame, tasks: int, given: Shared) -> DataFrame:
    """u, v: links between components, as many as are needed to connect those that a task sees linked.

    The visitors of a group of many are dealt over tasks, and each of these has all the group's members.
    """
    counts = given.give(counted(found.select("grp"), lambda b: mixed(b.column("grp").to_numpy().view(np.uint64))))

    def parts(grp: np.ndarray) -> np.ndarray:
        return 1 + counts.value[(mixed(grp.view(np.uint64)) >> u64(64 - GROUP_BITS)).astype(np.int64)].astype(np.int64) // VISITORS

    seats = "grp long, salt int, guest int, cls long, comp long, n long, tokens binary"

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = parts(batch.column("grp").to_numpy())
            row = np.repeat(np.arange(batch.num_rows), number)
            salt = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            for lo in range(0, len(row), 1024):
                own = batch.take(pa.array(row[lo : lo + 1024]))
                yield batch_of(seats, [own.column("grp"), salt[lo : lo + 1024].astype(np.int32), np.zeros(len(own), np.int32), *(own.column(c) for c in ("cls", "comp", "n", "tokens"))])

    def guests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salt = mixed(batch.column("cls").to_numpy().view(np.uint64) + u64(5)) % parts(batch.column("grp").to_numpy()).astype(np.uint64)
            yield batch_of(seats, [batch.column("grp"), salt.astype(np.int32), np.ones(len(batch), np.int32), *(batch.column(c) for c in ("cls", "comp", "n", "tokens"))])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, group, sets_, alone = None, [], None, Sets(), False
        out: list[tuple[int, int]] = []

        def settle(comp: int, n: int, tokens: np.ndarray) -> None:
            for k in group.partners(n, tokens):
                if sets_.join(comp, group.comps[k]):
                    out.append((comp, group.comps[k]))

        def gather() -> Group:
            nonlocal group
            group = Group(members)
            for x in members if alone else ():  # the first of the tasks of a group compares its members
                if len({sets_.top(c) for c in group.comps}) == 1:
                    break
                settle(*x)
            return group

        for batch in batches:
            for grp, salt, guest, comp, n, raw in zip(*(batch.column(c).to_pylist() for c in ("grp", "salt", "guest", "comp", "n", "tokens")), strict=True):
                if (grp, salt) != key:
                    if len(members) > 1 and group is None:
                        gather()
                    key, members, group, sets_, alone = (grp, salt), [], None, Sets(), salt == 0
                tokens = np.frombuffer(raw, np.uint64)
                if not guest:  # members come first
                    members.append((comp, n, tokens))
                elif members:
                    group or gather()
                    settle(comp, n, tokens)
            if out:
                yield batch_of("u long, v long", list(zip(*out, strict=True)))
                out.clear()
        if len(members) > 1 and group is None:
            gather()
        if out:
            yield batch_of("u long, v long", list(zip(*out, strict=True)))

    home = homes.select("cls", "comp", "n", "tokens", "grp").mapInArrow(hosts, seats)
    visitors = homes.drop("grp").join(found, "cls").select("cls", "comp", "n", "tokens", "grp").mapInArrow(guests, seats)
    seated = home.unionByName(visitors).repartition(tasks, "grp", "salt").sortWithinPartitions("grp", "salt", "guest", "cls")
    return seated.mapInArrow(visit, "u long, v long")


def looked_up(frame: DataFrame, values: DataFrame, key: str, tasks: int) -> DataFrame:
    """frame(cls, ...) left joined with values by key. Rows of a key are dealt over runs, and each run looks the key up once,
    so a key of very many rows does not meet in one task."""
    dealt = frame.withColumn("run_", F.pmod(F.xxhash64(F.lit(7), F.col("cls")), F.lit(tasks)))
    runs = dealt.select(key, "run_").distinct().join(values, key, "left")
    return dealt.join(runs, [key, "run_"]).drop("run_")


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text, ...).

    A-Z in lower case; words are runs of characters other than space and tab to carriage return. The set of a document
    is its different runs of five words, or all its words as one if they are fewer. Two documents link if 100 *
    intersection >= 80 * union; component_id is the smallest doc_id that links reach. Null texts and texts without words
    have an empty set and are linked with nothing. doc_id is an integer; a row without one has a null component unless
    linked. Rows of one doc_id are documents that share it. Shingles and sets are compared by 64-bit hashes. Other columns
    are ignored; an empty table gives an empty result. docs is read twice and must give the same rows each time.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = Shared(spark)
    rows = stored(classed(docs, tasks), "rows")
    sets = stored(token_sets(docs, rows), "sets")
    first = now = stored(led(sets, 0, tasks, given), "led")
    dropped(sets)
    label, rounds = now.select("cls", F.col("lead").alias("comp")), []
    for turn in range(1, ROUNDS):
        now = stored(led(now.where("lead = cls").select("cls", "n", "tokens"), turn, tasks, given), "led")
        rounds.append(now)
        moved = now.where("lead <> cls").select(F.col("cls").alias("comp"), "lead")
        label = looked_up(label, moved, "comp", tasks).select("cls", F.coalesce("lead", "comp").alias("comp"))
    label = stored(label, "groups")
    dropped(*rounds)
    members = first.select("cls", "n", "tokens").join(label, "cls")
    counts = counted(first.select("tokens"), lambda b: unpacked(b.column("tokens"))[0], LEVEL_BITS)
    levels = given.give(np.log2(np.maximum(counts, 1)).astype(np.uint8))
    homes = stored(in_groups(members, levels, given), "homes")
    dropped(first)
    found = stored(visits(homes, levels, tasks), "visits")
    joined = components(opened(homes, found, tasks, given))
    dropped(homes, found)
    given.release()  # all that used them is written
    final = looked_up(label, joined.withColumnRenamed("node", "comp"), "comp", tasks).select("cls", F.coalesce("label", "comp").alias("comp"))
    # Rows of a class are spread over runs, so that a class of very many copies never meets in one task.
    run = F.pmod(F.xxhash64(F.lit(3), F.col("doc_id")), F.lit(tasks)).alias("run")
    some = rows.where("cls IS NOT NULL").select("doc_id", "n", "cls", run)
    leaf = some.groupBy("cls", "run").agg(F.min("doc_id").alias("least"))
    least = leaf.groupBy("cls").agg(F.min("least").alias("least")).join(final, "cls", "left").select("cls", "least", F.coalesce("comp", "cls").alias("comp"))
    of_comp = least.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = looked_up(least.select("cls", "comp"), of_comp, "comp", tasks).select("cls", "component_id")
    down = leaf.select("cls", "run").join(named, "cls")
    linked = some.join(down, ["cls", "run"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("cls IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty)


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their component, and those without a doc_id, with all their columns.

    Cases as in link_components(); of rows that share the smallest doc_id all stay.
    """
    gone = link_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(docs[c] for c in quoted(docs)))


def quoted(docs: DataFrame) -> list[str]:
    """The names of the columns, fit for docs[...] whatever signs they have."""
    return [f"`{c.replace('`', '``')}`" for c in docs.columns]


SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {SHINGLE - 1}, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) AS h FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""
