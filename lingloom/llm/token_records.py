"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record is one document; all numbers are little-endian:

    8 bytes  length of the payload
    4 bytes  masked CRC-32 of these eight bytes
    payload  1 byte of flags, 8 bytes doc_id (signed), then the ids
    4 bytes  masked CRC-32 of the payload
    1 byte   line feed

Flags: 1, there is no doc_id (its eight bytes are 0); 2, an id takes four bytes (else two). A checksum is masked, that is
rotated and shifted, so that data which hold checksums of their own still have a checksum that tells. The line feed is what
Spark's text writer puts after a row: so files are written, committed and retried by Spark on any file system that it can
reach, and no task opens a path. Readers go by the lengths, never by line feeds.

Files are named part-NNNNN... in the order of doc_id. Each holds the records of one range, about FILE_BYTES of text, so it
is read whole (binaryFile) by one task. The index has a row for each record: its file, offset and length.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lingloom.llm.scratch import Shared, place
from lingloom.llm.words import SPACE, Words, lowered, slices, words

#: Bytes of text whose ids go to one file, about.
FILE_BYTES = 64 << 20
#: Bytes of text that a task encodes at a time, and pieces that it remembers the ids of.
SLICE = 4 << 20
REMEMBERED = 1 << 17
#: Words of letters that are encoded in one text, and what the last token of a word ends with.
TOGETHER = 4096
WORD_END = "</w>"
#: A fixed value: what the splitter of such a model keeps.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LENGTH, CHECKSUM, PAYLOAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<Bq")
HEAD, TAIL = LENGTH.size + CHECKSUM.size, CHECKSUM.size
NO_ID, WIDE = 1, 2
MASK = 0xA282EAD8
BLOCK = 1024


def masked(data: bytes | memoryview) -> int:
    """The CRC-32 of data, rotated right by 15 bits and shifted by a constant."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def framed(doc_id: int | None, ids: np.ndarray, wide: bool) -> bytes:
    """A record without the line feed at its end."""
    payload = PAYLOAD.pack(NO_ID * (doc_id is None) | WIDE * wide, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = LENGTH.pack(len(payload))
    return b"".join((length, CHECKSUM.pack(masked(length)), payload, CHECKSUM.pack(masked(payload))))


def opened(payload: bytes | memoryview) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of a payload."""
    flags, doc_id = PAYLOAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=PAYLOAD.size)
    return None if flags & NO_ID else doc_id, ids


def payload_of(record: bytes | memoryview, name: str = "record", at: int = 0) -> memoryview:
    """The payload of the record that begins there; damage raises and says where."""
    view = memoryview(record)
    if len(view) < at + HEAD:
        raise ValueError(f"{name}: cut off at byte {at}")
    length = view[at : at + LENGTH.size]
    if masked(length) != CHECKSUM.unpack_from(view, at + LENGTH.size)[0]:
        raise ValueError(f"{name}: the length at byte {at} is damaged")
    end = at + HEAD + LENGTH.unpack(length)[0]
    if len(view) < end + TAIL:
        raise ValueError(f"{name}: cut off in the record at byte {at}")
    if masked(view[at + HEAD : end]) != CHECKSUM.unpack_from(view, end)[0]:
        raise ValueError(f"{name}: the record at byte {at} is damaged")
    return view[at + HEAD : end]


def payloads(content: bytes, name: str) -> Iterator[tuple[int, memoryview]]:
    """(offset, payload) of every record of a file."""
    at = 0
    while at < len(content):
        payload = payload_of(content, name, at)
        yield at, payload
        at += HEAD + len(payload) + TAIL + 1


#: Bytes by kind: ASCII letters, other ASCII signs, and those that may act on their neighbours (the apostrophe of contractions,
#: all beyond ASCII); white space has none.
LETTER, SIGN, BOUND = 1, 2, 3
KIND = np.full(256, SIGN, np.uint8)
KIND[128:], KIND[ord("'")] = BOUND, BOUND
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[SPACE] = 0


class Encoder:
    """Ids of texts, by encoding each different piece of a word with the tokenizer library once.

    That gives the ids of the whole text if the model is one of parts_words(): white space parts tokens and has none, case does
    not matter, and neither a token of the splitter nor a composed character spans an ASCII letter and another ASCII sign that
    is no apostrophe. So pieces are words, cut there and in small letters; a word with the beginning of a special token in it
    stays as it is.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(model)
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.final[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.marks = {t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.known: dict[bytes, int] = {}
        self.ids, self.begin, self.size = (np.zeros(0, np.int32) for _ in range(3))

    def forget(self, number: int) -> None:
        """Drops all pieces but the first ones; those that come often come early."""
        if len(self.known) > number:
            self.known = dict(islice(self.known.items(), number))
            self.begin, self.size = self.begin[:number], self.size[:number]
            self.ids = self.ids[: int(self.size.sum())]

    def learn(self, new: list[bytes]) -> None:
        """Encodes pieces: those of letters only many at a time, as each is one word to the model, whose last id ends it."""
        words_, others = [w for w in new if w.isalpha()], [w for w in new if not w.isalpha()]
        ids, size = [], []
        for lo in range(0, len(words_), TOGETHER):
            some = b" ".join(words_[lo : lo + TOGETHER]).decode()
            got = np.array(self.tokenizer.encode_batch_fast([some], add_special_tokens=False)[0].ids, np.int32)
            ids.append(got)
            size.append(np.diff(np.flatnonzero(self.final[got]), prepend=-1).astype(np.int32))
        single = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False)]
        ids.append(np.fromiter(chain.from_iterable(single), np.int32))
        size.append(np.fromiter(map(len, single), np.int32))
        sizes = np.concatenate(size)
        if len(sizes) != len(new):
            raise ValueError("a word of letters has other than one last token")
        self.begin = np.append(self.begin, (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32))
        self.size, self.ids = np.append(self.size, sizes), np.concatenate([self.ids, *ids])
        for w in chain(words_, others):
            self.known[w] = len(self.known)

    def pieces(self, data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Bytes in small letters, and where each piece, or the white space between two, begins; one more at the end."""
        small, kind = lowered(data), KIND[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] < BOUND) & (kind[:-1] < BOUND)
        for mark in self.marks:
            at = np.flatnonzero((data[:-1] == mark[0]) & (data[1:] == mark[1]))
            for k in np.unique(np.searchsorted(w.starts, at, "right") - 1):
                small[w.starts[k] : w.ends[k]] = data[w.starts[k] : w.ends[k]]
                cut[w.starts[k] : w.ends[k]] = False
        cut[w.starts], cut[w.ends] = True, True
        cut[: w.starts[0]], cut[w.ends[-1] + 1 :] = False, False
        return small, np.flatnonzero(cut)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts data[offsets[k]:offsets[k + 1]], and where those of each text begin (and one more)."""
        w = words(data, offsets)
        if not len(w.starts):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        small, bounds = self.pieces(data, w)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(small)])
        coded = column.dictionary_encode()
        found = [b"" if SPACE[x[0]] else x for x in coded.dictionary.to_pylist()]
        self.learn([x for x in dict.fromkeys(found) if x not in self.known])
        which = np.fromiter(map(self.known.__getitem__, found), np.int32, len(found))[coded.indices.to_numpy()]
        sizes = self.size[which]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.begin[which] - (ends - sizes), sizes) + np.arange(ends[-1])]
        if len(self.known) > 2 * REMEMBERED:
            self.forget(REMEMBERED)
        first = np.append(np.searchsorted(bounds, w.starts), len(bounds) - 1)[w.first]
        return ids, np.append(0, ends)[first]


@lru_cache(1)
def encoder_of(model: str) -> Encoder:
    """The encoder of a worker, which knows the pieces of the tasks that it ran before."""
    return Encoder(model)


def parts_words(model: str) -> bool:
    """Whether a tokenizer file is one that Encoder can take: by its own words, runs of white space become blanks and letters
    small before the text is split; of it only runs of letters with an end of word, contractions, single digits and runs of
    other signs are kept; and nothing is added around a text."""
    spec = json.loads(model)
    normalisers = (spec.get("normalizer") or {}).get("normalizers", [])
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        [x.get("type") for x in normalisers] == ["NFC", "Replace", "Lowercase"]
        and (normalisers[1].get("pattern"), normalisers[1].get("content")) == ({"Regex": "\\s+"}, " ")
        and (first.get("type"), first.get("invert"), first.get("behavior")) == ("Split", True, "Removed")
        and first.get("pattern") == {"Regex": SPLITTER}
        and spec["model"].get("end_of_word_suffix") == WORD_END
        and spec.get("post_processor") is None
        and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or len(x["content"].split()) != 1 for x in spec.get("added_tokens", []))
    )


def write_records(docs: DataFrame, path: str, model_file: str, end_id: int | None = None) -> None:
    """Encodes docs(doc_id, text, ...) into records in {path}/records, in ascending doc_id order.

    end_id, if given, follows the ids of each document. A null text counts as empty. Rows of one doc_id stand in the order of
    a hash of their texts, rows without an id before all others; repeated rows are records of their own. Other columns are
    ignored; an empty table gives no records. The model must be one of parts_words(), else this raises.
    """
    spark, shared = docs.sparkSession, Shared(docs.sparkSession)
    with open(model_file, encoding="utf-8") as f:
        text = f.read()
    if not parts_words(text):
        raise ValueError(f"{model_file}: white space or case counts in this model, or it splits in another way")
    from tokenizers import Tokenizer

    wide = max(Tokenizer.from_str(text).get_vocab_size(), (end_id or 0) + 1) > 1 << 16
    model = shared.give(text)  # a file of a few megabytes, whatever the corpus

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = encoder_of(model.value), np.array([] if end_id is None else [end_id], np.int64)
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for lo, hi, data, offsets in slices(batch.column("text"), SLICE):
                ids, first = encoder.encode(data, offsets)
                rows = [framed(names[lo + k], np.append(ids[first[k] : first[k + 1]], tail), wide) for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    # Equal rows may go to several files: by the task that read them.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.spark_partition_id().alias("from"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    there = rows.repartitionByRange(files, *order, F.col("from")).sortWithinPartitions(*order, "from").select("doc_id", "text")
    there.mapInArrow(encode, "record binary").select(F.col("record").cast("string")).write.option("lineSep", "\n").text(f"{path}/records")
    shared.release()


def record_files(spark: SparkSession, path: str) -> DataFrame:
    """file, number, content of the files of records."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("file"), F.regexp_extract(name, r"^part-(\d+)", 1).cast("int").alias("number"), "content")


ENTRY = "file string, number int, at long, length long, doc_id long, first long, n_tokens long"


def scanned(files: DataFrame, schema: str, value: Callable[[np.ndarray], object] | None = None) -> DataFrame:
    """The records of files, each with its place, the number of ids before it in its file, its own, and value(ids) if asked for."""
    fields = [x.split() for x in schema.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32())}
    arrow = pa.schema([(n, types[t]) for n, t in fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, number, content in zip(*(batch.column(c) for c in ("file", "number", "content")), strict=True):
                name, rows, held, first = file.as_py(), [], 0, 0
                for at, payload in payloads(content.as_buffer().to_pybytes(), name):
                    doc_id, ids = opened(payload)
                    rows.append((name, number.as_py(), at, HEAD + len(payload) + TAIL, doc_id, first, len(ids), *([value(ids)] if value else [])))
                    first, held = first + len(ids), held + len(payload)
                    if held > SLICE:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return files.mapInArrow(scan, schema)


def index_records(spark: SparkSession, path: str) -> DataFrame:
    """Writes {path}/index from the files and returns it: file, number, at, length, doc_id, first (ids before the record in
    its file), n_tokens. Every checksum is verified on the way."""
    scanned(record_files(spark, path), ENTRY).write.mode("overwrite").parquet(f"{path}/index")
    return spark.read.schema(ENTRY).parquet(f"{path}/index")


def file_starts(index: DataFrame) -> DataFrame:
    """number, before: the ids in all files before each. A row a file; prefix sums in two levels, so no task sees all files."""
    totals = index.groupBy("number").agg(F.sum("n_tokens").alias("total")).withColumn("block", F.floor(F.col("number") / BLOCK))
    inner = F.sum("total").over(Window.partitionBy("block").orderBy("number")) - F.col("total")
    blocks = totals.groupBy("block").agg(F.sum("total").alias("all"))
    outer = blocks.select("block", (F.sum("all").over(Window.orderBy("block")) - F.col("all")).alias("outer"))
    return totals.select("number", "block", inner.alias("inner")).join(outer, "block").select("number", (F.col("inner") + F.col("outer")).alias("before"))


def read_records(spark: SparkSession, path: str, value: Callable[[np.ndarray], object] | None = None, kind: str = "array<int>") -> DataFrame:
    """doc_id, start (ids of all records before it), n_tokens, and value of every record of the files, or ids without one.

    value: from the ids to a value of that kind (array<int>, long or string). A damaged record raises.
    """
    index = spark.read.schema(ENTRY).parquet(f"{path}/index")
    found = scanned(record_files(spark, path), f"{ENTRY}, value {kind}", value or (lambda ids: ids.astype(np.int32)))
    start = (F.col("before") + F.col("first")).alias("start")
    return found.join(file_starts(index), "number").select("doc_id", start, "n_tokens", F.col("value").alias("value" if value else "ids"))


def shuffled_records(spark: SparkSession, path: str, seed: int, shards: int | None = None) -> DataFrame:
    """doc_id, ids of all records in an order that hangs on the seed alone: records are cut from their files by the index,
    dealt by a hash of their place, and sorted by it within each of the shards."""
    index = spark.read.schema(ENTRY).parquet(f"{path}/index")
    places = index.groupBy("file").agg(F.collect_list(F.struct("at", "length")).alias("places"))  # those of one file of bounded size
    cut = F.transform("places", lambda p: F.struct(F.xxhash64(F.lit(seed), "file", p["at"]).alias("order"), F.substring("content", p["at"].cast("int") + 1, p["length"].cast("int")).alias("record")))
    rows = record_files(spark, path).join(places, "file").select(F.explode(cut).alias("r")).select("r.*")

    def open_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [opened(payload_of(x.as_py())) for x in batch.column("record")]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int64()), pa.array([x.astype(np.int32) for _, x in pairs], pa.list_(pa.int32()))], ["doc_id", "ids"])

    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(shards, "order").sortWithinPartitions("order").mapInArrow(open_all, "doc_id long, ids array<int>")


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def record_digests(docs: DataFrame, model_file: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of docs, from its record in files of the shared folder."""
    spark = docs.sparkSession
    path = place(spark, "records")
    write_records(docs, path, model_file, end_id)
    index_records(spark, path)
    return read_records(spark, path, crc_of_ids, "long").withColumnRenamed("value", "ids_crc32")
