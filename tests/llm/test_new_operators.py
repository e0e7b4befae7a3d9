"""Token records, filter audit and fill-in-the-middle, against the tokenizer library and plain Python."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter
from functools import lru_cache
from itertools import permutations

import numpy as np
import pytest
from pyspark.errors import PythonException

import plain
from lingloom.llm import fill_middle, filter_audit, mixing, token_records

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, n long, part string, record string, mask int, file string, words string, digest string"


def frame(spark, rows, parts=3):
    """Documents of (doc_id, text) or (doc_id, text, source), with columns of clashing names."""
    full = [(i, t, (more or (f"s{(i or 0) % 3}",))[0], 1, "p", "r", 7, "f", "w", "d") for i, t, *more in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    bits = ["the", "Cat's", "naïve", "<|endoftext|>", "<|startoftext|>x", "日本語", "éa", "́", "I'll", "don't", "12,345", "a b", " ", "İ", "ΣΑΣ", "\u0001d", "\u0002", "\u0002e", "$0", "\\", "#", "a" * 300, "🙂", "\u0085x", "x　y"]
    spaces = [" ", "  ", "\n", "\t \r\n", "\x0b", "\x0c"]
    out = ["", None, " ", "\n \t", "word", " word ", "<P>", "a <S b", "x <M> y", "<|endoftext|>", "b " * 4000 + "c" * 5000]
    out += ["".join(rng.choice(bits) + (rng.choice(spaces) if rng.random() < 0.8 else "") for _ in range(rng.randint(0, 40))) for _ in range(250)]
    return [*out, out[40], out[41], out[41]]


# Token records.


@lru_cache(1)
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(MODEL)


def whole_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_pieces_have_the_ids_of_whole_texts():
    """Signs, contractions, capitals, marks and special tokens beside each other in every way."""
    rng = random.Random(7)
    bits = ["a", "B", "'", "'s", "'LL", "don't", "é", "e\u0301", "\u0301", ".", "12", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "-", "_", "İ", "K", "ß", "\x1c", "\x00", "\x7f", "\u0085", "\u00a0", "日", "²", "ⅷ", " ", "\n", "I'D", "x" * 90]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    with open(MODEL) as f:
        encoder = token_records.Encoder(f.read())
    for lo in range(0, len(texts), 500):
        some = [t.encode() for t in texts[lo : lo + 500]]
        data, offsets = np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)])
        ids, first = encoder.encode(data, offsets)
        if lo == 1000:
            encoder.forget(100)
        for k, t in enumerate(texts[lo : lo + 500]):
            assert ids[first[k] : first[k + 1]].tolist() == whole_ids(t), t


def test_token_records_are_the_library_s(spark, texts, monkeypatch):
    monkeypatch.setattr(token_records, "SLICE", 2000)
    rows = [(7 * k % 1009 - 100, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in token_records.record_digests(frame(spark, rows), MODEL, 2).collect()}
    assert len(got) == len(rows)
    before = 0
    for i, t in sorted(rows):
        ids = [*whole_ids(t), 2]
        want = (before, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == want, t
        before += len(ids)


def test_token_records_null_ids_and_repeats_have_records_of_their_own(spark):
    rows = [(None, "a b"), (None, None), (5, "same"), (5, "same"), (5, "other words"), (4, "")]
    got = token_records.record_digests(frame(spark, rows, 4), MODEL, 2).collect()
    assert Counter(r.doc_id for r in got) == {None: 2, 5: 3, 4: 1}
    place = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == place
        place += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, None, 4, 5, 5, 5]
    assert token_records.record_digests(frame(spark, []), MODEL, 2).collect() == []


def test_token_records_ids_come_back_in_order_and_shuffled(spark, texts, tmp_path):
    path = f"file://{tmp_path}/own"
    rows = list(enumerate(texts))
    token_records.write_records(frame(spark, rows), path, MODEL)
    index = token_records.index_records(spark, path)
    assert index.count() == len(rows)
    back = {r.doc_id: r.ids for r in token_records.read_records(spark, path).collect()}
    assert back == {i: whole_ids(t) for i, t in rows}
    one, again, other = ([(r.doc_id, r.ids) for r in token_records.shuffled_records(spark, path, seed, 3).collect()] for seed in (1, 1, 2))
    assert one == again != other
    assert dict(one) == dict(other) == back
    assert [i for i, _ in one] != sorted(back)


def test_token_records_by_the_format_alone(spark, tmp_path):
    """The bytes of a file, read by the description of the format."""
    path = f"file://{tmp_path}/plain"
    token_records.write_records(frame(spark, [(3, "the cat"), (None, "")], 1), path, MODEL, 2)
    content = b"".join(bytes(r.content) for r in token_records.record_files(spark, path).orderBy("number").collect())
    mask = lambda b: ((lambda c: (c >> 15 | c << 17) + 0xA282EAD8)(zlib.crc32(b))) & 0xFFFFFFFF
    want = b""
    for flags, doc_id, text in ((1, 0, ""), (0, 3, "the cat")):
        ids = [*whole_ids(text), 2]
        payload = struct.pack(f"<Bq{len(ids)}H", flags, doc_id, *ids)
        length = struct.pack("<Q", len(payload))
        want += length + struct.pack("<I", mask(length)) + payload + struct.pack("<I", mask(payload)) + b"\n"
    assert content == want


def test_token_records_tell_damage():
    ids = np.arange(10, 300)
    record = token_records.framed(9, ids, False) + b"\n"
    wide = token_records.framed(None, ids + 70000, True) + b"\n"
    (a, first), (b, second) = token_records.payloads(record + wide, "f")
    assert (a, b) == (0, len(record))
    assert token_records.opened(first)[0] == 9 and token_records.opened(second)[0] is None
    assert (token_records.opened(second)[1] == ids + 70000).all()
    for at in (3, 10, 40, len(record) - 2):
        bad = bytearray(record)
        bad[at] ^= 4
        with pytest.raises(ValueError, match="damaged|cut off"):
            list(token_records.payloads(bytes(bad), "f"))
    with pytest.raises(ValueError, match="cut off"):
        list(token_records.payloads(record[:-6], "f"))


def test_token_records_damaged_file_raises(spark, tmp_path):
    path = f"file://{tmp_path}/damaged"
    token_records.write_records(frame(spark, [(k, "some words here") for k in range(5)], 1), path, MODEL)
    token_records.index_records(spark, path)
    files = token_records.record_files(spark, path)
    torn = files.selectExpr("file", "number", "substring(content, 1, greatest(length(content) - 3, 0)) AS content").where("length(content) > 0")
    with pytest.raises(PythonException, match="cut off"):
        token_records.scanned(torn, token_records.ENTRY).collect()


def test_token_records_refuse_models_that_join_words(spark):
    with pytest.raises(ValueError, match="white space"):
        token_records.write_records(frame(spark, [(1, "a")]), "unused", public_tokenizers.path("byte_bpe_50k.json"))


# Filter audit.


def failures(rows):
    """Letters that each row fails, by plain Python."""
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, *_ in rows:
        t = t or ""
        w = plain.WORD.findall(t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and t in first and i > first[t]}
        out.append({k for k, x in bad.items() if x})
    return out


def audited(rows, labels):
    """All counts, by running every order."""
    bad, out = failures(rows), {}
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    for part in {r[2] or "" for r in rows}:
        own = [(r[0], b) for r, b in zip(rows, bad, strict=True) if (r[2] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                fails = sum(f in b for _, b in own)
                only = sum(b == {f} for _, b in own)
                shapley[f] += len(gone)
                lost = [sum(i in s for i, _ in gone) for s in (good, toxic)]
                out[part, "".join(order), step + 1] = [len(left), len(gone), fails - len(gone), only, *lost]
        for key in [k for k in out if k[0] == part]:
            out[key].append(shapley[key[1][key[2] - 1]])
    return out


def audit_of(spark, rows, labels):
    got = filter_audit.audit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return {(r.part, r.filter_order, r.step): list(r)[3:] for r in got.collect()}


def test_filter_audit_is_every_order_run(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeXY") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    rows = []
    for k in range(150):
        few = rng.choice([words[:20], words, [w.lower() for w in words]])
        text = " ".join(rng.choice(few) for _ in range(rng.choice([3, 199, 200, 260])))
        rows.append((k, text + rng.choice(["", "", " #", "|"]), rng.choice(["a", "b", "", None])))
    rows += [(200 + k, rows[k % 7][1], "a") for k in range(40)]
    rows += [(300, None, "a"), (301, "", "b"), (302, "", None), (None, "", "b"), (None, rows[0][1], "a"), (None, rows[0][1], "a")]
    rows += [(200, rows[0][1], "a"), (0, rows[0][1], "a")]
    labels = [(k, rng.randint(0, 1), rng.randint(0, 1)) for k in range(0, 320, 2)]
    labels = [*labels, (None, 1, 1), (4, None, 1), (200, 1, 0)]
    merged = {}
    for i, q, t in labels:
        if i is not None:
            a, b = merged.get(i, (0, 0))
            merged[i] = (int(a or q == 1), int(b or t == 1))
    want = audited(rows, [(i, *x) for i, x in merged.items()])
    assert len(want) == 3 * 600
    assert audit_of(spark, rows, labels) == want


def test_filter_audit_cases(spark):
    assert audit_of(spark, [], []) == {}
    one = audit_of(spark, [(1, None, None)], [])
    assert len(one) == 600
    assert one["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]
    assert one["", "BACDE", 1] == [1, 0, 0, 0, 0, 0, 0]


def test_filter_audit_matrices_partition_the_masks():
    """Of each mask and step: kept, removed now, or removed before; of each order, a mask is removed at most once."""
    m = filter_audit.matrices()
    removed = m["removed"].reshape(32, 120, 5)
    kept = m["kept"].reshape(32, 120, 5)
    assert (kept + removed.cumsum(2) == 1).all()
    assert (removed.sum(2) == (np.arange(32) > 0)[:, None]).all()
    assert (m["unique_fails"].sum(1) > 0).sum() == 5


# Fill in the middle.


def example(i, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (n, "plain", None, None, sha(text), sha(text))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return (n, form, len(p), len(m), sha(out), sha(text))


def test_fill_middle_is_brute_force(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, t) for k, t in enumerate(texts)] + [(5000 + k, "a b" * (k % 3)) for k in range(300)]
    got = {r.doc_id: tuple(r)[1:] for r in fill_middle.example_digests(frame(spark, rows)).collect()}
    for i, t in rows:
        assert got[i] == example(i, t), (i, t)
    assert {x[1] for x in got.values()} == {"plain", "spm", "psm"}


def test_fill_middle_markers_that_parts_could_make(spark):
    """Parts that end or begin like markers, at every cut."""
    rows = [(k, t) for k in range(0, 900, 3) for t in ["<P <S <M > P> S> M> <", "< P > <S >"][k % 2 : k % 2 + 1]]
    for r in fill_middle.example_digests(frame(spark, rows)).collect():
        assert r.output_sha256 == example(r.doc_id, dict(rows)[r.doc_id])[4]
        assert r.restored_sha256 == hashlib.sha256(dict(rows)[r.doc_id].encode()).hexdigest()


def test_fill_middle_cases(spark):
    got = fill_middle.example_digests(frame(spark, [(None, "a b c"), (None, "a b c"), (None, None)])).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted([example(None, "a b c"), example(None, "a b c"), example(None, "")])
    assert fill_middle.example_digests(frame(spark, [])).collect() == []
    all_cut = fill_middle.fill_in_middle(frame(spark, [(k, f"one two {k}") for k in range(50)]), percent=100, suffix_first=0).collect()
    assert {r.form for r in all_cut} == {"psm"}
    assert all(r.prefix + r.middle + r.suffix == r.text for r in all_cut)


# Columns of the mix.


def test_mixing_carries_columns_of_any_name(spark):
    rows = [(k, f"word{k % 5} common text {k}", "a" if k % 2 else "b") for k in range(30)]
    docs = frame(spark, rows).selectExpr("*", "n AS n_tokens", "mask AS draw_", "file AS copies", "words AS `odd name`")
    labelled = spark.createDataFrame([(k, "clean" if k % 2 else "poor") for k in range(30)], "doc_id long, domain string")
    keep = ["doc_id", "n_tokens", "draw_", "copies", "odd name"]
    got = mixing.mixed_rates(docs, labelled, {"clean": 0.5, "poor": 0.5}, keep=keep)
    assert got.columns == ["doc_id", "n_tokens_kept", "draw_", "copies_kept", "odd name", "n_tokens", "posteriors", "rate", "copies"]
    assert {(r.n_tokens_kept, r.draw_, r.copies_kept, r["odd name"], r.n_tokens) for r in got.collect()} == {(1, 7, "f", "w", 4)}
