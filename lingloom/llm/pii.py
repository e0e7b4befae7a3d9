"""Personal data in texts: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field adds what patterns miss: addresses written out (`ann dot lee at example
dot org`), numbers without a country code (`(555) 010-2030`). It is trained from a small labelled table, made by a
rule in `labelled()`, by gradient ascent on the conditional likelihood, and decoded by Viterbi in numpy batches.
Its spans are kept if they overlap no base span and have the parts of their kind (`plausible`).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lingloom.llm.words import lowered, mixed, slices, u64

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: every start before an @ meets the same @, so one try at each is enough, and long runs stay linear."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def is_octet(digits: str) -> bool:
    """Whether a number of any length is at most 255: leading zeros go first, since int() refuses very long numbers."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time of each dotted chain."""
    for chain in NUMBERS.finditer(text):
        parts = chain[0].split(".")
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(map(is_octet, four)):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind."""
    found = [(*x, 0) for x in emails(text)] if "@" in text else []
    found += [(*x, 1) for x in ips(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


# Shapes. A token is a run of letters (or of bytes of other scripts), a run of digits, or one other byte.

#: Words that announce or hold personal data; the words of a line share a shape.
CUES = (
    ("at",),
    ("dot", "punto", "point", "punkt"),
    ("com", "org", "net", "edu", "io", "de", "fr", "es", "uk", "info"),
    ("phone", "tel", "telephone", "mobile", "cell", "call", "fax", "whatsapp", "telefon", "ring"),
    ("email", "mail", "contact", "write", "reach", "address"),
    ("card", "visa", "mastercard", "account", "amex"),
    ("ip", "server", "host", "login", "address"),
    ("version", "page", "chapter", "section", "release", "figure", "year", "isbn", "id", "number"),
)
PUNCT = "@.-()+:/_%#[]{}<>"
LENGTHS = np.array([1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 14, 20])
FIRST_DIGIT = 4
FIRST_PUNCT = FIRST_DIGIT + len(LENGTHS)
FIRST_CUE = FIRST_PUNCT + len(PUNCT) + 1
EDGE = FIRST_CUE + len(CUES)
SHAPES = 2 * EDGE + 1  # each with and without white space before it, and beyond the text
CONTEXT = (-2, -1, 0, 1, 2)
SPACE_BYTE, LETTER_BYTE, DIGIT_BYTE, OTHER_BYTE = range(4)
BYTE = np.full(256, OTHER_BYTE, np.uint8)
BYTE[[32, *range(9, 14)]] = SPACE_BYTE
BYTE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER_BYTE
BYTE[48:58] = DIGIT_BYTE
PUNCT_SHAPE = np.full(256, FIRST_PUNCT + len(PUNCT), np.int16)
PUNCT_SHAPE[[ord(c) for c in PUNCT]] = np.arange(FIRST_PUNCT, FIRST_PUNCT + len(PUNCT))
LONGEST = 16  # bytes of a cue word


def cue_key(low: np.ndarray | np.uint64, high: np.ndarray | np.uint64) -> np.ndarray:
    """One number for a word of up to LONGEST bytes, of its first eight and its other bytes."""
    return low + mixed(np.atleast_1d(np.asarray(high, np.uint64)) + u64(1))


def cue_of(word: str) -> int:
    raw = word.encode().ljust(LONGEST, b"\0")
    return int(cue_key(u64(int.from_bytes(raw[:8], "little")), u64(int.from_bytes(raw[8:], "little")))[0])


CUE_OF = {cue_of(w): FIRST_CUE + k for k, line in reversed(list(enumerate(CUES))) for w in line}
CUE_KEYS = np.array(sorted(CUE_OF), np.uint64)
CUE_SHAPES = np.array([CUE_OF[k] for k in sorted(CUE_OF)], np.int16)


def shaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, shape and row of every token."""
    n = len(data)
    kind = BYTE[data]
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == OTHER_BYTE)
    new[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    kinds = kind[start]
    solid = kinds != SPACE_BYTE
    spaced = np.ones(len(start), np.int16)
    spaced[1:] = ~solid[:-1]
    row = np.searchsorted(offsets, start, "right") - 1
    spaced[1:][row[1:] != row[:-1]] = 1
    start, end, kinds, spaced, row = start[solid], end[solid], kinds[solid], spaced[solid], row[solid]
    size = end - start
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90), dtype=np.int64)])
    caps = upper[end] - upper[start]
    shape = np.where(caps == 0, 0, np.where(caps == size, 2, np.where((caps == 1) & (data[start] <= 90), 1, 3))).astype(np.int16)
    digit = kinds == DIGIT_BYTE
    shape[digit] = FIRST_DIGIT + np.searchsorted(LENGTHS, size[digit], "right") - 1
    other = kinds == OTHER_BYTE
    shape[other] = PUNCT_SHAPE[data[start[other]]]
    short = np.flatnonzero((kinds == LETTER_BYTE) & (size <= LONGEST))
    padded = lowered(np.concatenate([data, np.zeros(LONGEST, np.uint8)]))
    halves = [np.zeros(len(short), np.uint64) for _ in range(2)]
    for k in range(LONGEST):
        own = np.flatnonzero(k < size[short])
        halves[k // 8][own] |= padded[start[short[own]] + k].astype(np.uint64) << u64(8 * (k % 8))
    key = cue_key(*halves)
    at = np.minimum(np.searchsorted(CUE_KEYS, key), len(CUE_KEYS) - 1)
    cue = CUE_KEYS[at] == key
    shape[short[cue]] = CUE_SHAPES[at[cue]]
    return start, end, shape + spaced * np.int16(EDGE), row


#: Bytes of text of which the labels are found together, and steps after which scores are brought back to 0 at the most.
TOGETHER = 8 << 20
LEVEL = 32
#: Sequences up to which a step takes all pairs of labels at once.
FEW = 64


class Field:
    """Weights of the field: emissions [context, shape, label] and transitions [label, label]."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit.astype(np.float32), move.astype(np.float32)

    def scores(self, shapes: np.ndarray) -> np.ndarray:
        """Emission scores [sequence, position, label] of padded shapes [sequence, position + 4]."""
        width = shapes.shape[1] - 4
        out = self.emit[0][shapes[:, :width]]
        for k in range(1, 5):
            out += self.emit[k][shapes[:, k : k + width]]
        return out

    def decode(self, shapes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The best labels [sequence, position] of padded shapes; size falls from row to row."""
        number, rank, step = by_step(size)
        out = np.zeros((len(size), shapes.shape[1] - 4), np.int8)
        out[rank, step] = self.best(self.scores(shapes)[rank, step], number)
        return out

    def labels(self, shape: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The best label of each token of the texts shape[bounds[k]:bounds[k + 1]], each text by one pass over all of it."""
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        number, rank, step = by_step(size[order])
        text = order[rank]
        at, low, high = bounds[text] + step, bounds[text], bounds[text + 1]
        emit = np.zeros((len(at), self.emit.shape[2]), np.float32)
        for k in range(5):
            near = at + k - 2
            inside = (near >= low) & (near < high)
            emit += self.emit[k][np.where(inside, shape[np.clip(near, 0, len(shape) - 1)], SHAPES - 1)]
        out = np.zeros(len(shape), np.int8)
        out[at] = self.best(emit, number)
        return out

    def best(self, emit: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The best labels by Viterbi over all sequences at once. emit has the tokens of the first step of all sequences, then
        those of the second, and so on; number: how many sequences have each step, the longest ones first."""
        if not len(number):
            return np.zeros(0, np.int8)
        labels, into = emit.shape[1], self.move
        off = np.concatenate([[0], np.cumsum(number)])
        best = emit[: off[1]] + np.where((np.arange(labels) % 2 == 0) & (np.arange(labels) > 0), np.float32(-1e4), np.float32(0))
        back, out = np.zeros((len(emit), labels), np.int8), np.zeros(len(emit), np.int8)
        for t in range(1, len(number)):
            n = number[t]
            come = back[off[t] : off[t + 1]]
            if n <= FEW:  # fewer operations, of more numbers
                cand = best[:n, :, None] + into
                come[:] = cand.argmax(1)
                now = cand.max(1)
            else:
                now = np.empty((n, labels), np.float32)
                for y in (0, *range(1, labels, 2)):
                    cand = best[:n] + into[:, y]
                    come[:, y] = cand.argmax(1)
                    now[:, y] = cand.max(1)
                # Only the two labels of its own kind may come before an inner label.
                for y in range(2, labels, 2):
                    a, b = best[:n, y - 1] + into[y - 1, y], best[:n, y] + into[y, y]
                    come[:, y] = np.where(b > a, y, y - 1)
                    now[:, y] = np.maximum(a, b)
            now += emit[off[t] : off[t + 1]]
            if t % LEVEL == 0:  # else the sums of long texts would lose their last digits
                now -= now.max(1, keepdims=True)
            best[:n] = now
        label = best.argmax(1).astype(np.int8)
        for t in range(len(number) - 1, -1, -1):
            n = number[t]
            out[off[t] : off[t + 1]] = label[:n]
            if t:
                label[:n] = back[off[t] + np.arange(n), label[:n]]
        return out


def by_step(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences of falling size: how many have each step; and of the tokens, step by step, the sequence and the step."""
    number = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0))
    step = np.repeat(np.arange(len(number)), number)
    return number, np.arange(len(step)) - np.repeat(np.cumsum(number) - number, number), step


def padded(shape: np.ndarray, begin: np.ndarray, size: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Shapes [sequence, width + 4] with the edge shape outside; before and after bound what a sequence may see."""
    width = int(size.max())
    at = begin[:, None] + np.arange(-2, width + 2)
    inside = (at >= before[:, None]) & (at < after[:, None])
    return np.where(inside, shape[np.clip(at, 0, len(shape) - 1)], SHAPES - 1)


def labelled(seed: int = 7, count: int = 450) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The labelled table: short texts and the spans of personal data in them, made by a rule."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwygpbvk"
    word = lambda lo=2, hi=9: "".join(rng.choice(letters) for _ in range(rng.randint(lo, hi)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    top = lambda: rng.choice(CUES[2])

    def email() -> str:
        local = rng.choice([word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}_{word()}"])
        host = rng.choice([word(3, 8), f"{word(3, 6)}{digits(1)}"])
        signs = [(" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" AT ", " DOT "), (" at ", "."), ("@", ".")]
        at, dot = rng.choice(signs)
        return (local.replace(".", dot) if " dot " in dot and rng.random() < 0.5 else local) + at + host + dot + (rng.choice([f"{word(3, 7)}{dot}", ""])) + top()

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        forms = [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{a} {b}{c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}"]
        forms += [f"+{digits(2)} {a} {b}{c}", f"+1 ({a}) {b}-{c}", f"00{digits(2)} {a} {b}{c}"]
        return rng.choice(forms)

    def ip() -> str:
        return rng.choice([".", ".", " . ", " dot ", "[.]"]).join(str(rng.randint(0, 255)) for _ in range(4))

    def card() -> str:
        d = digits(16)
        return rng.choice([d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}"])

    def clean() -> str:
        return rng.choice(
            [
                f"version {digits(1)}.{digits(1)}",
                f"{digits(1)}.{digits(1)}.",
                f"{digits(4)}",
                f"{digits(2)}.{digits(2)}.{digits(4)}",
                f"{digits(4)}-{digits(2)}-{digits(2)}",
                f"{digits(2)} %",
                f"page {digits(3)}",
                f"{digits(3)},{digits(3)}",
                f"${digits(3)}.{digits(2)}",
                f'"{word(1, 2)}{digits(3)}{word(1, 1)}{digits(2)}{word(2, 3)}{digits(4)}"',
                f"{word()} at {word()}.",
                f"{word()} at {word()} dot {word()}",
                f"at {digits(2)}:{digits(2)}",
                f"{word()} at the {word()}",
                f"{digits(7)}",
                f"{digits(12)}",
                f"ISBN {digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
                f"{word()}: {digits(3)} {digits(3)}",
                f"{word()}, {word()} at {word()}. {word().capitalize()}",
                f"({word()}) [{word()}]",
                f"dot {word()} dot {top()}",
                f"{digits(2)}/{digits(2)}/{digits(4)}",
                f"id {digits(9)}",
                f"{word()}###",
                f"{word()} | {word()}",
                f"{word()}@{word()}",
                f"{digits(5)} {word()} {digits(3)}",
            ]
        )

    made = {"email": email, "phone": phone, "ip": ip, "card": card}
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(rng.randint(1, 4)):
            plain = (rng.choice(["at", "the", "de", "a", *CUES[7], word()] if rng.random() < 0.2 else [word()]) for _ in range(rng.randint(1, 7)))
            cased = (w if rng.random() < 0.7 else w.capitalize() if rng.random() < 0.6 else w.upper() for w in plain)
            text += " ".join(cased) + rng.choice([" ", " ", ", ", ". ", "\n", ": "])
            if rng.random() < 0.45:
                text += clean()
            else:
                kind = rng.choice(["email", "email", "phone", "phone", "ip", "card"])
                if rng.random() < 0.4:
                    text += rng.choice(CUES[{"email": 4, "phone": 3, "ip": 6, "card": 5}[kind]]) + rng.choice([" ", ": ", " : "])
                x = made[kind]()
                spans.append((len(text), len(text) + len(x), kind))
                text += x
            text += rng.choice([" ", ". ", ", ", "\n", "; "])
        out.append((text + word(), spans))
    return out


def trained(table: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 100, rate: float = 0.25, decay: float = 2e-4) -> Field:
    """The field of largest penalised likelihood, found by Adam over the whole table at once."""
    rows = []
    for text, spans in table:
        start, end, shape, _ = shaped(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        label = np.zeros(len(start), np.int64)
        for a, b, kind in spans:
            inside = np.flatnonzero((start >= a) & (end <= b))
            label[inside], label[inside[0]] = 2 * KINDS.index(kind) + 2, 2 * KINDS.index(kind) + 1
        rows.append((shape, label))
    width, labels = max(len(s) for s, _ in rows), len(LABELS)
    x = np.full((len(rows), width + 4), SHAPES - 1)
    y = np.zeros((len(rows), width), np.int64)
    mask = np.zeros((len(rows), width), bool)
    for k, (shape, label) in enumerate(rows):
        x[k, 2 : 2 + len(shape)], y[k, : len(label)], mask[k, : len(label)] = shape, label, True
    banned = np.zeros((labels, labels))
    for b in range(2, labels, 2):
        banned[[a for a in range(labels) if a not in (b - 1, b)], b] = -1e4
    first = np.where((np.arange(labels) > 0) & (np.arange(labels) % 2 == 0), -1e4, 0.0)
    params = [np.zeros((5, SHAPES, labels)), np.zeros((labels, labels))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    gold_move = np.zeros((labels, labels))
    np.add.at(gold_move, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)

    def log_sum(z: np.ndarray, axis: int) -> np.ndarray:
        top = z.max(axis, keepdims=True)
        return np.log(np.exp(z - top).sum(axis)) + top.squeeze(axis)

    for step in range(1, rounds + 1):
        move = params[1] + banned
        emit = sum(params[0][k][x[:, k : k + width]] for k in range(5))
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = emit[:, 0] + first
        for t in range(1, width):
            nxt = log_sum(alpha[:, t - 1, :, None] + move, 1) + emit[:, t]
            alpha[:, t] = np.where(mask[:, t, None], nxt, alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            before = log_sum(move + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], before, 0)
        whole = log_sum(alpha[:, -1], 1)
        share = np.exp(alpha + beta - whole[:, None, None]) * mask[..., None]
        error = -share
        np.put_along_axis(error, y[..., None], np.take_along_axis(error, y[..., None], 2) + mask[..., None], 2)
        up = np.zeros_like(params[0])
        for k in range(5):
            flat_x = x[:, k : k + width].ravel()
            for c in range(labels):
                up[k, :, c] = np.bincount(flat_x, error[..., c].ravel(), SHAPES)
        both = np.zeros((labels, labels))
        for t in range(1, width):
            on = mask[:, t]
            if on.any():
                both += np.exp(alpha[on, t - 1, :, None] + move + (emit[on, t] + beta[on, t] - whole[on, None])[:, None, :]).sum(0)
        for p, g, m in zip(params, (up, gold_move - both), moments, strict=True):
            g = g / len(rows) - decay * p
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p += rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return Field(params[0], params[1] + banned)


@lru_cache(1)
def default_field() -> Field:
    return trained(labelled())


def plausible(kind: str, found: str) -> bool:
    """Whether a span of the field has the parts that its kind needs."""
    digits = NOT_DIGIT.sub("", found)
    if kind == "email":
        words = re.findall(r"[a-z]+", found.lower())
        return ("@" in found or "at" in words[1:]) and ("." in found or "dot" in words[2:]) and bool(words) and words[-1] in CUES[2]
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    parts = re.findall(r"[0-9]+", found)
    return len(parts) == 4 and all(map(is_octet, parts))


def field_spans(field: Field, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, str]]:
    """(row, start byte, end byte, kind) of the field's spans in texts data[offsets[k]:offsets[k + 1]]."""
    start, end, shape, row = shaped(data, offsets)
    if not len(start):
        return
    label = field.labels(shape, np.searchsorted(row, np.arange(len(offsets))))
    heads = np.flatnonzero(label % 2 == 1)
    for h in heads:
        t = h + 1
        while t < len(label) and label[t] == label[h] + 1 and row[t] == row[h]:
            t += 1
        yield int(row[h]), int(start[h]), int(end[t - 1]), KINDS[(label[h] - 1) // 2]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs(doc_id, text, ...).

    Counts and base_sha256 are of the base spans; spans has those and the field's. The field's labels are the best
    ones of the whole text, however long. Positions are code points, ends exclusive. A null text counts as empty: no spans, the hash of the empty string. Repeated rows give repeated rows;
    a null doc_id is carried through; other columns are ignored; an empty table gives an empty result.
    """
    field = field or default_field()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for lo, hi, data, offsets in slices(batch.column("text"), TOGETHER):
                texts = [x.as_py() or "" for x in batch.column("text").slice(lo, hi - lo)]
                more: dict[int, list[tuple[int, int, str]]] = {}
                for row, a, b, kind in field_spans(field, data, offsets):
                    head = data[offsets[row] : a].tobytes().decode("utf-8", "ignore")
                    found = data[a:b].tobytes().decode("utf-8", "ignore")
                    if plausible(kind, found):
                        more.setdefault(row, []).append((len(head), len(head) + len(found), kind))
                for k, text in enumerate(texts):
                    base = base_spans(text)
                    extra = [x for x in more.get(k, ()) if all(x[1] <= a or x[0] >= b for a, b, _ in base)]
                    for j, kind in enumerate(KINDS):
                        out[j].append(sum(x[2] == kind for x in base))
                    out[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                    out[5].append(joined([*base, *extra]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:4]), *(pa.array(x, pa.string()) for x in out[4:])], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {id_type}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")
