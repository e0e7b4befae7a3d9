"""Token counts of a byte-level BPE, by compiled deterministic transducers.

Two transducers count the tokens of a text. The first reads character classes and splits the text into pieces, as
the pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+` does. It has twelve
states; its transitions are annotated with the piece starts that they settle, up to one character back. A text is
cut into chunks; the map from entry state to exit state of every chunk is worked out in lockstep, the maps compose
through a parallel prefix scan, and with the entry states known all chunks run once more and mark the starts.

The second reads the bytes of one piece and annotates each transition with the number of tokens by which the count
of the prefix changes (its sum over the piece is the count). It is compiled on demand: a state is the set of starts
that a token may still have, each with its place in the trie of tokens, the token that ends there and its count
relative to the present one. On a byte, of all tokens that may end here exactly one is the last of the prefix: that
whose pair with the token before it encodes to itself. All pieces of a slice run in lockstep through its table, from the
start state; chunks of longer pieces by maps of their entry states that compose by a scan, as the splitter's do.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lingloom.llm.words import flat, mixed, powers, slices, u64

LETTER, NUMBER, BLANK, SPACE, OTHER, QUOTE, ENDS, PAIRS, E, L, STOP = range(11)
START, IN_L, IN_N, IN_O, DONE, AT_QUOTE, QUOTE_R, QUOTE_L, BLANK1, SPACE1, BLANKS, SPACES = range(12)
HERE, BACK = 1, 2  # a piece starts at this character, at the one before
SENTINEL = 0x110000
#: White space of the pattern: code points with Unicode's property White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CHUNK = 64
SLICE = 2 << 20
LONG = 48  # bytes of a piece that run in lockstep with other pieces; the rest of a longer one is cut into such chunks
SCAN = 1024  # chunks that run together
ROUNDS = 6
MOST_STATES = 100_000  # a slice starts with no more
FEW = 4


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point, and STOP for the sentinel between texts."""
    out = np.full(SENTINEL + 1, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(SENTINEL):
        kind = kinds.get(unicodedata.category(chr(c))[0])
        if kind is not None:
            out[c] = kind
    out[WHITE] = SPACE
    out[32], out[39], out[SENTINEL] = BLANK, QUOTE, STOP
    for letters, kind in (("stmd", ENDS), ("rv", PAIRS), ("e", E), ("l", L)):
        out[[ord(x) for x in letters]] = kind
    return out


@lru_cache(1)
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Transitions and annotations [state, class] of the splitter."""
    to, marks = np.zeros((12, 11), np.uint8), np.zeros((12, 11), np.uint8)
    runs = {NUMBER: IN_N, OTHER: IN_O} | dict.fromkeys((LETTER, ENDS, PAIRS, E, L), IN_L)
    for state in range(12):
        pending = BACK if state in (QUOTE_R, QUOTE_L) else 0  # the letter after the quote starts a piece after all
        for kind in range(11):
            if kind == STOP:
                to[state, kind], marks[state, kind] = START, HERE | pending
            elif kind in (BLANK, SPACE):
                more = state in (BLANK1, SPACE1, BLANKS, SPACES)
                to[state, kind] = (BLANKS if kind == BLANK else SPACES) if more else (BLANK1 if kind == BLANK else SPACE1)
                marks[state, kind] = 0 if more else HERE | pending
            else:
                target = runs.get(kind, AT_QUOTE)
                mark = HERE | pending
                if state == BLANK1:
                    mark = 0
                elif state == BLANKS:
                    mark = BACK
                elif state == SPACES:
                    mark = BACK | HERE
                if kind == QUOTE and state in (BLANK1, BLANKS, IN_O, AT_QUOTE):
                    target = IN_O
                if state == target and state in (IN_L, IN_N, IN_O) or state in (IN_O, AT_QUOTE) and target == IN_O:
                    mark = 0
                if target == IN_L and state in (QUOTE_R, QUOTE_L):
                    mark = BACK
                if state == AT_QUOTE and kind in (ENDS, PAIRS, L):
                    target, mark = {ENDS: DONE, PAIRS: QUOTE_R, L: QUOTE_L}[kind], 0
                if (state, kind) in ((QUOTE_R, E), (QUOTE_L, L)):
                    target, mark = DONE, 0
                to[state, kind], marks[state, kind] = target, mark
    return to, marks


def starts(kinds: np.ndarray) -> np.ndarray:
    """Which characters start a piece; kinds ends with STOP, and a STOP starts one too."""
    to, marks = splitter()
    n = len(kinds)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, STOP, np.uint8)
    grid[:n] = kinds
    steps = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    maps = np.repeat(np.arange(12, dtype=np.uint8)[:, None], rows, 1)
    flat_to, flat_marks = to.ravel(), marks.ravel()
    for kind in steps:
        maps = flat_to[maps * np.uint8(11) + kind]
    reach = 1
    while reach < rows:  # after each round, map r covers twice as many chunks that end with chunk r
        later = maps.copy()
        later[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach], 0)
        maps, reach = later, 2 * reach
    state = np.zeros(rows, np.uint8)
    state[1:] = maps[START, :-1]
    out = np.empty((CHUNK, rows), np.uint8)
    for k, kind in enumerate(steps):
        at = state * np.uint8(11) + kind
        out[k], state = flat_marks[at], flat_to[at]
    out = out.T.ravel()[:n]
    found = (out & HERE) > 0
    found[:-1] |= (out[1:] & BACK) > 0
    return found


def check(model: dict) -> None:
    """Raises if the file asks for more than these transducers do."""
    kind, before = model["model"], model.get("pre_tokenizer") or {}
    known = {"add_prefix_space": False, "use_regex": True}
    if kind.get("type") not in (None, "BPE") or model.get("normalizer") or any(kind.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError("the model is no plain byte-level BPE without normaliser")
    if before.get("type") != "ByteLevel" or any(before.get(k, v) != v for k, v in known.items()):
        raise ValueError("texts are split as by ByteLevel(add_prefix_space=False) only")
    if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") for x in model["added_tokens"]):
        raise ValueError("added tokens are found as they stand only")


class Counter:
    """The second transducer, compiled from the vocabulary and merges of a byte-level BPE."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        check(model)
        self.special = [x["content"] for x in model["added_tokens"]]
        shown = {c: b for b, c in shown_bytes().items()}
        ids = {bytes(shown[c] for c in x): i for x, i in model["model"]["vocab"].items() if x not in self.special}
        self.tokens = {i: x for x, i in ids.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        raw = {x: i for x, i in model["model"]["vocab"].items()}
        for k, pair in enumerate(model["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((raw[a], raw[b]), (k, raw[a + b]))
        self.single = [ids[bytes([b])] for b in range(256)]
        self.child: dict[int, int] = {}
        self.token: list[int] = [-1]
        self.grows: list[bool] = [False]
        for x, i in ids.items():
            node = 0
            for b in x:
                self.grows[node] = True
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.grows.append(False)
                node = self.child[key]
            self.token[node] = i
        self.below: list[list[int]] = [[] for _ in self.token]  # of each node: the first FEW + 1 tokens that go on from it
        for x, i in ids.items():
            node = 0
            for b in x:
                if len(self.below[node]) <= FEW:
                    self.below[node].append(i)
                node = self.child[node << 8 | b]
        self.open: dict[tuple[int, int], bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        first = ((0, -1, 0),)
        self.number, self.states = {first: 0}, [first]
        self.to = np.full((1024, 256), -1, np.int32)
        self.emits = np.zeros((1024, 256), np.int16)

    def encoded(self, data: bytes) -> list[int]:
        """Tokens of a short string by merging its pairs in order of rank."""
        got = [self.single[b] for b in data]
        while len(got) > 1:
            best = min(((self.rank[p], k) for k, p in enumerate(zip(got, got[1:], strict=False)) if p in self.rank), default=None)
            if best is None:
                break
            (_, whole), k = best
            got[k : k + 2] = [whole]
        return got

    def fits(self, before: int, token: int) -> bool:
        if before < 0:
            if token not in self.alone:
                self.alone[token] = self.encoded(self.tokens[token]) == [token]
            return self.alone[token]
        found = self.pairs.get((before, token))
        if found is None:
            if len(self.pairs) > 1 << 21:
                self.pairs.clear()
            found = self.pairs[before, token] = self.encoded(self.tokens[before] + self.tokens[token]) == [before, token]
        return found

    def matters(self, node: int, before: int) -> bool:
        """Whether a start still counts: a token that goes on from the node may fit. Dropping the others keeps states few."""
        found = self.open.get((node, before))
        if found is None:
            if len(self.open) > 1 << 21:
                self.open.clear()
            few = self.below[node]
            found = self.open[node, before] = len(few) > FEW or any(self.fits(before, t) for t in few)
        return found

    def compile(self, state: int, byte: int) -> None:
        """Adds the transition of a state on a byte."""
        last = change = None
        live = []
        for node, before, count in self.states[state]:
            after = self.child.get(node << 8 | byte)
            if after is None:
                continue
            if last is None and self.token[after] >= 0 and self.fits(before, self.token[after]):
                last, change = self.token[after], count + 1
            if self.grows[after] and self.matters(after, before):
                live.append((after, before, count))
        new = (*((node, before, count - change) for node, before, count in live), (0, last, 0))
        number = self.named(new)
        self.to[state, byte], self.emits[state, byte] = number, change

    def run(self, grid: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and sums of chunks [byte, chunk] from their entry states, in lockstep."""
        state, total = entry.copy(), np.zeros(len(entry), np.int64)
        for byte in grid:
            nxt = self.to[state, byte]
            if (nxt < 0).any():
                for key in np.unique(state[nxt < 0].astype(np.int64) << 8 | byte[nxt < 0]):
                    self.compile(int(key) >> 8, int(key) & 255)
                nxt = self.to[state, byte]
            total += self.emits[state, byte]
            state = nxt
        return state, total

    def rest(self, data: np.ndarray, entry: tuple) -> int:
        """Tokens that a piece emits after its first bytes, from the state reached there.

        Chunks have maps from entry states to exit states and sums. Such a map is worked out where it is needed: first for
        the start, then, as states soon forget what was long before, for the exits of the chunks before, all chunks at once.
        The maps compose by a scan, which goes on until the next chunk has entered by each chunk's exit; what ROUNDS leave
        unsettled runs a byte at a time.
        """
        sum_, rows = 0, len(data) // LONG
        for lo in range(0, rows, SCAN):
            if len(self.states) > MOST_STATES:
                self.clear()
            grid = np.ascontiguousarray(data[lo * LONG : min(lo + SCAN, rows) * LONG].reshape(-1, LONG).T)
            number = grid.shape[1]
            enter, due = np.zeros(number, np.int32), np.ones(number, bool)
            enter[0] = self.named(entry)
            leave, total = np.zeros(number, np.int32), np.zeros(number, np.int64)
            for _ in range(ROUNDS):
                leave[due], total[due] = self.run(grid[:, due], enter[due])
                due = np.append(False, enter[1:] != leave[:-1])
                if not due.any():
                    break
                enter[1:] = leave[:-1]
            right = int(due.argmax()) if due.any() else number  # chunks before this one are settled
            entry, alone = self.alone_from(self.states[leave[right - 1]], grid[:, right:].T.ravel())
            sum_ += int(total[:right].sum()) + alone
        return sum_ + self.alone_from(entry, data[rows * LONG :])[1]

    def alone_from(self, entry: tuple, data: np.ndarray) -> tuple[tuple, int]:
        """The state after these bytes, and the tokens emitted, a byte at a time."""
        now, sum_ = self.named(entry), 0
        for byte in data.tolist():
            if self.to[now, byte] < 0:
                if len(self.states) > 2 * MOST_STATES:
                    kept = self.states[now]
                    self.clear()
                    now = self.named(kept)
                self.compile(now, byte)
            sum_ += int(self.emits[now, byte])
            now = int(self.to[now, byte])
        return self.states[now], sum_

    def named(self, entry: tuple) -> int:
        """The number of a state."""
        if entry not in self.number:
            self.number[entry] = len(self.states)
            self.states.append(entry)
            if len(self.states) > len(self.to):
                self.to = np.concatenate([self.to, np.full_like(self.to, -1)])
                self.emits = np.concatenate([self.emits, np.zeros_like(self.emits)])
        return self.number[entry]

    def counts(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each piece data[begin:end]; none is empty."""
        if len(self.states) > MOST_STATES:
            self.clear()
        size = end - begin
        order = np.argsort(-size, kind="stable")
        at, size = begin[order], size[order]
        state, total = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        for step in range(min(LONG, int(size[0])) if len(size) else 0):
            n = int(np.searchsorted(-size, -step))  # those longer than step
            now, byte = state[:n], data[at[:n] + step]
            nxt = self.to[now, byte]
            if (nxt < 0).any():
                for key in np.unique(now[nxt < 0].astype(np.int64) << 8 | byte[nxt < 0]):
                    self.compile(int(key) >> 8, int(key) & 255)
                nxt = self.to[now, byte]
            total[:n] += self.emits[now, byte]
            state[:n] = nxt
        for k in range(int(np.searchsorted(-size, -LONG))):
            total[k] += self.rest(data[at[k] + LONG : at[k] + size[k]], self.states[state[k]])
        out = np.empty_like(total)
        out[order] = total
        return out


def shown_bytes() -> dict[int, str]:
    """The character by which a byte-level vocabulary shows each byte: itself if it prints, else the next from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def slice_counts(model: Counter, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each text data[offsets[k]:offsets[k + 1]]."""
    rows = len(offsets) - 1
    extra = np.zeros(rows, np.int64)
    raw = data.tobytes()
    cps = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.flatnonzero((data & 0xC0) != 0x80)  # the byte at which each character begins
    for word in map(str.encode, model.special):
        at = raw.find(word)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(word) <= offsets[row + 1]:  # else it runs over the end of a text
                extra[row] += 1
                k = int(np.searchsorted(heads, at))
                if not cps.flags.writeable:
                    cps = cps.copy()
                cps[k : k + len(word)] = SENTINEL
                at = raw.find(word, at + len(word))
            else:
                at = raw.find(word, at + 1)
    ends = np.searchsorted(heads, offsets[1:])
    row_of = np.repeat(np.arange(rows), np.diff(np.concatenate([[0], ends])) + 1)
    chars = np.insert(cps, ends, SENTINEL)
    place = np.insert(heads, ends, offsets[1:])  # the byte of each character; for a sentinel the end of its text
    first = np.flatnonzero(starts(classes()[chars]))
    begin = place[first]
    last = np.append(first[1:], len(chars))
    end = np.append(place, len(data))[last]
    real = chars[first] != SENTINEL
    first, begin, end = first[real], begin[real], end[real]
    up, down = powers(0, len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + u64(1)) * up[: len(data)], out=total[1:])
    key = mixed((total[end] - total[begin]) * down[begin])
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    found = model.counts(data, begin[one], end[one])[which]
    return np.bincount(row_of[first], found, rows).astype(np.int64) + extra


def token_counts(docs: DataFrame, model_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) for every row of docs(doc_id, text, ...).

    model_path: a byte-level BPE in the JSON form of the tokenizers library, at the same place on every machine.
    Counts are those of its encode() without added special tokens; a special string inside a text is one token. Null
    and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated rows; a null doc_id is carried through;
    other columns are ignored; an empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(model_path)
        for batch in batches:
            tokens = [slice_counts(model, data, offsets) for _, _, data, offsets in slices(batch.column("text"), SLICE)]
            tokens = np.concatenate([*tokens, np.zeros(0, np.int64)])
            _, offsets = flat(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
