"""Edit distances, in full or up to a bound: the columns of the distance matrix, or of a band of it, as bits of whole numbers.

The built-in distance of columns walks the whole matrix, or a band of it, cell by cell. Here a step takes all cells of the
band in one column at once, as bits of two numbers (whether a cell is one more, or one less, than that above it), in a dozen
operations on numbers of 2 * most + 1 bits. So passages of 100,000 characters take a fraction of a second. Without a bound,
bands are tried that grow until the distance lies within: the cost is that of the distance found, not of the whole matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Texts up to that many characters are measured whole; columns that a band shares one table of places for.
WHOLE = 2048
BLOCK = 4096
#: How far the first band of a long text reaches; each further one reaches four times as far.
FIRST = 64
#: Bytes of the table of places of the texts that are measured together.
TOGETHER = 8_000_000


def places(text: str) -> dict[str, int]:
    """For each character of text a number whose bit k says whether it stands at place k."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    known, which = np.unique(codes, return_inverse=True)
    order = np.argsort(which, kind="stable")
    ends = np.cumsum(np.bincount(which, minlength=len(known)))
    bits = np.zeros(len(codes), np.uint8)
    out, begin = {}, 0
    for code, end in zip(known.tolist(), ends.tolist(), strict=True):
        bits[order[begin:end]] = 1
        out[chr(code)] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        bits[order[begin:end]] = 0
        begin = end
    return out


def within(a: str, b: str, most: int) -> int | None:
    """The edit distance of a and b, or None if it is over most."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    if a == b:
        return 0
    most = min(most, len(a))  # no distance is over that
    # Bit w - 1 is the cell of row j + most in column j, counted from 0; the band slides down the diagonal.
    width = 2 * most + 1
    full, top = (1 << width) - 1, width - 1
    block = max(BLOCK, width)
    up, down = full ^ ((1 << (width - most - 1)) - 1), 0
    distance, first = most, most + 1 - width
    worst = most + len(b) - (len(a) - most)  # from there the distance cannot fall to most again
    last = len(a) - most
    for j, c in enumerate(b):
        if not j % block:  # the places that the band meets in these columns
            base = max(first, 0)
            where = places(a[base : first + block + width])
        at = where.get(c, 0)
        seen = (at >> first - base if first >= base else at << base - first) & full
        zero = ((((seen & up) + up) ^ up) | seen | down) & full
        plus, minus = down | (full ^ (zero | up)), zero & up
        if j < last:
            distance += not zero >> top
        else:
            edge = top - 1 - (j - last)
            distance += (plus >> edge & 1) - (minus >> edge & 1)
        if distance > worst:
            return None
        slid = zero >> 1
        up, down = minus | (full ^ (slid | plus)), slid & plus
        first += 1
    return distance if distance <= most else None


def common(a: Sequence, b: Sequence) -> int:
    """How many elements both begin with, by halving steps."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def whole(a: Sequence, b: Sequence) -> int:
    """The edit distance by columns of the whole matrix, as long as a."""
    where, bit = {}, 1
    for c in a:
        where[c] = where.get(c, 0) | bit
        bit <<= 1
    full, up, down = bit - 1, bit - 1, 0
    for c in b:
        seen = where.get(c, 0)
        zero = (((seen & up) + up) ^ up) | seen | down
        plus, minus = (down | (full ^ ((zero | up) & full))) << 1 | 1, (zero & up) << 1
        up, down = (minus | (full ^ ((zero | plus) & full))) & full, zero & plus & full
    return len(b) + up.bit_count() - down.bit_count()


def trimmed(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    """The longer and the shorter one without what both begin and end with."""
    if len(a) < len(b):
        a, b = b, a
    n = common(a, b)
    a, b = a[n:], b[n:]
    n = common(a[::-1], b[::-1])
    return a[: len(a) - n], b[: len(b) - n]


def edits(a: Sequence, b: Sequence) -> int:
    """The edit distance of two texts, or two lists of words."""
    a, b = trimmed(a, b)
    if not b:
        return len(a)
    if not isinstance(a, str) or len(a) <= WHOLE:
        return whole(a, b)
    most = max(FIRST, len(a) - len(b))
    while 2 * most < len(a):
        if (found := within(a, b, most)) is not None:
            return found
        most *= 4
    return whole(a, b)


def numbers(a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal elements."""
    if isinstance(a, str):
        return np.frombuffer(a.encode("utf-32-le"), np.uint32), np.frombuffer(b.encode("utf-32-le"), np.uint32)
    known: dict = {}
    return tuple(np.array([known.setdefault(w, len(known)) for w in x], np.uint32) for x in (a, b))


def together(pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Edit distances of many pairs (different elements of a, place in these of each of a, b), each by whole().

    All take a step at once, in words of 64 rows; a word is one column behind the word above it, whose last difference
    enters it. Ends of equal signs, which change no distance, make all b as long as the longest.
    """
    columns, count = max(len(b) for _, _, b in pairs), len(pairs)
    rows = np.array([len(which) + columns - len(b) for _, which, b in pairs])
    words, signs = -(-int(rows.max()) // 64), max(len(known) for known, _, _ in pairs)
    bits, codes = np.zeros((count, signs + 2, words * 64), np.uint8), np.full((columns, count), signs, np.intp)
    for p, (known, which, b) in enumerate(pairs):
        bits[p, which, np.arange(len(which))] = 1
        bits[p, signs, len(which) : rows[p]] = 1
        at = np.minimum(np.searchsorted(known, b), len(known) - 1)
        codes[: len(b), p] = np.where(known[at] == b, at, signs + 1)
    where = np.packbits(bits, axis=2, bitorder="little").view("<u8").transpose(2, 0, 1).ravel()
    begin = np.arange(words * count).reshape(words, count) * (signs + 2)
    one, last = np.uint64(1), np.uint64(63)
    up, down = np.full((words, count), ~np.uint64(0)), np.zeros((words, count), np.uint64)
    rise, fall = np.zeros((words + 1, count), np.uint64), np.zeros((words + 1, count), np.uint64)
    rise[0] = 1
    for step in range(columns + words - 1):
        low, high = max(0, step - columns + 1), min(words, step + 1)
        u, d, r, f = up[low:high], down[low:high], rise[low:high], fall[low:high]
        seen = where.take(begin[low:high] + codes[step - high + 1 : step - low + 1][::-1])
        either = seen | d
        seen |= f
        zero = (((seen & u) + u) ^ u) | seen
        plus, minus = d | ~(zero | u), u & zero
        out = plus >> last, minus >> last
        plus, minus = plus << one | r, minus << one | f
        u[:], d[:] = minus | ~(either | plus), plus & either
        rise[low + 1 : high + 1], fall[low + 1 : high + 1] = out
    inside = np.clip(rows - 64 * np.arange(words)[:, None], 0, 64).astype(np.uint64)
    mask = np.where(inside == 64, ~np.uint64(0), (one << (inside & last)) - one)
    return columns + (np.bitwise_count(up & mask).astype(np.int64) - np.bitwise_count(down & mask)).sum(0)


def all_edits(pairs: list[tuple[Sequence, Sequence] | None]) -> list[int | None]:
    """edits() of each pair; those of up to WHOLE elements of like length together."""
    out: list[int | None] = [None] * len(pairs)
    open_ = []
    for k, pair in enumerate(pairs):
        if pair is None:
            continue
        a, b = trimmed(*pair)
        if not b or len(a) > WHOLE:
            out[k] = edits(a, b)
        else:
            open_.append((len(a), k, a, b))
    open_.sort(key=lambda x: x[:2])
    begin = 0
    while begin < len(open_):
        some, at, most = [], [], 1
        for n, k, a, b in open_[begin:]:
            first, second = numbers(a, b)
            known, which = np.unique(first, return_inverse=True)
            most = max(most, (len(known) + 2) * (n + 64))
            if some and (len(some) + 1) * most > TOGETHER:
                break
            some.append((known, which, second))
            at.append(k)
        for k, found in zip(at, together(some).tolist(), strict=True):
            out[k] = found
        begin += len(some)
    return out


def pairs_of(left: pd.Series, right: pd.Series, form: Callable) -> list[tuple[Sequence, Sequence] | None]:
    """form() of both sides, or None for a pair with a null."""
    return [None if x is None or y is None else (form(x), form(y)) for x, y in zip(left, right, strict=True)]


def distance(a: Column, b: Column) -> Column:
    """Edit distance of two columns of texts, or of arrays of words; null for a null."""

    @F.pandas_udf("long")
    def measure(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(all_edits(pairs_of(left, right, lambda x: x if isinstance(x, str) else x.tolist())), dtype="Int64")

    return measure(a, b)


def error_rate(reference: Column, hypothesis: Column, form: Callable[[str], Sequence]) -> Column:
    """Edits of form(text), such as str.strip or str.split, over the length of that of the reference; null if it has none."""

    @F.pandas_udf("double")
    def measure(left: pd.Series, right: pd.Series) -> pd.Series:
        pairs = [p if p and p[0] else None for p in pairs_of(left, right, form)]
        return pd.Series([None if p is None else d / len(p[0]) for p, d in zip(pairs, all_edits(pairs), strict=True)], dtype="float64").astype("Float64")

    return measure(reference, hypothesis)


def distance_within(a: Column, b: Column, share: float) -> Column:
    """Edit distance of two columns of texts if it is at most that share of the longer text, else null; null for a null text."""

    @F.pandas_udf("long")
    def measure(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in pairs:
            known = [(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(left, right, strict=True)]
            yield pd.Series([within(*p, int(share * max(map(len, p)))) if p else None for p in known], dtype="Int64")

    return measure(a, b)
