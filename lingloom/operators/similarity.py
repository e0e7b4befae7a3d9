"""Joins of texts within a small edit distance.

A plain edit-distance predicate compares all pairs. Instead, each reference text is cut into k + 1 pieces; k edits leave
at least one of them whole, so it stands in the other text near its place. Pieces and the possible substrings, as 64-bit
hashes of (keys, length, piece number, piece), meet in an equi-join of hashes and text numbers only; texts come back for
the pairs that are left, and those are measured. Nothing is lost, and what meets by chance is measured too.

A piece that more than HOT reference texts have is hot, and does not meet alone. Beside it, what is left of the text is cut
into k + 1 pieces again, and k edits leave one of these whole as well: the two together are the key. So texts that share a
common beginning, say, meet only if they share something else near its place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingloom.functions.text import near_distance
from lingloom.sources.tables import Steps

#: Reference texts that may share a piece before it needs a second one beside it.
HOT = 64


def bounds(k: int, i: str = "i") -> tuple[str, str]:
    """Where piece i of a text of length n begins and ends."""
    return f"cast({i} * n div {k + 1} as int)", f"cast(({i} + 1) * n div {k + 1} as int)"


def hash_of(keys: list[str], piece: str) -> str:
    return f"xxhash64({', '.join([*(f'`{c}`' for c in keys), 'n'])}, {piece})"


def piece_hashes(keys: list[str], k: int) -> Column:
    """The hashes of the k + 1 pieces of column b; a text shorter than that is one piece without content."""
    begin, end = bounds(k)
    piece = hash_of(keys, f"i, substring(b, {begin} + 1, {end} - {begin})")
    return F.expr(f"if(n > {k}, transform(sequence(0, {k}), i -> {piece}), array({hash_of(keys, '-1, ' + repr(''))}))")


def probes(keys: list[str], k: int, places: bool = False) -> Column:
    """The hashes that a piece within k edits of column a may have, for all lengths of its text; with places, structs (n, i, s,
    piece) of these: length, number and shift of the piece.

    Of piece i, at most i edits stand before it and k - i after it: so far it can have moved.
    """
    begin, end = bounds(k)
    low, high = f"greatest(-i, (m - n) - ({k} - i), -{begin})", f"least(i, (m - n) + ({k} - i), m - {end})"
    piece = hash_of(keys, f"i, substring(a, {begin} + s + 1, {end} - {begin})")
    value = f"named_struct('n', n, 'i', i, 's', s, 'piece', {piece})" if places else piece
    none = "cast(array() as array<int>)"
    shifts = f"transform(if({low} <= {high}, sequence({low}, {high}), {none}), s -> {value})"
    short = hash_of(keys, "-1, ''")
    short = "array()" if places else f"array({short})"
    of_length = f"if(n > {k}, flatten(transform(sequence(0, {k}), i -> {shifts})), {short})"
    return F.expr(f"array_distinct(flatten(transform(sequence(greatest(m - {k}, 0), m + {k}), n -> {of_length})))")


def others(k: int) -> str:
    """Structs (p, q) of the k + 1 pieces that the rest of a text has beside its piece i: the others, one of them in halves."""
    first = "if(i = 0, 1, 0)"
    begin, end = bounds(k, first)
    middle = f"(({begin} + {end}) div 2)"
    struct = lambda p, q: f"named_struct('p', cast({p} as int), 'q', cast({q} as int))"
    b, e = bounds(k, "j")
    rest = f"transform(filter(sequence(0, {k}), j -> j <> i and j <> {first}), j -> {struct(b, e)})"
    return f"concat(array({struct(begin, middle)}, {struct(middle, end)}), {rest})"


def second_pieces(k: int) -> Column:
    """Of a reference text b with a hot piece i: its hash with that of each other piece."""
    return F.expr(f"transform({others(k)}, x -> xxhash64(piece, x.p, x.q, substring(b, x.p + 1, x.q - x.p)))")


def second_probes(k: int) -> Column:
    """Of a text a that has a hot piece i of texts of length n at shift s: what its other pieces may be.

    Shifts begin at 0 and end at m - n, and each edit changes one by 1: so far another piece can have moved, with s known.
    """
    before, after = f"abs(t) + abs(s - t) + abs(m - n - s) <= {k}", f"abs(s) + abs(t - s) + abs(m - n - t) <= {k}"
    fits = f"x.p + t >= 0 and x.q + t <= m and if(x.p < {bounds(k)[0]}, {before}, {after})"
    shifted = f"transform(filter(sequence(-{k}, {k}), t -> {fits}), t -> xxhash64(piece, x.p, x.q, substring(a, x.p + t + 1, x.q - x.p)))"
    return F.expr(f"array_distinct(flatten(transform({others(k)}, x -> {shifted})))")


def meetings(a: DataFrame, b: DataFrame, k: int, keys: list[str], steps: Steps, hot: int = HOT) -> DataFrame:
    """piece, a_id, b_id: all that meet, of stored texts a(keys, a, a_id) and b(keys, b, b_id); a pair may meet several times.

    No text meets more than hot reference texts by one piece, but for texts of up to k characters and pairs that share two
    hot pieces: these meet by both.
    """
    a, b = a.withColumn("m", F.length("a")), b.withColumn("n", F.length("b"))
    pieces = b.select("b_id", "n", F.posexplode(piece_hashes(keys, k)).alias("i", "piece"))
    found = a.select("a_id", F.explode(probes(keys, k)).alias("piece"))
    alone = found.join(pieces, "piece").select("piece", "a_id", "b_id")
    if not k:
        return alone
    common = pieces.where(f"n > {k}").groupBy("piece").agg(F.count(F.lit(1)).alias("many")).where(f"many > {hot}").select("piece")
    common = steps.keep(common, f"common-{uuid.uuid4().hex[:8]}")
    if common.isEmpty():
        return alone
    alone = found.join(pieces.join(common, "piece", "left_anti"), "piece").select("piece", "a_id", "b_id")
    known = pieces.join(common, "piece", "left_semi").join(b.select("b_id", "b"), "b_id")
    wanted = found.join(common, "piece", "left_semi").select("a_id").distinct()
    tried = a.join(wanted, "a_id", "left_semi").select("a_id", "a", "m", F.explode(probes(keys, k, places=True)).alias("x"))
    tried = tried.select("a_id", "a", "m", "x.*").join(common, "piece", "left_semi")
    left = tried.select("a_id", F.explode(second_probes(k)).alias("piece")).distinct()
    right = known.select("b_id", F.explode(second_pieces(k)).alias("piece"))
    return alone.unionByName(left.join(right, "piece").select("piece", "a_id", "b_id"))


def within_distance(left: DataFrame, right: DataFrame, k: int = 3, keys: list[str] | None = None, hot: int = HOT, steps: Steps | None = None) -> DataFrame:
    """keys, a, b, distance: different texts left.text and right.text of equal keys at most k edits apart.

    Both sides have a column text (and the keys). Equal rows count once; null texts and null keys match nothing. Each side is
    read once: its different texts go to a table of the steps, which the pieces and the pairs are made from.
    """
    keys, steps = keys or [], steps or Steps(left.sparkSession)
    given = [F.col(c).isNotNull() for c in keys]
    texts, number = {}, uuid.uuid4().hex[:8]
    for side, frame in (("a", left), ("b", right)):
        rows = frame.select(*keys, F.col("text").alias(side)).where(F.col(side).isNotNull())
        for known in given:
            rows = rows.where(known)
        texts[side] = steps.keep(rows.distinct().withColumn(f"{side}_id", F.xxhash64(*keys, side)), f"texts-{side}-{number}")
    pairs = meetings(texts["a"], texts["b"], k, keys, steps, hot).select("a_id", "b_id").distinct()
    # A number that two texts share brings both back; keys and distance are of the texts themselves.
    found = pairs.join(texts["a"], "a_id").join(texts["b"].select("b_id", "b", *(F.col(c).alias(f"{c}_b") for c in keys)), "b_id")
    for c in keys:
        found = found.where(F.col(c) == F.col(f"{c}_b"))
    return found.select(*keys, "a", "b", near_distance(F.col("a"), F.col("b"), k).alias("distance")).where("distance >= 0")


def nearest(left: DataFrame, right: DataFrame, k: int = 3, keys: list[str] | None = None, order: str = "ord", steps: Steps | None = None) -> DataFrame:
    """keys, a, b, distance: for each left text the nearest right text within k edits; ties go to the smallest right.order, then text."""
    keys = keys or []
    first = right.groupBy(*keys, F.col("text").alias("b")).agg(F.min(order).alias("ord_"))
    found = within_distance(left, right, k, keys, steps=steps).join(first, [*keys, "b"])
    rank = Window.partitionBy(*keys, "a").orderBy("distance", "ord_", "b")
    return found.withColumn("rank_", F.row_number().over(rank)).where("rank_ = 1").select(*keys, "a", "b", "distance")
