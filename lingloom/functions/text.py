"""Text as columns: normalising, edit distances, error rates, parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lingloom.functions.bounded import distance, error_rate

#: ASCII punctuation that Unicode does not class as punctuation, and Unicode's punctuation.
PUNCTUATION = r"[\p{P}$+<=>^`|~]"
#: Everything that Unicode or Python takes for white space, as Java's classes name it; str.strip and str.split take the same.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def remove_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION, "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def collapse_spaces(text: Column) -> Column:
    """Without white space at the ends, and every run of it as one blank."""
    return F.regexp_replace(strip(text), f"{WHITE}+", " ")


def normalise(text: Column) -> Column:
    """Spaces first, then punctuation: blanks around a removed sign stay, so two may stand together."""
    return remove_punctuation(collapse_spaces(text))


def fold(text: Column) -> Column:
    """Every character beyond printable ASCII as a question mark."""
    return F.regexp_replace(text, "[^ -~]", "?")


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters both texts begin with, by halving steps: each compares two beginnings as a whole."""
    most = F.least(F.length(a), F.length(b))
    powers = F.sequence(F.floor(F.log2(F.greatest(most, F.lit(1)).cast("double"))).cast("int"), F.lit(0), F.lit(-1))

    def longer(known: Column, power: Column) -> Column:
        tried = (known + F.pow(F.lit(2), power)).cast("int")
        return F.when((tried <= most) & (F.substring(a, F.lit(1), tried) == F.substring(b, F.lit(1), tried)), tried).otherwise(known)

    return F.aggregate(powers, F.lit(0), longer)


def near_distance(a: Column, b: Column, k: int) -> Column:
    """Edit distance if it is at most k, else -1. What both texts begin and end with does not count, so of long texts that are
    near each other little is left to be measured: the built-in distance takes the square of what it is given."""

    def without_prefix(p: Column) -> Column:
        n = common_prefix(p["a"], p["b"])
        rest = lambda x: F.substring(x, n + 1, F.length(x))
        return F.struct(F.reverse(rest(p["a"])).alias("a"), F.reverse(rest(p["b"])).alias("b"))

    def measured(p: Column) -> Column:
        return let(without_prefix(p), lambda q: F.levenshtein(q["a"], q["b"], k))

    ends = let(F.struct(a.alias("a"), b.alias("b")), without_prefix)
    return F.when(F.abs(F.length(a) - F.length(b)) > k, F.lit(-1)).otherwise(let(ends, measured))


def normalised_distance(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; null for two empty texts."""
    return F.try_divide(distance(a, b).cast("double"), F.greatest(F.length(a), F.length(b)).cast("double"))


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits over the characters of the reference, both stripped; can exceed 1; null for an empty reference."""
    return error_rate(reference, hypothesis, str.strip)


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(collapse_spaces(text), " "), lambda w: w != "")


def let(value: Column, use) -> Column:
    """use(x) with x standing for the value, which is worked out once however often and wherever use() names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words."""
    return distance(a, b)


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Word edits over the words of the reference; null for a reference without words."""
    return error_rate(reference, hypothesis, str.split)


def speaker_number(text: Column) -> Column:
    """The digits of a speaker name as one number; -1 if it has none."""
    return F.coalesce(F.regexp_replace(text, "[^0-9]", "").try_cast("bigint"), F.lit(-1).cast("bigint"))


def class_code(names: list[str], value: Column) -> Column:
    """Position of the value in a list of names, from 0; null if it is none of them."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), value), F.lit(0)) - 1


def class_code_strict(names: list[str], value: Column) -> Column:
    """As class_code(); a value that is none of the names raises."""
    code = class_code(names, value)
    return F.when(value.isNotNull() & code.isNull(), F.raise_error(F.concat(F.lit("no such class: "), value)).cast("bigint")).otherwise(code)


def joined_in_order(parts: Column) -> Column:
    """Texts of an array of (order, text) structs, in order, with blanks between."""
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), " ")


def media_path(prefix: Column, split: Column, filename: Column) -> Column:
    return F.concat_ws("/", prefix, split, filename)


# Loudness of sampled sound, over an array of samples.


def root_mean_square(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return F.sqrt(F.try_divide(total, F.size(samples).cast("double")))


def decibels(rms: Column) -> Column:
    return 20 * F.log10(rms + 1e-9)


def gain_to(level: float, db: Column) -> Column:
    """The factor that brings a sound of that loudness to the level in decibels."""
    return F.pow(F.lit(10.0), (F.lit(level) - db) / 20)


def interval_sum(intervals: Column) -> Column:
    """Total length of an array of (start, end) structs."""
    return F.aggregate(intervals, F.lit(0.0), lambda acc, x: acc + x["end"].cast("double") - x["start"].cast("double"))


def mostly_silent(speech: Column, total: Column, silence: float = 0.95) -> Column:
    """Whether speech is under 1 - silence of the total; null if the total is 0."""
    return F.try_divide(speech, total) < 1 - silence


def duration_class(seconds: Column, limit: float = 30.0) -> Column:
    return F.when(seconds < limit, "short").otherwise("long")
