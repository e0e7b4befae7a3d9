"""Fill-in-the-middle examples, in DataFrame functions only.

A text is cut after two of its units (white space with the word after it; white space at the end). No unit list is built:
a delimiter that the text cannot hold, since it is escaped first, goes after each unit; counting it counts the units, and
substring_index() takes the text before the k-th of them, or after it. The parts, without delimiters and with escapes
undone, are put together with markers between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit: white space and a word, or white space at the end of the text.
UNIT = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"
#: The delimiter, and the sign that begins an escape; both count as parts of words, and so do escapes.
CUT, ESCAPE = "\u0001", "\u0002"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def replaced(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escaped(text: Column) -> Column:
    """text without a delimiter; every escape sign is followed by one of two letters."""
    return replaced(replaced(text, ESCAPE, ESCAPE + "e"), CUT, ESCAPE + "d")


def unescaped(part: Column) -> Column:
    """The text that a part of an escaped text, with delimiters in it, stands for."""
    return replaced(replaced(replaced(part, CUT, ""), ESCAPE + "d", CUT), ESCAPE + "e", ESCAPE)


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four whole numbers below 2**32 that hang on the seed and the id alone; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, suffix_first: int = 80) -> DataFrame:
    """doc_id, text, n (units), form, prefix, middle, suffix, output of every row of docs(doc_id, text, ...).

    percent of the texts are cut, the others have the form plain and null parts; of those cut, suffix_first percent have the
    form spm (suffix, prefix, middle), the others psm. A null text counts as empty; an empty text, and one that holds a
    marker, is plain. Cuts hang on doc_id alone: repeated rows, and rows without an id, draw alike. Other columns are
    ignored. A text that is one unit has cuts before or after it only, so parts may be empty.
    """
    rows = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(seed, F.col("doc_id"))
    rows = rows.withColumn("marked", F.regexp_replace(escaped(F.col("text")), UNIT, "$0" + CUT))
    rows = rows.withColumn("n", (F.octet_length("marked") - F.octet_length(replaced(F.col("marked"), CUT, ""))).cast("long"))
    held = F.col("text") == ""
    for marker in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains(F.col("text"), F.lit(marker))
    form = F.when(held | (h3 % 100 >= percent), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "n", "marked", form.alias("form"), F.least(a, b).cast("int").alias("lo"), F.greatest(a, b).cast("int").alias("hi"))
    cut = F.col("form") != "plain"
    rows = rows.withColumn("head", F.when(cut, beside("marked", F.col("hi"))))
    middle = F.when(F.col("hi") > F.col("lo"), beside("head", F.col("lo") - F.col("hi"))).otherwise("")
    # The delimiter at the end of the text is the first from the right.
    suffix = beside("marked", F.col("hi") - F.col("n").cast("int") - 1)
    parts = {"prefix": beside("marked", F.col("lo")), "middle": middle, "suffix": suffix}
    rows = rows.select("doc_id", "text", "n", "form", *(F.when(cut, unescaped(x)).alias(name) for name, x in parts.items()))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("*", output.alias("output"))


def beside(column: str, count: Column) -> Column:
    """What stands before the count-th delimiter of a column, or after it if count is negative and counts from the right."""
    return F.call_function("substring_index", F.col(column), F.lit(CUT), count)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made from: markers are in it once, since no text that holds one is cut."""

    def split(text: Column, marker: str) -> tuple[Column, Column]:
        at = F.position(F.lit(marker), text)
        return F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(marker), F.length(text))

    def joined(first: str, second: str, suffix_first: bool) -> Column:
        body = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one, rest = split(body, second)
        two, middle = split(rest, MIDDLE)
        return F.concat(two, middle, one) if suffix_first else F.concat(one, middle, two)

    return F.when(form == "psm", joined(PREFIX, SUFFIX, False)).when(form == "spm", joined(SUFFIX, PREFIX, True)).otherwise(output)


def example_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row of docs."""
    rows = fill_in_middle(docs)
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, CASE WHEN text = '' THEN [] ELSE regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') END AS units,
  CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:lo], '') AS prefix, array_to_string(units[lo + 1:hi], '') AS middle, array_to_string(units[hi + 1:n], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
