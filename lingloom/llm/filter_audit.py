"""How filters interact: what each removes, alone and after others, in every order, as an incidence matrix product.

A document is one of 32 masks of failed filters. Counts of masks are rows of 32 numbers: of each part all documents, those
labelled good and those labelled toxic. What happens to a mask at each step of each order is a column of an integer matrix
of 32 by 600 (120 orders of five steps), one matrix for each outcome. Their product has all counts of all orders; the
corpus is read once, and no order is run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: The filter that needs the whole table: copies of a text with a smaller doc_id.
COPIES = "E"
SPACE = "[\\x20\\x09-\\x0D]+"
#: Parts whose histograms are stacked for one product.
PARTS = 64
LABELS = ("docs", "good", "toxic")
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{x} bigint" for x in OUTCOMES)


@lru_cache(1)
def steps() -> list[tuple[str, int]]:
    """(order, step from 1), by order and step: the columns of the matrices."""
    return [("".join(order), k + 1) for order in permutations(FILTERS) for k in range(len(FILTERS))]


@lru_cache(1)
def matrices() -> dict[str, np.ndarray]:
    """Outcome matrices, 32 by 600: whether documents of a mask have that outcome at a step; for shapley, in how many orders
    the filter of the step removes them, at any step."""
    masks = np.arange(1 << len(FILTERS))
    fails = {f: (masks >> k & 1).astype(bool) for k, f in enumerate(FILTERS)}
    columns: dict[str, list[np.ndarray]] = {x: [] for x in ("kept", "removed", "redundant", "unique_fails")}
    for order, step in steps():
        own = order[step - 1]
        gone = np.any([fails[f] for f in order[: step - 1]], axis=0) if step > 1 else np.zeros(len(masks), bool)
        columns["kept"].append(~gone & ~fails[own])
        columns["removed"].append(~gone & fails[own])
        columns["redundant"].append(gone & fails[own])
        columns["unique_fails"].append(masks == 1 << FILTERS.index(own))
    out = {x: np.stack(c, 1).astype(np.int64) for x, c in columns.items()}
    filter_of = np.array([FILTERS.index(order[step - 1]) for order, step in steps()])
    total = np.stack([out["removed"][:, filter_of == k].sum(1) for k in range(len(FILTERS))], 1)
    return out | {"shapley": total[:, filter_of]}


def row_filters(text: Column, words: Column) -> dict[str, Column]:
    """Whether a text fails each filter that needs the text alone."""
    number = F.size(words)
    return {
        "A": number < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * number,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masked_rows(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, mask (without the filter of copies) of every row."""
    rows = docs.select("doc_id", F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    mask = F.lit(0)
    for name, fails in row_filters(F.col("text"), F.col("words")).items():
        mask = mask + fails.cast("int") * (1 << FILTERS.index(name))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, docs, good, toxic: counts of documents by mask of failed filters; up to 32 rows a part.

    Of equal texts (by SHA-256) all rows but those of the smallest doc_id fail the filter of copies. They are counted, not
    joined: rows meet their labels by doc_id, are added up by text and part before they are shuffled by text, so a text that
    very many rows share is a few rows there.
    """
    flag = lambda c: F.max((F.col(c) == 1).cast("int"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    # Rows without an id have no label; they are dealt by the task that read them, not to one task.
    rows = masked_rows(docs).withColumn("deal", F.when(F.col("doc_id").isNull(), F.spark_partition_id()).otherwise(-1))
    rows = rows.join(known.withColumn("deal", F.lit(-1)), ["doc_id", "deal"], "left").fillna(0, ["good", "toxic"])
    key = ["digest", "part", "mask", "good", "toxic"]
    rows = rows.groupBy("doc_id", "deal", *key).agg(F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    rows = rows.groupBy(*key).agg(F.sum("n").alias("n"), F.min(named).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    stays = F.col("unnamed") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    rows = rows.select(*key[1:], "n", stays.alias("stays"))
    copy = 1 << FILTERS.index(COPIES)
    both = F.array(F.struct(F.col("mask"), F.col("stays").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("stays")).alias("n")))
    rows = rows.select("part", "good", "toxic", F.explode(both).alias("r")).select("part", "r.mask", "r.n", "good", "toxic")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each
    different docs.source (null: the empty string).

    docs has doc_id, text, source, labels has doc_id, quality, toxic; other columns are ignored. A null text counts as
    empty: it fails A, and E after the first one. Repeated rows are documents of their own; of equal texts, all rows with
    the smallest doc_id pass E. Rows without a doc_id always pass E, make no other row fail it, and have no label. A
    document with several labels is good or toxic if one says so. An empty table gives an empty result.
    """
    counts = histograms(docs, labels)
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *LABELS)).alias("masks"))  # at most 32 entries

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outcome, places = matrices(), steps()
        orders, numbers = [o for o, _ in places], np.array([s for _, s in places], np.int32)
        for batch in batches:
            for some in (batch.slice(lo, PARTS) for lo in range(0, len(batch), PARTS)):
                parts = some.column("part").to_pylist()
                h = np.zeros((len(LABELS), len(parts), 1 << len(FILTERS)), np.int64)
                for k, masks in enumerate(some.column("masks").to_pylist()):
                    for m in masks:
                        h[:, k, m["mask"]] = [m[x] for x in LABELS]
                every, good, toxic = h
                done = {x: every @ matrix for x, matrix in outcome.items()} | {"good_lost": good @ outcome["removed"], "toxic_lost": toxic @ outcome["removed"]}
                arrays = [pa.array(np.repeat(np.array(parts, object), len(places)), pa.string()), pa.array(orders * len(parts)), pa.array(np.tile(numbers, len(parts)))]
                arrays += [pa.array(done[x].ravel()) for x in OUTCOMES]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "filter_order", "step", *OUTCOMES])

    return rows.mapInArrow(product, AUDIT)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, doc_id > min(doc_id) OVER (PARTITION BY text) AS copied FROM d),
f AS (SELECT doc_id, part,
  CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
  + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INT)
  + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(copied, false) AS INT) AS mask FROM w),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
h AS (SELECT part, mask, count(*) AS docs, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(c, bit)),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit,
  sum(CASE WHEN mask & CAST(earlier + bit AS INT) = 0 THEN docs ELSE 0 END) AS kept,
  sum(CASE WHEN mask & CAST(earlier AS INT) = 0 AND mask & bit > 0 THEN docs ELSE 0 END) AS removed,
  sum(CASE WHEN mask & CAST(earlier AS INT) > 0 AND mask & bit > 0 THEN docs ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN docs ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & CAST(earlier AS INT) = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & CAST(earlier AS INT) = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM h, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
