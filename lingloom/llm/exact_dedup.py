"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame functions only.

Every row is dealt to one of R runs by a hash of its id. A run lies in segments, each a range of digests in one partition,
sorted by digest; of equal digests there the best row and the number of copies stay. In each round, runs whose numbers
differ in the lowest log2(fan_in) bits only, that is in as many binomial rounds, exchange: they send their segments to the
partitions of the run that takes their place. There the sorted pieces that arrive are merged (the sort finds the runs that
it is given and merges them, several ways at once), and of equal entries the smallest stays. At last one run is left,
which lies over all partitions by its segments. Then the winners go down again: root entries meet the entries of the first
runs (at most R of a digest), and those meet the rows of their run. So a text that a third of all rows share is spread
over R runs on the way up and on the way down.

A digest is verified at every level by the length and a second, independent hash of the text: entries that differ in
either never merge.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingloom.llm.scratch import stored

SPACE = "[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def digests(docs: DataFrame, runs: int, segments: int) -> DataFrame:
    """doc_id, run, segment, digest, verify, n_chars (code points of the original text) of every row."""
    texts = docs.select("doc_id", "text", normalised(docs["text"]).alias("norm_"))  # each text is normalised once
    docs = texts.select("*", F.sha2("norm_", 256).alias("sha_"))
    norm, leading = F.col("norm_"), F.conv(F.substring("sha_", 1, 4), 16, 10).cast("int")
    return docs.select(
        F.col("doc_id"),
        F.pmod(F.xxhash64(F.lit(17), F.col("doc_id")), F.lit(runs)).cast("int").alias("run"),
        F.floor(leading * segments / 65536).cast("int").alias("segment"),
        F.unhex("sha_").alias("digest"),
        F.struct(F.octet_length(norm).alias("bytes"), F.xxhash64(norm).alias("hash")).alias("verify"),
        F.length(F.coalesce(F.col("text"), F.lit(""))).alias("n_chars"),
    )


def merged(entries: DataFrame, tasks: int) -> DataFrame:
    """Entries (run, segment, digest, verify, best, size), brought together by run and segment: sorted by digest, each once."""
    there = entries.repartition(tasks, "run", "segment")
    return there.groupBy("run", "segment", "digest", "verify").agg(F.min("best").alias("best"), F.sum("size").alias("size"))


def exact_dedup(docs: DataFrame, runs: int | None = None, fan_in: int = 4) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text, ...).

    Texts are equal if they are identical without white space (space, tab to carriage return). Of equal texts, the
    row with the most code points and then the smallest doc_id stays. A null text counts as empty, so all nulls and
    blanks are one group; a null doc_id loses every tie and is reported with a null doc_id. Repeated rows with one
    doc_id are rows of their own in group_size, and nothing here tells them apart: all of them are reported as kept if
    one is (unique_rows() keeps one). Other columns are ignored. An empty table gives an empty result. runs: a power of
    two, by default that at or over spark.sql.shuffle.partitions and 16, so that it follows the cluster.
    """
    if fan_in < 2 or fan_in & (fan_in - 1):
        raise ValueError("fan_in must be a power of two")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs or 1 << max(4, math.ceil(math.log2(tasks)))
    key = ["digest", "verify"]
    rows = stored(digests(docs, runs, 4 * tasks), "digests")
    rank = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    first = run = merged(rows.select("run", "segment", *key, rank.alias("best"), F.lit(1).cast("long").alias("size")), tasks)
    left = runs
    while left > 1:
        step = min(fan_in, left)
        run = merged(run.withColumn("run", F.floor(F.col("run") / step).cast("int")), tasks)
        left = math.ceil(left / step)
    root = run.select(*key, F.col("best.id").alias("keep_id"), F.col("size").alias("group_size"))
    down = first.select("run", *key).join(root, key)
    return rows.join(down, ["run", *key]).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def unique_rows(docs: DataFrame, runs: int | None = None, fan_in: int = 4) -> DataFrame:
    """One row of docs for each different text, with all its columns: the row that exact_dedup() keeps.

    Where several rows share its doc_id (or have none), the longest text stays, and of these the first by all columns as
    JSON. Cases as in exact_dedup().
    """
    found = exact_dedup(docs, runs, fan_in).groupBy("doc_id", "text_sha256").agg(F.bool_and("kept").alias("kept_"), F.count(F.lit(1)).alias("rows_"))
    odd = stored(found.where("NOT kept_ OR rows_ > 1").select(F.col("doc_id").alias("id_"), F.col("text_sha256").alias("hash_"), "kept_"), "odd")
    hash_ = F.sha2(normalised(docs["text"]), 256)
    only = docs.join(odd, docs["doc_id"].eqNullSafe(odd["id_"]) & (hash_ == odd["hash_"]), "left_anti")
    several = odd.where("kept_")
    if several.isEmpty():
        return only
    whole = F.struct(*(docs[f"`{c.replace('`', '``')}`"] for c in docs.columns))
    order = F.struct(-F.length(F.coalesce(docs["text"], F.lit(""))), F.to_json(whole))
    rows = docs.select(docs["doc_id"].alias("id_"), hash_.alias("hash_"), whole.alias("row_"), order.alias("order_"))
    rows = rows.join(several, rows["id_"].eqNullSafe(several["id_"]) & (rows["hash_"] == several["hash_"]), "left_semi")
    return only.unionByName(rows.groupBy("id_", "hash_").agg(F.min_by("row_", "order_").alias("row_")).select("row_.*"))


SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents),
r AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r
"""
