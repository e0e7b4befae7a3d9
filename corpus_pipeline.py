"""From documents to a training mix, in five stages; each is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lingloom.llm import decontaminate, exact_dedup, jaccard_join, mixing, quality
from lingloom.llm.scratch import dropped, stored

#: Shares of the tokens of the mix. Poor documents are gone by then.
TARGETS = {"clean": 0.95, "toxic": 0.05}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null text is scored as an empty one; null ids and repeated rows are scored like others."""
    return quality.accepted(docs, read(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the longest original with the smallest doc_id stays: one row, also where rows are repeated or have no id.
    Null texts are equal to empty ones."""
    return exact_dedup.unique_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar shingles connect, that with the smallest doc_id stays. Texts without words and rows
    without an id stay; rows that share the smallest id stay together."""
    return jaccard_join.representatives(docs)


def benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a test item go; null and empty texts overlap none."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix holds each document (doc_id, source, n_tokens, posteriors, rate, copies); those that it leaves out go.
    Texts without words have no tokens and the posteriors of a text without features."""
    labelled = read(spark, sf_dir, "labels").select("doc_id", mixing.label_domain().alias("domain"))
    return mixing.mixed_rates(docs, labelled, TARGETS).where("copies > 0")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark_overlaps),
    ("mixing_to_target_weights", mixing_weights),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; of a stage's table nothing is left when the next one is written."""
    kept = None
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            before, docs = kept, stored(docs, name)
            kept = docs
            if before is not None:
                dropped(before)  # the stage that read it is written
    return docs


#: The learned stages have no SQL; tests hold the second to the fourth stage against plain Python, and the others against their scores and targets.
ORACLE_SQL = None
