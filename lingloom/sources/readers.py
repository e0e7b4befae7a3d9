"""Readers with fixed schemas. Facts that lie in paths (split, model, task, language) become columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingloom.functions.text import speaker_number, strip

RECORDING_FIELDS = 8
MODELS = ("whisper", "seamlessm4t", "mms")


def stem(path: str = "_metadata.file_name"):
    return F.regexp_extract(F.col(path), r"([^/]+?)(\.[^./]*)?$", 1)


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tab-separated files, one for each split; a line of other than eight fields, or a bad number, raises."""
    lines = spark.read.text(path).select(F.split(strip(F.col("value")), "\t").alias("f"), stem().alias("split"))
    checked = F.when(F.size("f") == RECORDING_FIELDS, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("a recording has other than eight fields: "), F.array_join("f", "|"))))
    lines = lines.select(checked.alias("f"), "split")
    return lines.select(
        F.col("f")[0].cast("int").alias("fleurs_id"),
        F.col("f")[1].alias("filename"),
        F.col("f")[2].alias("raw_transcription"),
        F.col("f")[3].alias("transcription"),
        F.col("f")[5].cast("int").alias("num_samples"),
        speaker_number(F.col("f")[6]).alias("speaker_id"),
        F.col("f")[7].alias("gender"),
        "split",
    )


def read_voice_activity(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("filename string, is_silent boolean").csv(path, sep="\t")


def read_hypotheses(spark: SparkSession, root: str) -> DataFrame:
    """lang, model, task, split, filename, text of all {model}/{task}/{lang}/{split}.jsonl below root, in long form.

    {split}.jsonl is a file or a folder of files; a folder may also be named split={split}, as transcribe_splits() writes it.
    """
    fields = [f"{m}_asr{t}" for m in MODELS for t in ("", "_translation")]
    rows = spark.read.schema("filename string, " + ", ".join(f"{f} string" for f in fields)).json(f"{root}/*/*/*/{{*.jsonl,split=*}}")
    number = sum(F.col(f).isNotNull().cast("int") for f in fields)
    two = (number <= 1) & F.col("filename").isNotNull()  # an empty result leaves no text
    rows = rows.where(F.when(two, True).otherwise(F.raise_error(F.lit("a line of hypotheses has other than a file name and one text")).cast("boolean")))
    place = r"([^/]+)/([^/]+)/([^/]+)/(?:split=([^/]+)/[^/]+|([^/]+)\.jsonl(?:/[^/]+)?)$"
    part = lambda k: F.regexp_extract("_metadata.file_path", place, k)
    split = F.coalesce(F.nullif(part(4), F.lit("")), part(5))
    return rows.select(part(3).alias("lang"), part(1).alias("model"), part(2).alias("task"), split.alias("split"), "filename", strip(F.coalesce(*fields)).alias("text"))


def read_union(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet tables one after the other, by column names."""
    out = spark.read.parquet(paths[0])
    for path in paths[1:]:
        out = out.unionByName(spark.read.parquet(path))
    return out


def spread(frame: DataFrame) -> DataFrame:
    """frame over all cores, if its scan has fewer tasks than that; a larger table is left as it is."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def read_completed(spark: SparkSession, path: str) -> DataFrame:
    """A log of finished work: lang, split, and the number where the line has one. Lines have two tab-separated fields at least,
    whatever follows; others raise. White space around a line, and empty lines, do not count."""
    f = F.split(strip(F.col("value")), "\t")
    lines = spark.read.text(path).where(strip(F.col("value")) != "").select(F.when(F.size(f) >= 2, f).otherwise(F.raise_error(F.concat(F.lit("a log line has no two fields: "), F.col("value")))).alias("f"))
    return lines.select(F.col("f")[0].alias("lang"), F.col("f")[1].alias("split"), F.get("f", F.lit(2)).try_cast("bigint").alias("n"))


def read_by_stem(spark: SparkSession, folder: str, key: str = "lang") -> DataFrame:
    """The Parquet files right below a folder, one for each value of the key, which is the name of the file.

    Files may lack columns that others have; those are null.
    """
    return spark.read.option("mergeSchema", "true").option("pathGlobFilter", "*.parquet").parquet(folder).withColumn(key, stem())


def remaining(work: DataFrame, completed: DataFrame, keys: list[str]) -> DataFrame:
    """Work that the log doesn't have."""
    return work.join(completed.select(*keys).distinct(), keys, "left_anti").select(*work.columns)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """idx, id from a JSON object of ids by index."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>"))).select(F.col("key").cast("int").alias("idx"), F.col("value").cast("int").alias("id"))


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    """The dimension of languages: one code for each corpus and model, and which sets hold the language."""
    return spark.read.csv(path, header=True, schema="fleurs_code string, flores_code string, whisper_code string, mms_code string, seamless_code string, in_belebele boolean, in_sib boolean")


def with_code(frame: DataFrame, languages: DataFrame, key: str, code: str) -> DataFrame:
    """frame with the code of its language; an unmapped language raises. A dimension of a few hundred rows is broadcast."""
    if (n := languages.count()) > 100_000:
        raise ValueError(f"a dimension of {n} languages is too large to broadcast")
    names = languages.select(F.col("fleurs_code").alias(key), F.col(code).alias("code_"))
    value = F.when(F.col("code_").isNull(), F.raise_error(F.concat(F.lit("no code for language "), F.col(key)))).otherwise(F.col("code_"))
    return frame.join(F.broadcast(names), key, "left").withColumn(code, value).drop("code_")
