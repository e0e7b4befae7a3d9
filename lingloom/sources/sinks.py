"""Writers: tables by language, small reports, silence logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lingloom.sources.readers import remaining
from lingloom.sources.tables import steps


def write_by(frame: DataFrame, path: str, *keys: str) -> None:
    """Parquet in folders by keys; only the folders that frame has rows for are replaced."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_report(frame: DataFrame, path: str, sep: str = ",") -> None:
    """One file with a header. For reports of a row a language, not for data."""
    frame.coalesce(1).write.mode("overwrite").csv(path, header=True, sep=sep)


def write_json_lines(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def silence_counts(activity: DataFrame, *keys: str) -> DataFrame:
    """keys, silent, total."""
    return activity.groupBy(*keys).agg(F.count_if("is_silent").alias("silent"), F.count(F.lit(1)).alias("total"))


def write_silence(activity: DataFrame, folder: str) -> None:
    """A headerless log (filename, True or False) for each language and split, and the counts of all of them."""
    log = activity.select("lang", "split", "filename", F.initcap(F.col("is_silent").cast("string")).alias("is_silent"))
    log.write.mode("overwrite").partitionBy("lang", "split").csv(f"{folder}/files", sep="\t")
    write_report(silence_counts(activity, "lang", "split"), f"{folder}/counts", sep="\t")


#: Columns that are published as whole numbers of 32 bits.
WHOLE = ("id", "has_image", "has_hyperlink", "fleurs_id")
GROUP = ["lang", "split"]
STATUS = "lang string, split string, n long, error string"


def misfit(whole: list[str]) -> Column:
    """The names of the columns for which a row cannot be published: no name, or a whole number of over 32 bits; else null."""
    no_name = [F.when(F.col(c).isNull(), c) for c in GROUP]
    too_large = [F.when(F.col(c).isNotNull() & F.col(c).try_cast("int").isNull(), c) for c in whole]
    return F.nullif(F.concat_ws(", ", *no_name, *too_large), F.lit(""))


def published(frame: DataFrame, path: str, keep_split: bool = False) -> DataFrame:
    """Publishes frame(lang, split, ...) by language and split, but for those already there, and returns the status(lang,
    split, n, error) of this run: what was written, or the error of a language and split that failed.

    full_paragraph goes; whole numbers are cast to 32 bits; topics are codes already (class_code_strict). A language and
    split with a row that does not fit is not published and does not hold up the others: its status says how many rows and
    which columns, and those rows go to {path}_rejected as they were. keep_split: split stays as a column of the files,
    whose folders are then named lang=.../of=... The status is also appended to {path}_status, from which done() knows what
    is there.

    frame is worked out once: it goes to a table between, from which groups are counted and published, all in one write.
    """
    spark, whole = frame.sparkSession, [c for c in frame.columns if c in WHOLE]
    rows = remaining(frame.drop("full_paragraph"), done(spark, path), GROUP)
    with steps(spark) as own:
        seen, written = Observation(), Observation()
        marked = rows.withColumn("wrong_", misfit(whole)).observe(seen, F.count(F.lit(1)).alias("rows"), F.count("wrong_").alias("wrong"))
        kept = own.keep(marked, "rows")
        if not seen.get["rows"]:
            return spark.createDataFrame([], STATUS)
        error = F.concat(F.count("wrong_").cast("string"), F.lit(" rows do not fit: "), F.array_join(F.array_sort(F.collect_set("wrong_")), "; "))
        groups = kept.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.when(F.count("wrong_") > 0, error).alias("error"))
        groups = own.keep(groups.select(*GROUP, F.when(F.col("error").isNull(), F.col("n")).alias("n"), "error"), "groups")
        good = kept.drop("wrong_")
        if seen.get["wrong"]:
            good = good.join(groups.where("error IS NULL"), GROUP, "left_semi")
            write_by(kept.where("wrong_ IS NOT NULL").drop("wrong_"), f"{path}_rejected", *GROUP)
        good = good.withColumns({c: F.col(c).cast("int") for c in whole}) if whole else good
        folders = ["lang", "of"] if keep_split else GROUP
        good = good.withColumn("of", F.col("split")) if keep_split else good
        write_by(good.hint("rebalance", *folders).observe(written, F.count(F.lit(1)).alias("rows")), path, *folders)
        status = groups.collect()  # a row a language and split
        if (n := sum(r.n or 0 for r in status)) != written.get["rows"]:
            raise RuntimeError(f"{written.get['rows']} of {n} rows were published")
    out = spark.createDataFrame(status, STATUS)
    out.coalesce(1).write.mode("append").json(f"{path}_status")
    return out


def done(spark: SparkSession, path: str) -> DataFrame:
    """lang, split, n of what published() has written."""
    try:
        return spark.read.schema(STATUS).json(f"{path}_status").where("error IS NULL").select("lang", "split", "n")
    except AnalysisException:  # nothing has been published yet
        return spark.createDataFrame([], "lang string, split string, n long")


def missing_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of rows(path) that files(path) lacks."""
    return rows.select("path").distinct().join(files.select("path"), "path", "left_anti")


def require_none(frame: DataFrame, what: str) -> None:
    if (found := frame.take(5)):
        raise ValueError(f"{what}: {found}")
