"""Tables between steps, batches that run again, publishing in one pass, and distances up to a bound."""

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lingloom.functions import bounded
from lingloom.plans import pipelines
from lingloom.sources import sinks, tables
from lingloom.streaming import incremental
from test_relational import REQUIRED, corpus  # noqa: F401  (a fixture)
from test_similarity import distance, edited

# Tables between steps.


def test_steps_keep_and_clear(spark):
    with tables.steps(spark) as own:
        kept = own.keep(spark.range(10).withColumn("part", F.col("id") % 2), "numbers", "part")
        assert kept.columns == ["id", "part"] and kept.count() == 10
        root = own.root.removeprefix("file://").removeprefix("file:")
        assert glob.glob(f"{root}/numbers/part=1/*.parquet")
    assert not os.path.exists(root)
    other = tables.Steps(spark)
    other.keep(spark.range(1), "one")
    tables.clear_all()
    assert not tables.Steps.made and not os.path.exists(other.root.removeprefix("file://").removeprefix("file:"))


def counted(frame, runs):
    """frame, whose rows are counted when they are worked out."""

    def count(batches):
        for batch in batches:
            runs.add(len(batch))
            yield batch

    return frame.mapInPandas(count, frame.schema)


def test_alignment_and_report_work_out_each_input_once(spark, corpus):  # noqa: F811
    recordings, reference, hypotheses = corpus
    runs = spark.sparkContext.accumulator(0)
    own = tables.Steps(spark)
    aligned, statistics = pipelines.align_report(counted(recordings, runs), reference, steps=own)
    assert {tuple(r) for r in statistics.collect()} == {("eng", 3, 2, 1, 1, 0, 2, 2, 0), ("deu", 3, 2, 1, 1, 0, 2, 2, 0)}
    assert aligned.count() == 6 and runs.value == recordings.count()
    assert all(own.root.split("/")[-1] in f for frame in (aligned, statistics) for f in frame.inputFiles())
    scored, runs = pipelines.score(aligned, hypotheses, REQUIRED), spark.sparkContext.accumulator(0)
    report = pipelines.bleu_report(counted(scored, runs), "eng", "whisper", steps=tables.Steps(spark))
    assert {(r.lang, r.split): round(r.bleu) for r in report.collect()} == {("deu", None): 100, ("deu", "train"): 100}
    assert runs.value == 6
    tables.clear_all()


# Batches.


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    spark.range(6).selectExpr("id", "id % 2 AS kind").write.parquet(f"{tmp_path}/in/a")
    fail = [True]

    def once(rows):
        return rows.groupBy("kind").agg(F.sum("id").alias("total"))

    def run(keys=("kind",)):
        write = incremental.run_batches

        def torn(spark, source, schema, own, checkpoint):
            def then_fail(rows, number):
                own(rows, number)
                if fail[0]:
                    raise RuntimeError("after the write")

            write(spark, source, schema, then_fail, checkpoint)

        incremental.run_batches = torn
        try:
            incremental.run_repeatable(spark, f"{tmp_path}/in/*", "id long, kind long", once, f"{tmp_path}/out", f"{tmp_path}/state", *keys)
        finally:
            incremental.run_batches = write

    with pytest.raises(Exception, match="after the write"):
        run()
    there = spark.read.parquet(f"{tmp_path}/out")
    assert there.count() == 2  # the write is done, the batch is not
    fail[0] = False
    run()
    spark.range(10, 12).selectExpr("id", "5 AS kind").write.parquet(f"{tmp_path}/in/b")
    run()
    got = sorted((r.batch, r.kind, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, 0, 6), (0, 1, 9), (1, 5, 21)]


# Publishing.


def test_published_works_rows_out_once(spark, tmp_path):
    runs, out = spark.sparkContext.accumulator(0), f"{tmp_path}/out"
    rows = [(f"l{k % 5}", ("dev", "test")[k % 2], k if k != 33 else 1 << 33, 7, f"text {k}", True) for k in range(100)]
    frame = spark.createDataFrame([*rows, ("l9", None, 1, 1, "no split", True)], "lang string, split string, id long, has_image long, sentence string, full_paragraph boolean")
    status = {(r.lang, r.split): (r.n, r.error) for r in sinks.published(counted(frame, runs), out).collect()}
    assert runs.value == 101
    assert len(status) == 11 and sum(n for n, _ in status.values() if n) == 90
    assert status["l3", "test"] == (None, "1 rows do not fit: id") and status["l9", None] == (None, "1 rows do not fit: split")
    assert spark.read.parquet(out).count() == 90 and spark.read.parquet(f"{out}/lang=l0/split=dev").dtypes == [("id", "int"), ("has_image", "int"), ("sentence", "string")]
    assert {(r.id, r.sentence) for r in spark.read.parquet(f"{out}_rejected").collect()} == {(1 << 33, "text 33"), (1, "no split")}
    again = sinks.published(frame.where("id < 1000 AND split IS NOT NULL"), out)
    assert [(r.lang, r.split, r.n) for r in again.collect()] == [("l3", "test", 9)]
    assert spark.read.parquet(out).count() == 99
    assert sinks.published(frame.where("id < 1000 AND split IS NOT NULL"), out).count() == 0


def test_published_keeps_the_split_column(spark, tmp_path):
    frame = spark.createDataFrame([("en", "dev", "a"), ("en", "test", "b")], "lang string, split string, sentence string")
    assert sinks.published(frame, f"{tmp_path}/out", keep_split=True).count() == 2
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/lang=en/of=dev").collect()] == [("dev", "a")]
    assert sinks.published(frame.limit(0), f"{tmp_path}/none").count() == 0


# Distances.


def test_distances_up_to_a_bound():
    rng = random.Random(8)
    for _ in range(3000):
        a = "".join(rng.choice("abcé🙂") for _ in range(rng.randint(0, 16)))
        b = edited(rng, a, rng.randint(0, 7)) if rng.random() < 0.8 else "".join(rng.choice("abc") for _ in range(rng.randint(0, 16)))
        d, most = distance(a, b), rng.randint(0, 18)
        assert bounded.within(a, b, most) == (d if d <= most else None), (a, b, most)


def test_distances_of_long_passages_take_under_a_second():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    passage = lambda: " ".join(rng.choice(words) for _ in range(20000))[:100_000]
    a = passage()
    b = list(a)
    for at in rng.sample(range(len(a)), 2000):
        b[at] = "#"
    for other, want in ((a, 0), ("".join(b), 2000), (passage(), None)):
        times = []
        for _ in range(3):  # the least of three: other work of the machine does not count
            begin = time.process_time()
            assert bounded.within(a, other, 5000) == want
            times.append(time.process_time() - begin)
        assert min(times) < 1


def test_distances_as_columns(spark):
    rows = [("abcdefghij" * 4, "abcdefghij" * 4 + "x"), ("abcdefghij" * 4, "other"), ("", ""), (None, "a"), ("a", None), ("same", "same")]
    got = spark.createDataFrame(rows, "a string, b string").select(bounded.distance_within(F.col("a"), F.col("b"), 0.05).alias("d")).collect()
    assert [r.d for r in got] == [1, None, 0, None, None, 0]
