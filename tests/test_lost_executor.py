"""A plan on a small cluster that loses an executor between its steps and its result."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
RUN = """
import sys, time
from pyspark.sql import SparkSession
from lingloom.plans import pipelines
from lingloom.sources.tables import Steps

settings = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "700m", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "3",
            "spark.checkpoint.dir": sys.argv[1], "spark.executorEnv.PYTHONPATH": sys.argv[2], "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.config(map=settings).getOrCreate()
sentences = [f"sentence number {k} of the book has {k * 7919} words" for k in range(40)]
recordings = [("aaa", k, f"{k}.wav", s if k % 3 else s[:-1], s, 1, 1, "F", "dev") for k, s in enumerate(sentences)]
recordings = spark.createDataFrame(recordings, "lang string, fleurs_id int, filename string, raw_transcription string, transcription string, num_samples int, speaker_id int, gender string, split string")
reference = spark.createDataFrame([("aaa", k, s, f"page {k // 4}") for k, s in enumerate(sentences)], "lang string, id int, sentence string, url string")
steps = Steps(spark)
aligned, statistics = pipelines.align_report(recordings, reference, steps=steps)
before = sorted(map(str, aligned.collect()))
jvm = spark.sparkContext._jsc.sc()
alive = lambda: jvm.getExecutorMemoryStatus().size() - 1
ids = [e for e in ("0", "1") if alive()]
jvm.killExecutor(ids[0])
for _ in range(100):  # the other one is enough to go on with
    if alive() < 2:
        break
    time.sleep(0.1)
print("LOST", alive() < 2)
after, row = sorted(map(str, aligned.collect())), statistics.first()
print("SAME", before == after, len(after), tuple(row))
steps.clear()
spark.stop()
"""


def test_a_lost_executor_costs_no_rows(tmp_path):
    env = os.environ | {"PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    done = subprocess.run([sys.executable, "-c", RUN, f"file://{tmp_path}", str(ROOT)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=280)
    assert "LOST True" in done.stdout, done.stdout + done.stderr[-2000:]
    assert "SAME True 40 ('aaa', 40, 26, 14, 14, 0, 10, 10, 0)" in done.stdout, done.stdout
