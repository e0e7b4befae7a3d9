"""Readers, sound, writers and incremental runs on files made here."""

import json
import os
import wave

import numpy as np
import pytest

from lingloom.sources import audio, languages, readers, sinks
from lingloom.streaming import incremental


def test_recordings(spark, tmp_path):
    (tmp_path / "train.tsv").write_text('12\ta.wav\tsay "hi"\tsay hi\tx\t100\tsp12a3\tF\n')
    (tmp_path / "dev.tsv").write_text("12\tb.wav\tt\tt\tx\t50\tunknown\tM\n")
    got = {r.filename: r for r in readers.read_recordings(spark, f"{tmp_path}/*.tsv").collect()}
    assert got["a.wav"].raw_transcription == 'say "hi"' and (got["a.wav"].speaker_id, got["b.wav"].speaker_id) == (123, -1) and got["b.wav"].split == "dev"
    (tmp_path / "test.tsv").write_text("12\tb.wav\tt\tt\tx\t50\tM\n")
    with pytest.raises(Exception, match="eight fields"):
        readers.read_recordings(spark, f"{tmp_path}/test.tsv").collect()


def test_voice_activity_hypotheses_and_log(spark, tmp_path):
    (tmp_path / "log.tsv").write_text("a.wav\tTrue\nb.wav\tFalse\n")
    assert {tuple(r) for r in readers.read_voice_activity(spark, f"{tmp_path}/log.tsv").collect()} == {("a.wav", True), ("b.wav", False)}
    folder = tmp_path / "whisper/transcription/en_us"
    folder.mkdir(parents=True)
    (folder / "dev.jsonl").write_text(json.dumps({"filename": "a.wav", "whisper_asr": " hi "}) + "\n")
    assert tuple(readers.read_hypotheses(spark, str(tmp_path)).first()) == ("en_us", "whisper", "transcription", "dev", "a.wav", "hi")
    (tmp_path / "done.tsv").write_text("en\tdev\t3\n")
    work = spark.createDataFrame([("en", "dev"), ("en", "test")], "lang string, split string")
    assert [tuple(r) for r in readers.remaining(work, readers.read_completed(spark, f"{tmp_path}/done.tsv"), ["lang", "split"]).collect()] == [("en", "test")]
    (tmp_path / "map.json").write_text('{"0": 7, "1": 9}')
    assert {tuple(r) for r in readers.read_id_map(spark, f"{tmp_path}/map.json").collect()} == {(0, 7), (1, 9)}


def test_languages(spark, tmp_path):
    (tmp_path / "languages.csv").write_text("fleurs_code,flores_code,whisper_code,mms_code,seamless_code,in_belebele,in_sib\nen_us,eng_Latn,english,eng,eng,true,true\n")
    dim = readers.read_languages(spark, f"{tmp_path}/languages.csv")
    known = spark.createDataFrame([("en_us",)], "lang string")
    assert readers.with_code(known, dim, "lang", "mms_code").first().mms_code == "eng"
    with pytest.raises(Exception, match="no code"):
        readers.with_code(spark.createDataFrame([("xx",)], "lang string"), dim, "lang", "mms_code").collect()


def write_wav(path, samples, rate=16000):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with wave.open(path, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.asarray(samples) * 32767).astype("<i2").tobytes())


@pytest.fixture(scope="module")
def sounds(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("wav"))
    tone = 0.5 * np.sin(np.arange(16000) * 0.2)
    write_wav(f"{root}/dev/tone.wav", tone)
    write_wav(f"{root}/dev/silence.wav", np.zeros(16000))
    write_wav(f"{root}/dev/blip.wav", np.concatenate([np.zeros(16000 * 2), tone[:480]]))
    write_wav(f"{root}/test/slow.wav", tone[:8000], 8000)
    write_wav(f"{root}/test/long.wav", np.zeros(16000 * 31))
    return audio.read_audio(spark, root)


def test_sound(spark, sounds):
    got = {r.filename: r for r in audio.durations(sounds).collect()}
    assert (got["slow.wav"].seconds, got["slow.wav"].split, got["long.wav"].duration_class, got["tone.wav"].duration_class) == (1.0, "test", "long", "short")
    assert {r.filename: r.is_silent for r in audio.classify_silence(sounds).collect()} == {"tone.wav": False, "silence.wav": True, "blip.wav": True, "slow.wav": False, "long.wav": True}


def test_models_keep_names(spark, sounds):
    def load():
        def model(batch):
            if any(len(x) > 16000 * 30 for x in batch):
                raise MemoryError
            return [str(len(x)) for x in batch]

        return model

    assert {r.filename: r.text for r in audio.transcribe(sounds, lambda long: load(), 2).collect()} == {"tone.wav": "16000", "silence.wav": "16000", "blip.wav": "32480", "slow.wav": "16000", "long.wav": None}


def test_no_sound_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        audio.read_audio(spark, str(tmp_path))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("en", "dev", "a.wav", True), ("en", "dev", "b.wav", False), ("de", "dev", "c.wav", False)], "lang string, split string, filename string, is_silent boolean")
    sinks.write_by(rows, f"{tmp_path}/t", "lang")
    sinks.write_by(rows.where("lang = 'en'").limit(1), f"{tmp_path}/t", "lang")
    assert spark.read.parquet(f"{tmp_path}/t").groupBy("lang").count().count() == 2 and spark.read.parquet(f"{tmp_path}/t").count() == 2
    sinks.write_silence(rows, f"{tmp_path}/s")
    counts = spark.read.csv(f"{tmp_path}/s/counts", sep="\t", header=True).collect()
    assert {tuple(r) for r in counts} == {("en", "dev", "1", "2"), ("de", "dev", "0", "1")}
    with pytest.raises(ValueError, match="missing"):
        sinks.require_none(sinks.missing_files(spark.createDataFrame([("x",)], "path string"), spark.createDataFrame([], "path string")), "missing")


def test_incremental_takes_new_files_only(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in/a")
    run = lambda: incremental.run_available(spark, f"{tmp_path}/in/*", "id long", lambda d: d.selectExpr("id * 2 as id"), f"{tmp_path}/out", f"{tmp_path}/state")
    run()
    spark.range(10, 12).write.parquet(f"{tmp_path}/in/b")
    run()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 2, 4, 20, 22]


def test_language_table(spark):
    table = languages.languages(spark)
    assert table.count() == 102 == table.select("fleurs_code").distinct().count() == table.select("flores_code").distinct().count() and table.where("in_belebele").count() == 92
    assert len(languages.PASSAGES.split()) == 122 == len(set(languages.PASSAGES.split()))
    assert [r.lang for r in languages.with_passages(spark.createDataFrame([("eng_Latn",), ("umb_Latn",), ("acm_Arab",)], "lang string")).collect()] == ["eng_Latn", "acm_Arab"]
    codes = [languages.model_code(m, x) for m, x in (("whisper", "en_us"), ("whisper", "jv_id"), ("mms", "az_az"), ("mms", "de_de"), ("seamlessm4t", "ha_ng"), ("seamlessm4t", "fil_ph"))]
    assert codes == ["en", "jw", "azj-script_latin", "deu", "fuv", "tgl"] and languages.speech_code("oci_fr") == "oc_fr"
    for model, language in (("whisper", "xx_yy"), ("other", "en_us")):
        with pytest.raises(ValueError):
            languages.model_code(model, language)


def test_models_by_language(spark, sounds, tmp_path):
    load = lambda code, task, long: lambda batch: [f"{code} {task} {'long' if long else 'short'} {len(batch) if long else ''}".strip() for _ in batch]
    got = {r.filename: r.whisper_asr_translation for r in audio.transcribe_language(sounds, "whisper", "jv_id", load, translate=True).collect()}
    assert got["tone.wav"] == "jw translate short" and got["long.wav"] == "jw translate long 1"
    audio.transcribe_splits(sounds, str(tmp_path), "seamlessm4t", "de_de", load)
    read = {(r.lang, r.model, r.task, r.split, r.filename): r.text for r in readers.read_hypotheses(spark, str(tmp_path)).collect()}
    assert len(read) == 5 and read["de_de", "seamlessm4t", "transcription", "dev", "tone.wav"] == "deu transcribe short"
    with pytest.raises(ValueError, match="translate"):
        audio.transcribe_language(sounds, "mms", "de_de", load, translate=True)
    log = audio.classify_languages(sounds.selectExpr("'de_de' AS lang", "*"), f"{tmp_path}/silence")
    assert {(r.lang, r.filename) for r in log.where("is_silent").collect()} == {("de_de", "silence.wav"), ("de_de", "blip.wav"), ("de_de", "long.wav")}


def test_published_skips_what_is_done_and_logs_errors(spark, tmp_path):
    rows = spark.createDataFrame([("en", "dev", 1, "a", True), ("en", "test", 1 << 40, "b", True), ("de", "dev", 2, "c", True)], "lang string, split string, id long, sentence string, full_paragraph boolean")
    out = f"{tmp_path}/out"
    got = {(r.lang, r.split): (r.n, r.error is None) for r in sinks.published(rows, out).collect()}
    assert got == {("en", "dev"): (1, True), ("en", "test"): (None, False), ("de", "dev"): (1, True)}
    again = sinks.published(rows.where("id < 10").withColumn("sentence", rows.sentence).union(rows.limit(0)), out)
    assert again.count() == 0 and {tuple(r) for r in sinks.done(spark, out).collect()} == {("en", "dev", 1), ("de", "dev", 1)}
    read = spark.read.parquet(f"{out}/lang=en/split=dev")
    assert read.dtypes == [("id", "int"), ("sentence", "string")]


def test_hypotheses_have_a_name_and_one_text(spark, tmp_path):
    folder = tmp_path / "mms/transcription/en_us"
    folder.mkdir(parents=True)
    (folder / "dev.jsonl").write_text(json.dumps({"filename": "a.wav", "mms_asr": "x", "whisper_asr": "y"}) + "\n")
    with pytest.raises(Exception, match="one text"):
        readers.read_hypotheses(spark, str(tmp_path)).collect()


def test_batches_take_new_files_only(spark, tmp_path):
    seen = []
    run = lambda: incremental.run_batches(spark, f"{tmp_path}/in/*", "id long", lambda df, n: seen.append(sorted(r.id for r in df.collect())), f"{tmp_path}/state")
    spark.range(3).write.parquet(f"{tmp_path}/in/a")
    run()
    spark.range(7, 9).write.parquet(f"{tmp_path}/in/b")
    run()
    assert [x for x in seen if x] == [[0, 1, 2], [7, 8]]


def test_union_of_tables(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/dev")
    spark.range(5, 6).write.parquet(f"{tmp_path}/devtest")
    assert sorted(r.id for r in readers.read_union(spark, f"{tmp_path}/dev", f"{tmp_path}/devtest").collect()) == [0, 1, 5]


def test_logs_with_more_or_fewer_fields(spark, tmp_path):
    (tmp_path / "log.tsv").write_text("  en\tdev\t12\textra\nde\ttest\n\nfr\tdev\tmany\n")
    got = {tuple(r) for r in readers.read_completed(spark, f"{tmp_path}/log.tsv").collect()}
    assert got == {("en", "dev", 12), ("de", "test", None), ("fr", "dev", None)}
    (tmp_path / "bad.tsv").write_text("only\n")
    with pytest.raises(Exception, match="no two fields"):
        readers.read_completed(spark, f"{tmp_path}/bad.tsv").collect()


def test_tables_named_by_their_key(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"id": [1, 2], "x": ["a", "b"]}).to_parquet(f"{tmp_path}/en_us.parquet")
    pd.DataFrame({"id": [3]}).to_parquet(f"{tmp_path}/de_de.parquet")
    (tmp_path / "readme.txt").write_text("none")
    assert {(r.lang, r.id, r.x) for r in readers.read_by_stem(spark, str(tmp_path)).collect()} == {("en_us", 1, "a"), ("en_us", 2, "b"), ("de_de", 3, None)}


def test_topic_languages_are_those_of_the_topic_table(spark):
    topics = spark.createDataFrame([("eng_Latn", "train"), ("eng_Latn", "test"), ("nqo_Nkoo", "test")], "lang string, split string")
    rows = spark.createDataFrame([("eng_Latn", 1), ("xxx_Latn", 2), ("nqo_Nkoo", 3)], "lang string, id int")
    assert {tuple(r) for r in languages.with_topics(rows, topics).collect()} == {("eng_Latn", 1), ("nqo_Nkoo", 3)}
    assert languages.languages(spark).where("in_sib").count() == 102
