"""Relational operators against brute force and on edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from lingloom.operators import completeness, linking, nesting, reports, similarity
from lingloom.plans import pipelines
from tests_distance import distance


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_similarity_join_is_brute_force(spark, k):
    rng = random.Random(k)
    make = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(0, 12)))
    left, right = {make() for _ in range(120)}, {make() for _ in range(120)}
    a, b = (spark.createDataFrame([(x,) for x in [*s, None]], "text string") for s in (left, right))
    got = {(r.a, r.b, r.distance) for r in similarity.within_distance(a, b, k).collect()}
    assert got == {(x, y, d) for x in left for y in right if (d := distance(x, y)) <= k}


def test_nearest_breaks_ties_by_order(spark):
    left = spark.createDataFrame([("en", "abcd"), ("de", "abcd")], "lang string, text string")
    right = spark.createDataFrame([("en", "abce", 5), ("en", "abcf", 2), ("en", "zzzz", 1)], "lang string, text string, ord int")
    assert [tuple(r) for r in similarity.nearest(left, right, 3, ["lang"]).collect()] == [("en", "abcd", "abcf", 1)]


def test_links_go_from_exact_to_fuzzy(spark):
    left = spark.createDataFrame([("en", "a  good day"), ("en", "A good dya!"), ("en", "nothing like it at all"), ("en", None)], "lang string, t string")
    right = spark.createDataFrame([("en", "a  good day", 1), ("en", "A good day.", 2)], "lang string, s string, id int")
    got = {r.a: (r.b, r.match_type, r.distance) for r in linking.links(left, right, "t", "s", ["lang"], "id").collect()}
    assert got == {"a  good day": ("a  good day", "exact", 0), "A good dya!": ("A good day.", "fuzzy", 2)}


def test_voiced_and_rewritten(spark):
    recordings = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "filename string, n int")
    activity = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "filename string, is_silent boolean")
    assert [r.filename for r in linking.voiced(recordings, activity).collect()] == ["a"]
    swap = spark.createDataFrame([("x", "y"), ("y", "x")], "old string, new string")
    assert sorted(r.v for r in linking.rewritten(spark.createDataFrame([("x",), ("y",), ("z",)], "v string"), "v", swap).collect()) == ["x", "y", "z"]


def test_nest_and_back(spark):
    rows = [(k % 7, k, f"t{k}", None if k % 2 else k) for k in range(60)]
    frame = spark.createDataFrame(rows, "g int, k int, t string, m int")
    nested = nesting.nest(frame, ["g"], ["k"], ["k", "t"], first=["m"])
    assert {r.g: r.m for r in nested.collect()} == {g: next(m for a, _, _, m in rows if a == g and m is not None) for g in range(7)}
    assert sorted(map(tuple, nesting.unnest(nested.drop("m")).collect())) == sorted((g, k, t) for g, k, t, _ in rows)
    flat = nesting.unnest_arrays(nesting.parallel_arrays(nested.drop("m"), ["k", "t"]), ["k", "t"])
    assert sorted(map(tuple, flat.collect())) == sorted((g, k, t) for g, k, t, _ in rows)


def test_completeness(spark):
    reference = spark.createDataFrame([("p", 1), ("p", 2), ("p", 3), ("q", 4)], "url string, id int")
    flagged = completeness.with_completeness(reference.where("id <> 3"), reference, ["url"])
    assert {(r.url, r.full_paragraph) for r in flagged.collect()} == {("p", False), ("q", True)}
    counts = completeness.paragraph_counts(flagged.withColumn("lang", F.lit("en")), ["lang"], "url").first()
    assert tuple(counts) == ("en", 2, 1, 1)


def test_best_hypothesis(spark):
    frame = spark.createDataFrame([(["x", "y", "z"], [0.5, 0.1, 0.1])], "t array<string>, e array<double>")
    assert frame.select(reports.best_hypothesis(F.col("t"), F.col("e")), reports.best_hypothesis(F.col("t"), F.col("e"), "first")).first()[:] == ("y", "x")


@pytest.fixture(scope="module")
def corpus(spark):
    """Recordings of two languages, their reference sentences, and hypotheses by two models."""
    sentences = {"eng": ["the first thing is here", "a second thing came", "the third one left"], "deu": ["das erste ding ist hier", "ein zweites ding kam", "das dritte ging"]}
    recordings, reference, hypotheses = [], [], []
    for lang, texts in sentences.items():
        for k, t in enumerate(texts):
            reference.append((lang, k, t, "url1" if k < 2 else "url2"))
            for j in range(2):
                name = f"{lang}{k}{j}.wav"
                recordings.append((lang, k, name, t + ("!" if k == 1 else ""), t, 100 + j, j, "F", "train" if j else "dev"))
                for model in ("whisper", "seamlessm4t"):
                    hypotheses.append((lang, model, "transcription", name, t if j else t + "x"))
                    hypotheses.append((lang, model, "translation", name, sentences["eng"][k]))
    return (
        spark.createDataFrame(recordings, "lang string, fleurs_id int, filename string, raw_transcription string, transcription string, num_samples int, speaker_id int, gender string, split string"),
        spark.createDataFrame(reference, "lang string, id int, sentence string, url string"),
        spark.createDataFrame(hypotheses, "lang string, model string, task string, filename string, text string"),
    )


REQUIRED = [(m, t) for m in ("whisper", "seamlessm4t") for t in ("transcription", "translation")]


def test_align_and_statistics(spark, corpus):
    recordings, reference, _ = corpus
    aligned = pipelines.align(recordings, reference)
    assert {(r.lang, r.id): r.match_type for r in aligned.collect()} == {(lang, k): "fuzzy" if k == 1 else "exact" for lang in ("eng", "deu") for k in range(3)}
    assert aligned.where("full_paragraph").count() == 6 and {len(r.recordings) for r in aligned.collect()} == {2}
    stats = {r.lang: tuple(r)[1:] for r in pipelines.align_statistics(recordings, reference, aligned).collect()}
    assert stats["eng"] == (3, 2, 1, 1, 0, 2, 2, 0)


def test_score_summary_and_bleu(spark, corpus):
    recordings, reference, hypotheses = corpus
    scored = pipelines.score(pipelines.align(recordings, reference), hypotheses, REQUIRED)
    assert scored.count() == 6
    summary = {r.lang: r for r in pipelines.asr_summary(scored).collect()}
    assert len(summary["eng"]) == 25 and summary["eng"].train_whisper_asr_cer_mean > 0 and summary["eng"].dev_whisper_asr_cer_mean is None
    got = {(r.lang, r.split): r.bleu for r in pipelines.bleu_report(scored, "eng", "whisper").collect()}
    assert got == {("deu", None): pytest.approx(100), ("deu", "train"): pytest.approx(100)}
    fewer = pipelines.score(pipelines.align(recordings, reference), hypotheses.where("filename not in ('eng00.wav', 'eng01.wav')"), REQUIRED)
    assert {r.url for r in fewer.where("lang = 'eng'").collect()} == {"url2"}


def test_topics_and_passages(spark, corpus):
    recordings, reference, _ = corpus
    aligned = pipelines.align(recordings, reference)
    topics = spark.createDataFrame([("eng", "the first thing is here", "travel", "test"), ("eng", "a second thing cam", "sports", "test"), ("eng", "no such sentence anywhere", "health", "test")], "lang string, text string, category string, split string")
    spoken = aligned.select("lang", "sentence", "id", "recordings")
    assert {(r.text, r.split, r.category_code) for r in pipelines.link_topics(spoken, topics).collect()} == {("the first thing is here", "train", 1), ("a second thing cam", "train", 3)}
    assert {r.split for r in pipelines.link_topics(spoken, topics, by_split=True).collect()} == {"test"}
    items = spark.createDataFrame([("eng", "url1", "the first thing is here a second thing came", "q1"), ("eng", "url1", "the first thing is here a second thing came", "q2"), ("eng", "url2", "something else", "q3")], "lang string, link string, passage string, question string")
    good, bad = pipelines.link_passages(items, aligned)
    got = {r.question: [(s.id, s.sentence_idx) for s in r.sentence_data] for r in good.collect()}
    assert got == {"q1": [(0, 0), (1, 1)], "q2": [(0, 0), (1, 1)]} and [r.link for r in bad.collect()] == ["url2"]


def test_id_against_text(spark, corpus):
    recordings, reference, _ = corpus
    spoken = recordings.select("lang", "fleurs_id", "raw_transcription").distinct()
    id_map = spark.createDataFrame([(k, k) for k in range(3)], "idx int, id int")
    assert {tuple(r) for r in pipelines.id_against_text(spoken, reference, id_map).collect()} == {("eng", 3, 2, 1, 1), ("deu", 3, 2, 1, 1)}
    assert {tuple(r) for r in pipelines.id_against_set(spoken, reference, id_map).collect()} == {("eng", 3, 2, 1, 1), ("deu", 3, 2, 1, 1)}


def test_strict_passages_raise_and_audio_is_attached(spark, corpus):
    recordings, reference, _ = corpus
    aligned = pipelines.align(recordings, reference)
    items = spark.createDataFrame([("eng", "url1", "the first thing is here a second thing came", "q1"), ("eng", "url2", "something else", "q3")], "lang string, link string, passage string, question string")
    good, _ = pipelines.link_passages(items, aligned, media="data")
    assert [a.path for a in good.collect()[0].sentence_data[0].audio] == ["data/dev/eng00.wav", "data/train/eng01.wav"]
    with pytest.raises(Exception, match="differs"):
        pipelines.link_passages(items, aligned, strict=True)[0].collect()


def test_unknown_class_raises(spark):
    from lingloom.functions.text import class_code_strict

    frame = spark.createDataFrame([("a",), (None,), ("z",)], "x string")
    assert [r[0] for r in frame.where("x IS NULL OR x = 'a'").select(class_code_strict(["a", "b"], F.col("x"))).collect()] == [0, None]
    with pytest.raises(Exception, match="no such class"):
        frame.select(class_code_strict(["a", "b"], F.col("x"))).collect()
