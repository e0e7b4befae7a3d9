"""The corpus pipelines as plans over tables keyed by lang.

What a plan reads twice is worked out once: it goes to a table of the plan's steps (sources/tables.py), which the caller may
name, to clear it when the result is written, and to use the same table in several plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingloom.functions import bleu
from lingloom.functions.bounded import distance_within
from lingloom.functions.splits import resolve, route
from lingloom.functions.text import char_error_rate, class_code_strict, normalise, normalised_distance, strip, word_error_rate
from lingloom.operators.completeness import paragraph_counts, with_completeness
from lingloom.operators.linking import links, voiced
from lingloom.operators.nesting import nest, unnest, with_media
from lingloom.operators.reports import array_mean, best_hypothesis, pivot_summary
from lingloom.sources.tables import Steps

RECORDING = ["filename", "gender", "num_samples", "speaker_id", "split"]
#: The topics in the order of their codes (fixed values).
TOPICS = ["science/technology", "travel", "politics", "sports", "health", "entertainment", "geography"]

RATES = {"cer": char_error_rate, "wer": word_error_rate}


def nested_sentences(recordings: DataFrame, activity: DataFrame | None = None) -> DataFrame:
    """lang, fleurs_id, raw_transcription, transcription, recordings: one row a sentence, recordings in order of file and split."""
    key = ["lang", "fleurs_id", "filename"]
    rest = [c for c in recordings.columns if c not in key]
    # Of rows of one file the smallest stays, so that a second run gives the same.
    kept = recordings.groupBy(*key).agg(F.min(F.struct("split", *(c for c in rest if c != "split"))).alias("row_")).select(*key, "row_.*")
    if activity is not None:
        kept = voiced(kept, activity)
    return nest(kept, ["lang", "fleurs_id"], ["filename", "split"], RECORDING, "recordings", ["raw_transcription", "transcription"])


def align(recordings: DataFrame, reference: DataFrame, activity: DataFrame | None = None, k: int = 3, steps: Steps | None = None) -> DataFrame:
    """Reference sentences (lang, id, sentence, url, ...) with their spoken sentence, the kind of link, and full_paragraph."""
    steps = steps or Steps(recordings.sparkSession)
    return align_spoken(steps.keep(nested_sentences(recordings, activity), "spoken"), reference, k, steps)


def align_spoken(spoken: DataFrame, reference: DataFrame, k: int = 3, steps: Steps | None = None) -> DataFrame:
    """As align(), from the table of nested_sentences()."""
    found = links(spoken, reference.select("lang", "sentence", "id"), "raw_transcription", "sentence", ["lang"], "id", k, steps)
    found = found.withColumnsRenamed({"a": "raw_transcription", "b": "sentence"})
    linked = reference.join(found, ["lang", "sentence"]).join(spoken, ["lang", "raw_transcription"])
    return with_completeness(linked, reference, ["lang", "url"])


def align_report(recordings: DataFrame, reference: DataFrame, activity: DataFrame | None = None, k: int = 3, steps: Steps | None = None) -> tuple[DataFrame, DataFrame]:
    """align() and its statistics, from one table of spoken sentences and one of aligned ones."""
    steps = steps or Steps(recordings.sparkSession)
    spoken = steps.keep(nested_sentences(recordings, activity), "spoken")
    aligned = steps.keep(align_spoken(spoken, reference, k, steps), "aligned")
    return aligned, spoken_statistics(spoken, aligned)


def align_statistics(recordings: DataFrame, reference: DataFrame, aligned: DataFrame, activity: DataFrame | None = None, steps: Steps | None = None) -> DataFrame:
    """The statistics of an aligned table, which is read twice: a stored one, best. align_report() gives both."""
    steps = steps or Steps(recordings.sparkSession)
    return spoken_statistics(steps.keep(nested_sentences(recordings, activity), "spoken"), aligned)


def spoken_statistics(spoken: DataFrame, aligned: DataFrame) -> DataFrame:
    """One row a language: sentences, exact matches, those missing before and after recovery, recovered, paragraphs."""
    total = spoken.groupBy("lang").agg(F.count(F.lit(1)).alias("sentences"), F.countDistinct("raw_transcription").alias("texts"))
    kinds = aligned.groupBy("lang").agg(
        F.countDistinct(F.when(F.col("match_type") == "exact", F.col("raw_transcription"))).alias("exact_matches"),
        F.countDistinct(F.when(F.col("match_type") == "fuzzy", F.col("raw_transcription"))).alias("recovered"),
    )
    zero = {"exact_matches": 0, "recovered": 0, "total_paragraphs": 0, "retained_paragraphs": 0, "missing_paragraphs": 0}
    out = total.join(kinds, "lang", "left").join(paragraph_counts(aligned, ["lang"], "url"), "lang", "left").fillna(zero)
    difference = F.col("texts") - F.col("exact_matches")
    return out.select("lang", "sentences", "exact_matches", difference.alias("difference"), "recovered", (difference - F.col("recovered")).alias("still_missing"), "total_paragraphs", "retained_paragraphs", "missing_paragraphs")


def score(aligned: DataFrame, hypotheses: DataFrame, required: list[tuple[str, str]], errors: tuple[str, ...] = ("cer", "wer")) -> DataFrame:
    """aligned with recordings scored by hypotheses(lang, model, task, filename, text).

    A recording stays if it has a hypothesis of every required (model, task); a sentence if a recording does; a paragraph
    if all its sentences do. Error rates are of transcriptions: of characters (cer), words (wer), or both.
    """
    flat = unnest(aligned, "recordings").withColumn("reference", strip(F.col("raw_transcription")))
    wide = hypotheses.where(F.struct("model", "task").isin([F.struct(F.lit(m).alias("model"), F.lit(t).alias("task")) for m, t in required]))
    names = [f"{m}_asr" + ("_translation" if t == "translation" else "") for m, t in required]
    label = F.concat("model", F.when(F.col("task") == "translation", "_asr_translation").otherwise("_asr"))
    wide = wide.withColumn("label", label).groupBy("lang", "filename").pivot("label", names).agg(F.min("text"))
    joined = flat.join(wide.dropna(subset=names), ["lang", "filename"])
    fields = [*RECORDING]
    for name in names:
        joined = joined.withColumn(name, strip(F.col(name)))
        fields.append(name)
        if not name.endswith("_translation"):
            for e in errors:
                joined = joined.withColumn(f"{name}_{e}", RATES[e](F.col("reference"), F.col(name)))
                fields.append(f"{name}_{e}")
    keep = [c for c in aligned.columns if c not in ("recordings", "lang", "sentence", "url", "full_paragraph")]
    scored = nest(joined, ["lang", "url", "sentence"], ["filename", "split"], fields, "recordings", keep)
    return with_completeness(scored, aligned, ["lang", "url"]).where("full_paragraph")


def link_topics(spoken: DataFrame, topics: DataFrame, k: int = 3, by_split: bool = False) -> DataFrame:
    """Topic items (lang, text, category, split, ...) with the spoken sentence (lang, sentence, recordings) they match.

    by_split: keep the topic set's own split; else the split of the recordings routes the item, and mixtures go.
    """
    found = links(topics, spoken.select("lang", "sentence", "id"), "text", "sentence", ["lang"], "id", k).withColumnsRenamed({"a": "text", "b": "sentence"})
    joined = topics.withColumnRenamed("split", "topic_split").join(found, ["lang", "text"]).join(spoken, ["lang", "sentence"])
    joined = joined.withColumn("category_code", class_code_strict(TOPICS, F.col("category")))
    if by_split:
        return joined.withColumnRenamed("topic_split", "split")
    return joined.withColumn("split", route(F.transform("recordings", lambda r: r["split"]))).where("split IS NOT NULL").drop("topic_split")


def link_passages(items: DataFrame, linked: DataFrame, limit: float = 0.05, media: str | None = None, strict: bool = False, measure: bool = False) -> tuple[DataFrame, DataFrame]:
    """Questions (lang, link, passage, ...) of complete paragraphs with sentence_data, its sentences in order of id; and the
    (lang, link, passage, distance) set aside, whose passage is not near enough to the sentences joined.

    Distances are measured up to the limit only; those set aside have a null one, unless measure asks for theirs in full,
    which takes the square of their length.
    media: the folder of the sound files; each sentence then has audio, the paths and rates of its recordings.
    strict: a passage that is not near enough raises when the questions are read.
    """
    whole = linked.where("full_paragraph")
    fields = [c for c in whole.columns if c not in ("lang", "url", "full_paragraph")]
    data = nest(whole, ["lang", "url"], ["id", "sentence"], fields, "sentence_data").withColumnRenamed("url", "link")
    text = normalise(F.array_join(F.transform("sentence_data", lambda s: s["sentence"]), " "))
    data = data.withColumn("sentence_data", F.transform("sentence_data", lambda s, i: s.withField("sentence_idx", i))).withColumn("text_", text)
    passages = items.select("lang", "link", "passage").distinct().join(data, ["lang", "link"])
    passages = passages.withColumn("passage_", normalise(F.col("passage")))
    longer = F.greatest(F.length("passage_"), F.length("text_")).cast("double")
    edits = distance_within(F.col("passage_"), F.col("text_"), limit)
    passages = passages.withColumn("distance", F.try_divide(edits.cast("double"), longer))
    near = F.col("distance") < limit
    if media is not None:
        passages = passages.withColumn("sentence_data", with_media(F.col("sentence_data"), F.lit(media)))
    if strict:
        far = F.raise_error(F.concat(F.lit("a passage differs from its sentences: "), F.col("lang"), F.lit(" "), F.col("link").cast("string")))
        passages = passages.withColumn("distance", F.when(near, F.col("distance")).otherwise(far.cast("double")))
    good = items.join(passages.where(near).select("lang", "link", "passage", "sentence_data"), ["lang", "link", "passage"])
    aside = passages.where(~near | F.col("distance").isNull())
    distance = F.coalesce("distance", normalised_distance(F.col("passage_"), F.col("text_"))) if measure else F.col("distance")
    return good, aside.select("lang", "link", "passage", distance.alias("distance"))


def asr_summary(scored: DataFrame, models: tuple[str, ...] = ("whisper", "seamlessm4t"), errors: tuple[str, ...] = ("cer", "wer")) -> DataFrame:
    """lang and {split}_{model}_asr_{cer,wer}_{mean,std} over the means of each sentence's recordings."""
    measures = [f"{m}_asr_{e}" for m in models for e in errors]
    rows = scored.select("lang", resolve(F.transform("recordings", lambda r: r["split"])).alias("split"), *(array_mean(F.col("recordings")[c]).alias(c) for c in measures))
    return pivot_summary(rows, "lang", "split", measures)


def bleu_report(scored: DataFrame, pivot_lang: str, model: str, select: str = "min_cer", steps: Steps | None = None) -> DataFrame:
    """lang, split (null for all), bleu of translations against the pivot language's sentence of equal id.

    Both sides are read from one table of what the report needs of scored.
    """
    fields = (f"{model}_asr_translation", f"{model}_asr_cer", "split")
    narrow = F.transform("recordings", lambda r: F.struct(*(r[c].alias(c) for c in fields)))
    scored = (steps or Steps(scored.sparkSession)).keep(scored.select("lang", "id", "sentence", narrow.alias("recordings")), "scored")
    of = lambda name: F.col("recordings")[name]
    best = best_hypothesis(of(f"{model}_asr_translation"), of(f"{model}_asr_cer"), select)
    rows = scored.where(F.col("lang") != pivot_lang).select("lang", "id", best.alias("hypothesis"), resolve(of("split")).alias("split"))
    reference = scored.where(F.col("lang") == pivot_lang).select("id", F.col("sentence").alias("reference"))
    sums = bleu.statistics(rows.join(reference, "id"), "hypothesis", "reference", ["lang", "split"])
    counts = [c for c in sums.columns if c not in ("lang", "split")]
    both = sums.withColumn("split", F.explode(F.array("split", F.lit(None))))  # a few rows a language: its splits, and all of them
    return both.groupBy("lang", "split").agg(*(F.sum(c).alias(c) for c in counts)).select("lang", "split", bleu.score().alias("bleu"))


def id_against_text(spoken: DataFrame, reference: DataFrame, id_map: DataFrame) -> DataFrame:
    """Per language: pairs by the id map, those of equal text, the others, and of these how many have the nearest text of their id."""
    pairs = spoken.join(id_map.withColumnRenamed("id", "fleurs_id"), "fleurs_id").join(reference.withColumnRenamed("id", "idx"), ["lang", "idx"])
    odd = pairs.where("raw_transcription <> sentence")
    near = links(odd, reference.select("lang", "sentence", "id"), "raw_transcription", "sentence", ["lang"], "id").select("lang", F.col("a").alias("raw_transcription"), F.col("b").alias("nearest"))
    back = pairs.join(near, ["lang", "raw_transcription"], "left")
    same = F.col("raw_transcription") == F.col("sentence")
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("full"), F.count_if(same).alias("exact"), F.count_if(~same).alias("miss"), F.count_if(~same & (F.col("nearest") == F.col("sentence"))).alias("nearest_is_id"))


def id_against_set(spoken: DataFrame, reference: DataFrame, id_map: DataFrame, k: float = 0.025) -> DataFrame:
    """Per language: sentences, texts in both sets of the pairs by the id map, the other spoken texts, and how many of these
    have a text within k edits. A k under one lets equal normalised texts through only."""
    pairs = spoken.join(id_map.withColumnRenamed("id", "fleurs_id"), "fleurs_id").join(reference.withColumnRenamed("id", "idx"), ["lang", "idx"])
    texts, known = pairs.select("lang", "raw_transcription").distinct(), pairs.select("lang", "sentence", "idx")
    found = links(texts, known, "raw_transcription", "sentence", ["lang"], "idx", int(k))
    counts = found.groupBy("lang").agg(F.count_if(F.col("match_type") == "exact").alias("exact"), F.count_if(F.col("match_type") == "fuzzy").alias("near"))
    full, all_ = spoken.groupBy("lang").agg(F.countDistinct("fleurs_id").alias("full")), texts.groupBy("lang").agg(F.count(F.lit(1)).alias("texts_"))
    out = full.join(all_, "lang", "left").join(counts, "lang", "left").fillna(0)
    return out.select("lang", "full", "exact", (F.col("texts_") - F.col("exact")).alias("miss"), "near")
