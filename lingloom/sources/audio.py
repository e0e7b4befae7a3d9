"""Sound files: durations, samples, silence, and a plug for models. Python runs here only, in Arrow batches.

A table of audio has filename, split and either content (read_audio) or path (headers.read_headers); tasks open paths
themselves, so contents are never shuffled.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingloom.functions.text import duration_class, mostly_silent
from lingloom.sources import headers, wav
from lingloom.sources.languages import model_code
from lingloom.sources.readers import stem
from lingloom.sources.sinks import write_silence

RATE = 16000
#: Samples of a batch for a model at most, with all files as long as the longest; and of those that wait in a task to be sorted.
BATCH_SAMPLES, WAITING_SAMPLES = RATE * 30 * 8, RATE * 30 * 64
Model = Callable[[list[np.ndarray]], list[str | None]]


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """filename, split (the folder), content of the wav files below path; an empty folder raises."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    if files.isEmpty():
        raise FileNotFoundError(f"no wav files below {path}")
    return files.select(F.concat(stem("path"), F.lit(".wav")).alias("filename"), F.element_at(F.split("path", "/"), -2).alias("split"), "content")


def decoded(content: bytes, rate: int = RATE) -> tuple[np.ndarray, float]:
    """Mono samples from -1 to 1 at the rate, and the duration in seconds by the header."""
    found = wav.layout(io.BytesIO(content), len(content))
    return wav.resampled(wav.samples(content, found), found.rate, rate), found.seconds


def header_seconds(content: bytes) -> float:
    """The duration by the header; no sample is read."""
    return wav.layout(io.BytesIO(content), len(content)).seconds


def durations(audio: DataFrame) -> DataFrame:
    """filename, split, seconds, and the class that routes long files.

    A table with seconds already (read_headers) is not opened again. Whole files travel in Arrow batches:
    spark.sql.execution.arrow.maxRecordsPerBatch bounds how many.
    """
    if "seconds" in audio.columns:
        return audio.select("filename", "split", "seconds").withColumn("duration_class", duration_class(F.col("seconds")))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"filename": batch["filename"], "split": batch["split"], "seconds": [header_seconds(c) for c in batch["content"]]})

    out = audio.select("filename", "split", "content").mapInPandas(measure, "filename string, split string, seconds double")
    return out.withColumn("duration_class", duration_class(F.col("seconds")))


def content_of(kind: str, value: str | bytes) -> bytes:
    """The bytes of a file, by its content or its path."""
    if kind == "content":
        return value
    store, path = headers.opened(value)
    with store.open_input_file(path) as f:
        return f.read()


def carrier(audio: DataFrame) -> str:
    return "content" if "content" in audio.columns else "path"


class Voice(NamedTuple):
    """How voice_detector() tells speech: decibels over the noise floor where it begins and where it may go on, seconds of
    the shortest speech and the shortest pause, decibels below which nothing is heard, and the flatness of a spectrum (noise has
    some 0.1 to 0.6) under which a sound has a tone. Level and spectrum are those from 200 to 4,000 Hz."""

    begin: float = 9.0
    go_on: float = 5.0
    least_speech: float = 0.1
    least_pause: float = 0.2
    unheard: float = -60.0
    tonal: float = 0.08


WINDOW, HOP, BLOCK = 0.025, 0.01, 0.5
#: Frames that are worked out at a time, and those over which the flatness is averaged.
FRAMES, EVEN = 4096, 5


def frame_features(samples: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Level in decibels and spectral flatness of each window; frames go in blocks, so memory does not follow their number."""
    size, hop = int(WINDOW * rate), int(HOP * rate)
    padded = np.concatenate([np.zeros(size // 2, np.float32), samples, np.zeros(size, np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop][: -(-len(samples) // hop)]
    shape, frequency = np.hanning(size).astype(np.float32), np.fft.rfftfreq(size, 1 / rate)
    band = (frequency >= 200) & (frequency <= 4000)
    level, flat = [], []
    for lo in range(0, len(view), FRAMES):
        power = np.abs(np.fft.rfft(view[lo : lo + FRAMES] * shape, axis=1)[:, band]) ** 2 + 1e-12
        level.append(10 * np.log10(power.sum(1) * 2 / (size * (shape**2).sum())))
        flat.append(np.exp(np.log(power).mean(1)) / power.mean(1))
    around = np.pad(np.concatenate(flat), EVEN // 2, mode="edge")
    return np.concatenate(level), np.lib.stride_tricks.sliding_window_view(around, EVEN).mean(1)


def noise_floor(level: np.ndarray, unheard: float) -> np.ndarray:
    """The level of the quiet around each frame: the least of the low fifths of the half seconds within a second and a half."""
    size = int(BLOCK / HOP)
    blocks = [np.percentile(level[lo : lo + size], 20) for lo in range(0, len(level), size)]
    wide = np.pad(blocks, 3, constant_values=np.inf)
    least = np.lib.stride_tricks.sliding_window_view(wide, 7).min(1)
    return np.maximum(np.repeat(least, size)[: len(level)], unheard)


def stretches(mask: np.ndarray) -> np.ndarray:
    """(begin, end) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges.reshape(-1, 2)


def voice_detector(samples: np.ndarray, rate: int = RATE, voice: Voice = Voice()) -> list[tuple[float, float]]:
    """(begin, end) in seconds of the speech in some samples.

    Speech begins where the level is well over the noise floor around it, and goes on while it is somewhat over it; a sound
    with a tone is speech at any floor, so steady noise is not, and a voice without pauses is. Pauses that are too short are
    bridged, then speech that is too short is dropped.
    """
    if not len(samples):
        return []
    level, flat = frame_features(samples, rate)
    floor = noise_floor(level, voice.unheard)
    tone = (flat < voice.tonal) & (level > voice.unheard + voice.begin)
    strong, weak = (level > floor + voice.begin) | tone, (level > floor + voice.go_on) | tone
    begun = np.concatenate([[0], np.cumsum(strong)])
    runs = [(a, b) for a, b in stretches(weak) if begun[b] > begun[a]]
    joined: list[list[int]] = []
    for a, b in runs:
        if joined and (a - joined[-1][1]) * HOP < voice.least_pause:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    end = len(samples) / rate
    return [(float(a * HOP), min(float(b * HOP), end)) for a, b in joined if (b - a) * HOP >= voice.least_speech]


def classify_silence(audio: DataFrame, detector: Callable[[np.ndarray, int], list[tuple[float, float]]] = voice_detector, silence: float = 0.95, level: float = -25.0) -> DataFrame:
    """filename, split, speech, seconds, is_silent: whether speech, after bringing the loudness to the level, is too little."""
    kind = carrier(audio)

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch[kind]:
                samples, seconds = decoded(content_of(kind, value))
                rms = float(np.sqrt((samples**2).mean())) if len(samples) else 0.0
                loud = samples * 10 ** ((level - 20 * np.log10(rms + 1e-9)) / 20)
                rows.append((sum(b - a for a, b in detector(loud, RATE)) if rms > 1e-6 else 0.0, seconds))
            yield pd.DataFrame({"filename": batch["filename"], "split": batch["split"], "speech": [r[0] for r in rows], "seconds": [r[1] for r in rows]})

    out = audio.select("filename", "split", kind).mapInPandas(detect, "filename string, split string, speech double, seconds double")
    return out.withColumn("is_silent", F.coalesce(mostly_silent(F.col("speech"), F.col("seconds"), silence), F.lit(True)))


def texts_of(model: Model, files: list[np.ndarray]) -> list[str | None]:
    """The model's texts; where it fails on several files, each is tried alone, and one that fails alone has none."""
    try:
        found = model(files)
        if len(found) != len(files):
            raise ValueError(f"{len(found)} texts of {len(files)} files")
        return list(found)
    except Exception:
        return [None] if len(files) == 1 else [x for one in files for x in texts_of(model, [one])]


def batches_of(sizes: list[int], most: int) -> Iterator[list[int]]:
    """Positions, by size: at most that many in a batch, and BATCH_SAMPLES with all as long as the longest, or one alone."""
    now: list[int] = []
    for k in sorted(range(len(sizes)), key=lambda k: sizes[k]):
        if now and (len(now) == most or (len(now) + 1) * sizes[k] > BATCH_SAMPLES):
            yield now
            now = []
        now.append(k)
    if now:
        yield now


def transcribe(audio: DataFrame, load: Callable[[bool], Model], batch: int = 8, limit: float = 30.0) -> DataFrame:
    """filename, split, text by a model, in one pass over the files.

    load(long) runs once in a task for each kind of files that it meets; files of limit seconds and more are long and go to
    their model alone. A task keeps files waiting up to WAITING_SAMPLES, and batches those of like length. Each file keeps its
    name through its batch; where the model fails on a batch, its files are tried alone, and a file that fails alone, or
    cannot be read, has a null text.
    """
    kind = carrier(audio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[bool, Model] = {}
        waiting: list[tuple[str, str, np.ndarray]] = []

        def told(rows: list[tuple[str, str]], texts: list[str | None]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in ([r[0] for r in rows], [r[1] for r in rows], texts)], ["filename", "split", "text"])

        def model(long: bool) -> Model:
            if long not in models:
                models[long] = load(long)
            return models[long]

        def settle() -> Iterator[pa.RecordBatch]:
            for own in batches_of([len(x) for _, _, x in waiting], batch):
                yield told([waiting[k][:2] for k in own], texts_of(model(False), [waiting[k][2] for k in own]))
            waiting.clear()

        for rows in batches:
            for filename, split, value in zip(*(rows.column(c) for c in ("filename", "split", kind)), strict=True):
                name = (filename.as_py(), split.as_py())
                try:
                    samples, seconds = decoded(content_of(kind, value.as_py()))
                except (ValueError, OSError):
                    yield told([name], [None])
                    continue
                if seconds >= limit:
                    yield told([name], texts_of(model(True), [samples]))
                    continue
                waiting.append((*name, samples))
                if sum(len(x) for _, _, x in waiting) >= WAITING_SAMPLES:
                    yield from settle()
        yield from settle()

    return audio.select("filename", "split", kind).mapInArrow(run, "filename string, split string, text string")


def by_duration(found: DataFrame, tasks: int | None = None) -> DataFrame:
    """A table of headers dealt to tasks by duration, so that batches hold files of like length; only names are shuffled."""
    return found.repartitionByRange(tasks or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seconds", "path")


def transcribe_language(audio: DataFrame, model: str, language: str, load: Callable[[str, str, bool], Model], translate: bool = False, batch: int = 8) -> DataFrame:
    """filename, split and the model's column ({model}_asr, or {model}_asr_translation) for the files of a language.

    load(code, task, long) gives a function from samples to texts, by the model's code of the language and the task
    (transcribe or translate). Files of 30 seconds and more go one by one to a function for long files. Every file is read
    and run once.
    """
    if translate and model == "mms":
        raise ValueError("this model does not translate")
    code, task = model_code(model, language), "translate" if translate else "transcribe"
    dealt = by_duration(audio) if carrier(audio) == "path" and "seconds" in audio.columns else audio
    found = transcribe(dealt, lambda long: load(code, task, long), batch)
    return found.withColumnRenamed("text", f"{model}_asr" + "_translation" * translate)


def transcribe_splits(audio: DataFrame, root: str, model: str, language: str, load: Callable, translate: bool = False, batch: int = 8) -> None:
    """Writes {model}/{task}/{language}/split={split} below root for every split of audio, as read_hypotheses() takes them:
    one job, which runs the model once a file and deals its lines out to the folders of their splits."""
    found = transcribe_language(audio, model, language, load, translate, batch)
    found.write.mode("overwrite").partitionBy("split").json(f"{root}/{model}/{'translation' if translate else 'transcription'}/{language}")


def classify_languages(audio: DataFrame, folder: str, **options) -> DataFrame:
    """The silence log of audio(lang, split, filename, content) of any number of languages, written below folder and returned."""
    found = classify_silence(audio.withColumn("filename", F.concat_ws("/", "lang", "filename")), **options)
    name = F.split("filename", "/")
    activity = found.select(name[0].alias("lang"), "split", name[1].alias("filename"), "is_silent")
    write_silence(activity, folder)
    return activity
