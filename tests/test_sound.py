"""Sound by its numbers: headers, other rates, speech in noise, and models that see each file once."""

import io
import struct
import wave

import numpy as np
import pytest

from lingloom.sources import audio, headers, readers, wav

RATE = 16000


def pcm(samples, width=2, rate=RATE, channels=1):
    """The bytes of a wav file, by the standard library."""
    x = np.asarray(samples, np.float64)
    if width == 1:
        raw = (np.round(x * 127) + 128).astype(np.uint8).tobytes()
    else:
        whole = np.round(x * ((1 << 8 * width - 1) - 1)).astype("<i8")
        raw = whole.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(raw)
    return out.getvalue()


def chunk(name, body, size=None):
    return name + struct.pack("<I", len(body) if size is None else size) + body + b"\0" * (len(body) % 2)


def riff(*chunks):
    body = b"WAVE" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def tone(hertz, seconds=1.0, rate=RATE, size=0.5):
    return size * np.sin(2 * np.pi * hertz * np.arange(int(seconds * rate)) / rate)


def level(x):
    """Decibels, without the ends, where the filter has no neighbours."""
    return 20 * np.log10(np.sqrt(np.mean(np.asarray(x, np.float64)[2000:-2000] ** 2)) + 1e-12)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
@pytest.mark.parametrize("channels", [1, 2])
def test_samples_of_every_width(width, channels):
    x = tone(440, 0.1)
    both = np.stack([x, x * 0.5], 1).ravel() if channels == 2 else x
    got, seconds = audio.decoded(pcm(both, width, channels=channels))
    assert seconds == 0.1 and np.abs(got - (x * 0.75 if channels == 2 else x)).max() < 2.0 ** (2 - 8 * min(width, 2))


def test_samples_of_floats_and_extensible_formats():
    x = tone(300, 0.05).astype("<f4")
    plain = struct.pack("<HHIIHH", 3, 1, RATE, RATE * 4, 4, 32)
    wide = struct.pack("<HHIIHHHHI", 0xFFFE, 1, RATE, RATE * 4, 4, 32, 22, 32, 4) + struct.pack("<H", 3) + b"\0" * 14
    for form in (plain, wide):
        got, _ = audio.decoded(riff(chunk(b"fmt ", form), chunk(b"data", x.tobytes())))
        assert np.array_equal(got, x)


FORM = struct.pack("<HHIIHH", 1, 1, RATE, RATE * 2, 2, 16)
ORDERS = [
    lambda form, data: [form, data],
    lambda form, data: [chunk(b"LIST", b"odd"), form, chunk(b"fact", b"1234"), data],
    lambda form, data: [data, chunk(b"LIST", b"x" * 7), form],
    lambda form, data: [chunk(b"junk", b"y" * 5000), form, data, chunk(b"id3 ", b"z")],
]


@pytest.mark.parametrize("order", ORDERS)
def test_chunks_in_any_order(order):
    x = (tone(200, 0.02) * 32767).astype("<i2")
    content = riff(*order(chunk(b"fmt ", FORM), chunk(b"data", x.tobytes())))
    got, seconds = audio.decoded(content)
    assert seconds == 0.02 and np.abs(got * 32768 - x).max() < 1e-2


def test_files_that_are_cut_or_none():
    x = (tone(200, 0.02) * 32767).astype("<i2").tobytes()
    open_end = riff(chunk(b"fmt ", FORM), chunk(b"data", x, 0xFFFFFFFF))
    assert audio.header_seconds(open_end) == 0.02 and audio.header_seconds(open_end[:-320]) == 0.01
    other = chunk(b"fmt ", struct.pack("<HHIIHH", 85, 1, RATE, 1, 1, 0))
    for bad in (b"", b"RIFF", b"no wav file at all", riff(chunk(b"data", x)), riff(chunk(b"fmt ", FORM)), riff(chunk(b"fmt ", b"12")), riff(other, chunk(b"data", x))):
        with pytest.raises(ValueError):
            audio.header_seconds(bad)


@pytest.mark.parametrize("own", [48000, 44100, 32000, 22050, 24000])
def test_other_rates_keep_tones_below_half_the_rate_and_no_others(own):
    for hertz in (60, 440, 3000, 6800):
        got = wav.resampled(tone(hertz, 2, own).astype(np.float32), own, RATE)
        assert len(got) == 2 * RATE
        assert np.abs(got[3000:-3000] - tone(hertz, 2)[3000:-3000]).max() < 0.01, hertz
    for hertz in (8050, 9000, 10500):
        if hertz < own / 2:
            before = tone(hertz, 2, own).astype(np.float32)
            assert level(wav.resampled(before, own, RATE)) < level(before) - 40, hertz


def test_higher_rates_add_no_images():
    got = wav.resampled(tone(3000, 2, 8000).astype(np.float32), 8000, RATE)
    assert np.abs(got[3000:-3000] - tone(3000, 2)[3000:-3000]).max() < 0.01
    assert wav.resampled(np.zeros(0, np.float32), 8000, RATE).size == 0
    odd = wav.resampled(np.ones(11025, np.float32), 11027, RATE)
    assert len(odd) == 11025 * RATE // 11027 and np.abs(odd[3000:-3000] - 1).max() < 1e-3


# Speech.


def voice(seconds, rng):
    """A voice: harmonics of a gliding pitch, in syllables."""
    t = np.arange(int(seconds * RATE)) / RATE
    phase = 2 * np.pi * np.cumsum(130 + 30 * np.sin(2 * np.pi * 0.7 * t)) / RATE
    x = sum(np.sin(k * phase + rng.random()) / k for k in range(1, 25))
    return 0.08 * x * (0.6 + 0.4 * np.abs(np.sin(2 * np.pi * 2.5 * t)))


@pytest.mark.parametrize("noise", [-75, -50, -38])
def test_planted_speech_in_noise(noise):
    rng = np.random.default_rng(3)
    planted = [(1.0, 2.5), (3.4, 3.9), (6.0, 9.2)]
    x = 10 ** (noise / 20) * rng.standard_normal(11 * RATE)
    for a, b in planted:
        said = voice(b - a, rng)
        x[int(a * RATE) : int(a * RATE) + len(said)] += said
    got = audio.voice_detector(x.astype(np.float32))
    assert len(got) == len(planted), got
    for (a, b), (c, d) in zip(planted, got, strict=True):
        assert abs(a - c) < 0.05 and abs(b - d) < 0.05, (got, planted)


def test_noise_and_clicks_are_no_speech():
    rng = np.random.default_rng(4)
    white = rng.standard_normal(8 * RATE)
    pink = np.fft.irfft(np.fft.rfft(white) / np.sqrt(np.arange(len(white) // 2 + 1) + 1.0))
    for x in (white, pink / pink.std()):
        assert audio.voice_detector((x * 10 ** (-25 / 20)).astype(np.float32)) == []
    quiet = 1e-3 * rng.standard_normal(4 * RATE)
    quiet[RATE : RATE + 400] += 0.5 * rng.standard_normal(400)
    assert audio.voice_detector(quiet.astype(np.float32)) == []
    assert audio.voice_detector(np.zeros(0, np.float32)) == [] == audio.voice_detector(np.zeros(5, np.float32))


def test_pauses_are_bridged_up_to_their_least_length():
    rng = np.random.default_rng(5)
    for pause, count in ((0.1, 1), (0.4, 2)):
        x = 10 ** (-60 / 20) * rng.standard_normal(5 * RATE)
        for at in (1.0, 2.0 + pause):
            x[int(at * RATE) : int(at * RATE) + RATE] += voice(1, rng)
        assert len(audio.voice_detector(x.astype(np.float32))) == count
    whole = voice(6, rng).astype(np.float32)
    assert sum(b - a for a, b in audio.voice_detector(whole)) > 5.8  # a voice without a pause has no quiet around it


# Sources and models.


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("sounds")
    rng = np.random.default_rng(6)
    for split, number in (("dev", 4), ("test", 3), ("train", 5)):
        (root / split).mkdir()
        for k in range(number):
            (root / split / f"{split}{k}.wav").write_bytes(pcm(0.1 * rng.standard_normal(int(RATE * (0.5 + 0.3 * k)))))
    (root / "dev" / "long.wav").write_bytes(pcm(np.zeros(31 * RATE)))
    (root / "dev" / "broken.wav").write_bytes(b"RIFF and no more")
    (root / "dev" / "notes.txt").write_text("no sound")
    (root / "top.wav").write_bytes(riff(chunk(b"LIST", b"q" * 90001), chunk(b"fmt ", FORM), chunk(b"data", b"\0" * RATE)))
    return root


def test_headers_read_no_samples(spark, folder):
    got = {r.filename: r for r in headers.read_headers(spark, str(folder)).collect()}
    assert len(got) == 15 and sum(r.error is not None for r in got.values()) == 1
    assert (got["long.wav"].seconds, got["long.wav"].split, got["top.wav"].seconds, got["top.wav"].split) == (31.0, "dev", 0.5, folder.name)
    assert got["broken.wav"].seconds is None and "no wav" in got["broken.wav"].error
    assert all(r.bytes_read < 200 for r in got.values()) and got["long.wav"].bytes > 900_000
    assert {r.filename: r.duration_class for r in audio.durations(headers.read_headers(spark, f"file://{folder}")).collect()}["long.wav"] == "long"
    one = {r.path for r in headers.read_headers(spark, str(folder), tasks=1).collect()}
    assert one == {r.path for r in got.values()}


@pytest.mark.parametrize("by_path", [True, False])
def test_models_run_once_a_file(spark, folder, tmp_path, by_path):
    """Counters of tasks: every file is in one batch, and the writer reads each once, whatever the number of splits."""
    runs, files, loads = (spark.sparkContext.accumulator(0) for _ in range(3))

    def load(code, task, long):
        loads.add(1)

        def model(batch):
            runs.add(1), files.add(len(batch))
            assert len(batch) == 1 if long else max(map(len, batch)) * len(batch) <= audio.BATCH_SAMPLES
            return [f"{code} {'long' if long else len(x)}" for x in batch]

        return model

    sounds = headers.read_headers(spark, str(folder), 1) if by_path else audio.read_audio(spark, str(folder))
    audio.transcribe_splits(sounds, str(tmp_path), "whisper", "en_us", load)
    assert files.value == 14 and runs.value <= 14
    got = {r.filename: r for r in readers.read_hypotheses(spark, str(tmp_path)).collect()}
    assert len(got) == 15 and (got["broken.wav"].text, got["long.wav"].text, got["train4.wav"].text, got["train4.wav"].split) == (None, "en long", f"en {int(RATE * 1.7)}", "train")
    assert {(r.lang, r.model, r.task) for r in got.values()} == {("en_us", "whisper", "transcription")}


def test_batches_hold_files_of_like_length():
    sizes = [5 * RATE, RATE, 29 * RATE, 2 * RATE, 28 * RATE, RATE]
    got = list(audio.batches_of(sizes, 3))
    assert sorted(k for b in got for k in b) == list(range(6)) and got[0] == [1, 5, 3]
    assert all(len(b) * max(sizes[k] for k in b) <= audio.BATCH_SAMPLES for b in got)
    assert list(audio.batches_of([10**9], 4)) == [[0]] and list(audio.batches_of([], 4)) == []


def test_a_file_that_fails_does_not_take_its_batch_along():
    def model(batch):
        if any(len(x) == 7 for x in batch):
            raise MemoryError
        return [str(len(x)) for x in batch]

    assert audio.texts_of(model, [np.zeros(k) for k in (3, 7, 4)]) == ["3", None, "4"]
    assert audio.texts_of(lambda b: ["one"], [np.zeros(1), np.zeros(1)]) == ["one", "one"]
