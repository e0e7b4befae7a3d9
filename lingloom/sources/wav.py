"""Wav files: where their samples lie, what they are, and at another rate. Helpers of tasks; nothing here plans."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache
from math import gcd
from typing import BinaryIO

import numpy as np

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Zero crossings of the filter on each side, the Kaiser window's shape (some 80 dB), and the share of the band that passes whole.
CROSSINGS, BETA, PASS = 32, 8.0, 0.92
#: Up to so many weights a filter bank is kept for the next file.
KEPT_WEIGHTS = 1 << 20


@dataclass(frozen=True)
class Layout:
    """Of a wav file: the format, and where its samples lie."""

    kind: int
    channels: int
    rate: int
    width: int
    at: int
    size: int

    @property
    def frames(self) -> int:
        return self.size // (self.width * self.channels)

    @property
    def seconds(self) -> float:
        return self.frames / self.rate if self.rate else 0.0


def layout(f: BinaryIO, length: int) -> Layout:
    """Reads chunk heads and the format, and skips the rest: chunks may come in any order, of odd sizes and unknown kinds.

    A writer that could not seek leaves a data size of 2**32 - 1: the samples go on to the end of the file.
    """
    head = f.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("no wav file")
    form, data, at = None, None, 12
    while (form is None or data is None) and at + 8 <= length:
        f.seek(at)
        name, size = struct.unpack("<4sI", f.read(8))
        at += 8
        if name == b"fmt ":
            raw = f.read(min(size, 40))
            if len(raw) < 16:
                raise ValueError("a wav file with a short format")
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
            form = (int.from_bytes(raw[24:26], "little") if kind == EXTENSIBLE else kind, channels, rate, -(-bits // 8))
        elif name == b"data":
            size = min(size, length - at)
            data = (at, size)
        at += size + size % 2
    if form is None or data is None:
        raise ValueError("a wav file without a format or samples")
    kind, channels, rate, width = form
    if (kind, width) not in {(PCM, 1), (PCM, 2), (PCM, 3), (PCM, 4), (FLOAT, 4), (FLOAT, 8)} or not channels or not rate:
        raise ValueError(f"a wav file of kind {kind} with {width} bytes a sample, {channels} channels, {rate} Hz")
    return Layout(kind, channels, rate, width, *data)


def samples(content: bytes, found: Layout) -> np.ndarray:
    """Samples from -1 to 1, the mean of the channels."""
    count = found.frames * found.channels
    raw = np.frombuffer(content, np.uint8, count * found.width, found.at)
    if found.kind == FLOAT:
        x = raw.view(f"<f{found.width}").astype(np.float32)
    elif found.width == 1:
        x = (raw.astype(np.float32) - 128) / 128
    elif found.width == 3:
        wide = np.zeros((count, 4), np.uint8)
        wide[:, 1:] = raw.reshape(count, 3)
        x = wide.view("<i4").ravel().astype(np.float32) / (1 << 31)
    else:
        x = raw.view(f"<i{found.width}").astype(np.float32) / (1 << 8 * found.width - 1)
    return x.reshape(-1, found.channels).mean(1) if found.channels > 1 else x


def phase(up: int, down: int, k: int) -> np.ndarray:
    """Weights of the inputs around an output that lies k / up of a step after one of them."""
    wide = max(1.0, down / up)  # the filter widens as the rate falls, and cuts at half the lower rate
    half = int(np.ceil(CROSSINGS * wide))
    t = (np.arange(-half + 1, half + 1) - k / up) / wide
    w = np.sinc(PASS * t) * np.i0(BETA * np.sqrt(np.clip(1 - (t / CROSSINGS) ** 2, 0, None)))
    return w / w.sum()


@lru_cache(4)
def bank(up: int, down: int) -> np.ndarray:
    return np.stack([phase(up, down, k) for k in range(up)])


def resampled(x: np.ndarray, own: int, rate: int) -> np.ndarray:
    """x at another rate, by a windowed-sinc filter in as many phases as outputs have places between inputs.

    Outputs of one phase lie a fixed number of inputs apart: a strided view times the weights of the phase.
    """
    if own == rate or not len(x):
        return x
    g = gcd(own, rate)
    up, down = rate // g, own // g
    n = len(x) * rate // own
    taps = 2 * int(np.ceil(CROSSINGS * max(1.0, down / up)))
    weights = bank(up, down) if up * taps <= KEPT_WEIGHTS else None
    half = taps // 2
    padded = np.concatenate([np.zeros(half - 1, np.float32), x, np.zeros(half + 1, np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for k in range(min(up, n)):
        first, place = divmod(k * down, up)
        w = weights[place] if weights is not None else phase(up, down, place)
        out[k::up] = view[first::down][: len(range(k, n, up))] @ w.astype(np.float32)
    return out
