"""Features and resampling of PCM audio (WAV bytes), as Arrow-batched jobs over a table of recordings."""

from __future__ import annotations

import io

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolake.sources.readers import wav_header


def samples_of(raw: bytes) -> tuple[np.ndarray, int]:
    """The first channel of 16-bit PCM as numbers within 1, and the rate."""
    channels, rate, bits, n = wav_header(io.BytesIO(raw)) or (1, 0, 16, 0)
    if bits != 16 or not n:
        return np.zeros(0), rate
    at = raw.index(b"data") + 8
    return np.frombuffer(raw[at : at + n * channels * 2], "<i2").reshape(-1, channels)[:, 0] / 32768.0, rate


def mel_bank(bands: int, size: int, rate: int) -> np.ndarray:
    """Triangles at equal distances on the mel scale, (bands, size // 2 + 1)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, size // 2 + 1)
    up, down = (f - edge[:-2, None]) / np.diff(edge)[:-1, None], (edge[2:, None] - f) / np.diff(edge)[1:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel(x: np.ndarray, rate: int, bands: int = 80, window: float = 0.025, hop: float = 0.01, emphasis: float = 0.97, dither: float = 0.0, seed: int = 0) -> np.ndarray:
    """(frames, bands): dither (normal noise of that deviation, fixed by the seed), pre-emphasis, power spectra of frames that lie whole in the signal, mel bands, natural logarithm floored at 1e-20."""
    n, h = int(rate * window), int(rate * hop)
    if len(x) < n or not n:
        return np.zeros((0, bands))
    x = x + dither * np.random.default_rng(seed).standard_normal(len(x)) if dither else x
    x = np.append(x[:1], x[1:] - emphasis * x[:-1])
    frames = np.lib.stride_tricks.sliding_window_view(x, n)[::h] * np.hanning(n)
    size = 1 << (n - 1).bit_length()
    return np.log(np.maximum(np.abs(np.fft.rfft(frames, size)) ** 2 @ mel_bank(bands, size, rate).T, 1e-20))


def features(recordings: DataFrame, bands: int = 80, dither: float = 0.0) -> DataFrame:
    """utt, frame, features of recordings (utt, content); dither is fixed by utt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for utt, raw in zip(b["utt"], b["content"], strict=True):
                m = log_mel(*samples_of(raw), bands, dither=dither, seed=utt)
                yield pd.DataFrame({"utt": pd.Series([utt] * len(m), dtype="int64"), "frame": np.arange(len(m)), "features": pd.Series([r.tolist() for r in m], dtype="object")})

    return recordings.select("utt", "content").mapInPandas(run, "utt long, frame long, features array<double>")


def resampled(x: np.ndarray, factor: float) -> np.ndarray:
    """x played at factor times its speed, by linear interpolation."""
    n = int(len(x) / factor)
    return np.interp(np.arange(n) * factor, np.arange(len(x)), x) if n else x[:0]


def narrow_band(x: np.ndarray, rate: int, limit: int) -> np.ndarray:
    """x without what lies above half of limit samples a second."""
    spectrum = np.fft.rfft(x)
    spectrum[np.fft.rfftfreq(len(x), 1 / rate) > limit / 2] = 0
    return np.fft.irfft(spectrum, len(x))


def augmented(signals: DataFrame, seed: int, speed_share: float = 0.0, low: float = 0.85, high: float = 1.15, narrow_share: float = 0.0, limit: int = 8000) -> DataFrame:
    """signals (utt, rate, signal) with speed and narrow: a share of them at another speed between low and high, a share as a narrow band.
    Which ones, and how fast, is fixed by a hash of utt and seed."""
    unit = lambda k: F.pmod(F.xxhash64("utt", F.lit(seed), F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
    speed = F.when(unit(1) < speed_share, low + unit(2) * (high - low)).otherwise(F.lit(1.0))
    d = signals.select("utt", "rate", "signal").withColumns({"speed": speed, "narrow": unit(3) < narrow_share})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for x, rate, factor, narrow in zip(b["signal"], b["rate"], b["speed"], b["narrow"], strict=True):
                y = np.asarray(x, float)
                y = resampled(y, factor) if factor != 1 else y
                out.append((narrow_band(y, rate, limit) if narrow and len(y) else y).tolist())
            yield b.assign(signal=pd.Series(out, index=b.index, dtype="object"))

    return d.mapInPandas(run, d.schema)
