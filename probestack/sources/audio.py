"""Log-mel filterbanks as a numpy kernel for mapInPandas. Fixed values follow the feature definition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

RATE, N_FFT, N_MELS, HOP, WINDOW, F_MIN, TOP_DB = 16000, 2048, 80, 160, 400, 50.0, 80.0


def mel(hz: np.ndarray) -> np.ndarray:
    """Slaney's scale: linear below 1 kHz, logarithmic above."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, hz / (200 / 3), 15 + np.log(np.maximum(hz, 1e-9) / 1000) / (np.log(6.4) / 27))


def hertz(m: np.ndarray) -> np.ndarray:
    return np.where(m < 15, m * (200 / 3), 1000 * np.exp((np.log(6.4) / 27) * (m - 15)))


def mel_weights(n_mels: int = N_MELS) -> np.ndarray:
    edges = hertz(np.linspace(mel(np.array(F_MIN)), mel(np.array(RATE / 2)), n_mels + 2))
    freqs = np.linspace(0, RATE / 2, N_FFT // 2 + 1)
    up = (freqs[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - freqs[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2.0 / (edges[2:] - edges[:-2]))[:, None]


def preemphasised(x: np.ndarray, a: float = 0.97) -> np.ndarray:
    return np.concatenate([x[:1], x[1:] - a * x[:-1]])


def log_mel(signal: np.ndarray) -> np.ndarray:
    """[frames, 80]: peak-normalised to 0.999, pre-emphasised, magnitude mel in dB over the last 80, / 80 + 1."""
    peak = np.abs(signal).max(initial=0.0)
    x = preemphasised(signal / peak * 0.999 if peak > 0 else signal)
    x = np.pad(x, N_FFT // 2, mode="reflect" if len(x) > N_FFT // 2 else "constant")
    window = np.zeros(N_FFT)
    at = (N_FFT - WINDOW) // 2
    window[at : at + WINDOW] = np.hanning(WINDOW + 1)[:-1]
    frames = np.lib.stride_tricks.sliding_window_view(x, N_FFT)[::HOP] * window
    power = np.abs(np.fft.rfft(frames, axis=1)) @ mel_weights().T
    db = 20 * np.log10(np.maximum(power, 1e-5))
    return np.maximum(db, db.max(initial=-1e9) - TOP_DB) / TOP_DB + 1 if len(db) else db


def filterbanks(audio: DataFrame) -> DataFrame:
    """utt_id, frame, vec of rows (utt_id, signal array<float> at 16 kHz)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for utt, signal in zip(pdf["utt_id"], pdf["signal"], strict=True):
                m = log_mel(np.asarray(signal, float))
                yield pd.DataFrame({"utt_id": utt, "frame": np.arange(len(m)), "vec": list(m.astype(np.float32))})

    return audio.select("utt_id", "signal").mapInPandas(run, "utt_id string, frame long, vec array<float>")
