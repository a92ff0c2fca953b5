"""Filters and resampling of windows in numpy, over batches of equally long windows.

Formulas: bilinear transforms of the analogue prototypes with prewarped edges, forward-backward
filtering with odd extension and steady-state starts, and Fourier resampling.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def _digital(z: np.ndarray, p: np.ndarray, k: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of an analogue zero-pole-gain filter after the bilinear transform at a rate of 2."""
    degree, c = len(p) - len(z), 4.0
    gain = k * np.real(np.prod(c - z) / np.prod(c - p))
    zeros = np.append((c + z) / (c - z), -np.ones(degree))
    return np.real(gain * np.poly(zeros)), np.real(np.poly((c + p) / (c - p)))


@lru_cache
def butterworth_band(low: float, high: float, fs: float, order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Band-pass of the given prototype order, its edges clipped to 0.01 to 0.99 of half the rate."""
    edges = np.clip(np.array([low, high]) / (fs / 2), 0.01, 0.99)
    w1, w2 = 4 * np.tan(np.pi * edges / 2)
    m = np.arange(-order + 1, order, 2)
    p = -np.exp(1j * np.pi * m / (2 * order)) * (w2 - w1) / 2
    root = np.sqrt(p**2 - w1 * w2 + 0j)
    return _digital(np.zeros(order), np.concatenate([p + root, p - root]), (w2 - w1) ** order)


@lru_cache
def bessel_low(cutoff: float, order: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Third-order phase-normalised low-pass; ``cutoff`` as a share of half the rate."""
    if order != 3:
        raise ValueError("only the third order is built")
    c = 15 ** (1 / 3)
    poles = np.roots([1, 6 / c, 15 / c**2, 1])
    w = 4 * np.tan(np.pi * cutoff / 2)
    return _digital(np.zeros(0), poles * w, w**3)


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Delay values at which the filter's answer to a constant 1 starts without a transient."""
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a)))
    companion = np.zeros((n - 1, n - 1))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] += np.eye(n - 2)
    return np.linalg.solve(np.eye(n - 1) - companion, b[1:] - a[1:] * b[0])


def run_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Transposed direct form along the last axis; loops over time, all windows at once."""
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a)))
    state, out = start.copy(), np.empty_like(x)
    for t in range(x.shape[1]):
        out[:, t] = b[0] * x[:, t] + state[:, 0]
        state[:, :-1] = state[:, 1:]
        state[:, -1] = 0
        state += x[:, t, None] * b[1:] - out[:, t, None] * a[1:]
    return out


def forward_backward(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filtering of rows; rows no longer than the extension are an error."""
    pad = 3 * max(len(a), len(b))
    if x.shape[1] <= pad:
        raise ValueError("a window must be longer than the filter's extension")
    zi = steady_state(b, a)
    wide = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1)
    once = run_filter(b, a, wide, zi * wide[:, :1])
    back = once[:, ::-1]
    return run_filter(b, a, back, zi * back[:, :1])[:, ::-1][:, pad:-pad]


def remove_line(x: np.ndarray) -> np.ndarray:
    i = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
    centred = x - x.mean(axis=1, keepdims=True)
    return centred - np.outer(centred @ i / max((i**2).sum(), 1e-300), i)


def pulse_band(x: np.ndarray, fs: float, low: float = 0.7, high: float = 3.5) -> np.ndarray:
    """Detrended and band-passed windows: the pulse preprocessing."""
    return forward_backward(*butterworth_band(low, high, fs), remove_line(x))


def fourier_resample(x: np.ndarray, n: int) -> np.ndarray:
    """Rows resampled to n values by their spectrum."""
    have = x.shape[1]
    spectrum = np.fft.rfft(x, axis=1)
    least = min(n, have)
    out = np.zeros((x.shape[0], n // 2 + 1), complex)
    out[:, : least // 2 + 1] = spectrum[:, : least // 2 + 1]
    if least % 2 == 0:
        if n < have:
            out[:, least // 2] *= 2
        elif n > have:
            out[:, least // 2] /= 2
    return np.fft.irfft(out, n, axis=1) * n / have


def by_length(windows: pd.Series, apply) -> pd.Series:
    """``apply`` (matrix -> matrix or vector) to the windows of each length; null, short or non-finite ones give null."""
    out = pd.Series([None] * len(windows), dtype=object)
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(windows):
        if w is not None and len(w):
            groups.setdefault(len(w), []).append(k)
    for rows in groups.values():
        x = np.array([np.asarray(windows.iloc[k], float) for k in rows])
        good = np.isfinite(x).all(axis=1)
        if not good.any():
            continue
        try:
            y = apply(x[good])
        except ValueError:
            continue
        for k, v in zip(np.array(rows)[good], y, strict=True):
            out.iloc[k] = v
    return out


def bandpass(window: Column, fs: float, low: float = 0.7, high: float = 3.5) -> Column:
    """Zero-phase band-pass of an array column; null where the window is too short or not finite."""

    @F.pandas_udf("array<double>")
    def run(w: pd.Series) -> pd.Series:
        return by_length(w, lambda x: forward_backward(*butterworth_band(low, high, fs), x))

    return run(window)


def preprocess_pulse(window: Column, fs: float) -> Column:
    @F.pandas_udf("array<double>")
    def run(w: pd.Series) -> pd.Series:
        return by_length(w, lambda x: pulse_band(x, fs))

    return run(window)


def preprocess_channels(df, fs: float, channels: tuple[str, ...] = ("ppg_ir", "ppg_green")):
    """Preprocessed channels, or ``ppg`` if the table has neither, and the flag ``ppg_preprocessed``."""
    own = [c for c in channels if c in df.columns] or ["ppg"]
    for c in own:
        df = df.withColumn(c, preprocess_pulse(F.col(c), fs))
    return df.withColumn("ppg_preprocessed", F.lit(True))


def resample(window: Column, n: int = 200) -> Column:
    @F.pandas_udf("array<double>")
    def run(w: pd.Series) -> pd.Series:
        return by_length(w, lambda x: fourier_resample(x, n))

    return run(window)
