"""R peaks and signal quality of ECG windows, derived from the published methods and not equal to any library.

Peaks: band-pass 5 to 15 Hz, derivative, square, integration over 150 ms, two running thresholds
(Pan and Tompkins, 1985). Quality: three levels from the share of power in the QRS band, the
share of slow drift and the kurtosis, by simple rules in the manner of Zhao and Zhang, 2018.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from wavelane.functions.arrays import all_finite
from wavelane.functions.signal import butterworth_band, forward_backward
from wavelane.operators.labels import label_cascade

LEVELS = ("Unacceptable", "Barely acceptable", "Excellent")


def clean_ecg(x: np.ndarray, fs: float) -> np.ndarray:
    return forward_backward(*butterworth_band(5.0, 15.0, fs), x)


def beat_power(z: np.ndarray, fs: float) -> np.ndarray:
    """Squared slope of each row, averaged over 150 ms; beyond the edges it counts as 0."""
    width, n = max(1, round(0.15 * fs)), z.shape[1]
    sums = np.pad(np.cumsum(np.gradient(z, axis=1) ** 2, axis=1), ((0, 0), (1, 0)))
    low = np.arange(n) - width // 2
    return (sums[:, np.clip(low + width, 0, n)] - sums[:, np.clip(low, 0, n)]) / width


def r_peaks(z: np.ndarray, power: np.ndarray, fs: float) -> np.ndarray:
    """Places of R peaks of a cleaned window: candidates 200 ms apart that pass a quarter of the way from noise to signal level; a gap of
    1.66 times the mean interval is searched again at half of that."""
    top = np.flatnonzero((power[1:-1] >= power[:-2]) & (power[1:-1] > power[2:])) + 1
    height = power.tolist()
    apart: list[int] = []
    for k in top.tolist():
        if apart and k - apart[-1] < 0.2 * fs:
            if height[k] > height[apart[-1]]:
                apart[-1] = k
        else:
            apart.append(k)
    if not apart:
        return np.zeros(0, int)
    learn = power[: max(1, round(2 * fs))]
    signal, noise = float(learn.max() / 3), float(learn.mean() / 2)
    beats: list[int] = []
    passed: list[int] = []
    for k in apart:
        level = noise + 0.25 * (signal - noise)
        if len(beats) > 1 and k - beats[-1] > 1.66 * (beats[-1] - beats[-9:][0]) / (len(beats[-9:]) - 1):
            again = [m for m in passed if m > beats[-1] + 0.2 * fs and height[m] > level / 2]
            if again:
                best = max(again, key=height.__getitem__)
                beats.append(best)
                signal = 0.25 * height[best] + 0.75 * signal
        if height[k] > level:
            beats.append(k)
            passed = []
            signal = 0.125 * height[k] + 0.875 * signal
        else:
            passed.append(k)
            noise = 0.125 * height[k] + 0.875 * noise
    reach = max(1, round(0.1 * fs))
    found = [max(0, k - reach) + int(z[max(0, k - reach) : k + reach + 1].argmax()) for k in beats]
    return np.unique(np.array(found, int))


def ecg_quality(x: np.ndarray, fs: float) -> np.ndarray:
    """The quality of each row."""
    centred = x - x.mean(axis=1, keepdims=True)
    spectrum = np.abs(np.fft.rfft(centred, axis=1)) ** 2
    freq = np.fft.rfftfreq(x.shape[1], 1 / fs)
    power = lambda a, b: spectrum[:, (freq >= a) & (freq < b)].sum(axis=1)
    total, spread = power(0.01, 40.0), x.std(axis=1)
    kurtosis = np.where(spread > 0, (centred**4).mean(axis=1) / np.maximum(spread, 1e-150) ** 4, 0.0)
    drift = power(0.01, 1.0) / np.maximum(total, 1e-300)
    marks = (power(5, 15) / np.maximum(power(5, 40), 1e-300) > 0.3).astype(int) + (1 - drift > 0.6) + (kurtosis > 4)
    return np.array(LEVELS, object)[np.where(total <= 0, 0, np.maximum(marks - 1, 0))]


def ecg_beats(window: Column, fs: float) -> Column:
    """Struct (peaks, quality, failed) of an ECG window; ``failed``: the search for beats was impossible. Without peaks where the window is
    null, empty or not finite, or the search has failed. Windows of one length are filtered together."""

    @F.pandas_udf("peaks array<double>, quality string, failed boolean")
    def run(w: pd.Series) -> pd.DataFrame:
        out: list[tuple] = [(None, None, False)] * len(w)
        groups: dict[int, list[int]] = {}
        for k, x in enumerate(w):
            if x is not None and len(x) and np.isfinite(np.asarray(x, float)).all():
                groups.setdefault(len(x), []).append(k)
        for rows in groups.values():
            for low in range(0, len(rows), 256):
                own = rows[low : low + 256]
                x = np.stack([np.asarray(w.iloc[k], float) for k in own])
                try:
                    z = clean_ecg(x, fs)
                    found = [(r_peaks(a, p, fs).astype(float), q, False) for a, p, q in zip(z, beat_power(z, fs), ecg_quality(x, fs), strict=True)]
                except (ValueError, IndexError, FloatingPointError, np.linalg.LinAlgError):
                    found = [(None, None, True)] * len(own)
                for k, answer in zip(own, found, strict=True):
                    out[k] = answer
        return pd.DataFrame(out, columns=["peaks", "quality", "failed"])

    return run(window)


def label_windows(windows: DataFrame, ecg: str, fs: float = 130.0, **rules) -> DataFrame:
    """Windows with beat labels from their ECG samples, by the cascade of :func:`label_cascade`."""
    own = windows.withColumn("_b", ecg_beats(F.col(ecg), fs))
    peaks = F.coalesce(F.col("_b.peaks"), F.array().cast("array<double>"))
    out = label_cascade(own, F.coalesce(F.size(ecg), F.lit(0)), F.coalesce(~all_finite(F.col(ecg)), F.lit(False)), peaks, fs, F.col("_b.quality"), failed=F.col("_b.failed"), **rules)
    return out.drop("_b")
