"""Heart-rate estimators of windows, and their registry.

Each takes windows of one length, a row each, and a rate, and gives beats a minute, or NaN: for fewer than
50 samples, for samples that are not finite, and where nothing plausible is found. They run as Arrow batches: filters,
spectra, lags and scalograms over all rows of a batch that have one length; only the search for beats is row by row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from wavelane.functions.signal import bessel_low, butterworth_band, forward_backward

LEAST_SAMPLES, PADDED = 50, 8192
#: Rows that are worked on at once.
ROWS = 256
#: Intervals between beats, in seconds, that count: those of 200 to 30 beats a minute.
INTERVALS = (60 / 200, 60 / 30)


def _inside(hr, low: float, high: float):
    """Rates inside the closed band; NaN for others."""
    hr = np.asarray(hr, float)
    with np.errstate(invalid="ignore"):
        return np.where((hr >= low) & (hr <= high), hr, np.nan)


def _vertex(y: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Of each row the offset of the parabola's vertex through the value at k and its neighbours, half a step at most; an edge is its own neighbour."""
    row = np.arange(len(y))
    before, at, after = y[row, np.maximum(k - 1, 0)], y[row, k], y[row, np.minimum(k + 1, y.shape[1] - 1)]
    bend = before - 2 * at + after
    flat = np.abs(bend) <= 1e-10
    return np.where(flat, 0.0, np.clip(0.5 * (before - after) / np.where(flat, 1.0, bend), -0.5, 0.5))


def _from_peaks(peaks: np.ndarray, fs: float, low: float, high: float, ibi: tuple[float, float] | None = None, least: int = 1) -> float:
    beats = np.diff(np.asarray(peaks, float)) / fs
    if ibi:
        beats = beats[(beats >= ibi[0]) & (beats <= ibi[1])]
    return float(_inside(60 / np.median(beats), low, high)) if len(beats) >= least and np.median(beats) > 0 else np.nan


def spectral(x: np.ndarray, fs: float, centre: bool = False) -> np.ndarray:
    """Largest magnitude between 0.5 and 3 Hz of the Hann-weighted, zero-padded spectrum; ``centre``: of the window less its mean."""
    if x.shape[1] > PADDED:
        return np.full(len(x), np.nan)
    freq = np.fft.rfftfreq(PADDED, 1 / fs)
    band = np.flatnonzero((freq >= 30 / 60) & (freq <= 180 / 60))
    if not len(band):
        return np.full(len(x), np.nan)
    x = x - x.mean(axis=1, keepdims=True) if centre else x
    size = np.abs(np.fft.rfft(x * np.hanning(x.shape[1]), PADDED, axis=1))
    k = band[size[:, band].argmax(axis=1)]
    k = np.where(size[np.arange(len(x)), k] > 0, k, 0)
    return _inside(60 * (k + _vertex(size, k)) * fs / PADDED, 30, 180)


def autocorrelation(x: np.ndarray, fs: float, centre: bool = False) -> np.ndarray:
    """Largest autocorrelation of the Hann-weighted window at lags of a third of a second to two; ``centre``: of the window less its mean."""
    n = x.shape[1]
    low, high = int(np.ceil(fs * 60 / 180)), min(int(np.floor(fs * 60 / 30)), PADDED - 1)
    if n > PADDED or low >= high:
        return np.full(len(x), np.nan)
    w = (x - x.mean(axis=1, keepdims=True) if centre else x) * np.hanning(n)
    size = 1 << int(np.ceil(np.log2(2 * n)))
    r = np.fft.irfft(np.abs(np.fft.rfft(w, size, axis=1)) ** 2, size, axis=1)[:, :n]
    r = np.pad(r, ((0, 0), (0, max(0, high + 2 - n))))  # no products beyond the window's length
    k = low + r[:, low : high + 1].argmax(axis=1)
    return _inside(60 * fs / (k + _vertex(r, k)), 30, 180)


def scalogram_peaks(x: np.ndarray, fs: float) -> np.ndarray:
    """Of each row, as a mask: places that exceed their neighbours at every scale up to the one with the most local maxima, each
    moved to the largest value within a twentieth of a second."""
    rows, n = x.shape
    scales = range(1, (n + 1) // 2)
    if n < 10:
        return np.zeros(x.shape, bool)

    def above(s: int) -> np.ndarray:
        out = np.zeros(x.shape, bool)
        out[:, s : n - s] = (x[:, s : n - s] > x[:, : n - 2 * s]) & (x[:, s : n - s] > x[:, 2 * s :])
        return out

    best = np.stack([above(s).sum(axis=1) for s in scales], axis=1).argmax(axis=1) + 1
    peaks, alive = np.zeros(x.shape, bool), np.ones(x.shape, bool)
    for s in range(1, int(best.max()) + 1):
        alive &= above(s)
        own = best == s
        peaks[own] = alive[own]
    reach = max(1, int(np.ceil(fs * 0.05)))
    row, at = np.nonzero(peaks)
    around = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (reach, reach)), constant_values=-np.inf), 2 * reach + 1, axis=1)
    out = np.zeros(x.shape, bool)
    out[row, at - reach + around[row, at].argmax(axis=1)] = True
    return out


def multiscale(x: np.ndarray, fs: float) -> np.ndarray:
    """Peaks by scalogram in sub-windows of six seconds with a fifth overlapping; mean of the intervals that count."""
    size, n = int(6 * fs), x.shape[1]
    starts = [0]
    if n > size:
        starts = list(range(0, n - size, max(1, int(size * (1 - 0.2)))))
        if starts[-1] + size < n:
            starts.append(n - size)
    found = np.zeros(x.shape, bool)
    for s in starts:
        found[:, s : s + size] |= scalogram_peaks(x[:, s : s + size], fs)
    row, at = np.nonzero(found)
    beats, same = np.diff(at) / fs, row[1:] == row[:-1]
    ok = same & (beats >= INTERVALS[0]) & (beats <= INTERVALS[1])
    count = np.bincount(row[1:][ok], minlength=len(x))
    total = np.bincount(row[1:][ok], beats[ok], len(x))
    return _inside(np.where(count > 0, 60 * count / np.maximum(total, 1e-300), np.nan), 30, 200)


def apart(row: np.ndarray, at: np.ndarray, value: np.ndarray, gap: float) -> np.ndarray:
    """Numbers of the places, sorted by row, that are left when no two of a row are closer than the gap: as long as there are
    closer ones, the lower of each two goes, and of equals the later. One window at a time in a plan: arrays.merge_close."""
    left = np.arange(len(at))
    while True:
        close = (row[left][1:] == row[left][:-1]) & (np.diff(at[left]) < gap)
        if not close.any():
            return left
        lower = value[left][1:] <= value[left][:-1]
        gone = np.zeros(len(left), bool)
        gone[1:] |= close & lower
        gone[:-1] |= close & ~lower
        left = left[~gone]


def _median_rate(row: np.ndarray, at: np.ndarray, rows: int, fs: float) -> np.ndarray:
    """Beats a minute by the median of each row's intervals that count, of places sorted by row."""
    beats, same = np.diff(at) / fs, row[1:] == row[:-1]
    ok = same & (beats >= INTERVALS[0]) & (beats <= INTERVALS[1])
    middle = pd.Series(beats[ok]).groupby(row[1:][ok]).median()
    out = np.full(rows, np.nan)
    out[middle.index.to_numpy(dtype=np.int64)] = 60 / middle.to_numpy()
    return _inside(out, 30, 200)


def _around(row: np.ndarray, at: np.ndarray, value: np.ndarray, rows: int, n: int, fs: float) -> np.ndarray:
    """(row, second): the median, over five seconds around, of the largest value in each second that has any."""
    top = np.full((rows, int(n / fs) + 1), -np.inf)
    np.maximum.at(top, (row, (at / fs).astype(np.int64)), value)
    wide = np.pad(np.where(top > -np.inf, top, np.nan), ((0, 0), (2, 2)), constant_values=np.nan)
    near = np.sort(np.lib.stride_tricks.sliding_window_view(wide, 5, axis=1), axis=2)  # NaN goes last
    count = (~np.isnan(near)).sum(axis=2)
    take = lambda k: np.take_along_axis(near, np.maximum(k, 0)[..., None], axis=2)[..., 0]
    return np.where(count > 0, (take((count - 1) // 2) + take(count // 2)) / 2, np.inf)


def rises(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, foot and top of every stretch in which the samples rise, in order."""
    up = np.pad(np.diff(s, axis=1) > 0, ((0, 0), (1, 1))).astype(np.int8)
    turn = np.diff(up, axis=1)
    row, foot = np.nonzero(turn == 1)
    return row, foot, np.nonzero(turn == -1)[1]


#: A rise counts from 0.4 to 2.5 times the height of rises around it; one within 0.3 s of the last top and below 0.6 of its height is a dicrotic wave.
LOWEST, HIGHEST, DICROTIC, SECOND_WAVE = 0.4, 2.5, 0.3, 0.6


def delineator(x: np.ndarray, fs: float) -> np.ndarray:
    """Tops of pulse waves (after Li and others, 2010) as rises that are filtered in steps.

    After a Bessel low-pass at 25 Hz and a mean of five samples, all rises from foot to top are taken from the slope's sign. What is typical is the
    median of the largest rises in the seconds around, so there is no threshold that moves from beat to beat. Where a threshold of the
    paper has to find its way back after a loss of signal, this one has nothing to find; where beats alternate strongly, it may keep what
    the paper's drops. The answer is the median of the intervals that count.
    """
    smooth = forward_backward(*bessel_low(min(0.99, max(0.01, 25 * 2 / fs))), x)
    wide = np.pad(smooth, ((0, 0), (2, 2)), mode="edge")
    s = np.lib.stride_tricks.sliding_window_view(wide, 5, axis=1).mean(axis=2)
    row, foot, top = rises(s)
    height = s[row, top] - s[row, foot]
    usual = _around(row, top, height, *x.shape, fs)[row, (top / fs).astype(np.int64)]
    ok = (height > LOWEST * usual) & (height < HIGHEST * usual)
    row, foot, top, height = row[ok], foot[ok], top[ok], height[ok]
    after = np.zeros(len(row), bool)
    after[1:] = (row[1:] == row[:-1]) & (foot[1:] - top[:-1] < DICROTIC * fs) & (height[1:] < SECOND_WAVE * height[:-1])
    row, top = row[~after], top[~after]
    left = apart(row, top, x[row, top], fs * INTERVALS[0])
    return _median_rate(row[left], top[left], len(x), fs)


#: Seconds over which rises are summed, and in which an onset has no other (Vest and others, 2018); the shares of the usual sum at which a
#: beat begins to count and at which its onset lies.
SUM, BLIND, CROSSING, ONSET = 0.17, 0.34, 1 / 3, 0.02


def onsets(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and onsets of beats by the slope-sum function: the sum of the rises of the last 0.17 s, over samples scaled to -2000 to 2000.

    A beat is a stretch of it above a third of what is usual in the seconds around; its onset is the last place before at which the sum is next to
    nothing. The usual sum is a median of seconds on both sides, so that nothing has to be learned from a beginning that may be bad; a method
    that learns as it goes may differ at a window's start.
    """
    low, span = x.min(axis=1, keepdims=True), np.ptp(x, axis=1, keepdims=True)
    scaled = (x - low) / np.where(span > 1e-10, span, 1) * 4000 - 2000
    up = np.maximum(np.diff(scaled, axis=1, prepend=scaled[:, :1]), 0)
    total = np.cumsum(up, axis=1)
    size = max(1, int(fs * SUM))
    sums = total - np.pad(total, ((0, 0), (size, 0)))[:, : x.shape[1]]
    row, at = np.nonzero(sums > 0)
    usual = _around(row, at, sums[row, at], *x.shape, fs)[:, (np.arange(x.shape[1]) / fs).astype(np.int64)]
    over = np.diff(np.pad((sums > CROSSING * usual).astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(over == 1)
    end = np.nonzero(over == -1)[1]
    if not len(row):
        return row, begin
    flat = np.append(sums.ravel(), 0.0)
    peak = np.maximum.reduceat(flat, np.stack([row * x.shape[1] + begin, row * x.shape[1] + end], 1).ravel())[::2]
    left = apart(row, begin, peak, fs * BLIND)
    quiet = np.maximum.accumulate(np.where(sums <= ONSET * usual, np.arange(x.shape[1]), 0), axis=1)
    return row[left], quiet[row[left], begin[left]]


def slope_sum(x: np.ndarray, fs: float) -> np.ndarray:
    """Median of the intervals between beats, each the largest sample from one onset to the next; the first onset of a window is left out."""
    row, at = onsets(x, fs)
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    many = np.bincount(row, minlength=len(x))[row] > 1
    row, at = row[~(first & many)], at[~(first & many)]
    # All samples numbered by the last onset at or before them in their row.
    mark = np.zeros(x.shape, np.int64)
    mark[row, at] = np.arange(1, len(row) + 1)
    own = np.maximum.accumulate(mark, axis=1).ravel()
    inside = np.flatnonzero(own)
    top = pd.Series(x.ravel()[inside], index=inside).groupby(own[inside]).idxmax().to_numpy(dtype=np.int64)
    row, top = top // x.shape[1], top % x.shape[1]
    left = apart(row, top, x[row, top], fs * INTERVALS[0])
    return _median_rate(row[left], top[left], len(x), fs)


def two_averages(x: np.ndarray, fs: float) -> np.ndarray:
    """Systolic peaks by two moving averages of the squared, clipped signal (Elgendi and others, 2013): 111 ms against 667 ms,
    blocks of 111 ms at least; derived from the paper, intervals of 0.3 to 2 s count."""
    z = forward_backward(*butterworth_band(0.5, min(8.0, 0.45 * fs), fs), x)
    q = np.maximum(z, 0) ** 2
    sums = np.pad(np.cumsum(q, axis=1), ((0, 0), (1, 0)))
    n, out = x.shape[1], np.full(len(x), np.nan)

    def mean(w: int) -> np.ndarray:
        """Centred means over w samples, those beyond the edges counting as 0."""
        low = np.arange(n) - w // 2
        return (sums[:, np.clip(low + w, 0, n)] - sums[:, np.clip(low, 0, n)]) / w

    peak_w, beat_w = max(1, round(0.111 * fs)), max(1, round(0.667 * fs))
    block = mean(peak_w) > mean(min(beat_w, n)) + 0.02 * q.mean(axis=1, keepdims=True)
    edge = np.diff(np.pad(block.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    for k in range(len(x)):
        peaks: list[int] = []
        for a, b in zip(np.flatnonzero(edge[k] == 1).tolist(), np.flatnonzero(edge[k] == -1).tolist(), strict=True):
            if b - a >= peak_w:
                p = a + int(z[k, a:b].argmax())
                if not peaks or (p - peaks[-1]) / fs > 0.3:
                    peaks.append(p)
        out[k] = _from_peaks(np.array(peaks, int), fs, 30, 220, ibi=(0.3, 2.0), least=2)
    return out


def enhanced(x: np.ndarray, fs: float) -> np.ndarray:
    """Peaks above a moving mean of 0.75 s that is raised until the rate is plausible and its intervals vary least; values scaled to
    0 to 1024 and squared twice to lift peaks. Derived from public descriptions of the method."""
    low, span = x.min(axis=1, keepdims=True), np.ptp(x, axis=1, keepdims=True)
    flat = span[:, 0] <= 0
    z = (x - low) / np.where(span > 0, span, 1) * 1024
    for _ in range(2):
        z = z**2
        z = (z - z.min(axis=1, keepdims=True)) / np.maximum(np.ptp(z, axis=1, keepdims=True), 1e-300) * 1024
    half = round(0.375 * fs)
    sums = np.pad(np.cumsum(np.pad(z, ((0, 0), (half, half)), mode="edge"), axis=1), ((0, 0), (1, 0)))
    base = (sums[:, 2 * half + 1 :] - sums[:, : -2 * half - 1]) / (2 * half + 1)
    best, rate = np.full(len(x), np.inf), np.full(len(x), np.nan)
    for lift in (5, 10, 15, 20, 25, 30, 40, 50, 60, 70, 80, 90, 100, 110, 120, 150, 200, 300):
        inside = z > base * (1 + lift / 100)
        edge = np.diff(np.pad(inside.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, begin = np.nonzero(edge == 1)
        if not len(row):
            continue
        # The first largest value of each stretch above the line, all rows in one flat array.
        flat_z = np.where(inside, z, -1.0).ravel()
        first = row * x.shape[1] + begin
        size = np.repeat(np.arange(len(first)), np.diff(np.append(first, flat_z.size)))
        top = np.maximum.reduceat(flat_z, first)
        hit = np.flatnonzero(flat_z[first[0] :] == top[size]) + first[0]
        peak = hit[np.searchsorted(hit, first)] % x.shape[1]
        beats, same = np.diff(peak) / fs, row[1:] == row[:-1]
        count = np.bincount(row[1:][same], minlength=len(x))
        mean = np.bincount(row[1:][same], beats[same], len(x)) / np.maximum(count, 1)
        spread = np.sqrt(np.maximum(np.bincount(row[1:][same], (beats[same] - mean[row[1:][same]]) ** 2, len(x)) / np.maximum(count, 1), 0))
        hr = 60 / np.where(mean > 0, mean, np.inf)
        better = (count > 1) & (hr >= 40) & (hr <= 180) & (spread < best)
        best, rate = np.where(better, spread, best), np.where(better, hr, rate)
    return np.where(flat, np.nan, _inside(rate, 30, 200))


#: Estimators of rows by name.
ROW_ESTIMATORS: dict[str, Callable[[np.ndarray, float], np.ndarray]] = {
    "fft": spectral, "autocorr": autocorrelation, "msptd": multiscale, "pwd": delineator, "qppgfast": slope_sum, "neurokit": two_averages, "heartpy": enhanced,
}
#: Estimators that leave missing samples (NaN or null) out; for the others such a window has no answer.
DROP_MISSING = {"neurokit"}
#: Estimators of one window that have been registered.
ESTIMATORS: dict[str, Callable[[np.ndarray, float], float]] = {}


def register_estimator(name: str, estimator: Callable[[np.ndarray, float], float]) -> None:
    """Adds an estimator: a function of one window's samples and the rate to beats a minute or NaN."""
    ESTIMATORS[name.lower()] = estimator


def _each(estimator: Callable[[np.ndarray, float], float]) -> Callable[[np.ndarray, float], np.ndarray]:
    """An estimator of one window as one of rows; its errors are NaN."""

    def run(x: np.ndarray, fs: float) -> np.ndarray:
        out = np.full(len(x), np.nan)
        for k, w in enumerate(x):
            try:
                out[k] = estimator(w, fs)
            except (ValueError, IndexError, ZeroDivisionError, FloatingPointError):
                continue
        return out

    return run


def _of_rows(name: str) -> Callable[[np.ndarray, float], np.ndarray]:
    key = name.lower()
    if key in ESTIMATORS:
        return _each(ESTIMATORS[key])
    if key not in ROW_ESTIMATORS:
        raise ValueError(f"unknown estimator {name!r}; known: {', '.join(sorted({*ESTIMATORS, *ROW_ESTIMATORS}))}")
    return ROW_ESTIMATORS[key]


def answers(estimator: Callable[[np.ndarray, float], np.ndarray], windows, fs: float, drop_missing: bool = False) -> np.ndarray:
    """An estimator's answers by the contract of all of them: NaN rather than an error. Windows of one length are worked on together."""
    if drop_missing:
        windows = [None if w is None else (x := np.asarray(w, float))[~np.isnan(x)] for w in windows]
    out, groups = np.full(len(windows), np.nan), {}
    for k, w in enumerate(windows):
        if w is not None and len(w) >= LEAST_SAMPLES:
            groups.setdefault(len(w), []).append(k)
    for rows in groups.values():
        for low in range(0, len(rows), ROWS):
            own = np.array(rows[low : low + ROWS])
            x = np.stack([np.asarray(windows[k], float) for k in own])
            good = np.isfinite(x).all(axis=1)
            if good.any():
                try:
                    out[own[good]] = estimator(x[good], fs)
                except ValueError:  # too short for a filter
                    continue
    return out


def estimate_one(name: str, x: np.ndarray | None, fs: float) -> float:
    return float(answers(_of_rows(name), [x], fs, name.lower() in DROP_MISSING)[0])


def heart_rate(name: str, window: Column, fs: float) -> Column:
    """An estimator by name (in any case) as a column expression over an array column; its NaN is null in the column."""
    own, drop = _of_rows(name), name.lower() in DROP_MISSING  # go with the plan: a worker doesn't know what was registered here

    @F.pandas_udf("double")
    def run(w: pd.Series) -> pd.Series:
        return pd.Series(answers(own, w.tolist(), fs, drop))

    return run(window)


def estimates(windows, keys: list[str], channels: list[str], names: list[str], fs: float):
    """Long table (keys, channel, algorithm, hr_est): each window once a channel, all estimators side by side."""
    known = [c for c in channels if c in windows.columns]
    if not known:
        raise ValueError(f"none of the channels {channels} is a column")
    own = windows.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("x")) for c in known))).alias("_c")).select(*keys, "_c.channel", "_c.x")
    for n in names:
        own = own.withColumn(f"_{n.lower()}", heart_rate(n, F.col("x"), fs))
    pairs = F.array(*(F.struct(F.lit(n.lower()).alias("algorithm"), F.col(f"_{n.lower()}").alias("hr_est")) for n in names))
    return own.withColumn("_e", F.explode(pairs)).select(*keys, "channel", "_e.algorithm", "_e.hr_est")
