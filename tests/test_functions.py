"""Array functions, filters and estimators on signals whose answers are known."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelane.functions import arrays as A, estimators as E, signal as S


def tone(freq, n=800, fs=100.0):
    t = np.arange(n) / fs
    return np.sin(2 * np.pi * freq * t) + 0.3 * np.sin(4 * np.pi * freq * t - 0.6)


def test_butterworth_constants():
    b, a = S.butterworth_band(0.7, 3.5, 100.0)
    assert np.allclose(b, [0.00686787, 0, -0.01373573, 0, 0.00686787], atol=1e-8)
    assert np.allclose(a, [1, -3.73408935, 5.25013525, -3.29570246, 0.77973946], atol=1e-8)
    z = np.exp(2j * np.pi * np.array([0.7, 3.5]) / 100)
    assert np.allclose(np.abs(np.polyval(b, z) / np.polyval(a, z)), 1 / np.sqrt(2), atol=1e-6)


def test_bessel_constants():
    b, a = S.bessel_low(0.5)
    assert np.allclose(b, [0.14494659, 0.43483978, 0.43483978, 0.14494659], atol=1e-7)
    assert np.allclose(a, [1, 0.00483125, 0.15957274, -0.00483125], atol=1e-7)


def test_zero_phase_keeps_tones_and_removes_lines():
    x = tone(1.5)[None] + np.linspace(0, 50, 800)
    y = S.pulse_band(x, 100.0)[0]
    inner = slice(200, 600)
    assert np.corrcoef(y[inner], np.sin(2 * np.pi * 1.5 * np.arange(800) / 100)[inner])[0, 1] > 0.95
    assert abs(y[inner].mean()) < 0.05
    with pytest.raises(ValueError):
        S.forward_backward(*S.butterworth_band(0.7, 3.5, 100.0), np.zeros((1, 15)))


@pytest.mark.parametrize("n", [200, 400, 1000])
def test_resample_reproduces_tones(n):
    x = np.cos(2 * np.pi * 12 * np.arange(800) / 800)
    assert np.allclose(S.fourier_resample(x[None], n)[0], np.cos(2 * np.pi * 12 * np.arange(n) / n), atol=1e-12)


@pytest.mark.parametrize("name", sorted(E.ROW_ESTIMATORS))
@pytest.mark.parametrize("bpm", [66, 90, 120])
def test_estimators_find_tones(name, bpm):
    got = E.estimate_one(name, tone(bpm / 60), 100.0)
    assert abs(got - bpm) < (6 if name in ("heartpy", "neurokit", "qppgfast", "pwd") else 3)


@pytest.mark.parametrize("name", sorted(E.ROW_ESTIMATORS))
def test_estimators_answer_nan(name):
    for x in (np.zeros(49), np.array([]), np.full(100, np.nan), None, np.r_[tone(1.5), np.inf]):
        assert np.isnan(E.estimate_one(name, x, 100.0))
    assert np.isnan(E.estimate_one(name, np.zeros(800), 100.0)) or name == "autocorr"
    if name in ("fft", "autocorr"):
        assert np.isnan(E.estimate_one(name, np.zeros(8193), 100.0))


def test_spectrum_and_lags_keep_the_mean():
    """By plain sums, on windows far from 0: no estimator takes the mean off unless it is asked to."""
    rng = np.random.default_rng(4)
    for n, fs, offset in ((64, 8.0, 5.0), (200, 25.0, -40.0), (64, 8.0, 0.0)):
        x = tone(1.3, n, fs) + offset + 0.1 * rng.normal(size=n)
        w = x * np.hanning(n)
        t = np.arange(n)
        bins = [k for k in range(4097) if 0.5 <= k * fs / 8192 <= 3.0]
        size = {k: abs(np.sum(w * np.exp(-2j * np.pi * k * t / 8192))) for k in range(bins[0] - 1, bins[-1] + 2)}
        k = max(bins, key=lambda b: size[b])
        bend = size[k - 1] - 2 * size[k] + size[k + 1]
        hr = 60 * (k + np.clip(0.5 * (size[k - 1] - size[k + 1]) / bend, -0.5, 0.5)) * fs / 8192
        assert np.isclose(E.estimate_one("fft", x, fs), hr if 30 <= hr <= 180 else np.nan, atol=1e-6, equal_nan=True)
        lags = range(int(np.ceil(fs / 3)), int(2 * fs) + 1)
        r = {k: float(w[: n - k] @ w[k:]) for k in range(lags[0] - 1, lags[-1] + 2)}
        k = max(lags, key=lambda b: r[b])
        bend = r[k - 1] - 2 * r[k] + r[k + 1]
        hr = 60 * fs / (k + np.clip(0.5 * (r[k - 1] - r[k + 1]) / bend, -0.5, 0.5))
        assert np.isclose(E.estimate_one("autocorr", x, fs), hr if 30 <= hr <= 180 else np.nan, atol=1e-6, equal_nan=True)
        assert abs(E.spectral(x[None], fs, centre=True)[0] - 78) < 4


def pulse(beats, fs, seconds, dicrotic=0.35, noise=0.0):
    """A pulse wave with a steep rise and a dicrotic wave after it."""
    t = np.arange(int(fs * seconds)) / fs
    rise = lambda at, width: np.exp(-(((t - at) / width) ** 2))
    x = sum(rise(b, 0.09) + dicrotic * rise(b + 0.3, 0.08) for b in beats)
    return x + noise * np.random.default_rng(7).normal(size=len(t))


@pytest.mark.parametrize("name", ["pwd", "qppgfast", "msptd"])
@pytest.mark.parametrize("bpm", [48, 60, 72])
def test_beats_of_pulse_waves(name, bpm):
    gap = 60 / bpm
    beats = np.arange(0.5, 9.5, gap)
    for x in (pulse(beats, 100.0, 10, 0.0), pulse(beats, 100.0, 10, 0.0, 0.002)):
        assert abs(E.estimate_one(name, x, 100.0) - bpm) < 2.5
    # A beat that is left out makes one interval of twice the length, which the median doesn't see.
    short = np.delete(beats, 4)
    if name != "msptd":
        assert abs(E.estimate_one(name, pulse(short, 100.0, 10, 0.0), 100.0) - bpm) < 2.5


def test_dicrotic_waves_are_no_beats():
    beats = np.arange(0.5, 9.5, 60 / 55)
    assert abs(E.estimate_one("pwd", pulse(beats, 100.0, 10, 0.3), 100.0) - 55) < 2.5


def test_rises_and_places_apart():
    s = np.array([[0, 1, 2, 1, 1, 3, 2], [5, 4, 3, 2, 1, 0, 0], [0, 0, 1, 1, 2, 3, 4]], float)
    assert [a.tolist() for a in E.rises(s)] == [[0, 0, 2, 2], [0, 4, 1, 3], [2, 5, 2, 6]]
    row, at, value = np.array([0, 0, 0, 0, 1, 1]), np.array([3, 5, 9, 20, 21, 22]), np.array([1, 2, 2, 5, 7, 7])
    assert E.apart(row, at, value, 4).tolist() == [1, 2, 3, 4] and E.apart(row, at, value, 5).tolist() == [1, 3, 4] and len(E.apart(row[:0], at[:0], value[:0], 4)) == 0


@pytest.mark.parametrize("name", ["pwd", "qppgfast"])
def test_pulse_rates_do_not_depend_on_scale_or_place(name):
    """The same rate for a pulse that is shifted in time, raised, scaled or drifts slowly, and for beats whose heights differ."""
    rng = np.random.default_rng(3)
    for bpm in (50, 66, 84, 100):
        for _ in range(5):
            beats = np.arange(rng.uniform(0, 0.6), 29.5, 60 / bpm)
            x = pulse(beats, 100.0, 30, 0.2 if bpm < 80 else 0.0, 0.002)
            assert abs(E.estimate_one(name, x, 100.0) - bpm) < 2
            for other in (x + 40, x * 1e-3, x * 2e4 - 7, x + 0.3 * np.sin(np.arange(3000) / 700)):
                assert abs(E.estimate_one(name, other, 100.0) - bpm) < 2.5
            uneven = sum(pulse([b], 100.0, 30, 0.0) * h for b, h in zip(beats, rng.uniform(0.7, 1.3, len(beats)), strict=True))
            assert abs(E.estimate_one(name, uneven, 100.0) - bpm) < 2.5


def test_onsets_lie_at_the_feet_of_known_beats():
    beats = np.arange(1.0, 19, 0.8)
    row, at = E.onsets(np.stack([pulse(beats, 100.0, 20, 0.2), pulse(beats + 0.31, 100.0, 20, 0.2)]), 100.0)
    for k, shift in ((0, 0.0), (1, 0.31)):
        feet = at[row == k] / 100
        assert len(feet) == len(beats) and np.abs(feet - (beats + shift - 0.22)).max() < 0.1


def test_rows_are_alike_alone_and_together():
    rng = np.random.default_rng(9)
    x = [tone(rng.uniform(0.8, 2.5), n, 25.0) + 0.3 * rng.normal(size=n) for n in rng.choice([64, 100, 200], 60)]
    for name in E.ROW_ESTIMATORS:
        together = E.answers(E.ROW_ESTIMATORS[name], x, 25.0)
        assert np.allclose(together, [E.estimate_one(name, w, 25.0) for w in x], equal_nan=True), name


def test_scalogram_by_definition():
    rng = np.random.default_rng(5)
    for _ in range(20):
        x = rng.normal(size=rng.integers(10, 60))
        n = len(x)
        table = {s: [p for p in range(s, n - s) if x[p] > x[p - s] and x[p] > x[p + s]] for s in range(1, (n + 1) // 2)}
        best = max(table, key=lambda s: (len(table[s]), -s))
        peaks = [p for p in range(n) if all(p in table[s] for s in range(1, best + 1))]
        assert np.flatnonzero(E.scalogram_peaks(x[None], 10.0)[0]).tolist() == sorted({max(0, p - 1) + int(np.argmax(x[max(0, p - 1) : p + 2])) for p in peaks})


def test_missing_samples():
    x = tone(1.5)
    holes = np.insert(x, [100, 300, 301], np.nan)
    assert E.estimate_one("neurokit", holes, 100.0) == E.estimate_one("neurokit", x, 100.0)
    assert np.isnan(E.estimate_one("neurokit", np.r_[x[:49], [np.nan] * 20], 100.0)) and np.isnan(E.estimate_one("fft", holes, 100.0))


def test_registry(spark):
    E.register_estimator("Always", lambda x, fs: 70.0)
    df = spark.createDataFrame([([1.0] * 60,), ([1.0] * 10,), (None,)], "w array<double>")
    got = [r.h for r in df.select(E.heart_rate("ALWAYS", F.col("w"), 8.0).alias("h")).collect()]
    assert got == [70.0, None, None]
    del E.ESTIMATORS["always"]
    with pytest.raises(ValueError):
        E.heart_rate("none", F.col("w"), 8.0)


def test_array_functions(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([([1.0, 2.0, 4.0], [1.0, 2.0, 4.00001]), ([nan, 1.0], [nan, 1.0]), ([1.0], [1.0, 2.0]), ([5.0, 5.0], [inf, 1.0])], "a array<double>, b array<double>")
    rows = df.select(A.allclose(F.col("a"), F.col("b")).alias("same"), A.all_finite(F.col("b")).alias("finite"), A.zscore(F.col("a")).alias("z"), A.detrend(F.col("a")).alias("d")).collect()
    assert [r.same for r in rows] == [True, True, False, False]
    assert [r.finite for r in rows] == [True, False, True, False]
    assert rows[3].z == [0.0, 0.0] and abs(sum(rows[0].d)) < 1e-12 and rows[2].d == [0.0]
    one = spark.createDataFrame([([3, 5, 9, 20], [0.0] * 3 + [1.0, 0.0, 2.0, 0.0, 0.0, 0.0, 1.5] + [0.0] * 10 + [4.0])], "p array<int>, x array<double>")
    assert one.select(A.merge_close(F.col("p"), F.col("x"), 4).alias("m")).first().m == np.array([3, 5, 9, 20])[E.apart(np.zeros(4, int), np.array([3, 5, 9, 20]), np.array(one.first().x)[[3, 5, 9, 20]], 4)].tolist()
    assert one.select(A.one_hot_label(F.array(*map(F.lit, (0, 1, 1)))).alias("l"), A.clock(F.lit(90061.7)).alias("c"), A.run_label(F.lit("Earring_2"), F.lit("ppg_ir")).alias("r")).first() == (1, "25:01:01", "earring2_ir")
    assert A.subset_columns(["ring", "watch"], ["green", "accel"], [1]) == ["ppg_watch_green", "ppg_watch_accel"]
    with pytest.raises(ValueError):
        A.subset_columns(["ring"], [], [3])


@pytest.mark.parametrize("hr,keep", [(29.9, False), (30.0, True), (210.0, True), (210.1, False), (float("nan"), False), (None, False)])
def test_model_input(spark, hr, keep):
    df = spark.createDataFrame([(hr, [1.0])], "hr double, x array<double>")
    assert df.where(A.model_input(F.col("hr"), [F.col("x")])).count() == int(keep)


def test_filters_leave_bad_windows_null(spark):
    df = spark.createDataFrame([(1, [float(x) for x in tone(1.2)]), (2, [1.0] * 10), (3, [float("nan")] * 100), (4, None)], "k int, w array<double>")
    got = {r.k: r.f for r in df.select("k", S.bandpass(F.col("w"), 100.0).alias("f")).collect()}
    assert len(got[1]) == 800 and got[2] is None and got[3] is None and got[4] is None


def spikes(bpm, fs=130.0, seconds=8, noise=0.02):
    t = np.arange(int(fs * seconds)) / fs
    beats = np.arange(0.4, seconds - 0.2, 60 / bpm)
    x = sum(np.exp(-(((t - b) / 0.015) ** 2)) + 0.2 * np.exp(-(((t - b - 0.25) / 0.05) ** 2)) for b in beats)
    return 1000 * (x + noise * np.random.default_rng(1).normal(size=len(t))), beats


@pytest.mark.parametrize("bpm", [50, 75, 110, 160])
def test_r_peaks(spark, bpm):
    from wavelane.functions import ecg

    x, beats = spikes(bpm)
    z = ecg.clean_ecg(x[None], 130.0)
    found = ecg.r_peaks(z[0], ecg.beat_power(z, 130.0)[0], 130.0) / 130.0
    assert len(found) == len(beats) and np.abs(found - beats).max() < 0.03
    df = spark.createDataFrame([(1, x.tolist()), (2, [0.0] * 1040), (3, [float("nan")] * 1040), (4, [1.0] * 10), (5, None)], "k int, e array<double>")
    rows = {r.k: r for r in ecg.label_windows(df, "e").collect()}
    assert rows[1].valid and abs(rows[1].hr - bpm) < 2 and rows[1].n_peaks == len(beats)
    assert [rows[k].reason for k in (2, 3, 4, 5)] == ["too_few_beats", "contains_nan", "too_short", "too_short"]


def test_a_search_that_fails_is_an_exception(spark):
    from wavelane.functions import ecg
    from wavelane.operators.labels import label_summary

    df = spark.createDataFrame([(1, [1.0, 2.0] * 7), (2, [1.0, 2.0] * 5)], "k int, e array<double>")
    got = ecg.label_windows(df, "e", min_samples=5)
    assert {r.k: r.reason for r in got.collect()} == {1: "exception", 2: "exception"}
    assert label_summary(got, []).first().n_exception == 2
