"""Fold-parallel regressors against fits of one fold at a time."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelane.operators import networks as N, training as T
from wavelane.plans.fixtures import scratch


def made(seed=1, n=400, d=5, people=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    who = np.where(rng.random(n) < 0.4, 0, rng.integers(0, people, n))
    y = 70 + x @ np.arange(1, d + 1) + who + rng.normal(size=n)
    return x, who, y


def frame(spark, x, who, y):
    rows = [(k, f"P{p}", a.tolist(), float(b)) for k, (a, p, b) in enumerate(zip(x, who, y, strict=True))]
    return spark.createDataFrame(rows, "k long, who string, x array<double>, y double")


def test_ridge_is_a_fit_per_fold(spark):
    x, who, y = made()
    df = frame(spark, x, who, y)
    want = np.empty(len(y))
    for p in set(who):
        rest, own = who != p, who == p
        mean = x[rest].mean(axis=0)
        w = np.linalg.solve((x[rest] - mean).T @ (x[rest] - mean) + 2.5 * np.eye(5), (x[rest] - mean).T @ (y[rest] - y[rest].mean()))
        want[own] = y[rest].mean() + (x[own] - mean) @ w
    for parts in (1, 7):
        got = {r.k: r.predicted_bpm for r in T.leave_one_out_ridge(df.repartition(parts), "who", "x", "y", 5, 2.5).collect()}
        assert np.allclose([got[k] for k in range(len(y))], want, atol=1e-6)


def test_ridge_at_the_edges(spark):
    x, who, y = made(n=40)
    odd = [(900, "P0", None, 1.0), (901, "P0", [1.0] * 4, 1.0), (902, None, [1.0] * 5, 1.0), (903, "P1", [1.0] * 5, None), (904, "P1", [float("nan")] * 5, 80.0), (905, "P9", [0.0] * 5, None)]
    df = frame(spark, x, who, y).unionByName(spark.createDataFrame(odd, "k long, who string, x array<double>, y double"))
    got = {r.k: r.predicted_bpm for r in T.leave_one_out_ridge(df, "who", "x", "y", 5).collect()}
    base = {r.k: r.predicted_bpm for r in T.leave_one_out_ridge(frame(spark, x, who, y), "who", "x", "y", 5).collect()}
    assert len(got) == 46 and all(np.isclose(got[k], v) for k, v in base.items())
    assert got[900] is got[901] is got[902] is got[905] is None and got[903] is not None
    lone = T.leave_one_out_ridge(frame(spark, x, who * 0, y), "who", "x", "y", 5)
    assert lone.where("predicted_bpm IS NOT NULL").count() == 0 and T.leave_one_out_ridge(df.limit(0), "who", "x", "y", 5).count() == 0


@pytest.mark.parametrize("hidden", [0, 7])
def test_gradient_by_differences(hidden):
    rng = np.random.default_rng(hidden)
    model = T.TwoLayers(5, hidden)
    w = rng.normal(size=model.size)
    x, y = rng.normal(size=(30, 5)), rng.normal(size=30)
    loss, slope = model.gradient(w, x, y)
    assert np.isclose(loss, np.abs(model.predict(w, x) - y).sum())
    for k in range(model.size):
        step = np.zeros(model.size)
        step[k] = 1e-6
        assert np.isclose((model.gradient(w + step, x, y)[0] - model.gradient(w - step, x, y)[0]) / 2e-6, slope[k], atol=1e-4)


@pytest.mark.parametrize("hidden", [0, 4])
def test_same_weights_for_any_partitioning_and_after_a_stop(spark, hidden):
    x, who, y = made(n=240, people=3)
    df = frame(spark, x, who, y)
    fit = lambda rows, table, epochs: T.Training(T.TwoLayers(5, hidden), table, rate=0.05, epochs=epochs, batches=3).fit(rows, "who", ["k"], "x", "y").orderBy("fold").collect()
    one = fit(df.coalesce(1), scratch(spark, "t"), 4)
    many = fit(df.repartition(5), scratch(spark, "t"), 4)
    assert np.allclose([r.weights for r in one], [r.weights for r in many], atol=1e-6)
    table = scratch(spark, "t")
    fit(df, table, 2)
    again = fit(df, table, 4)
    assert np.allclose([r.weights for r in one], [r.weights for r in again], atol=1e-6) and [r.epochs for r in again] == [4, 4, 4]


def test_a_fold_does_not_see_its_own_rows(spark):
    x, who, y = made(n=200, people=3)
    other = np.where(who == 1, y + 1000, y)
    fit = lambda v: {r.fold: r.weights for r in T.Training(T.TwoLayers(5, 3), scratch(spark, "t"), rate=0.05, epochs=2, batches=2).fit(frame(spark, x, who, v), "who", ["k"], "x", "y").collect()}
    a, b = fit(y), fit(other)
    assert np.allclose(a["P1"], b["P1"]) and not np.allclose(a["P0"], b["P0"])


def test_training_learns_stops_and_predicts(spark):
    x, who, y = made(n=300, people=3)
    df = frame(spark, x, who, y)
    run = T.Training(T.TwoLayers(5, 8), scratch(spark, "t"), rate=0.3, epochs=12, patience=2, batches=2)
    fitted = run.fit(df, "who", ["k"], "x", "y")
    got = run.predictions(df.unionByName(df.limit(1).withColumn("x", F.lit(None).cast("array<double>"))), fitted, "who", "x").collect()
    weights = {r.fold: np.array(r.weights) for r in fitted.collect()}
    ok = [r for r in got if r.x is not None]
    assert len(got) == 301 and all(np.isclose(r.predicted_bpm, run.model.predict(weights[r.who], np.array([r.x]))[0]) for r in ok)
    assert np.mean([abs(r.predicted_bpm - r.y) for r in ok]) < 0.6 * np.abs(y - y.mean()).mean()
    still = T.Training(T.TwoLayers(5, 0), scratch(spark, "t"), rate=0.0, epochs=9, patience=2, batches=1).fit(df, "who", ["k"], "x", "y").first()
    assert still.epochs == 3
    assert T.Training(T.TwoLayers(5, 0), scratch(spark, "t"), epochs=2).fit(df.limit(0), "who", ["k"], "x", "y").count() == 0


NETWORKS = {
    "convolutions": lambda: N.Convolutions(13, (3, 4), 4),
    "recurrent": lambda: N.Recurrent(12, 3, 4, 2),
    "attention": lambda: N.Attention(12, 3, 6, 2, 2),
}


@pytest.mark.parametrize("kind", NETWORKS)
def test_network_gradient_by_differences(kind, monkeypatch):
    rng = np.random.default_rng(3)
    model = NETWORKS[kind]()
    w = model.start(5, 1.0) + rng.normal(0, 0.3, model.size)
    x, y = rng.normal(size=(11, model.inputs)), rng.normal(size=11)
    loss, slope = model.gradient(w, x, y)
    assert slope.shape == (model.size,) and np.isclose(loss, np.abs(model.predict(w, x) - y).sum())
    for k in range(model.size):
        step = np.zeros(model.size)
        step[k] = 1e-6
        assert np.isclose((model.gradient(w + step, x, y)[0] - model.gradient(w - step, x, y)[0]) / 2e-6, slope[k], rtol=1e-4, atol=1e-5), k
    monkeypatch.setattr(N, "ROWS", 4)
    assert np.allclose(model.gradient(w, x, y)[1], slope) and np.allclose(model.predict(w, x), [model.predict(w, r[None])[0] for r in x])
    assert model.predict(w, x[:0]).shape == (0,) and model.gradient(w, x[:0], y[:0])[0] == 0


def test_convolutions_by_loops():
    rng = np.random.default_rng(1)
    model = N.Convolutions(9, (2,), 4)
    w, x = rng.normal(size=model.size), rng.normal(size=9)
    p = model.parts(w)
    a = [max(0.0, sum(p["kernel0"][j, c] * x[t + j - 1] for j in range(4) if 0 <= t + j - 1 < 9) + p["bias0"][c]) for t in range(9) for c in range(2)]
    pooled = [max(a[4 * t + c], a[4 * t + 2 + c]) for t in range(4) for c in range(2)]
    assert np.isclose(model.predict(w, x[None])[0], sum(v * h for v, h in zip(pooled, p["head"][:, 0], strict=True)) + p["centre"][0])


def test_attention_forgets_order_without_places():
    model = N.Attention(12, 3, 6, 2, 2)
    w = model.start(2, 0.0)
    p = model.parts(w)
    x = np.random.default_rng(0).normal(size=(5, 12))
    swapped = x.reshape(5, 4, 3)[:, [2, 0, 3, 1]].reshape(5, 12)
    assert not np.allclose(model.predict(w, x), model.predict(w, swapped))
    p["places"][:] = 0
    assert np.allclose(model.predict(w, x), model.predict(w, swapped))


@pytest.mark.parametrize("kind", NETWORKS)
def test_a_network_trains_in_any_partitioning(spark, kind):
    model = NETWORKS[kind]()
    rng = np.random.default_rng(4)
    x, who = rng.normal(size=(160, model.inputs)), rng.integers(0, 3, 160)
    y = 60 + 8 * np.maximum(x[:, 1], 0) + 5 * x[:, 4]
    df = frame(spark, x, who, y)
    run = T.Training(model, scratch(spark, "t"), rate=0.05, epochs=6, batches=2)
    fitted = run.fit(df.coalesce(1), "who", ["k"], "x", "y").cache()
    other = T.Training(model, scratch(spark, "t"), rate=0.05, epochs=6, batches=2).fit(df.repartition(5), "who", ["k"], "x", "y")
    weights = {r.fold: np.array(r.weights) for r in fitted.collect()}
    assert all(np.allclose(weights[r.fold], r.weights, atol=1e-6) for r in other.collect())
    odd = spark.createDataFrame([(900, "P0", None, 1.0), (901, "P0", [1.0] * 4, 1.0), (902, None, [1.0] * model.inputs, 1.0), (903, "P9", [1.0] * model.inputs, 1.0), (904, "P1", [float("nan")] * model.inputs, 1.0)], df.schema)
    got = run.predictions(df.unionByName(odd), fitted, "who", "x").collect()
    assert len(got) == 165 and all((r.predicted_bpm is None) == (r.k >= 900) for r in got)
    ok = [r for r in got if r.k < 900]
    assert all(np.isclose(r.predicted_bpm, model.predict(weights[r.who], np.array([r.x]))[0]) for r in ok)
    assert np.mean([abs(r.predicted_bpm - r.y) for r in ok]) < 0.9 * np.abs(y - np.median(y)).mean()
