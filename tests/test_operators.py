"""Operators against small sequential models and at their edges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wavelane.operators import align, folds, labels, metrics, segments, windows as W


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def greedy_windows(times, gap, length, stride, span):
    """The sequential rule: a gap restarts after the first gap, rejected windows advance by the stride."""
    out, s = [], 0
    while s + length <= len(times):
        w = times[s : s + length]
        breaks = [k for k in range(1, length) if w[k] - w[k - 1] > gap]
        if breaks:
            s += breaks[0]
            continue
        if span[0] <= w[-1] - w[0] <= span[1]:
            out.append((w[0], w[-1]))
        s += stride
    return out


@pytest.mark.parametrize("length,stride", [(4, 1), (5, 2), (3, 3)])
def test_gap_restart_matches_the_sequential_rule(spark, length, stride):
    rng = random.Random(length * 10 + stride)
    rows, expect = [], set()
    for p in range(12):
        t, times = 0, []
        for _ in range(rng.randint(0, 40)):
            t += rng.choice([1, 2, 3, 15, 16, 40])
            times.append(t)
        rows += [(p, k, t) for k, t in enumerate(times)]
        expect |= {(p, a, b) for a, b in greedy_windows(times, 15, length, stride, (5, 40))}
    rng.shuffle(rows)
    df = frame(spark, rows, "participant int, ord long, t long")
    got = W.gap_restart_windows(df, ["participant"], "t", "ord", 15, length, stride, (5, 40))
    assert {(r.participant, r.t0, r.t1) for r in got.collect()} == expect
    walked = W.strided_in_order(df, ["participant"], "t", "ord", 15, length, stride).where("t1 - t0 BETWEEN 5 AND 40")
    assert {(r.participant, r.t0, r.t1) for r in walked.collect()} == expect


def test_stride_above_length_is_refused(spark):
    df = frame(spark, [(1, 1, 1)], "participant int, ord long, t long")
    with pytest.raises(ValueError):
        W.gap_restart_windows(df, ["participant"], "t", "ord", 15, 2, 3, (0, 9))
    with pytest.raises(ValueError):
        W.gap_restart_windows(df, ["participant"], "t", "ord", 15, 2, 0, (0, 9))


def test_segments_at_the_threshold(spark):
    df = frame(spark, [(1, k, t) for k, t in enumerate([0, 10, 20, 31, 31])] + [(2, 9, 5)], "p int, ord long, t long")
    got = {(r.p, r.start, r.end, r.n) for r in segments.gap_segments(df, ["p"], "t", "ord", 10).collect()}
    assert got == {(1, 0, 20, 3), (1, 31, 31, 2), (2, 5, 5, 1)}
    for bucket in (1, 7, 100):
        assert {(r.p, r.start, r.end, r.n) for r in segments.gap_segments(df, ["p"], "t", "ord", 10, bucket=bucket).collect()} == got
    assert segments.gap_segments(df.limit(0), ["p"], "t", "ord", 10).count() == 0


def test_regions_need_two_rows(spark):
    rows = frame(spark, [(1, 1, 5), (1, 2, 50), (1, 3, 51)], "p int, ord long, t long")
    runs = frame(spark, [(1, 0, 0, 10), (1, 1, 50, 60)], "p int, segment long, start long, end long")
    got = segments.region_segments(rows, runs, ["p"], "t", "ord", 10, 20.0).collect()
    assert [(r.b_segment, r.start, r.end, r.n) for r in got] == [(1, 50, 51, 2)]


def test_touching_overlap_and_coverage(spark):
    a = frame(spark, [(1, 0, 0.0, 5.0), (1, 1, 8.0, 9.0)], "p int, segment long, start double, end double")
    b = frame(spark, [(1, 0, 5.0, 8.5)], "p int, segment long, start double, end double")
    assert [(r.start, r.end) for r in segments.overlaps(a, b, ["p"], 100.0).collect()] == [(8.0, 8.5)]
    rng = random.Random(4)
    some = lambda: [(p, k, float(s := rng.randint(0, 400)), float(s + rng.randint(0, 60))) for p in "xy" for k in range(40)]
    left, right = some(), some()
    want = sorted((p, k, m, max(s, u), min(e, v)) for p, k, s, e in left for q, m, u, v in right if p == q and max(s, u) < min(e, v))
    names = "p string, segment long, start double, end double"
    for width in (7.0, 1000.0):
        got = segments.overlaps(spark.createDataFrame(left, names), spark.createDataFrame(right, names), ["p"], width).collect()
        assert sorted(tuple(r) for r in got) == want
    i = frame(spark, [(1, 0.0, 5.0), (1, 5.0, 6.0), (1, 2.0, 3.0), (1, 9.0, 9.0), (1, float("nan"), 4.0), (1, 10.0, 11.0)], "p int, s double, e double")
    r = segments.coverage(i, ["p"], "s", "e").first()
    assert (r.covered, r.n_merged) == (7.0, 2)


def test_fallback_is_all_or_nothing(spark):
    first = frame(spark, [(1, 5)], "p int, t0 int")
    second = frame(spark, [(1, 6), (2, 7), (2, 8)], "p int, t0 int")
    assert sorted((r.p, r.t0, r.fallback) for r in W.with_fallback(first, second, ["p"]).collect()) == [(1, 5, False), (2, 7, True), (2, 8, True)]


def test_padding(spark):
    df = frame(spark, [([1.0, 2.0],), ([1.0, 2.0, 3.0, 4.0],), ([],)], "x array<double>").select(W.padded(F.col("x"), 3).alias("p"))
    assert [r.p for r in df.collect()] == [[1.0, 2.0, 0.0], None, [0.0, 0.0, 0.0]]


def test_sub_windows_cover_the_tail(spark):
    df = frame(spark, [([float(k) for k in range(n)],) for n in (3, 5, 10, 11)], "x array<double>")
    got = [[[w[0], len(w)] for w in r.w] for r in df.select(W.sub_windows(F.col("x"), 5, 4).alias("w")).collect()]
    assert got == [[[0, 3]], [[0, 5]], [[0, 5], [4, 5], [5, 5]], [[0, 5], [4, 5], [6, 5]]]


def nearest(rows, devices, tolerance):
    counts = {d: [(t, o) for dd, t, o in rows if dd == d] for d in devices}
    if not all(counts.values()):
        return set()
    base = min(devices, key=lambda d: (len(counts[d]), devices.index(d)))
    out = set()
    for t, o in counts[base]:
        pick = [min((abs(u - t), u, k) for u, k in counts[d]) for d in devices]
        if all(x[0] <= tolerance for x in pick):
            out.add((o, *(x[2] for x in pick)))
    return out


def test_nearest_alignment(spark):
    rng, devices = random.Random(3), ("A", "B", "C")
    rows, expect = [], set()
    for p in range(10):
        own = [(rng.choice(devices), rng.randint(0, 300), k) for k in range(rng.randint(0, 40))]
        rows += [(p, *r) for r in own]
        expect |= {(p, *r) for r in nearest(own, devices, 7)}
    df = frame(spark, rows, "p int, role string, t long, ord long")
    got = align.nearest_align(df, "p", "role", "t", "ord", devices, 7).collect()
    assert {(r.p, r.base_ord, r.A_ord, r.B_ord, r.C_ord) for r in got} == expect


def test_nearest_at_the_tolerance(spark):
    df = frame(spark, [(1, "A", 1000.0, 1), (1, "B", 1500.0, 2), (1, "B", 500.0, 3), (2, "A", 0.0, 4), (2, "B", 501.0, 5)], "p int, role string, t double, ord long")
    got = align.nearest_align(df, "p", "role", "t", "ord", ("A", "B"), 500.0).collect()
    assert [(r.p, r.B_ord) for r in got] == [(1, 3)]


def test_keys_round_half_to_even_and_last_duplicate_counts(spark):
    ref = frame(spark, [(1, 0, 0.5, 8.0), (1, 1, 1.5, 9.0), (1, 2, 7.0, 7.0)], "p int, ord long, t0 double, t1 double")
    src = frame(spark, [(1, 5, 0.0, 8.0, "a"), (1, 6, 0.2, 8.0, "b"), (1, 7, 2.0, 9.0, "c")], "p int, ord long, t0 double, t1 double, x string")
    got = sorted((r.ref_ord, r.x, r.missing) for r in align.keyed_realign(ref, src, ["p"], "ord").collect())
    assert got == [(0, "b", False), (1, "c", False), (2, None, True)]


@pytest.mark.parametrize("rr,n,reason", [([0.8] * 4, 60, "ok"), ([0.8] * 2, 60, "too_few_beats"), ([0.8] * 4, 49, "too_short"), ([0.24, 0.5, 0.5, 0.5], 60, "implausible_rr"), ([0.5, 0.8, 0.5, 0.8], 60, "rr_too_irregular"), ([1.6] * 4, 60, "implausible_hr"), ([1.5] * 4, 60, "ok"), ([1 / 3] * 4, 60, "ok"), ([0.3] * 4, 60, "implausible_hr")])
def test_label_cascade(spark, rr, n, reason):
    peaks = [0.0]
    for r in rr:
        peaks.append(peaks[-1] + r)
    df = frame(spark, [(n, peaks, "")], "n int, peaks array<double>, q string")
    row = labels.label_cascade(df, F.col("n"), F.lit(False), F.col("peaks"), 1.0, F.col("q")).first()
    assert (row.reason, row.valid, row.quality) == (reason, reason == "ok", "unknown")


def test_label_order_and_quality(spark):
    df = frame(spark, [(10, None, True, "x"), (60, [0.0, 0.8, 1.6, 2.4], False, "Unacceptable"), (60, [], False, None)], "n int, peaks array<double>, bad boolean, q string")
    got = [r.reason for r in labels.label_cascade(df, F.col("n"), F.col("bad"), F.col("peaks"), 1.0, F.col("q")).collect()]
    assert got == ["contains_nan", "poor_quality", "too_few_beats"]


def test_metrics_edges(spark):
    rows = [("const", 70.0, 5.0), ("const", 80.0, 5.0), ("nan", 70.0, float("nan")), ("one", 60.0, 61.0), ("nil", None, 3.0)]
    df = frame(spark, rows, "k string, y double, x double")
    got = {r.k: r for r in metrics.error_metrics(df, ["k"], "y", "x").collect()}
    assert got["const"].r is None and got["const"].mae == 70.0
    assert (got["nan"].valid, got["nan"].mae, got["nan"].valid_pct) == (0, None, 0.0)
    assert got["one"].rmse == 1.0 and (got["nil"].valid, got["nil"].mae) == (1, None)
    assert {r.k: r.r for r in metrics.error_metrics(df, ["k"], "y", "x", zero_r=True).collect()} == dict.fromkeys(got, 0.0)
    assert metrics.macro_metrics(metrics.error_metrics(df.limit(0), ["k"], "y", "x"), ["mae"]).first().mae_mean is None


def test_folds(spark):
    df = frame(spark, [(p, k) for p in "abc" for k in range(60)], "participant string, k int")
    out = folds.loso_folds(df, "participant", ["participant", "k"])
    assert out.count() == 3 * 180
    assert out.where("(split = 'test') <> (participant = target)").count() == 0
    share = out.where("split = 'val'").count() / 360
    assert 0.1 < share < 0.3
    three = folds.three_way(df, ["participant", "k"], 0.2, 0.2).groupBy("split").count().collect()
    assert len(three) == 3
    assert folds.grouped_split(df, "participant", 0.5).groupBy("participant").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert folds.pooled([df, df]).count() == 360 and folds.fold_seed(4, 2) == 42


def test_rates_and_ranges(spark):
    df = frame(spark, [(1, k, 10.0 * k) for k in range(5)] + [(2, 1, 5.0), (3, 1, 1.0), (3, 2, 1.0)], "p int, ord long, t double")
    assert {r.p: r.fs for r in metrics.sampling_rate(df, ["p"], "t", "ord").collect()} == {1: 100.0, 2: None, 3: None}
    assert metrics.value_range(df.limit(0), ["p"], "t").count() == 0


def test_splits_at_all_shares(spark):
    from wavelane.operators import folds

    rows = spark.range(20_000)
    for share in (0.0, 0.2, 0.5, 0.99, 0.999, 1.0):
        got = folds.two_way(rows, ["id"], share).where("split = 'test'").count() / 20_000
        assert abs(got - share) < 0.01 and (0 < share < 1 or got == share)
    three = {r.split: r.n for r in folds.three_way(rows, ["id"], 0.3, 0.7).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert "train" not in three and abs(three["test"] / 20_000 - 0.7) < 0.02


@pytest.mark.parametrize("bucket", [1, 7, 50, 10**6])
def test_bucketed_runs_are_the_plain_ones(spark, bucket):
    rng = random.Random(bucket)
    rows = [(k, t, o) for k in "ab" for o, t in enumerate(sorted(rng.choices(range(400), k=150)))] + [("c", 5, 0), (None, 3, 0)]
    df = frame(spark, rows, "k string, t long, ord long")
    plain = {(r.k, r.ord): r.run for r in segments.with_runs(df, ["k"], "t", "ord", 4).collect()}
    got = segments.bucketed_runs(df.where("k IS NOT NULL"), ["k"], "t", "ord", 4, bucket).collect()
    assert {(r.k, r.ord): r.run for r in got} == {x: n for x, n in plain.items() if x[0] is not None}
    place, count = {}, {}
    for k, o in sorted(x for x in plain if x[0] is not None):
        place[k, o] = count.get((k, plain[k, o]), 0)
        count[k, plain[k, o]] = place[k, o] + 1
    assert {(r.k, r.ord): r._place for r in got} == place


def test_leave_one_out_models(spark):
    from pyspark.ml.functions import array_to_vector

    from wavelane.operators import models

    rng = random.Random(5)
    rows = [(p, k, [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for p in ("a", "b", "c") for k in range(60)]
    df = frame(spark, rows, "participant string, k long, x array<double>").withColumn("hr", 70 + 20 * F.element_at("x", 1)).withColumn("features", array_to_vector("x"))
    got = models.leave_one_out(df, "participant", ["participant", "k"], "hr")
    assert got.count() == 180 and {r[0] for r in got.select("participant").distinct().collect()} == {"a", "b", "c"}
    folds_, macro = models.fold_report(got, "participant")
    assert folds_.count() == 3 and macro.first().mae_mean < 1.5 and macro.first().r_mean > 0.99
    wide = df.withColumn("ppg", F.array(*[F.lit(float(k % 7)) for k in range(60)]))
    assert models.with_features(wide.drop("features"), ["ppg"], "hr", 60, 80).count() == df.where("hr BETWEEN 60 AND 80").count()
