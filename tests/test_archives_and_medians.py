"""Archives as a data source, and medians by selection."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelane.operators import metrics
from wavelane.sources import archives as A


def npz(folder):
    return sorted(f for f in os.listdir(folder) if f.endswith(".npz"))


def test_reads_asked_members_by_ranges(spark, tmp_path):
    n = 50_000
    x, w = np.arange(n) / 7, np.arange(2 * n).reshape(n, 2)
    np.savez(tmp_path / "a.npz", x=x, w=w, s=np.array(["é", "bb"] * (n // 2)), fs=np.float64(25.0), object=np.array([None] * n, object))
    np.savez_compressed(tmp_path / "b.npz", x=x[:3], w=np.asfortranarray(w[:3]))
    got = A.read_archives(spark, str(tmp_path), "file string, ord long, x double, w array<long>, s string, fs double, none double", split_bytes=1 << 18)
    assert got.rdd.getNumPartitions() > 4
    rows = got.where("file = 'a.npz'").orderBy("ord").collect()
    assert [r.x for r in rows] == x.tolist() and [r.w for r in rows] == w.tolist() and {r.fs for r in rows} == {25.0}
    assert [r.s for r in rows[:2]] == ["é", "bb"] and rows[0].none is None
    assert [(r.ord, r.w, r.s) for r in got.where("file = 'b.npz'").orderBy("ord").collect()] == [(0, [0, 1], None), (1, [2, 3], None), (2, [4, 5], None)]
    assert A.read_archives(spark, str(tmp_path), "file string, ord long").count() == n + 3
    with pytest.raises(Exception, match="b.npz lacks s"):
        A.read_archives(spark, str(tmp_path), "x double", required="x,s").collect()
    with pytest.raises(Exception, match="Python objects"):
        A.read_archives(spark, str(tmp_path / "a.npz"), "object string").collect()


def test_archives_at_the_edges(spark, tmp_path):
    assert A.read_archives(spark, str(tmp_path), "x double").count() == 0
    np.savez(tmp_path / "e.npz", x=np.zeros(0))
    assert A.read_archives(spark, str(tmp_path), "x double").count() == 0
    np.savez(tmp_path / "u.npz", x=np.zeros(3), y=np.zeros(4))
    with pytest.raises(Exception, match="unequal lengths"):
        A.read_archives(spark, str(tmp_path), "x double, y double").collect()
    with pytest.raises(Exception, match="give the columns"):
        spark.read.format("npz").option("path", str(tmp_path)).load()


def test_round_trip_and_replacement(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, "P/1").otherwise("P 2").alias("who"), "id", F.when(F.col("id") % 9 != 0, F.col("id") / 3).alias("x"), F.array(F.col("id") * 1.0, F.lit(2.0)).alias("w"), F.concat(F.lit("n"), "id").alias("s"))
    A.write_archives(rows, path, ["who"], ["id"], parts=4, file_rows=300)
    assert len(npz(path)) > 16 and os.listdir(path) == [f for f in os.listdir(path) if f.endswith(".npz")]
    back = A.read_archives(spark, path, "who string, id long, x double, w array<double>, s string").withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    assert back.exceptAll(rows).count() == rows.exceptAll(back).count() == 0
    A.write_archives(rows.where("id < 10"), path, ["who"], ["id"])
    assert A.read_archives(spark, path, "id long").count() == 10


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(1000).select(F.lit("k").alias("k"), "id", F.when(F.col("id") != 777, F.col("id")).alias("v"))
    A.write_archives(rows.where("id < 50"), path, ["k"], ["id"])
    before = npz(path)
    with pytest.raises(Exception, match="has nulls"):
        A.write_archives(rows, path, ["k"], ["id"], file_rows=20)
    assert sorted(os.listdir(path)) == before and A.read_archives(spark, path, "id long").count() == 50


def test_median_by_selection(spark):
    rng = np.random.default_rng(3)
    special = [0.0, -0.0, float("inf"), float("-inf"), 5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308, 2.2250738585072014e-308, 1.0, np.nextafter(1, 2), np.nextafter(1, 0), 2.0, -1.0, 4.0, 0.1]
    groups = {"a": special, "b": rng.normal(size=401).tolist(), "c": rng.integers(-3, 3, 500).astype(float).tolist(), "d": (10.0 ** rng.uniform(-300, 300, 300) * rng.choice([-1, 1], 300)).tolist(), "e": [7.5], "f": [2.0, 2.0], None: [1.0, 3.0, 8.0]}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("b", float("nan")), ("g", None)]
    got = {r.k: (r.n, r.median) for r in metrics.exact_median(spark.createDataFrame(rows, "k string, x double"), ["k"], "x").collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k][0] == len(vs) and np.isclose(got[k][1], np.median(vs), rtol=1e-15, atol=0), k
    order = sorted(set(special))
    parts = [tuple(r) for r in spark.createDataFrame([(k, float(v)) for k, v in enumerate(order)], "k int, x double").orderBy("k").select(*metrics._digits(F.col("x"))).collect()]
    assert parts == sorted(parts) and len(set(parts)) == len(order)
    assert metrics.exact_median(spark.createDataFrame([], "k string, x double"), ["k"], "x").count() == 0
