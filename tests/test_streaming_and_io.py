"""Streams against the batch operators; readers, writers and the model interface on small files."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from wavelane.operators import models, segments, windows as W
from wavelane.sources import readers as R, sinks
from wavelane.streaming import ordered, sessions


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_strided_stream_matches_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = []
    for p in range(4):
        t = np.cumsum(rng.choice([1, 2, 30], 60))
        rows += [(p, k, int(x)) for k, x in enumerate(t)]
    df = spark.createDataFrame(rows, "p int, ord long, t long")
    for k in range(3):  # three files, in order of time
        df.where(f"ord >= {20 * k} AND ord < {20 * (k + 1)}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("p int, ord long, t long").option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in"))
    drain(sessions.strided_stream(stream, "p", "t", "ord", 10, 4, 2), "strided")
    got = {tuple(r) for r in spark.sql("SELECT p, t0, t1 FROM strided").collect()}
    assert got == {(r.p, r.t0, r.t1) for r in W.gap_restart_windows(df, ["p"], "t", "ord", 10, 4, 2, (0, 10**9)).collect()}


def test_sessions_match_segments(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    drain(sessions.session_segments(stream, ["user_id"], "ts", "10 hours", "1 hour"), "sess", "append")
    got = {(r.user_id, r.start, r.end, r.n) for r in spark.table("sess").collect()}
    batch = segments.gap_segments(events.withColumn("t", F.unix_micros("ts")), ["user_id"], "t", "event_id", 36_000_000_000 - 1)
    expect = {(r.user_id, r.start, r.end, r.n) for r in batch.withColumns({"start": F.timestamp_micros("start"), "end": F.timestamp_micros("end")}).collect()}
    assert got <= expect and len(got) > 0.5 * len(expect)  # the last ones stay open


@pytest.mark.parametrize("length, stride", [(4, 4), (3, 1)])
def test_timers_take_rows_in_order_and_delete_state(spark, tmp_path, length, stride):
    rng = np.random.default_rng(length)
    rows = [(p, k, int(x)) for p in range(5) for k, x in enumerate(np.cumsum(rng.choice([10, 20, 5000, 90_000], 60) * 1000))]
    df = spark.createDataFrame(rows, "p int, ord long, t long").withColumn("ts", F.timestamp_micros("t"))
    shuffled = [rows[k] for k in sorted(range(len(rows)), key=lambda k: rows[k][2] + rng.integers(0, 3_000_000))]
    parts = [shuffled[:100], shuffled[100:200], shuffled[200:], [(-1, 0, 10**12)]]
    for part in parts:  # late by three seconds at most, in four files
        spark.createDataFrame(part, "p int, ord long, t long").withColumn("ts", F.timestamp_micros("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    session = ordered.with_state_tables(spark)
    stream = session.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    gap = 6_000_000
    results = {
        "windows": (ordered.window_stream(stream, "p", "ts", "t", "ord", gap, length, stride, "4 seconds"), W.gap_restart_windows(df, ["p"], "t", "ord", gap, length, stride, (0, 10**15)).select("p", "t0", "t1")),
        "segments": (ordered.segment_stream(stream, "p", "ts", "t", "ord", gap, "4 seconds"), segments.gap_segments(df, ["p"], "t", "ord", gap).select("p", "start", "end", "n")),
    }
    for name, (out, batch) in results.items():
        state = str(tmp_path / f"{name}-state")
        q = out.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(str(tmp_path / name))
        q.awaitTermination()
        got = spark.read.parquet(str(tmp_path / name)).where("p >= 0").select(*batch.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
        for variable in ("run", "waiting"):
            left = session.read.format("statestore").option("path", state).option("stateVarName", variable).load()
            assert {r.key.p for r in left.select("key").collect()} <= {-1}


def test_rows_are_numbered_over_splits(spark, tmp_path):
    n = 3000
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("".join(f"{k},{k}.0,2024-01-01 00:00:02,{name}{k},{k % 7}\n" for k in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        assert spark.read.csv(str(tmp_path)).rdd.getNumPartitions() > 4
        rows = R.device_csv(spark, str(tmp_path), "P7").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 2 * n and all(r.ord == r.t_ms + 1 and r.site == r.source_file[0] + "0" for r in rows)


def test_csv_readers(spark, tmp_path):
    (tmp_path / "dev.csv").write_text("1 , 2000.0, 2024-01-01 00:00:02, wrist, 5\n2, 1000.0 ,2024-01-01 00:00:01,arm,6\n")
    rows = R.device_csv(spark, str(tmp_path / "dev.csv"), "P7").orderBy("ord").collect()
    assert [(r.t_ms, r.site, r.ppg) for r in rows] == [(2000.0, "wrist", 5.0), (1000.0, "wrist", 6.0)]
    moved = R.device_csv_phone_time(spark, str(tmp_path / "dev.csv"), "P7").orderBy("ord").collect()
    assert [r.t_ms for r in moved] == [1704067202000.0, 1704067201000.0]
    (tmp_path / "polar.csv").write_text("Phone timestamp;sensor timestamp [ns];timestamp [ms];ecg [uV]\n2024-01-01T00:00:01;9;0;3\n2024-01-01T00:00:02;9;7.5;4\n")
    rows = R.polar_csv(spark, str(tmp_path / "polar.csv"), "P7").orderBy("ord").collect()
    assert [r.ecg_epoch_ms for r in rows] == [1704067201000.0, 1704067201007.5]
    (tmp_path / "m.csv").write_text("phone_time,time_ms,sensor_time_ns,rel_time_ms,ecg_uv,source_file\n2024-01-01T00:00:05,1,0,100,1,a\n2024-01-01T00:00:01,2,0,0,2,a\n2024-01-01T00:00:09,3,0,5,3,b\n2024-01-01T00:00:09,4,0,5,3,\n")
    rows = R.read_ecg(spark, str(tmp_path / "m.csv"), "P7").orderBy("ord").collect()
    assert [r.ecg_epoch_ms - 1704067200000 for r in rows] == [5100.0, 5000.0, 9005.0]
    assert [r.ecg_epoch_ms for r in R.merged_csv(spark, str(tmp_path / "m.csv"), "P7", recompute=False).orderBy("ord").collect()] == [1.0, 2.0, 3.0, 4.0]
    with pytest.raises(ValueError):
        R.read_ecg(spark, "x.txt", "P7")


def test_archives_and_paths(spark, tmp_path):
    np.savez(tmp_path / "P07_Ring_raw.npz", timestamp=np.array([5.0, 3.0]), ppg_ir=np.array([1, 2]), ppg_green=np.array([3, 4]))
    rows = R.samples_archive(spark, str(tmp_path / "*_raw.npz")).orderBy("ord").collect()
    assert [(r.participant, r.role, r.t_ms, r.ppg_green) for r in rows] == [("P7", "Ring", 5.0, 3.0), ("P7", "Ring", 3.0, 4.0)]
    assert all(r.accel_x is None for r in rows)
    np.savez(tmp_path / "P7_polar_ecg_raw.npz", phone_time=np.array(["2024-01-01 00:00:01"]), rel_time_ms=np.array([2.0]), ecg_uv=np.array([1.0]), source_file=np.array(["f"]))
    found = R.ecg_path(spark, str(tmp_path), "7")
    assert found.endswith("P7_polar_ecg_raw.npz")
    assert R.read_ecg(spark, found, "P7").first().ecg_epoch_ms == 1704067201002.0
    assert R.windows_path("/r", "p07", "ring", "ppg_ir") == "/r/P7/alignment_windows_ring_ppg_ir.npz" and R.dataset_root("/r", False) == "/r/sample"
    with pytest.raises(ValueError):
        R.normal_id("Q7")
    with pytest.raises(Exception, match="not a participant id"):
        spark.createDataFrame([("x",)], "p string").select(R.participant_id(F.col("p"))).collect()


def test_discovery(spark):
    files = spark.createDataFrame([("P1", "Ring", "a"), ("P10", "Ring", "b"), ("P2", "Ring", "c")], "participant string, role string, path string")
    assert [r.participant for r in R.discover(files, "participant", "role").collect()] == ["P1", "P10", "P2"]
    with pytest.raises(Exception, match="more than one file"):
        R.discover(files.union(files.limit(1)), "participant", "role").collect()
    df = spark.createDataFrame([(1.0,)], "ppg double")
    assert df.select(R.pulse_column(df, "ppg_ir").alias("x")).first().x == 1.0
    assert R.aligned_participants(files).count() == 3


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("P1", 70.0, 71.23456)], "participant string, ground_truth_bpm double, predicted_bpm double")
    path = str(tmp_path / "pred")
    sinks.write_predictions(rows, path)
    sinks.write_predictions(rows, path)
    assert [tuple(r) for r in sinks.read_predictions(spark, path).collect()] == [("P1", 70.0, 71.235)]
    sinks.write_predictions(rows, path, append=True)
    assert sinks.read_predictions(spark, path).count() == 2
    w = spark.createDataFrame([("P1", "Ring", 1.0), ("P2", "Ring", 2.0)], "participant string, role string, t0_ms double")
    sinks.write_windows(w, str(tmp_path / "w"))
    sinks.write_windows(w.where("participant = 'P1'"), str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2
    sinks.write_results(w, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    lines = sinks.summary_lines(spark.createDataFrame([(1.0,), (3.0,)], "mae double"), ["mae"]).collect()
    assert [r.line for r in lines] == ["MAE: 2.0000 ± 1.0000"]


def test_models_behind_folds(spark):
    rng = np.random.default_rng(2)
    rows = []
    for p in "abc":
        for k in range(30):
            hr = 60.0 + 60 * rng.random()
            rows.append((p, k, hr, [float(v) for v in np.sin(2 * np.pi * hr / 60 * np.arange(64) / 8)]))
    df = spark.createDataFrame(rows, "participant string, k int, hr double, ppg array<double>")
    report = models.grid(df, "participant", ["participant", "k"], "hr", {"linear": models.linear, "boosted": models.boosted}, models.FEATURE_SETS)
    got = report.collect()
    assert {r.model for r in got} == {"linear", "boosted"} and all(r.n_folds == 3 and 0 < r.mae_mean < 30 for r in got)
