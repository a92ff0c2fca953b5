"""Readers of recordings: CSV forms, NumPy archives and participant discovery.

Rows carry ``ord``, their order in the file: the place in the split that holds them and the counts of the file's splits before it, so that a large
file is numbered by many tasks. Parquet tables that already have it are the native form.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

CHANNELS = ("ppg_ir", "ppg_green")
ECG_KEYS = ("phone_time", "rel_time_ms", "ecg_uv", "source_file")


def participant_id(raw: Column) -> Column:
    """P and a number, from forms such as 7, P7 or p07; anything else is an error."""
    digits = F.regexp_extract(F.trim(raw.cast("string")), "^[Pp]?([0-9]+)$", 1)
    return F.when(digits != "", F.concat(F.lit("P"), digits.cast("long").cast("string"))).otherwise(F.raise_error(F.concat(F.lit("not a participant id: "), F.coalesce(raw.cast("string"), F.lit("null")))))


def normal_id(raw: str | int) -> str:
    found = re.fullmatch(r"\s*[Pp]?(\d+)\s*", str(raw))
    if not found:
        raise ValueError(f"not a participant id: {raw!r}")
    return f"P{int(found[1])}"


def epoch_ms(text: Column) -> Column:
    """Milliseconds of a date and time without a zone, read as UTC."""
    return F.unix_micros(F.to_timestamp(F.concat(text, F.lit("+00:00")))).cast("double") / 1000


def _numbered(df: DataFrame) -> DataFrame:
    """Rows of files with ``_file``, their file's path, and ``ord``; ids rise along a split."""
    rows = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_split", F.col("_metadata.file_block_start")).withColumn("_id", F.monotonically_increasing_id())
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_file", "_split").agg(F.count("*").alias("_n")).select("_file", "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_file", "_split").orderBy("_id")))
    return inside.join(counts, ["_file", "_split"]).withColumn("ord", F.col("_before") + F.col("_place")).drop("_split", "_id", "_place", "_before")


def _with_values(rows: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """Rows with aggregates of their key's rows, which are combined before the shuffle."""
    key = F.struct(*keys)
    return rows.withColumn("_key", key).join(rows.groupBy(key.alias("_key")).agg(*(v.alias(k) for k, v in values.items())), "_key").drop("_key")


def _ordered_csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """Rows of CSV files with their file's name and their order in it."""
    df = spark.read.csv(path, schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, **options)
    return _numbered(df).withColumn("source_file", F.element_at(F.split("_file", "/"), -1))


def _device_csv(spark: SparkSession, path: str, subject: str) -> DataFrame:
    rows = _ordered_csv(spark, path, "uptime_ms double, epoch_ms double, datetime_str string, site string, ppg_raw double")
    return rows.select("_file", F.lit(subject).alias("participant"), "source_file", "ord", F.col("epoch_ms").alias("t_ms"), "datetime_str", "site", F.col("ppg_raw").alias("ppg"))


def device_csv(spark: SparkSession, path: str, subject: str) -> DataFrame:
    """Headerless pulse CSV (uptime_ms, epoch_ms, datetime_str, site, ppg_raw): t_ms and ppg; ``site`` is the first row's."""
    rows = _with_values(_device_csv(spark, path, subject), ["_file"], _site=F.min_by("site", "ord"))
    return rows.withColumn("site", F.col("_site")).drop("_file", "_site")


def device_csv_phone_time(spark: SparkSession, path: str, subject: str) -> DataFrame:
    """:func:`device_csv` with times counted from the first row's (by time) date and time."""
    first = F.min_by("datetime_str", F.struct("t_ms", "ord"))
    rows = _with_values(_device_csv(spark, path, subject), ["_file"], _site=F.min_by("site", "ord"), _first=first, _least=F.min("t_ms"))
    return rows.withColumn("site", F.col("_site")).withColumn("t_ms", epoch_ms(F.col("_first")) + (F.col("t_ms") - F.col("_least"))).drop("_file", "_site", "_first", "_least")


def with_phone_time(samples: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Samples moved to phone time: ``anchors`` has keys, start_ms and least_ms (one row a recording)."""
    return samples.join(anchors.select(*keys, "start_ms", "least_ms"), keys).withColumn("t_ms", F.col("start_ms") + (F.col("t_ms") - F.col("least_ms"))).drop("start_ms", "least_ms")


def polar_csv(spark: SparkSession, path: str, subject: str) -> DataFrame:
    """Semicolon ECG CSV with a header: the epoch is the first phone time in the file plus the relative time."""
    rows = _ordered_csv(spark, path, "phone_time string, sensor_ns double, rel_time_ms double, ecg_uv double", sep=";", header=True, enforceSchema=True)
    rows = _with_values(rows, ["_file"], _first=F.min_by("phone_time", "ord"))
    return rows.select(F.lit(subject).alias("participant"), "ord", (epoch_ms(F.col("_first")) + F.col("rel_time_ms")).alias("ecg_epoch_ms"), F.col("rel_time_ms").alias("ecg_rel_ms"), "ecg_uv", "source_file")


def ecg_epoch(raw: DataFrame) -> DataFrame:
    """Raw rows (participant, ord, phone_time, rel_time_ms, ..., source_file) with ecg_epoch_ms: for each source file its first
    phone time in file order plus the relative time. Rows without a source file are rejected."""
    rows = _with_values(raw.where(F.col("source_file").isNotNull()), ["participant", "source_file"], _first=F.min_by("phone_time", "ord"))
    return rows.withColumn("ecg_epoch_ms", epoch_ms(F.col("_first")) + F.col("rel_time_ms")).drop("_first")


_MERGED = "phone_time string, time_ms double, sensor_time_ns double, rel_time_ms double, ecg_uv double, source_file string"


def merged_csv(spark: SparkSession, path: str, subject: str | None, recompute: bool = True) -> DataFrame:
    """Merged ECG CSV; epochs are recomputed by source file, or ``time_ms`` is trusted. Without ``subject`` the path holds folders participant=<id> with
    one file each."""
    df = _numbered(spark.read.csv(path, schema=_MERGED if subject else f"{_MERGED}, participant string", header=True, enforceSchema=True)).drop("_file")
    df = df.withColumn("participant", F.lit(subject)) if subject else df
    df = ecg_epoch(df) if recompute else df.withColumn("ecg_epoch_ms", F.col("time_ms"))
    return df.select("participant", "ord", "ecg_epoch_ms", F.col("rel_time_ms").alias("ecg_rel_ms"), "ecg_uv", "source_file")


def _archives(spark: SparkSession, path: str, read, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as archive:
                    yield read(str(name).rsplit("/", 1)[-1], {k: archive[k] for k in archive.files})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def samples_archive(spark: SparkSession, path: str) -> DataFrame:
    """Raw pulse archives named <participant>_<role>_raw.npz, in order of their rows; acceleration may be missing."""

    def read(name: str, a: dict) -> pd.DataFrame:
        stem = name.removesuffix(".npz").removesuffix("_raw")
        n = len(a["timestamp"])
        column = lambda k: a[k].astype(float) if k in a else np.full(n, np.nan)
        out = pd.DataFrame({"participant": normal_id(stem.split("_", 1)[0]), "role": stem.split("_", 1)[-1], "ord": np.arange(n), "t_ms": column("timestamp")})
        for k in (*CHANNELS, "accel_x", "accel_y", "accel_z"):
            out[k] = column(k)
        return out

    return _archives(spark, path, read, "participant string, role string, ord long, t_ms double, ppg_ir double, ppg_green double, accel_x double, accel_y double, accel_z double")


def ecg_archive(spark: SparkSession, path: str) -> DataFrame:
    """Raw ECG archives named <participant>_polar_ecg_raw.npz, with recomputed epochs; a missing key is an error."""

    def read(name: str, a: dict) -> pd.DataFrame:
        if missing := [k for k in ECG_KEYS if k not in a]:
            raise ValueError(f"{name} lacks {', '.join(missing)}")
        n = len(a["ecg_uv"])
        return pd.DataFrame({"participant": normal_id(name.split("_", 1)[0]), "ord": np.arange(n), "phone_time": a["phone_time"].astype(str), "rel_time_ms": a["rel_time_ms"].astype(float), "ecg_uv": a["ecg_uv"].astype(float), "source_file": a["source_file"].astype(str)})

    return ecg_epoch(_archives(spark, path, read, "participant string, ord long, phone_time string, rel_time_ms double, ecg_uv double, source_file string"))


def read_ecg(spark: SparkSession, path: str, subject: str | None) -> DataFrame:
    """ECG by the file's kind."""
    if path.endswith(".npz"):
        return ecg_archive(spark, path)
    if path.endswith(".csv"):
        return merged_csv(spark, path, subject)
    raise ValueError(f"neither .npz nor .csv: {path}")


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists in its file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    return None


def ecg_path(spark: SparkSession, root: str, participant: str) -> str | None:
    """A participant's ECG file: merged archive, merged CSV, then the raw archive."""
    p = normal_id(participant)
    return first_existing(spark, [f"{root}/{p}_ecg_merged.npz", f"{root}/{p}_ecg_merged.csv", f"{root}/{p}_polar_ecg_raw.npz"])


def windows_path(root: str, participant: str, device: str, channel: str | None = None) -> str:
    return f"{root}/{normal_id(participant)}/alignment_windows_{device}" + (f"_{channel}" if channel else "") + ".npz"


def dataset_root(root: str, full: bool) -> str:
    return f"{root}/{'full' if full else 'sample'}"


def pulse_column(df: DataFrame, channel: str) -> Column:
    """The channel's column, or ``ppg`` where the table has no such channel."""
    if channel not in CHANNELS:
        raise ValueError(f"unknown channel {channel!r}; known: {', '.join(CHANNELS)}")
    if channel in df.columns and "ppg" in df.columns:
        return F.coalesce(channel, "ppg")
    return F.col(channel if channel in df.columns else "ppg")


def discover(files: DataFrame, participant: str = "participant", role: str = "role") -> DataFrame:
    """Participants by role with exactly one file, in lexical order; more than one is an error when the rows are read."""
    one = files.groupBy(participant, role).agg(F.count("*").alias("_n"), F.min("path").alias("path"))
    checked = F.when(F.col("_n") == 1, F.col("path")).otherwise(F.raise_error(F.concat(F.lit("more than one file for "), F.col(participant), F.lit(" "), F.col(role))))
    return one.withColumn("path", checked).drop("_n").orderBy(participant, role)


def aligned_participants(aligned: DataFrame) -> DataFrame:
    return aligned.select("participant").distinct().orderBy("participant")
