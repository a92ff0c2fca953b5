"""The driver's tables in the shapes that the operators take.

Events are sparse, so thresholds are in hours; times are whole microseconds, which both engines hold exactly.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

HOUR = 3_600_000_000
DEVICES = ("Ring", "Earring", "Necklace", "Watch")
#: Which event type stands for which device.
DEVICE_OF = {"click": "Ring", "view": "Earring", "purchase": "Necklace", "signup": "Watch"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant, role, ord, t (microseconds), x."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("participant"), F.col("event_type").alias("role"), F.col("event_id").alias("ord"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("x"))


SAMPLES_SQL = "samples AS (SELECT user_id AS participant, event_type AS role, event_id AS ord, epoch_us(ts) AS t, value AS x FROM events)"


def windows64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, w: 64-sample windows at 8 Hz."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("w"))


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the folder that executors share; in a local folder in a local session only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='wavelane-')}"
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def scratch_csv(rows: DataFrame, by: str, order: str, **options) -> str:
    """Rows as CSV files, one in a folder of its own for each value of ``by``, in order of ``order`` (which isn't written), for the readers of such files."""
    path = f"{scratch(rows.sparkSession, 'csv')}.csv"
    rows.repartition(by).sortWithinPartitions(by, order).drop(order).write.partitionBy(by).options(**options).csv(path)
    return path
