"""Writers: windows, long results, predictions and summaries. All use Spark's commit protocol, so a failed write leaves no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wavelane.functions.arrays import clock
from wavelane.operators.segments import coverage


def write_windows(windows: DataFrame, path: str) -> None:
    """Windows as Parquet by participant and role; a rerun replaces the partitions that it has."""
    windows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("participant", "role").parquet(path)


def write_results(estimates: DataFrame, path: str) -> None:
    """Long estimates as CSV with a header."""
    estimates.write.mode("overwrite").option("header", True).csv(path)


def write_predictions(predictions: DataFrame, path: str, append: bool = False) -> None:
    """Space-separated participant, truth and prediction with three decimals; appending twice duplicates rows, replacing doesn't."""
    rows = predictions.select("participant", *(F.format_string("%.3f", F.col(c).cast("double")).alias(c) for c in ("ground_truth_bpm", "predicted_bpm")))
    rows.write.mode("append" if append else "overwrite").options(header=True, sep=" ").csv(path)


def read_predictions(spark, path: str) -> DataFrame:
    return spark.read.csv(path, schema="participant string, ground_truth_bpm double, predicted_bpm double", sep=" ", header=True)


def summary_lines(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """One line of text a metric: mean and population deviation over folds."""
    parts = [F.struct(F.lit(m).alias("metric"), F.format_string(f"{m.upper()}: %.4f ± %.4f", F.avg(m), F.stddev_pop(m)).alias("line")) for m in metrics]
    return folds.agg(F.array(*parts).alias("_s")).select(F.explode("_s").alias("_s")).select("_s.metric", "_s.line")


def run_log(metrics: DataFrame, form: str = "%.4f") -> DataFrame:
    """Lines of text (channel, algorithm, line) that say how each algorithm did, from rows of error metrics."""
    text = lambda c, form: F.coalesce(F.format_string(form, F.col(c)), F.lit("nan"))
    lines = F.array(F.format_string("%s: valid %d/%d (%.1f%%)", "algorithm", "valid", "n", "valid_pct"), *(F.concat(F.lit(f"  {c.upper()}: "), text(c, form)) for c in ("mae", "rmse", "r")))
    return metrics.select("channel", "algorithm", F.explode(lines).alias("line"))


def _part(n: Column, of: Column, form: str) -> Column:
    return F.format_string(form, n, *([of] if form.count("%d") == 2 else []), F.coalesce(F.try_divide(F.lit(100.0) * n, of), F.lit(0.0)))


def filter_summary(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Windows before filtering, kept and dropped, the latter two with their shares as text, by keys."""
    n = labelled.groupBy(*keys).agg(F.count("*").alias("total_windows_before"), F.count_if("valid").alias("_kept"))
    total, kept = F.col("total_windows_before"), F.col("_kept")
    return n.select(*keys, "total_windows_before", _part(kept, total, "%d (%.1f%%)").alias("kept_valid_windows"), _part(total - kept, total, "%d (%.1f%%)").alias("dropped_invalid_windows"))


def run_summary(windows: DataFrame, keys: list[str], t0: str, t1: str, valid: Column, per_second: float = 1000.0) -> DataFrame:
    """By keys: windows, the time that they cover without double counting, in seconds and as a clock, and valid ones with their share."""
    n = windows.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.count_if(valid).alias("_valid"))
    covered = coverage(windows, keys, t0, t1).select(*keys, (F.col("covered") / per_second).alias("_s"))
    out = n.join(covered, keys, "left").withColumn("effective_s", F.coalesce("_s", F.lit(0.0)))
    return out.select(*keys, "n_windows", "effective_s", clock(F.col("effective_s")).alias("effective"), _part(F.col("_valid"), F.col("n_windows"), "%d/%d (%.1f%%)").alias("valid_hr"))
