"""Beat-quality labels of windows, given the beats, and what is kept by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wavelane.functions.arrays import deviation, mean

#: Reasons in the order in which they are tested.
REASONS = ("contains_nan", "too_short", "too_few_beats", "no_rr", "implausible_hr", "implausible_rr", "rr_too_irregular", "poor_quality", "ok", "exception")


def quality_text(label: Column) -> Column:
    """A quality label as text; ``unknown`` if it is null or empty."""
    text = F.trim(label.cast("string"))
    return F.when(text.isNull() | (text == ""), "unknown").otherwise(text)


def rr_intervals(peaks: Column, fs: Column | float) -> Column:
    """Differences of neighbouring peak positions in seconds."""
    rate = fs if isinstance(fs, Column) else F.lit(float(fs))
    return F.when(F.size(peaks) > 1, F.transform(F.sequence(F.lit(2), F.size(peaks)), lambda k: (F.element_at(peaks, k) - F.element_at(peaks, k - 1)) / rate)).otherwise(F.array().cast("array<double>"))


def median(values: Column) -> Column:
    """Median of an array, the mean of the middle two for an even count; null for none."""
    s, n = F.array_sort(values), F.size(values)
    low, high = (n - 1) / 2, n / 2
    return F.when(n > 0, (F.element_at(s, F.floor(low).cast("int") + 1) + F.element_at(s, F.floor(high).cast("int") + 1)) / 2)


def label_cascade(windows: DataFrame, n_samples: Column, has_nan: Column, peaks: Column, fs: Column | float, quality: Column, min_samples: int = 50, min_beats: int = 4, hr_band: tuple[float, float] = (40.0, 180.0), rr_band: tuple[float, float] = (0.25, 2.0), max_cv: float = 0.2, poor: tuple[str, ...] = ("Unacceptable",), failed: Column | None = None) -> DataFrame:
    """Adds n_peaks, rr_median, rr_cv, hr, quality, reason and valid; the first failing test gives the reason, and ``exception`` that the
    search for beats has ``failed``.

    ``hr`` is 60 over the median interval, and null unless the window is valid.
    """
    out = windows.withColumn("_peaks", peaks).withColumn("_rr", rr_intervals(F.col("_peaks"), fs))
    out = out.withColumn("n_peaks", F.coalesce(F.size("_peaks"), F.lit(0)).cast("long")).withColumn("quality", quality_text(quality))
    out = out.withColumn("rr_median", median(F.col("_rr"))).withColumn("rr_cv", F.try_divide(deviation(F.col("_rr")), mean(F.col("_rr"))))
    hr = F.try_divide(F.lit(60.0), F.col("rr_median"))
    reason = (
        F.when(has_nan, "contains_nan").when(n_samples < min_samples, "too_short").when(F.lit(False) if failed is None else failed, "exception").when(F.col("n_peaks") < min_beats, "too_few_beats")
        .when(F.size("_rr") == 0, "no_rr").when(hr.isNull() | (hr < hr_band[0]) | (hr > hr_band[1]), "implausible_hr")
        .when(F.exists("_rr", lambda r: (r < rr_band[0]) | (r > rr_band[1])), "implausible_rr").when(F.col("rr_cv") > max_cv, "rr_too_irregular")
        .when(F.col("quality").isin(*poor), "poor_quality").otherwise("ok")
    )
    out = out.withColumn("reason", reason).withColumn("valid", F.col("reason") == "ok")
    return out.withColumn("hr", F.when(F.col("valid"), hr)).drop("_peaks", "_rr")


def keep_valid(labelled: DataFrame) -> DataFrame:
    """Valid windows, with all that they carry."""
    return labelled.where("valid")


def label_summary(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Windows kept and dropped by keys, and dropped ones by reason."""
    reasons = [F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in REASONS]
    return labelled.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.count_if("valid").alias("n_kept"), F.count_if(~F.col("valid")).alias("n_dropped"), *reasons)
