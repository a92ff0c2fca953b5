"""Array functions of single windows as Catalyst expressions: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row: a lambda's variable, where a plain expression inside another
    lambda would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def detrend(values: Column) -> Column:
    """Values less their least-squares line."""
    n = F.size(values).cast("double")
    middle = (n - 1) / 2

    def line(m: Column) -> Column:
        moments = F.transform(values, lambda x, i: (i.cast("double") - middle) * (x.cast("double") - m))
        slope = F.coalesce(F.try_divide(_sum(moments), n * (n * n - 1) / 12), F.lit(0.0))
        return let(slope, lambda b: F.transform(values, lambda x, i: x.cast("double") - m - b * (i.cast("double") - middle)))

    return let(_sum(values) / n, line)


def mean(values: Column) -> Column:
    """Mean of an array; null for none."""
    return F.when(F.size(values) > 0, _sum(values) / F.size(values))


def deviation(values: Column) -> Column:
    """Population standard deviation of an array; null for none."""
    squares = let(mean(values), lambda m: F.aggregate(values, F.lit(0.0), lambda a, x: a + (x.cast("double") - m) * (x.cast("double") - m)))
    return F.when(F.size(values) > 0, F.sqrt(squares / F.size(values)))


def zscore(values: Column, epsilon: float = 1e-6) -> Column:
    """(x - mean) / (population deviation + epsilon); all 0 for constant values."""
    both = F.struct(mean(values).alias("m"), deviation(values).alias("s"))
    return let(both, lambda b: F.transform(values, lambda x: (x.cast("double") - b["m"]) / (b["s"] + epsilon)))


def stack_channels(*channels: Column) -> Column:
    """Time-major array of the channels' values, as long as the shortest channel."""
    n = F.least(*(F.size(c) for c in channels)) if len(channels) > 1 else F.size(channels[0])
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array(*(F.element_at(c, i).cast("double") for c in channels)))).otherwise(F.array().cast("array<array<double>>"))


def all_finite(values: Column) -> Column:
    """Whether no value is null, NaN or infinite."""
    return ~F.exists(values, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))


def model_input(hr: Column, values: list[Column], low: float = 30.0, high: float = 210.0) -> Column:
    """Condition: a finite rate inside the closed band, and finite samples."""
    ok = hr.isNotNull() & ~F.isnan(hr.cast("double")) & hr.between(low, high)
    for v in values:
        ok = ok & all_finite(v)
    return ok


def subset_columns(devices: list[str], kinds: list[str], picked: list[int], prefix: str = "ppg_") -> list[str]:
    """Column names of the picked devices' channels, in the devices' order."""
    if not picked or any(k < 0 or k >= len(devices) for k in picked):
        raise ValueError(f"device indices must lie in 0..{len(devices) - 1}")
    return [f"{prefix}{devices[k]}" + (f"_{kind}" if kind else "") for k in picked for kind in (kinds or [""])]


def sorted_distinct(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def allclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether two arrays have one length and close values; NaN equals NaN."""
    def close(x: Column, y: Column) -> Column:
        both = F.isnan(x) & F.isnan(y)
        return both | (~F.isnan(x) & ~F.isnan(y) & ((x == y) | (F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y))))

    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, close), lambda ok: F.coalesce(ok, F.lit(False)))


def one_hot_label(values: Column) -> Column:
    """Place, from 0, of the greatest value; the first of equals."""
    return F.array_position(values, F.array_max(values)) - 1


def clock(seconds: Column) -> Column:
    """Whole seconds as HH:MM:SS; hours may pass 24."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.expr("0L") + F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def run_label(role: Column, channel: Column) -> Column:
    """Short label of a device and channel, such as earring2_ir for Earring_2 and ppg_ir."""
    return F.concat_ws("_", F.lower(F.replace(role, F.lit("_"), F.lit(""))), F.regexp_replace(channel, "^ppg_", ""))


def merge_close(peaks: Column, values: Column, distance: Column | int) -> Column:
    """Peak places, rising, at least ``distance`` apart: of two closer ones the one with the larger value stays, one after the other."""
    gap = distance if isinstance(distance, Column) else F.lit(distance)

    def step(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        better = F.element_at(values, p + 1) > F.element_at(values, last + 1)
        joined = F.when(better, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(p))).otherwise(kept)
        return F.when(F.size(kept) == 0, F.array(p)).when(p - last < gap, joined).otherwise(F.concat(kept, F.array(p)))

    return F.aggregate(peaks, F.array().cast("array<int>"), lambda kept, p: step(kept, p.cast("int")))
