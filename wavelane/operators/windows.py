"""Sliding windows by row count that start again after gaps, interval slices, and window arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wavelane.operators.segments import bucketed_runs, nested_regions, place_in_intervals, with_runs


def _check(length: int, stride: int) -> None:
    if stride < 1 or length < 1:
        raise ValueError("window length and stride must be at least one row")
    if stride > length:
        raise ValueError("a stride above the window length has no relational form; use strided_in_order")


def strided(rows: DataFrame, run_keys: list[str], t: str, ord: str, length: int, stride: int) -> DataFrame:
    """Rows that start a window of ``length`` rows inside their run, with t0, t1 and i, the row's place in the run.

    In a gap-free run the starts are every ``stride``-th row that has enough rows after it. Rejected windows don't shift
    the grid, so filters may follow as plain predicates.
    """
    _check(length, stride)
    order = Window.partitionBy(*run_keys).orderBy(t, ord)
    out = rows.withColumn("i", (F.row_number().over(order) - 1).cast("long")).withColumn("t1", F.lead(t, length - 1).over(order))
    return out.where((F.col("i") % stride == 0) & F.col("t1").isNotNull()).withColumn("t0", F.col(t))


def strided_by_place(rows: DataFrame, run_keys: list[str], t: str, length: int, stride: int) -> DataFrame:
    """As :func:`strided`, for rows that know their ``_place``: every start is joined to its window's last row by run and place, so that a
    long run is spread over tasks."""
    _check(length, stride)
    starts = rows.where(F.col("_place") % stride == 0).withColumnRenamed("_place", "i").withColumn("t0", F.col(t)).withColumn("_end", F.col("i") + length - 1)
    return starts.join(rows.select(*run_keys, F.col("_place").alias("_end"), F.col(t).alias("t1")), [*run_keys, "_end"]).drop("_end")


def gap_restart_windows(df: DataFrame, keys: list[str], t: str, ord: str, gap: float, length: int, stride: int, span: tuple[float, float], bucket: float | None = None) -> DataFrame:
    """Windows (keys, run, i, t0, t1) of gap-free rows whose span lies in the closed range. With ``bucket``, a width of time, a key that
    holds a large share of all rows is spread over many tasks."""
    if bucket is None:
        out = strided(with_runs(df, keys, t, ord, gap), [*keys, "run"], t, ord, length, stride)
    else:
        out = strided_by_place(bucketed_runs(df, keys, t, ord, gap, bucket), [*keys, "run"], t, length, stride)
    return out.where(F.col("t1") - F.col("t0") >= span[0]).where(F.col("t1") - F.col("t0") <= span[1]).select(*keys, "run", "i", "t0", "t1")


def continuous_windows(a: DataFrame, b_runs: DataFrame, keys: list[str], t: str, ord: str, gap: float, length: int, stride: int, span: tuple[float, float], width: float, bucket: float | None = None) -> DataFrame:
    """Windows (keys, b_segment, run, i, t0, t1) where both signals run on without a gap."""
    rows, run_keys = nested_regions(a, b_runs, keys, t, ord, gap, width, bucket), [*keys, "b_segment", "run"]
    out = strided(rows, run_keys, t, ord, length, stride) if bucket is None else strided_by_place(rows, run_keys, t, length, stride)
    return out.where(F.col("t1") - F.col("t0") >= span[0]).where(F.col("t1") - F.col("t0") <= span[1]).select(*keys, "b_segment", "run", "i", "t0", "t1")


def region_windows(a: DataFrame, regions: DataFrame, keys: list[str], t: str, ord: str, gap: float, length: int, stride: int, span: tuple[float, float], width: float) -> DataFrame:
    """Windows (keys, region, run, i, t0, t1) of gap-free rows inside closed regions (keys, region, start, end)."""
    rows = place_in_intervals(a, regions, keys, t, "start", "end", width)
    rows = with_runs(rows.drop("start", "end"), [*keys, "region"], t, ord, gap)
    out = strided(rows, [*keys, "region", "run"], t, ord, length, stride)
    return out.where(F.col("t1") - F.col("t0") >= span[0]).where(F.col("t1") - F.col("t0") <= span[1]).select(*keys, "region", "run", "i", "t0", "t1")


def with_fallback(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """``first``, and for the keys that have no row there ``second``; ``fallback`` tells which."""
    other = second.join(first.select(*keys).distinct(), keys, "left_anti")
    return first.withColumn("fallback", F.lit(False)).unionByName(other.withColumn("fallback", F.lit(True)))


def slice_counts(windows: DataFrame, rows: DataFrame, keys: list[str], t: str, width: float, columns: list[str]) -> DataFrame:
    """The windows with ``n_slice``, the rows at t0 <= t <= t1; windows are told apart by ``columns``."""
    at = rows.select(*keys, F.col(t).alias("_t"))
    inside = place_in_intervals(at, windows.select(*columns), keys, "_t", "t0", "t1", width).groupBy(*columns).agg(F.count("*").alias("n_slice"))
    return windows.join(inside, columns, "left").withColumn("n_slice", F.coalesce("n_slice", F.lit(0)).cast("long"))


def slice_arrays(windows: DataFrame, rows: DataFrame, keys: list[str], t: str, ord: str, x: str, width: float, columns: list[str]) -> DataFrame:
    """Windows with ``slice``: the values at t0 <= t <= t1 by time; windows without any have none and are left out."""
    at = rows.select(*keys, F.col(t).alias("_t"), F.col(ord).alias("_o"), F.col(x).alias("_x"))
    inside = place_in_intervals(at, windows.select(*columns), keys, "_t", "t0", "t1", width)
    sorted_ = F.array_sort(F.collect_list(F.struct("_t", "_o", "_x")))
    return inside.groupBy(*columns).agg(sorted_.alias("_s")).withColumn("slice", F.col("_s._x")).drop("_s")


def padded(values: Column, size: int) -> Column:
    """Values with zeros up to ``size``; null where there are more, which the caller rejects."""
    return F.when(F.size(values) <= size, F.concat(values, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(values))))


def window_arrays(rows: DataFrame, run_keys: list[str], t: str, ord: str, values: list[str], length: int, stride: int) -> DataFrame:
    """Windows with ``<value>_window`` and ``t_window``: the arrays of the window's rows.

    Rows are gathered into blocks of one stride, and each block, not each row, is dealt to the windows that it is a part of. Rows that know
    their ``_place`` (see bucketed_runs) are not sorted by run.
    """
    _check(length, stride)
    if "_place" in rows.columns:
        placed = rows.withColumnRenamed("_place", "_i")
    else:
        placed = rows.withColumn("_i", (F.row_number().over(Window.partitionBy(*run_keys).orderBy(t, ord)) - 1).cast("long"))
    block = placed.groupBy(*run_keys, F.floor(F.col("_i") / stride).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_i", F.col(t).alias("_t"), *values))).alias("_s"))
    reach = (length - 1) // stride
    own = block.withColumn("_w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_b") - reach), F.col("_b"))))
    own = own.select(*run_keys, "_w", "_b", F.expr(f"filter(_s, x -> x._i < _w * {stride} + {length})").alias("_s"))
    gathered = own.groupBy(*run_keys, "_w").agg(F.expr("flatten(transform(array_sort(collect_list(struct(_b, _s))), x -> x._s))").alias("_s"))
    out = gathered.where(F.size("_s") == length).withColumn("i", F.col("_w") * stride).withColumn("t_window", F.col("_s._t"))
    for v in values:
        out = out.withColumn(f"{v}_window", F.col("_s").getField(v))
    return out.withColumn("t0", F.element_at("t_window", 1)).withColumn("t1", F.element_at("t_window", -1)).drop("_w", "_s")


def regular_times(start: Column, n: Column, step: float) -> Column:
    """Times at a fixed pitch, for a window whose own times don't match its values in number."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: start + k * F.lit(step))


def sub_windows(values: Column, length: int, stride: int) -> Column:
    """Array of the values' sub-windows, and one at the end where the grid leaves a tail; shorter values are one."""
    n = F.size(values)
    grid = F.sequence(F.lit(0), F.greatest(F.lit(0), n - length), F.lit(stride))
    starts = F.when(n <= length, F.array(F.lit(0))).when(F.element_at(grid, -1) < n - length, F.concat(grid, F.array(n - length))).otherwise(grid)
    return F.transform(starts, lambda s: F.slice(values, s + 1, length))


def sliding(values: Column, length: int, stride: int) -> Column:
    """Array of the values' windows at every stride, without a tail."""
    n = F.size(values)
    return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length, F.lit(stride)), lambda s: F.slice(values, s + 1, length))).otherwise(F.array().cast("array<array<double>>"))


def strided_in_order(df: DataFrame, keys: list[str], t: str, ord: str, gap: float, length: int, stride: int) -> DataFrame:
    """Windows (keys, t0, t1) for any stride, found in order of time within each key, for strides above the length."""
    import pandas as pd

    if stride < 1 or length < 1:
        raise ValueError("window length and stride must be at least one row")
    kinds = dict(df.dtypes)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([t, ord])
        times, out, s = rows[t].to_numpy(), [], 0
        while s + length <= len(times):
            breaks = (times[s + 1 : s + length] - times[s : s + length - 1] > gap).nonzero()[0]
            if len(breaks):
                s += int(breaks[0]) + 1
                continue
            out.append((times[s], times[s + length - 1]))
            s += stride
        first = {k: rows[k].iloc[0] for k in keys}
        return pd.DataFrame([{**first, "t0": a, "t1": b} for a, b in out], columns=[*keys, "t0", "t1"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", t0 {kinds[t]}, t1 {kinds[t]}"
    return df.select(*keys, t, ord).groupBy(*keys).applyInPandas(walk, schema)
