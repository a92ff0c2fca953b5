"""Error metrics, ratios and small statistics. NaN is treated as missing; zero rows give nulls, not errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def clean(x: str) -> Column:
    """A number with NaN as null."""
    return F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double"))


def error_metrics(pairs: DataFrame, keys: list[str], truth: str, estimate: str, zero_r: bool = False) -> DataFrame:
    """n, valid (rows with an estimate), valid_pct, and over rows that have both numbers mae, rmse and r, by keys.

    ``r`` is null on constant input, or 0.0 with ``zero_r``. One pass of plain aggregates, combined before the shuffle.
    """
    rows = pairs.withColumn("_y", clean(truth)).withColumn("_x", clean(estimate))
    both = F.col("_y").isNotNull() & F.col("_x").isNotNull()
    y, x = F.when(both, F.col("_y")), F.when(both, F.col("_x"))
    r = F.try_divide(F.covar_pop(y, x), F.stddev_pop(y) * F.stddev_pop(x))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("_x").alias("valid"), F.avg(F.abs(y - x)).alias("mae"), F.sqrt(F.avg((y - x) * (y - x))).alias("rmse"), r.alias("r"),
    )
    if zero_r:
        out = out.withColumn("r", F.coalesce(F.when(~F.isnan("r"), F.col("r")), F.lit(0.0)))
    return out.withColumn("valid_pct", F.try_divide(F.lit(100.0) * F.col("valid"), F.col("n")))


def macro_metrics(folds: DataFrame, metrics: list[str], keys: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of each metric over folds (not over rows)."""
    cols = [c for m in metrics for c in (F.avg(clean(m)).alias(f"{m}_mean"), F.stddev_pop(clean(m)).alias(f"{m}_std"))]
    return folds.groupBy(*(keys or [])).agg(F.count("*").alias("n_folds"), *cols)


def valid_ratio(windows: DataFrame, keys: list[str], valid: Column) -> DataFrame:
    """n_windows, n_valid and their ratio by keys."""
    out = windows.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.count_if(valid).alias("n_valid"))
    return out.withColumn("valid_ratio", F.try_divide(F.col("n_valid").cast("double"), F.col("n_windows")))


def sampling_rate(rows: DataFrame, keys: list[str], t: str, ord: str, per_second: float = 1000.0, bucket: float | None = None) -> DataFrame:
    """fs by keys: units a second over the median difference of neighbouring times; null with fewer than two rows or a median of 0 or less.

    With ``bucket``, a width of time, differences are taken within buckets and between the ends of neighbouring ones, and the median is :func:`exact_median`'s,
    so that a key that holds a large share of all rows is spread over many tasks.
    """
    if bucket is None:
        order = Window.partitionBy(*keys).orderBy(t, ord)
        step = rows.select(*keys, (F.col(t) - F.lag(t).over(order)).cast("double").alias("_d"), F.lit(1).alias("_k"))
    else:
        parts = [*keys, "_bucket"]
        placed = rows.withColumn("_bucket", F.floor(F.col(t) / bucket))
        inside = placed.select(*keys, (F.col(t) - F.lag(t).over(Window.partitionBy(*parts).orderBy(t, ord))).cast("double").alias("_d"), F.lit(1).alias("_k"))
        ends = placed.groupBy(*parts).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
        between = (F.col("_lo") - F.lag("_hi").over(Window.partitionBy(*keys).orderBy("_bucket"))).cast("double")
        step = inside.unionByName(ends.select(*keys, between.alias("_d"), F.lit(0).alias("_k")))
    if bucket is None:
        out = step.groupBy(*keys).agg(F.sum("_k").alias("n"), F.median(F.when(~F.isnan("_d"), F.col("_d"))).alias("_m"))
    else:
        middle = exact_median(step, keys, "_d").select(F.struct(*keys).alias("_key"), F.col("median").alias("_m"))
        out = step.groupBy(*keys).agg(F.sum("_k").alias("n")).withColumn("_key", F.struct(*keys)).join(middle, "_key", "left").drop("_key")
    return out.withColumn("fs", F.when(F.col("_m") > 0, F.lit(per_second) / F.col("_m"))).drop("_m")


#: Bits of the mantissa that the second to the fourth digit of a number hold.
_BITS = (17, 17, 18)


def _digits(x: Column) -> list[Column]:
    """Whole numbers that order as ``x``, a double other than NaN, does: its signed exponent, then its mantissa in three signed parts.
    Powers of two are exact, so the parts are exact too."""
    size, top = F.abs(x), F.lit(float("inf"))
    plain = F.when((size > 0) & (size < top), size)
    guess = F.when(plain.isNotNull(), F.greatest(F.floor(F.log2(plain)).cast("int"), F.lit(-1074)))
    ratio = plain / F.pow(F.lit(2.0), guess)
    exponent = guess + F.when(ratio >= 2, 1).when(ratio < 1, -1).otherwise(0)
    mantissa = F.coalesce(((plain / F.pow(F.lit(2.0), exponent) - 1) * float(1 << 52)).cast("long"), F.lit(0).cast("long"))
    sign = F.when(x < 0, -1).otherwise(1)
    parts, left = [F.coalesce(exponent, F.when(size == 0, -1100).otherwise(1100)) + 1101], 52
    for bits in _BITS:
        left -= bits
        parts.append(F.shiftright(mantissa, left).bitwiseAND(F.lit((1 << bits) - 1)))
    return [(sign * p).cast("long") for p in parts]


def exact_median(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, n, median) of the numbers of ``x``, nulls and NaN left out; a key without numbers has no row.

    Counts by value and key are summed by digits, most significant first, and only the bucket that holds the middle goes to the next digit. No buffer holds a key's
    values, as that of an ordinary median does: a window has at most as many rows as a digit has values (262,144), however many rows a key has.
    """
    values = rows.select(F.struct(*keys).alias("_key"), clean(x).alias("_x")).where(F.col("_x").isNotNull())
    counts = values.groupBy("_key", "_x").agg(F.count("*").alias("_c"))
    n = counts.groupBy("_key").agg(F.sum("_c").alias("n"))
    placed = counts.select("_key", "_x", "_c", *(d.alias(f"_d{k}") for k, d in enumerate(_digits(F.col("_x")))))
    middles = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))
    # _rank: the place among all numbers of the key that is sought; _rest: the place among those that share the digits found so far.
    sought = n.select("_key", F.explode(middles).alias("_rank")).withColumn("_rest", F.col("_rank"))
    path = ["_key"]
    for k in range(len(_BITS) + 1):
        digit = f"_d{k}"
        sums = placed.join(sought, path).groupBy(*path, "_rank", "_rest", digit).agg(F.sum("_c").alias("_s"))
        upto = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy("_key", "_rank").orderBy(digit)) - F.col("_s"))
        path = [*path, digit]
        sought = upto.where((F.col("_rest") > F.col("_before")) & (F.col("_rest") <= F.col("_before") + F.col("_s"))).select(*path, "_rank", (F.col("_rest") - F.col("_before")).alias("_rest"))
    middles = placed.join(sought, path).groupBy("_key").agg(F.avg("_x").alias("median"))
    return n.join(middles, "_key").select(*(F.col("_key")[k].alias(k) for k in keys), "n", "median")


def value_range(rows: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Least and greatest value by keys; no rows, no result."""
    return rows.groupBy(*keys).agg(F.min(clean(x)).alias("least"), F.max(clean(x)).alias("greatest"))


def chunk_extremes(rows: DataFrame, keys: list[str], i: str, x: str, chunk: int, spread: bool = False) -> DataFrame:
    """Median over chunks of rows of the chunks' least and greatest values. ``spread``: by :func:`exact_median`, for keys with very many chunks."""
    parts = rows.withColumn("_c", F.floor(F.col(i) / chunk)).groupBy(*keys, "_c").agg(F.min(clean(x)).alias("_lo"), F.max(clean(x)).alias("_hi"))
    if not spread:
        return parts.groupBy(*keys).agg(F.median("_lo").alias("least"), F.median("_hi").alias("greatest"))
    sides = [exact_median(parts, keys, c).select(F.struct(*keys).alias("_key"), F.col("median").alias(name)) for c, name in (("_lo", "least"), ("_hi", "greatest"))]
    out = parts.select(*keys).distinct().withColumn("_key", F.struct(*keys))
    return out.join(sides[0], "_key", "left").join(sides[1], "_key", "left").drop("_key")


def column_zscore(rows: DataFrame, columns: list[str], epsilon: float = 1e-6) -> DataFrame:
    """Columns less their means over the population deviation plus epsilon; the statistics are one row, joined to all."""
    stats = rows.agg(*(f(clean(c)).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = rows.join(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(c, (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + epsilon))
    return out.drop(*stats.columns)


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Rows with ``weight``, the inverse of their class's share over the number of classes."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k"))
    return rows.join(counts.join(F.broadcast(total)), label).withColumn("weight", F.col("_all") / (F.col("_k") * F.col("_n"))).drop("_n", "_all", "_k")
