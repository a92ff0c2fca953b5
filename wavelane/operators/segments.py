"""Gap segmentation, interval overlap, nested regions and interval-union coverage.

Times are numbers (milliseconds or microseconds); ``ord`` orders equal times. A break is a gap
strictly above the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def finite(df: DataFrame, t: str) -> DataFrame:
    """Rows whose time is neither null, NaN nor infinite."""
    x = F.col(t).cast("double")
    return df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def in_range(t: str, start: Column | float, end: Column | float) -> Column:
    """Closed time range."""
    return (F.col(t) >= start) & (F.col(t) <= end)


def with_runs(df: DataFrame, keys: list[str], t: str, ord: str, gap: float, run: str = "run", bucket: float | None = None) -> DataFrame:
    """Adds the number, from 0, of each row's maximal gap-free run within its keys.

    One sort by keys and time serves the lag and the running sum; with ``bucket`` see :func:`bucketed_runs`.
    """
    if bucket is not None:
        return bucketed_runs(df, keys, t, ord, gap, bucket, run).drop("_place")
    order = Window.partitionBy(*keys).orderBy(t, ord)
    step = F.when(F.col(t) - F.lag(t).over(order) > gap, 1).otherwise(0)
    return df.withColumn("_break", step).withColumn(run, F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_break")


def bucketed_runs(df: DataFrame, keys: list[str], t: str, ord: str, gap: float, bucket: float, run: str = "run", place: str = "_place") -> DataFrame:
    """Adds each row's run and its place, from 0, in the run, without gathering a key's rows in one task.

    Rows are numbered within buckets of time; one row a bucket, with its times at both ends and the rows of its first and last
    run, is numbered along each key; and the rows of a bucket get what its own row says. Rows and summaries are dealt by the
    same key and bucket.
    """
    parts = [*keys, "_bucket"]
    order = Window.partitionBy(*parts).orderBy(t, ord).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_bucket", F.floor(F.col(t) / bucket))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*parts).orderBy(t, ord)))
    rows = rows.withColumn("_break", F.when(F.col(t) - F.lag(t).over(Window.partitionBy(*parts).orderBy(t, ord)) > gap, 1).otherwise(0))
    rows = rows.withColumn("_run", F.sum("_break").over(order)).withColumn("_first", F.max(F.when((F.col("_break") == 1) | (F.col("_n") == 1), F.col("_n"))).over(order))
    ends = rows.groupBy(*parts).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"), F.max("_run").alias("_breaks"), F.count("*").alias("_rows"), F.max("_first").alias("_last_first"))
    along = Window.partitionBy(*keys).orderBy("_bucket")
    sofar = along.rowsBetween(Window.unboundedPreceding, 0)
    # What a bucket adds to the run that goes on into the next one: its last run, or all of it.
    ends = ends.withColumn("_tail", F.when(F.col("_breaks") > 0, F.col("_rows") - F.col("_last_first") + 1).otherwise(F.col("_rows")))
    ends = ends.withColumn("_apart", F.coalesce((F.col("_lo") - F.lag("_hi").over(along) > gap).cast("int"), F.lit(0)))
    ends = ends.withColumn("_before", F.coalesce(F.lag("_breaks").over(along), F.lit(0))).withColumn("_base", F.when(F.col("_apart") == 1, 0).otherwise(F.coalesce(F.lag("_tail").over(along), F.lit(0))))
    ends = ends.withColumn("_runs_before", F.sum(F.col("_before") + F.col("_apart")).over(sofar)).withColumn("_chain", F.sum(F.when((F.col("_apart") == 1) | (F.col("_before") > 0), 1).otherwise(0)).over(sofar))
    ends = ends.withColumn("_rows_before", F.sum("_base").over(Window.partitionBy(*keys, "_chain").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.join(ends.select(*parts, "_runs_before", "_rows_before"), parts)
    out = out.withColumn(run, (F.col("_run") + F.col("_runs_before")).cast("long"))
    out = out.withColumn(place, (F.col("_n") - F.col("_first") + F.when(F.col("_run") == 0, F.col("_rows_before")).otherwise(0)).cast("long"))
    return out.drop("_bucket", "_n", "_break", "_run", "_first", "_runs_before", "_rows_before")


def gap_segments(df: DataFrame, keys: list[str], t: str, ord: str, gap: float, bucket: float | None = None) -> DataFrame:
    """Segments (keys, segment, start, end, n); a lone row is a segment of zero length.

    With ``bucket`` (a width of time), rows are first segmented within buckets and only the buckets' segments are
    then joined along each key, so that a key which holds a large share of all rows is spread over many tasks.
    """
    if bucket is None:
        return with_runs(df, keys, t, ord, gap, "segment").groupBy(*keys, "segment").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n"))
    placed = df.withColumn("_bucket", F.floor(F.col(t) / bucket))
    part = gap_segments(placed, [*keys, "_bucket"], t, ord, gap)
    order = Window.partitionBy(*keys).orderBy("start", "end")
    joined = part.withColumn("_break", F.when(F.col("start") - F.lag("end").over(order) > gap, 1).otherwise(0))
    joined = joined.withColumn("segment", F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return joined.groupBy(*keys, "segment").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Overlaps (keys, a_segment, b_segment, start, end) of two sets of segments; segments that only touch give none.

    Segments are listed under each bucket of ``width`` that they reach, and a pair is met in the bucket where its overlap begins: so
    segments of one key meet only those near them in time, and a large key spreads over its time.
    """

    def listed(segments: DataFrame, name: str) -> DataFrame:
        own = segments.select(*keys, F.col("segment").alias(f"{name}_segment"), F.col("start").alias(f"_{name}s"), F.col("end").alias(f"_{name}e"))
        return own.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(f"_{name}s") / width), F.floor(F.col(f"_{name}e") / width))))

    both = listed(a, "a").join(listed(b, "b"), [*keys, "_bucket"]).where("_as < _be AND _bs < _ae")
    both = both.withColumns({"start": F.greatest("_as", "_bs"), "end": F.least("_ae", "_be")})
    return both.where((F.col("end") > F.col("start")) & (F.col("_bucket") == F.floor(F.col("start") / width))).select(*keys, "a_segment", "b_segment", "start", "end")


def place_in_intervals(rows: DataFrame, intervals: DataFrame, keys: list[str], t: str, start: str, end: str, width: float, how: str = "inner") -> DataFrame:
    """Rows joined to the intervals that hold them (both ends count).

    Intervals are listed under each bucket of ``width`` that they reach, which gives the range join an equality to
    shuffle on: the bucket, so that a large key spreads over its time.
    """
    listed = intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    placed = rows.withColumn("_bucket", F.floor(F.col(t) / width))
    return placed.join(listed, [*keys, "_bucket"], how).where((F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end))).drop("_bucket")


def nested_regions(a: DataFrame, b_runs: DataFrame, keys: list[str], t: str, ord: str, gap: float, width: float, bucket: float | None = None) -> DataFrame:
    """Rows of ``a`` within runs (keys, segment, start, end) of another signal, with their own runs inside each.

    Returns the rows with b_segment, b_start, b_end and run; a region that holds fewer than two rows has none. With ``bucket``
    also their place in the run, as ``_place``, and no region's rows are gathered in one task.
    """
    regions = b_runs.select(*keys, F.col("segment").alias("b_segment"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    rows = place_in_intervals(a, regions, keys, t, "b_start", "b_end", width)
    region = [*keys, "b_segment"]
    if bucket is not None:
        enough = rows.groupBy(*region).agg(F.count("*").alias("_n")).where("_n >= 2").drop("_n")
        return bucketed_runs(rows.join(enough, region), region, t, ord, gap, bucket)
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*region))).where("_n >= 2").drop("_n")
    return with_runs(rows, region, t, ord, gap)


def region_segments(a: DataFrame, b_runs: DataFrame, keys: list[str], t: str, ord: str, gap: float, width: float, bucket: float | None = None) -> DataFrame:
    """Segments (keys, b_segment, b_start, b_end, run, start, end, n) of :func:`nested_regions`."""
    rows = nested_regions(a, b_runs, keys, t, ord, gap, width, bucket)
    return rows.groupBy(*keys, "b_segment", "b_start", "b_end", "run").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n"))


def coverage(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Length of the union of each key's intervals (keys, covered, n_merged); touching intervals merge, empty ones don't count."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    rows = finite(finite(intervals, start), end).where(F.col(end) > F.col(start))
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy(*keys, "_island").agg(F.min(start).alias("_s"), F.max(end).alias("_e"))
    return islands.groupBy(*keys).agg(F.sum(F.col("_e") - F.col("_s")).alias("covered"), F.count("*").alias("n_merged"))
