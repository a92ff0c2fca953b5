"""Alignment of windows across channels and devices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The order of devices that breaks a tie for the base device.
DEVICE_ORDER = ("Ring", "Earring", "Necklace", "Watch")


def window_key(t: str) -> Column:
    """A time rounded half to even, as an integer."""
    return F.rint(F.col(t).cast("double")).cast("long")


def keyed_realign(reference: DataFrame, source: DataFrame, keys: list[str], ord: str, t0: str = "t0", t1: str = "t1") -> DataFrame:
    """For each window of ``reference`` (in its order, ``ref_ord``) the source window with the same rounded times.

    Of source windows with equal keys the last counts. ``missing`` marks reference windows without one; the caller
    treats any as an error.
    """
    k0, k1 = window_key(t0), window_key(t1)
    last = source.withColumn("_k0", k0).withColumn("_k1", k1)
    last = last.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_k0", "_k1").orderBy(F.col(ord).desc()))).where("_r = 1").drop("_r", t0, t1)
    last = last.withColumnRenamed(ord, "src_ord").withColumn("_there", F.lit(True))
    wanted = reference.withColumn("_k0", k0).withColumn("_k1", k1).withColumnRenamed(ord, "ref_ord")
    wanted = wanted.select(*keys, "_k0", "_k1", "ref_ord")
    return wanted.join(last, [*keys, "_k0", "_k1"], "left").withColumn("missing", F.col("_there").isNull()).drop("_there").withColumnsRenamed({"_k0": "t0_key", "_k1": "t1_key"})


def merge_channels(a: DataFrame, b: DataFrame, keys: list[str], shared: list[str], own: list[str], labels: list[str], t0: str = "t0", t1: str = "t1", ord: str = "ord") -> DataFrame:
    """One row a window with ``a_<own>``, ``b_<own>``, the shared columns and ``same``, whether these agree.

    The side that has labels is the reference, and its labels and order count; if both or neither have, ``a`` is.
    """
    labelled = [all(c in df.columns for c in labels) for df in (a, b)]
    swap = labelled == [False, True]
    ref, other = (b, a) if swap else (a, b)
    names = ("b", "a") if swap else ("a", "b")
    carried = [c for c in labels if c in ref.columns]
    x = ref.select(*keys, window_key(t0).alias("t0_key"), window_key(t1).alias("t1_key"), ord, *shared, *carried, *(F.col(c).alias(f"{names[0]}_{c}") for c in own))
    y = other.select(*keys, window_key(t0).alias("t0_key"), window_key(t1).alias("t1_key"), *(F.col(c).alias(f"_{c}") for c in shared), *(F.col(c).alias(f"{names[1]}_{c}") for c in own))
    both = x.join(y, [*keys, "t0_key", "t1_key"])
    same = reduce(lambda p, c: p & F.col(c).eqNullSafe(F.col(f"_{c}")), shared, F.lit(True))
    return both.withColumn("same", same).drop(*(f"_{c}" for c in shared))


def merge_problems(a: DataFrame, b: DataFrame, keys: list[str], shared: list[str], t0: str = "t0", t1: str = "t1") -> DataFrame:
    """Counts by keys of windows that one side lacks, and of windows whose shared columns differ: all 0 if a merge is valid."""
    x = a.select(*keys, window_key(t0).alias("_k0"), window_key(t1).alias("_k1"), *shared, F.lit(1).alias("_a"))
    y = b.select(*keys, window_key(t0).alias("_k0"), window_key(t1).alias("_k1"), *(F.col(c).alias(f"_{c}") for c in shared), F.lit(1).alias("_b"))
    both = x.join(y, [*keys, "_k0", "_k1"], "full")
    differ = ~reduce(lambda p, c: p & F.col(c).eqNullSafe(F.col(f"_{c}")), shared, F.lit(True))
    return both.groupBy(*keys).agg(
        F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & differ).alias("differing"),
    )


def complete_participants(windows: DataFrame, participant: str, role: str, devices: tuple[str, ...]) -> DataFrame:
    """Participants with windows of every device (relational division)."""
    rows = windows.where(F.col(role).isin(*devices)).groupBy(participant).agg(F.count_distinct(role).alias("_n"))
    return rows.where(F.col("_n") == len(devices)).select(participant)


def base_device(windows: DataFrame, participant: str, role: str, devices: tuple[str, ...]) -> DataFrame:
    """Each complete participant's device with the fewest windows; a tie goes to the first in order of ``devices``."""
    rank = F.array_position(F.array(*(F.lit(d) for d in devices)), F.col(role)).cast("int")
    counts = windows.where(F.col(role).isin(*devices)).groupBy(participant, role).agg(F.count("*").alias("n_windows")).withColumn("_rank", rank)
    best = counts.groupBy(participant).agg(F.min_by(F.struct(role, "n_windows"), F.struct("n_windows", "_rank")).alias("_b"), F.count("*").alias("_n"))
    return best.where(F.col("_n") == len(devices)).select(participant, F.col(f"_b.{role}").alias("base"), F.col("_b.n_windows").alias("n_windows"))


def nearest_align(windows: DataFrame, participant: str, role: str, t: str, ord: str, devices: tuple[str, ...], tolerance: float) -> DataFrame:
    """For each base window the nearest window of every device within the tolerance (inclusive), where all have one.

    Returns (participant, base, base_ord, t0, <device>_ord ...). A tie goes to the lower time's row, then the lower
    ``ord``; a window may serve several base windows. Times are put into buckets of the tolerance, so a base window meets
    only the windows of its own bucket and the two beside it: an equi-join on participant and bucket.
    """
    rows = windows.where(F.col(role).isin(*devices)).select(participant, role, F.col(t).alias("_t"), F.col(ord).alias("_o"))
    base = rows.join(base_device(windows, participant, role, devices), participant).where(F.col(role) == F.col("base"))
    left = base.select(participant, "base", F.col("_t").alias("t0"), F.col("_o").alias("base_ord"))
    place = F.floor(F.col("t0") / tolerance)
    listed = left.withColumn("_bucket", F.explode(F.array(place - 1, place, place + 1)))
    placed = rows.withColumn("_bucket", F.floor(F.col("_t") / tolerance))
    near = listed.join(placed, [participant, "_bucket"]).where(F.abs(F.col("_t") - F.col("t0")) <= tolerance)
    # One aggregate finds the nearest window of every device at once.
    order = F.struct(F.abs(F.col("_t") - F.col("t0")), F.col("_t"), F.col("_o"))
    picks = [F.min_by(F.when(F.col(role) == d, F.col("_o")), F.when(F.col(role) == d, order)).alias(f"{d}_ord") for d in devices]
    out = near.groupBy(participant, "base", "base_ord", "t0").agg(*picks)
    return out.where(reduce(lambda p, d: p & F.col(f"{d}_ord").isNotNull(), devices, F.lit(True)))
