"""Leave-one-participant-out folds and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def hash_share(*parts: Column) -> Column:
    """The first four bytes of an md5 over the parts, as eight hex digits: alike in any engine and order."""
    return F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8)


def below(share: Column, of: float) -> Column:
    """Whether a hash share lies below a part of the whole, from 0 (none) to 1 (all)."""
    edge = round(of * 2**32)
    return F.lit(True) if edge >= 2**32 else share < f"{max(0, edge):08x}"


def fold_split(target: Column, participant: str, key: list[str], validation: float = 0.2) -> Column:
    """The split of a row in a target's fold: no rows are copied where one fold is wanted at a time."""
    return F.when(F.col(participant) == target, "test").when(below(hash_share(target, *map(F.col, key)), validation), "val").otherwise("train")


def loso_folds(rows: DataFrame, participant: str, key: list[str], validation: float = 0.2, targets: DataFrame | None = None) -> DataFrame:
    """Rows for each target participant: ``test`` for its own, ``val`` or ``train`` for the others' by a hash of target and key.

    Targets are the distinct participants, a list whose size the caller knows; they are broadcast only if the
    optimizer finds them small enough. All folds at once multiply the rows by the targets; see :func:`fold_split` for one.
    """
    names = (targets or rows.select(participant).distinct()).select(F.col(participant).alias("target"))
    return rows.join(names).withColumn("split", fold_split(F.col("target"), participant, key, validation))


def two_way(rows: DataFrame, key: list[str], test: float, seed: int = 0) -> DataFrame:
    """``split``: train or test by a seeded hash of the key."""
    return rows.withColumn("split", F.when(below(hash_share(F.lit(seed), *map(F.col, key)), test), "test").otherwise("train"))


def three_way(rows: DataFrame, key: list[str], validation: float, test: float, seed: int = 0) -> DataFrame:
    """``split``: train, val or test by a seeded hash of the key."""
    h = hash_share(F.lit(seed), *map(F.col, key))
    return rows.withColumn("split", F.when(below(h, test), "test").when(below(h, test + validation), "val").otherwise("train"))


def grouped_split(rows: DataFrame, group: str, test: float, seed: int = 0) -> DataFrame:
    """``split`` by a hash of the group, so that overlapping windows of one group stay on one side."""
    return two_way(rows, [group], test, seed)


def fold_seed(base: int, fold: int) -> int:
    """A seed of its own for each fold."""
    return base * 10 + fold


def pooled(parts: list[DataFrame]) -> DataFrame:
    """All rows of several tables of one schema."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
