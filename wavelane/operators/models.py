"""Regression baselines behind the fold and metric interface.

These are MLlib models, deliberately different from neural ones: features of a window are its
preprocessed samples or summary values. Folds and metrics are the same for any estimator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from wavelane.functions.arrays import model_input, zscore
from wavelane.operators.folds import fold_split
from wavelane.operators.metrics import error_metrics, macro_metrics

#: Sets of channels by name, for picking a model's inputs.
FEATURE_SETS = {"single": ["ppg"], "four": ["ppg_earring", "ppg_ring", "ppg_watch", "ppg_necklace"], "motion": ["ppg_green", "ppg_accel"], "infrared": ["ppg_green", "ppg_ir"]}


def with_features(windows: DataFrame, channels: list[str], hr: str, low: float = 30, high: float = 210) -> DataFrame:
    """Valid windows with ``features``: the channels' z-scored samples, one after the other, as a vector."""
    from pyspark.ml.functions import array_to_vector

    rows = windows.where(model_input(F.col(hr), [F.col(c) for c in channels], low, high))
    return rows.withColumn("features", array_to_vector(F.concat(*(zscore(F.col(c)) for c in channels))))


def linear(label: str):
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(labelCol=label, featuresCol="features", predictionCol="predicted_bpm", regParam=1.0, maxIter=20, solver="l-bfgs")


def boosted(label: str, seed: int = 40):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(labelCol=label, featuresCol="features", predictionCol="predicted_bpm", maxIter=10, maxDepth=3, seed=seed)


def leave_one_out(rows: DataFrame, participant: str, key: list[str], label: str, model: Callable = linear) -> DataFrame:
    """Predictions (participant, key, ground_truth_bpm, predicted_bpm) of each participant by a model fitted on the others.

    The loop is over participants, a short list; each fold reads the rows again, so give it a stored table rather than a long plan.
    """
    names = [r[0] for r in rows.select(participant).distinct().orderBy(participant).collect()]
    out = None
    for name in names:
        fold = rows.withColumn("split", fold_split(F.lit(name), participant, key))
        fitted = model(label).fit(fold.where("split = 'train'"))
        own = fitted.transform(fold.where("split = 'test'")).select(participant, *[k for k in key if k != participant], F.col(label).alias("ground_truth_bpm"), "predicted_bpm")
        out = own if out is None else out.unionByName(own)
    return out


def fold_report(predictions: DataFrame, participant: str) -> tuple[DataFrame, DataFrame]:
    """Metrics of each fold, and their mean and deviation."""
    folds = error_metrics(predictions, [participant], "ground_truth_bpm", "predicted_bpm", zero_r=True)
    return folds, macro_metrics(folds, ["mae", "rmse", "r"])


def grid(rows: DataFrame, participant: str, key: list[str], label: str, models: dict[str, Callable], feature_sets: dict[str, list[str]]) -> DataFrame:
    """Macro metrics of every model on every set of channels that the table has."""
    out = None
    for set_name, channels in feature_sets.items():
        if not all(c in rows.columns for c in channels):
            continue
        prepared = with_features(rows, channels, label)
        for name, model in models.items():
            one = fold_report(leave_one_out(prepared, participant, key, label, model), participant)[1].withColumns({"model": F.lit(name), "channels": F.lit(set_name)})
            out = one if out is None else out.unionByName(one)
    return out
