"""Regressors for all leave-one-participant-out folds at once: ridge from sums of products, and small networks by data-parallel steps.

Nothing loops over participants on the driver and no rows are copied by fold. What a fold needs is a sum over rows: of products for the ridge,
of gradients for a network. Tasks add up what their partitions hold, Spark adds up the tasks', and a fold's sum
is the total less its own participant's, or the sum over rows of other participants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from wavelane.operators.folds import below, hash_share
from wavelane.operators.networks import Network


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(rows: DataFrame, features: str, label: str, size: int) -> DataFrame:
    """Rows whose features are ``size`` finite numbers and whose label is finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.where((F.size(features) == size) & F.forall(features, finite) & finite(F.col(label).cast("double")))


# -- ridge -----------------------------------------------------------------------------------------------------------


def product_sums(rows: DataFrame, participant: str, features: str, label: str) -> DataFrame:
    """(participant, place, value): the sums of products of every two of 1, the features and the label, flattened. Tasks add up their rows first,
    so a participant with most of the rows sends as much as any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            names, code = np.unique(np.array(batch.column(0).to_pylist(), object).astype(str), return_inverse=True)
            z = np.column_stack([np.ones(batch.num_rows), _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)])
            for k, name in enumerate(names):
                own = z[code == k]
                sums[name] = sums.get(name, 0) + own.T @ own
        if sums:
            yield pa.RecordBatch.from_pydict({"participant": list(sums), "sums": [s.ravel().tolist() for s in sums.values()]})

    own = rows.select(F.col(participant).cast("string").alias("participant"), F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))
    parts = own.mapInArrow(run, "participant string, sums array<double>")
    return parts.select("participant", F.posexplode("sums").alias("place", "value")).groupBy("participant", "place").agg(F.sum("value").alias("value"))


def solve_ridge(sums: np.ndarray, penalty: float) -> np.ndarray | None:
    """Intercept and weights from sums of products; the intercept is free of the penalty. None without rows."""
    size = int(round(len(sums) ** 0.5))
    full = sums.reshape(size, size)
    if full[0, 0] < 0.5:
        return None
    mean = full[0, 1:-1] / full[0, 0]
    centred = full[1:-1, 1:-1] - full[0, 0] * np.outer(mean, mean)
    target = full[1:-1, -1] - mean * full[0, -1]
    weights = np.linalg.solve(centred + penalty * np.eye(size - 2), target)
    return np.concatenate([[full[0, -1] / full[0, 0] - weights @ mean], weights])


def leave_one_out_ridge(rows: DataFrame, participant: str, features: str, label: str, size: int, penalty: float = 1.0) -> DataFrame:
    """``rows`` with ``predicted_bpm`` by a ridge regression fitted on all other participants' usable rows; null where there are none, or
    where the row's own features can't be used. ``penalty`` is above 0."""
    own = product_sums(usable(rows, features, label, size).where(F.col(participant).isNotNull()), participant, features, label)
    total = own.groupBy("place").agg(F.sum("value").alias("total"))
    rest = own.join(total, "place").groupBy("participant").agg(F.array_sort(F.collect_list(F.struct("place", (F.col("total") - F.col("value")).alias("v")))).alias("s"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [solve_ridge(np.array(s), penalty) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if w is None else w.tolist() for w in weights], pa.list_(pa.float64()))], ["_name", "_weights"])

    fitted = rest.select("participant", F.transform("s", lambda e: e["v"]).alias("sums")).mapInArrow(solve, "_name string, _weights array<double>")
    out = rows.join(fitted, F.col(participant).cast("string") == F.col("_name"), "left")
    terms = F.zip_with(F.concat(F.array(F.lit(1.0)), F.col(features).cast("array<double>")), "_weights", lambda a, b: a * b)
    predicted = F.when(F.size(features) == size, F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))
    return out.withColumn("predicted_bpm", predicted).drop("_name", "_weights")


# -- networks --------------------------------------------------------------------------------------------------------


class TwoLayers:
    """Features to a hidden layer of rectified units to one value, as one vector of numbers. Without hidden units: a linear model."""

    def __init__(self, inputs: int, hidden: int):
        self.inputs, self.hidden = inputs, hidden
        self.size = (inputs + 2) * hidden + 1 if hidden else inputs + 1

    def start(self, seed: int, centre: float) -> np.ndarray:
        rng = np.random.default_rng(seed)
        if not self.hidden:
            return np.append(np.zeros(self.inputs), centre)
        bound = (6 / self.inputs) ** 0.5
        return np.concatenate([rng.uniform(-bound, bound, self.inputs * self.hidden), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), [centre]])

    def _parts(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        a, h = self.inputs * self.hidden, self.hidden
        return w[:a].reshape(self.inputs, h), w[a : a + h], w[a + h : a + 2 * h], w[-1]

    def predict(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not self.hidden:
            return x @ w[:-1] + w[-1]
        first, bias, second, last = self._parts(w)
        return np.maximum(x @ first + bias, 0) @ second + last

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """The sum of absolute errors and its gradient."""
        if not self.hidden:
            error = self.predict(w, x) - y
            sign = np.sign(error)
            return float(np.abs(error).sum()), np.append(sign @ x, sign.sum())
        first, bias, second, last = self._parts(w)
        inner = x @ first + bias
        active = np.maximum(inner, 0)
        error = active @ second + last - y
        sign = np.sign(error)
        back = np.outer(sign, second) * (inner > 0)
        return float(np.abs(error).sum()), np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), sign @ active, [sign.sum()]])


class Training:
    """Adam on the mean absolute error for all folds at once, with patience and the weights of the best validation epoch.

    ``table``: a path that every epoch's state is written under, from which an interrupted run goes on. Rows are dealt to ``batches`` by a hash of their
    key, one step each an epoch, and to validation by another; both are alike in any partitioning. The state is folds times weights, which is
    what goes to the driver and back at each step; rows stay where they are.
    """

    def __init__(self, model: TwoLayers | Network, table: str, rate: float = 5e-4, epochs: int = 20, patience: int = 5, batches: int = 4, validation: float = 0.2, seed: int = 40):
        self.model, self.table, self.rate, self.epochs, self.patience, self.batches, self.validation, self.seed = model, table, rate, epochs, patience, batches, validation, seed

    def prepared(self, rows: DataFrame, participant: str, key: list[str], features: str, label: str) -> DataFrame:
        """Usable rows as (fold, x, y, step), step -1 for validation, written under ``table`` by step once."""
        spark, path = rows.sparkSession, f"{self.table}/rows"
        own = usable(rows.where(F.col(participant).isNotNull()), features, label, self.model.inputs)
        places = [F.col(k) for k in key]
        step = F.when(below(hash_share(F.lit(self.seed), *places), self.validation), -1).otherwise(F.pmod(F.xxhash64(F.lit(self.seed), *places), F.lit(self.batches)))
        out = own.select(F.col(participant).cast("string").alias("fold"), F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), step.cast("int").alias("step"))
        out.write.mode("ignore").partitionBy("step").parquet(path)
        return spark.read.schema(out.schema).parquet(path)

    def _sums(self, rows: DataFrame, names: list[str], weights: np.ndarray, active: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By fold: rows of others, sum of errors and of gradients, added up in the tasks and then by Spark."""
        model = self.model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(names), 2 + model.size * learn))
            for batch in batches:
                own, x, y = np.array(batch.column(0).to_pylist(), object), _matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
                for k in np.flatnonzero(active):
                    others = own != names[k]
                    if learn:
                        loss, slope = model.gradient(weights[k], x[others], y[others])
                        sums[k, 2:] += slope
                    else:
                        loss = float(np.abs(model.predict(weights[k], x[others]) - y[others]).sum())
                    sums[k, :2] += others.sum(), loss
            yield pa.RecordBatch.from_pydict({"fold": np.arange(len(names)), "sums": sums.tolist()})

        parts = rows.select("fold", "x", "y").mapInArrow(run, "fold long, sums array<double>").select("fold", F.posexplode("sums").alias("place", "v"))
        out = np.zeros((len(names), 2 + model.size * learn))
        for r in parts.groupBy("fold", "place").agg(F.sum("v").alias("v")).collect():
            out[r.fold, r.place] = r.v
        return out[:, 0], out[:, 1], out[:, 2:]

    def _load(self, spark, names: list[str]) -> tuple[int, dict[str, np.ndarray]] | None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.table}/state")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return None
        state = spark.read.parquet(f"{self.table}/state")
        epoch = state.agg(F.max("epoch")).first()[0]
        rows = {r.fold: r for r in state.where(F.col("epoch") == epoch).collect()}
        return epoch, {c: np.array([rows[n][c] for n in names]) for c in ("weights", "mean", "square", "best", "best_loss", "waited", "steps")}

    def _save(self, spark, names: list[str], epoch: int, state: dict[str, np.ndarray]) -> None:
        rows = [(n, *(state[c][k].tolist() for c in ("weights", "mean", "square", "best", "best_loss", "waited", "steps"))) for k, n in enumerate(names)]
        schema = "fold string, weights array<double>, mean array<double>, square array<double>, best array<double>, best_loss double, waited long, steps long"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{self.table}/state/epoch={epoch}")

    def fit(self, rows: DataFrame, participant: str, key: list[str], features: str, label: str) -> DataFrame:
        """(fold, weights, loss, epochs): each participant's model, learned from the others, by its best mean of validation errors."""
        spark = rows.sparkSession
        table = self.prepared(rows, participant, key, features, label)
        known = table.groupBy("fold").agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("fold").collect()
        names = [r.fold for r in known]
        total = sum(r.y for r in known), sum(r.n for r in known)
        centre = [(total[0] - r.y) / max(1, total[1] - r.n) for r in known]
        folds, size = len(names), self.model.size
        begin = np.stack([self.model.start(self.seed * 10 + k, c) for k, c in enumerate(centre)]) if folds else np.zeros((0, size))
        state = {"weights": begin, "mean": np.zeros((folds, size)), "square": np.zeros((folds, size)), "best": begin.copy(), "best_loss": np.full(folds, np.inf), "waited": np.zeros(folds, np.int64), "steps": np.zeros(folds, np.int64)}
        loaded = self._load(spark, names)
        epoch, state = loaded if loaded else (0, state)
        while epoch < self.epochs and (state["waited"] < self.patience).any():
            active = state["waited"] < self.patience
            for step in range(self.batches):
                n, _, slope = self._sums(table.where(F.col("step") == step), names, state["weights"], active, True)
                go = active & (n > 0)
                g = slope[go] / n[go, None]
                state["steps"][go] += 1
                t = state["steps"][go, None]
                state["mean"][go] = 0.9 * state["mean"][go] + 0.1 * g
                state["square"][go] = 0.999 * state["square"][go] + 0.001 * g * g
                state["weights"][go] -= self.rate * (state["mean"][go] / (1 - 0.9**t)) / (np.sqrt(state["square"][go] / (1 - 0.999**t)) + 1e-8)
            n, loss, _ = self._sums(table.where(F.col("step") == -1), names, state["weights"], active, False)
            mean = np.where(n > 0, loss / np.maximum(n, 1), np.inf)
            better = active & ((mean < state["best_loss"]) | ~np.isfinite(mean))
            state["best"][better], state["best_loss"][better] = state["weights"][better], mean[better]
            state["waited"] = np.where(better, 0, state["waited"] + active)
            epoch += 1
            self._save(spark, names, epoch, state)
        out = [(n, state["best"][k].tolist(), float(state["best_loss"][k]), epoch) for k, n in enumerate(names)]
        return spark.createDataFrame(out, "fold string, weights array<double>, loss double, epochs int")

    def predictions(self, rows: DataFrame, fitted: DataFrame, participant: str, features: str) -> DataFrame:
        """``rows`` with ``predicted_bpm`` by the model that was fitted without their participant; null where features can't be used."""
        model = self.model
        if isinstance(model, Network):
            return self._network_predictions(rows, fitted, participant, features)
        joined = rows.join(fitted.select(F.col("fold").alias("_fold"), F.col("weights").alias("_w")), F.col(participant).cast("string") == F.col("_fold"), "left")
        x, w = F.col(features).cast("array<double>"), F.col("_w")

        def dot(a: Column, b: Column) -> Column:
            return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)

        d, h = model.inputs, model.hidden
        if h:
            # Column j of the first layer stands at every h-th place from j on.
            unit = lambda j: dot(x, F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.get(w, i * h + j))) + F.get(w, j + d * h)
            out = F.aggregate(F.sequence(F.lit(0), F.lit(h - 1)), F.get(w, F.lit(model.size - 1)), lambda s, j: s + F.greatest(unit(j), F.lit(0.0)) * F.get(w, j + (d + 1) * h))
        else:
            out = dot(x, F.slice(w, 1, d)) + F.get(w, F.lit(d))
        return joined.withColumn("predicted_bpm", F.when((F.size(features) == d) & w.isNotNull(), out)).drop("_fold", "_w")

    def _network_predictions(self, rows: DataFrame, fitted: DataFrame, participant: str, features: str) -> DataFrame:
        # The models are what training holds on the driver already: folds times weights.
        model = self.model
        weights = rows.sparkSession.sparkContext.broadcast({r.fold: np.array(r.weights) for r in fitted.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                *kept, who, x = batch.columns
                out = np.full(batch.num_rows, np.nan)
                fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(x), model.inputs), False).to_numpy(zero_copy_only=False))
                names, values = np.array(who.to_pylist(), object)[fits], _matrix(x.take(pa.array(fits))) if len(fits) else None
                for name in set(names) & set(weights.value):
                    own = names == name
                    out[fits[own]] = model.predict(weights.value[name], values[own])
                yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.float64(), mask=np.isnan(out))], names=[*batch.schema.names[:-2], "predicted_bpm"])

        kept = rows.drop("predicted_bpm")
        schema = StructType([*kept.schema.fields, StructField("predicted_bpm", DoubleType())])
        return kept.select("*", F.col(participant).cast("string").alias("_who"), F.col(features).cast("array<double>").alias("_x")).mapInArrow(run, schema)
