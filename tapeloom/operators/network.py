"""A small feed-forward regressor trained on rows that stay where they are.

Every step is one pass over the stored training rows: each task sums the gradient over its rows for all folds at once,
and the sums over tasks are a grouped aggregate, so the driver gets one number per fold and weight whatever the number
of rows or tasks. Partial gradients are summed as decimals, which do not depend on the order in which tasks end, so two
runs over the same files give the same weights. The weights (some thousand numbers) travel with the task.

Model: features standardised by the fold's training rows, hidden layers of rectified linear units, squared error with a
penalty on the weights, full-batch Adam. A fold's rows are those dated up to the end of its training; nothing else of
the rows decides. A fold without training rows predicts nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.session import stored


@dataclass(frozen=True)
class NetworkParams:
    hidden: tuple[int, ...] = (32, 16)
    steps: int = 60
    rate: float = 0.01
    penalty: float = 1e-3
    seed: int = 0


class Network:
    """Layers as one flat vector of weights: each layer's matrix, then its offsets."""

    def __init__(self, inputs: int, hidden: Sequence[int]):
        sizes = [inputs, *hidden, 1]
        self.shapes = list(zip(sizes[:-1], sizes[1:], strict=True))
        self.size = sum(a * b + b for a, b in self.shapes)

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in self.shapes:
            out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
            at += a * b + b
        return out

    def first(self, seed: int) -> np.ndarray:
        """Uniform start scaled by the layer's width; offsets begin at nothing."""
        rng, flat = np.random.default_rng(seed), np.zeros(self.size)
        for w, _ in self.layers(flat):
            w[:] = rng.uniform(-1, 1, w.shape) * np.sqrt(6.0 / sum(w.shape))
        return flat

    def predict(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self._forward(flat, x)[-1][:, 0]

    def _forward(self, flat: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        out, layers = [x], self.layers(flat)
        for i, (w, b) in enumerate(layers):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0.0) if i + 1 < len(layers) else z)
        return out

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradient of half the sum of squared errors over the rows."""
        out, grad = self._forward(flat, x), np.zeros_like(flat)
        back = out[-1] - y[:, None]
        for (w, _), (gw, gb), given in reversed(list(zip(self.layers(flat), self.layers(grad), out[:-1], strict=True))):
            gw[:], gb[:] = given.T @ back, back.sum(axis=0)
            back = (back @ w.T) * (given > 0)
        return grad

    def penalty(self, flat: np.ndarray) -> np.ndarray:
        """The weights without the offsets."""
        out = np.zeros_like(flat)
        for (w, _), (p, _) in zip(self.layers(flat), self.layers(out), strict=True):
            p[:] = w
        return out


@dataclass
class Adam:
    """First and second moments of the gradients of one fold."""

    rate: float
    m: np.ndarray
    v: np.ndarray
    step: int = 0

    def move(self, flat: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.step += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        return flat - self.rate * (self.m / (1 - 0.9 ** self.step)) / (np.sqrt(self.v / (1 - 0.999 ** self.step)) + 1e-8)


def _matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(n), np.float64) for n in names]) if batch.num_rows else np.zeros((0, len(names)))


def train(rows: DataFrame, folds: Sequence[tuple[int, object]], names: Sequence[str], p: NetworkParams = NetworkParams()) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Weights, means and deviations of every fold; ``folds``: (fold, last training date), ``rows``: date, ``names``, y."""
    net, names = Network(len(names), p.hidden), list(names)
    dated = rows.select("date", *[F.col(n).cast("double").alias(n) for n in names], F.col("y").cast("double").alias("y"))
    tags = F.array(*[F.when(F.col("date") <= F.lit(end), F.lit(fold)) for fold, end in folds])
    with stored(dated.withColumn("folds", F.filter(tags, lambda f: f.isNotNull())).filter(F.size("folds") > 0)) as kept:
        stats = kept.select(F.explode("folds").alias("fold"), *names).groupBy("fold").agg(
            F.count(F.lit(1)).alias("n"), *[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).collect()
        count = {r["fold"]: r["n"] for r in stats}
        mean = {r["fold"]: np.array([r[f"m_{n}"] for n in names]) for r in stats}
        scale = {r["fold"]: np.array([r[f"s_{n}"] or 1.0 for n in names]) for r in stats}
        weights = {f: net.first(p.seed + f) for f in count}
        movers = {f: Adam(p.rate, np.zeros(net.size), np.zeros(net.size)) for f in count}
        for _ in range(p.steps):
            summed = _summed(kept, net, names, weights, mean, scale)
            for f, grad in summed.items():
                weights[f] = movers[f].move(weights[f], grad / count[f] + p.penalty * net.penalty(weights[f]) / count[f])
    return {f: (weights[f], mean[f], scale[f]) for f in weights}


def _summed(kept: DataFrame, net: Network, names: list[str], weights: dict, mean: dict, scale: dict) -> dict[int, np.ndarray]:
    """Gradients over all rows, by fold."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {f: np.zeros(net.size) for f in weights}
        for batch in batches:
            x, y = _matrix(batch, names), np.asarray(batch.column("y"), np.float64)
            folds = batch.column("folds")
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(folds.value_lengths()))
            flat = np.asarray(folds.flatten())
            for f in weights:
                own = owner[flat == f]
                if len(own):
                    total[f] += net.gradient(weights[f], (x[own] - mean[f]) / scale[f], y[own])
        for f, grad in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(net.size, f, np.int32)), pa.array(np.arange(net.size, dtype=np.int32)), pa.array(grad)], names=["fold", "i", "g"])

    sums = kept.mapInArrow(partial, "fold int, i int, g double").groupBy("fold", "i").agg(F.sum(F.col("g").cast("decimal(38,15)")).cast("double").alias("g"))
    out = {f: np.zeros(net.size) for f in weights}
    for fold, i, g in sums.collect():
        out[fold][i] = g
    return out


def fit_predict_network(features: DataFrame, folds: DataFrame, names: Sequence[str], p: NetworkParams = NetworkParams()) -> DataFrame:
    """fold, date, symbol, y and pred of every test row; ``folds`` as from ``walk_forward_folds``, one small row each."""
    spec, names = folds.orderBy("fold").collect(), list(names)
    fitted = train(features, [(f["fold"], f["train_end"]) for f in spec], names, p)
    net, fields = Network(len(names), p.hidden), {c: features.schema[c] for c in ("date", "symbol")}
    tests = F.array(*[F.when(F.col("date").between(F.lit(f["test_start"]), F.lit(f["test_end"])), F.lit(f["fold"])) for f in spec if f["fold"] in fitted])
    rows = features.select("date", "symbol", *[F.col(n).cast("double").alias(n) for n in names], F.col("y").cast("double").alias("y"), F.explode(tests).alias("fold")).filter("fold IS NOT NULL")
    schema = T.StructType([T.StructField("fold", T.IntegerType()), *fields.values(), T.StructField("y", T.DoubleType()), T.StructField("pred", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold, pred = _matrix(batch, names), np.asarray(batch.column("fold")), np.zeros(batch.num_rows)
            for f in np.unique(fold).tolist():
                flat, mean, scale = fitted[f]
                pred[fold == f] = net.predict(flat, (x[fold == f] - mean) / scale)
            yield pa.RecordBatch.from_arrays([batch.column("fold"), batch.column("date"), batch.column("symbol"), batch.column("y"), pa.array(pred)], names=schema.names)

    return rows.mapInArrow(predict, schema)
