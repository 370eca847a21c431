"""A dense network with one sigmoid output, trained on the binary cross entropy of all rows.

Each step sums the gradients of all partitions and moves the weights once by the optimizer, so one step
is one pass over the rows however many there are. The driver holds the network and gradients of its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill.operators.matrices import Optimizer
from sentrymill.sources.tables import spread

HIDDEN = {
    "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500))), lambda a: a * (1 - a)),
}


class Network:
    """``sizes`` from the input width to the last hidden layer; the output layer has one unit."""

    def __init__(self, sizes: Sequence[int], hidden: str = "relu", optimizer: str = "adam", rate: float = 0.001, epochs: int = 100, seed: int = 42):
        self.hidden, self.epochs = hidden, epochs
        rng = np.random.default_rng(seed)
        whole = [*sizes, 1]
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(whole, whole[1:])]
        self.b = [np.zeros(b) for b in whole[1:]]
        self.steps = [(Optimizer(optimizer, rate), Optimizer(optimizer, rate)) for _ in self.w]

    def _forward(self, x: np.ndarray) -> list[np.ndarray]:
        acts = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b)):
            acts.append(HIDDEN["sigmoid" if i == len(self.w) - 1 else self.hidden][0](acts[-1] @ w + b))
        return acts

    def gradients(self, x: np.ndarray, y: np.ndarray, rows: int) -> list[np.ndarray]:
        """Of weights and biases, layer by layer, summed over these of ``rows`` rows."""
        acts = self._forward(x)
        grad = (acts[-1] - y[:, None]) / rows
        out: list[np.ndarray] = []
        for i in range(len(self.w) - 1, -1, -1):
            out = [acts[i].T @ grad, grad.sum(axis=0), *out]
            if i:
                grad = (grad @ self.w[i].T) * HIDDEN[self.hidden][1](acts[i])
        return out

    def move(self, g: list[np.ndarray]) -> None:
        for i, (w, b) in enumerate(self.steps):
            self.w[i], self.b[i] = w.step(self.w[i], g[2 * i]), b.step(self.b[i], g[2 * i + 1])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        for _ in range(self.epochs):
            self.move(self.gradients(x, y, len(y)))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[-1][:, 0]


def _summed(rows: DataFrame, gradients: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], shapes: list[tuple]) -> list[np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                g = np.concatenate([p.ravel() for p in gradients(x, b.column(1).to_numpy(zero_copy_only=False))])
                total = g if total is None else total + g
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    flat = rows.mapInArrow(run, "g binary").rdd.map(lambda r: np.frombuffer(r[0])).treeReduce(np.add)
    ends = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    return [g.reshape(s) for g, s in zip(np.split(flat, ends), shapes)]


def fit_network(df: DataFrame, features: str, label: str, hidden_sizes: Sequence[int] = (16,), **settings) -> Network:
    """Rows without features or label are left out; nulls among the features are 0.0; labels above 0.5 are positive."""
    x = F.transform(F.col(features).cast("array<double>"), lambda v: F.coalesce(v, F.lit(0.0)))
    rows = spread(df.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(x.alias("x"), (F.col(label) > 0.5).cast("double").alias("y"))).persist()
    try:
        n = rows.count()
        if not n:
            raise ValueError("there are no rows to fit on")
        model = Network([len(rows.first()["x"]), *hidden_sizes], **settings)
        shapes = [p.shape for pair in zip(model.w, model.b) for p in pair]
        for _ in range(model.epochs):
            model.move(_summed(rows, lambda a, y: model.gradients(a, y, n), shapes))
        return model
    finally:
        rows.unpersist()


def probabilities(model: Network, rows: DataFrame, key: str, features: str) -> DataFrame:
    """(key, probability) of every row with features."""
    shared = rows.sparkSession.sparkContext.broadcast((model.w, model.b, model.hidden))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network([1])
        own.w, own.b, own.hidden = shared.value
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.probability(x))], names=["k", "probability"])

    kind = rows.schema[key].dataType.simpleString()
    x = F.transform(F.col(features).cast("array<double>"), lambda v: F.coalesce(v, F.lit(0.0)))
    return rows.where(F.col(features).isNotNull()).select(key, x.alias("x")).mapInArrow(run, f"k {kind}, probability double").withColumnRenamed("k", key)
