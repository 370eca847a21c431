"""Matrices as rows (i, j, v), small dense ones in numpy, and an autoencoder for typing profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrymill.sources.tables import spread

TINY = 1e-10


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product of two coordinate tables (i, j, v): one equi-join on the inner index and a sum."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def transposed(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def from_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).alias("i"), F.posexplode(vector).alias("j", "v")).withColumn("v", F.col("v").cast("double"))


def axis_sums(df: DataFrame, vector: str) -> DataFrame:
    """pos, total, mean over all rows of an array column."""
    return df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.sum(F.col("x").cast("double")).alias("total"), F.avg(F.col("x").cast("double")).alias("mean"))


def inverse(m: np.ndarray) -> np.ndarray:
    """Inverse of a small matrix by elimination with pivoting; a pivot below 1e-10 raises."""
    a = np.hstack([np.asarray(m, float), np.eye(len(m))])
    n = len(m)
    for c in range(n):
        p = c + int(np.argmax(np.abs(a[c:, c])))
        if abs(a[p, c]) < TINY:
            raise ValueError("the matrix is singular")
        a[[c, p]] = a[[p, c]]
        a[c] /= a[c, c]
        others = np.arange(n) != c
        a[others] -= np.outer(a[others, c], a[c])
    return a[:, n:]


class Optimizer:
    """One step of a gradient method for one parameter array: sgd, momentum, adam, rmsprop or adagrad."""

    def __init__(self, kind: str = "adam", rate: float = 0.001, beta: float = 0.9, beta2: float = 0.999, eps: float = 1e-8):
        self.kind, self.rate, self.beta, self.beta2, self.eps = kind, rate, beta, beta2, eps
        self.m: np.ndarray | float = 0.0
        self.s: np.ndarray | float = 0.0
        self.t = 0

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        if self.kind == "sgd":
            return w - self.rate * g
        if self.kind == "momentum":
            self.m = self.beta * self.m + g
            return w - self.rate * self.m
        if self.kind == "adagrad":
            self.s = self.s + g * g
            return w - self.rate * g / (np.sqrt(self.s) + self.eps)
        if self.kind == "rmsprop":
            self.s = self.beta * self.s + (1 - self.beta) * g * g
            return w - self.rate * g / (np.sqrt(self.s) + self.eps)
        if self.kind != "adam":
            raise ValueError(self.kind)
        self.m = self.beta * self.m + (1 - self.beta) * g
        self.s = self.beta2 * self.s + (1 - self.beta2) * g * g
        return w - self.rate * (self.m / (1 - self.beta**self.t)) / (np.sqrt(self.s / (1 - self.beta2**self.t)) + self.eps)


class Autoencoder:
    """Dense layers down to a code and back, tanh inside, linear out, trained on the squared error of normalized rows."""

    def __init__(self, hidden: tuple[int, ...] = (64, 32), code: int = 12, epochs: int = 200, rate: float = 0.01, seed: int = 42):
        self.hidden, self.code, self.epochs, self.rate, self.seed = hidden, code, epochs, rate, seed

    def fit(self, x: np.ndarray) -> Autoencoder:
        return self.trained(x.mean(axis=0), x.std(axis=0), lambda: self.gradients(x, x.size))

    def trained(self, mean: np.ndarray, std: np.ndarray, gradients: Callable[[], list[np.ndarray]]) -> Autoencoder:
        """Trains on rows of this mean and deviation, of which ``gradients`` gives the summed gradients at the present weights."""
        rng = np.random.default_rng(self.seed)
        self.mean, self.std = mean, np.where(std < TINY, 1.0, std)
        sizes = [len(mean), *self.hidden, self.code, *reversed(self.hidden), len(mean)]
        self.w = [rng.normal(0, np.sqrt(1 / a), (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]
        steps = [(Optimizer(rate=self.rate), Optimizer(rate=self.rate)) for _ in self.w]
        for _ in range(self.epochs):
            g = gradients()
            for i, (w, b) in enumerate(steps):
                self.w[i], self.b[i] = w.step(self.w[i], g[2 * i]), b.step(self.b[i], g[2 * i + 1])
        return self

    def gradients(self, x: np.ndarray, size: int) -> list[np.ndarray]:
        """Gradients of weights and biases, layer by layer, summed over the rows of ``x``, which belong to rows of ``size`` values."""
        z = (x - self.mean) / self.std
        acts = self._forward(z)
        grad = 2 * (acts[-1] - z) / size
        out: list[np.ndarray] = []
        for i in range(len(self.w) - 1, -1, -1):
            out = [acts[i].T @ grad, grad.sum(axis=0), *out]
            if i:
                grad = (grad @ self.w[i].T) * (1 - acts[i] ** 2)
        return out

    def _forward(self, z: np.ndarray) -> list[np.ndarray]:
        acts = [z]
        for i, (w, b) in enumerate(zip(self.w, self.b)):
            a = acts[-1] @ w + b
            acts.append(a if i == len(self.w) - 1 else np.tanh(a))
        return acts

    def errors(self, x: np.ndarray) -> np.ndarray:
        """Mean squared reconstruction error of each row, in original units."""
        back = self._forward((x - self.mean) / self.std)[-1] * self.std + self.mean
        return ((x - back) ** 2).mean(axis=1)


def reconstruction_errors(model: Autoencoder, rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, error) of every row by a fitted model of fixed size."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(1).to_pylist(), float)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.errors(x))], names=["k", "error"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"k {kind}, error double").withColumnRenamed("k", key)


def fit_on_all(rows: DataFrame, vector: str, **settings) -> Autoencoder:
    """Fits on all rows: mean and deviation by one aggregation, then for each epoch the gradients summed per partition and by a tree.

    The driver holds the model and gradients of its size only; the result is that of ``Autoencoder.fit`` on all rows.
    """
    x = spread(rows.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("x"))).persist()
    try:
        at = x.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
        stats = at.orderBy("pos").collect()
        if not stats:
            raise ValueError("there are no rows to fit on")
        model, size = Autoencoder(**settings), sum(r["n"] for r in stats)

        def summed() -> list[np.ndarray]:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = None
                for b in batches:
                    if b.num_rows:
                        flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
                        g = np.concatenate([p.ravel() for p in model.gradients(flat.reshape(b.num_rows, -1), size)])
                        total = g if total is None else total + g
                if total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

            flat = x.mapInArrow(run, "g binary").rdd.map(lambda r: np.frombuffer(r[0])).treeReduce(np.add)
            shapes = [p.shape for pair in zip(model.w, model.b) for p in pair]
            ends = np.cumsum([np.prod(shape) for shape in shapes])[:-1]
            return [g.reshape(shape) for g, shape in zip(np.split(flat, ends), shapes)]

        return model.trained(np.array([r["mean"] for r in stats]), np.array([r["std"] for r in stats]), summed)
    finally:
        x.unpersist()


def numeric_gradient(f: Callable[[np.ndarray], float], x: np.ndarray, h: float = 1e-6) -> np.ndarray:
    g = np.zeros_like(x)
    for i in np.ndindex(x.shape):
        d = np.zeros_like(x)
        d[i] = h
        g[i] = (f(x + d) - f(x - d)) / (2 * h)
    return g
