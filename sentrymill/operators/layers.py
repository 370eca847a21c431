"""Layers over rows: batch normalization, dropout and residual sums; optimizer steps and choice among arms per key.

Vectors are arrays of doubles. Batches are named by a column. Running statistics are folds over batches,
of which there is one small row each.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrymill.operators.fold import folded
from sentrymill.operators.matrices import Optimizer

EPS, MOMENTUM = 1e-5, 0.9
OPTIMIZERS = ("sgd", "momentum", "adam", "rmsprop", "adagrad")


def batch_statistics(df: DataFrame, batch: str, columns: Sequence[str]) -> DataFrame:
    """batch, column, mean, variance (population) of each batch."""
    entry = lambda c: F.struct(F.lit(c).alias("column"), F.avg(F.col(c).cast("double")).alias("mean"), F.var_pop(F.col(c).cast("double")).alias("variance"))
    return df.groupBy(batch).agg(F.array(*[entry(c) for c in columns]).alias("cs")).select(batch, F.inline("cs"))


def running_statistics(stats: DataFrame, batch: str, momentum: float = MOMENTUM) -> DataFrame:
    """After each batch in order: running mean, from 0, and variance, from 1, that keep ``momentum`` of what they were."""

    def step(state, row):
        m, v = state or (0.0, 1.0)
        if row["mean"] is not None:
            m, v = momentum * m + (1 - momentum) * row["mean"], momentum * v + (1 - momentum) * row["variance"]
        return (m, v), [(row["column"], row["b"], m, v)]

    kind = stats.schema[batch].dataType.simpleString()
    rows = stats.select("column", F.col(batch).alias("b"), "mean", "variance")
    return folded(rows, ["column"], ["b"], step, f"column string, b {kind}, running_mean double, running_variance double").withColumnRenamed("b", batch)


def batch_normalized(df: DataFrame, batch: str, columns: Sequence[str], gamma: float = 1.0, beta: float = 0.0) -> DataFrame:
    """Columns scaled by the mean and variance of their own batch; nulls stay null. Sums are taken per task before rows move."""
    fit = df.groupBy(F.col(batch).alias("__b")).agg(
        *[F.avg(F.col(c).cast("double")).alias(f"__m_{c}") for c in columns], *[F.var_pop(F.col(c).cast("double")).alias(f"__v_{c}") for c in columns]
    )
    joined = df.join(fit, F.col(batch).eqNullSafe(F.col("__b")))
    scaled = {c: gamma * (F.col(c) - F.col(f"__m_{c}")) / F.sqrt(F.col(f"__v_{c}") + EPS) + beta for c in columns}
    return joined.withColumns(scaled).select(*df.columns)


def dropped_out(vector: Column, key: Column, rate: float, seed: int = 42) -> Column:
    """A vector with about ``rate`` of its values set to 0, by a hash of key and place, and the rest scaled up by as much."""
    kept = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32) >= rate
    return F.transform(vector, lambda x, i: F.when(kept(i), x / (1 - rate)).otherwise(0.0))


def residual(vector: Column, branch: Column) -> Column:
    """The vector plus what a branch made of it; null if their lengths differ."""
    return F.when(F.size(vector) == F.size(branch), F.zip_with(vector, branch, lambda a, b: a + b))


def optimized(rows: DataFrame, key: str, order: str, target: str, rate: float = 0.1) -> DataFrame:
    """(key, optimizer, steps, w): per key a weight from 0 that follows the targets in order by the gradient w - target, for each optimizer."""
    picked = rows.where(F.col(target).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(target).cast("double").alias("t"))

    def step(state, row):
        if state is None:
            state = {name: (Optimizer(name, rate), np.zeros(1)) for name in OPTIMIZERS}
        return {name: (o, o.step(w, w - row["t"])) for name, (o, w) in state.items()}, []

    def finish(state, key_):
        return [(key_[0], name, o.t, float(w[0])) for name, (o, w) in state.items()]

    kind = picked.dtypes[0][1]
    return folded(picked, ["k"], ["o"], step, f"k {kind}, optimizer string, steps int, w double", finish).withColumnRenamed("k", key)


def arms_chosen(rows: DataFrame, key: str, order: str, context: str, rewards: str, alpha: float = 1.0) -> DataFrame:
    """(key, order, arm, reward) per row in order: the arm with the largest upper confidence bound of a linear reward model.

    ``context`` is a vector and ``rewards`` what each arm would give; only the chosen arm's is learned from. An arm
    starts with the unit matrix; of equal bounds the first arm is taken.
    """
    picked = rows.where(F.col(context).isNotNull() & F.col(rewards).isNotNull()).select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(context).alias("c"), F.col(rewards).alias("r"))

    def step(state, row):
        x, given = np.array(row["c"], float), row["r"]
        if state is None:
            state = [(np.eye(len(x)), np.zeros(len(x))) for _ in given]
        bounds = []
        for inverse, b in state:
            spread = inverse @ x
            bounds.append(float(b @ spread + alpha * np.sqrt(max(0.0, x @ spread))))
        arm = int(np.argmax(np.round(bounds, 12)))
        inverse, b = state[arm]
        spread = inverse @ x
        state[arm] = (inverse - np.outer(spread, spread) / (1 + x @ spread), b + given[arm] * x)
        return state, [(row["k"], row["o"], arm, given[arm])]

    kinds = dict(picked.dtypes)
    return folded(picked, ["k"], ["o"], step, f"k {kinds['k']}, o {kinds['o']}, arm int, reward double").withColumnsRenamed({"k": key, "o": order})

