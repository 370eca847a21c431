"""Vectors as arrays of doubles: distances, norms, activations, softmax, interpolation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def pairwise(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return total(pairwise(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(pairwise(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(pairwise(a, b, lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column) -> Column:
    """0 if either norm is below 1e-10."""
    n, m = norm(a), norm(b)
    return F.when((n < TINY) | (m < TINY), 0.0).otherwise(F.try_divide(dot(a, b), n * m))


def normalized(a: Column) -> Column:
    """Scaled to length 1; a vector shorter than 1e-10 stays."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n < TINY, 1.0).otherwise(n))


def between(a: Column, b: Column, share: Column) -> Column:
    return pairwise(a, b, lambda x, y: x + (y - x) * share)


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp((x - top).cast("double")))
    return F.transform(e, lambda x: x / total(e))


# Constants of the self-normalizing activation.
SELU_SCALE, SELU_ALPHA = 1.0507009873554805, 1.6732632423543772

ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "tanh": F.tanh,
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "leaky_relu": lambda x: F.when(x > 0, x).otherwise(x * 0.01),
    "elu": lambda x: F.when(x > 0, x).otherwise(F.exp(F.least(x, F.lit(0.0))) - 1),
    "selu": lambda x: SELU_SCALE * F.when(x > 0, x).otherwise(SELU_ALPHA * (F.exp(F.least(x, F.lit(0.0))) - 1)),
    "swish": lambda x: x / (1 + F.exp(-x)),
    "gelu": lambda x: 0.5 * x * (1 + F.tanh(F.lit(0.7978845608028654) * (x + 0.044715 * x * x * x))),
    "softplus": lambda x: F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0)),
    "mish": lambda x: x * F.tanh(F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))),
}
DERIVATIVES: dict[str, Callable[[Column], Column]] = {
    "sigmoid": lambda x: ACTIVATIONS["sigmoid"](x) * (1 - ACTIVATIONS["sigmoid"](x)),
    "tanh": lambda x: 1 - F.tanh(x) * F.tanh(x),
    "relu": lambda x: (x > 0).cast("double"),
    "leaky_relu": lambda x: F.when(x > 0, 1.0).otherwise(0.01),
    "elu": lambda x: F.when(x > 0, 1.0).otherwise(F.exp(F.least(x, F.lit(0.0)))),
}


def applied(vector: Column, f: Callable[[Column], Column]) -> Column:
    """Every value of a vector by a function of columns, in the JVM."""
    return F.transform(vector, f)
