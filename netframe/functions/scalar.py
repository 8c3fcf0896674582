"""Scalar and array functions: vectors, activations and losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a: Column, b: Column, other: float = 0.0) -> Column:
    """a / b, and `other` where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(other))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def sum_array(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return sum_array(F.zip_with(a, b, lambda x, y: x * y))


def sqdist(a: Column, b: Column) -> Column:
    return sum_array(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column, floor: float = 1e-10) -> Column:
    """Row scaled to length 1; norms below the floor count as the floor."""
    return let(F.greatest(norm(a), F.lit(floor)), lambda n: F.transform(a, lambda x: x / n))


def shares(a: Column) -> Column:
    """Array divided by its sum."""
    return let(a, lambda whole: let(sum_array(whole), lambda s: F.transform(whole, lambda x: x / s)))


def relu(x) -> Column:
    return F.greatest(col(x), F.lit(0.0))


def leaky_relu(x, slope: float = 0.01) -> Column:
    return F.when(col(x) >= 0, col(x)).otherwise(col(x) * slope)


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def tanh(x) -> Column:
    return F.tanh(col(x))


def softmax(a) -> Column:
    """Of an array, shifted by its maximum."""
    return let(F.array_max(col(a)), lambda top: shares(F.transform(col(a), lambda x: F.exp(x - top))))


def log_softmax(a) -> Column:
    """Of an array: x less the logarithm of the sum of exponentials."""
    spread = lambda top: top + F.log(sum_array(F.transform(col(a), lambda x: F.exp(x - top))))
    return let(let(F.array_max(col(a)), spread), lambda z: F.transform(col(a), lambda x: x - z))


def cross_entropy_loss(logits, labels, one_hot: bool = False) -> Column:
    """Aggregate: mean of -log softmax at the label (an index from 0, or an array of weights)."""
    logp = log_softmax(logits)
    return F.avg(-dot(col(labels), logp) if one_hot else -F.get(logp, col(labels).cast("int")))


def binary_cross_entropy_with_logits(x, z) -> Column:
    """Aggregate: mean of softplus(-x) + x - x * z."""
    x, z = col(x), col(z)
    return F.avg(F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))) + x - x * z)


def mean_squared_error(p, t) -> Column:
    return F.avg((col(p) - col(t)) * (col(p) - col(t)))


def mean_absolute_error(p, t) -> Column:
    return F.avg(F.abs(col(p) - col(t)))


def adaptive_temperature(iteration, initial: float = 2.0, final: float = 0.1, decay: float = 0.95) -> Column:
    return F.greatest(F.lit(initial) * F.pow(F.lit(decay), col(iteration)), F.lit(final))
