"""Expressions on array<double> columns, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(col) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return col.cast("array<double>")


def bind(value, body) -> Column:
    """body(value) with the value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(arr) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def dot(a, b) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def euclidean(a, b) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def mean(arr) -> Column:
    return total(arr) / F.size(arr)


def sample_std(arr) -> Column:
    spread = bind(
        mean(arr), lambda center: F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + (v - center) * (v - center))
    )
    return F.sqrt(spread / (F.size(arr) - 1))


def _shifted_exp(logits, temperature: float) -> Column:
    """exp((z - max) / temperature), so exp cannot overflow."""
    return bind(F.array_max(logits), lambda peak: F.transform(logits, lambda z: F.exp((z - peak) / F.lit(float(temperature)))))


def softmax(logits, temperature: float = 1.0) -> Column:
    """Softmax of logits / temperature."""
    return bind(
        _shifted_exp(logits, temperature),
        lambda weights: bind(total(weights), lambda norm: F.transform(weights, lambda w: w / norm)),
    )


def log_softmax(logits) -> Column:
    norm = F.log(total(_shifted_exp(logits, 1.0))) + F.array_max(logits)
    return bind(norm, lambda n: F.transform(logits, lambda z: z - n))


def argmax(arr) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def one_hot(label, classes: int) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("double"))


def normalize_channels(arr, means: list[float], stds: list[float], width: int) -> Column:
    """(x - mean) / std with given constants, the array holding channels of ``width`` values."""
    mu = F.array(*[F.lit(float(m)) for m in means])
    sd = F.array(*[F.lit(float(s)) for s in stds])
    return F.transform(
        arr,
        lambda x, i: (x - F.get(mu, F.floor(i / width).cast("int"))) / F.get(sd, F.floor(i / width).cast("int")),
    )


def blend(a, b, weight) -> Column:
    """weight * a + (1 - weight) * b, element by element."""
    return F.zip_with(a, b, lambda x, y: weight * x + (1.0 - weight) * y)


def sharpen(a, b, temperature: float) -> Column:
    """Average two probability vectors, raise to 1/temperature, renormalise."""
    powered = F.zip_with(a, b, lambda x, y: F.pow((x + y) / 2.0, F.lit(1.0 / temperature)))
    return bind(powered, lambda ps: bind(total(ps), lambda norm: F.transform(ps, lambda p: p / norm)))
