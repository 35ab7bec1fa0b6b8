"""Seeded augmentations of array columns; every draw is a hash of seed and row key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortwise.functions.seeded import integer, normal, uniform
from cohortwise.functions.vectors import bind, total

# Magnitude scale of the pool, and (name, largest value, bias) of its value-wise ops.
LEVELS = 10
POOL = [
    ("autocontrast", None, None),
    ("brightness", 0.9, 0.05),
    ("contrast", 0.9, 0.05),
    ("identity", None, None),
    ("posterize", 4, 4),
    ("solarize", 256, 0),
]
GRAY = 127.0


def flip(arr, seed, key) -> Column:
    """Reverse with probability one half."""
    return F.when(uniform(f"{seed}flip", key) < 0.5, F.reverse(arr)).otherwise(arr)


def pad_crop(arr, seed, key, border: int) -> Column:
    """Mirror ``border`` values beyond both ends, then cut the old width at a drawn start."""

    def cut(a):
        width = F.size(a)
        padded = F.concat(F.reverse(F.slice(a, 2, border)), a, F.reverse(F.slice(a, width - border, border)))
        return F.slice(padded, integer(f"{seed}crop", 0, 2 * border, key) + 1, width)

    return bind(arr, cut)


def weak(arr, seed, key, border: int = 4) -> Column:
    return pad_crop(flip(arr, seed, key), seed, key, border)


def cutout(arr, seed, key, share: float = 0.5, fill: float = GRAY) -> Column:
    """Overwrite a span of ``share`` of the width around a drawn centre, clipped to the ends."""

    def cut(a):
        width, span = F.size(a), F.floor(F.size(a) * share)
        first = F.floor(F.greatest(F.lit(0.0), uniform(f"{seed}cut", key) * width - span / 2.0))
        return bind(
            first,
            lambda start: F.transform(
                a, lambda x, i: F.when((i >= start) & (i <= F.least(width, start + span)), F.lit(fill)).otherwise(x)
            ),
        )

    return bind(arr, cut)


def _pixel(value) -> Column:
    """Whole number between 0 and 255."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), value))).cast("double")


def _pool_op(name: str, largest, bias, arr, level) -> Column:
    if name == "identity":
        return arr
    if name == "autocontrast":
        ends = F.struct(F.array_min(arr).alias("low"), F.array_max(arr).alias("high"))
        stretch = bind(ends, lambda e: F.transform(arr, lambda x: _pixel((x - e["low"]) * 255.0 / (e["high"] - e["low"]))))
        return F.when(F.array_max(arr) > F.array_min(arr), stretch).otherwise(arr)
    if name == "brightness":
        factor = level * largest / LEVELS + bias
        return F.transform(arr, lambda x: _pixel(x * factor))
    if name == "contrast":
        factor = level * largest / LEVELS + bias
        middle = F.floor(total(arr) / F.size(arr) + 0.5)
        return bind(middle, lambda m: F.transform(arr, lambda x: _pixel(m + (x - m) * factor)))
    if name == "posterize":
        step = F.pow(F.lit(2.0), 8.0 - (F.floor(level * largest / LEVELS) + bias))
        return F.transform(arr, lambda x: F.floor(x / step) * step)
    threshold = 256.0 - F.floor(level * largest / LEVELS)
    return F.transform(arr, lambda x: F.when(x < threshold, x).otherwise(255.0 - x))


def random_ops(arr, seed, key, n: int = 2, m: int = 10) -> Column:
    """n draws from the pool, each applied with probability one half at a drawn magnitude.

    ``arr`` holds whole numbers from 0 to 255.
    """
    for step in range(n):
        draw = F.struct(
            integer(f"{seed}level{step}", 1, m, key).cast("double").alias("level"),
            integer(f"{seed}op{step}", 0, len(POOL), key).alias("op"),
        )

        def drawn_op(a, d):
            result = a
            for i, (name, largest, bias) in enumerate(POOL):
                result = F.when(d["op"] == i, _pool_op(name, largest, bias, a, d["level"])).otherwise(result)
            return result

        used = uniform(f"{seed}use{step}", key) < 0.5
        arr = bind(arr, lambda a: F.when(used, bind(draw, lambda d: drawn_op(a, d))).otherwise(a))
    return arr


def strong(arr, seed, key, n: int = 2, m: int = 10, border: int = 4) -> Column:
    """Flip, pad and crop, drawn pool operations, then cutout of half the width."""
    return cutout(random_ops(weak(arr, seed, key, border), seed, key, n, m), seed, key)


def two_weak_views(arr, key, border: int = 4) -> tuple[Column, Column]:
    return weak(arr, "view1", key, border), weak(arr, "view2", key, border)


def weak_and_strong(arr, key, border: int = 4) -> tuple[Column, Column]:
    return weak(arr, "weak", key, border), strong(arr, "strong", key, border=border)


def gaussian_noise(arr, seed, key, scale: float = 0.15) -> Column:
    return F.transform(arr, lambda x, i: x + scale * normal(seed, key, i))
