"""Seeded randomness from hashes: the same row gets the same draw on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed, *cols) -> Column:
    """Hex digest of seed and key; sorting by it is a seeded shuffle."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def uniform(seed, *cols) -> Column:
    """Draw in [0, 1) with 32 random bits."""
    digits = F.substring(hash_key(seed, *cols), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def integer(seed, low: int, high: int, *cols) -> Column:
    """Integer draw in [low, high)."""
    return F.floor(uniform(seed, *cols) * (high - low)).cast("int") + F.lit(low)


def normal(seed, *cols) -> Column:
    """Standard normal draw (Box-Muller on two uniform draws)."""
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(f"{seed}r", *cols)))
    return radius * F.cos(2.0 * F.pi() * uniform(f"{seed}a", *cols))
