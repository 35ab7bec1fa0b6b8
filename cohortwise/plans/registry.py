"""The query registry and small SQL fragments shared by the oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` computes the same result on the same tables."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return register


def sql_hash(seed, *cols: str) -> str:
    return "md5('" + str(seed) + "'" + "".join(f" || '|' || CAST({c} AS VARCHAR)" for c in cols) + ")"


def sql_uniform(seed, *cols: str) -> str:
    return f"(CAST('0x' || substr({sql_hash(seed, *cols)}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def sql_integer(seed, low: int, high: int, *cols: str) -> str:
    return f"(CAST(floor({sql_uniform(seed, *cols)} * {high - low}) AS BIGINT) + {low})"


def r6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0::DOUBLE)"
