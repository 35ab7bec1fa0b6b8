"""Cleaning: column selection, missing values, outlier capping, labels and class balance."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortwise.operators.ordering import exact_quantiles

LOG = logging.getLogger(__name__)


def require_columns(df: DataFrame, needed: list[str]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def present_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns that exist; the others are logged and skipped."""
    for c in wanted:
        if c not in df.columns:
            LOG.warning("column %s does not exist, skipped", c)
    return [c for c in wanted if c in df.columns]


def columns_like(df: DataFrame, *parts: str) -> list[str]:
    """Columns whose name contains one of the given parts."""
    return [c for c in df.columns if any(p in c for p in parts)]


def drop_leakage(df: DataFrame, target: str, *leaks: str) -> DataFrame:
    """Features only: the target must exist and goes, leaking columns go if they exist."""
    require_columns(df, [target])
    return df.drop(target, *leaks)


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop the columns that are missing in every row, found by one counting aggregate."""
    present = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
    return df.drop(*[c for c, n in present.items() if n == 0])


def drop_missing(df: DataFrame, categorical: list[str]) -> DataFrame:
    return df.dropna(subset=present_columns(df, categorical))


def fill_zero(df: DataFrame, numeric: list[str]) -> DataFrame:
    return df.fillna(0, subset=present_columns(df, numeric))


def fill_like_zero(df: DataFrame, *parts: str) -> DataFrame:
    """Zero for missing values in all columns whose name contains one of the parts."""
    return df.fillna(0, subset=columns_like(df, *parts))


def missing_indicator(df: DataFrame, col: str) -> DataFrame:
    """Keep the fact that a value was missing before it is filled."""
    return df.withColumn(f"{col}_missing", F.col(col).isNull().cast("int"))


def drop_non_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[f.name for f in df.schema if isinstance(f.dataType, T.NumericType)])


def above_share_of_max(df: DataFrame, col: str, share: float) -> DataFrame:
    """Rows whose value exceeds ``share`` times the largest value of the whole table."""
    peak = df.agg(F.max(col)).scalar()
    return df.filter(F.col(col) > F.lit(share) * peak)


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows, positives and positive share of a 0/1 label."""
    return df.agg(
        F.count(label).alias("n"), F.sum(label).cast("bigint").alias("positives"), F.avg(label).alias("positive_rate")
    )


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def cap_upper(df: DataFrame, cols: list[str], prob: float = 0.98) -> DataFrame:
    """Cap each column at its own exact upper quantile; missing values stay missing."""
    limits = exact_quantiles(df, cols, [prob])
    return df.withColumns(
        {c: F.when(F.col(c) > q[0], F.lit(q[0])).otherwise(F.col(c).cast("double")) for c, q in limits.items()
         if q[0] is not None}
    )


def boxplot_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 IQR, and outlier count per column."""
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for c, (q1, _, q3) in quartiles.items():
        reach = 1.5 * (q3 - q1)
        inside = F.col(c).between(q1 - reach, q3 + reach)
        aggs += [
            F.min(F.when(inside, F.col(c).cast("double"))).alias(f"lo_{c}"),
            F.max(F.when(inside, F.col(c).cast("double"))).alias(f"hi_{c}"),
            F.count_if(~inside).alias(f"out_{c}"),
        ]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(q1).alias("q1"), F.lit(q2).alias("median"), F.lit(q3).alias("q3"),
            F.col(f"lo_{c}").alias("whisker_low"), F.col(f"hi_{c}").alias("whisker_high"),
            F.col(f"out_{c}").alias("n_outliers"),
        )
        for c, (q1, q2, q3) in quartiles.items()
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))
