"""Group statistics, matrices, and joins of two measured sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.scalars import clip
from cohortwise.functions.vectors import as_double, mean, sample_std


def group_means(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    return df.groupBy(group).agg(*[F.avg(c).alias(c) for c in cols])


def group_positive_rate(df: DataFrame, group: str, label: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(label).alias("positive_rate"))


def group_mode(df: DataFrame, group: str, label: str, name: str) -> DataFrame:
    """Most frequent label per group, the smallest one on ties. Counting first keeps a hot
    group down to its distinct labels."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(group).agg(F.max_by(label, F.struct(F.col("_n"), -F.col(label))).alias(name))


def between_group_spread(means: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """Population standard deviation of the group means, per feature."""
    long = means.unpivot([group], cols, "feature", "value")
    return long.groupBy("feature").agg(F.stddev_pop("value").alias("importance"))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def channel_stats(df: DataFrame, vec: str, channels: int, width: int) -> DataFrame:
    """Mean over items of each channel's mean and sample standard deviation."""
    arr = as_double(vec)
    parts = [F.slice(arr, c * width + 1, width) for c in range(channels)]
    aggs = []
    for c, part in enumerate(parts):
        aggs += [F.avg(mean(part)).alias(f"m{c}"), F.avg(sample_std(part)).alias(f"s{c}")]
    rows = [
        F.struct(F.lit(c).cast("bigint").alias("channel"), F.col(f"m{c}").alias("mean"), F.col(f"s{c}").alias("std"))
        for c in range(channels)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def class_histogram(df: DataFrame, prediction: str, classes: int) -> DataFrame:
    """Rows per predicted class, with a zero row for a class never predicted."""
    counted = df.groupBy(prediction).agg(F.count(F.lit(1)).alias("_n"))
    listed = df.sparkSession.range(classes).select(F.col("id").cast("int").alias(prediction))
    return listed.join(counted, prediction, "left").select(prediction, F.coalesce("_n", F.lit(0)).alias("n"))


def masked_mean(value: Column, mask: Column) -> list[Column]:
    """Mean of value times mask over all rows, and the share of unmasked rows."""
    weight = mask.cast("double")
    return [F.avg(value * weight).alias("masked_loss"), F.avg(weight).alias("mask_rate")]


def overlap_blend(
    a: DataFrame, b: DataFrame, keys: list[str], value: str, weight: str, eps: float = 1e-5
) -> DataFrame:
    """Weighted mean where both sources have the key, the only value elsewhere."""
    left = a.select(*keys, F.col(value).alias("_v1"), F.col(weight).alias("_w1"))
    right = b.select(*keys, F.col(value).alias("_v2"), F.col(weight).alias("_w2"))
    both = F.col("_v1").isNotNull() & F.col("_v2").isNotNull()
    norm = F.col("_w1") + F.col("_w2") + F.lit(eps)
    mixed = F.col("_v1") * F.col("_w1") / norm + F.col("_v2") * F.col("_w2") / norm
    return left.join(right, keys, "full_outer").select(
        *keys, both.alias("overlap"), F.when(both, mixed).otherwise(F.coalesce("_v1", "_v2")).alias(value)
    )


def gain_factor(a: DataFrame, b: DataFrame, keys: list[str], value: str, eps: float = 1e-5) -> DataFrame:
    """One row: mean of source a over mean of source b on their common keys."""
    common = a.select(*keys, F.col(value).alias("_v1")).join(b.select(*keys, F.col(value).alias("_v2")), keys)
    return common.agg(((F.avg("_v1") + F.lit(eps)) / (F.avg("_v2") + F.lit(eps))).alias("gain"))


def gain_calibrate(
    a: DataFrame, b: DataFrame, keys: list[str], value: str, low: float = 0.0, high: float = 255.0
) -> DataFrame:
    """Source b scaled to the level of source a, clipped to [low, high]."""
    gain = gain_factor(a, b, keys, value).scalar()
    return b.withColumn(value, clip(F.col(value) * gain, low, high))
