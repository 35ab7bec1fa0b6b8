"""Joining tables and turning an activity log into wide behavioural features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.scalars import row_mean, row_total, safe_ratio, text_or_nan
from cohortwise.operators.clean import fill_like_zero, present_columns
from cohortwise.operators.ordering import ordered_index
from cohortwise.session import materialize

_MOST_KINDS = 10_000
_WINDOWED_CATEGORIES = 100_000  # above this a dictionary is ranked by range partitions


def left_join(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Keep every row of ``df``. The planner broadcasts ``other`` when its size allows it and
    splits skewed partitions otherwise."""
    return df.join(other, keys, "left")


def lookup(facts: DataFrame, dimension: DataFrame, key: str, attribute: str) -> DataFrame:
    """Add one attribute of a dimension; facts without a match or with a missing one go."""
    return facts.join(dimension.select(key, attribute).filter(F.col(attribute).isNotNull()), key)


def activity_days(log: DataFrame, keys: list[str], activity: str, day: str, amount: str) -> DataFrame:
    """One row per key, activity and day. A hot key shrinks to its days before the shuffle."""
    return log.groupBy(*keys, activity, day).agg(F.sum(amount).alias("_amount"))


def activity_totals(log: DataFrame, keys: list[str], activity: str, day: str, amount: str) -> DataFrame:
    """Total amount and number of distinct days per key and activity."""
    days = activity_days(log, keys, activity, day, amount)
    return days.groupBy(*keys, activity).agg(
        F.sum("_amount").alias("total_clicks"), F.count(day).alias("active_days")
    )


def activity_wide(
    log: DataFrame, keys: list[str], activity: str, day: str, amount: str, kinds: list[str] | None = None, rest: str | None = None
) -> DataFrame:
    """One row per key with total_clicks_<kind> and active_days_<kind>, zero where absent.

    Without ``kinds`` every kind of the data gets its columns. With them the schema is fixed, and rows of other kinds
    (or none) are counted under the name ``rest``; if that is not given, such a row fails the job, so
    none is lost unseen. Straight from the day table, so the pivot costs no shuffle of its own.
    """
    if kinds is None:
        found = log.select(activity).distinct().limit(_MOST_KINDS + 1).collect()
        if len(found) > _MOST_KINDS:
            raise ValueError(f"more than {_MOST_KINDS} kinds make no columns")
        kinds = sorted(r[0] for r in found if r[0] is not None)
        rest = rest or ("none" if any(r[0] is None for r in found) else None)
    listed = F.coalesce(F.col(activity).isin(*kinds), F.lit(False))
    unlisted = F.lit(rest) if rest else F.raise_error(F.concat(F.lit("no column for kind "), F.coalesce(activity, F.lit("NULL"))))
    days = activity_days(log, keys, activity, day, amount).withColumn("_kind", F.when(listed, F.col(activity)).otherwise(unlisted))
    named = [*kinds, *([rest] if rest and rest not in kinds else [])]
    totals = [
        F.coalesce(F.sum(F.when(F.col("_kind") == k, F.col("_amount"))), F.lit(0.0)).alias(f"total_clicks_{k}") for k in named
    ]
    counts = [F.count(F.when(F.col("_kind") == k, F.col(day))).alias(f"active_days_{k}") for k in kinds]
    if len(named) > len(kinds):  # several kinds may share a day
        counts.append(F.count_distinct(F.when(~listed, F.col(day))).alias(f"active_days_{rest}"))
    return days.groupBy(*keys).agg(*totals, *counts)


def join_features(entities: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """Entities with their behaviour columns; entities without any activity get zeros."""
    return fill_like_zero(left_join(entities, wide, keys), "total_clicks_", "active_days_")


def engagement(df: DataFrame, kinds: list[str], early_kinds: list[str]) -> DataFrame:
    """Overall totals, their ratio, and the mean over the columns of the early kinds."""
    clicks = [f"total_clicks_{k}" for k in kinds]
    active = [f"active_days_{k}" for k in kinds]
    early = [f"{m}_{k}" for k in early_kinds for m in ("active_days", "total_clicks")]
    return (
        df.withColumns({"overall_total_clicks": row_total(clicks), "overall_active_days": row_total(active)})
        .withColumn("avg_daily_clicks", safe_ratio("overall_total_clicks", "overall_active_days"))
        .withColumn("early_engagement", row_mean(early))
    )


def label_mapping(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, code): categories in code-point order, a missing one is ``nan``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), text_or_nan(c).alias("value")) for c in cols]))
    distinct = materialize(df.select(pairs.alias("p")).select("p.*").distinct(), "categories")
    sizes = {r["column_name"]: r["n"] for r in distinct.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_column = Window.partitionBy("column_name").orderBy("value")
    if max(sizes.values(), default=0) <= _WINDOWED_CATEGORIES:
        return distinct.withColumn("code", (F.row_number().over(by_column) - 1).cast("bigint"))
    placed = ordered_index(distinct, ["column_name", "value"], "_at")
    first = F.lit(0)
    before = 0
    for c in sorted(sizes):
        first = F.when(F.col("column_name") == c, F.lit(before)).otherwise(first)
        before += sizes[c]
    return placed.select("column_name", "value", (F.col("_at") - first).cast("bigint").alias("code"))


def label_encode(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Replace each category by its code. Returns the encoded rows and the mapping table.

    The mapping is written down first: it is broadcast when small, shuffled when not.
    """
    cols = present_columns(df, cols)
    mapping = materialize(label_mapping(df, cols), "mapping")
    for c in cols:
        codes = mapping.filter(F.col("column_name") == c).select(
            F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_code_{c}")
        )
        df = (
            df.join(codes, text_or_nan(c) == F.col(f"_v_{c}"), "left")
            .withColumn(c, F.col(f"_code_{c}"))
            .drop(f"_v_{c}", f"_code_{c}")
        )
    return df, mapping
