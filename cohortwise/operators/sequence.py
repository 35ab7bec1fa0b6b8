"""Running statistics along keyed series of evaluations.

A series may be as long as the table: rows get their place in it from range partitions, and the windows run over
blocks of a fixed number of places. What came before a block is one row per block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.operators.ordering import ordered_index
from cohortwise.session import materialize

BLOCK = 100_000


def series_places(df: DataFrame, series: str, order_cols: list[str], name: str) -> DataFrame:
    """Add the zero-based place of each row in its series; no series is sorted in one task. A missing series is one of its own."""
    placed = ordered_index(df, [series, *order_cols], "_global")
    first = materialize(placed.groupBy(F.col(series).alias("_series")).agg(F.min("_global").alias("_first")), "series")
    joined = placed.join(first, F.col(series).eqNullSafe(F.col("_series")))
    return joined.withColumn(name, F.col("_global") - F.col("_first")).drop("_global", "_series", "_first")


def _blocks(df: DataFrame, series: str, order_cols: list[str], block: int) -> DataFrame:
    return series_places(df, series, order_cols, "_at").withColumn("_block", F.floor(F.col("_at") / block))


def _within(series: str):
    return Window.partitionBy(series, "_block").orderBy("_at")


def _carried(rows: DataFrame, series: str, **folds: Column) -> DataFrame:
    """``rows`` with the given aggregates of their series before their block, null in the first block."""
    totals = rows.groupBy(F.col(series).alias("_series"), F.col("_block").alias("_of")).agg(
        *[fold.alias(f"_{n}") for n, fold in folds.items()]
    )
    before = Window.partitionBy("_series").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    over = {n: (F.max if n.startswith("max") else F.sum)(f"_{n}").over(before).alias(n) for n in folds}
    carry = materialize(totals.select("_series", "_of", *over.values()), "carry")
    same = F.col(series).eqNullSafe(F.col("_series")) & (F.col("_block") == F.col("_of"))
    return rows.join(carry, same, "left").drop("_series", "_of")


def _steps(step: str | list[str]) -> list[str]:
    return [step] if isinstance(step, str) else list(step)


def weighted_running_mean(df: DataFrame, series: str, step: str | list[str], value: str, weight: str, block: int = BLOCK) -> DataFrame:
    """Meter after each update: last value, running sum, running count, running mean."""
    steps = _steps(step)
    own = df.select(series, *steps, F.col(value).alias("val"), (F.col(value) * F.col(weight)).alias("_amount"), F.col(weight).alias("_w"))
    rows = _carried(_blocks(own, series, steps, block), series, part=F.sum("_amount"), weight=F.sum("_w"))
    past = _within(series).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        series, *steps, "val",
        (F.coalesce("part", F.lit(0)) + F.sum("_amount").over(past)).alias("running_sum"),
        (F.coalesce("weight", F.lit(0)) + F.sum("_w").over(past)).alias("running_count"),
    ).withColumn("running_avg", F.col("running_sum") / F.col("running_count"))


def running_best(df: DataFrame, series: str, step: str | list[str], value: str, start: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Best value so far, and whether this step is strictly better than all before it."""
    steps = _steps(step)
    rows = _carried(_blocks(df.select(series, *steps, value), series, steps, block), series, max_before=F.max(value))
    before = _within(series).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.greatest(F.lit(start), F.col("max_before"), F.max(value).over(before))
    return rows.select(series, *steps, value, earlier.alias("_earlier")).select(
        series, *steps, value, F.greatest("_earlier", value).alias("best"), (F.col(value) > F.col("_earlier")).alias("is_best")
    )


def trailing_mean(df: DataFrame, series: str, step: str | list[str], value: str, rows: int = 20, block: int = BLOCK) -> DataFrame:
    """Mean of the last ``rows`` steps. A block's last places are copied to the next block, whose first means need them."""
    steps = _steps(step)
    block = max(block, rows)
    placed = _blocks(df.select(series, *steps, value), series, steps, block)
    also = F.array(F.col("_block"), F.when(F.col("_at") % block > block - rows, F.col("_block") + 1))
    spread = placed.withColumn("_home", F.col("_block")).withColumn("_block", F.explode(F.array_compact(also)))
    recent = _within(series).rowsBetween(-(rows - 1), 0)
    mean = spread.withColumn("trailing_mean", F.avg(value).over(recent))
    return mean.filter(F.col("_home") == F.col("_block")).select(series, *steps, value, "trailing_mean")


def ema_smooth(df: DataFrame, series: str, step: str | list[str], value: str, decay: float) -> DataFrame:
    """e_0 = v_0, e_t = decay * e_(t-1) + (1 - decay) * v_t along each series.

    Within a block the recurrence is a running sum of values scaled by decay^-position. A block
    is as long as that scale stays inside a double (decay^length = e^-500), so of all that came
    before a block only the last value of the previous one still counts.
    """
    if not 0.0 < decay < 1.0:
        raise ValueError("decay must lie between 0 and 1")
    steps, block = _steps(step), max(1, int(500.0 / -math.log(decay)))
    power = F.pow(F.lit(decay), F.col("_pos").cast("double"))
    within = _within(series).rowsBetween(Window.unboundedPreceding, 0)
    own = (
        _blocks(df.select(series, *steps, value), series, steps, block)
        .withColumn("_in", F.when(F.col("_at") == 0, F.col(value)).otherwise(F.col(value) * (1.0 - decay)))
        .withColumn("_pos", F.col("_at") % block)
        .withColumn("_own", F.sum(F.col("_in") / power).over(within) * power)
    )
    # Where this block began, the smoothed value stood at the end of the previous block.
    ends = own.filter(F.col("_pos") == block - 1).select(
        F.col(series).alias("_series"), (F.col("_block") + 1).alias("_of"), F.col("_own").alias("_carry")
    )
    carried = F.coalesce("_carry", F.lit(0.0)) * power * F.lit(decay)
    same = F.col(series).eqNullSafe(F.col("_series")) & (F.col("_block") == F.col("_of"))
    return own.join(ends, same, "left").select(series, *steps, value, (F.col("_own") + carried).alias("ema"))


def best_record(df: DataFrame, series: str, step: str, score: str) -> DataFrame:
    """Per series the full record with the best score, the earliest step on ties."""
    others = [c for c in df.columns if c != series]
    best = df.groupBy(series).agg(
        F.max_by(F.struct(*others), F.struct(F.col(score), -F.col(step))).alias("_best")
    )
    return best.select(series, "_best.*")


def log_lines(df: DataFrame, series: str, step: str, values: list[str]) -> DataFrame:
    """Tab-separated log: a title line per series, then one line per step with six decimals."""
    body = F.concat_ws("\t", *[F.format_string("%.6f", F.col(v).cast("double")) for v in values])
    lines = df.select(series, F.col(step).cast("bigint").alias("line_no"), body.alias("line"))
    title = df.select(series).distinct().select(
        series, F.lit(0).cast("bigint").alias("line_no"), F.lit("\t".join(values)).alias("line")
    )
    return title.unionByName(lines)


def append_log(df: DataFrame, path: str, values: list[str], resume: bool = False) -> None:
    """Write or, when resuming, extend a tab-separated log folder with a header per file."""
    text = df.select(*[F.format_string("%.6f", F.col(v).cast("double")).alias(v) for v in values])
    text.write.mode("append" if resume else "overwrite").option("sep", "\t").option("header", True).csv(path)
