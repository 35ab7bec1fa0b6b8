"""Global order at scale: positions, running sums, order thresholds and exact quantiles.

None of these sorts a whole table, a whole class or a hot key in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.seeded import hash_key
from cohortwise.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition number above this bit


def _range_sorted(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """Range-partitioned and sorted rows with their partition and place in it, written down
    so that every later reader sees the same partitions."""
    slotted = (
        df.repartitionByRange(*order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    return (
        materialize(slotted, "ordered")
        .withColumn("_part", F.shiftright("_slot", _LOCAL_BITS))
        .withColumn("_local", F.col("_slot").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("_slot")
    )


def ordered_index(df: DataFrame, order_cols: list[str], name: str) -> DataFrame:
    """Add the zero-based position of each row in the total order of ``order_cols``."""
    placed = _range_sorted(df, order_cols)
    # One row per shuffle partition, so the unpartitioned window and the broadcast are bounded.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .drop("_part", "_local", "_offset")
    )


def ordered_running_sums(df: DataFrame, order_cols: list[str], sums: dict[str, str]) -> DataFrame:
    """Add inclusive running sums over the total order; ``sums`` maps value column to new name.

    ``order_cols`` must be unique per row, then the range partitions are even.
    """
    placed = _range_sorted(df, order_cols)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{n}") for c, n in sums.items()])
    offsets = totals.select(
        "_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums.values()]
    )
    running = placed.select("*", *[F.sum(c).over(within).alias(f"_r_{n}") for c, n in sums.items()])
    joined = running.join(F.broadcast(offsets), "_part")
    return joined.select(
        *[F.col(c) for c in df.columns], *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums.values()]
    )


def first_in_class(df: DataFrame, class_col: str, order_cols: list[str], k: int, name: str) -> DataFrame:
    """Per class the struct of ``order_cols`` of its k-th row in their order, or of the last row of a shorter class.

    The rows are placed by range partitions over (class, order columns), so no class is sorted in one task,
    whatever k is. Rows without a class take no part.
    """
    slim = df.filter(F.col(class_col).isNotNull()).select(class_col, *order_cols)
    placed = ordered_index(slim, [class_col, *order_cols], "_at")
    ends = placed.groupBy(class_col).agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    wanted = F.least(F.col("_low") + F.lit(k - 1), "_high")
    ends = materialize(ends.select(class_col, wanted.alias("_wanted")), "ends")
    found = placed.join(ends, class_col).filter(F.col("_at") == F.col("_wanted"))
    return found.select(class_col, F.struct(*order_cols).alias(name))


def rank_bounds(df: DataFrame, class_col: str, key: str, ranks: list, name: str) -> DataFrame:
    """Per class the hash keys at several one-based ranks, as an array in the order of ``ranks``.

    A rank is a function of the class size, a column. A histogram on the key's first digits finds the digit
    group of each rank; only those groups, 1/65536 of the rows each, are ranked. No class is ever sorted as a
    whole. Rows without a class take no part.
    """
    keyed = df.filter(F.col(class_col).isNotNull()).select(class_col, key).withColumn("_digits", F.substring(key, 1, 4))
    bins = keyed.groupBy(class_col, "_digits").agg(F.count(F.lit(1)).alias("_n"))
    by_class = Window.partitionBy(class_col)
    upto = by_class.orderBy("_digits").rowsBetween(Window.unboundedPreceding, 0)
    size = F.sum("_n").over(by_class)
    located = (
        bins.select(class_col, "_digits", "_n", F.sum("_n").over(upto).alias("_upto"),
                    F.array(*[r(size).cast("bigint") for r in ranks]).alias("_ranks"))
        .select("*", F.posexplode("_ranks").alias("_which", "_rank"))
        .filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
        .select(class_col, "_digits", "_which", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
    )
    near = keyed.join(materialize(located, "digits"), [class_col, "_digits"])
    place = Window.partitionBy(class_col, "_digits", "_which").orderBy(key)
    at = near.withColumn("_rn", F.row_number().over(place)).filter(F.col("_rn") == F.col("_rank"))
    pairs = F.array_sort(F.collect_list(F.struct("_which", F.col(key).alias("_key"))))  # one per rank
    return at.groupBy(class_col).agg(F.transform(pairs, lambda x: x["_key"]).alias(name))


def seeded_positions(df: DataFrame, key: str, seed, name: str) -> DataFrame:
    """Add the one-based position of each row in a seeded shuffle of the whole table."""
    keyed = df.withColumn("_hash", hash_key(seed, key))
    return ordered_index(keyed, ["_hash", key], name).withColumn(name, F.col(name) + 1).drop("_hash")


def exact_quantiles(
    df: DataFrame, cols: list[str], probs: list[float], direct_rows: int = 100_000
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation of every column, missing values left out.

    Small inputs use one ``percentile`` aggregate. Larger ones are narrowed: a bounded sketch
    brackets each wanted rank, one pass counts the rows below, and only the values inside the
    bracket are counted one by one; too wide brackets are narrowed again.
    """
    counted = df.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
    if max(counted.values()) <= direct_rows:
        probs_lit = F.array(*[F.lit(p) for p in probs])
        row = df.agg(*[F.percentile(F.col(c).cast("double"), probs_lit).alias(c) for c in cols]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in cols}
    targets = []
    for c in cols:
        n = counted[c]
        for p in probs:
            rank = p * (n - 1)
            targets.append({"col": c, "n": n, "low_rank": math.floor(rank), "high_rank": math.ceil(rank),
                            "part": rank - math.floor(rank), "lo": -math.inf, "hi": math.inf,
                            "below": 0, "inside": n, "open": n > 0})
    accuracy = 10_000
    while any(t["open"] and t["inside"] > direct_rows for t in targets):
        wide = [t for t in targets if t["open"] and t["inside"] > direct_rows]
        sketches = df.agg(*[_bracket(t, accuracy).alias(f"b{i}") for i, t in enumerate(wide)]).first()
        brackets = [sketches[f"b{i}"] for i in range(len(wide))]
        checks = []
        for i, (t, (lo, hi)) in enumerate(zip(wide, brackets)):
            value = F.col(t["col"]).cast("double")
            checks += [F.count_if(value < lo).alias(f"l{i}"), F.count_if(value <= hi).alias(f"h{i}")]
        seen = df.agg(*checks).first()
        for i, (t, (lo, hi)) in enumerate(zip(wide, brackets)):
            below, upto = seen[f"l{i}"], seen[f"h{i}"]
            sound = below <= t["low_rank"] and upto > t["high_rank"]
            shrunk = upto - below < t["inside"]
            if sound and shrunk:
                t.update(lo=lo, hi=hi, below=below, inside=upto - below)
            t["open"] = sound and shrunk and lo < hi
    return _ranked_values(df, cols, probs, targets)


def _bracket(target: dict, accuracy: int):
    value = F.col(target["col"]).cast("double")
    inside = F.when((value >= F.lit(target["lo"])) & (value <= F.lit(target["hi"])), value)
    margin = 2.0 / accuracy
    low = (target["low_rank"] - target["below"]) / target["inside"] - margin
    high = (target["high_rank"] - target["below"]) / target["inside"] + margin
    return F.percentile_approx(inside, [max(0.0, low), min(1.0, high)], accuracy)


def _ranked_values(df: DataFrame, cols, probs, targets) -> dict[str, list[float | None]]:
    """Look the wanted ranks up among the distinct values inside the brackets."""
    cells = [
        F.when(
            F.col(t["col"]).cast("double").between(t["lo"], t["hi"]),
            F.struct(F.lit(i).alias("target"), F.col(t["col"]).cast("double").alias("value")),
        )
        for i, t in enumerate(targets)
    ]
    inside = df.select(F.explode(F.array_compact(F.array(*cells))).alias("cell")).select("cell.*")
    counts = inside.groupBy("target", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("target").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    bounds = F.array(*[F.array(F.lit(t["low_rank"] - t["below"]), F.lit(t["high_rank"] - t["below"])) for t in targets])
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("want", F.get(bounds, F.col("target")))
    covers = lambda i: (F.get("want", F.lit(i)) < F.col("upto")) & (F.get("want", F.lit(i)) >= F.col("upto") - F.col("n"))
    picked = ranked.groupBy("target").agg(
        F.max(F.when(covers(0), F.col("value"))).alias("low"), F.max(F.when(covers(1), F.col("value"))).alias("high")
    )
    found = {r["target"]: (r["low"], r["high"]) for r in picked.collect()}
    out: dict[str, list[float | None]] = {c: [] for c in cols}
    for i, t in enumerate(targets):
        low, high = found.get(i, (None, None))
        out[t["col"]].append(None if low is None else low + t["part"] * (high - low))
    return out
