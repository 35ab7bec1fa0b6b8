"""Mixing sources to target weights along a time-varying curriculum.

Every source has a schedule, its weight as a function of training time in [0, 1]. Integrated and
scaled to the source's target it says how many of the source's words are demanded up to a time;
inverted it says at which time the word at a given place of the source is due. A document copy
trains at the time its middle word is due, and the mixture is the range sort of all copies by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.seeded import hash_key
from cohortwise.llm.words import word_count
from cohortwise.operators.ordering import ordered_index, ordered_running_sums
from cohortwise.session import materialize

# Weights over time at equal steps, taken in turn by the sources: steady, fading out, ramping up.
SCHEDULES = [[1.0, 1.0, 1.0], [2.0, 1.0, 0.5], [0.5, 1.0, 2.0]]


def source_targets(sizes: DataFrame, weights=(5, 2, 1), budget: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """(source, place, source_size, weight, target) from rows (source, size).

    The sources by code point, null last, take ``weights`` in turn and share ``budget`` times all
    sizes by weight. A target stops at ``repeats`` times its source's size; the excess is shared
    again by weight until none is above. Each round is one aggregate over the sources. Sources
    without a word get target 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = ordered_index(totals, [F.col("source").asc_nulls_last()], "place")
    turn = (F.col("place") % len(weights)).cast("int")
    weighed = materialize(
        placed.select(
            "source", "place", "source_size", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"),
            (F.col("source_size") * F.lit(float(repeats))).alias("cap"),
        ),
        "sources",
    )
    rate, known = 0.0, None
    while True:
        full = F.lit(False) if known is None else F.col("cap") < F.col("weight") * F.lit(rate)
        row = weighed.agg(
            F.sum("source_size").alias("all"), F.count_if(full).alias("full"),
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("capped"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if row["full"] == known or not row["open"]:
            break
        known = row["full"]
        rate = (budget * row["all"] - row["capped"]) / row["open"]
    target = F.least("cap", F.col("weight") * F.lit(rate))
    return weighed.select("source", "place", "source_size", "weight", target.alias("target"))


def due_time(share: Column, place: Column, schedules=None) -> Column:
    """The time at which a source's cumulative demand reaches ``share`` of its target.

    The schedule is linear between its knots, so its integral is quadratic in each step and is
    inverted in closed form there.
    """
    schedules = SCHEDULES if schedules is None else schedules
    turn, chosen = place % len(schedules), None
    for i, knots in enumerate(schedules):
        step = 1.0 / (len(knots) - 1)
        areas = [(a + b) * step / 2 for a, b in zip(knots, knots[1:])]
        done, whole = 0.0, sum(areas)
        for j, area in enumerate(areas):
            first, slope = knots[j], (knots[j + 1] - knots[j]) / step
            left = F.greatest(share * F.lit(whole) - F.lit(done), F.lit(0.0))
            into = left * 2.0 / (F.lit(first) + F.sqrt(F.lit(first * first) + left * (2.0 * slope)))
            at = F.round(F.lit(j * step) + F.least(into, F.lit(step)), 9)
            done += area
            here = turn == i if j == len(areas) - 1 else (turn == i) & (share * F.lit(whole) <= F.lit(done))
            chosen = F.when(here, at) if chosen is None else chosen.when(here, at)
    return chosen


def mixture(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=(5, 2, 1), budget: float = 1.5, repeats: float = 2.0, schedules=None, seed=7,
) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, copies, taken, first_at, text_key``, and what
    ``training_order`` needs.

    ``size`` counts the words of the whole text, ``copies`` how often the mix takes the document,
    ``taken = size * copies``. A source is passed in a seeded order; whole passes are taken while
    they fit in the target, and of the last pass the documents whose middle word fits, so a source
    misses its target by at most half the size of one document. ``first_at`` is the training time of the
    first copy, null where none is taken; ``done`` counts the source's words up to the document.

    A null text or one without words has size 0 (it takes part as often as the words around it).
    A null source is a source of its own, the last one. Null and repeated ids are
    allowed: every row counts. Ties of the seeded order go by id, size, text. No rows in, no rows out.
    Other columns are not read. Nothing is sorted per source: sums run over range partitions.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(text_col).alias("text_key"),
        F.substring(hash_key(seed, F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 16).alias("key"),
    )
    sized = materialize(rows, "sizes")
    targets = materialize(source_targets(sized.select("source", "size"), weights, budget, repeats), "targets")
    upto = ordered_running_sums(sized, ["source", "key", "doc_id", "size", "text_key"], {"size": "upto"})
    running = materialize(upto, "running")
    starts = running.groupBy("source").agg(F.min(F.col("upto") - F.col("size")).alias("start"))
    per_source = starts.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    per_source = materialize(per_source.withColumnRenamed("source", "of"), "passes")
    joined = running.join(per_source, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    before = F.col("done") - F.col("size")
    partial = (2 * before + F.col("size")) <= 2.0 * rest
    middle = (before + F.col("size") / 2.0) / F.col("target")
    return (
        joined.withColumn("done", F.col("upto") - F.col("start"))
        .withColumn("whole", whole.cast("bigint"))
        .withColumn("copies", (F.col("whole") + partial.cast("bigint")))
        .withColumn("taken", F.col("size") * F.col("copies"))
        .withColumn("first_at", F.when((F.col("copies") > 0) & (F.col("target") > 0), due_time(middle, F.col("place"), schedules)))
        .select("doc_id", "source", "size", "source_size", "target", "copies", "taken", "first_at", "text_key", "place", "done", "key")
    )


def training_order(mixed: DataFrame, schedules=None) -> DataFrame:
    """Every taken copy with its training time and zero-based position: the range sort by time.

    ``mixed`` comes from ``mixture``. Copies of documents without words, which no demand can
    place, come at time 0. Ties go by source, seeded key, id, pass.
    """
    copies = mixed.filter(F.col("copies") > 0).withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    before = (F.col("pass") - 1) * F.col("source_size") + F.col("done") - F.col("size") / 2.0
    at = F.when(F.col("target") > 0, due_time(before / F.col("target"), F.col("place"), schedules)).otherwise(F.lit(0.0))
    timed = copies.withColumn("at", at)
    return ordered_index(timed, ["at", "source", "key", "doc_id", "text_key", "pass"], "position")


def dealt(mixed: DataFrame, schedules=None) -> DataFrame:
    """The rows of ``mixture`` with what ``training_order`` makes of them.

    ``taken`` is the sum of the sizes of a row's copies in the order, 0 where it has none; ``first_at``, ``last_at``,
    ``first_position`` and ``last_position`` are the times and places of its first and last copy, null where it has none. The
    order is written with times and positions, so all of it is made whatever columns are read.
    """
    rows = materialize(mixed.drop("taken", "first_at").withColumn("_row", F.monotonically_increasing_id()), "mixed")
    order = materialize(training_order(rows, schedules).select("_row", "size", "at", "position"), "order")
    copies = order.groupBy("_row").agg(
        F.sum("size").alias("taken"), F.min("at").alias("first_at"), F.max("at").alias("last_at"),
        F.min("position").alias("first_position"), F.max("position").alias("last_position"),
    )
    return rows.join(copies, "_row", "left").withColumn("taken", F.coalesce("taken", F.lit(0))).drop("_row")
