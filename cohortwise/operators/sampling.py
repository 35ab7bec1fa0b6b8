"""Deterministic splits, samples, shuffles, replication and rebalancing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.seeded import hash_key, integer, uniform
from cohortwise.functions.vectors import as_double
from cohortwise.operators.ordering import first_in_class, rank_bounds, seeded_positions
from cohortwise.session import materialize


def positional_class_split(df: DataFrame, label: str, key: str, k: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the first k rows of each class in the order of ``key``, then ``ties``, are ``train``, the rest ``test``.

    ``key`` and ``ties`` together tell the rows of a class apart. Rows without a label belong to no class: they
    are ``unlabeled``. Only the k-th place per class is looked for; the rows themselves are compared, not sorted.
    """
    order = [key, *ties]
    bounds = materialize(first_in_class(df, label, order, k, "_last"), "bounds")
    split = F.when(F.col(label).isNull(), "unlabeled").when(F.struct(*order) <= F.col("_last"), "train").otherwise("test")
    return df.join(bounds, label, "left").withColumn("split", split).drop("_last")


def stratified_split(df: DataFrame, label: str, key: str, fraction: float = 0.2, seed=42) -> DataFrame:
    """Exactly ceil(fraction * n) rows of each class, chosen by seeded hash, are ``test``; rows without a label are ``unlabeled``."""
    keyed = df.withColumn("_hash", hash_key(seed, key))
    bounds = rank_bounds(keyed, label, "_hash", [lambda n: F.ceil(n * F.lit(fraction))], "_bound")
    split = F.when(F.col(label).isNull(), "unlabeled").when(F.col("_hash") <= F.get("_bound", F.lit(0)), "test").otherwise("train")
    return keyed.join(materialize(bounds, "bounds"), label, "left").withColumn("split", split).drop("_hash", "_bound")


def labeled_split(
    df: DataFrame, label: str, key: str, per_class: int, validation: int = 0, overlap: bool = False, seed=42
) -> DataFrame:
    """Seeded choice of labelled rows per class; rows without a label are always ``unlabeled``.

    Disjoint form: the last ``validation`` rows of each class in seeded order are ``validation``,
    the remaining ones ``unlabeled``. Overlap form: every row is also listed as ``unlabeled``.
    """
    keyed = df.withColumn("_hash", hash_key(seed, key))
    ranks = [lambda n: F.least(n, F.lit(per_class))]
    if validation and not overlap:
        ranks.append(lambda n: F.greatest(n - F.lit(validation - 1), F.lit(1)))
    bounds = materialize(rank_bounds(keyed, label, "_hash", ranks, "_bound"), "bounds")
    tagged = keyed.join(bounds, label, "left")
    chosen = F.coalesce(F.col("_hash") <= F.get("_bound", F.lit(0)), F.lit(False))
    if overlap:
        labeled = tagged.filter(chosen).withColumn("part", F.lit("labeled"))
        return labeled.unionByName(tagged.withColumn("part", F.lit("unlabeled"))).drop("_hash", "_bound")
    part = F.when(chosen, "labeled")
    if validation:
        part = part.when(F.col("_hash") >= F.get("_bound", F.lit(1)), "validation")
    return tagged.withColumn("part", part.otherwise("unlabeled")).drop("_hash", "_bound")


def stratified_folds(df: DataFrame, label: str, key: str, folds: int, name: str = "fold", seed=42) -> DataFrame:
    """Add the cross-validation fold of each row: per class the seeded order cut into ``folds`` parts that differ by at most one row.

    Rows without a label are in no fold, null.
    """
    keyed = df.withColumn("_hash", hash_key(f"{seed}fold", key))
    ranks = [lambda n, i=i: F.ceil(n * F.lit(i) / F.lit(folds)) for i in range(1, folds)]
    bounds = materialize(rank_bounds(keyed, label, "_hash", ranks, "_bound"), "bounds")
    below = F.size(F.filter("_bound", lambda b: b < F.col("_hash")))
    fold = F.when(F.col(label).isNotNull(), below).cast("int")
    return keyed.join(bounds, label, "left").withColumn(name, fold).drop("_hash", "_bound")


def seeded_sample(df: DataFrame, key: str, n: int, seed=42) -> DataFrame:
    """n rows without replacement; each task keeps only its n smallest hashes."""
    return df.withColumn("_hash", hash_key(seed, key)).orderBy("_hash", key).limit(n).drop("_hash")


def replicate(df: DataFrame, times: int) -> DataFrame:
    """Repeat every row; ``copy`` numbers the repetitions."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def expansion_factor(batch: int, steps: int, labeled: int) -> int:
    """Repetitions of the labelled set that fill all batches of an epoch."""
    return max(1, math.ceil(batch * steps / labeled))


def permuted_pairs(df: DataFrame, key: str, seed=42) -> DataFrame:
    """(key, partner): a random permutation, the ranks of one seeded order meeting the ranks
    of another."""
    keys = df.select(key)
    own = seeded_positions(keys, key, f"{seed}a", "_rank")
    other = seeded_positions(keys.withColumnRenamed(key, "partner"), "partner", f"{seed}b", "_rank")
    return own.join(other, "_rank").select(key, "partner")


def smote(
    df: DataFrame, key: str, vec: str, label: str, minority: int, k: int = 5, seed=42
) -> DataFrame:
    """All rows, plus synthetic minority rows until both classes are equally large.

    Synthetic row i starts at a minority row, picks one of its k nearest minority neighbours
    and lies a seeded share of the way towards it. The starts go round the minority rows in
    seeded order, so every row serves equally often.
    """
    from cohortwise.operators.neighbors import knn_join

    counts = df.agg(
        F.count_if(F.col(label) == minority).alias("few"), F.count_if(F.col(label) != minority).alias("many")
    ).first()
    small = df.filter(F.col(label) == minority).select(key, as_double(vec).alias(vec))
    real = df.select(
        F.col(key).cast("bigint").alias("source_id"), F.lit(0).cast("bigint").alias("copy"), F.col(label).cast("int").alias(label),
        as_double(vec).alias(vec),
    )
    missing = counts["many"] - counts["few"]
    if missing <= 0 or counts["few"] < 2:
        return real
    k = min(k, counts["few"] - 1)
    neighbors = knn_join(small, small, key, vec, k, exclude_self=True)
    rounds, rest = divmod(missing, counts["few"])
    starts = seeded_positions(small, key, f"{seed}start", "_rank")
    per_row = F.lit(rounds) + (F.col("_rank") <= rest).cast("long")
    drawn = (
        starts.withColumn("_n", per_row).filter("_n > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
        .withColumn("rank", integer(f"{seed}pick", 1, k + 1, key, "copy").cast("bigint"))
        .withColumn("_share", uniform(f"{seed}share", key, "copy"))
    )
    targets = small.select(F.col(key).alias("neighbor_id"), F.col(vec).alias("_to"))
    synthetic = (
        drawn.join(neighbors.select(F.col("query_id").alias(key), "neighbor_id", "rank"), [key, "rank"])
        .join(targets, "neighbor_id")
        .select(
            F.col(key).cast("bigint").alias("source_id"), "copy", F.lit(minority).cast("int").alias(label),
            F.zip_with(vec, "_to", lambda a, b: a + F.col("_share") * (b - a)).alias(vec),
        )
    )
    return real.unionByName(synthetic)
