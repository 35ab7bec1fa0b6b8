"""Feature attributions: exact for linear scores and for trees, by permutations or coalitions for any model."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.functions.seeded import hash_key, integer
from cohortwise.operators.ordering import seeded_positions
from cohortwise.session import materialize


def linear_attribution(df: DataFrame, key: str, weights: dict[str, float], background: DataFrame | None = None) -> DataFrame:
    """(key, feature, value, attribution): weight times distance from the background mean.

    The attributions of a row add up to its score minus the mean score.
    """
    background = df if background is None else background
    means = background.agg(F.struct(*[F.avg(c).alias(c) for c in weights]).alias("m")).scalar()
    held = df.withColumn("_m", means)
    parts = [
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                 (F.lit(float(w)) * (F.col(c) - F.col(f"_m.{c}"))).alias("attribution"))
        for c, w in weights.items()
    ]
    return held.select(key, F.inline(F.array(*parts)))


def mean_abs(attributions: DataFrame) -> DataFrame:
    """(feature, mean_abs): the importance table."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))


def top_features(attributions: DataFrame, n: int = 10) -> DataFrame:
    return mean_abs(attributions).orderBy(F.col("mean_abs").desc(), "feature").limit(n)


def dependence(attributions: DataFrame, key: str, n: int = 3) -> DataFrame:
    """Value and attribution pairs of the n most important features."""
    top = top_features(attributions, n).select("feature")
    return attributions.join(F.broadcast(top), "feature", "left_semi").select(key, "feature", "value", "attribution")


def sampled_shapley(
    model, rows: DataFrame, background: DataFrame, key: str, cols: list[str], permutations: int = 16, seed=42,
    score=lambda df: df.withColumn("_score", vector_to_array("probability")[1]),
) -> DataFrame:
    """(key, feature, value, attribution, base, score) by permutation sampling.

    ``rows`` and ``background`` are samples; ``score`` adds column ``_score`` to what the model made. For every row and permutation a background row is
    turned into the explained row one feature at a time; all steps are scored by the model in
    one distributed pass, and a feature gets the mean change of its step. The changes of a row
    add up to its score minus the mean score of the background rows drawn for it. The background is numbered in a seeded
    order and the drawn numbers are joined, so it may be of any size.
    """
    d = len(cols)
    known = rows.select(key, F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    pool = background.select(key, F.array(*[F.col(c).cast("double") for c in cols]).alias("b"))
    pool = materialize(seeded_positions(pool, key, f"{seed}bg", "_place").select("_place", "b"), "pool")
    size = pool.count()
    drawn = (
        known.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
        .withColumn("_place", F.pmod(integer(f"{seed}draw", 0, 1 << 30, key, "perm"), F.lit(size)).cast("bigint") + 1)
        .join(pool, "_place")
        .drop("_place")
    )
    order = F.array_sort(F.array(*[F.struct(hash_key(f"{seed}f{j}", key, "perm").alias("h"), F.lit(j).alias("j")) for j in range(d)]))
    stepped = (
        drawn.withColumn("order", F.transform(order, lambda s: s["j"]))
        .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    )
    mixed = stepped.select(
        key, "perm", "step", F.when(F.col("step") > 0, F.get("order", F.col("step") - 1)).alias("j"), "x",
        *[F.when(F.array_position("order", j) <= F.col("step"), F.col("x")[j]).otherwise(F.col("b")[j]).alias(c) for j, c in enumerate(cols)],
    )
    scored = score(model.transform(mixed)).select(key, "perm", "step", "j", "x", "_score").withColumnRenamed("_score", "score")
    along = Window.partitionBy(key, "perm").orderBy("step")
    changes = scored.withColumn("change", F.col("score") - F.lag("score").over(along))
    names = F.array(*[F.lit(c) for c in cols])
    ends = changes.groupBy(key).agg(
        F.avg(F.when(F.col("step") == 0, F.col("score"))).alias("base"), F.avg(F.when(F.col("step") == d, F.col("score"))).alias("score")
    )
    per_feature = changes.filter("step > 0").groupBy(key, "j").agg(
        F.avg("change").alias("attribution"), F.first("x").alias("x")
    )
    return per_feature.join(ends, key).select(
        key, F.get(names, F.col("j")).alias("feature"), F.get("x", F.col("j")).alias("value"), "attribution", "base", "score"
    )


MOST_BACKGROUND = 1_000
MOST_KERNEL_FEATURES = 62


def coalitions(d: int, most: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(known, solver): which features each coalition knows, none and all last, and the matrix that turns its values into attributions.

    The attributions are the least squares fit to the coalitions' values, weighted by the kernel of their sizes, that adds up to the difference
    between all and none; that is linear in the values, so one matrix serves all rows. Up to ``most`` proper coalitions are all
    taken, else ``most`` are drawn by size, each with its opposite.
    """
    if 2**d - 2 <= most:
        known = (np.arange(1, 2**d - 1)[:, None] >> np.arange(d)) & 1
        size = known.sum(axis=1)
        weight = np.array([(d - 1) / (math.comb(d, int(k)) * k * (d - k)) for k in size])
    else:
        draw, sizes = np.random.default_rng(seed), np.arange(1, d)
        chance = 1.0 / (sizes * (d - sizes))
        drawn = np.zeros((most // 2, d), int)
        for row, k in zip(drawn, draw.choice(sizes, most // 2, p=chance / chance.sum())):
            row[draw.permutation(d)[:k]] = 1
        known, weight = np.unique(np.vstack([drawn, 1 - drawn]), axis=0, return_counts=True)
    ends = np.array([[0] * d, [1] * d])
    if d == 1:
        return ends, np.array([[-1.0, 1.0]])
    pull = known.T * weight
    normal = pull @ known
    if np.linalg.matrix_rank(normal) < d:
        raise ValueError("too few coalitions for the features: raise their number")
    inverse = np.linalg.inv(normal)
    lean = inverse.sum(axis=1)
    share = lean / lean.sum()
    inner = (inverse - np.outer(share, inverse.sum(axis=0))) @ pull
    return np.vstack([known, ends]), np.column_stack([inner, -share - inner.sum(axis=1), share])


def kernel_attributions(
    model, rows: DataFrame, background: DataFrame, key: str, cols: list[str], most: int = 2048, seed=42,
    score=lambda df: df.withColumn("_score", vector_to_array("probability")[1]),
) -> DataFrame:
    """(key, feature, value, attribution, base, score) by weighted least squares over coalitions of features, for any model.

    A coalition's value is the mean score of the row with the features it does not know taken from every background row. With 2^d - 2 up to ``most``
    the attributions are the exact Shapley values of that. They always add up to the score less the base. ``key`` must be unique, columns
    not null; no rows in, no rows out. The background is a sample of at most 1,000 rows; it and the coalitions are joined by number, the
    explained rows stay where they are until their sums.
    """
    d, spark = len(cols), rows.sparkSession
    if d > MOST_KERNEL_FEATURES:
        raise ValueError(f"at most {MOST_KERNEL_FEATURES} features")
    known, solver = coalitions(d, most, seed)
    masks = [sum(1 << j for j in range(d) if row[j]) for row in known]
    asked = spark.createDataFrame([(z, m, p) for z, (m, p) in enumerate(zip(masks, solver.T.tolist()))], "z int, mask long, p array<double>")
    pool = materialize(background.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("b")), "background")
    size = pool.count()
    if not 0 < size <= MOST_BACKGROUND:
        raise ValueError(f"the background holds 1 to {MOST_BACKGROUND} rows, not {size}: sample it")
    numbered = pool.agg(F.posexplode(F.array_sort(F.collect_list("b"))).alias("place", "b"))
    spread = (
        rows.select(key, F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
        .withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1)))).join(F.broadcast(asked), "z")
        .withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).join(F.broadcast(numbered), "place")
    )
    has = lambda j: F.shiftright("mask", j).bitwiseAND(F.lit(1)) == 1
    mixed = spread.select(key, "z", "p", "x", *[F.when(has(j), F.col("x")[j]).otherwise(F.col("b")[j]).alias(c) for j, c in enumerate(cols)])
    scored = score(model.transform(mixed)).withColumn("_score", F.col("_score") / size)
    end = lambda z: F.sum(F.when(F.col("z") == z, F.col("_score"))).alias
    # Numbers only: with an array among them the sums would be taken by sorting all scored rows.
    sums = scored.groupBy(key).agg(
        *[F.first(F.col("x")[j]).alias(f"_x{j}") for j in range(d)], end(len(masks) - 2)("base"), end(len(masks) - 1)("score"),
        *[F.sum(F.col("p")[j] * F.col("_score")).alias(f"_a{j}") for j in range(d)],
    )
    parts = [F.struct(F.lit(c).alias("feature"), F.col(f"_x{j}").alias("value"), F.col(f"_a{j}").alias("attribution")) for j, c in enumerate(cols)]
    return sums.select(key, F.inline(F.array(*parts)), "base", "score")


def tree_paths(tree: dict) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """(value, conditions) of every leaf: per feature on its path the bounds low < x <= high and the share of rows that go that way.

    ``tree`` holds ``left``, ``right``, ``feature``, ``threshold``, ``cover`` and ``value`` by node, the root first.
    """
    found, open_ = [], [(0, {})]
    while open_:
        node, held = open_.pop()
        if tree["left"][node] < 0:
            found.append((float(tree["value"][node]), [(f, *c) for f, c in sorted(held.items())]))
            continue
        feature, cut = int(tree["feature"][node]), float(tree["threshold"][node])
        low, high, share = held.get(feature, (-math.inf, math.inf, 1.0))
        for child, bounds in ((tree["left"][node], (low, min(high, cut))), (tree["right"][node], (max(low, cut), high))):
            open_.append((int(child), {**held, feature: (*bounds, share * float(tree["cover"][child]) / float(tree["cover"][node]))}))
    return found


def path_attributions(x: np.ndarray, paths: list) -> tuple[np.ndarray, float]:
    """Shapley values of all rows under one tree, and the tree's value where nothing is known.

    An unknown feature goes both ways by the shares of the rows that did. A leaf is then a product of one factor per feature on its
    path: whether the row meets its bounds if the feature is known, else the share. Subsets are never listed: the product's
    coefficients by the number of known features carry all their weights.
    """
    out, base = np.zeros(x.shape), 0.0
    for value, conditions in paths:
        m = len(conditions)
        base += value * math.prod(c[3] for c in conditions)
        if not m or not value:
            continue
        meets = [((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, low, high, _ in conditions]
        weights = np.array([math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)])
        for i, (feature, _, _, share) in enumerate(conditions):
            sums = np.zeros((len(x), m))
            sums[:, 0] = 1.0
            for j, (_, _, _, other) in enumerate(conditions):
                if j != i:
                    grown = sums * other
                    grown[:, 1:] += sums[:, :-1] * meets[j][:, None]
                    sums = grown
            out[:, feature] += value * (meets[i] - share) * (sums @ weights)
    return out, base


def tree_attributions(rows: DataFrame, trees: list[dict], key: str, cols: list[str]) -> DataFrame:
    """(key, feature, value, attribution, base, score): exact attributions of the mean of ``trees``, one pass over ``rows``.

    Trees are as ``tree_paths`` takes them, over the columns in order; they travel as one value bounded by their nodes. The attributions of a row add
    up to its score minus the base. No rows in, no rows out. Columns must not be null.
    """
    paths, names = [tree_paths(t) for t in trees], list(cols)

    def run(batches):
        for batch in batches:
            x = batch[names].to_numpy(float)
            made = [path_attributions(x, p) for p in paths]
            parts, base = sum(m[0] for m in made) / len(made), sum(m[1] for m in made) / len(made)
            yield pd.DataFrame({
                key: np.repeat(batch[key].to_numpy(), len(names)), "feature": names * len(x), "value": x.ravel(),
                "attribution": parts.ravel(), "base": base, "score": np.repeat(base + parts.sum(axis=1), len(names)),
            })

    kind = rows.schema[key].dataType.simpleString()
    chosen = rows.select(key, *[F.col(c).cast("double").alias(c) for c in cols])
    return chosen.mapInPandas(run, f"{key} {kind}, feature string, value double, attribution double, base double, score double")
