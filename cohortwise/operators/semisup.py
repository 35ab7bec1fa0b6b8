"""Semi-supervised labelling: pseudo labels, consistency losses, mixing, self-training."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions import vectors as V
from cohortwise.operators.evaluate import cross_entropy, soft_cross_entropy, squared_gap
from cohortwise.operators.sampling import labeled_split, permuted_pairs
from cohortwise.session import materialize


def confident(probabilities, threshold: float) -> Column:
    return F.array_max(probabilities) >= threshold


def pseudo_label(df: DataFrame, logits: str, temperature: float = 1.0, threshold: float = 0.95) -> DataFrame:
    """Add ``confidence``, ``pseudo`` and ``keep`` from softmax(logits / temperature)."""
    held = df.withColumn("_p", V.softmax(F.col(logits), temperature))
    return held.withColumns({
        "confidence": F.array_max("_p"), "pseudo": V.argmax(F.col("_p")), "keep": confident("_p", threshold)
    }).drop("_p")


def consistency_loss(
    labeled: DataFrame, unlabeled: DataFrame, label: str, logits: str, weak: str, strong: str,
    temperature: float = 1.0, threshold: float = 0.95, weight: float = 1.0,
) -> DataFrame:
    """One row (lx, lu, loss, mask_rate).

    lx: cross-entropy of the labelled rows. lu: cross-entropy of the strong view against the
    weak view's pseudo label, zero where it is not confident, averaged over all rows.
    """
    lx = labeled.agg(F.avg(cross_entropy(F.col(logits), F.col(label)))).scalar()
    marked = pseudo_label(unlabeled, weak, temperature, threshold)
    mask = F.col("keep").cast("double")
    lu = F.avg(cross_entropy(F.col(strong), F.col("pseudo")) * mask)
    return marked.agg(lu.alias("lu"), F.avg(mask).alias("mask_rate")).withColumn("lx", lx).withColumn(
        "loss", F.col("lx") + weight * F.col("lu")
    )


def soft_label_losses(df: DataFrame, logits: str, target: str, classes: int) -> DataFrame:
    """One row: soft cross-entropy, and squared error over all cells."""
    return df.agg(
        F.avg(soft_cross_entropy(F.col(logits), F.col(target))).alias("lx"),
        F.avg(squared_gap(F.col(logits), F.col(target), classes)).alias("lu"),
    )


def mixing_weight(alpha: float, seed: int = 42) -> float:
    """A Beta(alpha, alpha) draw folded to at least one half; one number per batch."""
    share = float(np.random.default_rng(seed).beta(alpha, alpha))
    return max(share, 1.0 - share)


def ramp_up(step: float, length: float) -> float:
    """Linear growth of the unlabelled weight from 0 to 1."""
    return 1.0 if length == 0 else min(max(step / length, 0.0), 1.0)


def mixup(df: DataFrame, key: str, vec: str, target: str, share: float, seed=42) -> DataFrame:
    """(key, partner, vec, target): every row mixed with the row a seeded permutation gives it."""
    rows = materialize(df.select(key, vec, target), "mixup")
    pairs = permuted_pairs(rows, key, seed)
    partners = rows.select(F.col(key).alias("partner"), F.col(vec).alias("_v"), F.col(target).alias("_t"))
    joined = rows.join(pairs, key).join(partners, "partner")
    return joined.select(
        key, "partner", V.blend(F.col(vec), F.col("_v"), F.lit(share)).alias(vec),
        V.blend(F.col(target), F.col("_t"), F.lit(share)).alias(target),
    )


def mixmatch_rows(
    labeled: DataFrame, unlabeled: DataFrame, key: str, classes: int, temperature: float, share: float, seed=42
) -> DataFrame:
    """(id, part, vec, target, partner): the mixed rows of one step.

    ``labeled`` holds (key, view, label), ``unlabeled`` (key, first, second, logits_first, logits_second): two weak views and what the
    model says about them. Their sharpened mean is the guessed target of both views. All rows together are mixed
    with one share: each with the row that a seeded permutation gives it.
    """
    named = lambda part: F.concat(F.lit(f"{part}|"), F.col(key).cast("string")).alias("id")
    guess = V.sharpen(V.softmax(F.col("logits_first")), V.softmax(F.col("logits_second")), temperature)
    guessed = unlabeled.withColumn("target", guess)
    rows = labeled.select(named("x"), F.lit("x").alias("part"), F.col("view").alias("vec"), V.one_hot("label", classes).alias("target"))
    for part, view in (("a", "first"), ("b", "second")):
        rows = rows.unionByName(guessed.select(named(part), F.lit(part).alias("part"), F.col(view).alias("vec"), "target"))
    rows = materialize(rows, "mixmatch")
    mixed = mixup(rows, "id", "vec", "target", share, seed)
    return mixed.withColumn("part", F.substring("id", 1, 1))


def mixmatch_loss(scored: DataFrame, logits: str, target: str, classes: int, weight: float, step: float, length: float) -> DataFrame:
    """One row (lx, lu, weight, loss) of mixed rows with logits: the labelled part by cross-entropy, the rest by squared
    error, which counts ``weight`` times the ramp at ``step`` of ``length``."""
    known = F.col("part") == "x"
    grown = float(weight) * ramp_up(step, length)
    return scored.agg(
        F.avg(F.when(known, soft_cross_entropy(F.col(logits), F.col(target)))).alias("lx"),
        F.avg(F.when(~known, squared_gap(F.col(logits), F.col(target), classes))).alias("lu"),
    ).select("lx", "lu", F.lit(grown).alias("weight"), (F.col("lx") + F.lit(grown) * F.col("lu")).alias("loss"))


def self_training(
    labeled: DataFrame, unlabeled: DataFrame, test: DataFrame, key: str, vec: str, label: str,
    rounds: int = 3, threshold: float = 0.95, iterations: int = 50,
) -> DataFrame:
    """(round, n_labeled, accuracy): fit, label the confident unlabelled rows, fit again.

    Every round's additions are written down, so the plan does not grow with the rounds and a
    lost executor costs no earlier round.
    """
    ready = lambda df: df.select(key, array_to_vector(V.as_double(vec)).alias("f"), F.col(label).cast("double").alias("y"))
    known = materialize(ready(labeled), "known")
    pool = materialize(ready(unlabeled).drop("y"), "pool")
    held = materialize(ready(test), "held")
    learner = LogisticRegression(featuresCol="f", labelCol="y", family="multinomial", maxIter=iterations, regParam=0.01)
    added, table = None, []
    for step in range(rounds):
        training = known if added is None else known.unionByName(added)
        model = learner.fit(training)
        right = model.transform(held).agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
        table.append((step, training.count(), float(right)))
        if step + 1 == rounds:
            break
        scored = model.transform(pool).withColumn("p", vector_to_array("probability"))
        # All confident rows are labelled afresh each round, so an early mistake can be undone.
        added = materialize(scored.filter(confident("p", threshold)).select(key, "f", F.col("prediction").alias("y")), "pseudo")
    return labeled.sparkSession.createDataFrame(table, "round int, n_labeled bigint, accuracy double")


def label_budget_sweep(
    df: DataFrame, test: DataFrame, key: str, vec: str, label: str, budgets: list[int], rounds: int = 3, threshold: float = 0.95
) -> DataFrame:
    """(budget, round, n_labeled, accuracy): self-training with ever more labels per class."""
    out = None
    for budget in budgets:
        cut = labeled_split(df, label, key, budget)
        run = self_training(cut.filter("part = 'labeled'"), cut.filter("part = 'unlabeled'"), test, key, vec, label, rounds, threshold)
        run = run.withColumn("budget", F.lit(budget))
        out = run if out is None else out.unionByName(run)
    return out.select("budget", "round", "n_labeled", "accuracy")
