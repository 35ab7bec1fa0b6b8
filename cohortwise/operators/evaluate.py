"""Evaluation tables: confusion, per-class reports, ROC, top-k, losses, model comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.vectors import log_softmax, softmax, total
from cohortwise.operators.ordering import ordered_running_sums

# Metric names in report order.
METRICS = ["Accuracy", "Precision", "Recall", "F1", "ROC AUC"]


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, n) for every pair of occurring classes, absent pairs with zero."""
    counts = df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))
    # Counted pairs only, so the list is as short as the number of classes.
    classes = counts.select(F.explode(F.array(label, prediction)).alias("c")).agg(F.array_sort(F.collect_set("c")).alias("cs"))
    grid = classes.select(F.explode("cs").alias(label), "cs").select(label, F.explode("cs").alias(prediction))
    return grid.join(counts, [label, prediction], "left").select(label, prediction, F.coalesce("n", F.lit(0)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    """Quotient, zero when undefined."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def binary_metrics(df: DataFrame, label: str, prediction: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 as (*by, metric, value) rows, one pass."""
    hit = (F.col(label) == 1) & (F.col(prediction) == 1)
    counts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == F.col(prediction)).alias("right"),
        F.count_if(hit).alias("tp"), F.count_if(F.col(prediction) == 1).alias("said"),
        F.count_if(F.col(label) == 1).alias("real"),
    )
    scores = {
        "Accuracy": _ratio(F.col("right"), F.col("n")),
        "Precision": _ratio(F.col("tp"), F.col("said")),
        "Recall": _ratio(F.col("tp"), F.col("real")),
        "F1": _ratio(2 * F.col("tp"), F.col("said") + F.col("real")),
    }
    wide = counts.select(*by, *[v.alias(n) for n, v in scores.items()])
    return wide.unpivot(list(by), list(scores), "metric", "value")


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    cm = confusion_matrix(df, label, prediction)
    sides = cm.select(
        F.explode(
            F.array(
                F.struct(F.col(label).alias("c"), F.col("n").alias("real"), F.lit(0).cast("long").alias("said")),
                F.struct(F.col(prediction).alias("c"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said")),
            )
        ).alias("s"),
        F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0).alias("tp"),
    )
    # The diagonal cell shows up on both sides; count it once.
    per_class = (
        sides.groupBy(F.col("s.c").alias("c"))
        .agg(F.sum("s.real").alias("real"), F.sum("s.said").alias("said"), (F.sum("tp") / 2).alias("tp"))
        .select(
            F.col("c").cast("string").alias("name"), _ratio(F.col("tp"), F.col("said")).alias("precision"),
            _ratio(F.col("tp"), F.col("real")).alias("recall"),
            _ratio(2 * F.col("tp"), F.col("said") + F.col("real")).alias("f1"), F.col("real").alias("support"), "tp",
        )
    )
    scores = ["precision", "recall", "f1"]
    averages = per_class.agg(
        F.sum("support").alias("support"), (F.sum("tp") / F.sum("support")).alias("accuracy"),
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[(F.sum(F.col(s) * F.col("support")) / F.sum("support")).alias(f"weighted_{s}") for s in scores],
    )
    tail = averages.select(
        F.inline(
            F.array(
                F.struct(F.lit("accuracy").alias("name"), F.lit(None).cast("double").alias("precision"),
                         F.lit(None).cast("double").alias("recall"), F.col("accuracy").alias("f1"), "support"),
                *[
                    F.struct(F.lit(f"{kind} avg").alias("name"), F.col(f"{kind}_precision").alias("precision"),
                             F.col(f"{kind}_recall").alias("recall"), F.col(f"{kind}_f1").alias("f1"), "support")
                    for kind in ("macro", "weighted")
                ],
            )
        )
    )
    return per_class.drop("tp").unionByName(tail)


def _score_groups(df: DataFrame, label: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Positives and negatives per distinct score, and their running sums from the highest
    score down. Equal scores are one row before anything is ordered."""
    groups = df.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    down = groups.withColumn("_down", -F.col("score"))
    return ordered_running_sums(down, [*by, "_down"], {"pos": "tp", "neg": "fp"}).drop("_down")


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score."""
    groups = _score_groups(df, label, score)
    ends = groups.agg(F.struct(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).alias("e"))
    return groups.withColumn("_e", ends.scalar()).select(
        F.col("score").alias("threshold"), _ratio(F.col("fp"), F.col("_e.neg")).alias("fpr"),
        _ratio(F.col("tp"), F.col("_e.pos")).alias("tpr"),
    )


def roc_auc(df: DataFrame, label: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact area under the ROC curve per group, ties counted half; NULL for a single class.

    The running sum goes on across groups; what it held before a group's first row comes off
    in the end: sum(neg * (above - start)) = sum(neg * above) - start * sum(neg).
    """
    above = F.col("tp") - F.col("pos")
    sums = _score_groups(df, label, score, by).groupBy(*by).agg(
        F.sum(F.col("neg") * (above + F.col("pos") / 2)).alias("won"), F.min(above).alias("start"),
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
    )
    area = (F.col("won") - F.col("start") * F.col("neg")) / (F.col("pos") * F.col("neg"))
    return sums.select(*by, F.when((F.col("pos") > 0) & (F.col("neg") > 0), area).alias("roc_auc"))


def topk_accuracy(df: DataFrame, label: str, scores: str, ks: list[int]) -> DataFrame:
    """Percentage of rows whose label is among the k best scores, earlier class first on ties."""
    own = F.get(F.col(scores), F.col(label))
    ahead = F.size(
        F.filter(
            F.transform(scores, lambda s, i: F.struct((s > own).alias("more"), ((s == own) & (i < F.col(label))).alias("tie"))),
            lambda t: t["more"] | t["tie"],
        )
    )
    ranked = df.select(ahead.alias("_ahead"))
    wide = ranked.agg(*[(F.avg((F.col("_ahead") < k).cast("double")) * 100).alias(f"top{k}") for k in ks])
    return wide.unpivot([], wide.columns, "metric", "value")


def cross_entropy(logits, label) -> Column:
    """-log softmax at the label."""
    return -F.get(log_softmax(logits), label)


def soft_cross_entropy(logits, target) -> Column:
    return -total(F.zip_with(log_softmax(logits), target, lambda lp, t: lp * t))


def squared_gap(logits, target, classes: int) -> Column:
    """Mean squared difference of softmax and target over the classes of one row."""
    return total(F.zip_with(softmax(logits), target, lambda p, t: (p - t) * (p - t))) / classes


def model_metrics(
    df: DataFrame, label: str, prediction: str, score: str | None = None, by: tuple[str, ...] = ()
) -> DataFrame:
    """The metric rows of one model, or of every model of a predictions table; ROC AUC only
    where there is a score."""
    rows = binary_metrics(df, label, prediction, by)
    if score is None:
        return rows
    areas = roc_auc(df, label, score, by)
    return rows.unionByName(areas.select(*by, F.lit("ROC AUC").alias("metric"), F.col("roc_auc").alias("value")))


def tag_union(parts: dict[str, DataFrame], tag: str = "model") -> DataFrame:
    """One long table from named parts."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def long_to_wide(metrics: DataFrame, names: list[str] = METRICS) -> DataFrame:
    """Model by metric; a metric a model lacks is NULL. The name list fixes the columns."""
    return metrics.groupBy("model").pivot("metric", names).agg(F.first("value"))


def best_per_metric(metrics: DataFrame) -> DataFrame:
    """The model with the highest value of each metric, the first name on ties."""
    present = metrics.filter(F.col("value").isNotNull())
    best = present.groupBy("metric").agg(F.max("value").alias("value"))
    return present.join(best, ["metric", "value"]).groupBy("metric", "value").agg(F.min("model").alias("model"))


def overall_score(metrics: DataFrame) -> DataFrame:
    """Mean over the metrics each model has."""
    return metrics.groupBy("model").agg(F.avg("value").alias("overall"))


def in_order(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    """Sort by an explicit category order instead of the name."""
    return df.orderBy(F.array_position(F.array(*[F.lit(o) for o in order]), F.col(col)), col)


def comparison_report(metrics: DataFrame, names: list[str] = METRICS, stamp: str | None = None) -> DataFrame:
    """Text report, one row (line_no, line) per line: table at four decimals, best model per
    metric, best overall."""
    cell = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.format_string("%.4f", F.col(c)))
    wide = long_to_wide(metrics, names).select(
        F.lit(2).alias("section"), F.col("model").alias("at"), F.concat_ws(" | ", F.col("model"), *[cell(n) for n in names]).alias("line")
    )
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("metric"))
    best = best_per_metric(metrics).select(
        F.lit(4).alias("section"), F.format_string("%03d", rank).alias("at"),
        F.format_string("%s: %s (%.4f)", "metric", "model", "value").alias("line"),
    )
    top = overall_score(metrics).orderBy(F.col("overall").desc(), "model").limit(1).select(
        F.lit(6).alias("section"), F.lit("").alias("at"),
        F.format_string("best overall: %s (mean score: %.4f)", "model", "overall").alias("line"),
    )
    titles = ["model comparison" if stamp is None else f"model comparison {stamp}", " | ".join(["model", *names]), "best model per metric", "overall"]
    numbers = [0, 1, 3, 5]
    heads = metrics.sparkSession.createDataFrame(list(zip(numbers, [""] * 4, titles)), "section int, at string, line string")
    lines = heads.unionByName(wide).unionByName(best).unionByName(top)
    # Models times metrics lines: a handful of rows.
    return _numbered(lines)


def _numbered(lines: DataFrame) -> DataFrame:
    gathered = lines.agg(F.array_sort(F.collect_list(F.struct("section", "at", "line"))).alias("ls"))
    return gathered.select(F.posexplode("ls").alias("pos", "l")).select(
        (F.col("pos") + 1).cast("bigint").alias("line_no"), F.col("l.line").alias("line")
    )
