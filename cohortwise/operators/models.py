"""Class weights, scaling, grid-searched models, clustering, and what they leave behind."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasLabelCol, HasOutputCol, HasOutputCols, HasPredictionCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from cohortwise.functions.vectors import as_double, euclidean
from cohortwise.operators import batched, machines
from cohortwise.operators.aggregates import between_group_spread, group_means, group_mode, group_positive_rate
from cohortwise.operators.clustering import kmeans_starts
from cohortwise.operators.network import RectifierNetwork
from cohortwise.operators.sampling import stratified_folds
from cohortwise.session import materialize, scratch_path


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): labelled rows over classes times rows of the class. A missing label is no class."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).alias("w")).scalar()
    return counts.withColumn("_w", whole).select(
        label, "n", (F.col("_w.n") / (F.col("_w.c") * F.col("n"))).alias("weight")
    )


def add_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Every row with the weight of its class, null where the label is missing."""
    weights = materialize(class_weights(df, label).select(label, F.col("weight").alias(name)), "weights")
    return df.join(weights, label, "left")


class _Scale(HasInputCols, HasOutputCols):
    means = Param(Params._dummy(), "means", "mean per column", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population deviation per column", TypeConverters.toListFloat)


class PopulationScalerModel(Model, _Scale, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        means, stds = self.getOrDefault(self.means), self.getOrDefault(self.stds)
        scaled = {}
        for source, target, m, s in zip(self.getInputCols(), self.getOutputCols(), means, stds):
            scaled[target] = (F.col(source) - F.lit(m)) / F.lit(s if s > 0 else 1.0)
        return dataset.withColumns(scaled)


class PopulationScaler(Estimator, _Scale, DefaultParamsReadable, DefaultParamsWritable):
    """Z-scores with the population deviation; a constant column becomes zero.

    Fitted by one aggregate over all columns, applied as plain column arithmetic.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        cols = self.getInputCols()
        row = dataset.agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
        model = PopulationScalerModel()
        model._set(inputCols=cols, outputCols=self.getOutputCols(),
                   means=[float(v or 0.0) for v in row[: len(cols)]], stds=[float(v or 0.0) for v in row[len(cols) :]])
        return model


def scaled_stages(cols: list[str]) -> list:
    """Scaler and assembler in front of a model."""
    names = [f"z_{c}" for c in cols]
    return [PopulationScaler(inputCols=cols, outputCols=names), VectorAssembler(inputCols=names, outputCol="features")]


def f1_of_positives(label: str) -> MulticlassClassificationEvaluator:
    """F1 of class 1; the evaluator's own ``f1`` averages over the classes."""
    return MulticlassClassificationEvaluator(labelCol=label, metricName="fMeasureByLabel", metricLabel=1.0, beta=1.0)


@dataclass
class Search:
    """A finished grid search: the mean score per cell, and the best cell's pipeline, fitted on all rows when it is asked for."""

    avgMetrics: list[float]
    refit: Callable[[], PipelineModel]

    @cached_property
    def bestModel(self) -> PipelineModel:
        return self.refit()


def in_threads(spark: SparkSession, task, items: list) -> list:
    """``task`` of every item, as many jobs at a time as there are cores; the driver only waits for them."""
    run = inheritable_thread_target(spark)(task)
    with ThreadPool(max(1, min(len(items), spark.sparkContext.defaultParallelism))) as pool:
        return pool.map(run, items)


ROWS_PER_TASK = 50_000


def in_few_tasks(df: DataFrame) -> DataFrame:
    """The rows in no more partitions than they fill: iterative fits pay per task and iteration."""
    return df.coalesce(max(1, math.ceil(df.count() / ROWS_PER_TASK)))


def tasks_per_fit(spark: SparkSession, fits: int) -> int:
    """The tasks that each of so many fits needs for all that run side by side to have two tasks per core.

    Every task of a forest's fit hands on the statistics of all nodes, so what is shuffled and added up grows with the tasks.
    """
    cores = spark.sparkContext.defaultParallelism
    return math.ceil(2 * cores / max(1, min(cores, fits)))


def fold_sides(df: DataFrame, prepare: list, label: str, key: str, folds: int) -> list[tuple[DataFrame, DataFrame]]:
    """Training and held-out side of every fold, both prepared by stages fitted on the training side and written once.

    Folds are class-stratified; rows without a label take no part.
    """
    rows = in_few_tasks(materialize(stratified_folds(df.filter(F.col(label).isNotNull()), label, key, folds), "folds"))

    def sides(fold: int) -> tuple[DataFrame, DataFrame]:
        train, held = rows.filter(F.col("fold") != fold), rows.filter(F.col("fold") == fold)
        fitted = Pipeline(stages=prepare).fit(train)
        return materialize(fitted.transform(train), "train"), materialize(fitted.transform(held), "held")

    return in_threads(df.sparkSession, sides, list(range(folds)))


def grid_search(df: DataFrame, prepare: list, estimator, grid: list, label: str, key: str, folds: int, fits=None, score=None, wide: bool = False) -> Search:
    """Cross-validated grid search on seeded, class-stratified folds.

    The rows of a fold are prepared once for all cells; cells and folds run side by side. Where one fit serves several cells, ``fits``
    lists (parameters of the fit, its cells) and ``score`` gives a fitted model's score in each of those cells on the held-out rows. Where
    the state of a fit is ``wide``, as that of many trees, its rows are in no more tasks than keep the cores busy.
    """
    spark = df.sparkSession
    sides = fold_sides(df, prepare, label, key, folds)
    evaluator = f1_of_positives(label)
    fits = fits or [(cell, [i]) for i, cell in enumerate(grid)]
    tasks = tasks_per_fit(spark, len(fits) * folds)
    score = score or (lambda model, held, cells: [evaluator.evaluate(model.transform(held))])

    def one(job: tuple[int, dict, list[int]]) -> list[tuple[int, float]]:
        fold, params, cells = job
        train, held = sides[fold]
        return list(zip(cells, score(estimator.fit(train.coalesce(tasks) if wide else train, params), held, cells)))

    sums = [0.0] * len(grid)
    for found in in_threads(spark, one, [(f, params, cells) for params, cells in fits for f in range(folds)]):
        for cell, value in found:
            sums[cell] += value / folds
    return Search(sums, lambda: refitted(df, prepare, estimator, grid[max(range(len(grid)), key=lambda i: sums[i])], label))


def refitted(df: DataFrame, prepare: list, estimator, cell: dict, label: str) -> PipelineModel:
    """The pipeline of one cell on all labelled rows."""
    labelled = in_few_tasks(df.filter(F.col(label).isNotNull()))
    whole = Pipeline(stages=prepare).fit(labelled)
    final = estimator.fit(materialize(whole.transform(labelled), "whole"), cell)
    return PipelineModel(stages=[*whole.stages, final])


def tree_arrays(model, spark: SparkSession) -> list[dict]:
    """The trees of a fitted tree or forest as arrays, read back from the model's own saved form."""
    path = scratch_path(spark, "tree")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    nodes = data.select("treeID", "nodeData.*") if "treeID" in data.columns else data.withColumn("treeID", F.lit(0))
    split = [F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")]
    table = nodes.select("treeID", "id", "prediction", "impurityStats", "rawCount", "leftChild", "rightChild", *split).toPandas()
    trees = []
    for _, rows in table.sort_values(["treeID", "id"]).groupby("treeID"):
        stats = np.stack(rows["impurityStats"].to_numpy())
        trees.append({
            "left": rows["leftChild"].to_numpy(), "right": rows["rightChild"].to_numpy(), "feature": rows["feature"].to_numpy(),
            "threshold": rows["threshold"].fillna(0.0).to_numpy(), "said": rows["prediction"].to_numpy(),
            "chance": stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300),
            "rows": rows["rawCount"].to_numpy(), "cover": stats.sum(axis=1),
        })
    return trees


def descend(tree: dict, rows: np.ndarray, depths: list[int], least: int = 2) -> dict[int, np.ndarray]:
    """The node that each row has reached after so many splits, or the leaf before.

    Nodes of fewer than ``least`` rows count as leaves: a tree is grown from the root, so this is the tree with that least split.
    """
    at, found = np.zeros(len(rows), np.int64), {}
    for depth in range(max(depths) + 1):
        if depth in depths:
            found[depth] = at
        inner = (tree["left"][at] >= 0) & (tree["rows"][at] >= least)
        if not inner.any():
            return {d: found.get(d, at) for d in depths}
        below = rows[np.arange(len(rows)), np.where(inner, tree["feature"][at], 0)] <= tree["threshold"][at]
        at = np.where(inner, np.where(below, tree["left"][at], tree["right"][at]), at)
    return found


def _f1_of_variants(held: DataFrame, label: str, said) -> list[float]:
    """F1 of class 1 for each row of the matrix of predictions that ``said`` makes from the features."""

    def count(batches):
        for batch in batches:
            if len(batch):
                y = batch["y"].to_numpy() == 1
                for i, p in enumerate(said(np.stack(batch["x"].to_numpy()))):
                    yield pd.DataFrame({"i": [i], "both": [int((p & y).sum())], "either": [int(p.sum() + y.sum())]})

    rows = held.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"))
    sums = rows.mapInPandas(count, "i int, both long, either long").groupBy("i").agg(F.sum("both"), F.sum("either")).orderBy("i").collect()
    return [2.0 * r[1] / r[2] if r[2] else 0.0 for r in sums]


def grid_table(df: DataFrame, fitted, grid: list) -> DataFrame:
    """(cell, params, f1, is_best) of a grid search; one row per cell."""
    best = max(range(len(grid)), key=lambda i: fitted.avgMetrics[i])
    rows = []
    for i, (cell, score) in enumerate(zip(grid, fitted.avgMetrics)):
        named = {p.name: v for p, v in cell.items()}
        rows.append((i, json.dumps(named, sort_keys=True), float(score), i == best))
    return df.sparkSession.createDataFrame(rows, "cell int, params string, f1 double, is_best boolean")


# The default grids.
LR_C = [0.01, 0.1, 1.0, 10.0, 100.0]
LR_PENALTY = {"l1": 1.0, "l2": 0.0}
TREE_DEPTH = [3, 5, 7, 10, 30]  # 30 is the deepest Spark grows, standing in for no limit
TREE_SPLIT = [2, 5, 10]
TREE_LEAF = [1, 2, 4]
FOREST_TREES = [100, 150, 200]
FOREST_DEPTH = [8, 10, 12]
FOREST_SPLIT = [2, 5]
FOREST_LEAF = [1, 2]
FOREST_FEATURES = ["sqrt", "log2"]
SVM_C = [0.1, 1.0, 10.0]
HIDDEN = [64, 32]


def logistic_regression_cv(
    df: DataFrame, cols: list[str], label: str, key: str, folds: int = 5, cs=LR_C, penalties=tuple(LR_PENALTY),
    iterations: int = 1000,
):
    """Scaled logistic regression with balanced weights. Returns (search, grid).

    With balanced weights the weights sum to the row count, so a strength C corresponds to a
    penalty of 1 / (C n) on the mean loss. All cells and folds are fitted together, one job per iteration.
    """
    weighted = add_class_weight(df, label)
    n = df.count()
    model = LogisticRegression(labelCol=label, weightCol="weight", maxIter=iterations, standardization=False)
    # Penalty and strength are one axis each; the grid crosses them.
    grid = (
        ParamGridBuilder().addGrid(model.regParam, [1.0 / (c * n) for c in cs])
        .addGrid(model.elasticNetParam, [LR_PENALTY[p] for p in penalties]).build()
    )
    folded = in_few_tasks(stratified_folds(weighted.filter(F.col(label).isNotNull()), label, key, folds))
    rows = batched.written_rows(folded, cols, label, "weight")
    fits = [batched.Fit(cell[model.regParam], cell[model.elasticNetParam], fold) for cell in grid for fold in range(folds)]
    scores = batched.held_out_f1(rows, cols, batched.fit_logistics(rows, cols, fits), fits)
    means = [sum(scores[i * folds : (i + 1) * folds]) / folds for i in range(len(grid))]
    best = grid[max(range(len(grid)), key=lambda i: means[i])]
    return Search(means, lambda: refitted(weighted, scaled_stages(cols), model, best, label)), grid


def least_split(estimator) -> Param:
    """The grid axis for the least rows of a node that is split. Spark has no such parameter; grown trees are cut by it."""
    return Param(estimator, "minRowsPerSplit", "least rows of a node that is split")


def decision_tree_cv(df, cols, label, key, folds=5, depths=TREE_DEPTH, splits=TREE_SPLIT, leaves=TREE_LEAF):
    """A tree splits greedily from the root, so one cut at depth m, or at nodes of few rows, is the one grown so: each leaf size
    is fitted once per fold, to the largest depth, and its cuts are scored."""
    weighted = add_class_weight(df, label)
    model = DecisionTreeClassifier(labelCol=label, weightCol="weight", seed=42, maxBins=64)
    split = least_split(model)
    grid = ParamGridBuilder().addGrid(model.minInstancesPerNode, leaves).addGrid(split, splits).addGrid(model.maxDepth, depths).build()
    fits = [({model.minInstancesPerNode: leaf, model.maxDepth: max(depths)},
             [i for i, c in enumerate(grid) if c[model.minInstancesPerNode] == leaf]) for leaf in leaves]

    def score(fitted, held, cells):
        tree, wanted = tree_arrays(fitted, held.sparkSession)[0], [(grid[i][split], grid[i][model.maxDepth]) for i in cells]

        def said(rows):
            reached = {least: descend(tree, rows, depths, least) for least in splits}
            return [tree["said"][reached[least][d]] == 1 for least, d in wanted]

        return _f1_of_variants(held, label, said)

    return grid_search(weighted, scaled_stages(cols), model, grid, label, key, folds, fits, score), grid


def subset_size(strategy: str, features: int) -> int:
    """How many features a node of a forest may choose from."""
    return math.ceil(math.sqrt(features)) if strategy == "sqrt" else max(1, math.ceil(math.log2(features)))


def random_forest_cv(
    df, cols, label, key, folds=3, trees=FOREST_TREES, depths=FOREST_DEPTH, splits=FOREST_SPLIT, leaves=FOREST_LEAF, subsets=FOREST_FEATURES
):
    """One forest per fold, leaf size and number of features to choose from, of the most trees and the largest depth.

    The trees of a forest are drawn one by one, so the first of a larger forest are a forest of their own; cut at a depth, or at nodes of few
    rows, they are trees grown so. They are other draws than separate fits would make. Strategies that give the same number of
    features share their fits.
    """
    weighted = add_class_weight(df, label)
    model = RandomForestClassifier(labelCol=label, weightCol="weight", seed=42)
    split, params = least_split(model), [model.minInstancesPerNode, model.featureSubsetStrategy]
    builder = ParamGridBuilder()
    for param, values in zip([model.maxDepth, split, *params, model.numTrees], [depths, splits, leaves, subsets, trees]):
        builder = builder.addGrid(param, values)
    grid, shared = builder.build(), {}
    for i, cell in enumerate(grid):
        shared.setdefault((cell[params[0]], subset_size(cell[params[1]], len(cols))), []).append(i)
    most = {model.maxDepth: max(depths), model.numTrees: max(trees)}
    fits = [({**most, params[0]: leaf, params[1]: str(size)}, cells) for (leaf, size), cells in shared.items()]

    def score(fitted, held, cells):
        grown = tree_arrays(fitted, held.sparkSession)
        wanted = [(grid[i][model.numTrees], grid[i][split], grid[i][model.maxDepth]) for i in cells]

        def said(rows):
            chance, found = {}, {}
            for n, tree in enumerate(grown, 1):
                for least in splits:
                    for depth, at in descend(tree, rows, depths, least).items():
                        chance[least, depth] = chance.get((least, depth), 0.0) + tree["chance"][at]
                if n in trees:
                    found.update({(n, *cut): total.argmax(axis=1) == 1 for cut, total in chance.items()})
            return [found[w] for w in wanted]

        return _f1_of_variants(held, label, said)

    search = grid_search(weighted, scaled_stages(cols), model, grid, label, key, folds, fits, score, wide=True)
    best = grid[max(range(len(grid)), key=lambda i: search.avgMetrics[i])]
    plain = {p: v for p, v in best.items() if p is not split}
    return Search(search.avgMetrics, lambda: refitted(weighted, scaled_stages(cols), model, plain, label)), grid


def mlp(cols: list[str], label: str, hidden=tuple(HIDDEN), iterations: int = 200) -> Pipeline:
    """Scaled network of rectifier layers that stops early."""
    return Pipeline(stages=[*scaled_stages(cols), RectifierNetwork(labelCol=label, hidden=list(hidden), maxIter=iterations)])


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random cosine features whose dot product approximates exp(-gamma |x - y|^2)."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the directions", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, gamma=1.0, size=256, seed=42):
        super().__init__()
        self._setDefault(gamma=1.0, size=256, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, size, seed = (self.getOrDefault(p) for p in (self.gamma, self.size, self.seed))

        @F.pandas_udf("array<double>")
        def expand(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            rows = np.stack(vectors.to_numpy())
            draw = np.random.default_rng(seed)  # same directions in every task
            directions = draw.normal(scale=math.sqrt(2.0 * gamma), size=(rows.shape[1], size))
            shift = draw.uniform(0.0, 2.0 * math.pi, size=size)
            return pd.Series(list(math.sqrt(2.0 / size) * np.cos(rows @ directions + shift)))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(expand(vector_to_array(self.getInputCol()))))


def kernel_svm_cv(
    df, cols, label, key, folds=3, cs=SVM_C, kernels=("rbf", "poly"), size=256, degree=3, iterations=100, gammas=("scale",)
):
    """Support vector machine on the true kernel through ``size`` landmarks of each fold's training rows, C by gamma by kernel grid.

    Columns are z-scored by each fold's own rows. gamma "auto" is one over the number of columns, "scale" also over their variance: on z-scores
    both are the same unless a column is constant, so one of them is the default. A number is taken as it is. All cells, folds and
    kernels are fitted together. Returns the best kernel and (search, grid) by kernel.
    """
    weighted = add_class_weight(df, label)
    folded = in_few_tasks(stratified_folds(weighted.filter(F.col(label).isNotNull()), label, key, folds))
    x = F.array(*[F.col(c).cast("double") for c in cols])
    rows = materialize(folded.select(*[F.col(c).cast("double").alias(c) for c in cols], x.alias("x"), F.col(label).alias("y"), F.col("weight").alias("w"), "fold"), "machines")
    moments, blocks = batched.fold_moments(rows, cols), machines.written_blocks(rows)
    marks, seen = machines.drawn_rows(rows, size * 2)
    estimator = machines.VectorMachine(labelCol=label, weightCol="weight", degree=degree, size=size, maxIter=iterations)
    width, searches = Param(estimator, "gamma", "kernel width, a number or a rule"), {}

    def space(fold: int, kernel: str, gamma) -> machines.Space:
        means, stds = batched.scaling(moments, fold)
        mine = marks[[bool(found - {fold}) for found in seen]][:size]
        return machines.landmark_space(mine, kernel, _gamma(gamma, moments, fold, len(cols)), degree, means, stds)

    grid = ParamGridBuilder().addGrid(estimator.c, cs).addGrid(width, list(gammas)).build()
    value = lambda cell, fold: _gamma(cell[width], moments, fold, len(cols))
    # Cells of equal width share their fits, and all fits their jobs.
    wanted = list(dict.fromkeys((kernel, fold, value(cell, fold), cell[estimator.c]) for kernel in kernels for cell in grid for fold in range(folds)))
    spaces = {(kernel, fold, gamma): space(fold, kernel, gamma) for kernel, fold, gamma, _ in wanted}
    places = {known: i for i, known in enumerate(spaces)}
    fits = [machines.Machine(c, places[kernel, fold, gamma], fold) for kernel, fold, gamma, c in wanted]
    fitted = machines.fit_machines(blocks, list(spaces.values()), fits, iterations)
    found = dict(zip(wanted, machines.held_out_f1(blocks, list(spaces.values()), fits, fitted)))
    for kernel in kernels:
        means = [sum(found[kernel, fold, value(cell, fold), cell[estimator.c]] for fold in range(folds)) / folds for cell in grid]
        best = grid[max(range(len(grid)), key=lambda i: means[i])]
        params = {estimator.kernel: kernel, estimator.c: best[estimator.c], estimator.gamma: value(best, batched.NO_FOLD)}
        searches[kernel] = (Search(means, lambda params=params: refitted(weighted, scaled_stages(cols), estimator, params, label)), grid)
    best = max(searches, key=lambda kernel: max(searches[kernel][0].avgMetrics))
    return best, searches


def _gamma(gamma, moments: dict, fold: int, columns: int) -> float:
    """The kernel width on z-scores of the rows outside ``fold``: their variance is the share of columns that are not constant."""
    if gamma not in ("auto", "scale"):
        return float(gamma)
    varied = sum(bool(s) for s in batched.spread(moments, fold)) if gamma == "scale" else columns
    return 1.0 / max(1, varied)


def calibrated(scored: DataFrame, df: DataFrame, prepare: list, machine, label: str, key: str, folds: int = 5) -> DataFrame:
    """Turn the margins of ``scored`` into probabilities in column ``score``.

    The logistic curve is fitted on margins of rows that the machine giving them was not fitted on: each fold is scored by
    a machine fitted on the others.
    """
    sides = fold_sides(df, prepare, label, key, folds)
    margin = lambda rows: rows.withColumn("margin", vector_to_array("rawPrediction")[1])
    held = in_threads(df.sparkSession, lambda side: margin(machine.fit(side[0]).transform(side[1])).select("margin", label), sides)
    curve = Pipeline(stages=[VectorAssembler(inputCols=["margin"], outputCol="margin_vec"), LogisticRegression(
        featuresCol="margin_vec", labelCol=label, rawPredictionCol="cal_raw", probabilityCol="cal_prob", predictionCol="cal_pred")])
    out = curve.fit(materialize(reduce(DataFrame.unionByName, held), "margins")).transform(margin(scored))
    return out.withColumn("score", vector_to_array("cal_prob")[1]).drop("margin", "margin_vec", "cal_raw", "cal_prob", "cal_pred")


def linear_svm_multiclass(features: str, label: str, n: int, c: float = 1.0, iterations: int = 50) -> OneVsRest:
    """One linear machine per class against the rest."""
    return OneVsRest(classifier=LinearSVC(featuresCol=features, labelCol=label, regParam=1.0 / (c * n), maxIter=iterations),
                     featuresCol=features, labelCol=label)


def kmeans_best(df: DataFrame, features: str, k: int = 2, starts: int = 10, iterations: int = 300):
    """The clustering with the lowest cost out of several seeded starts, all of which move in the same jobs."""
    return kmeans_starts(df, features, k, starts, iterations)[0]


def mean_centroids(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """(cluster, center): element-wise means, summed as whole vectors in the tasks. Null vectors take no part."""
    rows = df.filter(F.col(vec).isNotNull()).select(cluster, array_to_vector(as_double(vec)).alias("_v"))
    return rows.groupBy(cluster).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("center"))


MOST_CENTERS = 10_000


def nearest_centroid(df: DataFrame, vec: str, centroids: DataFrame, cluster: str, name: str, most: int = MOST_CENTERS) -> DataFrame:
    """Add the cluster of the nearest centre, the smallest cluster on ties; null for a null vector.

    Up to ``most`` centres travel as one value. Beyond that the centres are searched like any other table of vectors; the
    clusters must then be whole numbers.
    """
    known = materialize(centroids.select(F.col(cluster).alias("_c"), F.col("center").alias("_m")), "centers")
    if known.limit(most + 1).count() > most:
        return _searched_centroid(df, vec, known, name)
    centers = known.agg(F.collect_list(F.struct(F.col("_c").alias("c"), F.col("_m").alias("m"))).alias("cs"))
    held = df.withColumn("_cs", centers.scalar())
    ranked = F.transform("_cs", lambda s: F.struct(F.round(euclidean(as_double(vec), s["m"]), 6).alias("d"), s["c"].alias("c")))
    return held.withColumn(name, F.when(F.col(vec).isNotNull(), F.array_min(ranked)["c"])).drop("_cs")


def _searched_centroid(df: DataFrame, vec: str, known: DataFrame, name: str) -> DataFrame:
    from cohortwise.operators.neighbors import knn_join

    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    queries = rows.filter(F.col(vec).isNotNull()).select(F.col("_row").alias("id"), F.col(vec).alias("v"))
    found = knn_join(queries, known.select(F.col("_c").alias("id"), F.col("_m").alias("v")), "id", "v", 1)
    near = found.select(F.col("query_id").alias("_row"), F.col("neighbor_id").cast(known.schema["_c"].dataType).alias(name))
    return rows.join(near, "_row", "left").drop("_row")


def cluster_classes(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, prediction): majority class of each cluster."""
    return group_mode(df, cluster, label, "prediction")


class _ClusterToClass(HasLabelCol, HasPredictionCol):
    clusterCol = Param(Params._dummy(), "clusterCol", "column with the cluster", TypeConverters.toString)
    clusters = Param(Params._dummy(), "clusters", "known clusters", TypeConverters.toListInt)
    classes = Param(Params._dummy(), "classes", "class of each known cluster", TypeConverters.toListInt)


class ClusterToClassModel(Model, _ClusterToClass, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the majority class of the row's cluster, null for a cluster not seen in training."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        known = zip(self.getOrDefault(self.clusters), self.getOrDefault(self.classes))
        pairs = [F.lit(x).cast("bigint") for pair in known for x in pair]
        empty = F.create_map().cast("map<bigint,bigint>")
        mapping = F.create_map(*pairs) if pairs else empty
        found = F.try_element_at(mapping, F.col(self.getOrDefault(self.clusterCol)).cast("bigint"))
        return dataset.withColumn(self.getPredictionCol(), found.cast("int"))


class ClusterToClass(Estimator, _ClusterToClass, DefaultParamsReadable, DefaultParamsWritable):
    """Names every cluster by the majority label of its rows, the smallest label on ties; one pair per cluster is kept."""

    @keyword_only
    def __init__(self, *, clusterCol="cluster", labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._setDefault(clusterCol="cluster", labelCol="label", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ClusterToClassModel:
        cluster, label = self.getOrDefault(self.clusterCol), self.getLabelCol()
        seen = dataset.filter(F.col(cluster).isNotNull() & F.col(label).isNotNull())
        pairs = cluster_classes(seen, cluster, label).orderBy(cluster).collect()
        model = ClusterToClassModel()
        model._set(clusterCol=cluster, labelCol=label, predictionCol=self.getPredictionCol(),
                   clusters=[int(r[cluster]) for r in pairs], classes=[int(r["prediction"]) for r in pairs])
        return model


def cluster_profile(df: DataFrame, cluster: str, cols: list[str], label: str) -> DataFrame:
    """Feature means in original units and the share of positives, per cluster."""
    return group_means(df, cluster, cols).join(group_positive_rate(df, cluster, label), cluster)


def cluster_importance(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """Spread of the scaled cluster centres per feature."""
    scaled = PopulationScaler(inputCols=cols, outputCols=cols).fit(df).transform(df)
    return between_group_spread(group_means(scaled, cluster, cols), cluster, cols)


def silhouette_squared(df: DataFrame, vec: str, cluster: str) -> DataFrame:
    """Mean silhouette under squared Euclidean distance, in time linear in the rows.

    The mean squared distance to a cluster needs only its size, sum vector and sum of squares.
    """
    rows = df.select(F.col(cluster).alias("c"), as_double(vec).alias("v"))
    sizes = rows.groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("q")
    )
    known = mean_centroids(rows, "v", "c").join(sizes, "c")
    packed = known.agg(F.collect_list(F.struct("c", "n", "q", F.col("center").alias("m"))).alias("cs")).scalar()
    own_sq = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    gap = lambda s: F.greatest(
        F.lit(0.0),
        own_sq + s["q"] - 2.0 * F.aggregate(F.zip_with("v", s["m"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x),
    )
    held = rows.withColumn("cs", packed).withColumn("sq", own_sq)
    inside = F.filter("cs", lambda s: s["c"] == F.col("c"))
    outside = F.filter("cs", lambda s: s["c"] != F.col("c"))
    scored = held.select(
        F.get(inside, F.lit(0))["n"].alias("n"),
        (gap(F.get(inside, F.lit(0))) * F.get(inside, F.lit(0))["n"] / F.greatest(F.get(inside, F.lit(0))["n"] - 1, F.lit(1))).alias("a"),
        F.array_min(F.transform(outside, gap)).alias("b"),
    )
    value = F.when(F.col("n") < 2, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-300)))
    return scored.agg(F.avg(value).alias("silhouette"))


def tree_nodes(model, names: list[str]) -> DataFrame:
    """Nodes of a fitted tree as a table, read back from the model's own saved form."""
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "tree")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    named = F.array(*[F.lit(n) for n in names])
    leaf = F.col("leftChild") < 0
    return nodes.select(
        F.col("id").alias("node_id"), F.when(~leaf, F.col("leftChild")).alias("left"),
        F.when(~leaf, F.col("rightChild")).alias("right"),
        F.when(~leaf, F.get(named, F.col("split.featureIndex"))).alias("feature"),
        F.when(~leaf, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        "impurity", F.col("rawCount").alias("n"), F.col("impurityStats").alias("class_weights"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
