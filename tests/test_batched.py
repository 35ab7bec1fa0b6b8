"""Logistic fits in one pass against separate fits, and trees cut by the rows of their nodes."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cohortwise.operators import batched, models

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(600, 3)) * [1.0, 50.0, 0.01] + [0.0, 1_000.0, 5.0]
    margin = 1.5 * x[:, 0] - 0.03 * (x[:, 1] - 1_000) + 60 * (x[:, 2] - 5) + draw.normal(size=600)
    rows = [(i, *map(float, r), int(m > 0.4), 0.5 + i % 3, i % 4) for i, (r, m) in enumerate(zip(x, margin))]
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, label int, weight double, fold int").repartition(3)


def test_fits_equal_separate_ones(frame):
    rows = batched.written_rows(frame, COLS, "label", "weight")
    fits = [batched.Fit(penalty, mix, fold) for penalty in (1e-4, 1e-2, 0.1) for mix in (0.0, 0.5, 1.0) for fold in (0, 3, batched.NO_FOLD)]
    found = batched.fit_logistics(rows, COLS, fits)
    for i, fit in enumerate(fits):
        part = frame.filter(F.col("fold") != fit.held_out)
        scaled = models.PopulationScaler(inputCols=COLS, outputCols=[f"z_{c}" for c in COLS]).fit(part).transform(part)
        scaled = VectorAssembler(inputCols=[f"z_{c}" for c in COLS], outputCol="features").transform(scaled)
        alone = LogisticRegression(labelCol="label", weightCol="weight", regParam=fit.penalty, elasticNetParam=fit.mix, standardization=False,
                                   maxIter=2_000, tol=1e-12).fit(scaled)
        assert np.allclose(found.weights[i], alone.coefficients.toArray(), atol=1e-4), fit
        assert abs(found.intercepts[i] - alone.intercept) < 1e-4, fit
    assert (found.weights[[f.mix == 1.0 and f.penalty == 0.1 for f in fits]] == 0).any()  # the l1 part sets coefficients to zero
    assert found.iterations < 40


def test_held_out_score(frame):
    rows = batched.written_rows(frame, COLS, "label", "weight")
    fits = [batched.Fit(1e-3, 0.0, fold) for fold in range(4)]
    found = batched.fit_logistics(rows, COLS, fits)
    got, raw = batched.held_out_f1(rows, COLS, found, fits), found.raw()
    table = frame.toPandas()
    for fold in range(4):
        held = table[table.fold == fold]
        said, y = np.column_stack([held[COLS], np.ones(len(held))]) @ raw[:, fold] > 0, held.label.to_numpy() == 1
        assert got[fold] == pytest.approx(2 * (said & y).sum() / (said.sum() + y.sum()))


def test_constant_column_and_one_class(spark):
    rows = spark.createDataFrame([(float(i), 1.0, 2.0, 1, 1.0, i % 2) for i in range(20)], "a double, b double, c double, label int, weight double, fold int")
    found = batched.fit_logistics(batched.written_rows(rows, COLS, "label", "weight"), COLS, [batched.Fit(0.1, 0.0, 0)], iterations=10)
    assert np.isfinite(found.weights).all() and found.weights[0, 1] == 0 and (found.stds[0, 1:] == 1).all()


def grown(x, y, depth, least, leaf):
    """A tree grown row by row: the split with the least Gini impurity, the first of equals; None where no split is allowed."""
    said = int(2 * y.sum() > len(y))
    if depth == 0 or len(y) < least or len(set(y.tolist())) == 1:
        return said
    impurity = lambda v: len(v) * 2 * v.mean() * (1 - v.mean())
    best = None
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= t
            if min(left.sum(), (~left).sum()) >= leaf:
                gain = impurity(y) - impurity(y[left]) - impurity(y[~left])
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = (gain, j, t)
    if best is None:
        return said
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grown(x[left], y[left], depth - 1, least, leaf), grown(x[~left], y[~left], depth - 1, least, leaf)


def says(tree, row):
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("least", [2, 8, 20])
def test_cut_tree_is_the_tree_with_that_least_split(spark, least):
    from pyspark.ml.classification import DecisionTreeClassifier

    draw = np.random.default_rng(4)
    x = draw.permutation(60)[:, None] * 1.0
    y = ((x[:, 0] // 7).astype(int) % 2) ^ (draw.random(60) < 0.1)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x[:, 0], y)], "a double, label int")
    fitted = DecisionTreeClassifier(labelCol="label", maxDepth=10, maxBins=64, seed=1).fit(VectorAssembler(inputCols=["a"], outputCol="features").transform(rows))
    tree = models.tree_arrays(fitted, spark)[0]
    plain = grown(x, y.astype(int), 10, least, 1)
    reached = models.descend(tree, x, [10], least)[10]
    assert tree["rows"][0] == 60 and np.mean(tree["said"][reached] == [says(plain, r) for r in x]) >= 0.95
    if least > 2:
        assert (tree["rows"][np.unique(reached)] < 60).all() and len(np.unique(reached)) < (tree["left"] < 0).sum()


def test_subset_sizes():
    assert [models.subset_size(s, n) for s in ("sqrt", "log2") for n in (1, 8, 60)] == [1, 3, 8, 1, 3, 6]
