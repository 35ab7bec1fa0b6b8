"""Exact tree attributions against the definition over all subsets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler

from cohortwise.operators import explain, models

D = 8


def value(tree, row, known, at=0):
    if tree["left"][at] < 0:
        return tree["value"][at]
    sides = [int(tree[s][at]) for s in ("left", "right")]
    if tree["feature"][at] in known:
        return value(tree, row, known, sides[0] if row[int(tree["feature"][at])] <= tree["threshold"][at] else sides[1])
    return sum(tree["cover"][s] / tree["cover"][at] * value(tree, row, known, s) for s in sides)


def plain(tree, row):
    out = []
    for i in range(D):
        others = [j for j in range(D) if j != i]
        subsets = [set(s) for k in range(D) for s in combinations(others, k)]
        out.append(sum(factorial(len(s)) * factorial(D - len(s) - 1) / factorial(D) * (value(tree, row, s | {i}) - value(tree, row, s)) for s in subsets))
    return out


def test_forest_against_all_subsets(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(300, D))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(int)
    cols = [f"f{i}" for i in range(D)]
    rows = spark.createDataFrame([(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))], "id bigint, " + ", ".join(f"{c} double" for c in cols) + ", label int")
    forest = RandomForestClassifier(labelCol="label", numTrees=3, maxDepth=5, seed=2).fit(VectorAssembler(inputCols=cols, outputCol="features").transform(rows))
    trees = [t | {"value": t["chance"][:, 1]} for t in models.tree_arrays(forest, spark)]
    got = {}
    for r in explain.tree_attributions(rows, trees, "id", cols).collect():
        got.setdefault(r["id"], {})[r["feature"]] = r
    assert len(got) == 300
    for i in range(6):
        want = np.mean([plain(t, x[i]) for t in trees], axis=0)
        assert [got[i][c]["attribution"] for c in cols] == pytest.approx(want.tolist(), abs=1e-9)
    for i in range(300):
        score = np.mean([value(t, x[i], set(range(D))) for t in trees])
        first = got[i]["f0"]
        assert first["score"] == pytest.approx(score, abs=1e-9)
        assert sum(r["attribution"] for r in got[i].values()) == pytest.approx(score - first["base"], abs=1e-9)
    assert explain.tree_attributions(rows.limit(0), trees, "id", cols).count() == 0


def test_tree_of_one_leaf():
    paths = explain.tree_paths({"left": [-1], "right": [-1], "feature": [0], "threshold": [0.0], "cover": [5.0], "value": [0.25]})
    parts, base = explain.path_attributions(np.ones((2, 3)), paths)
    assert base == 0.25 and not parts.any()
