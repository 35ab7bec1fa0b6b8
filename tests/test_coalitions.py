"""Attributions over coalitions against the definition by enumeration."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from cohortwise.operators import explain, machines

COLS = [f"f{j}" for j in range(8)]


def shapley(value, d):
    """The definition: the weighted mean change over all subsets of the other features."""
    out = np.zeros(d)
    for j in range(d):
        others = [i for i in range(d) if i != j]
        for k in range(d):
            weight = factorial(k) * factorial(d - k - 1) / factorial(d)
            out[j] += sum(weight * (value({*s, j}) - value(set(s))) for s in combinations(others, k))
    return out


@pytest.mark.parametrize("d", [1, 2, 3, 6])
def test_all_coalitions_are_the_definition(d):
    draw, known = np.random.default_rng(d), explain.coalitions(d, 100)
    worth = {tuple(row): draw.normal() for row in known[0].tolist()}
    value = lambda s: worth[tuple(int(i in s) for i in range(d))]
    assert np.allclose(known[1] @ [worth[tuple(r)] for r in known[0].tolist()], shapley(value, d))


def test_drawn_coalitions_are_exact_for_sums():
    known, solver = explain.coalitions(20, 400)
    assert len(known) <= 402 and (known[-2] == 0).all() and (known[-1] == 1).all()
    parts = np.random.default_rng(1).normal(size=20)
    assert np.allclose(solver @ (3.0 + known @ parts), parts)
    with pytest.raises(ValueError, match="too few"):
        explain.coalitions(20, 8)


def test_kernel_machine_by_enumeration(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(120, 8))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(int)
    rows = [(i, *map(float, r), r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in COLS) + ", x array<double>, y int").repartition(3)
    model = machines.VectorMachine(featuresCol="x", labelCol="y").fit(df)
    anchors = np.array(model.getOrDefault(model.anchors)).reshape(-1, 8)
    weights = np.array(model.getOrDefault(model.weights))

    class Margins:
        def transform(self, mixed):
            from pyspark.sql import functions as F

            return model.transform(mixed.withColumnRenamed("x", "kept").withColumn("x", F.array(*COLS))).drop("x").withColumnRenamed("kept", "x")

    from pyspark.ml.functions import vector_to_array

    score = lambda said: said.withColumn("_score", vector_to_array("rawPrediction")[1])
    found = explain.kernel_attributions(Margins(), df.filter("id < 3"), df.filter("id >= 115"), "id", COLS, score=score).collect()
    margin = lambda z: -(machines.kernel_values(z, anchors, "rbf", 1 / 8, 3) @ weights[:-1] + weights[-1])

    for i in range(3):
        def value(s):
            mixed = x[115:].copy()
            mixed[:, list(s)] = x[i, list(s)]
            return margin(mixed).mean()

        mine = {r["feature"]: r for r in found if r["id"] == i}
        assert np.allclose([mine[c]["attribution"] for c in COLS], shapley(value, 8), atol=1e-6)
        assert [mine[c]["value"] for c in COLS] == x[i].tolist()
        assert np.isclose(sum(r["attribution"] for r in mine.values()), mine["f0"]["score"] - mine["f0"]["base"])
        assert np.isclose(mine["f0"]["score"], margin(x[i : i + 1])[0]) and np.isclose(mine["f0"]["base"], margin(x[115:]).mean())
    assert explain.kernel_attributions(Margins(), df.filter("id < 0"), df.filter("id >= 115"), "id", COLS, score=score).count() == 0
    with pytest.raises(ValueError, match="background"):
        explain.kernel_attributions(Margins(), df, df.filter("id < 0"), "id", COLS, score=score)


def test_sums_are_taken_without_sorting_the_scored_rows(spark):
    rows = spark.range(50).selectExpr("id", "id * 1.0D AS f0", "id % 7 * 1.0D AS f1")
    score = lambda df: df.selectExpr("*", "2 * f0 - f1 AS _score")
    found = explain.kernel_attributions(_Same(), rows, rows.filter("id < 5"), "id", ["f0", "f1"], score=score)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["id"], r["feature"]): (r["value"], r["attribution"]) for r in found.collect()}
    assert len(got) == 100 and got[9, "f1"][0] == 2.0 and np.isclose(got[9, "f0"][1], 14.0) and np.isclose(got[9, "f1"][1], 0.0)


class _Same:
    def transform(self, df):
        return df
