"""Queries without an SQL text are held to what must be true of their rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.plans import QUERIES, data
from cohortwise.plans.registry import ORACLES


def test_every_query_is_checked():
    unchecked = set(QUERIES) - set(ORACLES)
    assert unchecked == {
        "sampled_shapley", "logistic_regression_cv", "decision_tree_cv", "random_forest_cv",
        "kernel_svm", "grid_search_table", "mlp_classifier", "kmeans_cluster", "trained_model_comparison",
        "svm_probabilities", "tree_nodes", "pca_project", "pca_explained_variance",
        "fisher_lda_project", "subspace_scatter", "dimension_sweep", "linear_svm_multiclass", "self_training",
        "label_budget_sweep",
    }


def run(name, spark, folder):
    return QUERIES[name](spark, folder)


def test_shapley_adds_up(spark, folder):
    rows = run("sampled_shapley", spark, folder).collect()
    by_row = {}
    for r in rows:
        by_row.setdefault(r["doc_id"], []).append(r)
    assert len(by_row) == spark.read.parquet(f"{folder}/labels.parquet").count() and all(len(v) == len(data.TEXT_FEATURES) for v in by_row.values())
    for parts in by_row.values():
        assert np.isclose(sum(p["attribution"] for p in parts), parts[0]["score"] - parts[0]["base"])


def test_prepared_data_is_balanced_and_scaled(spark, folder):
    rows = run("prepare_model_data", spark, folder).filter("split = 'train'")
    counts = [r["count"] for r in rows.groupBy("label").count().collect()]
    assert len(set(counts)) == 1
    row = rows.agg(*[F.avg(c) for c in data.TEXT_FEATURES], *[F.stddev_pop(c) for c in data.TEXT_FEATURES]).first()
    d = len(data.TEXT_FEATURES)
    assert np.allclose(row[:d], 0, atol=1e-6) and all(np.isclose(s, 1) or np.isclose(s, 0) for s in row[d:])


@pytest.mark.parametrize("name", ["logistic_regression_cv", "decision_tree_cv", "random_forest_cv"])
def test_grids(spark, folder, name):
    rows = run(name, spark, folder).collect()
    assert sum(r["is_best"] for r in rows) == 1
    assert max(r["f1"] for r in rows) == next(r["f1"] for r in rows if r["is_best"])
    assert all(0 <= r["f1"] <= 1 for r in rows)


def test_tree_has_one_edge_less_than_nodes(spark, folder):
    rows = run("tree_nodes", spark, folder).collect()
    edges = sum((r["left"] is not None) + (r["right"] is not None) for r in rows)
    assert edges == len(rows) - 1
    assert all((r["feature"] is None) == (r["left"] is None) for r in rows)


def test_perceptron_and_comparison(spark, folder):
    scored = run("mlp_classifier", spark, folder).collect()
    assert scored and all(0 <= r["score"] <= 1 and r["prediction"] in (0, 1) for r in scored)
    table = {r["model"]: r for r in run("trained_model_comparison", spark, folder).collect()}
    assert set(table) == {"LogisticRegression", "DecisionTree", "RandomForest", "SVM", "NeuralNetwork", "KMeans"}
    assert table["KMeans"]["ROC AUC"] is None and all(0 <= r["Accuracy"] <= 1 for r in table.values())


def test_kernel_grids_and_best_cells(spark, folder):
    rows = run("kernel_svm", spark, folder).collect()
    assert {r["kernel"] for r in rows} == {"rbf", "poly"} and len(rows) == 6
    top = max(rows, key=lambda r: r["f1"])
    assert top["f1"] == max(r["f1"] for r in rows if r["kernel"] == top["best_kernel"])
    assert all(sum(r["is_best"] for r in rows if r["kernel"] == k) == 1 for k in ("rbf", "poly"))


def test_projections_keep_their_rows(spark, folder):
    n = spark.read.parquet(f"{folder}/embeddings.parquet").count()
    for name, axes in (("pca_project", 8), ("fisher_lda_project", 9)):
        assert run(name, spark, folder).count() == n * axes
    assert run("subspace_scatter", spark, folder).count() == 2 * n


def test_clusters_and_probabilities(spark, folder):
    clustered = run("kmeans_cluster", spark, folder).collect()
    assert {r["cluster"] for r in clustered} <= {0, 1} and clustered
    scored = run("svm_probabilities", spark, folder).collect()
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_explained_variance_descends(spark, folder):
    rows = sorted(run("pca_explained_variance", spark, folder).collect(), key=lambda r: r["axis"])
    assert all(a["variance"] >= b["variance"] - 1e-12 for a, b in zip(rows, rows[1:]))
    assert np.isclose(sum(r["share"] for r in rows), 1)


def test_self_training_grows(spark, folder):
    rows = sorted(run("self_training", spark, folder).collect())
    assert rows[0]["n_labeled"] == 40
    assert all(r["n_labeled"] >= 40 and 0 <= r["accuracy"] <= 1 for r in rows)


def test_linear_svm_on_separable_classes(spark, folder):
    """The given labels do not follow from the vectors, so accuracy is held on made-up clusters."""
    from pyspark.ml.functions import array_to_vector

    from cohortwise.operators.models import linear_svm_multiclass

    assert {r["prediction"] for r in run("linear_svm_multiclass", spark, folder).collect()} <= set(range(10))
    rng = np.random.default_rng(0)
    middles = [(0, 0), (6, 0), (0, 6)]
    rows = [(i % 3, [float(x) for x in rng.normal(size=2) + middles[i % 3]]) for i in range(150)]
    df = spark.createDataFrame(rows, "label int, v array<double>").coalesce(1).withColumn("f", array_to_vector("v"))
    said = linear_svm_multiclass("f", "label", 150, iterations=8).fit(df).transform(df)
    assert said.filter("label = prediction").count() > 140


def test_kernel_machine_on_a_ring(spark):
    """A ring around a disc has no linear border; the kernel features find one."""
    from cohortwise.operators.models import kernel_svm_cv

    rng = np.random.default_rng(1)
    angle, label = rng.uniform(0, 6.28, 240), np.arange(240) % 2
    radius = np.where(label == 1, 0.4, 2.0) + rng.normal(scale=0.1, size=240)
    rows = [(i, float(r * np.cos(a)), float(r * np.sin(a)), int(y)) for i, (r, a, y) in enumerate(zip(radius, angle, label))]
    df = spark.createDataFrame(rows, "id int, a double, b double, label int").coalesce(1)
    _, searches = kernel_svm_cv(df, ["a", "b"], "label", "id", folds=2, cs=[10.0], size=64, degree=2, iterations=8)
    assert all(max(search.avgMetrics) > 0.9 for search, _ in searches.values())


def test_self_training_learns_from_its_own_labels(spark):
    from cohortwise.operators.semisup import self_training

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=2) + (5 * (i % 2), 0)], i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y int").coalesce(1)
    out = sorted(self_training(df.filter("id < 6"), df.filter("id >= 6 and id < 150"), df.filter("id >= 150"), "id", "v", "y").collect())
    assert out[0]["n_labeled"] == 6 and out[-1]["n_labeled"] > 60 and out[-1]["accuracy"] > 0.95


def test_sweep_stops_at_classes_less_one(spark, folder):
    from cohortwise.plans.vectors import dimension_sweep

    rows = dimension_sweep(spark, folder, dims=(2, 16)).collect()
    assert len(rows) == 8
    assert all((r["accuracy"] is None) == (r["reducer"] == "lda" and r["dim"] > 9) for r in rows)
