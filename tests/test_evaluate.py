import numpy as np
import pytest

from cohortwise.operators import evaluate, explain

# Published metrics (accuracy, precision, recall, F1, ROC AUC) and confusion
# counts (true negatives, false positives, false negatives, true positives) of six models.
PUBLISHED = {
    "RandomForest": ((0.9045577259012229, 0.9591497841248755, 0.8579916815210933, 0.9057550572369454, 0.9602291605723481), (2808, 123, 478, 2888)),
    "LogisticRegression": ((0.8774019374305224, 0.8923169993950393, 0.8764111705288176, 0.8842925659472421, 0.9479461563271547), (2575, 356, 416, 2950)),
    "KMeans": ((0.6861997776719072, 0.639, 0.9491978609625669, 0.763805880946689, None), (1126, 1805, 171, 3195)),
    "SVM": ((0.900746387168493, 0.9471451876019575, 0.8624480095068331, 0.9028144923029078, 0.9542022975251948), (2769, 162, 463, 2903)),
    "NeuralNetwork": ((0.9034460854375099, 0.9405750798722045, 0.8746286393345217, 0.9064039408866996, 0.9595944391838183), (2745, 186, 422, 2944)),
    "DecisionTree": ((0.896141019533111, 0.9587280108254398, 0.8419489007724302, 0.8965517241379312, 0.9480715396483956), (2809, 122, 532, 2834)),
}


def cells(spark, counts):
    from pyspark.sql import functions as F

    tn, fp, fn, tp = counts
    grid = [(0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp)]
    df = spark.createDataFrame([g for g in grid if g[2]], "label int, prediction int, n int")
    return df.select("label", "prediction", F.explode(F.sequence(F.lit(1), "n")))


@pytest.mark.parametrize("model", PUBLISHED)
def test_published_metrics_from_counts(spark, model):
    values, counts = PUBLISHED[model]
    got = {r["metric"]: r["value"] for r in evaluate.binary_metrics(cells(spark, counts), "label", "prediction").collect()}
    assert np.allclose([got[m] for m in ("Accuracy", "Precision", "Recall", "F1")], values[:4])


def long_metrics(spark):
    rows = [(m, n, v) for m, (values, _) in PUBLISHED.items() for n, v in zip(evaluate.METRICS, values) if v is not None]
    return spark.createDataFrame(rows, "model string, metric string, value double")


def test_published_comparison(spark):
    metrics = long_metrics(spark)
    assert metrics.count() == 29
    best = {r["metric"]: (r["model"], round(r["value"], 4)) for r in evaluate.best_per_metric(metrics).collect()}
    assert best == {
        "Accuracy": ("RandomForest", 0.9046), "Precision": ("RandomForest", 0.9591), "Recall": ("KMeans", 0.9492),
        "F1": ("NeuralNetwork", 0.9064), "ROC AUC": ("RandomForest", 0.9602),
    }
    overall = {r["model"]: r["overall"] for r in evaluate.overall_score(metrics).collect()}
    assert max(overall, key=overall.get) == "RandomForest" and round(overall["RandomForest"], 4) == 0.9175
    wide = {r["model"]: r for r in evaluate.long_to_wide(metrics).collect()}
    assert wide["KMeans"]["ROC AUC"] is None


def test_published_report(spark):
    lines = [r["line"] for r in evaluate.comparison_report(long_metrics(spark)).orderBy("line_no").collect()]
    assert "KMeans | 0.6862 | 0.6390 | 0.9492 | 0.7638 | -" in lines
    assert "F1: NeuralNetwork (0.9064)" in lines
    assert lines[-1] == "best overall: RandomForest (mean score: 0.9175)"


def test_confusion_keeps_zero_cells(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, p int")
    got = {(r["y"], r["p"]): r["n"] for r in evaluate.confusion_matrix(df, "y", "p").collect()}
    assert got == {(0, 0): 1, (1, 0): 1, (0, 1): 0, (1, 1): 0}


def test_undefined_metrics_are_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    got = {r["metric"]: r["value"] for r in evaluate.binary_metrics(df, "y", "p").collect()}
    assert got == {"Accuracy": 0.5, "Precision": 0.0, "Recall": 0.0, "F1": 0.0}


def test_published_report_averages(spark):
    _, counts = PUBLISHED["DecisionTree"]
    report = {r["name"]: r for r in evaluate.classification_report(cells(spark, counts), "label", "prediction").collect()}
    assert [round(report["0"][m], 2) for m in ("precision", "recall", "f1")] == [0.84, 0.96, 0.90]
    assert [round(report["1"][m], 2) for m in ("precision", "recall", "f1")] == [0.96, 0.84, 0.90]
    assert report["accuracy"]["f1"] == pytest.approx(0.896141019533111) and report["macro avg"]["support"] == 6297


def test_auc_with_ties_matches_pair_count(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.random() < 0.4), float(rng.integers(0, 6)), "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "y int, s double, g string")

    def pairs(sub):
        pos, neg = [s for y, s, _ in sub if y], [s for y, s, _ in sub if not y]
        return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])

    assert evaluate.roc_auc(df, "y", "s").first()[0] == pytest.approx(pairs(rows))
    for r in evaluate.roc_auc(df, "y", "s", by=("g",)).collect():
        assert r["roc_auc"] == pytest.approx(pairs([x for x in rows if x[2] == r["g"]]))


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    assert evaluate.roc_auc(df, "y", "s").first()[0] is None


def test_roc_ends_at_one(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (0, 0.1)], "y int, s double")
    rows = {r["threshold"]: (r["fpr"], r["tpr"]) for r in evaluate.roc_curve(df, "y", "s").collect()}
    assert rows == {0.9: (0.5, 1.0), 0.1: (1.0, 1.0)}


def test_linear_attributions_add_up(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i % 7)) for i in range(20)], "id int, a double, b double")
    weights = {"a": 0.5, "b": -2.0}
    sums = {r[0]: r[1] for r in explain.linear_attribution(df, "id", weights).groupBy("id").sum("attribution").collect()}
    scores = {r["id"]: 0.5 * r["a"] - 2.0 * r["b"] for r in df.collect()}
    middle = np.mean(list(scores.values()))
    assert all(np.isclose(sums[i], scores[i] - middle) for i in scores)
