"""Rebalancing, models, clustering and their tables, on document features and embeddings."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortwise.functions import scalars as S
from cohortwise.functions import vectors as V
from cohortwise.operators import evaluate, machines, models, neighbors, sampling
from cohortwise.operators.clean import drop_leakage
from cohortwise.operators.features import label_encode
from cohortwise.plans import data
from cohortwise.plans.evaluation import CENTROID_SQL
from cohortwise.plans.registry import query, r6, sql_hash, sql_integer, sql_uniform
from cohortwise.session import materialize, scratch_path
from cohortwise.sources.tables import table

FEATURES = data.TEXT_FEATURES


def model_frame(spark, folder):
    """Numeric features and the label of every labelled document, written once for all fits."""
    frame, _ = label_encode(data.document_features(spark, folder), ["lang", "source"])
    return materialize(frame.withColumn("label", F.col("quality")).drop("quality", "toxic"), "frame")


def train_test(spark, folder):
    cut = sampling.stratified_split(model_frame(spark, folder), "label", "doc_id")
    return cut.filter("split = 'train'").drop("split"), cut.filter("split = 'test'").drop("split")


def document_model(spark, folder):
    """A small forest on all text features, and the rows it was fitted on."""
    frame = model_frame(spark, folder)
    forest = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=20, maxDepth=6, seed=42)
    pipeline = Pipeline(stages=[*models.scaled_stages(FEATURES), forest])
    return pipeline.fit(models.add_class_weight(frame, "label")), frame


@query("class_weights", f"""
SELECT quality, n, {r6('(SELECT count(*) FROM labels) / (2.0 * n)')} AS weight FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality)""")
def class_weights(spark, folder):
    return models.class_weights(table(spark, folder, "labels"), "quality").withColumn("weight", S.rounded("weight"))


_VEC = "[" + ", ".join(FEATURES) + "]"

SMOTE_SQL = f"""{data.DOCUMENT_SQL},
pts AS (SELECT doc_id, toxic, {_VEC} AS v FROM feat),
few AS (SELECT * FROM pts WHERE toxic = 1),
size AS (SELECT (SELECT count(*) FROM few) AS f, (SELECT count(*) FROM pts WHERE toxic <> 1) AS m),
near AS (SELECT a.doc_id, b.doc_id AS nid, b.v AS w, row_number() OVER (PARTITION BY a.doc_id ORDER BY round(list_distance(a.v, b.v), 6), b.doc_id) AS rk
  FROM few a, few b WHERE a.doc_id <> b.doc_id),
start AS (SELECT doc_id, v, row_number() OVER (ORDER BY {sql_hash('42start', 'doc_id')}, doc_id) AS pos FROM few),
drawn AS (SELECT doc_id, v, unnest(range(1, (m - f) // f + CASE WHEN pos <= (m - f) % f THEN 1 ELSE 0 END + 1)) AS copy FROM start, size),
pick AS (SELECT *, {sql_integer('42pick', 1, 6, 'doc_id', 'copy')} AS rk, {sql_uniform('42share', 'doc_id', 'copy')} AS u FROM drawn),
allrows AS (SELECT doc_id AS source_id, 0::BIGINT AS copy, toxic::INT AS toxic, v FROM pts
  UNION ALL SELECT p.doc_id, copy, 1, list_transform(range(1, {len(FEATURES) + 1}), lambda i: v[i] + u * (w[i] - v[i])) FROM pick p JOIN near n ON n.doc_id = p.doc_id AND n.rk = p.rk)"""


@query("smote_oversample", f"WITH {SMOTE_SQL} SELECT source_id, copy, toxic, unnest(range({len(FEATURES)})) AS pos, {r6('unnest(v)')} AS value FROM allrows")
def smote_oversample(spark, folder):
    frame = materialize(data.document_features(spark, folder).select("doc_id", "toxic", F.array(*FEATURES).alias("v")), "smote")
    balanced = sampling.smote(frame, "doc_id", "v", "toxic", 1)
    return balanced.select("source_id", "copy", "toxic", F.posexplode("v").alias("p", "x")).select(
        "source_id", "copy", "toxic", F.col("p").cast("bigint").alias("pos"), S.rounded("x").alias("value")
    )


_SPLIT_FRAME_SQL = f"""
lab AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {sql_hash(42, 'doc_id')}) AS rn, count(*) OVER (PARTITION BY quality) AS cnt FROM feat),
cut AS (SELECT doc_id, quality AS label, rn <= ceil(0.2::DOUBLE * cnt) AS test FROM lab)"""

PREPARED_SQL = f"""{data.DOCUMENT_SQL},{_SPLIT_FRAME_SQL},
pts AS (SELECT doc_id, label, test, {_VEC} AS v FROM feat JOIN cut USING (doc_id)),
small AS (SELECT label AS l FROM pts WHERE NOT test GROUP BY label ORDER BY count(*), label LIMIT 1),
few AS (SELECT * FROM pts, small WHERE NOT test AND label = l),
size AS (SELECT (SELECT count(*) FROM few) AS f, (SELECT count(*) FROM pts, small WHERE NOT test AND label <> l) AS m),
near AS (SELECT a.doc_id, b.v AS w, row_number() OVER (PARTITION BY a.doc_id ORDER BY round(list_distance(a.v, b.v), 6), b.doc_id) AS rk
  FROM few a, few b WHERE a.doc_id <> b.doc_id),
start AS (SELECT doc_id, label, v, row_number() OVER (ORDER BY {sql_hash('42start', 'doc_id')}, doc_id) AS pos FROM few),
drawn AS (SELECT doc_id, label, v, unnest(range(1, (m - f) // f + CASE WHEN pos <= (m - f) % f THEN 1 ELSE 0 END + 1)) AS copy FROM start, size),
pick AS (SELECT *, {sql_integer('42pick', 1, 6, 'doc_id', 'copy')} AS rk, {sql_uniform('42share', 'doc_id', 'copy')} AS u FROM drawn),
grown AS (SELECT doc_id, label, v FROM pts WHERE NOT test
  UNION ALL SELECT p.doc_id, label, list_transform(range(1, {len(FEATURES) + 1}), lambda i: v[i] + u * (w[i] - v[i])) FROM pick p JOIN near n ON n.doc_id = p.doc_id AND n.rk = p.rk),
long AS (SELECT unnest(range(1, {len(FEATURES) + 1})) AS i, unnest(v) AS x FROM grown),
stat AS (SELECT list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM long GROUP BY i)),
sides AS (SELECT 'train' AS split, doc_id, label, v FROM grown UNION ALL SELECT 'test', doc_id, label, v FROM pts WHERE test)
SELECT split, doc_id, label::INT AS label, {', '.join(f"(round((v[{i}] - m[{i}]) / CASE WHEN s[{i}] > 0 THEN s[{i}] ELSE 1 END, 6) + 0.0::DOUBLE) AS {c}" for i, c in enumerate(FEATURES, 1))}
FROM sides, stat"""


@query("prepare_model_data", f"WITH {PREPARED_SQL}")
def prepare_model_data(spark, folder):
    """Leaks dropped, split, training side balanced by synthetic rows, both sides scaled by it."""
    train, test = train_test(spark, folder)
    as_vec = lambda df: df.select("doc_id", "label", F.array(*FEATURES).alias("v"))
    minority = train.groupBy("label").count().orderBy("count", "label").first()["label"]
    balanced = sampling.smote(materialize(as_vec(train), "train"), "doc_id", "v", "label", minority)
    spread = lambda df, key: df.select(F.col(key).alias("doc_id"), F.col("label").cast("int").alias("label"), *[F.col("v")[i].alias(c) for i, c in enumerate(FEATURES)])
    train_rows = materialize(spread(balanced, "source_id"), "balanced")
    scaler = models.PopulationScaler(inputCols=FEATURES, outputCols=FEATURES).fit(drop_leakage(train_rows, "label"))
    parts = {"train": scaler.transform(train_rows), "test": scaler.transform(spread(as_vec(test), "doc_id"))}
    return evaluate.tag_union(parts, "split").withColumns({c: S.rounded(c) for c in FEATURES})


def _grid(spark, search, grid):
    return models.grid_table(spark.range(0), search, grid)


@query("stratified_folds", f"""
WITH r AS (SELECT quality, row_number() OVER (PARTITION BY quality ORDER BY {sql_hash('42fold', 'doc_id')}) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT quality, (SELECT count(*) FROM range(1, 5) t(i) WHERE rn > ceil(n * i / 5.0::DOUBLE))::INT AS fold, count(*) AS n FROM r GROUP BY ALL""")
def stratified_folds(spark, folder):
    """Rows per class and fold of five: they differ by one at most."""
    cut = sampling.stratified_folds(table(spark, folder, "labels"), "quality", "doc_id", 5)
    return cut.groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("logistic_regression_cv")
def logistic_regression_cv(spark, folder):
    train, _ = train_test(spark, folder)
    return _grid(spark, *models.logistic_regression_cv(train, FEATURES, "label", "doc_id"))


@query("decision_tree_cv")
def decision_tree_cv(spark, folder):
    train, _ = train_test(spark, folder)
    return _grid(spark, *models.decision_tree_cv(train, FEATURES, "label", "doc_id"))


@query("random_forest_cv")
def random_forest_cv(spark, folder):
    train, _ = train_test(spark, folder)
    return _grid(spark, *models.random_forest_cv(train, FEATURES, "label", "doc_id"))


def _kernel_grids(spark, train):
    best, searches = models.kernel_svm_cv(train, FEATURES, "label", "doc_id")
    return best, {kernel: _grid(spark, *found) for kernel, found in searches.items()}


@query("kernel_svm")
def kernel_svm(spark, folder):
    train, _ = train_test(spark, folder)
    best, parts = _kernel_grids(spark, train)
    return evaluate.tag_union(parts, "kernel").withColumn("best_kernel", F.lit(best))


@query("grid_search_table")
def grid_search_table(spark, folder):
    """Best cell per search, of all searches."""
    train, _ = train_test(spark, folder)
    parts = {
        "LogisticRegression": _grid(spark, *models.logistic_regression_cv(train, FEATURES, "label", "doc_id")),
        "DecisionTree": _grid(spark, *models.decision_tree_cv(train, FEATURES, "label", "doc_id")),
        "RandomForest": _grid(spark, *models.random_forest_cv(train, FEATURES, "label", "doc_id")),
    }
    best, kernels = _kernel_grids(spark, train)
    return evaluate.tag_union({**parts, "SVM": kernels[best]}).filter("is_best").select("model", "params", "f1")


@query("mlp_classifier")
def mlp_classifier(spark, folder):
    train, test = train_test(spark, folder)
    said = models.mlp(FEATURES, "label").fit(train).transform(test)
    return said.select("doc_id", "label", F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability")[1].alias("score"))


def _machine():
    return machines.VectorMachine(labelCol="label", weightCol="weight")


def _forest():
    return RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=100, maxDepth=10, seed=42)


# The registry of compared models: shown name and how to build it. Adding an entry is all it
# takes to put another model into the comparison.
MODELS = {
    "LogisticRegression": lambda: Pipeline(stages=[*models.scaled_stages(FEATURES), LogisticRegression(labelCol="label", weightCol="weight")]),
    "DecisionTree": lambda: Pipeline(stages=[*models.scaled_stages(FEATURES), DecisionTreeClassifier(labelCol="label", weightCol="weight", maxDepth=5, seed=42)]),
    "RandomForest": lambda: Pipeline(stages=[*models.scaled_stages(FEATURES), _forest()]),
    "SVM": lambda: Pipeline(stages=[*models.scaled_stages(FEATURES), _machine()]),
    "NeuralNetwork": lambda: models.mlp(FEATURES, "label"),
}


def cluster_predictions(train, test):
    """Two clusters on scaled features, named by the majority label of their training rows."""
    prepared = Pipeline(stages=models.scaled_stages(FEATURES)).fit(train)
    clustering = models.kmeans_best(prepared.transform(train), "features", k=2)
    assign = lambda df: clustering.transform(prepared.transform(df)).withColumnRenamed("prediction", "cluster")
    named = models.ClusterToClass(clusterCol="cluster", labelCol="label").fit(assign(train))
    return named.transform(assign(test)).select("doc_id", "label", "cluster", "prediction")


@query("kmeans_cluster")
def kmeans_cluster(spark, folder):
    return cluster_predictions(*train_test(spark, folder))


@query("trained_model_comparison")
def trained_model_comparison(spark, folder):
    """Every registered model and the clustering, trained, scored on the test side, compared."""
    train, test = train_test(spark, folder)
    weighted = materialize(models.add_class_weight(train, "label"), "weighted")
    parts = {}
    for name, build in MODELS.items():
        fitted = build().fit(weighted)
        said = fitted.transform(test)
        if "probability" in said.columns:
            said = said.withColumn("score", vector_to_array("probability")[1])
        else:  # a margin only
            said = models.calibrated(said, weighted, models.scaled_stages(FEATURES), _machine(), "label", "doc_id")
        said = said.select("label", F.col("prediction").cast("int").alias("prediction"), "score")
        parts[name] = evaluate.model_metrics(said, "label", "prediction", "score")
    parts["KMeans"] = evaluate.model_metrics(cluster_predictions(train, test), "label", "prediction")
    return evaluate.long_to_wide(evaluate.tag_union(parts))


@query("svm_probabilities")
def svm_probabilities(spark, folder):
    """Margins of the best rbf machine turned into probabilities by a curve over held-out margins."""
    train, test = train_test(spark, folder)
    _, searches = models.kernel_svm_cv(train, FEATURES, "label", "doc_id", kernels=("rbf",))
    search, grid = searches["rbf"]
    best = max(range(len(grid)), key=lambda i: search.avgMetrics[i])
    machine = _machine().setParams(c=grid[best][next(p for p in grid[best] if p.name == "c")])
    weighted = materialize(models.add_class_weight(train, "label"), "weighted")
    scored = models.calibrated(search.bestModel.transform(test), weighted, models.scaled_stages(FEATURES), machine, "label", "doc_id")
    return scored.select("doc_id", "label", F.col("prediction").cast("int").alias("prediction"), "score")


@query("tree_nodes")
def tree_nodes(spark, folder):
    train, _ = train_test(spark, folder)
    fitted = MODELS["DecisionTree"]().fit(models.add_class_weight(train, "label"))
    return models.tree_nodes(fitted.stages[-1], FEATURES)


@query("model_store", f"WITH {data.DOCUMENT_SQL},{_SPLIT_FRAME_SQL} SELECT doc_id, true AS equal FROM cut WHERE test")
def model_store(spark, folder):
    """Whether a stored and reloaded pipeline scores every held-out row as the fitted one does."""
    train, test = train_test(spark, folder)
    fitted = MODELS["LogisticRegression"]().fit(models.add_class_weight(train, "label"))
    path = scratch_path(spark, "model")
    models.save_model(fitted, path)
    score = lambda model, name: model.transform(test).select("doc_id", vector_to_array("probability")[1].alias(name))
    both = score(fitted, "before").join(score(models.load_model(path), "after"), "doc_id")
    return both.select("doc_id", (F.col("before") == F.col("after")).alias("equal"))


_NEAREST_SQL = f"""{CENTROID_SQL},
asg AS (SELECT vec_id, label, c AS cluster FROM (SELECT vec_id, label, c, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(embedding::DOUBLE[], m), 6), c) AS rn
  FROM embeddings, cent) WHERE rn = 1)"""


def nearest_clusters(spark, folder):
    """Every vector with the nearest class mean as its cluster."""
    vectors = table(spark, folder, "embeddings")
    centers = models.mean_centroids(vectors, "embedding", "label").withColumnRenamed("label", "cluster")
    return models.nearest_centroid(vectors, "embedding", centers, "cluster", "cluster")


@query("cluster_to_class", f"""
WITH {_NEAREST_SQL}, maj AS (SELECT cluster, label AS prediction FROM (
  SELECT cluster, label, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, label) AS rn FROM asg GROUP BY cluster, label) WHERE rn = 1)
SELECT vec_id, label, cluster, prediction FROM asg JOIN maj USING (cluster)""")
def cluster_to_class(spark, folder):
    clustered = materialize(nearest_clusters(spark, folder).select("vec_id", "label", "cluster"), "clusters")
    named = models.ClusterToClass(clusterCol="cluster", labelCol="label").fit(clustered)
    return named.transform(clustered).select("vec_id", "label", "cluster", "prediction")


@query("cluster_profile", f"WITH {data.DOCUMENT_SQL} SELECT lang, {', '.join(f'{r6(f'avg({c})')} AS {c}' for c in FEATURES)}, {r6('avg(quality)')} AS positive_rate FROM feat GROUP BY lang")
def cluster_profile(spark, folder):
    """Feature means in original units and share of positives, the language as the cluster."""
    profile = models.cluster_profile(data.document_features(spark, folder), "lang", FEATURES, "quality")
    return profile.withColumns({c: S.rounded(c) for c in [*FEATURES, "positive_rate"]})


@query("cluster_importance", f"""
WITH {data.DOCUMENT_SQL}, s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in FEATURES)} FROM feat),
z AS (SELECT lang, {', '.join(f'avg(({c} - m_{c}) / s_{c}) AS {c}' for c in FEATURES)} FROM feat, s GROUP BY lang)
{' UNION ALL '.join(f"SELECT '{c}' AS feature, {r6(f'stddev_pop({c})')} AS importance FROM z" for c in FEATURES)}""")
def cluster_importance(spark, folder):
    frame = materialize(data.document_features(spark, folder), "profile")
    return models.cluster_importance(frame, "lang", FEATURES).withColumn("importance", S.rounded("importance"))


def _silhouette_sql(distance: str) -> str:
    return f"""
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum({distance}) AS s, count(*) AS n FROM e a, e b GROUP BY ALL),
r AS (SELECT vec_id, max(n) FILTER (own = other) AS n, max(s / (n - 1)) FILTER (own = other AND n > 1) AS a, min(s / n) FILTER (own <> other) AS b FROM d GROUP BY vec_id)
SELECT {r6('avg(CASE WHEN n < 2 THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette FROM r"""


@query("silhouette", _silhouette_sql("list_distance(a.v, b.v)"))
def silhouette(spark, folder):
    score = neighbors.silhouette(table(spark, folder, "embeddings"), "vec_id", "embedding", "label")
    return score.select(S.rounded("silhouette").alias("silhouette"))


@query("silhouette_squared", _silhouette_sql("list_distance(a.v, b.v) * list_distance(a.v, b.v)"))
def silhouette_squared(spark, folder):
    score = models.silhouette_squared(table(spark, folder, "embeddings"), "embedding", "label")
    return score.select(S.rounded("silhouette").alias("silhouette"))
