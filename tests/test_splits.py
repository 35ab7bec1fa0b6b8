"""Splits, folds and weights: missing labels, ties, large k, and what one fit says about several cells."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortwise.operators import features, geometry, models, neighbors, ordering, sampling, semisup, sequence
from cohortwise.session import materialize, scratch_scope


@pytest.fixture(scope="module")
def partly(spark):
    """90 rows, every third without a label."""
    return spark.range(90).select("id", F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("int")).alias("y"))


def test_no_row_is_lost(partly):
    for cut, name in ((sampling.stratified_split(partly, "y", "id"), "split"), (sampling.labeled_split(partly, "y", "id", 4, validation=3), "part"),
                      (sampling.positional_class_split(partly, "y", "id", 5), "split")):
        rows = cut.collect()
        assert len(rows) == 90 and {r[name] for r in rows if r["y"] is None} == {"unlabeled"}
    both = sampling.labeled_split(partly, "y", "id", 4, overlap=True).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in both} == {"labeled": 8, "unlabeled": 90}


def test_weights_leave_missing_labels_out(partly):
    assert sorted((r["y"], r["n"], r["weight"]) for r in models.class_weights(partly, "y").collect()) == [(1, 30, 1.0), (2, 30, 1.0)]
    rows = models.add_class_weight(partly, "y").collect()
    assert len(rows) == 90 and all((r["weight"] is None) == (r["y"] is None) for r in rows)


def test_first_k_are_exact_on_ties(spark):
    df = spark.createDataFrame([(i, i // 10, i % 2) for i in range(100)], "id int, k int, y int")
    cut = sampling.positional_class_split(df, "y", "k", 7, ties=("id",)).filter("split = 'train'").collect()
    assert sorted(r["id"] for r in cut) == list(range(14))


def test_large_k_sorts_no_class(spark):
    df = spark.range(12_000).select("id", (F.col("id") % 2).alias("y"))
    cut = sampling.positional_class_split(df, "y", "id", 5_000)
    assert cut.filter("split = 'train'").count() == 10_000
    for made in (cut, sampling.labeled_split(df, "y", "id", 5_000)):
        plan = made._jdf.queryExecution().toString()
        assert "WindowGroupLimit" not in plan and "Window [" not in plan
    assert sampling.labeled_split(df, "y", "id", 5_000, validation=900).groupBy("part").count().filter("count in (10000, 1800, 200)").count() == 3


def test_rank_bounds(spark):
    df = spark.range(500).select(F.md5(F.col("id").cast("string")).alias("h"), (F.col("id") % 3).alias("y"))
    rows = {r["y"]: r["b"] for r in ordering.rank_bounds(df, "y", "h", [lambda n: F.lit(1), lambda n: n, lambda n: F.ceil(n / 2)], "b").collect()}
    for y, bounds in rows.items():
        keys = sorted(r["h"] for r in df.filter(F.col("y") == y).collect())
        assert bounds == [keys[0], keys[-1], keys[-(-len(keys) // 2) - 1]]


def test_folds_are_even_in_every_class(spark):
    df = spark.range(407).select("id", F.when(F.col("id") < 400, (F.col("id") < 23).cast("int")).alias("y"))
    counts = {}
    for r in sampling.stratified_folds(df, "y", "id", 5).collect():
        counts[r["y"], r["fold"]] = counts.get((r["y"], r["fold"]), 0) + 1
    assert counts[None, None] == 7
    for y in (0, 1):
        sizes = [counts[y, f] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_unlisted_kinds_are_not_lost(spark):
    log = spark.createDataFrame([(1, "quiz", 3, 2.0), (1, "new", 1, 9.0), (1, None, 1, 1.0)], "id int, kind string, day int, clicks double")
    args = (["id"], "kind", "day", "clicks")
    with pytest.raises(Exception, match="no column for kind"):
        features.activity_wide(log, *args, ["quiz"]).collect()
    row = features.activity_wide(log, *args, ["quiz"], rest="rest").first()
    assert (row["total_clicks_quiz"], row["total_clicks_rest"], row["active_days_rest"]) == (2.0, 10.0, 1)
    row = features.activity_wide(log, *args).first()
    assert (row["total_clicks_new"], row["total_clicks_none"]) == (9.0, 1.0)


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + rng.normal(scale=0.6, size=400) > 0).astype(int)
    rows = [(i, *[float(v) for v in x[i]], int(y[i]), 1.0 + i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, label int, weight double").coalesce(1)
    return materialize(Pipeline(stages=models.scaled_stages(list("abcd"))).fit(df).transform(df), "noisy")


def test_a_cut_tree_is_the_shallower_tree(spark, noisy):
    grow = lambda depth: DecisionTreeClassifier(labelCol="label", weightCol="weight", maxDepth=depth, minInstancesPerNode=2, maxBins=64, seed=42).fit(noisy)
    deep = models.tree_arrays(grow(10), spark)[0]
    rows = noisy.select("id", vector_to_array("features").alias("x")).orderBy("id").collect()
    reached = models.descend(deep, np.array([r["x"] for r in rows]), [2, 4, 7, 10])
    for depth, nodes in reached.items():
        said = [r["prediction"] for r in grow(depth).transform(noisy).orderBy("id").collect()]
        assert (deep["said"][nodes] == said).all(), depth


def test_forest_arrays_vote_as_the_forest(spark, noisy):
    forest = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=12, maxDepth=6, seed=42).fit(noisy)
    rows = forest.transform(noisy).select("id", vector_to_array("features").alias("x"), vector_to_array("probability").alias("p")).orderBy("id").collect()
    x = np.array([r["x"] for r in rows])
    chance = np.mean([t["chance"][models.descend(t, x, [6])[6]] for t in models.tree_arrays(forest, spark)], axis=0)
    assert np.allclose(chance, [r["p"] for r in rows])


def test_forest_fits_take_no_more_tasks_than_cores_need(spark, noisy, monkeypatch):
    seen, fit = [], RandomForestClassifier.fit
    spread = noisy.repartition(40)
    monkeypatch.setattr(models, "fold_sides", lambda *_: [(spread, noisy)] * 2)
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, df, params: seen.append((df.rdd.getNumPartitions(), df.count())) or fit(self, df, params))
    search, grid = models.random_forest_cv(noisy, list("abcd"), "label", "id", folds=2, trees=(3,), depths=(2,), splits=(2,), leaves=(1,), subsets=("sqrt",))
    assert seen == [(spark.sparkContext.defaultParallelism, 400)] * 2 and len(grid) == 1 and 0.5 < search.avgMetrics[0] <= 1
    assert models.tasks_per_fit(spark, 1) == 2 * models.tasks_per_fit(spark, 2) and models.tasks_per_fit(spark, 10_000) == 2


def test_missing_vectors_have_no_neighbours(spark):
    df = spark.createDataFrame([(1, [0.0], 0), (2, None, 0), (3, [1.0], 1)], "id bigint, v array<double>, y int")
    for path in (dict(), dict(broadcast_bytes=0)):
        assert {(r["query_id"], r["neighbor_id"]) for r in neighbors.knn_join(df, df, "id", "v", 2, exclude_self=True, **path).collect()} == {(1, 3), (3, 1)}
    centers = models.mean_centroids(df, "v", "y")
    for most in (10, 0):
        near = {r["id"]: r["c"] for r in models.nearest_centroid(df, "v", centers.withColumnRenamed("y", "c"), "c", "c", most).collect()}
        assert near == {1: 0, 2: None, 3: 1}


def test_stored_neighbours_and_cluster_names(spark, tmp_path):
    train = spark.createDataFrame([(1, [0.0], 5), (2, [0.1], 5), (3, [9.0], 7)], "id bigint, v array<double>, y int")
    test = spark.createDataFrame([(10, [0.2], 0), (11, None, 0)], "id bigint, v array<double>, y int")
    stage = neighbors.KNNClassifier(idCol="id", inputCol="v", labelCol="y", k=2)
    Pipeline(stages=[stage]).fit(train).save(str(tmp_path / "knn"))
    assert {r["id"]: r["prediction"] for r in PipelineModel.load(str(tmp_path / "knn")).transform(test).collect()} == {10: 5, 11: None}
    named = models.ClusterToClass(clusterCol="k", labelCol="y").fit(train.withColumn("k", (F.col("id") > 2).cast("int")))
    named.save(str(tmp_path / "names"))
    again = models.ClusterToClassModel.load(str(tmp_path / "names"))
    rows = again.transform(spark.createDataFrame([(0,), (1,), (4,), (None,)], "k int")).collect()
    assert [r["prediction"] for r in rows] == [5, 7, None, None]


def test_blocks_do_not_show(spark):
    """Running statistics over series cut into small blocks are those of the whole series."""
    rng = np.random.default_rng(3)
    rows = [(["a", "b", None][i % 3], i, float(v), float(w)) for i, (v, w) in enumerate(zip(rng.integers(0, 50, 200), rng.integers(1, 5, 200)))]
    df = spark.createDataFrame(rows, "s string, t int, v double, w double").repartition(6)
    for name, made in (("mean", sequence.weighted_running_mean(df, "s", "t", "v", "w", block=7)), ("best", sequence.running_best(df, "s", "t", "v", block=7)),
                       ("trail", sequence.trailing_mean(df, "s", "t", "v", rows=5, block=7))):
        got = {(r["s"], r["t"]): r for r in made.collect()}
        assert len(got) == 200
        for s in ("a", "b", None):
            own = [r for r in rows if r[0] == s]
            for i, (_, t, v, _) in enumerate(own):
                r, before = got[s, t], [x[2] for x in own[:i]]
                if name == "mean":
                    assert np.isclose(r["running_avg"], sum(x[2] * x[3] for x in own[: i + 1]) / sum(x[3] for x in own[: i + 1]))
                elif name == "best":
                    assert r["is_best"] == (v > max([0.0, *before])) and r["best"] == max([0.0, v, *before])
                else:
                    assert np.isclose(r["trailing_mean"], np.mean([x[2] for x in own[max(0, i - 4) : i + 1]]))


def test_same_points_have_no_transform(spark):
    df = spark.createDataFrame([(i, 1.0, 1.0, 2.0, 2.0) for i in range(6)], "id int, x double, y double, u double, v double")
    with pytest.raises(ValueError):
        geometry.consensus_similarity(df, "id", 0.1)


def test_mixing_share_and_ramp():
    assert 0.5 <= semisup.mixing_weight(0.75) <= 1 and semisup.mixing_weight(0.75) == semisup.mixing_weight(0.75)
    assert [semisup.ramp_up(s, 4) for s in (0, 1, 4, 9)] == [0.0, 0.25, 1.0, 1.0] and semisup.ramp_up(1, 0) == 1.0


def test_scratch_tables_go_with_their_scope(spark):
    with scratch_scope(spark):
        kept = materialize(spark.range(5), "scope")
        assert kept.count() == 5
        path = kept.inputFiles()[0]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
