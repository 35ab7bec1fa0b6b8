"""The rectifier network and the clustering from many starts against plain versions."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cohortwise.operators import clustering, network
from cohortwise.operators.blocks import distinct_rows, hashed_blocks, rows_per_block, seeded_blocks, unpacked


def framed(spark, x, y, parts=3):
    rows = [(*map(float, r), None if l is None else int(l)) for r, l in zip(x, y)]
    names = [f"c{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", label int").repartition(parts)
    return VectorAssembler(inputCols=names, outputCol="features").transform(df)


@pytest.fixture(scope="module")
def rings():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(1_200, 2))
    return x, (np.hypot(*x.T) > 1.18).astype(int)


@pytest.mark.parametrize("layers", [[3, 5, 2], [3, 6, 4, 3]])
def test_gradient_equals_finite_differences(layers):
    draw = np.random.default_rng(1)
    x, y, w = draw.normal(size=(20, 3)), draw.integers(0, layers[-1], 20), draw.uniform(0.5, 2, 20)
    flat = network.first_parameters(layers, 7)
    _, gradient = network.loss_and_gradient(flat, layers, x, y, w, 0.3)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (network.loss_and_gradient(flat + s, layers, x, y, w, 0.3)[0] for s in (step, -step))
        assert gradient[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_network_learns_and_stops_early(spark, rings):
    df = framed(spark, *rings)
    model = network.RectifierNetwork(hidden=[16, 8], batch=50, rate=0.01).fit(df)
    assert 5 < model.getOrDefault("epochs") < 200
    said = model.transform(df).select("label", "prediction", "probability").collect()
    assert np.mean([r["label"] == r["prediction"] for r in said]) > 0.93
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 and r["prediction"] == int(np.argmax(r["probability"])) for r in said)


def test_network_does_not_depend_on_partitioning(spark, rings):
    fit = lambda parts: network.RectifierNetwork(hidden=[8], maxIter=4, blockRows=150).fit(framed(spark, *rings, parts))
    one, other = fit(1), fit(7)
    assert one.getOrDefault("weights") == other.getOrDefault("weights")


def test_one_block_is_plain_mini_batch_training(spark, rings):
    df = framed(spark, *rings)
    got = network.RectifierNetwork(hidden=[8], maxIter=3, share=0.0, batch=100).fit(df)
    block = next(unpacked(seeded_blocks(distinct_rows(df, "features", "label"), 42, 0.0).toPandas()))
    layers = [2, 8, 2]
    flat = network.first_parameters(layers, 42)
    first, second, done = np.zeros_like(flat), np.zeros_like(flat), 0
    for epoch in range(3):
        order = np.random.default_rng([42, epoch, 0]).permutation(len(block["y"]))
        for at in range(0, len(order), 100):
            rows, done = order[at : at + 100], done + 1
            _, g = network.loss_and_gradient(flat, layers, block["x"][rows], block["y"][rows], block["w"][rows], 0.0001 / len(rows))
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            flat = flat - 0.001 * (first / (1 - 0.9**done)) / (np.sqrt(second / (1 - 0.999**done)) + 1e-8 / np.sqrt(1 - 0.999**done))
    assert np.allclose(got.getOrDefault("weights"), flat, atol=1e-7)


def test_network_edges(spark, tmp_path):
    x = np.array([[0.0, 1.0]] * 30 + [[1.0, 0.0]] * 30 + [[5.0, 5.0]])
    df = framed(spark, x, [0] * 30 + [1] * 30 + [None])
    model = network.RectifierNetwork(hidden=[4], maxIter=60, rate=0.05, share=0.0).fit(df)  # two different rows, one without a label
    assert {(r["c0"], r["prediction"]) for r in model.transform(df).filter("label is not null").collect()} == {(0.0, 0.0), (1.0, 1.0)}
    model.write().save(str(tmp_path / "net"))
    again = network.RectifierNetworkModel.load(str(tmp_path / "net"))
    assert again.transform(df).select("probability").collect() == model.transform(df).select("probability").collect()
    assert model.transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no labelled row"):
        network.RectifierNetwork().fit(df.filter("label is null"))


def test_blocks_hold_every_row_once(spark, rings):
    df = framed(spark, *rings)
    packed = seeded_blocks(distinct_rows(df, "features", "label"), 1, 0.1, 100).toPandas()
    parts = list(unpacked(packed))
    assert len(parts) == 12 and all(len(p["x"]) == 100 for p in parts)
    assert np.allclose(sorted(np.concatenate([p["x"][:, 0] for p in parts])), sorted(rings[0][:, 0]))
    assert 60 < sum(p["held"].sum() for p in parts) < 190
    assert rows_per_block(60) == 50_000 and rows_per_block(4_000) == 1_000


def plain_lloyd(x, centers, tolerance):
    for _ in range(300):
        near = ((x[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[near == c].mean(axis=0) if (near == c).any() else centers[c] for c in range(len(centers))])
        moved, centers = ((new - centers) ** 2).sum(), new
        if moved <= tolerance:
            break
    return centers, ((x[:, None] - centers) ** 2).sum(axis=2).min(axis=1).sum()


@pytest.fixture(scope="module")
def clouds():
    draw = np.random.default_rng(9)
    return np.vstack([draw.normal(c, 0.6, (150, 3)) for c in ([0, 0, 100], [2, 0, 100], [0, 3, 101], [4, 4, 99])])


@pytest.mark.parametrize("k", [2, 5])
def test_all_starts_equal_separate_fits(spark, clouds, k):
    x = np.vstack([clouds, clouds[:40], clouds[:40]])  # copies count by their number
    blocks = hashed_blocks(distinct_rows(framed(spark, x, [0] * len(x)), "features"))
    first = clustering.seeded_centers(blocks, k, 6, 3)
    assert first.shape == (6, k, 3) and all(len(np.unique(f, axis=0)) == k for f in first)
    assert len(np.unique(first[:, 0], axis=0)) > 1
    found = clustering.lloyd(blocks, first, 300, 1e-8)
    for s in range(6):
        centers, cost = plain_lloyd(x, first[s], 1e-8)
        assert np.allclose(found.centers[s], centers, atol=1e-6) and found.costs[s] == pytest.approx(cost)


def test_best_start_and_partitioning(spark, clouds):
    fits = [clustering.kmeans_starts(framed(spark, clouds, [0] * len(clouds), parts), "features", 4) for parts in (1, 6)]
    (model, found), (other, _) = fits
    assert model.getOrDefault("cost") == pytest.approx(found.costs.min()) and np.allclose(model.clusterCenters(), other.clusterCenters())
    df = framed(spark, clouds, [0] * len(clouds))
    said = model.transform(df).select("features", "prediction").collect()
    for r in said:
        assert r["prediction"] == ((np.array(model.clusterCenters()) - r["features"].toArray()) ** 2).sum(axis=1).argmin()
    nulls = model.transform(df.limit(2).withColumn("features", F.when(F.col("c0") > 1e9, F.col("features"))))
    assert [r["prediction"] for r in nulls.collect()] == [None, None]


def test_draws_follow_weight_and_distance(spark):
    x = np.array([[0.0]] * 30 + [[1.0]] * 10 + [[3.0]] * 10)
    blocks = hashed_blocks(distinct_rows(framed(spark, x, [0] * 50), "features"))
    first = clustering.seeded_centers(blocks, 2, 400, 1)
    assert np.mean(first[:, 0, 0] == 0) == pytest.approx(0.6, abs=0.08)
    after_zero = first[first[:, 0, 0] == 0][:, 1, 0]
    assert np.mean(after_zero == 3) == pytest.approx(0.9, abs=0.06) and not (after_zero == 0).any()


def test_few_rows_and_none(spark):
    df = framed(spark, np.array([[1.0, 2.0]] * 5), [0] * 5)
    model, _ = clustering.kmeans_starts(df, "features", 2, starts=2)
    assert np.allclose(model.clusterCenters(), [[1, 2], [1, 2]]) and model.getOrDefault("cost") == 0
    assert {r["prediction"] for r in model.transform(df).collect()} == {0}
    with pytest.raises(ValueError, match="no row"):
        clustering.kmeans_starts(df.limit(0), "features")
