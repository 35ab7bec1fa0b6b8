import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.operators import geometry, models, neighbors, reduce


def brute(queries, rows, k, exclude_self):
    """k nearest by rounded distance, then id."""
    out = {}
    ids = np.array([i for i, _ in rows])
    points = np.array([v for _, v in rows])
    for qid, q in queries:
        gaps = np.round(np.sqrt(((points - np.array(q)) ** 2).sum(axis=1)), 6)
        order = [int(ids[i]) for i in np.lexsort((ids, gaps)) if not (exclude_self and ids[i] == qid)]
        out[qid] = order[:k]
    return out


@pytest.fixture(scope="module")
def clouds():
    """Three clusters of very different size, a large group of exact copies, and tied distances."""
    rng = np.random.default_rng(7)
    points = [rng.normal(c, s, size=(n, 6)) for c, s, n in ((0, 1, 120), (9, 0.2, 40), (-20, 3, 15))]
    points.append(np.tile(rng.normal(size=6), (80, 1)))
    points.append(np.round(rng.normal(size=(40, 6))))
    return [(i, [float(x) for x in v]) for i, v in enumerate(np.vstack(points))]


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("cells", [dict(), dict(broadcast_bytes=0, pivots=6, tile_rows=16), dict(broadcast_bytes=0, pivots=40, tile_rows=1000)])
def test_nearest_are_exact(spark, clouds, exclude_self, cells):
    df = spark.createDataFrame(clouds, "id bigint, v array<double>").repartition(3)
    found = neighbors.knn_join(df, df, "id", "v", 4, exclude_self=exclude_self, **cells).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["neighbor_id"])
    assert got == brute(clouds, clouds, 4, exclude_self)


def test_fewer_rows_than_neighbors(spark):
    rows = [(1, [0.0]), (2, [1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    for cells in (dict(), dict(broadcast_bytes=0)):
        assert neighbors.knn_join(df, df, "id", "v", 5, exclude_self=True, **cells).count() == 2


def test_empty_search(spark):
    df = spark.createDataFrame([(1, [0.0])], "id bigint, v array<double>")
    assert neighbors.knn_join(df, df.filter("id > 1"), "id", "v", 1).count() == 0


def test_tied_votes_take_the_smallest_label(spark):
    train = spark.createDataFrame([(1, [0.0], 7), (2, [0.0], 3), (3, [9.0], 3)], "id bigint, v array<double>, y int")
    test = spark.createDataFrame([(10, [0.0], 3)], "id bigint, v array<double>, y int")
    assert neighbors.knn_classify(train, test, "id", "v", "y", k=2).first()["prediction"] == 3


def test_silhouette_paths_agree(spark, clouds):
    df = spark.createDataFrame([(i, v, min(i // 120, 2)) for i, v in clouds], "id bigint, v array<double>, c int")
    whole = neighbors.silhouette(df, "id", "v", "c").first()[0]
    tiled = neighbors.silhouette(df, "id", "v", "c", broadcast_bytes=0, tile_rows=50).first()[0]
    points, member = np.array([v for _, v in clouds]), np.array([min(i // 120, 2) for i, _ in clouds])
    gaps = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    scores = []
    for i in range(len(points)):
        means = {c: gaps[i][(member == c) & (np.arange(len(points)) != i)].mean() for c in set(member)}
        a, b = means[member[i]], min(m for c, m in means.items() if c != member[i])
        scores.append((b - a) / max(a, b))
    assert np.isclose(whole, np.mean(scores)) and np.isclose(tiled, whole)


def test_pca_axes(spark, clouds):
    df = spark.createDataFrame(clouds, "id bigint, v array<double>")
    model = reduce.CenteredPCA(inputCol="v", outputCol="p", dim=6).fit(df)
    axes = np.array(model.getOrDefault(model.axes))
    assert np.allclose(axes @ axes.T, np.eye(6), atol=1e-9)
    values = np.array([r["p"] for r in model.transform(df).collect()])
    spread = values.var(axis=0, ddof=1)
    assert np.allclose(values.mean(axis=0), 0, atol=1e-9) and np.all(np.diff(spread) <= 1e-9)
    assert np.allclose(spread, model.getOrDefault(model.spectrum))


def test_lda_separates_better_than_pca(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        y = i % 3
        v = rng.normal(size=4) * np.array([10.0, 1.0, 1.0, 1.0]) + np.array([0, 2.0 * y, -1.0 * y, 0])
        rows.append((i, [float(x) for x in v], y))
    df = spark.createDataFrame(rows, "id bigint, v array<double>, y int")

    def ratio(values):
        labels = np.array([y for _, _, y in rows])
        between = sum((labels == c).sum() * (values[labels == c].mean() - values.mean()) ** 2 for c in range(3))
        within = sum(((values[labels == c] - values[labels == c].mean()) ** 2).sum() for c in range(3))
        return between / within

    pca = reduce.CenteredPCA(inputCol="v", outputCol="p", dim=1).fit(df).transform(df).orderBy("id").collect()
    model = reduce.FisherLDA(inputCol="v", outputCol="p", labelCol="y", dim=2).fit(df)
    lda = model.transform(df).orderBy("id").collect()
    first = ratio(np.array([r["p"][0] for r in lda]))
    assert first > ratio(np.array([r["p"][0] for r in pca]))
    assert first > ratio(np.array([r["p"][1] for r in lda]))


def test_projection_survives_saving(spark, clouds, tmp_path):
    df = spark.createDataFrame(clouds, "id bigint, v array<double>")
    model = reduce.CenteredPCA(inputCol="v", outputCol="p", dim=2).fit(df)
    model.save(str(tmp_path / "m"))
    again = reduce.ProjectionModel.load(str(tmp_path / "m"))
    assert np.allclose(np.array(again.transform(df).first()["p"]), np.array(model.transform(df).first()["p"]))


def test_too_few_matches(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 1.0, 0.0)], "id int, x double, y double, u double, v double")
    with pytest.raises(ValueError):
        geometry.consensus_similarity(df, "id", 0.1)


def test_consensus_finds_the_transform(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        x, y = rng.normal(size=2) * 10
        u, v = 2 * x - 1 * y + 4, 1 * x + 2 * y - 3
        if i % 4 == 0:
            u, v = u + 50 + i, v - 20
        rows.append((i, float(x), float(y), float(u), float(v)))
    fit = geometry.consensus_similarity(spark.createDataFrame(rows, "id int, x double, y double, u double, v double"), "id", 0.01).first()
    assert np.allclose(fit[1:], (2, 1, 4, -3)) and fit["inliers"] == 45


def test_nearest_centroid_and_single_member_cluster(spark):
    df = spark.createDataFrame([(1, [0.0], 0), (2, [0.5], 0), (3, [9.0], 1)], "id bigint, v array<double>, c int")
    centers = models.mean_centroids(df, "v", "c")
    assert {r["id"]: r["k"] for r in models.nearest_centroid(df, "v", centers, "c", "k").collect()} == {1: 0, 2: 0, 3: 1}
    assert neighbors.silhouette(df, "id", "v", "c").first()[0] > 0.6
    assert models.silhouette_squared(df, "v", "c").first()[0] > 0.6


def test_cell_search_writes_no_row_once_per_cell(spark, clouds, monkeypatch):
    df = spark.createDataFrame(clouds, "id bigint, v array<double>").repartition(3)
    written, plain = [], neighbors.materialize

    def counted(frame, tag):
        out = plain(frame, tag)
        written.append(out.count())
        return out

    monkeypatch.setattr(neighbors, "materialize", counted)
    found = neighbors.knn_join(df, df, "id", "v", 4, exclude_self=True, broadcast_bytes=0, pivots=30, tile_rows=4)
    assert found.count() == 4 * len(clouds) and max(written) <= len(clouds)


def _peak(run) -> float:
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak


def test_search_memory_does_not_follow_the_searched_rows():
    rng = np.random.default_rng(3)
    rows, query = np.round(rng.normal(size=(60_000, 3)), 2), np.round(rng.normal(size=(700, 3)), 2)
    nearest = neighbors._Nearest(np.arange(700), query, 3)
    assert _peak(lambda: nearest.see(np.arange(60_000)[::-1], rows)) < 60
    wanted = brute(list(zip(range(0, 700, 50), query[::50])), list(zip(np.arange(60_000)[::-1], rows)), 3, False)
    assert {i: nearest.row[i].tolist() for i in range(0, 700, 50)} == wanted


def test_silhouette_memory_does_not_follow_the_rows():
    rng = np.random.default_rng(3)
    rows, clusters = rng.normal(size=(60_000, 3)), rng.integers(0, 4, 60_000)
    out = []
    assert _peak(lambda: out.append(neighbors._cluster_sums(np.arange(700), clusters[:700], rows[:700], clusters, rows))) < 60
    first = out[0][out[0]["query_id"] == 5].set_index("other")
    gaps = np.sqrt(((rows - rows[5]) ** 2).sum(axis=1))
    assert all(np.isclose(first.loc[c, "total"], gaps[clusters == c].sum()) and first.loc[c, "n"] == (clusters == c).sum() for c in range(4))


def test_differences_and_pivots_are_taken_in_parts():
    """Neither many candidate pairs nor many pivots make a worker hold more than some parts of 8 MB at once."""
    rng = np.random.default_rng(3)
    rows, first, second = rng.normal(size=(1000, 64)), rng.integers(0, 1000, 60_000), rng.integers(0, 1000, 60_000)
    tracemalloc.start()
    gaps = neighbors._gaps(rows, rows, first, second)
    most = tracemalloc.get_traced_memory()[1]
    assert np.allclose(gaps[:100], np.linalg.norm(rows[first[:100]] - rows[second[:100]], axis=1)) and most < 40e6

    many, centers = rng.normal(size=(6000, 3)), rng.normal(size=(2048, 3))
    to_pivots = lambda part: np.sqrt(sum((part[:, i, None] - centers[:, i]) ** 2 for i in range(3)))
    usable = np.arange(2048) % 2 == 0
    tracemalloc.reset_peak()
    cell, least = neighbors._home(many, to_pivots, len(centers), usable)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for i in (0, 3000, 5999):
        away = np.where(usable, np.linalg.norm(many[i] - centers, axis=1), np.inf)
        assert cell[i] == away.argmin() and np.isclose(least[i], away.min())
    assert most < 80e6
