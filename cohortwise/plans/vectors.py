"""Vector analytics: neighbours, projections, augmentation, robust fitting."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from cohortwise.functions import scalars as S
from cohortwise.functions import vectors as V
from cohortwise.functions.seeded import uniform
from cohortwise.operators import augment, geometry, machines, models, neighbors, reduce
from cohortwise.plans.evaluation import _SPLIT_SQL, KNN_SQL, knn_predictions, split_vectors
from cohortwise.plans.registry import query, r6, sql_hash, sql_integer, sql_uniform
from cohortwise.session import materialize, scratch_path
from cohortwise.sources.tables import table

_LONG = "SELECT vec_id, label, unnest(range(64))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings"


@query("covariance_matrix", f"""
WITH long AS ({_LONG}) SELECT a.pos AS i, b.pos AS j, {r6('covar_samp(a.x, b.x)')} AS cov FROM long a JOIN long b USING (vec_id) GROUP BY a.pos, b.pos""")
def covariance_matrix(spark, folder):
    return reduce.covariance(table(spark, folder, "embeddings"), "embedding").withColumn("cov", S.rounded("cov"))


@query("scatter_matrices", f"""
WITH long AS ({_LONG}), cm AS (SELECT label, pos, avg(x) AS m, count(*) AS n FROM long GROUP BY ALL),
om AS (SELECT pos, avg(x) AS m FROM long GROUP BY pos),
dev AS (SELECT vec_id, long.pos, x - m AS d FROM long JOIN cm ON cm.label = long.label AND cm.pos = long.pos),
sw AS (SELECT a.pos AS i, b.pos AS j, sum(a.d * b.d) AS s FROM dev a JOIN dev b USING (vec_id) GROUP BY ALL),
cd AS (SELECT label, cm.pos, cm.m - om.m AS d, n FROM cm JOIN om ON cm.pos = om.pos),
sb AS (SELECT a.pos AS i, b.pos AS j, sum(a.n * a.d * b.d) AS s FROM cd a JOIN cd b USING (label) GROUP BY ALL)
SELECT i, j, {r6('sw.s')} AS sw, {r6('sb.s')} AS sb FROM sw JOIN sb USING (i, j)""")
def scatter_matrices(spark, folder):
    scatter = reduce.class_scatter(table(spark, folder, "embeddings"), "embedding", "label")
    return scatter.withColumns({c: S.rounded(c) for c in ("sw", "sb")})


@query("knn_topk", f"""
WITH {KNN_SQL} SELECT qid AS query_id, tid AS neighbor_id, {r6('dist')} AS distance, rn::INT AS rank FROM near WHERE rn <= 5""")
def knn_topk(spark, folder):
    train, test = split_vectors(spark, folder)
    return neighbors.knn_join(test, train, "vec_id", "embedding", 5)


@query("knn_self_cells", f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
near AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, round(list_distance(a.v, b.v), 6) AS distance,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, b.v), 6), b.vec_id) AS rank FROM e a, e b WHERE a.vec_id <> b.vec_id)
SELECT query_id, neighbor_id, {r6('distance')} AS distance, rank::INT AS rank FROM near WHERE rank <= 3""")
def knn_self_cells(spark, folder):
    """The cell search, as for a searched side beyond the byte bound."""
    vectors = table(spark, folder, "embeddings")
    return neighbors.knn_join(
        vectors, vectors, "vec_id", "embedding", 3, exclude_self=True, broadcast_bytes=0, pivots=16, tile_rows=128
    )


def _halves(spark, folder):
    tagged = table(spark, folder, "embeddings").withColumn("half", (uniform("half", "vec_id") >= 0.5).cast("int"))
    return [tagged.filter(F.col("half") == i).drop("half") for i in (0, 1)]


_MUTUAL_SQL = f"""
h AS (SELECT vec_id, embedding::DOUBLE[] AS v, {sql_uniform('half', 'vec_id')} >= 0.5 AS second FROM embeddings),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, round(list_distance(a.v, b.v), 6) AS distance FROM h a, h b WHERE NOT a.second AND b.second),
mutual AS (SELECT query_id, neighbor_id, distance FROM (SELECT *,
    row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS r1,
    row_number() OVER (PARTITION BY neighbor_id ORDER BY distance, query_id) AS r2 FROM pairs) WHERE r1 = 1 AND r2 = 1)"""


def mutual_matches(spark, folder):
    first, second = _halves(spark, folder)
    return neighbors.mutual_nearest(first, second, "vec_id", "embedding")


@query("mutual_nearest_match", f"WITH {_MUTUAL_SQL} SELECT query_id, neighbor_id, {r6('distance')} AS distance FROM mutual")
def mutual_nearest_match(spark, folder):
    return mutual_matches(spark, folder).withColumn("distance", S.rounded("distance"))


@query("best_matches", f"WITH {_MUTUAL_SQL} SELECT query_id, neighbor_id, {r6('distance')} AS distance FROM mutual ORDER BY 3, 1, 2 LIMIT 50")
def best_matches(spark, folder):
    return neighbors.closest(mutual_matches(spark, folder), 50).withColumn("distance", S.rounded("distance"))


@query("euclidean_distance", f"""
WITH {_MUTUAL_SQL} SELECT query_id, neighbor_id, {r6('list_distance(a.v, b.v)')} AS distance FROM mutual
  JOIN h a ON a.vec_id = query_id JOIN h b ON b.vec_id = neighbor_id""")
def euclidean_distance(spark, folder):
    """The distance expression itself, on the matched pairs."""
    vectors = table(spark, folder, "embeddings")
    left = vectors.select(F.col("vec_id").alias("query_id"), V.as_double("embedding").alias("a"))
    right = vectors.select(F.col("vec_id").alias("neighbor_id"), V.as_double("embedding").alias("b"))
    pairs = mutual_matches(spark, folder).select("query_id", "neighbor_id").join(left, "query_id").join(right, "neighbor_id")
    return pairs.select("query_id", "neighbor_id", S.rounded(V.euclidean(F.col("a"), F.col("b"))).alias("distance"))


@query("knn_classify", f"WITH {KNN_SQL} SELECT vec_id, label, prediction FROM said")
def knn_classify(spark, folder):
    return knn_predictions(spark, folder)


@query("knn_accuracy", f"WITH {KNN_SQL} SELECT {r6('avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM said")
def knn_accuracy(spark, folder):
    right = (F.col("label") == F.col("prediction")).cast("double")
    return knn_predictions(spark, folder).agg(S.rounded(F.avg(right)).alias("accuracy"))


def _fit(spark, folder, kind, dim):
    train, test = split_vectors(spark, folder)
    if kind == "pca":
        estimator = reduce.CenteredPCA(inputCol="embedding", outputCol="coords", dim=dim)
    else:
        estimator = reduce.FisherLDA(inputCol="embedding", outputCol="coords", labelCol="label", dim=dim)
    return estimator.fit(train), train, test


def _coordinates(model, train, test):
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return model.transform(both).select("vec_id", "label", "split", F.posexplode("coords").alias("axis", "value"))


@query("pca_project")
def pca_project(spark, folder):
    model, train, test = _fit(spark, folder, "pca", 8)
    return _coordinates(model, train, test)


@query("pca_explained_variance")
def pca_explained_variance(spark, folder):
    model, train, _ = _fit(spark, folder, "pca", 64)
    return reduce.explained_variance(model, train)


_CENTERED_SQL = f"""{_SPLIT_SQL},
mu AS (SELECT list(m ORDER BY pos) AS m FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(range(64)) AS pos, unnest(v) AS x FROM split WHERE NOT test) GROUP BY pos)),
cen AS (SELECT vec_id, label, test, list_transform(range(1, 65), lambda i: v[i] - m[i]) AS y FROM split, mu),
trn AS (SELECT y FROM cen WHERE NOT test), num AS (SELECT count(*) AS n FROM trn)"""


@query("pca_row_energy", f"""
WITH {_CENTERED_SQL}, g AS (SELECT c.vec_id, sum(pow(list_dot_product(c.y, t.y), 2)) AS s FROM cen c, trn t GROUP BY c.vec_id)
SELECT vec_id, {r6('s / (n - 1)')} AS energy FROM g, num""")
def pca_row_energy(spark, folder):
    """Per row the squares of its coordinates weighted with the spectrum: (x - mean)' C (x - mean), whatever the axes."""
    model, train, test = _fit(spark, folder, "pca", 64)
    spectrum = F.array(*[F.lit(v) for v in model.getOrDefault(model.spectrum)])
    coords = model.transform(train.unionByName(test))
    return coords.select("vec_id", S.rounded(V.total(F.zip_with("coords", spectrum, lambda c, v: c * c * v))).alias("energy"))


@query("pca_spectrum_moments", f"""
WITH {_CENTERED_SQL}, g AS (SELECT sum(pow(list_dot_product(a.y, b.y), 2)) AS s2 FROM trn a, trn b), d AS (SELECT sum(list_dot_product(y, y)) AS s1 FROM trn)
SELECT {r6('s1 / (n - 1)')} AS first_moment, {r6('s2 / pow(n - 1, 2)')} AS second_moment FROM g, d, num""")
def pca_spectrum_moments(spark, folder):
    """Sums of the eigenvalues and of their squares: the traces of C and of C squared."""
    spectrum = pca_explained_variance(spark, folder)
    return spectrum.agg(S.rounded(F.sum("variance")).alias("first_moment"), S.rounded(F.sum(F.col("variance") * F.col("variance"))).alias("second_moment"))


@query("pca_full_dimension_knn", f"WITH {KNN_SQL} SELECT vec_id, label, prediction FROM said")
def pca_full_dimension_knn(spark, folder):
    """Neighbours in all principal coordinates are those of the vectors themselves."""
    model, train, test = _fit(spark, folder, "pca", 64)
    cut = lambda df: materialize(model.transform(df).select("vec_id", "label", F.col("coords").alias("v")), "coords")
    return neighbors.knn_classify(cut(train), cut(test), "vec_id", "v", "label")


@query("knn_estimator", f"WITH {KNN_SQL} SELECT vec_id, label, prediction FROM said")
def knn_estimator(spark, folder):
    """The classifier as an estimator, stored inside a pipeline and loaded again."""
    train, test = split_vectors(spark, folder)
    stage = neighbors.KNNClassifier(idCol="vec_id", inputCol="embedding", labelCol="label", k=3)
    path = scratch_path(spark, "pipeline")
    models.save_model(Pipeline(stages=[stage]).fit(train), path)
    return models.load_model(path).transform(test).select("vec_id", "label", "prediction")


@query("pca_total_variance", f"""
WITH {_SPLIT_SQL}, long AS (SELECT unnest(range(64)) AS pos, unnest(v) AS x FROM split WHERE NOT test),
var AS (SELECT var_samp(x) AS v FROM long GROUP BY pos)
SELECT {r6('sum(v)')} AS total_variance, 64::BIGINT AS n_axes FROM var""")
def pca_total_variance(spark, folder):
    """The spectrum adds up to the variance of the input, whatever the axes."""
    spectrum = pca_explained_variance(spark, folder)
    return spectrum.agg(S.rounded(F.sum("variance")).alias("total_variance"), F.count(F.lit(1)).alias("n_axes"))


@query("fisher_lda_project")
def fisher_lda_project(spark, folder):
    model, train, test = _fit(spark, folder, "lda", 9)
    return _coordinates(model, train, test)


@query("subspace_scatter")
def subspace_scatter(spark, folder):
    """Two-dimensional coordinates of both projections, training and test rows."""
    parts = []
    for kind in ("pca", "lda"):
        model, train, test = _fit(spark, folder, kind, 2)
        both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
        coords = model.transform(both)
        parts.append(coords.select(F.lit(kind).alias("reducer"), "vec_id", "label", "split", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y")))
    return parts[0].unionByName(parts[1])


def _knn_score(train, test, dim):
    cut = lambda df: df.select("vec_id", "label", reduce.leading("coords", dim).alias("v"))
    said = neighbors.knn_classify(cut(train), cut(test), "vec_id", "v", "label")
    return said.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]


@query("dimension_sweep")
def dimension_sweep(spark, folder, dims=(2, 4, 8, 16, 32, 64)):
    """(reducer, classifier, dim, accuracy); beyond classes - 1 the second projection is NULL."""
    rows = []
    for kind in ("pca", "lda"):
        model, train, test = _fit(spark, folder, kind, max(dims))
        train, test = (materialize(model.transform(df).select("vec_id", "label", "coords"), "coords") for df in (train, test))
        cap = train.select("label").distinct().count() - 1
        known = [dim for dim in dims if kind == "pca" or dim <= cap]
        said = machines.pairwise_accuracies(train, test, "coords", "label", known)
        for dim in dims:
            if kind == "lda" and dim > cap:
                rows += [(kind, "knn", dim, None), (kind, "svm", dim, None)]
                continue
            rows.append((kind, "knn", dim, float(_knn_score(train, test, dim))))
            rows.append((kind, "svm", dim, float(said[dim])))
    return spark.createDataFrame(rows, "reducer string, classifier string, dim int, accuracy double")


@query("linear_svm_multiclass")
def linear_svm_multiclass(spark, folder):
    train, test = split_vectors(spark, folder)
    as_double = lambda df: df.select("vec_id", "label", V.as_double("embedding").alias("f"))
    said = machines.VectorMachine(featuresCol="f", labelCol="label", kernel="linear").fit(as_double(train)).transform(as_double(test))
    return said.select("vec_id", "label", F.col("prediction").cast("int").alias("prediction"))


def _long(df, col, *keys):
    return df.select(*keys, F.posexplode(col).alias("p", "v")).select(
        *keys, F.col("p").cast("bigint").alias("pos"), S.rounded("v").alias("value")
    )


def _weak_sql(source: str, seed: str, border: int = 4) -> str:
    flipped = f"CASE WHEN {sql_uniform(f'{seed}flip', 'vec_id')} < 0.5 THEN list_reverse(v) ELSE v END"
    padded = f"list_concat(list_reverse(f[2:{border + 1}]), f, list_reverse(f[len(f) - {border}:len(f) - 1]))"
    return (f"SELECT vec_id, list_slice(p, start + 1, start + n) AS v FROM (SELECT vec_id, {padded} AS p, len(f) AS n, "
            f"{sql_integer(f'{seed}crop', 0, 2 * border, 'vec_id')} AS start FROM (SELECT vec_id, {flipped} AS f FROM {source}))")


def _unnest_sql(source: str, extra: str = "") -> str:
    return f"SELECT vec_id, {extra}unnest(range(len(v))) AS pos, {r6('unnest(v)')} AS value FROM {source}"


_RAW = "raw AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"


@query("weak_augment", f"WITH {_RAW}, w AS ({_weak_sql('raw', 'aug')}) {_unnest_sql('w')}")
def weak_augment(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return _long(vectors.select("vec_id", augment.weak(V.as_double("embedding"), "aug", "vec_id").alias("v")), "v", "vec_id")


@query("two_views", f"""WITH {_RAW}, a AS ({_weak_sql('raw', 'view1')}), b AS ({_weak_sql('raw', 'view2')})
{_unnest_sql('a', "'first' AS view, ")} UNION ALL {_unnest_sql('b', "'second' AS view, ")}""")
def two_views(spark, folder):
    first, second = augment.two_weak_views(V.as_double("embedding"), "vec_id")
    views = table(spark, folder, "embeddings").select("vec_id", first.alias("first"), second.alias("second"))
    return _long(views, "first", "vec_id").withColumn("view", F.lit("first")).unionByName(
        _long(views, "second", "vec_id").withColumn("view", F.lit("second")))


def _pixels(spark, folder):
    """Vectors on the whole-number scale 0 to 255."""
    pixel = F.transform(V.as_double("embedding"), lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x + 1.0) * 127.5))).cast("double"))
    return table(spark, folder, "embeddings").select("vec_id", pixel.alias("v"))


_PIXELS = ("pix AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, (x + 1.0::DOUBLE) * 127.5::DOUBLE)))) AS v "
           "FROM embeddings)")


def _cut_sql(source: str, seed: str) -> str:
    return (f"SELECT vec_id, list_transform(range(1, len(v) + 1), lambda i: CASE WHEN i - 1 >= s AND i - 1 <= least(len(v), s + floor(len(v) * 0.5::DOUBLE)) THEN 127.0::DOUBLE ELSE v[i] END) AS v "
            f"FROM (SELECT *, floor(greatest(0.0::DOUBLE, {sql_uniform(f'{seed}cut', 'vec_id')} * len(v) - floor(len(v) * 0.5::DOUBLE) / 2.0::DOUBLE)) AS s FROM {source})")


def _ops_sql(source: str, seed: str, step: int) -> str:
    pix = lambda e: f"floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, {e})))"
    factor = "(level * 0.9::DOUBLE / 10 + 0.05::DOUBLE)"
    step_size = "pow(2.0::DOUBLE, 8.0::DOUBLE - (floor(level * 4 / 10) + 4))"
    auto = pix("(x - list_min(v)) * 255.0::DOUBLE / (list_max(v) - list_min(v))")
    contrast = pix(f"mid + (x - mid) * {factor}")
    return f"""SELECT vec_id, CASE WHEN NOT used THEN v ELSE CASE op
      WHEN 0 THEN CASE WHEN list_max(v) > list_min(v) THEN list_transform(v, lambda x: {auto}) ELSE v END
      WHEN 1 THEN list_transform(v, lambda x: {pix(f'x * {factor}')})
      WHEN 2 THEN list_transform(v, lambda x: {contrast})
      WHEN 4 THEN list_transform(v, lambda x: floor(x / {step_size}) * {step_size})
      WHEN 5 THEN list_transform(v, lambda x: CASE WHEN x < 256.0::DOUBLE - floor(level * 256 / 10) THEN x ELSE 255.0::DOUBLE - x END)
      ELSE v END END AS v
    FROM (SELECT *, floor(list_sum(v) / len(v) + 0.5::DOUBLE) AS mid, {sql_integer(f'{seed}level{step}', 1, 10, 'vec_id')}::DOUBLE AS level,
      {sql_integer(f'{seed}op{step}', 0, 6, 'vec_id')} AS op, {sql_uniform(f'{seed}use{step}', 'vec_id')} < 0.5 AS used FROM {source})"""


@query("strong_augment", f"""WITH {_PIXELS}, w AS ({_weak_sql('pix', 'strong')}), o0 AS ({_ops_sql('w', 'strong', 0)}), o1 AS ({_ops_sql('o0', 'strong', 1)}),
c AS ({_cut_sql('o1', 'strong')}) {_unnest_sql('c')}""")
def strong_augment(spark, folder):
    pixels = _pixels(spark, folder)
    return _long(pixels.select("vec_id", augment.strong(F.col("v"), "strong", "vec_id").alias("v")), "v", "vec_id")


@query("weak_and_strong", f"""WITH {_PIXELS}, a AS ({_weak_sql('pix', 'weak')}), w AS ({_weak_sql('pix', 'strong')}), o0 AS ({_ops_sql('w', 'strong', 0)}),
o1 AS ({_ops_sql('o0', 'strong', 1)}), c AS ({_cut_sql('o1', 'strong')})
{_unnest_sql('a', "'weak' AS view, ")} UNION ALL {_unnest_sql('c', "'strong' AS view, ")}""")
def weak_and_strong(spark, folder):
    weak, strong = augment.weak_and_strong(F.col("v"), "vec_id")
    views = _pixels(spark, folder).select("vec_id", weak.alias("weak"), strong.alias("strong"))
    return _long(views, "weak", "vec_id").withColumn("view", F.lit("weak")).unionByName(
        _long(views, "strong", "vec_id").withColumn("view", F.lit("strong")))


@query("cutout", f"WITH {_PIXELS}, c AS ({_cut_sql('pix', 'cut')}) {_unnest_sql('c')}")
def cutout(spark, folder):
    cut = _pixels(spark, folder).withColumn("v", augment.cutout(F.col("v"), "cut", "vec_id"))
    return _long(cut, "v", "vec_id")


@query("gaussian_noise", f"""
WITH long AS (SELECT vec_id, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT vec_id, pos, {r6(f"x + 0.15::DOUBLE * sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {sql_uniform('noiser', 'vec_id', 'pos')})) * cos(2.0::DOUBLE * pi() * {sql_uniform('noisea', 'vec_id', 'pos')})")} AS value FROM long""")
def gaussian_noise(spark, folder):
    noisy = table(spark, folder, "embeddings").select("vec_id", augment.gaussian_noise(V.as_double("embedding"), "noise", "vec_id").alias("v"))
    return _long(noisy, "v", "vec_id")


# A rotation with scaling and a shift, as a 2 x 3 matrix.
MATRIX = [[12.0, -5.0, 3.0], [5.0, 12.0, -4.0]]


def _points(spark, folder):
    arr = V.as_double("embedding")
    return table(spark, folder, "embeddings").select("vec_id", arr[0].alias("x"), arr[1].alias("y"))


@query("affine_transform_extent", """
WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
b AS (SELECT 12.0::DOUBLE * x + -5.0::DOUBLE * y + 3.0::DOUBLE AS x, 5.0::DOUBLE * x + 12.0::DOUBLE * y + -4.0::DOUBLE AS y FROM p UNION ALL SELECT x, y FROM p)
SELECT floor(min(x))::BIGINT AS x_min, floor(min(y))::BIGINT AS y_min, ceil(max(x))::BIGINT AS x_max, ceil(max(y))::BIGINT AS y_max,
  (ceil(max(x)) - floor(min(x)))::BIGINT AS width, (ceil(max(y)) - floor(min(y)))::BIGINT AS height FROM b""")
def affine_transform_extent(spark, folder):
    points = _points(spark, folder)
    return geometry.bounding_box(geometry.affine(points, "x", "y", MATRIX).unionByName(points), "x", "y")


def _matches(spark, folder):
    """Points and their images under the matrix, a drawn quarter of them moved elsewhere."""
    points = _points(spark, folder)
    image = geometry.affine(points.withColumns({"u": F.col("x"), "v": F.col("y")}), "u", "v", MATRIX)
    wrong = uniform("wrong", "vec_id") < 0.25
    return image.withColumns({
        "u": F.col("u") + F.when(wrong, 5.0 + 10.0 * uniform("du", "vec_id")).otherwise(0.0),
        "v": F.col("v") - F.when(wrong, 5.0 + 10.0 * uniform("dv", "vec_id")).otherwise(0.0),
    })


@query("consensus_affine_fit", f"""
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
m AS (SELECT vec_id, x, y,
  12.0::DOUBLE * x - 5.0::DOUBLE * y + 3.0::DOUBLE + CASE WHEN {sql_uniform('wrong', 'vec_id')} < 0.25 THEN 5.0 + 10.0 * {sql_uniform('du', 'vec_id')} ELSE 0.0::DOUBLE END AS u,
  5.0::DOUBLE * x + 12.0::DOUBLE * y - 4.0::DOUBLE - CASE WHEN {sql_uniform('wrong', 'vec_id')} < 0.25 THEN 5.0 + 10.0 * {sql_uniform('dv', 'vec_id')} ELSE 0.0::DOUBLE END AS v FROM p),
s AS (SELECT *, row_number() OVER (ORDER BY {sql_hash(42, 'vec_id')}, vec_id) - 1 AS k FROM m ORDER BY k LIMIT 200),
h AS (SELECT a.k // 2 AS h, a.x AS px, a.y AS py, a.u AS pu, a.v AS pv, b.x - a.x AS dx, b.y - a.y AS dy, b.u - a.u AS du, b.v - a.v AS dv
  FROM s a JOIN s b ON b.k = a.k + 1 WHERE a.k % 2 = 0),
ab AS (SELECT *, (du * dx + dv * dy) / (dx * dx + dy * dy) AS a, (dv * dx - du * dy) / (dx * dx + dy * dy) AS b FROM h WHERE dx * dx + dy * dy > 0),
t AS (SELECT *, pu - a * px + b * py AS tx, pv - b * px - a * py AS ty FROM ab),
r AS (SELECT h, a, b, tx, ty, m.*, round(sqrt(pow(a * m.x - b * m.y + tx - m.u, 2) + pow(b * m.x + a * m.y + ty - m.v, 2)), 9) AS miss FROM t, m),
w AS (SELECT h FROM r WHERE miss < 0.01 GROUP BY h ORDER BY count(*) DESC, h LIMIT 1),
i AS (SELECT avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, avg(x * x) + avg(y * y) - avg(x) ** 2 - avg(y) ** 2 AS sp,
  avg(x * u) + avg(y * v) - avg(x) * avg(u) - avg(y) * avg(v) AS al, avg(x * v) - avg(y * u) - avg(x) * avg(v) + avg(y) * avg(u) AS ac, count(*) AS n
  FROM r WHERE h = (SELECT h FROM w) AND miss < 0.01)
SELECT n AS inliers, {r6('al / sp')} AS a, {r6('ac / sp')} AS b, {r6('mu - al / sp * mx + ac / sp * my')} AS tx, {r6('mv - ac / sp * mx - al / sp * my')} AS ty FROM i""")
def consensus_affine_fit(spark, folder):
    fit = geometry.consensus_similarity(_matches(spark, folder), "vec_id", 0.01)
    return fit.withColumns({c: S.rounded(c) for c in ("a", "b", "tx", "ty")})
