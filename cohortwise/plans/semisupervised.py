"""Semi-supervised operators on the embeddings and their distances to the class means."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortwise.functions import scalars as S
from cohortwise.functions import vectors as V
from cohortwise.operators import augment, models, sampling, semisup
from cohortwise.operators.aggregates import masked_mean
from cohortwise.operators.evaluate import cross_entropy
from cohortwise.plans.evaluation import CENTROID_SQL, split_vectors
from cohortwise.plans.registry import query, r6, sql_hash, sql_uniform
from cohortwise.plans.vectors import _PIXELS, _cut_sql, _ops_sql, _pixels, _weak_sql
from cohortwise.sources.tables import table

# How sharply distances count, and the confidence asked of a pseudo label.
SCALE, THRESHOLD, TEMPERATURE, UNLABELED_WEIGHT = 8.0, 0.4, 0.5, 75.0

_SOFT = "list_transform({z}, lambda x: exp((x - list_max({z})) / {t}::DOUBLE))"

_CUT = (f"SELECT vec_id, label, v, list_transform(range(1, 65), lambda i: CASE WHEN i - 1 >= s AND i - 1 <= least(64, s + 32) THEN 0.0::DOUBLE ELSE v[i] END) AS cut "
        f"FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v, floor(greatest(0.0::DOUBLE, {sql_uniform('viewcut', 'vec_id')} * 64 - 16.0::DOUBLE)) AS s FROM embeddings)")

VIEWS_SQL = f"""{CENTROID_SQL},
cutv AS ({_CUT}),
views AS (SELECT vec_id, label, list(round({-SCALE}::DOUBLE * list_distance(v, m), 6) ORDER BY c) AS weak,
  list(round({-SCALE}::DOUBLE * list_distance(cut, m), 6) ORDER BY c) AS strong FROM cutv, cent GROUP BY vec_id, label),
e AS (SELECT *, {_SOFT.format(z='weak', t='1.0')} AS we, {_SOFT.format(z='strong', t='1.0')} AS se FROM views),
probs AS (SELECT vec_id, label, weak, strong, list_transform(we, lambda x: x / list_sum(we)) AS pw, list_transform(se, lambda x: x / list_sum(se)) AS ps FROM e)"""


def view_logits(spark, folder):
    """Class scores of every vector as it is (weak view) and with half of it cut out (strong)."""
    vectors = table(spark, folder, "embeddings")
    centers = models.mean_centroids(vectors, "embedding", "label").agg(
        F.array_sort(F.collect_list(F.struct("label", "center"))).alias("cs")
    )
    raw = V.as_double("embedding")
    held = vectors.select(
        "vec_id", "label", raw.alias("v"), augment.cutout(raw, "view", "vec_id", fill=0.0).alias("cut")
    ).withColumn("cs", centers.scalar())
    score = lambda col: F.transform("cs", lambda s: F.round(-SCALE * V.euclidean(F.col(col), s["center"]), 6))
    return held.select("vec_id", "label", score("v").alias("weak"), score("cut").alias("strong"))


@query("sharpen", f"""
WITH {VIEWS_SQL}, w AS (SELECT vec_id, list_transform(range(1, 11), lambda i: pow((pw[i] + ps[i]) / 2, 2.0::DOUBLE)) AS q FROM probs)
SELECT vec_id, unnest(range(10)) AS pos, {r6('unnest(list_transform(q, lambda x: x / list_sum(q)))')} AS value FROM w""")
def sharpen(spark, folder):
    views = view_logits(spark, folder).select("vec_id", V.softmax(F.col("weak")).alias("a"), V.softmax(F.col("strong")).alias("b"))
    sharp = views.select("vec_id", F.posexplode(V.sharpen(F.col("a"), F.col("b"), TEMPERATURE)).alias("p", "v"))
    return sharp.select("vec_id", F.col("p").cast("bigint").alias("pos"), S.rounded("v").alias("value"))


_PSEUDO = f"""{VIEWS_SQL},
tp AS (SELECT vec_id, label, strong, {_SOFT.format(z='weak', t=TEMPERATURE)} AS w FROM views),
ps AS (SELECT vec_id, label, strong, list_max(w) / list_sum(w) AS conf, list_position(w, list_max(w)) - 1 AS pseudo FROM tp)"""


@query("pseudo_label", f"WITH {_PSEUDO} SELECT vec_id, label, {r6('conf')} AS confidence, pseudo, conf >= {THRESHOLD} AS keep FROM ps")
def pseudo_label(spark, folder):
    marked = semisup.pseudo_label(view_logits(spark, folder), "weak", TEMPERATURE, THRESHOLD)
    return marked.select("vec_id", "label", S.rounded("confidence").alias("confidence"), "pseudo", "keep")


@query("confidence_mask", f"""
WITH {_PSEUDO} SELECT {r6(f'avg(conf * CASE WHEN conf >= {THRESHOLD} THEN 1 ELSE 0 END)')} AS masked_loss,
  {r6(f'avg(CASE WHEN conf >= {THRESHOLD} THEN 1.0 ELSE 0.0 END)')} AS mask_rate FROM ps""")
def confidence_mask(spark, folder):
    probs = view_logits(spark, folder).withColumn("p", V.softmax(F.col("weak"), TEMPERATURE))
    means = probs.agg(*masked_mean(F.array_max("p"), semisup.confident("p", THRESHOLD)))
    return means.withColumns({c: S.rounded(c) for c in ("masked_loss", "mask_rate")})


_CE = "ln(list_sum(list_transform({z}, lambda x: exp(x - list_max({z}))))) + list_max({z}) - {z}[{c} + 1]"


@query("consistency_loss", f"""
WITH {_PSEUDO},
lab AS (SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY {sql_hash(42, 'vec_id')}) AS rn FROM embeddings) WHERE rn <= 10),
x AS (SELECT avg({_CE.format(z='weak', c='label')}) AS lx FROM views SEMI JOIN lab USING (vec_id)),
u AS (SELECT avg(CASE WHEN conf >= {THRESHOLD} THEN {_CE.format(z='strong', c='pseudo')} ELSE 0 END) AS lu,
  avg(CASE WHEN conf >= {THRESHOLD} THEN 1.0 ELSE 0.0 END) AS mask_rate FROM ps)
SELECT {r6('lx')} AS lx, {r6('lu')} AS lu, {r6('lx + lu')} AS loss, {r6('mask_rate')} AS mask_rate FROM x, u""")
def consistency_loss(spark, folder):
    """Ten labelled rows per class; the unlabelled side is every row, as in the overlap split."""
    cut = sampling.labeled_split(view_logits(spark, folder), "label", "vec_id", 10, overlap=True)
    loss = semisup.consistency_loss(
        cut.filter("part = 'labeled'"), cut.filter("part = 'unlabeled'"), "label", "weak", "weak", "strong", TEMPERATURE, THRESHOLD
    )
    return loss.select(*[S.rounded(c).alias(c) for c in ("lx", "lu", "loss", "mask_rate")])


@query("soft_label_l2_loss", f"""
WITH {VIEWS_SQL}
SELECT {r6('avg(-list_sum(list_transform(range(1, 11), lambda i: ln(ps[i]) * pw[i])))')} AS lx,
  {r6('avg(list_sum(list_transform(range(1, 11), lambda i: (ps[i] - pw[i]) * (ps[i] - pw[i]))) / 10)')} AS lu FROM probs""")
def soft_label_l2_loss(spark, folder):
    """The weak view's probabilities are the target of the strong view."""
    views = view_logits(spark, folder).withColumn("target", V.softmax(F.col("weak")))
    losses = semisup.soft_label_losses(views, "strong", "target", 10)
    return losses.select(S.rounded("lx").alias("lx"), S.rounded("lu").alias("lu"))


@query("per_row_loss", f"WITH {VIEWS_SQL} SELECT vec_id, {r6(_CE.format(z='weak', c='label'))} AS loss FROM views")
def per_row_loss(spark, folder):
    return view_logits(spark, folder).select("vec_id", S.rounded(cross_entropy(F.col("weak"), F.col("label"))).alias("loss"))


_SHARE = 0.75


@query("mixup", f"""
WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY {sql_hash('42a', 'vec_id')}, vec_id) AS rk FROM embeddings),
b AS (SELECT vec_id AS partner, row_number() OVER (ORDER BY {sql_hash('42b', 'vec_id')}, vec_id) AS rk FROM embeddings),
r AS (SELECT vec_id, list_concat(embedding::DOUBLE[], list_transform(range(10), lambda i: CASE WHEN i = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS v FROM embeddings),
j AS (SELECT a.vec_id, partner, x.v AS v, y.v AS w FROM a JOIN b USING (rk) JOIN r x ON x.vec_id = a.vec_id JOIN r y ON y.vec_id = partner)
SELECT vec_id, partner, unnest(range(74)) AS pos, {r6(f'unnest(list_transform(range(1, 75), lambda i: {_SHARE}::DOUBLE * v[i] + {1 - _SHARE}::DOUBLE * w[i]))')} AS value FROM j""")
def mixup(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", V.as_double("embedding").alias("v"), V.one_hot("label", 10).alias("t"))
    mixed = semisup.mixup(rows, "vec_id", "v", "t", _SHARE)
    return mixed.select("vec_id", "partner", F.posexplode(F.concat("v", "t")).alias("p", "x")).select(
        "vec_id", "partner", F.col("p").cast("bigint").alias("pos"), S.rounded("x").alias("value")
    )


def _center_logits(rows, centers, vec, name, scale):
    """Scores of the classes: minus ``scale`` times the distance to the class mean."""
    held = rows.withColumn("_cs", centers.scalar())
    score = F.transform("_cs", lambda c: F.round(-scale * V.euclidean(F.col(vec), c["center"]), 6))
    return held.withColumn(name, score).drop("_cs")


def _class_centers(rows, vec):
    return models.mean_centroids(rows, vec, "label").agg(F.array_sort(F.collect_list(F.struct("label", "center"))).alias("cs"))


MIX_ALPHA, RAMP_STEP, RAMP_LENGTH = 0.75, 3, 16
_MIX_SHARE = semisup.mixing_weight(MIX_ALPHA)
_NORMAL = lambda z: f"list_transform({_SOFT.format(z=z, t='1.0')}, lambda y: y / list_sum({_SOFT.format(z=z, t='1.0')}))"
_DISTANCES = "list(round({scale}::DOUBLE * list_distance({v}, m), 6) ORDER BY c)"
_UNLABELED_SHARE = UNLABELED_WEIGHT * semisup.ramp_up(RAMP_STEP, RAMP_LENGTH)


@query("mixmatch_step", f"""
WITH {CENTROID_SQL}, raw AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
lab AS (SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {sql_hash(42, 'vec_id')}) AS rn FROM embeddings) WHERE rn <= 4),
vx AS ({_weak_sql('raw', 'labeled')}), va AS ({_weak_sql('raw', 'view1')}), vb AS ({_weak_sql('raw', 'view2')}),
za AS (SELECT vec_id, {_DISTANCES.format(scale=-SCALE, v='v')} AS z FROM va, cent GROUP BY vec_id),
zb AS (SELECT vec_id, {_DISTANCES.format(scale=-SCALE, v='v')} AS z FROM vb, cent GROUP BY vec_id),
pa AS (SELECT vec_id, {_NORMAL('z')} AS p FROM za), pb AS (SELECT vec_id, {_NORMAL('z')} AS p FROM zb),
w AS (SELECT vec_id, list_transform(range(1, 11), lambda i: pow((pa.p[i] + pb.p[i]) / 2, {1 / TEMPERATURE}::DOUBLE)) AS q FROM pa JOIN pb USING (vec_id)),
g AS (SELECT vec_id, list_transform(q, lambda x: x / list_sum(q)) AS t FROM w),
rows AS (SELECT 'x|' || vec_id AS id, v, list_transform(range(10), lambda i: CASE WHEN i = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS t FROM vx JOIN lab USING (vec_id)
  UNION ALL SELECT 'a|' || vec_id, v, t FROM va JOIN g USING (vec_id) UNION ALL SELECT 'b|' || vec_id, v, t FROM vb JOIN g USING (vec_id)),
a AS (SELECT id, row_number() OVER (ORDER BY {sql_hash('42a', 'id')}, id) AS rk FROM rows), b AS (SELECT id AS partner, row_number() OVER (ORDER BY {sql_hash('42b', 'id')}, id) AS rk FROM rows),
mixed AS (SELECT a.id, list_transform(range(1, 65), lambda i: {_MIX_SHARE!r}::DOUBLE * x.v[i] + {1 - _MIX_SHARE!r}::DOUBLE * y.v[i]) AS v,
  list_transform(range(1, 11), lambda i: {_MIX_SHARE!r}::DOUBLE * x.t[i] + {1 - _MIX_SHARE!r}::DOUBLE * y.t[i]) AS t
  FROM a JOIN b USING (rk) JOIN rows x ON x.id = a.id JOIN rows y ON y.id = partner),
zz AS (SELECT id, t, {_DISTANCES.format(scale=-SCALE, v='v')} AS z FROM mixed, cent GROUP BY id, t),
pp AS (SELECT id, t, {_NORMAL('z')} AS p FROM zz),
l AS (SELECT avg(CASE WHEN id LIKE 'x%' THEN -list_sum(list_transform(range(1, 11), lambda i: ln(p[i]) * t[i])) END) AS lx,
  avg(CASE WHEN id NOT LIKE 'x%' THEN list_sum(list_transform(range(1, 11), lambda i: (p[i] - t[i]) * (p[i] - t[i]))) / 10 END) AS lu FROM pp)
SELECT {r6('lx')} AS lx, {r6('lu')} AS lu, {r6(f'{_UNLABELED_SHARE!r}')} AS weight, {r6(f'lx + {_UNLABELED_SHARE!r}::DOUBLE * lu')} AS loss FROM l""")
def mixmatch_step(spark, folder):
    """One step: targets guessed from two views, all rows mixed with one draw, both losses, the ramped weight."""
    vectors = table(spark, folder, "embeddings")
    raw, centers = V.as_double("embedding"), _class_centers(vectors, "embedding")
    first, second = augment.two_weak_views(raw, "vec_id")
    cut = sampling.labeled_split(vectors, "label", "vec_id", 4, overlap=True)
    labeled = cut.filter("part = 'labeled'").select("vec_id", "label", augment.weak(raw, "labeled", "vec_id").alias("view"))
    views = cut.filter("part = 'unlabeled'").select("vec_id", first.alias("first"), second.alias("second"))
    for view in ("first", "second"):
        views = _center_logits(views, centers, view, f"logits_{view}", SCALE)
    mixed = semisup.mixmatch_rows(labeled, views, "vec_id", 10, TEMPERATURE, _MIX_SHARE)
    scored = _center_logits(mixed, centers, "vec", "logits", SCALE)
    loss = semisup.mixmatch_loss(scored, "logits", "target", 10, UNLABELED_WEIGHT, RAMP_STEP, RAMP_LENGTH)
    return loss.select(*[S.rounded(c).alias(c) for c in ("lx", "lu", "weight", "loss")])


PIXEL_SCALE, CONFIDENT = 0.25, 0.95


@query("fixmatch_step", f"""
WITH {_PIXELS}, lv AS (SELECT vec_id, label, v FROM pix JOIN embeddings USING (vec_id)),
cent AS (SELECT label AS c, list(m ORDER BY pos) AS m FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS pos, unnest(v) AS x FROM lv) GROUP BY ALL) GROUP BY label),
lab AS (SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {sql_hash(42, 'vec_id')}) AS rn FROM embeddings) WHERE rn <= 4),
vx AS ({_weak_sql('pix', 'labeled')}), va AS ({_weak_sql('pix', 'weak')}),
w AS ({_weak_sql('pix', 'strong')}), o0 AS ({_ops_sql('w', 'strong', 0)}), o1 AS ({_ops_sql('o0', 'strong', 1)}), vs AS ({_cut_sql('o1', 'strong')}),
zx AS (SELECT vec_id, {_DISTANCES.format(scale=-PIXEL_SCALE, v='v')} AS weak FROM vx, cent GROUP BY vec_id),
zw AS (SELECT vec_id, {_DISTANCES.format(scale=-PIXEL_SCALE, v='v')} AS weak FROM va, cent GROUP BY vec_id),
zs AS (SELECT vec_id, {_DISTANCES.format(scale=-PIXEL_SCALE, v='v')} AS strong FROM vs, cent GROUP BY vec_id),
tp AS (SELECT vec_id, strong, {_SOFT.format(z='weak', t='1.0')} AS w FROM zw JOIN zs USING (vec_id)),
ps AS (SELECT strong, list_max(w) / list_sum(w) AS conf, list_position(w, list_max(w)) - 1 AS pseudo FROM tp),
x AS (SELECT avg({_CE.format(z='weak', c='label')}) AS lx FROM zx JOIN lab USING (vec_id)),
u AS (SELECT avg(CASE WHEN conf >= {CONFIDENT} THEN {_CE.format(z='strong', c='pseudo')} ELSE 0 END) AS lu, avg(CASE WHEN conf >= {CONFIDENT} THEN 1.0 ELSE 0.0 END) AS mask_rate FROM ps)
SELECT {r6('lx')} AS lx, {r6('lu')} AS lu, {r6('lx + lu')} AS loss, {r6('mask_rate')} AS mask_rate FROM x, u""")
def fixmatch_step(spark, folder):
    """One step: the strong view (drawn operations and cutout) against the confident pseudo label of the weak view (flip and crop)."""
    pixels = _pixels(spark, folder).join(table(spark, folder, "embeddings").select("vec_id", "label"), "vec_id")
    centers = _class_centers(pixels, "v")
    weak, strong = augment.weak_and_strong(F.col("v"), "vec_id")
    views = pixels.select("vec_id", "label", augment.weak(F.col("v"), "labeled", "vec_id").alias("vx"), weak.alias("vw"), strong.alias("vs"))
    for view, name in (("vx", "own"), ("vw", "weak"), ("vs", "strong")):
        views = _center_logits(views, centers, view, name, PIXEL_SCALE)
    cut = sampling.labeled_split(views, "label", "vec_id", 4, overlap=True)
    loss = semisup.consistency_loss(
        cut.filter("part = 'labeled'"), cut.filter("part = 'unlabeled'"), "label", "own", "weak", "strong", 1.0, CONFIDENT
    )
    return loss.select(*[S.rounded(c).alias(c) for c in ("lx", "lu", "loss", "mask_rate")])


@query("self_training")
def self_training(spark, folder):
    train, test = split_vectors(spark, folder)
    cut = sampling.labeled_split(train, "label", "vec_id", 4)
    return semisup.self_training(
        cut.filter("part = 'labeled'"), cut.filter("part = 'unlabeled'"), test, "vec_id", "embedding", "label", threshold=0.8
    )


# Budgets of 40, 250 and 4000 labels over ten classes; a class with fewer rows gives all it has.
PER_CLASS = [4, 25, 400]


@query("label_budget_sweep")
def label_budget_sweep(spark, folder):
    train, test = split_vectors(spark, folder)
    return semisup.label_budget_sweep(train, test, "vec_id", "embedding", "label", PER_CLASS, threshold=0.8)
