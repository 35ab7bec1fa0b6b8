"""Evaluation tables and attributions."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pyspark.sql import functions as F

from cohortwise.functions import scalars as S
from cohortwise.functions.vectors import as_double, euclidean, softmax
from cohortwise.operators import evaluate, explain, models, sampling
from cohortwise.operators.neighbors import knn_classify
from cohortwise.plans import data
from cohortwise.plans.prepare import rule_metrics
from cohortwise.plans.registry import query, r6, sql_hash, sql_uniform
from cohortwise.session import materialize
from cohortwise.sources.tables import table


def _variety(spark, folder):
    return data.rule_predictions(spark, folder).filter("model = 'Variety'")


@query("confusion_matrix", f"""
WITH {data.RULES_SQL}, c AS (SELECT unnest([0, 1]) AS c)
SELECT a.c AS label, b.c AS prediction, (SELECT count(*) FROM pred WHERE model = 'Variety' AND label = a.c AND prediction = b.c) AS n FROM c a, c b""")
def confusion_matrix(spark, folder):
    return evaluate.confusion_matrix(_variety(spark, folder), "label", "prediction")


@query("binary_metrics", f"WITH {data.METRICS_SQL} SELECT metric, {r6('value')} AS value FROM met WHERE model = 'Variety' AND metric <> 'ROC AUC'")
def binary_metrics(spark, folder):
    return evaluate.binary_metrics(_variety(spark, folder), "label", "prediction").withColumn("value", S.rounded("value"))


@query("roc_auc", f"WITH {data.METRICS_SQL} SELECT model, {r6('value')} AS roc_auc FROM met WHERE metric = 'ROC AUC'")
def roc_auc(spark, folder):
    areas = evaluate.roc_auc(data.rule_predictions(spark, folder), "label", "score", by=("model",))
    return areas.withColumn("roc_auc", S.rounded("roc_auc"))


@query("roc_curve", f"""
WITH {data.RULES_SQL}, v AS (SELECT * FROM pred WHERE model = 'Variety'),
g AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM v GROUP BY score)
SELECT score AS threshold, {r6('sum(n) OVER w / (SELECT sum(n) FROM g)')} AS fpr, {r6('sum(p) OVER w / (SELECT sum(p) FROM g)')} AS tpr
FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""")
def roc_curve(spark, folder):
    curve = evaluate.roc_curve(_variety(spark, folder), "label", "score")
    return curve.withColumns({c: S.rounded(c) for c in ("fpr", "tpr")})


@query("model_comparison", f"""
WITH {data.METRICS_SQL}, best AS (SELECT metric, model FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, model) AS rn FROM met WHERE value IS NOT NULL) WHERE rn = 1),
o AS (SELECT model, avg(value) AS overall FROM met GROUP BY model)
SELECT met.model, met.metric, {r6('value')} AS value, {r6('overall')} AS overall, (met.model = best.model) AS is_best,
  (met.model = (SELECT model FROM o ORDER BY overall DESC, model LIMIT 1)) AS is_overall_best
FROM met JOIN best USING (metric) JOIN o ON o.model = met.model""")
def model_comparison(spark, folder):
    """All models' metrics with each metric's winner and the overall one."""
    metrics = rule_metrics(spark, folder)
    best = evaluate.best_per_metric(metrics).select("metric", F.col("model").alias("winner"))
    overall = evaluate.overall_score(metrics)
    leader = overall.orderBy(F.col("overall").desc(), "model").limit(1).select("model").scalar()
    return (
        metrics.join(best, "metric").join(overall, "model").withColumn("leader", leader)
        .select("model", "metric", S.rounded("value").alias("value"), S.rounded("overall").alias("overall"),
                (F.col("model") == F.col("winner")).alias("is_best"), (F.col("model") == F.col("leader")).alias("is_overall_best"))
    )


_SPLIT_SQL = f"""
split AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, rn <= ceil(0.2::DOUBLE * cnt) AS test FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {sql_hash(42, 'vec_id')}) AS rn, count(*) OVER (PARTITION BY label) AS cnt FROM embeddings))"""

KNN_SQL = f"""{_SPLIT_SQL},
near AS (SELECT q.vec_id AS qid, q.label AS qlabel, t.vec_id AS tid, t.label AS tlabel,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.v, t.v), 6), t.vec_id) AS rn,
  round(list_distance(q.v, t.v), 6) AS dist FROM split q, split t WHERE q.test AND NOT t.test),
votes AS (SELECT qid, qlabel, tlabel, count(*) AS c FROM near WHERE rn <= 3 GROUP BY ALL),
said AS (SELECT qid AS vec_id, qlabel AS label, tlabel AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, tlabel) AS r FROM votes) WHERE r = 1)"""


def split_vectors(spark, folder):
    """Embeddings cut 80 to 20 within each class."""
    cut = sampling.stratified_split(table(spark, folder, "embeddings"), "label", "vec_id")
    return cut.filter("split = 'train'").drop("split"), cut.filter("split = 'test'").drop("split")


def knn_predictions(spark, folder):
    train, test = split_vectors(spark, folder)
    return knn_classify(train, test, "vec_id", "embedding", "label")


@query("classification_report", f"""
WITH {KNN_SQL},
cls AS (SELECT label AS c FROM said UNION SELECT prediction FROM said),
per AS (SELECT c, count(*) FILTER (label = c AND prediction = c) AS tp, count(*) FILTER (prediction = c) AS sd, count(*) FILTER (label = c) AS rl
  FROM cls, said GROUP BY c),
m AS (SELECT CAST(c AS VARCHAR) AS name, CASE WHEN sd > 0 THEN tp::DOUBLE / sd ELSE 0 END AS p, CASE WHEN rl > 0 THEN tp::DOUBLE / rl ELSE 0 END AS r,
  CASE WHEN sd + rl > 0 THEN 2.0::DOUBLE * tp / (sd + rl) ELSE 0 END AS f, rl, tp FROM per)
SELECT name, {r6('p')} AS precision, {r6('r')} AS recall, {r6('f')} AS f1, rl AS support FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, {r6('sum(tp) / sum(rl)')}, sum(rl)::BIGINT FROM m
UNION ALL SELECT 'macro avg', {r6('avg(p)')}, {r6('avg(r)')}, {r6('avg(f)')}, sum(rl)::BIGINT FROM m
UNION ALL SELECT 'weighted avg', {r6('sum(p * rl) / sum(rl)')}, {r6('sum(r * rl) / sum(rl)')}, {r6('sum(f * rl) / sum(rl)')}, sum(rl)::BIGINT FROM m""")
def classification_report(spark, folder):
    report = evaluate.classification_report(knn_predictions(spark, folder), "label", "prediction")
    return report.withColumns({c: S.rounded(c) for c in ("precision", "recall", "f1")})


CENTROID_SQL = """
cent AS (SELECT label AS c, list(m ORDER BY pos) AS m FROM (
  SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL) GROUP BY label)"""

LOGITS_SQL = f"""{CENTROID_SQL},
logit AS (SELECT vec_id, label, list(round(-list_distance(embedding::DOUBLE[], m), 6) ORDER BY c) AS z FROM embeddings, cent GROUP BY vec_id, label),
prob AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda y: exp(y - list_max(z))))) AS p FROM logit)"""


def class_logits(spark, folder):
    """Score of every class for every vector: minus the distance to the class mean."""
    vectors = table(spark, folder, "embeddings")
    centers = models.mean_centroids(vectors, "embedding", "label").agg(
        F.array_sort(F.collect_list(F.struct("label", "center"))).alias("cs")
    )
    held = vectors.select("vec_id", "label", as_double("embedding").alias("v")).withColumn("cs", centers.scalar())
    return held.select("vec_id", "label", F.transform("cs", lambda s: F.round(-euclidean(F.col("v"), s["center"]), 6)).alias("logits"))


@query("topk_accuracy", f"""
WITH {LOGITS_SQL}, r AS (SELECT len(list_filter(range(1, 11), lambda i: z[i] > z[label + 1] OR (z[i] = z[label + 1] AND i < label + 1))) AS ahead FROM logit)
SELECT 'top1' AS metric, {r6('avg(CASE WHEN ahead < 1 THEN 100.0 ELSE 0.0 END)')} AS value FROM r
UNION ALL SELECT 'top5', {r6('avg(CASE WHEN ahead < 5 THEN 100.0 ELSE 0.0 END)')} FROM r""")
def topk_accuracy(spark, folder):
    return evaluate.topk_accuracy(class_logits(spark, folder), "label", "logits", [1, 5]).withColumn("value", S.rounded("value"))


@query("cross_entropy_loss", f"""
WITH {LOGITS_SQL}
SELECT {r6('avg(-ln(p[label + 1]))')} AS loss,
  {r6('avg(-list_sum(list_transform(range(1, 11), lambda i: ln(p[i]) * (0.05::DOUBLE + CASE WHEN i = label + 1 THEN 0.5::DOUBLE ELSE 0 END))))')} AS soft_loss FROM prob""")
def cross_entropy_loss(spark, folder):
    """Hard labels, and soft targets giving half the weight to the label."""
    logits = class_logits(spark, folder)
    target = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.lit(0.05) + F.when(i == F.col("label"), 0.5).otherwise(0.0))
    return logits.agg(
        S.rounded(F.avg(evaluate.cross_entropy(F.col("logits"), F.col("label")))).alias("loss"),
        S.rounded(F.avg(evaluate.soft_cross_entropy(F.col("logits"), target))).alias("soft_loss"),
    )


@query("softmax_argmax", f"""
WITH {LOGITS_SQL},
t AS (SELECT vec_id, list_transform(z, lambda x: exp((x - list_max(z)) / 0.5::DOUBLE)) AS w FROM logit)
SELECT vec_id, {r6('list_max(w) / list_sum(w)')} AS confidence, list_position(w, list_max(w)) - 1 AS prediction FROM t""")
def softmax_argmax(spark, folder):
    from cohortwise.functions.vectors import argmax

    sharp = class_logits(spark, folder).withColumn("p", softmax(F.col("logits"), 0.5))
    return sharp.select("vec_id", S.rounded(F.array_max("p")).alias("confidence"), argmax(F.col("p")).alias("prediction"))


# Weights of the linear scorer whose attributions are shown.
WEIGHTS = {"n_chars": 0.0005, "variety": 2.0, "digit_share": -3.0, "upper_share": 1.5, "mean_word": 0.25, "line_variety": -1.0}

_ATTRIBUTION_SQL = f"""{data.DOCUMENT_SQL},
mean AS (SELECT {", ".join(f"avg({c}) AS m_{c}" for c in WEIGHTS)} FROM feat),
attr AS ({" UNION ALL ".join(f"SELECT doc_id, '{c}' AS feature, {c} AS value, {w}::DOUBLE * ({c} - m_{c}) AS attribution FROM feat, mean" for c, w in WEIGHTS.items())})"""


def linear_attributions(spark, folder):
    return explain.linear_attribution(data.document_features(spark, folder), "doc_id", WEIGHTS)


@query("linear_attribution", f"WITH {_ATTRIBUTION_SQL} SELECT feature, {r6('avg(abs(attribution))')} AS mean_abs FROM attr GROUP BY feature")
def linear_attribution(spark, folder):
    return explain.mean_abs(linear_attributions(spark, folder)).withColumn("mean_abs", S.rounded("mean_abs"))


@query("attribution_dependence", f"""
WITH {_ATTRIBUTION_SQL}, top AS (SELECT feature FROM attr GROUP BY feature ORDER BY avg(abs(attribution)) DESC, feature LIMIT 3)
SELECT doc_id, feature, {r6('value')} AS value, {r6('attribution')} AS attribution FROM attr WHERE feature IN (SELECT feature FROM top)""")
def attribution_dependence(spark, folder):
    pairs = explain.dependence(linear_attributions(spark, folder), "doc_id", 3)
    return pairs.withColumns({c: S.rounded(c) for c in ("value", "attribution")})


class LinearScorer:
    """A score that is a weighted sum of columns, with the face of a fitted model."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def transform(self, df):
        score = sum((F.lit(w) * F.col(c) for c, w in self.weights.items()), F.lit(0.0))
        return df.withColumn("_score", score)


@query("sampled_shapley_linear", f"""
WITH {data.DOCUMENT_SQL}, bg AS (SELECT row_number() OVER (ORDER BY {sql_hash('42bg', 'doc_id')}, doc_id) AS place, * FROM feat), n AS (SELECT count(*) AS n FROM feat),
drawn AS (SELECT doc_id, p, floor({sql_uniform('42draw', 'doc_id', 'p')} * 1073741824)::BIGINT % n + 1 AS place FROM feat, n, range(1, 17) t(p)),
mean AS (SELECT d.doc_id, {", ".join(f"avg(b.{c}) AS m_{c}" for c in WEIGHTS)} FROM drawn d JOIN bg b USING (place) GROUP BY d.doc_id)
{" UNION ALL ".join(f"SELECT f.doc_id, '{c}' AS feature, round({w}::DOUBLE * (f.{c} - m_{c}), 9) + 0.0::DOUBLE AS attribution FROM feat f JOIN mean m USING (doc_id)" for c, w in WEIGHTS.items())}""")
def sampled_shapley_linear(spark, folder):
    """Sampled attributions of a linear score, which have a closed form, against all documents as background."""
    frame = materialize(data.document_features(spark, folder), "frame")
    found = explain.sampled_shapley(LinearScorer(WEIGHTS), frame, frame, "doc_id", list(WEIGHTS), score=lambda df: df)
    return found.select("doc_id", "feature", (F.round("attribution", 9) + F.lit(0.0)).alias("attribution"))


@query("sampled_shapley")
def sampled_shapley(spark, folder):
    """Attributions of a fitted forest for a thousand sampled documents against a sampled background."""
    from cohortwise.plans.learning import document_model

    model, frame = document_model(spark, folder)
    rows = sampling.seeded_sample(frame, "doc_id", 1000)
    background = sampling.seeded_sample(frame, "doc_id", 100, seed="background")
    return explain.sampled_shapley(model, rows, background, "doc_id", data.TEXT_FEATURES)


@query("kernel_attribution_linear", f"""
WITH {data.DOCUMENT_SQL}, bg AS (SELECT * FROM feat ORDER BY {sql_hash('background', 'doc_id')}, doc_id LIMIT 20),
mean AS (SELECT {", ".join(f"avg({c}) AS m_{c}" for c in WEIGHTS)} FROM bg),
ends AS (SELECT doc_id, {" + ".join(f"{w}::DOUBLE * m_{c}" for c, w in WEIGHTS.items())} AS base, {" + ".join(f"{w}::DOUBLE * {c}" for c, w in WEIGHTS.items())} AS score FROM feat, mean)
{" UNION ALL ".join(f"SELECT doc_id, '{c}' AS feature, {r6(f'{w}::DOUBLE * (f.{c} - m_{c})')} AS attribution, {r6('base')} AS base, {r6('score')} AS score FROM feat f JOIN ends USING (doc_id), mean" for c, w in WEIGHTS.items())}""")
def kernel_attribution_linear(spark, folder):
    """Attributions over all coalitions of a linear score, which have a closed form, for every labelled document against twenty drawn ones."""
    frame = materialize(data.document_features(spark, folder), "frame")
    drawn = sampling.seeded_sample(frame, "doc_id", 20, seed="background")
    found = explain.kernel_attributions(LinearScorer(WEIGHTS), frame, drawn, "doc_id", list(WEIGHTS), score=lambda df: df)
    return found.select("doc_id", "feature", *[S.rounded(c).alias(c) for c in ("attribution", "base", "score")])


# A small tree over three text features; a node is (feature, threshold, rows, left, right) or (rows, value).
TREE_COLS = ["n_chars", "variety", "digit_share"]
TREE = ("n_chars", 500.0, 100, ("variety", 0.7, 60, (20, 0.9), (40, 0.2)), ("digit_share", 0.01, 40, (30, 0.7), ("n_chars", 2000.0, 10, (4, 0.4), (6, 0.1))))


def tree_table(node) -> dict:
    """The nested nodes as arrays, the root first."""
    out = {c: [] for c in ("left", "right", "feature", "threshold", "cover", "value")}

    def add(n) -> int:
        at = len(out["left"])
        for c, v in zip(out, (-1, -1, 0, 0.0, n[0] if len(n) == 2 else n[2], n[1] if len(n) == 2 else 0.0)):
            out[c].append(v)
        if len(n) == 5:
            out["feature"][at], out["threshold"][at] = TREE_COLS.index(n[0]), n[1]
            out["left"][at], out["right"][at] = add(n[3]), add(n[4])
        return at

    add(node)
    return out


def _tree_sql(node, known: frozenset) -> str:
    """The tree's value if only some features are known."""
    if len(node) == 2:
        return f"{node[1]}::DOUBLE"
    feature, cut, rows, left, right = node
    parts = [_tree_sql(n, known) for n in (left, right)]
    if feature in known:
        return f"CASE WHEN {feature} <= {cut}::DOUBLE THEN {parts[0]} ELSE {parts[1]} END"
    covers = [n[0] if len(n) == 2 else n[2] for n in (left, right)]
    return f"(({covers[0]}::DOUBLE * {parts[0]} + {covers[1]}::DOUBLE * {parts[1]}) / {rows}::DOUBLE)"


def _shapley_sql(feature: str) -> str:
    """The definition: the weighted mean change over all subsets of the other features."""
    others = [c for c in TREE_COLS if c != feature]
    terms = []
    for subset in (frozenset(s) for k in range(len(others) + 1) for s in combinations(others, k)):
        weight = factorial(len(subset)) * factorial(len(others) - len(subset)) / factorial(len(TREE_COLS))
        terms.append(f"{weight}::DOUBLE * ({_tree_sql(TREE, subset | {feature})} - {_tree_sql(TREE, subset)})")
    return " + ".join(terms)


@query("tree_attribution", f"WITH {data.DOCUMENT_SQL} " + " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS feature, {r6(_shapley_sql(c))} AS attribution, {r6(_tree_sql(TREE, frozenset()))} AS base, {r6(_tree_sql(TREE, frozenset(TREE_COLS)))} AS score FROM feat"
    for c in TREE_COLS))
def tree_attribution(spark, folder):
    """Exact attributions of a small tree for every labelled document; the SQL lists all subsets."""
    found = explain.tree_attributions(data.document_features(spark, folder), [tree_table(TREE)], "doc_id", TREE_COLS)
    return found.select("doc_id", "feature", *[S.rounded(c).alias(c) for c in ("attribution", "base", "score")])
