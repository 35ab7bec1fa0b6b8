"""Splits, running statistics, sorts, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortwise.functions import scalars as S
from cohortwise.operators import evaluate, ordering, sampling, sequence
from cohortwise.plans import data
from cohortwise.plans.prepare import rule_metrics
from cohortwise.plans.registry import query, r6, sql_hash
from cohortwise.session import materialize
from cohortwise.sources.tables import table


@query("positional_class_split", """
SELECT vec_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 9 THEN 'train' ELSE 'test' END AS split FROM embeddings""")
def positional_class_split(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "label")
    return sampling.positional_class_split(vectors, "label", "vec_id", 9)


@query("positional_class_split_hot", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CASE WHEN row_number() OVER (
  PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) <= 5000 THEN 'train' ELSE 'test' END AS split FROM lineitem""")
def positional_class_split_hot(spark, folder):
    """Three classes, each a third of the largest table; ties of the order key are broken by further columns."""
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return sampling.positional_class_split(items, "l_returnflag", "l_orderkey", 5000, ties=("l_linenumber", "l_partkey", "l_suppkey"))


@query("positional_class_split_missing", """
SELECT doc_id, quality, CASE WHEN quality IS NULL THEN 'unlabeled' WHEN row_number() OVER (PARTITION BY quality ORDER BY doc_id) <= 20 THEN 'train' ELSE 'test' END AS split
FROM documents LEFT JOIN labels USING (doc_id)""")
def positional_class_split_missing(spark, folder):
    return sampling.positional_class_split(_some_labeled(spark, folder), "quality", "doc_id", 20)


def _some_labeled(spark, folder):
    """All documents; those without a label have a null one."""
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return table(spark, folder, "documents").select("doc_id").join(labels, "doc_id", "left")


def _labeled_sql(order: str) -> str:
    return (f"SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {order}) AS rn, "
            "count(*) OVER (PARTITION BY label) AS cnt FROM embeddings")


@query("labeled_unlabeled_split", f"""
SELECT vec_id, label, CASE WHEN rn <= 10 THEN 'labeled' WHEN rn > cnt - 10 THEN 'validation' ELSE 'unlabeled' END AS part
FROM ({_labeled_sql(sql_hash(42, 'vec_id'))})""")
def labeled_unlabeled_split(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "label")
    return sampling.labeled_split(vectors, "label", "vec_id", 10, validation=10)


@query("labeled_overlap_split", f"""
WITH r AS ({_labeled_sql(sql_hash(42, 'vec_id'))})
SELECT vec_id, label, 'labeled' AS part FROM r WHERE rn <= 4 UNION ALL SELECT vec_id, label, 'unlabeled' FROM r""")
def labeled_overlap_split(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "label")
    return sampling.labeled_split(vectors, "label", "vec_id", 4, overlap=True)


@query("labeled_split_missing", f"""
WITH r AS (SELECT doc_id, quality, row_number() OVER w AS rn, count(*) OVER (PARTITION BY quality) AS cnt
  FROM documents LEFT JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY quality ORDER BY {sql_hash(42, 'doc_id')}))
SELECT doc_id, quality, CASE WHEN quality IS NULL THEN 'unlabeled' WHEN rn <= 10 THEN 'labeled' WHEN rn > cnt - 5 THEN 'validation' ELSE 'unlabeled' END AS part FROM r""")
def labeled_split_missing(spark, folder):
    """Rows without a label are the unlabelled ones to begin with."""
    return sampling.labeled_split(_some_labeled(spark, folder), "quality", "doc_id", 10, validation=5)


@query("labeled_split_large", f"""
SELECT o_orderkey, o_orderstatus, CASE WHEN rn <= 2500 THEN 'labeled' WHEN rn > cnt - 1500 THEN 'validation' ELSE 'unlabeled' END AS part FROM (
  SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {sql_hash(42, 'o_orderkey')}) AS rn,
    count(*) OVER (PARTITION BY o_orderstatus) AS cnt FROM orders)""")
def labeled_split_large(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.labeled_split(orders, "o_orderstatus", "o_orderkey", 2500, validation=1500)


@query("stratified_split_missing", f"""
WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {sql_hash(42, 'doc_id')}) AS rn, count(*) OVER (PARTITION BY quality) AS cnt
  FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, quality, CASE WHEN quality IS NULL THEN 'unlabeled' WHEN rn <= ceil(0.2::DOUBLE * cnt) THEN 'test' ELSE 'train' END AS split FROM r""")
def stratified_split_missing(spark, folder):
    return sampling.stratified_split(_some_labeled(spark, folder), "quality", "doc_id")


def _stratified_sql(tbl: str, key: str, label: str) -> str:
    return f"""
SELECT {key}, {label}, CASE WHEN rn <= ceil(0.2::DOUBLE * cnt) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT {key}, {label}, row_number() OVER (PARTITION BY {label} ORDER BY {sql_hash(42, key)}) AS rn,
    count(*) OVER (PARTITION BY {label}) AS cnt FROM {tbl})"""


@query("stratified_split", _stratified_sql("labels", "doc_id", "quality"))
def stratified_split(spark, folder):
    return sampling.stratified_split(table(spark, folder, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query("stratified_split_orders", _stratified_sql("orders", "o_orderkey", "o_orderstatus"))
def stratified_split_orders(spark, folder):
    """Each class holds a third of the rows."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.stratified_split(orders, "o_orderstatus", "o_orderkey")


@query("weighted_running_mean", f"""
WITH {data.DAILY_SQL}
SELECT event_type, day, {r6('mean')} AS val, {r6('sum(mean * n) OVER w')} AS running_sum, (sum(n) OVER w)::BIGINT AS running_count,
  {r6('sum(mean * n) OVER w / sum(n) OVER w')} AS running_avg
FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING)""")
def weighted_running_mean(spark, folder):
    meter = sequence.weighted_running_mean(data.daily_series(spark, folder), "event_type", "day", "mean", "n")
    return meter.withColumns({c: S.rounded(c) for c in ("val", "running_sum", "running_avg")})


@query("weighted_running_mean_events", f"""
SELECT event_type, ts, event_id, {r6('value')} AS val, round(sum(value * sqrt(value + 1)) OVER w, 3) AS running_sum, round(sum(sqrt(value + 1)) OVER w, 3) AS running_count,
  {r6('sum(value * sqrt(value + 1)) OVER w / sum(sqrt(value + 1)) OVER w')} AS running_avg
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def weighted_running_mean_events(spark, folder):
    """Along the raw events, a step each; larger values weigh more."""
    events = table(spark, folder, "events").select("event_type", "ts", "event_id", "value", F.sqrt(F.col("value") + 1).alias("n"))
    meter = sequence.weighted_running_mean(events, "event_type", ["ts", "event_id"], "value", "n")
    sums = {c: F.round(c, 3) for c in ("running_sum", "running_count")}
    return meter.withColumns(sums | {c: S.rounded(c) for c in ("val", "running_avg")})


@query("running_best_events", f"""
WITH p AS (SELECT event_type, ts, event_id, value, greatest(0.0, coalesce(max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS p FROM events)
SELECT event_type, ts, event_id, {r6('value')} AS value, {r6('greatest(p, value)')} AS best, value > p AS is_best FROM p""")
def running_best_events(spark, folder):
    best = sequence.running_best(table(spark, folder, "events").select("event_type", "ts", "event_id", "value"), "event_type", ["ts", "event_id"], "value")
    return best.withColumns({c: S.rounded(c) for c in ("value", "best")})


@query("trailing_mean_events", f"""
SELECT user_id, ts, event_id, {r6('value')} AS value, {r6('avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING)')} AS trailing_mean FROM events""")
def trailing_mean_events(spark, folder):
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "value")
    mean = sequence.trailing_mean(events, "user_id", ["ts", "event_id"], "value", block=50)
    return mean.withColumns({c: S.rounded(c) for c in ("value", "trailing_mean")})


@query("running_best", f"""
WITH {data.DAILY_SQL}, prev AS (SELECT *, greatest(0.0, coalesce(max(total) OVER (PARTITION BY event_type ORDER BY day
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS p FROM daily)
SELECT event_type, day, {r6('total')} AS total, {r6('greatest(p, total)')} AS best, total > p AS is_best FROM prev""")
def running_best(spark, folder):
    best = sequence.running_best(data.daily_series(spark, folder), "event_type", "day", "total")
    return best.withColumns({c: S.rounded(c) for c in ("total", "best")})


@query("trailing_mean_20", f"""
WITH {data.DAILY_SQL}
SELECT event_type, day, {r6('total')} AS total, {r6('avg(total) OVER (PARTITION BY event_type ORDER BY day ROWS 19 PRECEDING)')} AS trailing_mean FROM daily""")
def trailing_mean_20(spark, folder):
    mean = sequence.trailing_mean(data.daily_series(spark, folder), "event_type", "day", "total")
    return mean.withColumns({c: S.rounded(c) for c in ("total", "trailing_mean")})


@query("ema_smooth", f"""
WITH RECURSIVE {data.DAILY_SQL},
pos AS (SELECT event_type, day, total, row_number() OVER (PARTITION BY event_type ORDER BY day) AS k FROM daily),
ema AS (
  SELECT event_type, day, total, k, total AS e FROM pos WHERE k = 1
  UNION ALL
  SELECT p.event_type, p.day, p.total, p.k, 0.999::DOUBLE * ema.e + (1.0::DOUBLE - 0.999::DOUBLE) * p.total FROM ema JOIN pos p
    ON p.event_type = ema.event_type AND p.k = ema.k + 1)
SELECT event_type, day, {r6('total')} AS total, {r6('e')} AS ema FROM ema""")
def ema_smooth(spark, folder):
    smooth = sequence.ema_smooth(data.daily_series(spark, folder), "event_type", "day", "total", 0.999)
    return smooth.withColumns({c: S.rounded(c) for c in ("total", "ema")})


@query("best_checkpoint", f"""
WITH {data.DAILY_SQL}
SELECT event_type, day, {r6('total')} AS total, {r6('mean')} AS mean, n FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY total DESC, day) AS rn FROM daily) WHERE rn = 1""")
def best_checkpoint(spark, folder):
    best = sequence.best_record(data.daily_series(spark, folder), "event_type", "day", "total")
    return best.withColumns({c: S.rounded(c) for c in ("total", "mean")}).select("event_type", "day", "total", "mean", "n")


@query("top_features", f"""
WITH long AS (SELECT label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, pos, avg(x) AS x FROM long GROUP BY ALL),
i AS (SELECT 'x' || lpad(CAST(pos AS VARCHAR), 2, '0') AS feature, {r6('stddev_pop(x)')} AS importance FROM m GROUP BY pos)
SELECT * FROM i ORDER BY importance DESC, feature LIMIT 10""")
def top_features(spark, folder):
    from cohortwise.plans.relate import between_group_spread

    importance = between_group_spread(spark, folder)
    return importance.orderBy(F.col("importance").desc(), "feature").limit(10)


@query("custom_order_sort", f"""
WITH {data.METRICS_SQL} SELECT model, metric, {r6('value')} AS value,
  list_position(['Words', 'Lines', 'Variety', 'Length', 'Language'], model)::BIGINT AS place FROM met WHERE metric = 'Accuracy'""")
def custom_order_sort(spark, folder):
    order = ["Words", "Lines", "Variety", "Length", "Language"]
    rows = rule_metrics(spark, folder).filter("metric = 'Accuracy'").withColumn("value", S.rounded("value"))
    placed = rows.withColumn("place", F.array_position(F.array(*[F.lit(o) for o in order]), F.col("model")).cast("bigint"))
    return evaluate.in_order(placed, "model", order).select("model", "metric", "value", "place")


@query("seeded_sample", f"SELECT event_id, user_id, event_type, value FROM events ORDER BY {sql_hash(42, 'event_id')}, event_id LIMIT 1000")
def seeded_sample(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value")
    return sampling.seeded_sample(events, "event_id", 1000)


@query("seeded_shuffle", f"SELECT event_id, row_number() OVER (ORDER BY {sql_hash(7, 'event_id')}, event_id) AS position FROM events")
def seeded_shuffle(spark, folder):
    return ordering.seeded_positions(table(spark, folder, "events").select("event_id"), "event_id", 7, "position")


@query("union_tagged", f"WITH {data.METRICS_SQL} SELECT model, metric, {r6('value')} AS value FROM met")
def union_tagged(spark, folder):
    """The single-model path: metrics of each model on its own, tagged and put together. The texts are measured once."""
    predictions = materialize(data.rule_predictions(spark, folder), "predictions")
    parts = {}
    for name in [*data.RULES, "Language"]:
        own = predictions.filter(F.col("model") == name)
        parts[name] = evaluate.model_metrics(own, "label", "prediction", *(["score"] if name in data.RULES else []))
    return evaluate.tag_union(parts).withColumn("value", S.rounded("value"))


@query("replicate_rows", f"""
WITH r AS ({_labeled_sql(sql_hash(42, 'vec_id'))}), l AS (SELECT vec_id, label FROM r WHERE rn <= 4),
f AS (SELECT ceil(64 * 10 / (SELECT count(*) FROM l)::DOUBLE)::BIGINT AS k)
SELECT vec_id, label, unnest(range(1, k + 1))::INT AS copy FROM l, f""")
def replicate_rows(spark, folder):
    """The labelled set, repeated until it fills ten batches of 64."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "label")
    labeled = sampling.labeled_split(vectors, "label", "vec_id", 4, overlap=True).filter("part = 'labeled'").drop("part")
    return sampling.replicate(labeled, sampling.expansion_factor(64, 10, labeled.count()))


@query("permutation_self_join", f"""
WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY {sql_hash('42a', 'vec_id')}, vec_id) AS rk FROM embeddings),
b AS (SELECT vec_id AS partner, row_number() OVER (ORDER BY {sql_hash('42b', 'vec_id')}, vec_id) AS rk FROM embeddings)
SELECT vec_id, partner FROM a JOIN b USING (rk)""")
def permutation_self_join(spark, folder):
    return sampling.permuted_pairs(table(spark, folder, "embeddings"), "vec_id")
