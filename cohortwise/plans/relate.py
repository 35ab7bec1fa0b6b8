"""Joins and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortwise.functions import scalars as S
from cohortwise.functions.seeded import uniform
from cohortwise.functions.vectors import as_double
from cohortwise.operators import aggregates as A
from cohortwise.operators import evaluate, features
from cohortwise.plans import data
from cohortwise.plans.prepare import rule_metrics
from cohortwise.plans.registry import query, r6, sql_uniform
from cohortwise.sources.tables import table


@query("left_join_multi_key", """
SELECT ps.l_partkey, ps.l_suppkey, ps.n, rf.returned FROM
  (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) ps
  LEFT JOIN (SELECT l_partkey, l_suppkey, count(*) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) rf
  ON ps.l_partkey = rf.l_partkey AND ps.l_suppkey = rf.l_suppkey""")
def left_join_multi_key(spark, folder):
    items = table(spark, folder, "lineitem")
    keys = ["l_partkey", "l_suppkey"]
    sold = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    returned = items.filter("l_returnflag = 'R'").groupBy(*keys).agg(F.count(F.lit(1)).alias("returned"))
    return features.left_join(sold, returned, keys)


@query("left_join_registration", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, o_orderpriority FROM lineitem
  LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey""")
def left_join_registration(spark, folder):
    orders = table(spark, folder, "orders").filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority"
    )
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return features.left_join(items, orders, ["l_orderkey"])


@query("left_join_dimension", """
SELECT c_custkey, c_nationkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey""")
def left_join_dimension(spark, folder):
    nations = table(spark, folder, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    regions = table(spark, folder, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    joined = features.left_join(features.left_join(customers, nations, ["c_nationkey"]), regions, ["n_regionkey"])
    return joined.select("c_custkey", "c_nationkey", "n_name", "r_name")


@query("lookup_join_dropna", f"""
SELECT p_brand, count(*) AS n, {r6('sum(l_quantity)')} AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE p_brand IS NOT NULL GROUP BY p_brand""")
def lookup_join_dropna(spark, folder):
    facts = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    found = features.lookup(facts, table(spark, folder, "part"), "p_partkey", "p_brand")
    return found.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), S.rounded(F.sum("l_quantity")).alias("quantity"))


_WIDE_OUT = ", ".join(f"{r6(f'total_clicks_{k}')} AS total_clicks_{k}, active_days_{k}" for k in data.KINDS)


def _rounded_clicks(df):
    return df.withColumns({f"total_clicks_{k}": S.rounded(f"total_clicks_{k}") for k in data.KINDS})


@query("left_join_features", f"WITH {data.ACTIVITY_SQL} SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, {_WIDE_OUT} FROM joined")
def left_join_features(spark, folder):
    return _rounded_clicks(data.customer_activity(spark, folder))


@query("activity_aggregate", f"WITH {data.ACTIVITY_SQL} SELECT user_id AS c_custkey, event_type, {r6('total_clicks')} AS total_clicks, active_days FROM act")
def activity_aggregate(spark, folder):
    totals = features.activity_totals(data.activity_log(spark, folder), ["c_custkey"], "event_type", "day", "value")
    return totals.withColumn("total_clicks", S.rounded("total_clicks"))


@query("activity_pivot", f"WITH {data.ACTIVITY_SQL} SELECT user_id AS c_custkey, {_WIDE_OUT} FROM wide")
def activity_pivot(spark, folder):
    return _rounded_clicks(
        features.activity_wide(data.activity_log(spark, folder), ["c_custkey"], "event_type", "day", "value", data.KINDS)
    )


@query("activity_by_brand", f"""
SELECT l_suppkey, p_brand, {r6('sum(l_quantity)')} AS total_clicks, count(DISTINCT CAST(l_shipdate AS DATE)) AS active_days
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def activity_by_brand(spark, folder):
    """Log joined to its dimension, then aggregated per entity and kind."""
    log = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), "l_suppkey", F.to_date("l_shipdate").alias("day"), "l_quantity"
    )
    found = features.lookup(log, table(spark, folder, "part"), "p_partkey", "p_brand")
    totals = features.activity_totals(found, ["l_suppkey"], "p_brand", "day", "l_quantity")
    return totals.withColumn("total_clicks", S.rounded("total_clicks"))


_VECTOR_SQL = "SELECT vec_id, label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings"


def _spread_dims(spark, folder):
    arr = as_double("embedding")
    return table(spark, folder, "embeddings").select("vec_id", "label", *[arr[i].alias(f"x{i:02d}") for i in range(64)])


_DIMS = [f"x{i:02d}" for i in range(64)]


@query("group_feature_means", f"""
WITH long AS ({_VECTOR_SQL}) SELECT label, 'x' || lpad(CAST(pos AS VARCHAR), 2, '0') AS feature, {r6('avg(x)')} AS mean FROM long GROUP BY ALL""")
def group_feature_means(spark, folder):
    means = A.group_means(_spread_dims(spark, folder), "label", _DIMS)
    return means.unpivot(["label"], _DIMS, "feature", "mean").withColumn("mean", S.rounded("mean"))


@query("group_positive_rate", f"SELECT lang, {r6('avg(quality)')} AS positive_rate FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def group_positive_rate(spark, folder):
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return A.group_positive_rate(joined, "lang", "quality").withColumn("positive_rate", S.rounded("positive_rate"))


@query("group_mode", """
SELECT l_suppkey, mode AS majority FROM (
  SELECT l_suppkey, l_linenumber AS mode, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_linenumber) AS rn
  FROM lineitem GROUP BY l_suppkey, l_linenumber) WHERE rn = 1""")
def group_mode(spark, folder):
    return A.group_mode(table(spark, folder, "lineitem"), "l_suppkey", "l_linenumber", "majority")


@query("between_group_spread", f"""
WITH long AS ({_VECTOR_SQL}), m AS (SELECT label, pos, avg(x) AS x FROM long GROUP BY ALL)
SELECT 'x' || lpad(CAST(pos AS VARCHAR), 2, '0') AS feature, {r6('stddev_pop(x)')} AS importance FROM m GROUP BY pos""")
def between_group_spread(spark, folder):
    means = A.group_means(_spread_dims(spark, folder), "label", _DIMS)
    return A.between_group_spread(means, "label", _DIMS).withColumn("importance", S.rounded("importance"))


@query("channel_stats", f"""
WITH long AS (SELECT vec_id, pos // 16 AS channel, x FROM ({_VECTOR_SQL})),
item AS (SELECT vec_id, channel, avg(x) AS m, stddev_samp(x) AS s FROM long GROUP BY ALL)
SELECT channel, {r6('avg(m)')} AS mean, {r6('avg(s)')} AS std FROM item GROUP BY channel""")
def channel_stats(spark, folder):
    stats = A.channel_stats(table(spark, folder, "embeddings"), "embedding", 4, 16)
    return stats.withColumns({c: S.rounded(c) for c in ("mean", "std")})


@query("prediction_histogram", """
SELECT c::INT AS prediction, coalesce(n, 0) AS n FROM (SELECT unnest(range(12)) AS c)
LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) ON c = label""")
def prediction_histogram(spark, folder):
    """Twelve listed classes over data with ten: the last two show as zero."""
    return A.class_histogram(table(spark, folder, "embeddings").withColumnRenamed("label", "prediction"), "prediction", 12)


_NAMES = ["Accuracy", "Precision", "Recall", "F1", "ROC AUC"]


@query("long_to_wide", f"WITH {data.METRICS_SQL} SELECT model, "
       + ", ".join(f"{r6(f'max(value) FILTER (metric = {chr(39)}{m}{chr(39)})')} AS \"{m}\"" for m in _NAMES) + " FROM met GROUP BY model")
def long_to_wide(spark, folder):
    wide = evaluate.long_to_wide(rule_metrics(spark, folder))
    return wide.withColumns({m: S.rounded(m) for m in _NAMES})


@query("best_per_metric", f"""
WITH {data.METRICS_SQL} SELECT metric, {r6('value')} AS value, model FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, model) AS rn FROM met WHERE value IS NOT NULL) WHERE rn = 1""")
def best_per_metric(spark, folder):
    return evaluate.best_per_metric(rule_metrics(spark, folder)).withColumn("value", S.rounded("value"))


@query("overall_score", f"WITH {data.METRICS_SQL} SELECT model, {r6('avg(value)')} AS overall FROM met GROUP BY model")
def overall_score(spark, folder):
    return evaluate.overall_score(rule_metrics(spark, folder)).withColumn("overall", S.rounded("overall"))


@query("masked_mean", f"""
SELECT event_type, {r6('avg(value * CASE WHEN value >= 40 THEN 1 ELSE 0 END)')} AS masked_loss,
  {r6('avg(CASE WHEN value >= 40 THEN 1.0 ELSE 0.0 END)')} AS mask_rate FROM events GROUP BY event_type""")
def masked_mean(spark, folder):
    means = table(spark, folder, "events").groupBy("event_type").agg(*A.masked_mean(F.col("value"), F.col("value") >= 40))
    return means.withColumns({c: S.rounded(c) for c in ("masked_loss", "mask_rate")})


@query("distinct_values", "SELECT DISTINCT o_orderpriority FROM orders")
def distinct_values(spark, folder):
    return A.distinct_sorted(table(spark, folder, "orders"), "o_orderpriority")


def two_sources(spark, folder):
    """Two measured sources on the same kind of key: a seeded half of the events each."""
    cells = table(spark, folder, "events").withColumn("source", (uniform("source", "event_id") >= 0.5).cast("int"))
    grid = cells.groupBy("source", "user_id", F.unix_date(F.to_date("ts")).cast("bigint").alias("day")).agg(
        F.round(F.avg("value"), 6).alias("level"), F.count(F.lit(1)).cast("double").alias("weight")
    )
    return [grid.filter(F.col("source") == i).drop("source") for i in (0, 1)]


_SOURCES_SQL = f"""
cells AS (
  SELECT CASE WHEN {sql_uniform('source', 'event_id')} >= 0.5 THEN 1 ELSE 0 END AS source, user_id,
    date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))::BIGINT AS day, round(avg(value), 6) AS level, count(*)::DOUBLE AS weight
  FROM events GROUP BY ALL),
a AS (SELECT * FROM cells WHERE source = 0), b AS (SELECT * FROM cells WHERE source = 1)"""


@query("overlap_blend_join", f"""
WITH {_SOURCES_SQL}
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS day, (a.level IS NOT NULL AND b.level IS NOT NULL) AS overlap,
  {r6('CASE WHEN a.level IS NOT NULL AND b.level IS NOT NULL THEN a.level * a.weight / (a.weight + b.weight + 0.00001::DOUBLE) + b.level * b.weight / (a.weight + b.weight + 0.00001::DOUBLE) ELSE coalesce(a.level, b.level) END')} AS level
FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.day = b.day""")
def overlap_blend_join(spark, folder):
    first, second = two_sources(spark, folder)
    return A.overlap_blend(first, second, ["user_id", "day"], "level", "weight").withColumn("level", S.rounded("level"))


@query("gain_calibration", f"""
WITH {_SOURCES_SQL},
g AS (SELECT (avg(a.level) + 0.00001::DOUBLE) / (avg(b.level) + 0.00001::DOUBLE) AS gain FROM a JOIN b ON a.user_id = b.user_id AND a.day = b.day)
SELECT user_id, day, {r6('greatest(0.0, least(255.0, level * gain))')} AS level FROM b, g""")
def gain_calibration(spark, folder):
    first, second = two_sources(spark, folder)
    return A.gain_calibrate(first, second, ["user_id", "day"], "level").select("user_id", "day", S.rounded("level").alias("level"))
