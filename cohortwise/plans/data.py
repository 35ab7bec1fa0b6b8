"""Derived inputs the queries share: the behaviour table, document features, rule predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.functions.scalars import binary_label, rounded
from cohortwise.operators.clean import cap_upper, columns_like
from cohortwise.operators.features import activity_wide, engagement, join_features, label_encode
from cohortwise.plans.registry import r6
from cohortwise.session import materialize
from cohortwise.sources.tables import table

# The event types, so the wide table has the same columns on any data.
KINDS = ["click", "error", "purchase", "signup", "view"]
EARLY_KINDS = ["click", "purchase", "view"]


def activity_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("c_custkey"), "event_type", F.to_date("ts").alias("day"), "value"
    )


def customer_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with their activity per event type, zero where there is none.

    Sums are rounded here, so what is derived from them does not hang on the order of adding.
    """
    wide = activity_wide(activity_log(spark, folder), ["c_custkey"], "event_type", "day", "value", KINDS)
    customers = table(spark, folder, "customer").drop("c_name")
    joined = join_features(customers, wide, ["c_custkey"])
    return joined.withColumns({c: rounded(c) for c in columns_like(joined, "total_clicks_")})


def behaviour_table(spark: SparkSession, folder: str) -> DataFrame:
    """The whole preparation: log to wide features, joined, capped, enriched, encoded, labelled.

    The joined table is written once: the quantiles and the final projection both read it, and
    the log is scanned a single time.
    """
    joined = materialize(customer_activity(spark, folder), "activity")
    measures = ["c_acctbal", *columns_like(joined, "total_clicks_", "active_days_")]
    capped = cap_upper(joined, measures).withColumns({c: rounded(c) for c in measures})
    enriched = engagement(capped, KINDS, EARLY_KINDS).withColumn(
        "at_risk", binary_label("c_mktsegment", ["FURNITURE", "MACHINERY"])
    )
    encoded, _ = label_encode(enriched, ["c_mktsegment"])
    doubles = [c for c, t in encoded.dtypes if t == "double"]
    return encoded.withColumns({c: rounded(c) for c in doubles})


def _per_kind(template: str) -> str:
    return ", ".join(template.format(k=k) for k in KINDS)


ACTIVITY_SQL = f"""
act AS (
  SELECT user_id, event_type, sum(value) AS total_clicks, count(DISTINCT CAST(ts AS DATE)) AS active_days
  FROM events GROUP BY user_id, event_type),
wide AS (
  SELECT user_id,
    {_per_kind("coalesce(sum(total_clicks) FILTER (event_type = '{k}'), 0.0::DOUBLE) AS total_clicks_{k}")},
    {_per_kind("coalesce(sum(active_days) FILTER (event_type = '{k}'), 0)::BIGINT AS active_days_{k}")}
  FROM act GROUP BY user_id),
joined AS (
  SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment,
    {", ".join(f"{r6(f'coalesce(total_clicks_{k}, 0.0::DOUBLE)')} AS total_clicks_{k}" for k in KINDS)},
    {_per_kind("coalesce(active_days_{k}, 0)::BIGINT AS active_days_{k}")}
  FROM customer LEFT JOIN wide ON c_custkey = user_id)"""

_CAPPED = ["c_acctbal"] + [f"{m}_{k}" for m in ("total_clicks", "active_days") for k in KINDS]

BEHAVIOUR_SQL = f"""
WITH {ACTIVITY_SQL},
lim AS (SELECT {", ".join(f"quantile_cont({c}::DOUBLE, 0.98) AS q_{c}" for c in _CAPPED)} FROM joined),
capped AS (
  SELECT c_custkey, c_nationkey, c_mktsegment,
    {", ".join(f"{r6(f'CASE WHEN {c} > q_{c} THEN q_{c} ELSE {c}::DOUBLE END')} AS {c}" for c in _CAPPED)}
  FROM joined, lim),
sums AS (
  SELECT *, {" + ".join(f"total_clicks_{k}" for k in KINDS)} AS tc, {" + ".join(f"active_days_{k}" for k in KINDS)} AS ad,
    ({" + ".join(f"active_days_{k} + total_clicks_{k}" for k in EARLY_KINDS)}) / {2 * len(EARLY_KINDS)} AS early
  FROM capped),
codes AS (
  SELECT c_mktsegment AS seg, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code
  FROM (SELECT DISTINCT c_mktsegment FROM customer))
SELECT c_custkey, c_nationkey, code AS c_mktsegment, {", ".join(f"{r6(c)} AS {c}" for c in _CAPPED)},
  {r6("tc")} AS overall_total_clicks, {r6("ad")} AS overall_active_days,
  {r6("CASE WHEN ad > 0 THEN tc / ad ELSE 0 END")} AS avg_daily_clicks, {r6("early")} AS early_engagement,
  CASE WHEN c_mktsegment IN ('FURNITURE', 'MACHINERY') THEN 1 ELSE 0 END AS at_risk
FROM sums JOIN codes ON c_mktsegment = seg
"""

TEXT_FEATURES = ["n_chars", "n_words", "n_lines", "variety", "digit_share", "upper_share", "mean_word", "line_variety"]


def document_features(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of the whole text of every labelled document, with its two labels."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    words, lines = F.split("text", " "), F.split("text", "\n")
    length = F.greatest(F.length("text"), F.lit(1))
    without = lambda pattern: F.length(F.regexp_replace("text", pattern, ""))
    return docs.select(
        "doc_id", "quality", "toxic", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"),
        F.size(words).cast("double").alias("n_words"), F.size(lines).cast("double").alias("n_lines"),
        (F.size(F.array_distinct(words)) / F.size(words)).alias("variety"),
        ((F.length("text") - without("[0-9]")) / length).alias("digit_share"),
        ((F.length("text") - without("[A-Z]")) / length).alias("upper_share"),
        (without(" ") / F.size(words)).alias("mean_word"),
        (F.size(F.array_distinct(lines)) / F.size(lines)).alias("line_variety"),
    )


DOCUMENT_SQL = """
feat AS (
  SELECT doc_id, quality, toxic, lang, source, n_chars::DOUBLE AS n_chars,
    len(string_split(text, ' '))::DOUBLE AS n_words, len(string_split(text, chr(10)))::DOUBLE AS n_lines,
    len(list_distinct(string_split(text, ' ')))::DOUBLE / len(string_split(text, ' ')) AS variety,
    (length(text) - length(regexp_replace(text, '[0-9]', '', 'g')))::DOUBLE / greatest(length(text), 1) AS digit_share,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::DOUBLE / greatest(length(text), 1) AS upper_share,
    length(replace(text, ' ', ''))::DOUBLE / len(string_split(text, ' ')) AS mean_word,
    len(list_distinct(string_split(text, chr(10))))::DOUBLE / len(string_split(text, chr(10))) AS line_variety
  FROM documents JOIN labels USING (doc_id))"""

# The rule models compared with each other. Name, score, and the score at which
# the rule says 1; the language rule gives no score, as a clustering gives none.
RULES = {
    "Length": ("n_chars / (n_chars + 2000)", 0.3),
    "Variety": ("variety", 0.6),
    "Lines": ("line_variety", 0.95),
    "Words": ("mean_word / 10", 0.45),
}


def rule_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """(model, doc_id, label, prediction, score) of every rule on every labelled document."""
    features = document_features(spark, folder)
    said = []
    for name, (score, bar) in RULES.items():
        value = F.round(F.expr(score), 6)
        said.append(F.struct(F.lit(name).alias("model"), (value >= bar).cast("int").alias("prediction"), value.alias("score")))
    said.append(
        F.struct(F.lit("Language").alias("model"), (F.col("lang") == "en").cast("int").alias("prediction"),
                 F.lit(None).cast("double").alias("score"))
    )
    return features.select("doc_id", F.col("quality").alias("label"), F.inline(F.array(*said)))


RULES_SQL = (
    DOCUMENT_SQL
    + ",\npred AS (\n"
    + " UNION ALL ".join(
        f"SELECT '{name}' AS model, doc_id, quality AS label, CASE WHEN round({score}, 6) >= {bar} THEN 1 ELSE 0 END AS prediction, "
        f"round({score}, 6) AS score FROM feat"
        for name, (score, bar) in RULES.items()
    )
    + " UNION ALL SELECT 'Language', doc_id, quality, CASE WHEN lang = 'en' THEN 1 ELSE 0 END, NULL FROM feat)"
)

METRICS_SQL = (
    RULES_SQL
    + """,
cnt AS (
  SELECT model, count(*) AS n, count(*) FILTER (label = prediction) AS ok, count(*) FILTER (label = 1 AND prediction = 1) AS tp,
    count(*) FILTER (prediction = 1) AS said, count(*) FILTER (label = 1) AS pos FROM pred GROUP BY model),
auc AS (
  SELECT model, (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
    / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS v
  FROM (SELECT model, label, rank() OVER w + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS rk
        FROM pred WHERE score IS NOT NULL WINDOW w AS (PARTITION BY model ORDER BY score)) GROUP BY model),
met AS (
  SELECT model, 'Accuracy' AS metric, ok::DOUBLE / n AS value FROM cnt
  UNION ALL SELECT model, 'Precision', CASE WHEN said > 0 THEN tp::DOUBLE / said ELSE 0 END FROM cnt
  UNION ALL SELECT model, 'Recall', CASE WHEN pos > 0 THEN tp::DOUBLE / pos ELSE 0 END FROM cnt
  UNION ALL SELECT model, 'F1', CASE WHEN said + pos > 0 THEN 2.0::DOUBLE * tp / (said + pos) ELSE 0 END FROM cnt
  UNION ALL SELECT model, 'ROC AUC', v::DOUBLE FROM auc)"""
)


def daily_series(spark: SparkSession, folder: str) -> DataFrame:
    """One row per event type and day: the steps of the running statistics."""
    return (
        table(spark, folder, "events")
        .groupBy("event_type", F.to_date("ts").alias("date"))
        .agg(F.round(F.sum("value"), 6).alias("total"), F.round(F.avg("value"), 6).alias("mean"),
             F.count(F.lit(1)).alias("n"))
        .withColumn("day", F.unix_date("date").cast("bigint"))
        .drop("date")
    )


DAILY_SQL = """
daily AS (
  SELECT event_type, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))::BIGINT AS day, round(sum(value), 6) AS total,
    round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY ALL)"""
