"""Sources and sinks, cleaning, and row-wise expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortwise.functions import scalars as S
from cohortwise.functions import vectors as V
from cohortwise.operators import clean
from cohortwise.operators.evaluate import comparison_report, model_metrics, tag_union
from cohortwise.operators.features import label_mapping
from cohortwise.operators.sequence import append_log, log_lines
from cohortwise.plans import data
from cohortwise.plans.registry import query, r6
from cohortwise.session import materialize, scratch_path
from cohortwise.sources import metrics as metric_files
from cohortwise.sources.tables import load_tables, null_profile, read_written, table, table_shapes, write_table

# The given tables.
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

DOCS_LABELED = "SELECT d.doc_id, text, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)"


def documents_labeled(spark, folder):
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")


@query("load_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t})) AS n_cols"
    for t in TABLES))
def load_all(spark, folder):
    return table_shapes(load_tables(spark, folder, TABLES))


_NULL_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


def _null_sql(stage: str, source: str) -> str:
    parts = [f"SELECT '{stage}' AS stage, '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS n_null FROM {source}" for c in _NULL_COLUMNS]
    whole = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in _NULL_COLUMNS)
    return " UNION ALL ".join([*parts, f"SELECT '{stage}', 'total', {whole} FROM {source}"])


@query("null_profile", f"""
WITH before AS ({DOCS_LABELED}),
after AS (SELECT * REPLACE (coalesce(toxic, 0) AS toxic) FROM before WHERE quality IS NOT NULL)
{_null_sql('before', 'before')} UNION ALL {_null_sql('after', 'after')}""")
def null_profile_query(spark, folder):
    before = documents_labeled(spark, folder)
    after = clean.fill_zero(clean.drop_missing(before, ["quality"]), ["toxic"])
    stages = {"before": null_profile(before), "after": null_profile(after)}
    return tag_union(stages, "stage")


@query("behaviour_features", data.BEHAVIOUR_SQL)
def behaviour_features(spark, folder):
    return data.behaviour_table(spark, folder)


@query("write_processed", data.BEHAVIOUR_SQL)
def write_processed(spark, folder):
    """The processed table through Parquet, then through CSV with header, and back."""
    features = data.behaviour_table(spark, folder)
    parquet, csv = scratch_path(spark, "processed"), scratch_path(spark, "processed-csv")
    write_table(features, parquet)
    stored = read_written(spark, parquet, features)
    write_table(stored, csv, "csv")
    return read_written(spark, csv, features, "csv")


_METRICS_LONG = f"WITH {data.METRICS_SQL} SELECT model, metric, {r6('value')} AS value FROM met"


def rule_metrics(spark, folder):
    """Metrics of every rule model; the texts are measured once and both passes, over classes
    and over scores, read the written predictions."""
    predictions = materialize(data.rule_predictions(spark, folder), "predictions")
    return materialize(model_metrics(predictions, "label", "prediction", "score", by=("model",)), "rule-metrics")


@query("metrics_sink", _METRICS_LONG)
def metrics_sink(spark, folder):
    path = scratch_path(spark, "metrics")
    metric_files.write_metrics(rule_metrics(spark, folder), path)
    return metric_files.read_metrics(spark, path).withColumn("value", S.rounded("value"))


@query("collect_metrics", _METRICS_LONG)
def collect_metrics(spark, folder):
    """One folder per model, read together; the model name comes from the file path and the
    models without a file are skipped with a warning."""
    path = scratch_path(spark, "metrics")
    metric_files.write_metrics(rule_metrics(spark, folder), path)
    names = {**{m: m for m in data.RULES}, "Language": "Language", "Absent": "Absent"}
    return metric_files.collect_metrics(spark, path, names).withColumn("value", S.rounded("value"))


@query("training_log", f"""
WITH {data.DAILY_SQL}
SELECT event_type, 0::BIGINT AS line_no, 'total' || chr(9) || 'mean' || chr(9) || 'n' AS line FROM daily GROUP BY event_type
UNION ALL
SELECT event_type, day, format('{{:.6f}}', total) || chr(9) || format('{{:.6f}}', mean) || chr(9) || format('{{:.6f}}', n::DOUBLE) FROM daily""")
def training_log(spark, folder):
    return log_lines(data.daily_series(spark, folder), "event_type", "day", ["total", "mean", "n"])


@query("training_log_resume", f"""
WITH {data.DAILY_SQL} SELECT {r6('total')} AS total, {r6('mean')} AS mean, {r6('n')} AS n FROM daily""")
def training_log_resume(spark, folder):
    """Written for all types but one, resumed with the last, read back."""
    series = data.daily_series(spark, folder)
    path = scratch_path(spark, "log")
    append_log(series.filter("event_type <> 'view'"), path, ["total", "mean", "n"])
    append_log(series.filter("event_type = 'view'"), path, ["total", "mean", "n"], resume=True)
    return spark.read.option("sep", "\t").option("header", True).schema("total double, mean double, n double").csv(path)


@query("comparison_report", f"""
WITH {data.METRICS_SQL},
wide AS (SELECT model, {", ".join(f"max(value) FILTER (metric = '{m}') AS m{i}" for i, m in enumerate(["Accuracy", "Precision", "Recall", "F1", "ROC AUC"]))} FROM met GROUP BY model),
best AS (SELECT metric, max(value) AS value FROM met GROUP BY metric),
best2 AS (SELECT m.metric, min(m.model) AS model, b.value FROM met m JOIN best b ON m.metric = b.metric AND m.value = b.value GROUP BY m.metric, b.value),
lines(s, pos, line) AS (
  SELECT 0, '', 'model comparison'
  UNION ALL SELECT 1, '', 'model | Accuracy | Precision | Recall | F1 | ROC AUC'
  UNION ALL SELECT 2, model, model || {" || ".join(f"' | ' || coalesce(format('{{:.4f}}', m{i}), '-')" for i in range(5))} FROM wide
  UNION ALL SELECT 3, '', 'best model per metric'
  UNION ALL SELECT 4, lpad(CAST(list_position(['Accuracy', 'Precision', 'Recall', 'F1', 'ROC AUC'], metric) AS VARCHAR), 3, '0'),
    format('{{}}: {{}} ({{:.4f}})', metric, model, value) FROM best2
  UNION ALL SELECT 5, '', 'overall'
  UNION ALL SELECT 6, '', line FROM (SELECT format('best overall: {{}} (mean score: {{:.4f}})', model, avg(value)) AS line
    FROM met GROUP BY model ORDER BY avg(value) DESC, model LIMIT 1))
SELECT row_number() OVER (ORDER BY s, pos, line) AS line_no, line FROM lines""")
def comparison_report_query(spark, folder):
    return comparison_report(rule_metrics(spark, folder))


@query("drop_leakage_columns", "SELECT doc_id, lang, source, n_chars FROM documents JOIN labels USING (doc_id)")
def drop_leakage_columns(spark, folder):
    joined = table(spark, folder, "documents").drop("text").join(table(spark, folder, "labels"), "doc_id")
    return clean.drop_leakage(joined, "quality", "toxic", "not_there")


@query("prune_columns", "SELECT p_partkey, p_brand FROM part")
def prune_columns(spark, folder):
    return table(spark, folder, "part").select("p_partkey", "p_brand")


@query("drop_all_null_columns", "SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def drop_all_null_columns(spark, folder):
    """A column that is missing everywhere goes; the half-filled label columns stay."""
    frame = documents_labeled(spark, folder).drop("text")
    impossible = F.when((F.col("quality") > 1) & (F.col("toxic") > 1), F.col("quality"))
    return clean.drop_all_null_columns(frame.withColumn("empty", impossible))


@query("dropna_subset", "SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id) "
       "WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def dropna_subset(spark, folder):
    return clean.drop_missing(documents_labeled(spark, folder).drop("text"), ["quality", "toxic"])


@query("fillna_zero", "SELECT doc_id, lang, source, n_chars, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, "
       "CASE WHEN quality IS NULL THEN 1 ELSE 0 END AS quality_missing FROM documents LEFT JOIN labels USING (doc_id)")
def fillna_zero(spark, folder):
    frame = clean.missing_indicator(documents_labeled(spark, folder).drop("text"), "quality")
    return clean.fill_zero(frame, ["quality", "toxic", "not_there"])


@query("select_by_pattern", f"WITH {data.ACTIVITY_SQL} SELECT c_custkey, "
       + ", ".join(f"{r6(f'total_clicks_{k}')} AS total_clicks_{k}" for k in data.KINDS) + " FROM joined")
def select_by_pattern(spark, folder):
    frame = data.customer_activity(spark, folder)
    return frame.select("c_custkey", *[S.rounded(c).alias(c) for c in clean.columns_like(frame, "total_clicks_")])


@query("fill_pattern_zero", f"WITH {data.ACTIVITY_SQL} SELECT c_custkey, "
       + ", ".join(f"active_days_{k}" for k in data.KINDS) + " FROM joined")
def fill_pattern_zero(spark, folder):
    frame = data.customer_activity(spark, folder)
    return frame.select("c_custkey", *clean.columns_like(frame, "active_days_"))


@query("drop_non_numeric", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def drop_non_numeric(spark, folder):
    return clean.drop_non_numeric(table(spark, folder, "customer"))


@query("derive_binary_label", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 ELSE 0 END AS at_risk FROM orders")
def derive_binary_label(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", S.binary_label("o_orderstatus", ["F", "P"]).alias("at_risk"))


@query("filter_metric", f"WITH {data.METRICS_SQL} SELECT model, {r6('value')} AS value FROM met WHERE metric = 'F1'")
def filter_metric(spark, folder):
    return rule_metrics(spark, folder).filter("metric = 'F1'").select("model", S.rounded("value").alias("value"))


@query("relative_max_filter", "SELECT event_id, value FROM events WHERE value > 0.01::DOUBLE * (SELECT max(value) FROM events)")
def relative_max_filter(spark, folder):
    return clean.above_share_of_max(table(spark, folder, "events").select("event_id", "value"), "value", 0.01)


@query("class_balance_summary", f"SELECT count(quality) AS n, sum(quality)::BIGINT AS positives, {r6('avg(quality)')} AS positive_rate FROM labels")
def class_balance_summary(spark, folder):
    balance = clean.class_balance(table(spark, folder, "labels"), "quality")
    return balance.withColumn("positive_rate", S.rounded("positive_rate"))


@query("class_counts", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def class_counts(spark, folder):
    return clean.class_counts(table(spark, folder, "embeddings"), "label")


@query("quantile_cap", "WITH q AS (SELECT quantile_cont(l_quantity, 0.98) AS a, quantile_cont(l_extendedprice, 0.98) AS b FROM lineitem) "
       f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {r6('least(l_quantity, a)')} AS l_quantity, "
       f"{r6('least(l_extendedprice, b)')} AS l_extendedprice FROM lineitem, q")
def quantile_cap(spark, folder):
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    capped = clean.cap_upper(table(spark, folder, "lineitem").select(*columns), ["l_quantity", "l_extendedprice"])
    return capped.withColumns({c: S.rounded(c) for c in ("l_quantity", "l_extendedprice")})


def _box_sql(c: str) -> str:
    return (
        f"SELECT '{c}' AS column_name, {r6('q1')} AS q1, {r6('q2')} AS median, {r6('q3')} AS q3, "
        f"min({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low, "
        f"max({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high, "
        f"count(*) FILTER ({c} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers FROM orders_events, "
        f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM orders_events) GROUP BY ALL"
    )


@query("boxplot_stats", "WITH orders_events AS (SELECT value FROM events) " + _box_sql("value"))
def boxplot_stats(spark, folder):
    stats = clean.boxplot_stats(table(spark, folder, "events").select("value"), ["value"])
    return stats.withColumns({c: S.rounded(c) for c in ("q1", "median", "q3")})


_BOXED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("boxplot_stats_columns", "WITH orders_events AS (SELECT * FROM lineitem) " + " UNION ALL ".join(_box_sql(c) for c in _BOXED))
def boxplot_stats_columns(spark, folder):
    """All measures of the largest table at once."""
    stats = clean.boxplot_stats(table(spark, folder, "lineitem").select(*_BOXED), _BOXED)
    return stats.withColumns({c: S.rounded(c) for c in ("q1", "median", "q3")})


_PERIOD_CODE = "strftime(o_orderdate, '%Y') || CASE WHEN month(o_orderdate) <= 4 THEN 'B' WHEN month(o_orderdate) <= 8 THEN 'M' ELSE 'J' END"


def orders_with_code(spark, folder):
    month = F.month("o_orderdate")
    letter = F.when(month <= 4, "B").when(month <= 8, "M").otherwise("J")
    return table(spark, folder, "orders").withColumn("code", F.concat(F.date_format("o_orderdate", "yyyy"), letter))


@query("parse_period_code", f"""
SELECT o_orderkey, code, substr(code, 1, 4) AS period_year,
  CASE substr(code, 5, 1) WHEN 'B' THEN 'Spring' WHEN 'J' THEN 'Autumn' END AS period_term
FROM (SELECT o_orderkey, {_PERIOD_CODE} AS code FROM orders)""")
def parse_period_code(spark, folder):
    return orders_with_code(spark, folder).select(
        "o_orderkey", "code", S.period_year("code").alias("period_year"), S.period_term("code").alias("period_term")
    )


@query("row_totals", f"WITH {data.ACTIVITY_SQL} SELECT c_custkey, {r6(' + '.join(f'total_clicks_{k}' for k in data.KINDS))} AS overall FROM joined")
def row_totals(spark, folder):
    frame = data.customer_activity(spark, folder)
    return frame.select("c_custkey", S.rounded(S.row_total(clean.columns_like(frame, "total_clicks_"))).alias("overall"))


@query("safe_ratio", f"WITH {data.ACTIVITY_SQL} SELECT c_custkey, "
       f"{r6('CASE WHEN active_days_view > 0 THEN total_clicks_view / active_days_view ELSE 0 END')} AS per_day FROM joined")
def safe_ratio(spark, folder):
    frame = data.customer_activity(spark, folder)
    return frame.select("c_custkey", S.rounded(S.safe_ratio("total_clicks_view", "active_days_view")).alias("per_day"))


@query("row_mean", f"WITH doc AS ({DOCS_LABELED}) SELECT doc_id, "
       "round((coalesce(quality, 0) + coalesce(toxic, 0) + n_chars)::DOUBLE / "
       "((quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT + 1), 6) AS mean_value FROM doc")
def row_mean(spark, folder):
    frame = documents_labeled(spark, folder)
    return frame.select("doc_id", S.rounded(S.row_mean(["quality", "toxic", "n_chars"])).alias("mean_value"))


@query("early_engagement", f"""
WITH early AS (SELECT user_id, event_type, sum(value) AS t, count(DISTINCT CAST(ts AS DATE)) AS a FROM events
  WHERE ts < TIMESTAMP '2024-01-29' GROUP BY ALL),
wide AS (SELECT user_id, sum(t) AS t, sum(a) AS a FROM early WHERE event_type IN ('click', 'purchase', 'view') GROUP BY user_id)
SELECT c_custkey, {r6('coalesce(t + a, 0) / 6')} AS early_engagement FROM customer LEFT JOIN wide ON c_custkey = user_id""")
def early_engagement(spark, folder):
    """Mean of the early columns with a real cutoff: the first four weeks of the log."""
    from cohortwise.operators.features import activity_wide, engagement, join_features

    log = data.activity_log(spark, folder).filter(F.col("day") < F.lit("2024-01-29").cast("date"))
    wide = activity_wide(log, ["c_custkey"], "event_type", "day", "value", data.KINDS)
    joined = join_features(table(spark, folder, "customer").select("c_custkey"), wide, ["c_custkey"])
    return engagement(joined, data.KINDS, data.EARLY_KINDS).select("c_custkey", S.rounded("early_engagement").alias("early_engagement"))


@query("cast_string_nan", f"WITH doc AS ({DOCS_LABELED}) SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'nan') AS quality FROM doc")
def cast_string_nan(spark, folder):
    return documents_labeled(spark, folder).select("doc_id", S.text_or_nan("quality").alias("quality"))


_ENCODED = {"customer": ["c_mktsegment"], "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"]}


@query("label_mapping", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS value, row_number() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM {t})"
    for t, cs in _ENCODED.items() for c in cs)
    + " UNION ALL SELECT 'quality', v, row_number() OVER (ORDER BY v) - 1 FROM (SELECT DISTINCT coalesce(CAST(quality AS VARCHAR), 'nan') AS v "
      "FROM documents LEFT JOIN labels USING (doc_id))")
def label_mapping_query(spark, folder):
    from functools import reduce

    parts = [label_mapping(table(spark, folder, t), cs) for t, cs in _ENCODED.items()]
    parts.append(label_mapping(documents_labeled(spark, folder), ["quality"]))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("label_encode", f"""
WITH doc AS ({DOCS_LABELED}),
c1 AS (SELECT lang AS v, row_number() OVER (ORDER BY lang) - 1 AS code FROM (SELECT DISTINCT lang FROM documents)),
c2 AS (SELECT source AS v, row_number() OVER (ORDER BY source) - 1 AS code FROM (SELECT DISTINCT source FROM documents)),
c3 AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(CAST(quality AS VARCHAR), 'nan') AS v FROM doc))
SELECT doc_id, c1.code AS lang, c2.code AS source, c3.code AS quality FROM doc JOIN c1 ON lang = c1.v JOIN c2 ON source = c2.v
  JOIN c3 ON coalesce(CAST(quality AS VARCHAR), 'nan') = c3.v""")
def label_encode_query(spark, folder):
    from cohortwise.operators.features import label_encode

    frame = documents_labeled(spark, folder).select("doc_id", "lang", "source", "quality")
    return label_encode(frame, ["lang", "source", "quality", "not_there"])[0]


_STD = ["o_totalprice", "zero_spread"]


@query("standardize", f"""
WITH src AS (SELECT o_orderkey, o_totalprice, 7.0::DOUBLE AS zero_spread, o_orderstatus = 'F' AS train FROM orders),
fit AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM src WHERE train)
SELECT o_orderkey, {r6('(o_totalprice - m) / s')} AS o_totalprice, 0.0::DOUBLE AS zero_spread FROM src, fit""")
def standardize(spark, folder):
    """Fitted on the finished orders only, applied to all; a constant column becomes zero."""
    from cohortwise.operators.models import PopulationScaler

    frame = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.lit(7.0).alias("zero_spread"))
    scaler = PopulationScaler(inputCols=_STD, outputCols=_STD).fit(frame.filter("o_orderstatus = 'F'"))
    scaled = scaler.transform(frame).drop("o_orderstatus")
    return scaled.withColumns({c: S.rounded(c) for c in _STD})


# The three channel means and deviations of the reference normalisation.
CHANNEL_MEANS = [0.4914, 0.4822, 0.4465]
CHANNEL_STDS = [0.2471, 0.2435, 0.2616]


@query("fixed_normalize", f"""
SELECT vec_id, p - 1 AS pos, {r6('(embedding[p]::DOUBLE - m[(p - 1) // 22 + 1]) / s[(p - 1) // 22 + 1]')} AS value
FROM embeddings, (SELECT unnest(range(1, 65)) AS p), (SELECT {CHANNEL_MEANS}::DOUBLE[] AS m, {CHANNEL_STDS}::DOUBLE[] AS s)""")
def fixed_normalize(spark, folder):
    normal = V.normalize_channels(V.as_double("embedding"), CHANNEL_MEANS, CHANNEL_STDS, 22)
    return table(spark, folder, "embeddings").select("vec_id", F.posexplode(normal).alias("p", "v")).select(
        "vec_id", F.col("p").cast("bigint").alias("pos"), S.rounded("v").alias("value")
    )


@query("one_hot", "SELECT vec_id, c AS cls, CASE WHEN label = c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM embeddings, (SELECT unnest(range(10)) AS c)")
def one_hot(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.posexplode(V.one_hot("label", 10)).alias("c", "value")).select(
        "vec_id", F.col("c").cast("bigint").alias("cls"), "value"
    )


@query("clip_range", f"SELECT event_id, {r6('greatest(1.0, least(255.0, value))')} AS value FROM events")
def clip_range(spark, folder):
    return table(spark, folder, "events").select("event_id", S.rounded(S.clip(F.col("value"), 1.0, 255.0)).alias("value"))


@query("number_format", """
SELECT o_orderkey, CAST(CAST(CAST(o_totalprice / 7 AS VARCHAR) AS DECIMAL(38, 18)) AS DECIMAL(38, 4)) || '' AS four,
  CAST(CAST(CAST(o_totalprice / 9000 AS VARCHAR) AS DECIMAL(38, 18)) AS DECIMAL(38, 2)) || '%' AS share,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp FROM orders""")
def number_format(spark, folder):
    """Fixed decimals, rounded half up on the number's shortest decimal form."""
    return table(spark, folder, "orders").select(
        "o_orderkey", F.format_string("%.4f", F.col("o_totalprice") / 7).alias("four"),
        F.format_string("%.2f%%", F.col("o_totalprice") / 9000).alias("share"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("stamp"),
    )
