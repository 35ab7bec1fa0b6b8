"""Metric files: one (metric, value) CSV folder per model, collected into one long table."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """(model, metric, value) rows, a folder per model."""
    # The result holds models times metrics rows; one file per model is enough.
    metrics.repartition("model").write.mode("overwrite").partitionBy("model").option("header", True).csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("metric string, value double, model string").csv(path)


def collect_metrics(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Read the folder of every listed model at once; ``names`` maps folder to shown name.

    A model without files is skipped with a warning; none at all is an error.
    """
    jvm = spark.sparkContext._jvm
    conf = spark._jsc.hadoopConfiguration()
    folders = []
    for key in names:
        folder = f"{path}/model={key}"
        hadoop_path = jvm.org.apache.hadoop.fs.Path(folder)
        if hadoop_path.getFileSystem(conf).exists(hadoop_path):
            folders.append(folder)
        else:
            LOG.warning("no metrics of model %s in %s", key, path)
    if not folders:
        raise FileNotFoundError(f"no model metrics in {path}")
    files = spark.read.option("header", True).schema("metric string, value double").csv(folders)
    key = F.regexp_extract(F.col("_metadata.file_path"), r"model=([^/]+)/", 1)
    shown = spark.createDataFrame(list(names.items()), "key string, model string")
    return files.withColumn("key", F.url_decode(key)).join(shown, "key").select("model", "metric", "value")
