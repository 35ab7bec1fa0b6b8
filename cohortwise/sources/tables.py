"""Reading named tables, profiling them, and writing results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The column layouts of the relational inputs, read from quoted CSV with header.
CSV_SCHEMAS = {
    "courses": "code_module string, code_presentation string, module_presentation_length int",
    "assessments": "code_module string, code_presentation string, id_assessment int, "
    "assessment_type string, date int, weight double",
    "studentInfo": "code_module string, code_presentation string, id_student bigint, gender string, "
    "region string, highest_education string, imd_band string, age_band string, "
    "num_of_prev_attempts int, studied_credits int, disability string, final_result string",
    "studentRegistration": "code_module string, code_presentation string, id_student bigint, "
    "date_registration int, date_unregistration int",
    "studentVle": "code_module string, code_presentation string, id_student bigint, id_site bigint, "
    "date int, sum_click int",
    "vle": "id_site bigint, code_module string, code_presentation string, activity_type string, "
    "week_from int, week_to int",
    "studentAssessment": "id_assessment int, id_student bigint, date_submitted int, is_banked int, score double",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """All named Parquet tables; a missing or broken one fails here, before any job."""
    return {name: table(spark, folder, name) for name in names}


def load_csv_tables(spark: SparkSession, folder: str, schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The relational CSV inputs with their fixed column types; an empty field is NULL."""
    schemas = CSV_SCHEMAS if schemas is None else schemas
    return {
        name: spark.read.option("header", True).option("mode", "FAILFAST").schema(layout).csv(f"{folder}/{name}.csv")
        for name, layout in schemas.items()
    }


def table_shapes(tables: dict[str, DataFrame]) -> DataFrame:
    """One row (table, n_rows, n_cols) per table."""
    rows = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def null_profile(df: DataFrame) -> DataFrame:
    """Missing values per column plus a row named ``total``, from one aggregate over the data."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    whole = reduce(lambda a, b: a + b, [F.col(c) for c in df.columns])
    wide = counts.withColumn("total", whole)
    return wide.unpivot([], wide.columns, "column_name", "n_null")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Write a result in parallel; CSV gets a header and keeps empty strings apart from NULL."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("emptyValue", '""')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def read_written(spark: SparkSession, path: str, like: DataFrame, fmt: str = "parquet") -> DataFrame:
    """Read a written table with the columns and types of ``like``."""
    reader = spark.read.schema(like.schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
    return reader.load(path)
