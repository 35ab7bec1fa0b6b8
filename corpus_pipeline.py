"""The corpus pipeline: language, lines, near-duplicates, benchmark passages, mixture.

Every stage takes the documents that the one before kept and is written before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.llm import decontaminate, language, line_dedup, mixing, simhash
from cohortwise.llm.labelled import held_out
from cohortwise.llm.rows import distinct_rows, fresh, matching
from cohortwise.session import materialize
from cohortwise.sources.tables import table

# A text is in a language that was learned if this share of its n-grams is known there.
LEAST_SHARE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose best language knows under a fifth of their n-grams.

    Texts too short for that to mean anything, of under 20 characters, stay if they have a letter.
    """
    model = language.fit_language_filter(docs.filter(~held_out("doc_id", 5, 0)))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.length("text").alias("chars"), "text")
    known = language.identify(rows, model, keep_text=False)
    sure = (F.col("score") >= LEAST_SHARE) | (F.col("chars") < 20)
    gone = known.filter((F.col("lang_pred") == language.UNKNOWN) | ~F.coalesce(sure, F.lit(False)))
    gone = materialize(gone.select("doc_id", "key").distinct().toDF(*fresh(docs, "_of", "_key")), "gone")
    return matching(docs, gone, "left_anti", "doc_id", "text")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of every class of similar lines; no document goes, ``n_chars`` follows the text."""
    fewer = line_dedup.dedup_lines(docs, names=fresh(docs, "_n_lines", "_n_kept"))
    if "n_chars" in docs.columns:
        fewer = fewer.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))
    return fewer.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, that with the smallest id."""
    return simhash.one_per_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that overlap with a benchmark item."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), least_words=1)
    return decontaminate.without_contaminated(docs, found)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: a row per taken copy with its position, time, pass and words, then the document's columns."""
    order = mixing.training_order(mixing.mixture(docs))
    names = fresh(docs, "_of", "_key", "position", "at", "pass", "n_words")
    placed = materialize(order.select("doc_id", "text_key", "position", "at", "pass", "size").toDF(*names), "placed")
    taken = matching(distinct_rows(docs, "doc_id", "text"), placed, "inner", "doc_id", "text")
    ordered = taken.repartitionByRange(names[2]).sortWithinPartitions(names[2])
    return ordered.select(*names[2:], *docs.columns)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
]

# Fitted filters, signatures and connected components have no SQL form; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
