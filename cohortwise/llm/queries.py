"""One query per operator over the given tables, with production parameters, and its SQL where one exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortwise.llm import (
    chat, decontaminate, language, line_dedup, mixing, quality_model, quality_rules, simhash, substrings, tokens, toxicity,
    vector_codes, whitening,
)
from cohortwise.llm.labelled import held_out, labelled_sample
from cohortwise.llm.registry import ORACLES, QUERIES, query
from cohortwise.llm.words import word_list
from cohortwise.sources.tables import table

__all__ = ["ORACLES", "QUERIES"]

MIXTURE_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    substr(md5('7' || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS key
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM sized GROUP BY source),
tight AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source) AS r FROM totals),
rates AS (
  SELECT r, (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM totals) - coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate, cap, w FROM tight),
rate AS (SELECT rate FROM rates WHERE rate * w <= cap ORDER BY r LIMIT 1),
targets AS (SELECT source, source_size, least(cap, w * rate) AS target FROM tight, rate),
placed AS (
  SELECT s.*, t.source_size, t.target,
    sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS done
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passes AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM placed)
SELECT doc_id, size, source_size, target,
  size * (whole + CASE WHEN 2 * (done - size) + size <= 2.0::DOUBLE * (target - whole * source_size) THEN 1 ELSE 0 END) AS taken
FROM passes
"""


@query("op7_source_mixing", MIXTURE_SQL)
def source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.dealt(mixing.mixture(table(spark, folder, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op8_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


PROBE_TEXT = "\\### Assistant: </turn> ok"


def _hashes_beyond_two(text: str) -> str:
    return f"list_sum(list_transform(regexp_extract_all({text}, '#+'), lambda x: greatest(length(x) - 2, 0)))"


def _placed_tags(text: str) -> str:
    return f"len(regexp_extract_all({text}, '<(/turn>|image:|audio:|document:|attachment:)'))"


CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PROBE_TEXT}'), (-7, 1, 'assistant', '{PROBE_TEXT}')),
sized AS (
  SELECT *, 6 + 8 + length(role) + len(regexp_extract_all(role, '[\\\\:#<]')) + length(text) + len(regexp_extract_all(text, '\\\\'))
    + coalesce({_hashes_beyond_two("text")}, 0) + {_placed_tags("text")} AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query("op10_chat_formatting", CHAT_SQL)
def chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"),
    )
    return chat.conversation_digests(chat.format_conversations(given.unionByName(probe)))


@query("op6_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


QUALITY_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
base AS (
  SELECT rid, doc_id, t, len(words)::BIGINT AS n_words, len(lines)::BIGINT AS n_lines,
    length(array_to_string(words, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, words
  FROM split),
windows AS (
  SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT rid, words, unnest(generate_series(1, n_words - 2)) AS i FROM base WHERE n_words >= 3)),
repeated AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
covered AS (SELECT rid, count(DISTINCT p)::BIGINT AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY rid),
counted AS (
  SELECT b.*, coalesce(n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed
  FROM base b LEFT JOIN covered USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (
    word_chars < 2.0 * n_words OR word_chars > 15.0 * n_words OR n_symbols > 0.25 * n_words OR n_dup_lines > 0.5 * n_lines
    OR 2 * len(regexp_extract_all(t, '\p{Lu}')) > len(regexp_extract_all(t, '\p{L}'))
    OR 2 * len(regexp_extract_all(t, '\p{L}')) < word_chars
    OR 2 * len(regexp_extract_all(t, '!!')) > n_words
    OR 2 * len(regexp_extract_all(t, '(\.\.\.|…)[ \t\r]*(\n|$)')) > n_lines
    OR 10 * len(regexp_extract_all(t, '(^|\n)[ \t]*[-*•]')) > 9 * n_lines) AS kept
FROM counted
"""


@query("op2_quality_rules", QUALITY_SQL)
def quality_rules_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_cascade(table(spark, folder, "documents"))


@query("op1_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit_language_filter(docs.filter(~held_out("doc_id", 5, 0)))
    given = docs.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "text")
    return language.identify(given, model, keep_text=False)


@query("op3_quality_classifier")
def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").filter(~held_out("doc_id", 3, 1))
    weights = quality_model.fit_quality(labelled_sample(docs, labels, "quality", {0: 12_000, 1: 12_000}))
    scored = quality_model.score_quality(docs, weights)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


@query("op4_toxicity")
def toxicity_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").filter(~held_out("doc_id", 4, 2))
    model = toxicity.fit_toxicity(labelled_sample(docs, labels, "toxic", {0: 8_000, 1: 4_000}))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted", "worst_word")


@query("op5_line_dedup")
def line_dedup_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_kept", "text")


@query("op9_decontamination")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"), least_words=1)
    return found.select("doc_id", "item_id", "first_word", "n_words", "n_equal")


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten_embeddings(table(spark, folder, "embeddings"))[0]


_PART = "v[4 * p + 1 : 4 * p + 4]"


def _assignment_sql(source: str, book: str) -> str:
    gap = " + ".join(f"(e.v[{i}] - b.v[{i}]) * (e.v[{i}] - b.v[{i}])" for i in range(1, 5))
    return f"""SELECT rid, vec_id, label, p, v, min_by(k, d * 64 + k) AS k, min(d) AS d
  FROM (SELECT e.rid, e.vec_id, e.label, e.p, e.v, b.k, {gap} AS d FROM {source} e JOIN {book} b ON e.p = b.p)
  GROUP BY rid, vec_id, label, p, v"""


def _update_sql(assigned: str, book: str) -> str:
    means = ", ".join(f"floor(sum(v[{i}]) / count(*))::BIGINT AS m{i}" for i in range(1, 5))
    return f"""SELECT b.p, b.k, CASE WHEN m1 IS NULL THEN b.v ELSE [m1, m2, m3, m4] END AS v
  FROM {book} b LEFT JOIN (SELECT p, k, {means} FROM {assigned} GROUP BY p, k) a ON a.p = b.p AND a.k = b.k"""


CODES_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT rid, vec_id, label, p, {_PART} AS v FROM kept, range(16) t(p)),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS k, v FROM parts WHERE rid <= 64),
a1 AS MATERIALIZED ({_assignment_sql("parts", "b0")}),
b1 AS MATERIALIZED ({_update_sql("a1", "b0")}),
a2 AS MATERIALIZED ({_assignment_sql("parts", "b1")}),
b2 AS MATERIALIZED ({_update_sql("a2", "b1")}),
a3 AS MATERIALIZED ({_assignment_sql("parts", "b2")}),
coded AS (
  SELECT rid, vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY rid, vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS h FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM coded, books
"""


@query("op12_vector_code_compression", CODES_SQL)
def vector_code_compression(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = vector_codes.compress_vectors(table(spark, folder, "embeddings"))
    digits = F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    return vector_codes.with_label_errors(coded).select(
        "vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256")
    )


SUBSTRINGS_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
windows AS (
  SELECT rid, i, array_to_string(words[i : i + 34], ' ') AS w
  FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 34)) AS i FROM texts WHERE len(words) >= 35)),
repeated AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY md5(w)) > 1),
gone AS (SELECT DISTINCT rid, unnest(generate_series(i, i + 34)) AS p FROM repeated),
placed AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM texts),
kept AS (
  SELECT t.rid, count(g.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY t.p) FILTER (g.p IS NULL), '') AS left_over
  FROM placed t LEFT JOIN gone g ON g.rid = t.rid AND g.p = t.p GROUP BY t.rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (rid)
"""


@query("op13_substring_dedup", SUBSTRINGS_SQL)
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = substrings.dedup_substrings(table(spark, folder, "documents").select("doc_id", "text"))
    kept = F.array_join(word_list(F.col("text")), " ")
    return docs.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))
