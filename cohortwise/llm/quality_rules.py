"""Quality rules as a short-circuit cascade in SQL expressions.

Each rule's cost and selectivity are estimated on a sample; the rules then stand in one OR by rejections per
second, highest first, so a row that a cheap rule throws out never reaches a dear one. Order changes what is
computed, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.words import BLANKS, word_list
from cohortwise.session import materialize

# Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is an SQL condition over the measures and ``_text``; true throws the document out."""

    name: str
    rejects: str


# The rules after the base; the thresholds follow the published rule sets for web text, set loosely.
RULES = [
    Rule("word_length", "word_chars < 2.0 * n_words OR word_chars > 15.0 * n_words"),
    Rule("symbols", "n_symbols > 0.25 * n_words"),
    Rule("repeated_lines", "n_dup_lines > 0.5 * n_lines"),
    Rule("capitals", r"2 * regexp_count(_text, '\\p{Lu}') > regexp_count(_text, '\\p{L}')"),
    Rule("letters", r"2 * regexp_count(_text, '\\p{L}') < word_chars"),
    Rule("shouting", r"2 * regexp_count(_text, '!!') > n_words"),
    Rule("cut_lines", r"2 * regexp_count(_text, '(\\.\\.\\.|…)[ \\t\\r]*(\\n|$)') > n_lines"),
    Rule("bullets", r"10 * regexp_count(_text, '(^|\\n)[ \\t]*[-*•]') > 9 * n_lines"),
]


def _repeated_places(ranked: str) -> Column:
    """Places, in order, of the windows whose hash occurs twice or more, from sorted (hash, place) structs."""
    at = lambda i: F.get(ranked, i)
    same = lambda i, j: F.coalesce(at(i)["h"] == at(j)["h"], F.lit(False))
    every = F.sequence(F.lit(0), F.size(ranked) - 1)
    return F.sort_array(
        F.transform(F.filter(every, lambda i: same(i, i + 1) | ((i > 0) & same(i, i - 1))), lambda i: at(i)["i"])
    )


def measured(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``_text`` and the base measures of the whole text, one row in one row out.

    Windows are compared by a 64-bit hash and found by sorting inside the row, only where some
    hash repeats; no window leaves its row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    none = F.array().cast("array<bigint>")
    ranked = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    gaps = F.zip_with(
        F.slice("_places", 1, F.size("_places") - 1), F.slice("_places", 2, F.size("_places") - 1),
        lambda a, b: F.least(b - a, F.lit(3)),
    )
    covered = F.aggregate(gaps, F.lit(3), lambda x, y: x + y).cast("bigint")
    return (
        docs.withColumn("_text", text)
        .withColumn("_words", word_list(F.col("_text")))
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("bigint"))
        .withColumn("word_chars", F.length(F.translate("_text", BLANKS, "")).cast("bigint"))
        .withColumn("n_symbols", (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint"))
        .withColumn("n_lines", F.size("_lines").cast("bigint"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
        .withColumn("_windows", F.when(F.size("_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), window)).otherwise(none))
        .withColumn("_ranked", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), ranked))
        .withColumn("_places", F.when(F.col("_ranked").isNotNull(), _repeated_places("_ranked")))
        .withColumn("n_repeat_words", F.when(F.col("_places").isNotNull(), covered).otherwise(F.lit(0).cast("bigint")))
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .drop("_words", "_lines", "_windows", "_ranked", "_places")
    )


def rule_order(docs: DataFrame, id_col: str, text_col: str, rules: list[Rule], sample_rows: int, seed: int) -> list[dict]:
    """Rules with their seconds per row and rejected share on about ``sample_rows`` seeded rows, best first.

    The sample is measured and written once; each rule is timed alone on it, after one untimed pass.
    """
    share = min(1.0, sample_rows / max(docs.count(), 1))
    draw = F.pmod(F.xxhash64(F.lit(seed), id_col, text_col), F.lit(1 << 20))
    sample = materialize(measured(docs.select(id_col, text_col).filter(draw <= int(share * (1 << 20))), text_col), "sample")
    base = sample.filter(~F.col("base_failed")).repartition(1)
    rows = base.agg(F.count(F.lit(1)), F.sum(F.length("_text"))).first()[0]
    found = []
    for rule in rules:
        started = time.perf_counter()
        rejected = base.agg(F.count_if(F.expr(rule.rejects))).first()[0]
        took = time.perf_counter() - started
        found.append({"rule": rule, "cost": took / max(rows, 1), "rejected": rejected / max(rows, 1)})
    return sorted(found, key=lambda r: (-r["rejected"] / r["cost"], r["rule"].name))


def quality_cascade(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None,
    sample_rows: int = 1_000, seed: int = 5,
) -> DataFrame:
    """One row per input row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``.

    A document fails the base with under 50 words, or when more than half of its words lie in repeated three-word windows.
    It is kept if it passes the base and no rule rejects it. Rules are asked in the order of ``rule_order`` and only up
    to the first that rejects.

    A null text has no words: all measures 0, base failed. Lines without a word do not count. Null and repeated ids
    keep their rows. Columns other than the two named are not read, so theirs may have any name. No rows in, no rows out.
    """
    rules = RULES if rules is None else rules
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = rule_order(given, "doc_id", "text", rules, sample_rows, seed)
    rejects = F.lit(False)
    for entry in order:
        rejects = rejects | F.expr(entry["rule"].rejects)
    base = measured(given, "text")
    return base.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~rejects).alias("kept"),
    )
