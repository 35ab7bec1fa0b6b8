"""Language identification with a bit-sliced Bloom filter over character n-grams.

One table of language bitmasks stands for one Bloom filter per language: a slot's bit l belongs to the filter of
language l. Reading the slots of an n-gram and joining them with AND gives all languages that contain it at once. The bits of a text's
n-grams are counted per language, corrected for the filter's false positives, and the largest share decides.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortwise.llm.arrow import add_columns, map_columns
from cohortwise.session import materialize

UNKNOWN = "und"
GRAM = 4
# Odd multipliers of the n-gram hash and of the two slot hashes.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]
_LAST_LETTER = 0x33479  # the end of the last block of letters
_KINDS: list[np.ndarray] = []


def _kinds(points: np.ndarray) -> np.ndarray:
    """2 for a letter, 1 for a mark that goes with letters, 0 for all else."""
    if not _KINDS:
        table = np.zeros(_LAST_LETTER + 2, np.int8)  # its last entry stands for all beyond
        for c in range(_LAST_LETTER + 1):
            table[c] = {"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0)
        _KINDS.append(table)
    return _KINDS[0][np.minimum(points, _LAST_LETTER + 1)]


def grams(text: str | None) -> np.ndarray:
    """Hashes of the character n-grams of a text: lower case, one blank for every run of other characters than letters.

    Empty without a letter; a text shorter than an n-gram is filled up with blanks.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _kinds(points)
    if not (kinds == 2).any():
        return np.empty(0, np.uint64)
    letter = kinds > 0
    points = np.where(letter, points, 32)
    points = np.concatenate([[32], points[letter | np.r_[True, letter[:-1]]], [32]])
    if points[1] == 32:
        points = points[1:]
    if points[-2] == 32:
        points = points[:-1]
    points = np.pad(points, (0, max(0, GRAM - len(points))), constant_values=32).astype(np.uint64)
    n = len(points) - GRAM + 1
    out = points[:n].copy()
    for i in range(1, GRAM):
        out = out * _STEP + points[i : i + n]
    return (out ^ (out >> np.uint64(29))) * _SLOTS[0]


@dataclass
class LanguageFilter:
    """``slots[i, w]`` holds the bits of 64 languages; ``false_positive`` is each language's rate."""

    languages: list[str]
    slots: np.ndarray
    false_positive: np.ndarray

    @classmethod
    def build(cls, members: dict[str, np.ndarray], order: list[str], bits: int) -> LanguageFilter:
        slots = np.zeros((1 << bits, (len(order) + 63) // 64), np.uint64)
        rates = []
        for i, language in enumerate(order):
            bit = np.uint64(1 << (i % 64))
            for at in _places(members[language], bits):
                slots[at, i // 64] |= bit
            rates.append(((slots[:, i // 64] & bit) != 0).mean() ** len(_SLOTS))
        return cls(order, slots, np.array(rates))

    def languages_of(self, hashes: np.ndarray) -> np.ndarray:
        """The mask of all languages that contain each n-gram."""
        first, second = _places(hashes, int(len(self.slots)).bit_length() - 1)
        return self.slots[first] & self.slots[second]

    def shares(self, hashes: np.ndarray) -> np.ndarray:
        """Per language the share of known n-grams, as it would be without false positives."""
        masks = self.languages_of(hashes)
        known = [np.count_nonzero(masks[:, i // 64] & np.uint64(1 << (i % 64))) for i in range(len(self.languages))]
        share = np.array(known) / len(hashes)
        return np.clip((share - self.false_positive) / np.maximum(1 - self.false_positive, 1e-9), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        hashes = grams(text)
        if not len(hashes) or not self.languages:
            return UNKNOWN, 0.0
        shares = self.shares(hashes)
        best = int(np.argmax(shares))
        return self.languages[best], float(shares[best])


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(hashes * m) >> np.uint64(64 - bits) for m in _SLOTS]


def fit_language_filter(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", members: int = 6_000,
    bits: int = 17, fit_rows: int = 4_000, max_languages: int = 1_024, seed: int = 3,
) -> LanguageFilter:
    """The filter of the ``members`` n-grams that most documents of each language hold.

    About ``fit_rows`` rows per language, drawn by a hash of id and text, are read (all of a smaller one); n-grams are counted by document inside the
    partitions and summed. The table has ``2 ** bits`` slots, and the bits it takes grow only with the
    number of languages, which may be ``max_languages`` at most. Languages stand by rows, then name: this
    order breaks ties. Rows with a null language are left out.
    """
    rows = docs.filter(F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    counted = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    known = counted.orderBy(F.col("n").desc(), "lang").limit(max_languages + 1).collect()
    if len(known) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    draw = F.pmod(F.xxhash64(F.lit(seed), "id", "text"), F.lit(1 << 20))
    rates = counted.select(F.col("lang").alias("of"), (F.lit(float(fit_rows << 20)) / F.col("n")).alias("rate"))
    sample = rows.join(rates, F.col("lang") == F.col("of")).filter(draw < F.col("rate")).select("lang", "text")

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        counts: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                counts.setdefault(lang, []).append(np.unique(grams(text)))
        for lang, found in counts.items():
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            yield {"lang": [lang] * len(gram), "gram": gram.view(np.int64).tolist(), "n": n.tolist()}

    summed = map_columns(sample, kernel, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    top = summed.withColumn("rank", rank).filter(F.col("rank") <= members).select("lang", "gram").toPandas()
    sets = {r["lang"]: np.empty(0, np.uint64) for r in known}
    for lang, part in top.groupby("lang"):
        sets[lang] = part["gram"].to_numpy(np.int64).view(np.uint64)
    return LanguageFilter.build(sets, [r["lang"] for r in known], bits)


def identify(
    docs: DataFrame, model: LanguageFilter, text_col: str = "text", names=("lang_pred", "score"), keep_text: bool = True
) -> DataFrame:
    """``docs`` with the predicted language and its corrected share of known n-grams (0 to 1) under ``names``.

    The language is ``und`` with score 0 if the text is null or has no letter, or nothing was learned. With no known
    n-gram at all the language with most training rows is named, with score 0. Ties go to the language with
    more training rows. All rows and columns of ``docs`` are passed on, whatever they hold; columns of ``docs`` that have one of
    ``names`` give way, and the text does without ``keep_text``. The broadcast filter is bounded by its slots and the number of languages.
    """
    table = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(texts: list) -> dict[str, list]:
        made = [table.value.predict(t) for t in texts]
        return {names[0]: [m[0] for m in made], names[1]: [m[1] for m in made]}

    return add_columns(docs.drop(*names), text_col, kernel, f"{names[0]} string, {names[1]} double", keep_text)
