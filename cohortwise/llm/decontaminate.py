"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive words; its hash leaves some places out, so it survives substitutions
there. Seeds of benchmark items and documents are joined by hash, and around each hit the item is laid
over the document: an overlap counts where a window of words agrees in four fifths of them. Items shorter than a
window have masks for their length, so that whatever may differ, one mask is left whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.arrow import map_columns
from cohortwise.llm.rows import fresh, matching
from cohortwise.session import materialize

# With these two masks every 13 words that differ in at most two places share a seed.
MASKS = ("11110011", "11010111")
SPAN = 8
SURE, SURE_OFF = 13, 2
# Scripts written without blanks: Thai, Lao, Burmese, Khmer, kana and Chinese characters; each character is a word.
_UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u30fa\u30fc-\u30ff\u31f0-\u31ff"
    "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
)
_WORD, _ANY_UNSPACED = re.compile(r"\w+"), re.compile(f"[{_UNSPACED}]")
_MIXED = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+")
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOW = 8  # where a seed's second place in the bitmap begins; the first is its highest bits


class WordHashes(dict):
    """Word to its 64-bit hash; bounded."""

    def __missing__(self, word: str) -> int:
        made = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= 400_000:
            self.clear()
        if len(word) <= 48:
            self[word] = made
        return made


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (_WORD if text.isascii() or not _ANY_UNSPACED.search(text) else _MIXED).findall(text)


def kind_of(n: int, window: int, similarity: float) -> tuple[int, int]:
    """(words of a window, how many of them may differ) for an item of ``n`` words: under ``SPAN`` words none."""
    if n < SPAN:
        return n, 0
    wide = min(window, n)
    return wide, wide - math.ceil(similarity * wide - 1e-9)


def masks_for(wide: int, off: int) -> list[tuple[int, ...]]:
    """The places of each mask, for windows of ``wide`` words of which ``off`` may differ.

    Beyond what ``MASKS`` promise, the window is dealt into ``off + 2`` groups. Whatever ``off`` places differ, two groups
    are left whole, and every two groups are a mask.
    """
    if wide >= SURE and off <= SURE_OFF:
        return [tuple(i for i, used in enumerate(mask) if used == "1") for mask in MASKS]
    if not off:
        return [tuple(range(wide))]
    groups = [range(i, wide, off + 2) for i in range(off + 2)]
    return [tuple(sorted((*a, *b))) for a, b in combinations(groups, 2)]


def hashed(words: list[str], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def seeds(codes: np.ndarray, wide: int, off: int) -> list[np.ndarray]:
    """Per mask for such windows the hash of every place where it fits."""
    sure = wide >= SURE and off <= SURE_OFF
    n = len(codes) - (SPAN if sure else wide) + 1
    if n < 1:
        return []
    found = []
    for number, places in enumerate(masks_for(wide, off)):
        total = np.full(n, number + 1 if sure else (wide << 32) + (off << 16) + number, np.uint64)
        for i in places:
            total += codes[i : i + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64) | 1)
        found.append((total ^ (total >> np.uint64(31))) * _MIX)
    return found


def _benchmark_seeds(items: DataFrame, window: int, similarity: float) -> DataFrame:
    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        known = WordHashes()
        for batch in batches:
            out = {"seed": [], "item": [], "at": []}
            for item, words in zip(batch["item"], batch["words"]):
                for hashes in seeds(hashed(words, known), *kind_of(len(words), window, similarity)):
                    out["seed"] += hashes.view(np.int64).tolist()
                    out["item"] += [item] * len(hashes)
                    out["at"] += range(len(hashes))
            yield out

    return map_columns(items.select("item", "words"), kernel, "seed bigint, item bigint, at int")


def _bitmap(table: DataFrame, most_bits: int) -> np.ndarray:
    """A bitmap of the benchmark seeds, two bits each, of at most ``2 ** most_bits`` bits, joined in the executors.

    A document seed without both bits is in no item. The bitmap only saves rows: the join decides.
    """
    n = table.count()
    bits = min(most_bits, max(16, math.ceil(math.log2(max(n, 1) * 256))))
    whole = (1 << bits) - 1
    places = [F.shiftrightunsigned("seed", shift).bitwiseAND(F.lit(whole)) for shift in (64 - bits, _LOW)]
    place = F.explode(F.array(*places)).alias("place")
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = table.select(place).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    out = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _in_bitmap(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bits = 6 + len(bitmap).bit_length() - 1
    found = np.ones(len(hashes), bool)
    for shift in (64 - bits, _LOW):
        place = (hashes >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        found &= (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found


_REGION = "start int, words array<string>, hits array<struct<seed: bigint, at: int>>"


def _regions(docs: DataFrame, bitmap: np.ndarray, window: int, kinds: list[tuple[int, int]]) -> DataFrame:
    """Stretches of documents around possible seed hits, with the hits; documents are read once.

    ``kinds`` are the windows of the items. Of an item that must be equal as a whole the first place in a document is enough.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        known = WordHashes()
        for batch in batches:
            out = {n: [] for n in ("doc_id", "key", "start", "words", "hits")}
            for doc, key, text in zip(batch["doc_id"], batch["key"], batch["text"]):
                words, hits = words_of(text), []
                codes = hashed(words, known)
                for wide, off in kinds:
                    for hashes in seeds(codes, wide, off):
                        at = np.flatnonzero(_in_bitmap(hashes, shared.value))
                        if wide < SPAN and not off:
                            at = at[np.unique(hashes[at], return_index=True)[1]]
                        hits += zip(at.tolist(), hashes[at].view(np.int64).tolist())
                hits.sort()
                i = 0
                while i < len(hits):
                    j = i
                    while j + 1 < len(hits) and hits[j + 1][0] - hits[j][0] <= SPAN + 2 * window:
                        j += 1
                    start, end = max(0, hits[i][0] - window), hits[j][0] + SPAN + window
                    out["doc_id"].append(doc)
                    out["key"].append(key)
                    out["start"].append(start)
                    out["words"].append(words[start:end])
                    out["hits"].append([{"seed": s, "at": p} for p, s in hits[i : j + 1]])
                    i = j + 1
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_columns(docs, kernel, f"doc_id {kind}, key bigint, {_REGION}")


def overlap(words: list[str], start: int, item: list[str], shift: int, window: int, similarity: float):
    """(first word, words, equal words) of the item's overlap with the stretch, at item place = document place - shift.

    It is the widest cover by windows, or the whole of a shorter item, that agree in at least ``similarity`` of
    their words; None if no window does. An item of under ``SPAN`` words must be equal as a whole.
    """
    low, high = max(0, start - shift), min(len(item), start + len(words) - shift)
    wide, off = kind_of(len(item), window, similarity)
    if high - low < wide:
        return None
    equal = np.array([item[i] == words[i + shift - start] for i in range(low, high)])
    sums = np.convolve(equal, np.ones(wide, np.int64), "valid")
    good = np.flatnonzero(sums >= wide - off)
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + wide
    return low + first + shift, last - first, int(equal[first:last].sum())


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 13, similarity: float = 0.8, most_bits: int = 26, least_words: int = SPAN,
) -> DataFrame:
    """A row per document and item that overlap: ``doc_id, item_id, first_word, n_words, n_equal, key``.

    Words are runs of letters and digits in lower case, and single characters of scripts written without blanks, of whole texts. Where several alignments overlap, the one with most
    equal words is given (ties: the first). ``key`` is the hash of the document's text, which tells documents with
    one id apart. Items of fewer than ``least_words`` words never match; items under ``window`` words must agree as a
    whole, and those under 8 words in every word.

    Null and empty texts overlap with nothing. Null and repeated ids on either side are kept; rows repeated entirely
    give one row. Other columns are not read. An empty table on either side gives no rows. A seed that many documents
    hold is joined, never gathered.
    """
    items = materialize(
        benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
        .withColumn("item", F.monotonically_increasing_id()), "items",
    )

    def split(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield {"item": batch["item"], "item_id": batch["item_id"], "words": [words_of(t) for t in batch["text"]]}

    kind = items.schema["item_id"].dataType.simpleString()
    parted = map_columns(items, split, f"item bigint, item_id {kind}, words array<string>")
    items = materialize(parted.filter(F.size("words") >= max(1, least_words)), "items")
    lengths = items.select(F.least(F.size("words"), F.lit(max(window, SPAN))).alias("n")).distinct().collect()
    kinds = sorted({kind_of(r["n"], window, similarity) for r in lengths})
    table = materialize(_benchmark_seeds(items, window, similarity), "seeds")
    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    found = _regions(given, _bitmap(table, most_bits), window, kinds).withColumn("region", F.monotonically_increasing_id())
    regions = materialize(found, "regions")
    hits = regions.select("region", F.inline("hits")).withColumnRenamed("at", "place")
    laid = hits.join(table, "seed").select("region", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    pairs = laid.join(regions.drop("hits"), "region").join(items.withColumnRenamed("words", "item_words"), "item")

    def verify(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            out = {n: [] for n in ("doc_id", "key", "item", "item_id", "first_word", "n_words", "n_equal")}
            for i, words in enumerate(batch["words"]):
                seen = overlap(words, batch["start"][i], batch["item_words"][i], batch["shift"][i], window, similarity)
                if seen is not None:
                    for n in ("doc_id", "key", "item", "item_id"):
                        out[n].append(batch[n][i])
                    for n, v in zip(("first_word", "n_words", "n_equal"), seen):
                        out[n].append(v)
            yield out

    doc_kind = given.schema["doc_id"].dataType.simpleString()
    verified = map_columns(
        pairs.select("doc_id", "key", "item", "item_id", "start", "words", "item_words", "shift"), verify,
        f"doc_id {doc_kind}, key bigint, item bigint, item_id {kind}, first_word int, n_words int, n_equal int",
    )
    best = F.max_by(F.struct("first_word", "n_words", "n_equal"), F.struct("n_equal", -F.col("first_word"))).alias("best")
    return verified.groupBy("doc_id", "key", "item", "item_id").agg(best).select("doc_id", "item_id", "best.*", "key")


def without_contaminated(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id and text ``contaminated`` gave, nulls compared as values."""
    gone = materialize(found.select("doc_id", "key").distinct().toDF(*fresh(docs, "_of", "_key")), "gone")
    return matching(docs, gone, "left_anti", id_col, text_col)
