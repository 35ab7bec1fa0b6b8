"""Substring deduplication by level-wise doubling.

A window of words that is repeated has repeated parts, so only windows repeated at one length are extended to twice that length. The
shortest windows are taken at anchors: places whose hash is the least among their neighbours. Equal text has equal anchors, and
every window of the full length holds one. After the first level only the regions around repeated anchors are read, as word
hashes. At the full length the windows between two anchors are first compared as one piece; a piece that
is found twice settles all its windows, and single windows are compared for the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.arrow import SLICE
from cohortwise.llm.rows import bounded_broadcast, fresh, matching, release
from cohortwise.llm.vectors import map_batches
from cohortwise.llm.words import BLANKS, word_list
from cohortwise.session import materialize

WINDOW, BASE = 35, 9
_CHUNK = 1 << 20  # bytes of a text that are hashed at a time
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True
# Odd multipliers of the hashes.
_BYTE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_PAIR, _MIX, _LANE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the byte multiplier and of its inverse, of exponents up to ``n`` at least."""
    if len(_POWERS[0]) <= n:
        size = 1 << n.bit_length()
        for i, base in enumerate((_BYTE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word of a text, in order."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    blank = _BLANK[raw]
    edges = np.flatnonzero(np.diff(np.r_[False, ~blank, False].astype(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(stops, starts[at] + _CHUNK, "right")))
        first, last = starts[at], stops[end - 1]
        power, inverse = _powers(int(last - first))
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum((raw[first:last].astype(np.uint64) + np.uint64(1)) * power[: last - first], out=sums[1:])
        own = starts[at:end] - first
        out[at:end] = _mixed((sums[stops[at:end] - first] - sums[own]) * inverse[own])
        at = end
    return out


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of every window of ``length`` words: windows are joined in pairs, to twice the length each time."""
    out, size = words, 1
    while size < length and len(out):
        step = min(size, length - size)
        out = _mixed(out[:-step] * _PAIR + out[step:])
        size += step
    return out if size == length else words[:0]


def _lanes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return words, _mixed(words * _LANE + _PAIR)


def window_names(words: np.ndarray, length: int) -> list[np.ndarray]:
    """128 bits that name every window of ``length`` words, as two arrays."""
    return [window_hashes(lane, length) for lane in _lanes(words)]


def span_names(words: np.ndarray, first: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
    """128 bits that name the words from each ``first`` to its ``stop``, as two arrays."""
    power, inverse = _powers(len(words))
    out = []
    for lane in _lanes(words):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lane * power[: len(words)], dtype=np.uint64)])
        out.append(_mixed((sums[stop] - sums[first]) * inverse[first]))
    return out


def _sliding(join, values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size < width:
        step = min(size, width - size)
        values = join(values[:-step], values[step:])
        size += step
    return values


def anchors(words: np.ndarray, window: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the windows of ``base`` words that are the least in some window of ``window`` words; ties all count."""
    if len(words) < window:
        return np.empty(0, np.int64), words[:0]
    hashes, width = window_hashes(words, base), window - base + 1
    least = _sliding(np.minimum, hashes, width)
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    at = np.flatnonzero(_sliding(np.maximum, around, width) == hashes)
    return at, hashes[at]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)])
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, kind))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Slices of the batches as {column: list of Python values, or of arrays where the column holds lists of numbers}."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            part, out = batch.slice(i, SLICE), {}
            for name, column in zip(part.schema.names, part.columns):
                if pa.types.is_list(column.type):
                    ends = column.offsets.to_numpy()
                    values = column.values.to_numpy(zero_copy_only=False)
                    out[name] = [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
                else:
                    out[name] = column.to_pylist()
            yield out


def _anchored(docs: DataFrame, window: int, base: int) -> DataFrame:
    """(doc_id, key, n_words, at, hashes) of every text of at least ``window`` words."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in _slices(batches):
            found = []
            for doc, key, text in zip(part["doc_id"], part["key"], part["text"]):
                words = word_hashes(text)
                at, hashes = anchors(words, window, base)
                if len(at):
                    found.append((doc, key, len(words), at, hashes))
            doc, key, n, at, hashes = zip(*found) if found else [()] * 5
            yield {"doc_id": list(doc), "key": list(key), "n_words": list(n), "at": _lists(list(at), pa.int32()), "hashes": _lists(list(hashes), pa.int64())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, kernel, f"doc_id {kind}, key bigint, n_words int, at array<int>, hashes array<bigint>")


def _repeated(rows: DataFrame, *names: str) -> DataFrame:
    """The rows whose values of ``names`` are there more than once.

    Counts are made before the shuffle, and no group is gathered. The counts are written, so the planner knows how many
    there are; it splits a frequent value's rows.
    """
    counts = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*names)
    return rows.join(materialize(counts, "repeated"), list(names), "left_semi")


def _by_doc(rows: DataFrame, tag: str) -> DataFrame:
    """(doc_no, at): the places of each document, which its length bounds; written."""
    return materialize(rows.groupBy("doc_no").agg(F.sort_array(F.collect_set("at")).alias("at")), tag)


def _regions(docs: DataFrame, places: DataFrame, window: int, base: int) -> DataFrame:
    """(doc_no, at, starts, sizes, words): the word hashes of all that a window with a repeated anchor may cover, a row per document."""
    given = matching(docs, places, "inner", "doc_id", "text").select("doc_no", "at", "text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in _slices(batches):
            starts, sizes, kept = [], [], []
            for text, at in zip(part["text"], part["at"]):
                words = word_hashes(text)
                low, high = np.maximum(at.astype(np.int64) - (window - base), 0), np.minimum(at.astype(np.int64) + window, len(words))
                new = np.r_[True, low[1:] > high[:-1]]
                first, last = low[new], high[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]]
                starts.append(first)
                sizes.append(last - first)
                kept.append(np.concatenate([words[a:b] for a, b in zip(first, last)]))
            at = _lists(part["at"], pa.int32())
            yield {"doc_no": part["doc_no"], "at": at, "starts": _lists(starts, pa.int32()), "sizes": _lists(sizes, pa.int32()), "words": _lists(kept, pa.int64())}

    return map_batches(given, kernel, "doc_no bigint, at array<int>, starts array<int>, sizes array<int>, words array<bigint>")


class _Doc:
    """The regions of one document laid end to end: places in the text and in the row, and where each region ends."""

    def __init__(self, starts: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> None:
        self.starts, self.words = starts.astype(np.int64), words.view(np.uint64)
        self.ends = np.cumsum(sizes.astype(np.int64))
        self.shift = self.starts - (self.ends - sizes)

    def fitting(self, at: np.ndarray, length: int) -> np.ndarray:
        """The places among ``at``, sorted and once each, where a window of ``length`` lies inside a region, as places in the row."""
        at = np.unique(at)
        region = np.maximum(np.searchsorted(self.starts, at, "right") - 1, 0)
        here = at - self.shift[region]
        begins = self.starts[region] - self.shift[region]
        return here[(here >= begins) & (here + length <= self.ends[region])]

    def place(self, here: np.ndarray) -> np.ndarray:
        return here + self.shift[np.searchsorted(self.ends, here, "right")]


def _extended(regions: DataFrame, length: int, longer: int, window: int) -> DataFrame:
    """(doc_no, at, hash): the windows of ``longer`` words that begin or end with a repeated one of ``length``, or all around it if they must."""
    shifts = np.array([0, length - longer]) if window - longer >= longer - length - 1 else np.arange(length - longer, 1)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in _slices(batches):
            docs, ats, names = [], [], []
            for doc, at, *row in zip(*[part[n] for n in ("doc_no", "at", "starts", "sizes", "words")]):
                laid = _Doc(*row)
                here = laid.fitting((at[:, None] + shifts).ravel(), longer)
                docs.append(np.full(len(here), doc))
                ats.append(laid.place(here))
                names.append(window_hashes(laid.words, longer)[here].view(np.int64))
            yield {"doc_no": np.concatenate(docs), "at": np.concatenate(ats), "hash": np.concatenate(names)}

    return map_batches(regions, kernel, "doc_no bigint, at int, hash bigint")


def _pieces(regions: DataFrame, length: int, window: int) -> DataFrame:
    """(doc_no, at, n, hi, lo): the windows around repeated ones of ``length``, cut at those into pieces of ``n`` starts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in _slices(batches):
            out = []
            for doc, at, *row in zip(*[part[n] for n in ("doc_no", "at", "starts", "sizes", "words")]):
                laid = _Doc(*row)
                here = laid.fitting((at.astype(np.int64)[:, None] - np.arange(window - length + 1)).ravel(), window)
                if not len(here):
                    continue
                cut = np.isin(laid.place(here), at) | np.r_[True, np.diff(here) != 1]
                firsts = np.flatnonzero(cut)
                counts = np.diff(np.r_[firsts, len(here)])
                names = span_names(laid.words, here[firsts], here[firsts] + counts - 1 + window)
                out.append((np.full(len(firsts), doc), laid.place(here[firsts]), counts, *[x.view(np.int64) for x in names]))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 5
            yield dict(zip(("doc_no", "at", "n", "hi", "lo"), columns))

    return map_batches(regions, kernel, "doc_no bigint, at int, n int, hi bigint, lo bigint")


def _windows(regions: DataFrame, window: int) -> DataFrame:
    """(hi, lo, weight, doc_no, at): the single windows of the pieces (at, n, weight) of each row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in _slices(batches):
            out = []
            for doc, at, n, weight, *row in zip(*[part[x] for x in ("doc_no", "at", "n", "weight", "starts", "sizes", "words")]):
                laid = _Doc(*row)
                n = n.astype(np.int64)
                starts = np.repeat(at - np.cumsum(n) + n, n) + np.arange(n.sum())
                weights = np.repeat(weight, n)
                order = np.argsort(starts, kind="stable")
                here, weights = laid.fitting(starts, window), weights[order]
                names = [x[here].view(np.int64) for x in window_names(laid.words, window)]
                out.append((*names, weights, np.full(len(here), doc), laid.place(here)))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 5
            yield dict(zip(("hi", "lo", "weight", "doc_no", "at"), columns))

    return map_batches(regions, kernel, "hi bigint, lo bigint, weight int, doc_no bigint, at int")


def _covered(regions: DataFrame, length: int, window: int) -> DataFrame:
    """(doc_no, first, stop): words that a window repeated somewhere covers, from regions with the repeated windows of ``length``."""
    pieces = materialize(_pieces(regions, length, window), "pieces")
    name = ["hi", "lo", "n"]
    several = pieces.groupBy(*name).agg(F.count(F.lit(1)).alias("_c"), F.min("doc_no").alias("_speaker")).filter("_c > 1").drop("_c")
    judged = pieces.join(materialize(several, "several"), name, "left")
    judged = materialize(judged.select("doc_no", "at", "n", "_speaker"), "judged")
    release(pieces)
    whole = judged.filter("_speaker is not null").select("doc_no", F.col("at").alias("first"), (F.col("at") + F.col("n") + (window - 1)).alias("stop"))
    # One document speaks for a piece that is found twice, so that other pieces' windows can meet its windows.
    asked = judged.filter("_speaker is null or _speaker = doc_no").withColumn("weight", F.when(F.col("_speaker").isNull(), 1).otherwise(2))
    asked = asked.groupBy("doc_no").agg(F.collect_list(F.struct("at", "n", "weight")).alias("p"))
    asked = materialize(asked.select("doc_no", *[F.col(f"p.{c}").alias(c) for c in ("at", "n", "weight")]), "asked")
    given = regions.drop("at").join(bounded_broadcast(asked), "doc_no")
    windows = materialize(_windows(given, window), "windows")
    counts = windows.groupBy("hi", "lo").agg(F.sum("weight").alias("_n"), F.min("weight").alias("_least"))
    twice = materialize(counts.filter("_n > 1 and _least = 1").select("hi", "lo"), "twice")
    single = windows.filter("weight = 1").join(twice, ["hi", "lo"], "left_semi")
    return whole.unionByName(single.select("doc_no", F.col("at").alias("first"), (F.col("at") + window).alias("stop")))


def _merged(spans: DataFrame) -> DataFrame:
    """(doc_id, key, kept, n_removed): the runs of words (at, n) that stay, of rows (doc_id, key, n_words, spans)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows = batch.select(["doc_id", "key", "n_words", "spans"]).to_pylist()
            kept, removed = [], []
            for row in rows:
                runs, at, gone = [], 0, 0
                for span in sorted((s["first"], s["stop"]) for s in row["spans"]):
                    if span[0] > at:
                        runs.append({"at": at, "n": span[0] - at})
                    gone += max(0, span[1] - max(span[0], at))
                    at = max(at, span[1])
                if at < row["n_words"]:
                    runs.append({"at": at, "n": row["n_words"] - at})
                kept.append(runs)
                removed.append(gone)
            yield {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "kept": kept, "n_removed": removed}

    kind = spans.schema["doc_id"].dataType.simpleString()
    return map_batches(spans, kernel, f"doc_id {kind}, key bigint, kept array<struct<at: int, n: int>>, n_removed bigint")


def repeated_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, base: int = BASE
) -> DataFrame:
    """(doc_id, key, kept, n_removed) of every document with a window of ``window`` words that also starts anywhere else; written.

    ``key`` is the hash of the text, ``kept`` the runs (at, n) of words that no such window covers. Rows that agree in id and text
    make one row here and are copies of each other. Levels are ``base`` words, twice that and so on up to ``window``.
    """
    if not 1 <= base < window:
        raise ValueError("the first level must be shorter than the window")
    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    anchored = materialize(_anchored(given, window, base).withColumn("doc_no", F.monotonically_increasing_id()), "anchors")
    found, known = anchored, materialize(anchored.select("doc_no", "doc_id", "key", "n_words"), "known")
    same = known.groupBy("doc_id", "key", "n_words").agg(F.min("doc_no").alias("doc_no"), F.count(F.lit(1)).alias("_n"))
    same = materialize(same.filter("_n > 1"), "same")
    twins = not same.isEmpty()
    if twins:
        again = known.join(bounded_broadcast(same.select(F.col("doc_id").alias("_i"), F.col("key").alias("_k"), F.col("doc_no").alias("_first"))),
                           F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("key") == F.col("_k")) & (F.col("doc_no") != F.col("_first")))
        again = bounded_broadcast(materialize(again.select("doc_no"), "again"))
        found, known = found.join(again, "doc_no", "left_anti"), known.join(again, "doc_no", "left_anti")
    seeds = found.select("doc_no", F.inline(F.arrays_zip("at", "hashes"))).withColumnRenamed("hashes", "hash")
    places = _by_doc(_repeated(seeds, "hash"), "places")
    first = known.join(bounded_broadcast(places), "doc_no").select(F.col("doc_id").alias("_of"), F.col("key").alias("_key"), "doc_no", "at")
    first = materialize(first, "first")
    release(anchored)
    laid = materialize(_regions(given.drop("key"), first, window, base), "regions")
    here, length = laid, base
    while not here.isEmpty():
        longer = min(2 * length, window)
        if longer == window:
            spans = _covered(here, length, window)
            break
        longer_windows = materialize(_extended(here, length, longer, window), "windows")
        at, length = _by_doc(_repeated(longer_windows, "hash"), "places"), longer
        release(longer_windows)
        here = laid.drop("at").join(bounded_broadcast(at), "doc_no")
    else:
        spans = docs.sparkSession.createDataFrame([], "doc_no bigint, first int, stop int")
    if twins:
        spans = spans.unionByName(same.select("doc_no", F.lit(0).alias("first"), F.col("n_words").alias("stop")))
    spans = spans.groupBy("doc_no").agg(F.collect_list(F.struct("first", "stop")).alias("spans"))
    return materialize(_merged(known.join(spans, "doc_no").select("doc_id", "key", "n_words", "spans")), "kept")


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, base: int = BASE, names=("n_words", "n_removed"),
) -> DataFrame:
    """``docs`` without the words that a repeated window covers, every occurrence included; counts stand under ``names``.

    A window is ``window`` words in a row of one document; it is repeated if its words also start anywhere else, in the same
    document or in another. All windows are judged on the texts as given. Where words go, those that stay are joined by one
    space; other texts are passed on unchanged, a null text stays null with no words. Rows equal in id and text are documents of their
    own, so all their windows are repeated. Null ids are ids like any other. Texts of under ``window`` words lose nothing. Other columns are passed on unread; those
    named like ``names`` give way. No row goes. A frequent window is counted before it is shuffled, and never gathered.
    """
    docs = docs.drop(*names)
    of, key, kept, gone = fresh(docs, "_of", "_key", "_kept", "_gone")
    joined = matching(docs, repeated_words(docs, id_col, text_col, window, base).toDF(of, key, kept, gone), "left", id_col, text_col)
    (words,) = fresh(joined, "_words")
    runs = F.flatten(F.transform(kept, lambda r: F.slice(words, r["at"] + 1, r["n"])))
    return (
        joined.withColumn(words, word_list(F.col(text_col)))
        .withColumn(names[0], F.size(words).cast("bigint"))
        .withColumn(names[1], F.coalesce(gone, F.lit(0)).cast("bigint"))
        .withColumn(text_col, F.when(F.col(kept).isNull(), F.col(text_col)).otherwise(F.array_join(runs, " ")))
        .drop(kept, gone, words)
    )
