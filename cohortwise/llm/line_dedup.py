"""Fuzzy line deduplication by MinHash.

Character shingles of every distinct line are hashed into a signature, bands of it put lines into buckets, the
exact Jaccard similarity of bucket mates decides, and a distributed union-find makes classes of similar lines. Of each class
the first occurrence stays. Two numbers go with a line into its buckets, the count of its shingles and 64 bits of its signature:
mates whose counts differ too much cannot be similar, and mates whose bits differ too much are not, so few texts are moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.arrow import map_arrays, map_columns
from cohortwise.llm.components import components
from cohortwise.llm.rows import bounded_broadcast, fresh, matching, release
from cohortwise.session import materialize

SHINGLE = 5
BANDS, ROWS = 16, 5  # at a similarity of 0.8 a pair meets in one band with 99.8 %, at 0.9 with 99.9999 %
ALIKE = 0.9999  # the share of pairs at the bar whose sketches pass for alike, at least
_BLANK = " \t\n\x0b\x0c\r"
_WORDED = r"[^\x20\x09-\x0D][^\n]*"  # a line from its first word on
_CHUNK = 1 << 16  # characters that are hashed at a time
_DRAWS = np.random.default_rng(2024)
_SLOPES = _DRAWS.integers(1, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_SHIFTS = _DRAWS.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_FOLD, _STEP = np.uint32(0x9E3779B1), np.uint64(0x9E3779B97F4A7C15)


def shingles(line: str, width: int = SHINGLE) -> np.ndarray:
    """The character shingles of a line as sorted distinct 64-bit codes; a shorter line is one shingle."""
    points = np.frombuffer(line.ljust(width, "\x00").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points) - width + 1
    codes = points[:n].copy()
    for i in range(1, width):
        codes *= _STEP
        codes += points[i : i + n]
    return np.unique(codes)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def signatures(lines: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """MinHash signatures, one row per line, and the numbers of distinct shingles."""
    out, counts = np.empty((len(lines), BANDS * ROWS), np.uint32), np.empty(len(lines), np.int64)
    ends, at = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines))), 0
    while at < len(lines):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + _CHUNK, "right")))
        out[at:end], counts[at:end] = _signed([line if len(line) >= width else line.ljust(width, "\x00") for line in lines[at:end]], width)
        at = end
    return out, counts


def _signed(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    hashes = points[: len(points) - width + 1].copy()
    for i in range(1, width):
        hashes *= _FOLD
        hashes += points[i : len(points) - width + 1 + i]
    inside = np.ones(len(points), bool)
    ends = np.cumsum(lengths)
    for i in range(1, width):
        inside[ends - i] = False
    hashes = hashes[inside[: len(hashes)]]
    hashes ^= hashes >> np.uint32(15)
    hashes *= np.uint32(0x85EBCA6B)
    hashes ^= hashes >> np.uint32(13)
    codes = np.repeat(np.arange(len(lines), dtype=np.uint64) << np.uint64(32), lengths - width + 1)
    codes |= hashes
    codes.sort()
    codes = codes[_changes(codes)]
    hashes, counts = codes.astype(np.uint32), np.bincount((codes >> np.uint64(32)).astype(np.int64), minlength=len(lines))
    starts = np.cumsum(counts) - counts
    out, drawn = np.empty((len(_SLOPES), len(lines)), np.uint32), np.empty_like(hashes)
    for k, (slope, shift) in enumerate(zip(_SLOPES, _SHIFTS)):
        np.multiply(hashes, slope, out=drawn)
        np.add(drawn, shift, out=drawn)
        np.minimum.reduceat(drawn, starts, out=out[k])
    return out.T, counts


def sketches(signs: np.ndarray) -> np.ndarray:
    """64 bits per line, one of each of 64 values of its signature: two lines share a bit with (1 + similarity) / 2."""
    mixed = (signs[:, :64] ^ (signs[:, :64] >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return np.packbits((mixed >> np.uint32(31)).astype(np.uint8), axis=1).view(np.int64)[:, 0]


def bits_apart(similarity: float, alike: float = ALIKE) -> int:
    """The number of differing sketch bits that ``alike`` of the pairs at ``similarity`` do not exceed."""
    differ, at, reached = (1 - similarity) / 2, -1, 0.0
    while reached < alike and at < 64:
        at += 1
        reached += math.comb(64, at) * differ**at * (1 - differ) ** (64 - at)
    return at


def band_keys(signs: np.ndarray) -> np.ndarray:
    """One 32-bit key per line and band."""
    cut = signs.reshape(len(signs), BANDS, ROWS)
    keys = cut[:, :, 0].copy()
    for i in range(1, ROWS):
        keys = (keys ^ (keys >> np.uint32(16))) * _FOLD + cut[:, :, i]
    return keys ^ (keys >> np.uint32(15))


def _lines(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, at, parts, worded, hi, lo, n, sketch, bands) of every line with a word.

    128 bits of hash name the line without blanks around it; ``parts`` counts the lines of its text, ``worded`` those with a word.
    """

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            for i in range(0, len(batch["text"]), 1_000):
                yield from _batch_lines({n: v[i : i + 1_000] for n, v in batch.items()}, width)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_columns(docs, kernel, f"doc_id {kind}, key bigint, at int, parts int, worded int, hi bigint, lo bigint, n int, sketch bigint, bands array<int>")


def _batch_lines(batch: dict, width: int) -> Iterator[dict]:
    ats, which, places, parts, worded = [], [], {}, [], []
    for text in batch["text"]:
        lines = [line.strip(_BLANK) for line in (text or "").split("\n")]
        parts.append(len(lines))
        worded.append(len(lines) - lines.count(""))
        for at, x in enumerate(lines):
            if x:
                ats.append(at)
                which.append(places.setdefault(x, len(places)))
    if not which:
        return
    distinct, of, which = list(places), np.repeat(np.arange(len(parts)), worded), np.array(which)
    signs, counts = signatures(distinct, width)
    names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass")) for s in distinct), np.int64).reshape(-1, 2)[which]
    bands = pa.ListArray.from_arrays(np.arange(0, BANDS * len(which) + 1, BANDS, dtype=np.int32), band_keys(signs).view(np.int32)[which].ravel())
    yield {"doc_id": [batch["doc_id"][i] for i in of.tolist()], "key": np.array(batch["key"], np.int64)[of], "at": np.array(ats), "parts": np.array(parts)[of],
           "worded": np.array(worded)[of], "hi": names[:, 0], "lo": names[:, 1], "n": counts[which], "sketch": sketches(signs)[which], "bands": bands}


ROOM = 2_048  # members of a bucket whose pairs are looked at inside the task
_COUNT_BITS = 27  # beside the band and its key in one number; a larger count is cut to the most they hold, which rules out less


def _dealt(distinct: DataFrame) -> DataFrame:
    """(slot, id, sketch): every line once per bucket. ``slot`` is the bucket before the count, since each column costs time per row."""
    bucket = F.shiftleft(F.col("band").cast("bigint"), 32).bitwiseOR(F.col("band_key").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    count = F.least(F.col("n").cast("bigint"), F.lit((1 << _COUNT_BITS) - 1))
    slot = F.shiftleft(bucket, _COUNT_BITS).bitwiseOR(count)
    return distinct.select("id", "n", "sketch", F.posexplode("bands").alias("band", "band_key")).select(slot.alias("slot"), "id", "sketch")


def _unpacked(batch: dict) -> dict:
    slot = batch["slot"]
    return {"bucket": slot >> _COUNT_BITS, "id": batch["id"], "n": slot & ((1 << _COUNT_BITS) - 1), "sketch": batch["sketch"]}


def _mates(distinct: DataFrame, similarity: float, room: int) -> DataFrame:
    """(bucket, a, b): what is worth comparing. Buckets pass as a sorted stream.

    With a null bucket, a line and the first line of one of its buckets, in an order drawn for the bucket, whose counts and
    sketches allow the similarity. With a bucket, a member ``a`` that has another such mate there; of a bucket of more than ``room``
    lines all members.
    """
    bucket = F.shiftright("slot", _COUNT_BITS)  # without the count, which would put the shortest line of a bucket first
    ordered = _dealt(distinct).repartition(bucket).sortWithinPartitions(bucket)
    names, apart = ("bucket", "id", "n", "sketch"), bits_apart(similarity)

    def alike(rows: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, sketch = rows["n"], rows["sketch"]
        near = np.bitwise_count((sketch[i] ^ sketch[j]).view(np.uint64)) <= apart
        return near & (np.minimum(n[i], n[j]) >= (similarity - 1e-3) * np.maximum(n[i], n[j]))

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        held, speaker = None, None  # rows of a bucket that may go on; the first row of a bucket that outgrew its room
        for batch in _with_end(map(_unpacked, batches)):
            if batch is not None:
                held = batch if held is None else {c: np.concatenate([held[c], batch[c]]) for c in names}
            if held is None or not len(held["id"]):
                continue
            rows = held
            if speaker is not None:  # its bucket goes on in front
                goes = int(np.searchsorted(rows["bucket"] != speaker["bucket"][0], True))
                yield {"bucket": rows["bucket"][:goes].tolist(), "a": rows["id"][:goes].tolist(), "b": [None] * goes}
                joined = {c: np.concatenate([speaker[c], rows[c][:goes]]) for c in names}
                j = np.arange(1, goes + 1)
                j = j[alike(joined, np.zeros_like(j), j)]
                yield {"bucket": [None] * len(j), "a": [int(speaker["id"][0])] * len(j), "b": joined["id"][j].tolist()}
                rows = {c: rows[c][goes:] for c in names}
                held = rows
                if not len(rows["id"]):
                    continue
                speaker = None
            new = np.flatnonzero(np.r_[True, rows["bucket"][1:] != rows["bucket"][:-1]])
            last, total = int(new[-1]), len(rows["id"])
            if batch is None:
                held = None
            elif total - last > room:
                speaker = {c: rows[c][last : last + 1] for c in names}
                held = {c: rows[c][total:] for c in names}
            else:
                held, rows, new = {c: rows[c][last:] for c in names}, {c: rows[c][:last] for c in names}, new[:-1]
            sizes = np.diff(np.r_[new, len(rows["id"])])
            shared = np.repeat(sizes > 1, sizes)
            rows, sizes = {c: rows[c][shared] for c in names}, sizes[sizes > 1]
            turn = (rows["id"] ^ rows["bucket"] * np.int64(0x9E3779B1)) * np.int64(0x2545F4914F6CDD1D)
            order = np.lexsort((turn ^ (turn >> np.int64(29)), rows["bucket"]))
            rows, firsts = {c: rows[c][order] for c in names}, np.repeat(np.cumsum(sizes) - sizes, sizes)
            others = np.flatnonzero(firsts != np.arange(len(firsts)))
            others = others[alike(rows, firsts[others], others)]
            yield {"bucket": [None] * len(others), "a": rows["id"][firsts[others]].tolist(), "b": rows["id"][others].tolist()}
            wide = np.repeat(sizes > room, sizes)
            open_, here, step = wide.copy(), np.flatnonzero((firsts != np.arange(len(firsts))) & ~wide), 1
            while True:  # pairs without the first line, ``step`` places apart
                here = here[here + step < len(firsts)]
                here = here[firsts[here] == firsts[here + step]]
                if not len(here):
                    break
                near = here[alike(rows, here, here + step)]
                open_[near] = open_[near + step] = True
                step += 1
            found = np.flatnonzero(open_)
            yield {"bucket": rows["bucket"][found].tolist(), "a": rows["id"][found].tolist(), "b": [None] * len(found)}

    return map_arrays(ordered, kernel, "bucket bigint, a bigint, b bigint")


def _with_end(batches: Iterator[dict]) -> Iterator[dict | None]:
    yield from batches
    yield None


def _texts(ids: DataFrame, known: DataFrame, docs: DataFrame, small: int) -> DataFrame:
    """(id, line) of the given distinct lines, read from the documents where they occur first; only those documents are cut into lines."""
    wanted = known.join(ids, "id").groupBy(F.col("first.doc_id").alias("_of"), F.col("first.key").alias("_key")).agg(
        F.collect_list(F.struct("id", F.col("first.at").alias("at"))).alias("_wanted")  # of one document, which bounds it
    )
    same = F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("key") == F.col("_key"))
    held = docs.join(bounded_broadcast(materialize(wanted, "wanted"), small), same).withColumn("_parts", F.split("text", "\n"))
    line = lambda w: F.struct(w["id"].alias("id"), F.trim(F.get("_parts", w["at"]), F.lit(_BLANK)).alias("line"))
    return held.select(F.inline(F.transform("_wanted", line))).dropDuplicates(["id"])


def _mixed(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the lines one after the other, repeats included, as 64-bit hashes, and whose they are."""
    filled = [line.ljust(width, "\x00") for line in lines]
    points = np.frombuffer("".join(filled).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(line) for line in filled])
    n = len(points) - width + 1
    codes = points[:n].copy()
    for i in range(1, width):
        codes *= _STEP
        codes += points[i : i + n]
    codes ^= codes >> np.uint64(31)
    codes *= np.uint64(0xBF58476D1CE4E5B9)
    owners, inside = np.repeat(np.arange(len(lines), dtype=np.uint64), lengths), np.ones(len(points), bool)
    ends = np.cumsum(lengths)
    for i in range(1, width):
        inside[ends - i] = False
    return codes[inside[:n]], owners[:n][inside[:n]]


def _pair_codes(lines: list[str], width: int) -> np.ndarray:
    """The distinct shingles of the lines, each as its line's place in ten bits and 54 bits of hash, sorted."""
    codes, owners = _mixed(lines, width)
    codes = np.sort(owners << np.uint64(54) | codes >> np.uint64(10))
    return codes[np.r_[True, codes[1:] != codes[:-1]]]


def similarities(left: list[str], right: list[str], width: int) -> np.ndarray:
    """The Jaccard similarities of the pairs of lines, many at a time."""
    out, at = np.empty(len(left)), 0
    while at < len(left):
        end, size = at, 0
        while end < len(left) and end - at < 1_000 and (end == at or size + len(left[end]) + len(right[end]) <= _CHUNK):
            size += len(left[end]) + len(right[end])
            end += 1
        sides = [_pair_codes(side[at:end], width) for side in (left, right)]
        both = np.sort(np.concatenate(sides))
        count = lambda codes: np.bincount((codes >> np.uint64(54)).astype(np.int64), minlength=end - at)
        shared = count(both[1:][both[1:] == both[:-1]])
        out[at:end] = shared / (count(sides[0]) + count(sides[1]) - shared)
        at = end
    return out


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs (a, b) whose lines are at least ``similarity`` alike, by their shingle sets."""
    both = pairs.join(texts.toDF("b", "line_b"), "b").join(texts.toDF("a", "line_a"), "a")

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            kept = np.flatnonzero(similarities(batch["line_a"], batch["line_b"], width) >= similarity)
            yield {"a": [batch["a"][i] for i in kept], "b": [batch["b"][i] for i in kept]}

    return map_columns(both.select("a", "b", "line_a", "line_b"), kernel, "a bigint, b bigint")


TILE, TILE_CHARS = 512, 2_000_000  # lines and characters of a tile; a task holds two
_CELLS, _OFTEN = 1 << 20, 6  # numbers that are held at once; a shingle in a sixth of the lines is counted by a matrix product


def _changes(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before, the first included."""
    out = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=out[1:])
    return out


def overlaps(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of distinct shingles of the lines, and above the diagonal how many of them every two lines share.

    A shingle that many of the lines hold is a column of a matrix of zeros and ones, one that few hold is written out as their pairs.
    """
    n, (codes, owners) = len(lines), _mixed(lines, width)
    bits = np.uint64((n - 1).bit_length())
    codes >>= bits
    codes <<= bits
    codes |= owners
    codes.sort()
    codes = codes[_changes(codes)]
    rows = (codes & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    codes >>= bits
    starts = np.flatnonzero(_changes(codes))
    holders = np.diff(starts, append=len(codes))
    often = (holders > 1) & (holders * _OFTEN >= n)
    shared, sizes = np.zeros((n, n), np.int64), holders[often]
    of, column = rows[np.repeat(often, holders)], np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(sizes), step := max(1, _CELLS // n)):
        part = slice(*np.searchsorted(column, [at, at + step]))
        held = np.zeros((n, min(step, len(sizes) - at)), np.float32)
        held[of[part], column[part] - at] = 1
        shared += (held @ held.T).astype(np.int64)
    few = (holders > 1) & ~often
    for size in np.unique(holders[few]):
        heads, (i, j) = starts[few & (holders == size)], np.triu_indices(size, 1)
        for at in range(0, len(heads), step := max(1, _CELLS // len(i))):
            who = rows[heads[at : at + step, None] + np.arange(size)]
            shared += np.bincount((who[:, i] * n + who[:, j]).ravel(), minlength=n * n).reshape(n, n)
    return np.bincount(rows, minlength=n), shared


def _compared(members: DataFrame, similarity: float, width: int, tile: int) -> DataFrame:
    """Links (a, b) between lines (bucket, id, root, line) of one bucket and different roots that are similar.

    A bucket is cut into tiles by hash, and every two tiles of it are compared by one task, so no task follows the size of a bucket
    and no pair is written. Of the similar pairs of two tiles only a spanning set is returned.
    """
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("line")).alias("chars"))
    tiles = F.ceil(F.greatest(F.col("m") / tile, F.col("chars") / TILE_CHARS)).cast("int")
    cut = members.join(materialize(sizes.select("bucket", tiles.alias("tiles")), "sizes"), "bucket")
    own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    met = cut.select("bucket", "id", "root", "line", own.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    met = met.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
    group = ["bucket", "low", "high"]
    ordered = met.select(*group, "tile", "id", "root", "line").repartition(*group).sortWithinPartitions(*group)

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        tile, ids, roots, lines = zip(*rows)
        tile, same = np.array(tile), len(set(tile)) == 1
        classes = {r: i for i, r in reversed(list(enumerate(roots)))}
        parent = [classes[r] for r in roots]

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        counts, shared = overlaps(list(lines), width)
        names, found = np.array(parent), []
        near = np.triu(shared >= similarity * (counts + counts[:, None] - shared), 1) & (names != names[:, None])
        for i, j in np.argwhere(near & (same | (tile != tile[:, None]))).tolist():
            a, b = top(i), top(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((ids[i], ids[j]))
        return found

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        at, held = None, []
        for batch in _with_end(batches):
            found = []
            for row in zip(*batch.values()) if batch is not None else [(None,) * 7]:
                if held and row[:3] != at:
                    found += links(held)
                    held = []
                at = row[:3]
                held.append(row[3:])
            yield {"a": [f[0] for f in found], "b": [f[1] for f in found]}

    return map_columns(ordered, kernel, "a bigint, b bigint")


def _classes(distinct: DataFrame, known: DataFrame, docs: DataFrame, similarity: float, small: int, width: int, room: int, tile: int) -> DataFrame:
    """(node, root) of the distinct lines that are similar to another: the components of the verified links.

    Lines are first compared with the first of each of their buckets. Buckets that then still hold several classes have all
    pairs of lines of different classes compared, so every two bucket mates are compared or in one class.
    """
    mates = materialize(_mates(distinct, similarity, room), "mates")
    pairs = mates.filter("bucket is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(mates.filter("bucket is not null").select(F.col("a").alias("id")))
    texts = materialize(_texts(ids.distinct(), known, docs, small), "texts")
    links = materialize(_verified(pairs, texts, similarity, width), "links")
    roots = materialize(components(links, "lines"), "roots")
    open_ = mates.filter("bucket is not null").select("bucket", F.col("a").alias("id")).join(roots.withColumnRenamed("node", "id"), "id", "left")
    open_ = materialize(open_.withColumn("root", F.coalesce("root", "id")), "open")
    several = open_.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("bucket")
    members = materialize(open_.join(several, "bucket").join(texts, "id"), "members")
    if members.isEmpty():
        return roots
    more = materialize(_compared(members, similarity, width, tile), "links")
    release(mates, texts, members)
    return components(links.unionByName(more), "lines")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, names=("n_lines", "n_kept"),
    small: int = 1_000_000, shingle: int = SHINGLE, room: int = ROOM, tile: int = TILE,
) -> DataFrame:
    """``docs`` with fewer lines: of every class of similar lines only the first occurrence stays.

    Lines are parted at line feeds; blanks around a line do not count, and lines without a word go. Lines are similar if the Jaccard
    similarity of their shingles of ``shingle`` characters is at least ``similarity``; classes are the connected components of that. First
    means the smallest id, then the text's hash, then the place in the text. Kept lines stand in their old order, unchanged. The lines with a
    word before and after are counted under ``names``; columns of ``docs`` with these names give way.

    A null text stays null, a text whose lines all go becomes empty; no row goes. A null id comes before all others; rows
    with equal id and text count as one document and keep the same lines. Other columns are passed on unread. No rows in, no rows out. A line
    that many documents hold is one row after the first, pre-aggregated step. ``small`` is the row bound of a broadcast
    table; beyond it the join is shuffled. ``room`` bounds the members of a bucket that a task holds as numbers, ``tile`` half of those
    that it holds as texts; larger buckets are compared tile by tile.
    """
    docs = docs.drop(*names)
    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    lines = _lines(given, shingle)
    of_line = [F.first(c).alias(c) for c in ("n", "sketch", "bands")]
    firsts = lines.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "key", "at", "parts", "worded")).alias("first"), *of_line)
    distinct = materialize(firsts.select(F.monotonically_increasing_id().alias("id"), "first", "n", "sketch", "bands"), "distinct")
    known = distinct.select("id", "first")
    roots = materialize(_classes(distinct, known, given, similarity, small, shingle, room, tile), "classes")
    rooted = known.join(roots.withColumnRenamed("node", "id"), "id", "left")
    kept = rooted.groupBy(F.coalesce("root", "id").alias("class")).agg(F.min("first").alias("first"))
    of, key, places, parts, worded, cut = fresh(docs, "_of", "_key", "_places", "_parts", "_worded", "_cut")
    kept = kept.groupBy(F.col("first.doc_id").alias(of), F.col("first.key").alias(key)).agg(
        F.sort_array(F.collect_list("first.at")).alias(places),  # of one document, which bounds it
        F.first("first.parts").alias(parts), F.first("first.worded").alias(worded),
    )
    joined = matching(docs, materialize(kept, "kept"), "left", id_col, text_col)
    fewer = F.concat_ws("\n", F.transform(places, lambda i: F.get(cut, i)))
    whole = F.col(text_col).isNull() | F.coalesce(F.size(places) == F.col(parts), F.lit(False))
    return (
        joined.withColumn(cut, F.when(F.size(places) < F.col(parts), F.split(text_col, "\n")))
        .withColumn(names[0], F.coalesce(worded, F.regexp_count(text_col, F.lit(_WORDED)), F.lit(0)).cast("bigint"))
        .withColumn(names[1], F.when(F.col(places).isNull(), 0).otherwise(F.size(places)).cast("bigint"))
        .withColumn(text_col, F.when(whole, F.col(text_col)).when(F.col(cut).isNull(), "").otherwise(fewer))
        .drop(places, parts, worded, cut)
    )
