"""SimHash near-duplicates: every pair of fingerprints within two bits, found in vantage-point shards.

A level of the tree measures the Hamming distance to a vantage point over one block of the bits, and
its children are the distance rings. Blocks are disjoint, so by the triangle inequality the ring
numbers of two fingerprints differ in sum by at most their Hamming distance. A shard is a leaf: one ring
per level. A fingerprint goes to its own shard and to those whose rings differ by one in one level; all others are
pruned. Two fingerprints within two bits then meet in at least one shard, so the pairs are exact.
Shards that still hold many fingerprints are cut again with blocks of a single bit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.arrow import map_arrays, map_columns
from cohortwise.llm.components import components
from cohortwise.llm.rows import distinct_rows, fresh, matching
from cohortwise.llm.words import word_bytes
from cohortwise.session import materialize

# The seed of the shingle hash and the widest pair distance the shards are laid out for.
SEED, BITS_APART = 42, 2
_CHUNK = 1 << 16


def fingerprint(text: str | None, width: int) -> int:
    """The signed 64-bit SimHash of a text's word shingles, A-Z in lower case; 0 without words."""
    words = [w.lower() for w in word_bytes(text)]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts, stops = [0, *ends[:-1].tolist()], (ends - 1).tolist()
    if len(words) < width:
        starts, stops = starts[:1], stops[-1:]
    else:
        starts, stops = starts[: len(words) - width + 1], stops[width - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), _CHUNK):
        part = range(i, min(i + _CHUNK, len(starts)))
        hashes = np.fromiter((digest(joined[starts[j] : stops[j]], SEED) for j in part), np.uint64, len(part))
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, key, fingerprint) per row; ``key`` is the hash of the text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "key": batch["key"], "fingerprint": [fingerprint(t, width) for t in batch["text"]]}

    return map_columns(rows, kernel, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key bigint, fingerprint bigint")


def _ring_shards(bits: Column, block: int) -> Column:
    """The shards of a fingerprint in the tree with levels of ``block`` bits: its own and the adjoining ones.

    The rings are packed into one number. The vantage point is zero in every block; the fingerprints are hashes, so no
    other point would cut them better.
    """
    levels, size = 64 // block, 64 // (64 // block) // 2
    whole = (1 << block) - 1
    signed = lambda n: n - (1 << 64) if n >= 1 << 63 else n
    rings = [F.bit_count(bits.bitwiseAND(F.lit(signed(whole << (block * i))))).cast("bigint") for i in range(levels)]
    home = rings[0]
    for i, ring in enumerate(rings[1:], 1):
        home = home + F.shiftleft(ring, size * i)
    steps = [0] + [s << (size * i) for i in range(levels) for s in (1, -1)]
    return F.transform(F.array(*[F.lit(s) for s in steps]), lambda s: home + s)


def _bit_shards(bits: Column) -> Column:
    """Levels of one bit: the shards are the fingerprint itself and those with one bit turned."""
    turned = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    return F.transform(F.array(F.lit(0), *[F.lit(t) for t in turned]), lambda m: bits.bitwiseXOR(m))


def _pairs(shards: DataFrame, apart: int, room: int | None) -> DataFrame:
    """Pairs (a, b) within ``apart`` bits of shards (shard, x), each shard searched as a stream.

    A shard of more than ``room`` fingerprints is not searched; its members come back as (a, null).
    """
    ordered = shards.repartition("shard").sortWithinPartitions("shard", "x")

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        left = (np.empty(0, np.int64), np.empty(0, np.int64))
        wide = None  # the shard that has already outgrown its room
        for batch in _with_end(batches):
            if batch is not None:
                left = tuple(np.concatenate([o, batch[n]]) for o, n in zip(left, ("shard", "x")))
            shard, x = left
            if not len(shard):
                continue
            starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            sizes = np.diff(np.r_[starts, len(shard)])
            big = np.zeros(len(starts), bool) if room is None else sizes > room
            big |= shard[starts] == wide if wide is not None else False
            if batch is not None and not big[-1]:  # the last shard may go on
                cut = starts[-1]
                left, starts, sizes, big = (shard[cut:], x[cut:]), starts[:-1], sizes[:-1], big[:-1]
                shard, x = shard[:cut], x[:cut]
            else:
                left = (shard[:0], x[:0])
            wide = shard[-1] if len(big) and big[-1] else wide
            large = np.repeat(big, sizes)
            found = [(x[large], None)]
            shard, x = shard[~large], x[~large]
            here, step = np.arange(len(x)), 1
            while True:
                here = here[here + step < len(x)]
                here = here[shard[here] == shard[here + step]]
                if not len(here):
                    break
                near = here[np.bitwise_count(np.bitwise_xor(x[here], x[here + step]).view(np.uint64)) <= apart]
                found.append((x[near], x[near + step]))
                step += 1
            a = np.concatenate([f for f, _ in found])
            b = np.concatenate([t for _, t in found[1:]]) if len(found) > 1 else np.empty(0, np.int64)
            yield {"a": a.tolist(), "b": [None] * len(found[0][0]) + b.tolist()}

    return map_arrays(ordered, kernel, "a bigint, b bigint").distinct()


def _with_end(batches: Iterator[dict]) -> Iterator[dict | None]:
    yield from batches
    yield None


def near_pairs(prints: DataFrame, apart: int = BITS_APART, block: int = 8, room: int = 512) -> DataFrame:
    """All pairs (a, b) of the distinct fingerprints in column ``x`` that differ in at most ``apart`` bits.

    Blocks of 8 bits send a fingerprint to 17 shards. Members of shards with more than ``room`` of them go on to single-bit
    blocks, 65 shards each, none of which can hold more than 65 fingerprints. Both searches are exact.
    """
    if not 0 <= apart <= BITS_APART:
        raise ValueError(f"shards are laid out for at most {BITS_APART} bits")
    first = _pairs(prints.select(F.explode(_ring_shards(F.col("x"), block)).alias("shard"), "x"), apart, room)
    first = materialize(first, "pairs")
    dense = first.filter("b is null").select(F.col("a").alias("x"))
    again = _pairs(dense.select(F.explode(_bit_shards(F.col("x"))).alias("shard"), "x"), apart, None)
    return first.filter("b is not null").unionByName(again)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, apart: int = BITS_APART
) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id, key, class``.

    The fingerprint has 16 lower-case hex digits, the component is the smallest id that can be reached over
    fingerprints at most ``apart`` bits apart, the document itself included; ``class`` names the component by its
    smallest fingerprint and ``key`` is the hash of the text. Equal fingerprints are searched once,
    however many documents share one.

    A null or empty text, or one without words, has fingerprint zero and is linked like any other. Fewer words than
    ``width`` are one shingle. Null ids get a component like all others but never name one, unless all its
    ids are null, then it is null; repeated ids keep their rows. Other columns are not read. No rows in, no rows out.
    """
    given = materialize(fingerprints(docs, id_col, text_col, width), "prints")
    nodes = materialize(given.groupBy(F.col("fingerprint").alias("x")).agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(near_pairs(nodes.select("x"), apart), "simhash")
    rooted = nodes.join(roots, F.col("x") == F.col("node"), "left").select(
        "x", "first", F.coalesce("root", "x").alias("root")
    )
    rooted = materialize(rooted, "roots")
    smallest = rooted.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component_id"))
    classes = materialize(rooted.join(smallest, F.col("root") == F.col("of")).select("x", "component_id", "root"), "classes")
    return given.join(classes, F.col("fingerprint") == F.col("x")).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id", "key",
        F.col("root").alias("class"),
    )


def one_per_class(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, apart: int = BITS_APART
) -> DataFrame:
    """``docs`` with one row of each class of ``near_duplicates``: the smallest id, then the smallest hash of the text.

    Null ids come last; of rows that agree in id and text one stays. All columns are passed on unread, whatever their names.
    """
    classes = materialize(near_duplicates(docs, id_col, text_col, width, apart).select("doc_id", "key", "class"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    first = classes.groupBy(F.col("class").alias("of")).agg(F.min(order).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    others = classes.join(first, F.col("class") == F.col("of")).filter(~stays).select("doc_id", "key").distinct()
    gone = materialize(others.toDF(*fresh(docs, "_of", "_key")), "gone")
    return distinct_rows(matching(docs, gone, "left_anti", id_col, text_col), id_col, text_col)
