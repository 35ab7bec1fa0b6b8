"""Fingerprints, pairs and components against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cohortwise.llm import simhash
from cohortwise.llm.components import components
from cohortwise.llm.queries import QUERIES


def plain_fingerprint(text, width=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    ones = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(parts))


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_query_against_all_pairs(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op6_simhash_near_dedup"](spark, folder).collect()}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    ids = sorted(docs)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert {i: r["component_id"] for i, r in got.items()} == classes(near, ids)


def test_spark_hash_is_the_shingle_hash(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def clustered(n, seed=4):
    draw = random.Random(seed)
    found = set()
    while len(found) < n:
        x = draw.getrandbits(64)
        for _ in range(draw.choice([1, 1, 3, 30])):
            found.add(x)
            x ^= 1 << draw.randrange(64)
            if draw.random() < 0.5:
                x ^= 1 << draw.randrange(12)
    return [x - (1 << 64) if x >> 63 else x for x in sorted(found)]


def test_pairs_with_and_without_room(spark):
    xs = clustered(600) + [0, 1, -1, -2, 1 << 62, -(1 << 63)]
    a = np.array(sorted(set(xs)), np.int64)
    want = {
        (int(min(a[i], y)), int(max(a[i], y)))
        for i in range(len(a)) for y in a[:i][np.bitwise_count((a[:i] ^ a[i]).view(np.uint64)) <= 2]
    }
    prints = spark.createDataFrame([(int(x),) for x in a], "x bigint").repartition(5)
    for room in (512, 3):
        for block in (8, 4):
            pairs = simhash.near_pairs(prints, block=block, room=room).collect()
            assert {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in pairs} == want
    one = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in simhash.near_pairs(prints, apart=1).collect()}
    assert one == {(p, q) for p, q in want if ((p ^ q) % (1 << 64)).bit_count() == 1}


def test_components_of_random_links(spark):
    draw = random.Random(1)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(1000, i) for i in range(1001, 1100)]
    links += [(i, i + 1) for i in range(2000, 2100)] + [(5, 5), (None, 3), (4, None)]
    got = components(spark.createDataFrame(links, "a bigint, b bigint").repartition(7), "test").collect()
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    want = classes(real, {x for p in real for x in p})
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "test").count() == 0


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (None, "a b c d", "x"), (7, "A b  c\nD", "x"), (7, "A b  c\nD", "x"), (8, "one", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    assert by[1] == by[2] == by[3] == [("0" * 16, 1)]
    assert by[None][0][1] == 7 and by[7][0] == by[7][1] == by[None][0]
    assert by[8] == [(f"{plain_fingerprint('one'):016x}", 8)]
    kept = sorted(r["doc_id"] for r in simhash.one_per_class(docs).collect())
    assert kept == [1, 7, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.one_per_class(docs.limit(0)).columns == docs.columns
