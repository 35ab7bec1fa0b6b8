"""Fuzzy line deduplication against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.llm import line_dedup as L


def sliced(line):
    return {line[i : i + L.SHINGLE] for i in range(max(1, len(line) - L.SHINGLE + 1))}


def plain(docs, similarity=0.8):
    """{(id, text): kept lines}, by comparing all distinct lines."""
    occurrences = []
    for i, t in docs:
        for line in (t or "").split("\n"):
            if line.strip(L._BLANK):
                occurrences.append(((i, t), line))
    names = {}
    for _, line in occurrences:
        names.setdefault(line.strip(L._BLANK), len(names))
    sets = [sliced(x) for x in names]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in index[x]:
                shared[j] += 1
            index[x].append(i)
        for j, k in shared.items():
            if k / (len(s) + len(sets[j]) - k) >= similarity:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    seen, kept = set(), defaultdict(list)
    for doc, line in occurrences:
        r = root(names[line.strip(L._BLANK)])
        if r not in seen:
            seen.add(r)
            kept[doc].append(line)
    return kept


def test_against_all_pairs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = plain(given)
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(docs).collect()}
    assert got == {i: "\n".join(want[i, t]) for i, t in given}


def noisy(count, seed):
    """Lines in groups of near copies: words replaced in some, so that similarities lie on both sides of the bar."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 9)))
    out = []
    while len(out) < count:
        base = [word() for _ in range(draw.randint(8, 60))]
        for _ in range(draw.choice([1, 2, 6, 40])):
            line = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 4])):
                line[draw.randrange(len(line))] = word()
            out.append(" ".join(line))
    return out[:count]


def test_recall_on_near_copies(spark):
    lines = noisy(1_500, 3)
    docs = [(i, line) for i, line in enumerate(lines)]
    want = plain(docs)
    given = spark.createDataFrame(docs, "doc_id bigint, text string")
    bounds = [{}, {"room": 3, "tile": 2}, {"room": 8, "tile": 100}]
    kept = [sorted(r["doc_id"] for r in L.dedup_lines(given, **b).filter("n_kept > 0").collect()) for b in bounds]
    assert kept[0] == kept[1] == kept[2]  # however much of a bucket a task may hold
    assert abs(len(kept[0]) - len(want)) <= 0.01 * len(want)  # a missed pair leaves one line more


def test_signatures_estimate_similarity():
    lines = noisy(300, 5)
    signs, counts = L.signatures(lines)
    assert counts.tolist() == [len(sliced(x)) for x in lines]
    draw = np.random.default_rng(1)
    off = []
    for _ in range(400):
        i, j = draw.integers(0, len(lines), 2)
        both = len(sliced(lines[i]) & sliced(lines[j]))
        exact = both / len(sliced(lines[i]) | sliced(lines[j]))
        assert L.jaccard(L.shingles(lines[i]), L.shingles(lines[j])) == exact == L.similarities([lines[i], ""], [lines[j], "x"], 5)[0]
        off.append(abs((signs[i] == signs[j]).mean() - exact))
    assert np.mean(off) < 0.05
    assert (L.signatures(lines[:1])[0] == signs[:1]).all()  # not a matter of what stands beside it


def test_chain_inside_a_bucket(spark):
    """A is like B and B like C, but not A like C: one class."""
    base = [f"w{i:03d}x" for i in range(60)]
    b, c = list(base), list(base)
    b[5:11] = [f"q{i}" for i in range(6)]
    c[5:17] = [f"q{i}" for i in range(12)]
    rows = [(i, " ".join(x)) for i, x in enumerate((base, b, c))]
    sets = [L.shingles(t) for _, t in rows]
    if not (L.jaccard(sets[0], sets[1]) >= 0.8 <= L.jaccard(sets[1], sets[2]) and L.jaccard(sets[0], sets[2]) < 0.8):
        raise AssertionError("the fixture is off")
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r["n_kept"] for r in got) == [0, 0, 1]


def test_edge_rows(spark):
    rows = [(None, "b line\nshort", "u"), (1, None, "v"), (2, "", "w"), (3, " b line \n\n \nx\nx", "x"), (4, "only this\n", "y"),
            (4, "only this\n", "z"), (5, "z" * 50_000 + "\nb line", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_kept string")
    got = L.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "n_kept"]
    by = {(r["doc_id"], r["n_lines"]): r["text"] for r in got.collect()}
    assert got.count() == len(rows)
    assert by[None, 2] == "b line\nshort" and by[1, 0] is None and by[2, 0] == ""
    assert by[3, 3] == "x" and by[4, 1] == "only this" and by[5, 2] == "z" * 50_000
    assert L.dedup_lines(docs.limit(0)).count() == 0
    other = docs.select("doc_id", "text", F.lit(1).alias("_of"), F.lit(2).alias("_key"), F.lit(3).alias("_parts"))
    assert L.dedup_lines(other).columns == [*other.columns, "n_lines", "n_kept"]


def test_query_finds_one_edit_in_short_and_middling_lines(spark, tmp_path):
    from cohortwise.llm.queries import QUERIES

    draw = random.Random(11)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    rows = []
    for i in range(40):
        base = [word() for _ in range(9 if i % 2 else 15)]  # 62 and 104 characters
        line, changed = " ".join(base), list(base)
        changed[len(base) // 2] = word()
        rows += [(2 * i, line), (2 * i + 1, line[:30] + "#" + line[31:] if i % 2 else " ".join(changed))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    kept = {r["doc_id"] for r in QUERIES["op5_line_dedup"](spark, str(tmp_path)).filter("n_kept > 0").collect()}
    assert kept >= set(range(0, 80, 2)) and len(kept) <= 41  # at the bar a pair is missed in one case of 500


def test_sketches_pass_what_is_alike():
    """No pair at the bar or above fails the sketch, and most unlike pairs do."""
    lines = noisy(1_200, 9)
    sets, marks = [sliced(x) for x in lines], L.sketches(L.signatures(lines)[0])
    apart, alike, unlike = L.bits_apart(0.8), [], []
    for i in range(len(lines)):
        for j in range(max(0, i - 40), i):
            both = len(sets[i] & sets[j])
            (alike if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) else unlike).append(((int(marks[i]) ^ int(marks[j])) & (1 << 64) - 1).bit_count() <= apart)
    assert len(alike) > 200 and np.mean(alike) > 0.999 and np.mean(unlike) < 0.3


def test_many_lines_below_the_bar(spark):
    """Lines that share most of their words but are not similar: all are compared, in tiles, and all stay."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    base = [word() for _ in range(60)]
    lines = []
    for _ in range(400):
        line = list(base)
        for i in draw.sample(range(60), 5):
            line[i] = word()
        lines.append(" ".join(line))
    docs = list(enumerate([*lines, lines[7] + " x"]))
    want = plain(docs)
    given = spark.createDataFrame(docs, "doc_id bigint, text string")
    for tile in (64, 512):
        kept = {r["doc_id"] for r in L.dedup_lines(given, tile=tile).filter("n_kept > 0").collect()}
        assert len(kept ^ {i for i, _ in want}) <= 2 and 400 not in kept


def test_candidates_grow_with_the_lines(spark):
    """Five times the lines, unlike ones and near copies, give at most six times the pairs whose texts are compared."""
    draw = random.Random(6)
    vocabulary = ["".join(draw.choices("abcdefghijklmnopqrst", k=draw.randint(2, 8))) for _ in range(1_500)]
    counts = []
    for n in (2_000, 10_000):
        lines = [draw.choices(vocabulary, k=draw.randint(8, 40)) for _ in range(n)]
        for line in lines[: n // 10]:
            lines += [line[:-1] + [draw.choice(vocabulary)] for _ in range(2)]
        docs = spark.createDataFrame([(i, i, " ".join(x)) for i, x in enumerate(lines)], "doc_id bigint, key bigint, text string")
        signed = L.materialize(L._lines(docs, L.SHINGLE).withColumn("id", F.col("doc_id")), "signed")
        counts.append(L._mates(signed, 0.8, L.ROOM).filter("bucket is null").select("a", "b").distinct().count())
    assert 100 < counts[0] and counts[1] <= 6 * counts[0]


@pytest.mark.parametrize("n, cells", [(1, 1 << 20), (7, 1 << 20), (90, 1 << 20), (90, 500)])
def test_overlaps_count_shared_shingles(monkeypatch, n, cells):
    """Shingles that many lines hold and shingles that few hold, in one part and in several."""
    monkeypatch.setattr(L, "_CELLS", cells)
    draw = np.random.default_rng(n)
    words = ["".join(draw.choice(list("abcdef\u00e9\U0001f600"), 6)) for _ in range(60)]
    lines = [" ".join(["always the same", *draw.choice(words, 8)]) for _ in range(n - 1)] + ["x"]
    counts, shared = L.overlaps(lines, 5)
    sets = [L.shingles(x) for x in lines]
    assert counts.tolist() == [len(s) for s in sets]
    for i in range(n):
        for j in range(i + 1, n):
            assert shared[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_no_written_table_has_a_row_per_occurrence(spark, monkeypatch):
    written, write = [], L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, tag: written.append((tag, write(df, tag))) or written[-1][1])
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("one and the same line\nanother line of text").alias("text"))
    kept = {r["doc_id"]: r["text"] for r in L.dedup_lines(docs).collect()}
    assert kept[0] == "one and the same line\nanother line of text" and not any(kept[i] for i in range(1, 60))
    assert max(table.count() for _, table in written) == 2


def test_rows_of_lines_name_their_document_place_and_signature():
    texts = ["first line here\n\n  \nshort", None, "", "  first line here\nsecond line here "]
    batch = {"doc_id": ["a", None, "c", "d"], "key": [5, -(2**63), 7, 2**63 - 1], "text": texts}
    (rows,) = L._batch_lines(batch, L.SHINGLE)
    assert rows["doc_id"] == ["a", "a", "d", "d"] and [rows[c].tolist() for c in ("key", "at", "parts", "worded")] == [
        [5, 5, 2**63 - 1, 2**63 - 1], [0, 3, 0, 1], [4, 4, 2, 2], [2, 2, 2, 2]]
    signs, counts = L.signatures(["first line here", "short", "first line here", "second line here"])
    assert rows["bands"].to_pylist() == L.band_keys(signs).view(np.int32).tolist() and rows["n"].tolist() == counts.tolist()
    assert rows["hi"][0] == rows["hi"][2] != rows["hi"][3] and rows["sketch"].tolist() == L.sketches(signs).tolist()


def test_a_line_goes_into_a_bucket_as_three_numbers(spark):
    """The band and its key, the whole identifier and sketch, and the count, cut to its most, come back from them."""
    most = (1 << L._COUNT_BITS) - 1
    bands = [(-1) ** b * (2**31 - 1 - b) for b in range(L.BANDS)]
    known = [(7, 1, -(2**63), bands), (2**62 + 1, 2**31 - 1, 2**63 - 1, bands)]
    dealt = L._dealt(spark.createDataFrame(known, "id bigint, n int, sketch bigint, bands array<int>"))
    assert len(dealt.columns) == 3
    rows = L._unpacked({c: np.array([r[c] for r in dealt.orderBy("id", "slot").collect()]) for c in dealt.columns})
    buckets = sorted(band << 32 | key & 0xFFFFFFFF for band, key in enumerate(bands))
    assert rows["bucket"].tolist() == 2 * buckets and rows["n"].tolist() == [1] * L.BANDS + [most] * L.BANDS
    assert rows["id"].tolist() == [7] * L.BANDS + [2**62 + 1] * L.BANDS
    assert rows["sketch"].tolist() == [-(2**63)] * L.BANDS + [2**63 - 1] * L.BANDS
