"""Repeated windows of words against brute force over all windows."""

import random
from collections import Counter

import numpy as np
import pytest

from cohortwise.llm import substrings as S


def words_of(text):
    return (text or "").encode().split()


def plain(texts, window):
    """The words of every text that no repeated window covers."""
    parted = [words_of(t) for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in parted for i in range(len(w) - window + 1))
    kept = []
    for words in parted:
        gone = set()
        for i in range(len(words) - window + 1):
            if counts[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept.append([w for i, w in enumerate(words) if i not in gone])
    return kept


def kept_words(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r for r in sorted(S.dedup_substrings(rows, **options).collect(), key=lambda r: r["doc_id"])]


def made_up(seed, count):
    """Texts with shared passages, edited copies, overlapping repeats, runs of one word."""
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefghij") * draw.randint(1, 6) + str(draw.randint(0, 99))
    passages = [[word() for _ in range(draw.randint(10, 120))] for _ in range(6)]
    texts = []
    for _ in range(count):
        words = [word() for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            part = list(draw.choice(passages))
            if draw.random() < 0.5:
                part[draw.randrange(len(part))] = word()
            cut = draw.randint(0, len(part) // 2)
            words[draw.randint(0, len(words)) :][:0] = part
            words += part[cut:] + [word()]
        if draw.random() < 0.1:
            words += ["same"] * draw.randint(20, 90)
        texts.append(draw.choice([" ", "\n", " \t"]).join(words))
    return texts + texts[:2]


@pytest.mark.parametrize("window, base", [(35, 9), (35, 5), (35, 34), (12, 2), (6, 1)])
def test_against_all_windows(spark, window, base):
    texts = made_up(window * base, 80)
    got = kept_words(spark, texts, window=window, base=base)
    want = plain(texts, window)
    assert [words_of(r["text"]) for r in got] == want
    assert [r["n_removed"] for r in got] == [len(words_of(t)) - len(k) for t, k in zip(texts, want)]
    assert sum(r["n_removed"] for r in got) > 100


def test_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"]: r for r in S.dedup_substrings(docs).collect()}
    for (doc, text), want in zip(given, plain([t for _, t in given], S.WINDOW)):
        assert words_of(got[doc]["text"]) == want and (got[doc]["n_removed"] or got[doc]["text"] == text)


def test_hashes_depend_on_words_alone():
    text = "one two  three\nfour \t five é " + "x" * 3_000_000 + " six one two"
    hashes = S.word_hashes(text)
    assert len(hashes) == 10 and (hashes[:2] == hashes[-2:]).all() and len(set(hashes.tolist())) == 8
    assert (S.word_hashes("one two") == hashes[:2]).all() and not len(S.word_hashes(None)) and not len(S.word_hashes(" \n"))
    long = " ".join(f"w{i % 977}" for i in range(400_000))
    assert (S.word_hashes(long)[:977] == S.word_hashes(long[: long.index("w0", 5)])).all()


def test_every_window_holds_an_anchor_by_its_words_alone():
    draw = np.random.default_rng(2)
    words = draw.integers(0, 1 << 62, 3_000, np.uint64)
    words[1_000:1_200] = words[2_000:2_200]
    at, _ = S.anchors(words, 35, 9)
    inside = lambda i: set((at[(at >= i) & (at <= i + 26)] - i).tolist())
    assert all(inside(i) for i in range(3_000 - 34)) and len(at) < 0.12 * 3_000
    assert all(inside(1_000 + i) & inside(2_000 + i) for i in range(165))


def test_odd_rows(spark):
    once, twice = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(40))
    rows = [(None, once, 1), (1, None, 2), (2, "", 3), (3, twice, 4), (3, twice, 4), (4, "short " + "y" * 100_000, 5), (5, f"{once}  x\ny", 6), (None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int").selectExpr("*", "1 AS _words", "2 AS _key", "3 AS kept", "4 AS hash")
    got = S.dedup_substrings(docs)
    assert got.columns == ["doc_id", "text", "_words", "_key", "kept", "hash", "n_words", "n_removed"]
    found = sorted(((r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in got.collect()), key=str)
    assert found == sorted([(None, "", 50, 50), (1, None, 0, 0), (2, "", 0, 0), (3, "", 40, 40), (3, "", 40, 40),
                            (4, rows[5][1], 2, 0), (5, "x y", 52, 50), (None, None, 0, 0)], key=str)
    assert S.dedup_substrings(docs.limit(0)).count() == 0
    assert S.dedup_substrings(docs.filter("doc_id = 2")).collect()[0]["n_removed"] == 0
