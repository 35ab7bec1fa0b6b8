"""Embedding whitening and vector codes against dense NumPy versions."""

import hashlib

import numpy as np
import pytest

from cohortwise.llm import vector_codes as C
from cohortwise.llm import whitening as W

NAN, INF = float("nan"), float("inf")
BAD = [None, [], [None, 1.0, 2.0, 3.0], [NAN, 1.0, 2.0, 3.0], [INF, 1.0, 2.0, 3.0]]


def embeddings(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int")


def given(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    return rows, sorted((r["vec_id"], r["embedding"], r["label"]) for r in rows.collect())


def test_whitening_against_full_decomposition(spark, folder):
    df, rows = given(spark, folder)
    x = np.floor(1024 * np.array([v for _, v, _ in rows], float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1][:, :8]
    made, basis = W.whiten_embeddings(df)
    got = made.toPandas().sort_values(["vec_id", "component"])
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 8 * n and set(got["n"]) == {n} and basis.residual <= W.CERTIFIED
    assert np.allclose(basis.values, values[:8], rtol=1e-12)
    sign = np.sign((basis.vectors * vectors).sum(axis=0))
    assert np.abs(basis.vectors * sign - vectors).max() < 1e-10
    plain = centred @ (vectors * sign) / np.sqrt(values[:8])
    assert np.abs(got["whitened"].to_numpy().reshape(n, 8) - plain).max() < 1e-9
    deviation = [sum((n * int(e) - int(s)) ** 2 for e, s in zip(row, sums)) for row in x]
    assert got["deviation"].to_numpy().reshape(n, 8).tolist() == [[d] * 8 for d in deviation]
    assert np.allclose(got["explained"].to_numpy()[:8], values[:8] / values.sum(), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def test_filter_amplifies_only_the_wanted_end():
    spectrum = np.r_[9.0, 8.0, np.linspace(0, 5, 30)]
    out = W._filtered(lambda block: spectrum[:, None] * block, np.ones((32, 1)), 0.0, 5.0, 9.0, 10)[:, 0]
    assert abs(out[0]) > 1e3 * np.abs(out[2:]).max() and abs(out[1]) > 1e2 * np.abs(out[2:]).max()


def test_whitening_of_odd_rows(spark):
    draw = np.random.default_rng(3)
    rows = [(i, v, 1) for i, v in enumerate(BAD)] + [(None, [0.5, 0.25, 0.125, 1.0], None)]
    rows += [(7, draw.normal(size=4).tolist(), 2) for _ in range(30)] + [(8, [1.0, 2.0], 3)]
    made, basis = W.whiten_embeddings(embeddings(spark, rows, "double").selectExpr("*", "1 AS x", "2 AS component"))
    got = made.collect()
    assert basis.n == 31 and len(got) == 31 * 4 and sum(r["vec_id"] is None for r in got) == 4
    equal = [(i, [1.0, 2.0, 3.0], 0) for i in range(5)]
    line = [(i, [float(i), 2.0 * i, 0.0], 0) for i in range(9)]
    assert W.whiten_embeddings(embeddings(spark, equal))[0].count() == 0  # no variance, no component
    assert W.whiten_embeddings(embeddings(spark, line))[0].count() == 9
    for none in ([], [(1, None, 1)]):
        empty, basis = W.whiten_embeddings(embeddings(spark, none))
        assert basis is None and empty.columns == made.columns and empty.count() == 0


def plain_codes(vectors, parts, entries, rounds):
    cut = np.floor(256 * np.array(vectors, float)).astype(np.int64).reshape(len(vectors), parts, -1)
    books = cut[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        gaps = ((cut[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        codes = gaps.argmin(axis=2)
        if turn < rounds:
            for p in range(parts):
                for k in set(codes[:, p].tolist()):
                    books[p, k] = cut[codes[:, p] == k, p].sum(axis=0) // (codes[:, p] == k).sum()
    return codes, gaps.min(axis=2).sum(axis=1), books


def test_codes_against_all_distances(spark, folder):
    df, rows = given(spark, folder)
    codes, errors, books = plain_codes([v for _, v, _ in rows], 16, 64, 2)
    coded, made = C.compress_vectors(df)
    got = coded.orderBy("vec_id").collect()
    assert [r["codes"] for r in got] == codes.tolist() and [r["error"] for r in got] == errors.tolist()
    assert made.sha256() == hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()
    assert np.mean([r["evaluations"] for r in got]) < 0.1 * 16 * 64  # the bounds prune
    sums = {r["label"]: r["label_error"] for r in C.with_label_errors(coded).collect()}
    assert sums == {x: sum(e for (_, _, y), e in zip(rows, errors.tolist()) if x == y) for x in sums}


def test_bound_order_keeps_ties_at_the_lower_index():
    draw = np.random.default_rng(1)
    parts, book = draw.integers(-3, 4, (500, 2)), draw.integers(-3, 4, (40, 2))
    pivots = C.fixed_pivots(book[None], 4)[0]
    squares, roots = ((parts[:, None] - pivots) ** 2).sum(axis=2), np.sqrt(((book[:, None] - pivots) ** 2).sum(axis=2).astype(float))
    which, best, tried = C.nearest_entries(parts, squares, book, roots)
    gaps = ((parts[:, None] - book) ** 2).sum(axis=2)
    assert (which == gaps.argmin(axis=1)).all() and (best == gaps.min(axis=1)).all() and tried.max() <= 40


def test_codes_of_odd_rows(spark):
    rows = [(i, v, 1) for i, v in enumerate(BAD)] + [(9, [1.0, 2.0, 3.0, 4.0], None), (9, [1.0, 2.0, 3.0, 4.0], None), (None, [0.0, 0.0, -0.001, 9.0], 5)]
    coded, books = C.compress_vectors(embeddings(spark, rows, "double").selectExpr("*", "1 AS codes", "2 AS _of"), parts=2)
    got = sorted(((r["vec_id"], r["label"], r["codes"], r["error"], r["label_error"]) for r in C.with_label_errors(coded).collect()), key=str)
    assert got == [(9, None, [0, 0], 0, 0), (9, None, [0, 0], 0, 0), (None, 5, [2, 2], 0, 0)]
    assert books.entries.shape == (2, 3, 2) and books.entries[1, 2].tolist() == [-1, 2304]
    with pytest.raises(ValueError):
        C.compress_vectors(embeddings(spark, rows, "double"), parts=3)
    empty, none = C.compress_vectors(embeddings(spark, []))
    assert none is None and C.with_label_errors(empty).count() == 0
