"""Vector code compression: a product quantizer whose nearest entries are found with LAESA pivots.

Every part of a vector is measured once against a few fixed pivots of its position. In each round the entries are measured
against the same pivots; by the triangle inequality the largest difference of two pivot distances bounds the distance of part and
entry from below. Entries are tried in the order of that bound with exact integer distances, until the bound passes the best
distance found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.rows import bounded_broadcast, fresh
from cohortwise.llm.vectors import integer_vectors, map_batches, matrix
from cohortwise.session import materialize

SCALE = 256  # fixed value: entries become floor(SCALE * c)
PARTS, ENTRIES, ROUNDS, PIVOTS = 16, 64, 2, 5
_BATCH = 16_384


@dataclass
class Codebooks:
    """``entries[part, entry]`` and ``pivots[part, pivot]`` are vectors of whole numbers."""

    entries: np.ndarray
    pivots: np.ndarray

    def roots(self) -> np.ndarray:
        """The distances of all entries from the pivots of their part."""
        return np.sqrt(((self.entries[:, :, None, :] - self.pivots[:, None, :, :]) ** 2).sum(axis=3).astype(float))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def fixed_pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """Per part the first entry and then, again and again, the entry farthest from the pivots so far."""
    out = []
    for book in entries:
        chosen = [0]
        gap = ((book - book[0]) ** 2).sum(axis=1)
        while len(chosen) < min(count, len(book)):
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, ((book - book[chosen[-1]]) ** 2).sum(axis=1))
        out.append(book[chosen])
    return np.array(out)


def nearest_entries(parts: np.ndarray, squares: np.ndarray, book: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each part, its squared distance, and how many exact distances it took.

    ``squares`` holds the squared distances of the parts from the pivots, ``roots`` the distances of the entries from them. Ties go to
    the lower index: an entry whose bound equals the best distance is still tried. The bound is lowered by more than its rounding error.
    """
    own, bound = np.sqrt(squares.astype(float)), np.zeros((len(parts), len(book)))
    for p in range(own.shape[1]):
        np.maximum(bound, np.abs(own[:, p, None] - roots[None, :, p]), out=bound)
    bound = bound * bound * (1 - 1e-9) - 1e-6
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    best, which = np.full(len(parts), np.iinfo(np.int64).max), np.zeros(len(parts), np.int64)
    open_, tried = np.arange(len(parts)), np.zeros(len(parts), np.int64)
    for turn in range(len(book)):
        open_ = open_[bound[open_, turn] <= best[open_]]
        if not len(open_):
            break
        tried[open_] += 1
        entry = order[open_, turn]
        d = ((parts[open_] - book[entry]) ** 2).sum(axis=1)
        closer = (d < best[open_]) | (d == best[open_]) & (entry < which[open_])
        best[open_[closer]], which[open_[closer]] = d[closer], entry[closer]
    return which, best, tried


def _assigned(batch: pa.RecordBatch, width: int, books: Codebooks, roots: np.ndarray) -> Iterator[tuple]:
    """(slice of the batch, vectors, codes, squared distances, evaluations per vector) of slices of a batch."""
    parts, pivots, _ = books.pivots.shape
    for at in range(0, batch.num_rows, _BATCH):
        piece = batch.slice(at, _BATCH)
        x = matrix(piece.column("x"), width).reshape(piece.num_rows, parts, -1)
        squares = matrix(piece.column("squares"), parts * pivots).reshape(piece.num_rows, parts, pivots)
        found = [nearest_entries(x[:, j], squares[:, j], books.entries[j], roots[j]) for j in range(parts)]
        yield piece, x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1), sum(f[2] for f in found)


def _with_pivot_distances(rows: DataFrame, width: int, pivots: np.ndarray) -> DataFrame:
    """``rows`` with ``squares``: every part's squared distances from its pivots; written, as all rounds read them."""

    names = rows.columns

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                piece = batch.slice(at, _BATCH)
                x = matrix(piece.column("x"), width).reshape(piece.num_rows, len(pivots), 1, -1)
                squares = ((x - pivots[None]) ** 2).sum(axis=3).reshape(piece.num_rows, -1)
                offsets = pa.array(np.arange(0, squares.size + 1, squares.shape[1]), pa.int32())
                yield {n: piece.column(n) for n in names} | {"squares": pa.ListArray.from_arrays(offsets, pa.array(squares.ravel()))}

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return materialize(map_batches(rows, kernel, f"{ddl}, squares array<bigint>"), "pivots")


def _means(rows: DataFrame, width: int, books: Codebooks) -> np.ndarray:
    """The entries after one round: the floored means of the parts nearest to each; unused entries stay.

    Sums are made in the tasks, so a task sends a row per part and entry at most; they are whole numbers.
    """
    parts, entries, each = books.entries.shape
    roots, names = books.roots(), [f"s{i}" for i in range(each)]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, each), np.int64)
        for batch in batches:
            for _, x, codes, _, _ in _assigned(batch, width, books, roots):
                cell = (codes + np.arange(parts) * entries).ravel()
                counts += np.bincount(cell, minlength=len(counts))
                np.add.at(sums, cell, x.reshape(-1, each))
        used = np.flatnonzero(counts)
        yield {"cell": used, "n": counts[used]} | {n: sums[used, i] for i, n in enumerate(names)}

    made = map_batches(rows, kernel, "cell int, n bigint, " + ", ".join(f"{n} bigint" for n in names))
    out = books.entries.reshape(-1, each).copy()
    for row in made.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in names]).collect():
        out[row["cell"]] = [row[n] // row["n"] for n in names]
    return out.reshape(books.entries.shape)


def compress_vectors(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS,
) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, codes, error, evaluations) of every whole vector, written, and the codebooks of whole numbers.

    ``codes`` has the zero-based entry of each part, ``error`` the squared distance summed over the parts, ``evaluations`` the number of
    exact distances the last assignment took, of ``parts * entries`` there are. The codebooks start as the parts of the
    ``entries`` smallest ids (nulls last, equal ids by vector), of all where there are fewer. An entry that is used becomes the floored mean of its parts.

    Null vectors, empty ones, and those with a null or non-finite entry are left out. Of vectors of several
    lengths the most frequent length stays; one that cannot be cut into equal parts is an error. Null and repeated ids keep their rows, null labels
    stay null. Other columns are not read. No rows in, no rows out, and no codebooks. The driver holds the codebooks only.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte: 1 to 256 entries")
    rows, width = integer_vectors(df, vec_col, SCALE, 0, F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"))
    kinds = [rows.schema[n].dataType.simpleString() for n in ("vec_id", "label")]
    ddl = f"vec_id {kinds[0]}, label {kinds[1]}, codes array<int>, error bigint, evaluations bigint"
    if not width:
        return df.sparkSession.createDataFrame([], ddl), None
    if width % parts:
        raise ValueError(f"{width} entries cannot be cut into {parts} equal parts")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    books = Codebooks(start, fixed_pivots(start, pivots))
    measured = _with_pivot_distances(rows, width, books.pivots)
    for _ in range(rounds):
        books = Codebooks(_means(measured, width, books), books.pivots)
    final, roots = books, books.roots()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for piece, _, codes, squares, tried in _assigned(batch, width, final, roots):
                offsets = pa.array(np.arange(0, codes.size + 1, parts), pa.int32())
                yield {
                    "vec_id": piece.column("vec_id"), "label": piece.column("label"), "error": squares.sum(axis=1),
                    "codes": pa.ListArray.from_arrays(offsets, pa.array(codes.ravel(), pa.int32())),
                    "evaluations": tried,
                }

    return materialize(map_batches(measured, kernel, ddl), "codes"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the error summed over its label, nulls being one label. Sums are made before the shuffle."""
    of, total = fresh(coded, "_of", "label_error")
    sums = materialize(coded.groupBy(F.col("label").alias(of)).agg(F.sum("error").alias(total)), "labels")
    return coded.join(bounded_broadcast(sums), F.col("label").eqNullSafe(F.col(of))).drop(of)
