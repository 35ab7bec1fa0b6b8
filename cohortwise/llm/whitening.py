"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance is never formed. One pass over the centred rows gives its product with a thin block, each task sending one
thin partial sum. A Chebyshev polynomial of the covariance, by its three-term recurrence, damps the unwanted end of the
spectrum in the block; QR and a Rayleigh-Ritz step follow. Rounds go on until the residuals certify the wanted pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.vectors import integer_vectors, map_batches, matrix

# Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
DEGREE = 10  # of the polynomial: so many passes, and one for the Rayleigh-Ritz step, make a round
CERTIFIED = 2e-14  # residual of a pair over the largest eigenvalue
_LARGEST = 9.0e18  # sums of squares below this fit in a long


@dataclass
class Basis:
    """The leading eigenpairs of the covariance of ``n`` integer vectors with the entry sums ``sums``."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int

    def spread(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, in whole numbers."""
        return self.n * x - self.sums

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.spread(x) / self.n) @ self.vectors / np.sqrt(self.values)


def _summed(rows: DataFrame, width: int, kernel, columns: int) -> np.ndarray:
    """The sum over all tasks of the matrix that ``kernel`` makes of each task's batches: one row per line of it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = None
        for batch in batches:
            made = kernel(matrix(batch.column("x"), width))
            total = made if total is None else total + made
        if total is not None:
            yield {"line": np.arange(len(total))} | {f"c{i}": total[:, i] for i in range(columns)}

    names = [f"c{i}" for i in range(columns)]
    made = map_batches(rows.select("x"), run, "line int, " + ", ".join(f"{n} double" for n in names))
    got = made.groupBy("line").agg(*[F.sum(n).alias(n) for n in names]).toPandas().sort_values("line")
    return got[names].to_numpy()


def _entry_sums(rows: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """The number of vectors and the exact sum of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n, total = 0, np.zeros(width, np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), width)
            n, total = n + len(x), total + x.sum(axis=0)
        yield {"at": np.arange(width), "n": [n] * width, "s": total}

    made = map_batches(rows.select("x"), run, "at int, n bigint, s bigint").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    got = sorted((r["at"], r["n"], r["s"]) for r in made.collect())
    return got[0][1], np.array([s for _, _, s in got], np.int64)


def _spectrum_floor(product, width: int, start: np.ndarray, steps: int) -> float:
    """A lower bound of the spectrum by a few Lanczos steps: the smallest Ritz value less its residual, 0 at least."""
    basis, before, beta = [start / np.linalg.norm(start)], np.zeros(width), 0.0
    alphas, betas = [], []
    for _ in range(min(steps, width)):
        v = product(basis[-1][:, None])[:, 0] - beta * before
        alphas.append(float(basis[-1] @ v))
        v = v - alphas[-1] * basis[-1]
        for q in (*basis, *basis):  # twice is enough
            v = v - (q @ v) * q
        beta = float(np.linalg.norm(v))
        betas.append(beta)
        if beta <= 1e-12 * max(abs(alphas[0]), 1e-300):
            break
        before = basis[-1]
        basis.append(v / beta)
    small, vectors = np.linalg.eigh(np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1))
    return max(0.0, float(small[0] - betas[-1] * abs(vectors[-1, 0])))


def _filtered(product, block: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The block under the Chebyshev polynomial that is small on [low, high], scaled to stay near one at ``top``."""
    half, middle = (high - low) / 2, (high + low) / 2
    sigma = half / (top - middle)
    twice = 2 / sigma
    now, before = (product(block) - middle * block) * (sigma / half), block
    for _ in range(1, degree):
        after = 1 / (twice - sigma)
        now, before = (product(now) - middle * now) * (2 * after / half) - sigma * after * before, now
        sigma = after
    return now


def fit_basis(
    rows: DataFrame, width: int, components: int = 8, guard: int = 16, degree: int = DEGREE, certified: float = CERTIFIED,
    rounds: int = 200, seed: int = 5,
) -> Basis | None:
    """The leading ``components`` eigenpairs over rows (x: array of ``width`` longs); None without rows.

    The block has ``guard`` columns more than are wanted, so only the part of the spectrum behind them must be damped. A pair is
    certified if its residual ``|Vq - eq|`` is at most ``certified`` times the largest eigenvalue; if ``rounds`` do not
    get there, that is an error. Pairs whose eigenvalue is zero beside the trace are left out: vectors that are all equal, or fewer
    than wanted, have fewer components. Only thin matrices of ``width`` lines reach the driver.
    """
    if not width:
        return None
    n, sums = _entry_sums(rows, width)
    centred = lambda x: (n * x - sums) / n
    passes = 0

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def kernel(x):
            c = centred(x)
            return c.T @ (c @ block)

        return _summed(rows, width, kernel, block.shape[1]) / n

    trace = float(_summed(rows, width, lambda x: (centred(x) ** 2).sum(axis=0)[:, None], 1).sum()) / n
    rng = np.random.default_rng(seed)
    wanted, size = min(components, width), min(components + guard, width)
    nothing = max(trace, 1e-300) * 1e-13
    if trace == 0:
        return Basis(n, sums, np.empty(0), np.empty((width, 0)), 0.0, 0.0, passes)
    floor = _spectrum_floor(product, width, rng.normal(size=width), 10) if size < width else 0.0
    block, _ = np.linalg.qr(rng.normal(size=(width, size)))
    for turn in range(rounds):
        if turn:
            block = _filtered(product, block, min(floor, values[-1] / 2), values[-1], values[0], degree)
            block, _ = np.linalg.qr(block)
        image = product(block)
        small = block.T @ image
        values, turned = np.linalg.eigh((small + small.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        block, image = block @ turned, image @ turned
        residual = np.linalg.norm(image - block * values, axis=0)[:wanted].max() / max(values[0], 1e-300)
        if residual <= certified or values[-1] <= nothing and residual <= 1e-12:
            break
    else:
        raise ArithmeticError(f"eigenpairs not certified: residual {residual:.1e} after {passes} passes")
    real = values[:wanted] > nothing
    return Basis(n, sums, values[:wanted][real], block[:, :wanted][:, real], trace, float(residual), passes)


def identity_error(rows: DataFrame, width: int, basis: Basis) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity; the rows' mean is taken off first."""
    k = len(basis.values)
    mean = _summed(rows, width, lambda x: basis.whiten(x).sum(axis=0)[None, :], k)[0] / basis.n

    def kernel(x):
        w = basis.whiten(x) - mean
        return w.T @ w

    return float(np.abs(_summed(rows, width, kernel, k) / basis.n - np.eye(k)).max())


def whitened(rows: DataFrame, width: int, basis: Basis) -> DataFrame:
    """(vec_id, component, deviation, whitened) of rows (vec_id, x), a row per component, numbered from 1.

    ``deviation`` is the exact sum of ``(n * x - S)^2``, null if that is beyond a long.
    """
    k = len(basis.values)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8_192):
                part = batch.slice(at, 8_192)
                x = matrix(part.column("x"), width)
                spread = basis.spread(x)
                fits = (spread.astype(float) ** 2).sum(axis=1) < _LARGEST
                squares = (np.where(fits[:, None], spread, 0) ** 2).sum(axis=1)
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield {
                    "vec_id": part.column("vec_id").take(each), "component": np.tile(np.arange(1, k + 1), len(x)),
                    "deviation": pa.array(squares, mask=~fits).take(each), "whitened": basis.whiten(x).ravel(),
                }

    kind = rows.schema["vec_id"].dataType.simpleString()
    return map_batches(rows.select("vec_id", "x"), kernel, f"vec_id {kind}, component int, deviation bigint, whitened double")


def whiten_embeddings(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8, guard: int = 16,
) -> tuple[DataFrame, Basis | None]:
    """The whitened rows ``vec_id, component, n, deviation, whitened, explained, identity_error``, and the fitted basis.

    Null vectors, empty ones, and those with a null or non-finite entry are left out; all others make the fit. Of vectors of several
    lengths the most frequent length stays. Null and repeated ids keep their rows. Components with no variance are
    not there, so equal vectors give no rows, as do no rows. Other columns are not read. ``explained`` is the
    eigenvalue's share of the trace, ``identity_error`` one value measured over the whitened rows.
    """
    rows, width = integer_vectors(df, vec_col, SCALE, SHIFT, F.col(id_col).alias("vec_id"))
    basis = fit_basis(rows, width, components, guard)
    if basis is None or not len(basis.values):
        kind = rows.schema["vec_id"].dataType.simpleString()
        ddl = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], ddl), basis
    error = identity_error(rows, width, basis)
    share = F.get(F.array(*[F.lit(float(v) / basis.trace) for v in basis.values]), F.col("component") - 1)
    made = whitened(rows, width, basis).select(
        "vec_id", "component", F.lit(basis.n).cast("bigint").alias("n"), "deviation", "whitened", share.alias("explained"),
        F.lit(error if math.isfinite(error) else None).cast("double").alias("identity_error"),
    )
    return made, basis
