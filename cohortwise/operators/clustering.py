"""Lloyd's clustering from several seeded starts at once: one job per iteration moves the centres of all of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.operators.blocks import distinct_rows, hashed_blocks, unpacked

MOST_VALUES = 4_000_000


@dataclass
class Clustered:
    """``centers[start, cluster]``, the weighted sum of squared distances per start, and the iterations each took."""

    centers: np.ndarray
    costs: np.ndarray
    iterations: np.ndarray


def _draws(key: np.ndarray, seed: int, start: int, step: int) -> np.ndarray:
    """Uniform draws in (0, 1) from the rows' hashes, one mixing per (seed, start, step)."""
    with np.errstate(over="ignore"):
        salt = np.random.default_rng([seed, start, step]).integers(1, 2**63, 2).astype(np.uint64)
        x = (key.view(np.uint64) ^ salt[0]) * np.uint64(0x9E3779B97F4A7C15) + salt[1]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, in columns less the mean of the centres to keep their digits."""
    shift = centers.mean(axis=0)
    x, centers = x - shift, centers - shift
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers**2).sum(axis=1), 0.0)


def seeded_centers(blocks: DataFrame, k: int, starts: int, seed: int) -> np.ndarray:
    """First centres of all starts: each next one is a row drawn with odds of weight times squared distance to those before.

    The draw is a race of exponential times, so it is a minimum over all rows: one job per centre for all starts together, the
    same on any partitioning. Where no row is away from the centres so far, the race goes by weight alone.
    """
    chosen: list[list[np.ndarray]] = [[] for _ in range(starts)]
    for step in range(k):
        known = [np.array(c) for c in chosen]

        def race(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[int, tuple] = {}
            for batch in batches:
                for block in unpacked(batch):
                    for s in range(starts):
                        gap = _distances(block["x"], known[s]).min(axis=1) if step else np.ones(len(block["x"]))
                        time = -np.log(_draws(block["key"], seed, s, step)) / block["w"]
                        away = gap > 0
                        time = np.where(away, time / np.where(away, gap, 1.0), time)
                        first = np.lexsort((time, ~away))[0]
                        found = (int(not away[first]), float(time[first]), block["x"][first].tolist())
                        best[s] = min(best.get(s, found), found)
            if best:
                yield pd.DataFrame([(s, *found) for s, found in best.items()], columns=["s", "last", "time", "x"])

        made = blocks.mapInPandas(race, "s int, last int, time double, x array<double>")
        for row in made.groupBy("s").agg(F.min(F.struct("last", "time", "x")).alias("first")).collect():
            chosen[row["s"]].append(np.array(row["first"]["x"]))
    return np.array(chosen)


def _moved(blocks: DataFrame, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per start and cluster the weight and the summed rows, per start the cost, from one pass over the blocks."""
    starts, k, d = centers.shape
    names = [f"c{i}" for i in range(d + 2)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((starts * k, d + 2))
        for batch in batches:
            for block in unpacked(batch):
                x, w = block["x"], block["w"]
                gaps = _distances(x, centers.reshape(starts * k, d)).reshape(len(x), starts, k)
                nearest = gaps.argmin(axis=2)
                whole = np.column_stack([x * w[:, None], w])
                for s in range(starts):
                    member = (nearest[:, s, None] == np.arange(k)).astype(float)
                    total[s * k : (s + 1) * k, : d + 1] += member.T @ whole
                    total[s * k : (s + 1) * k, d + 1] += member.T @ (w * gaps[np.arange(len(x)), s, nearest[:, s]])
        yield pd.DataFrame({"line": np.arange(starts * k)} | {n: total[:, i] for i, n in enumerate(names)})

    made = blocks.mapInPandas(run, "line int, " + ", ".join(f"{n} double" for n in names))
    got = made.groupBy("line").agg(*[F.sum(n).alias(n) for n in names]).toPandas().sort_values("line")
    total = got[names].to_numpy().reshape(starts, k, d + 2)
    return total[:, :, d], total[:, :, :d], total[:, :, d + 1].sum(axis=1)


def lloyd(blocks: DataFrame, centers: np.ndarray, iterations: int = 300, tolerance: float = 0.0) -> Clustered:
    """Moves the centres of every start to the means of their rows, until their summed squared moves are ``tolerance`` or less.

    Starts that have settled leave the later passes. A centre without rows stays where it is; a row as near to several
    centres goes to the first.
    """
    centers, taken = centers.astype(float).copy(), np.zeros(len(centers), int)
    active = np.arange(len(centers))
    for _ in range(iterations):
        mass, sums, _ = _moved(blocks, centers[active])
        new = np.where(mass[:, :, None] > 0, sums / np.maximum(mass, 1e-300)[:, :, None], centers[active])
        moves = ((new - centers[active]) ** 2).sum(axis=(1, 2))
        centers[active] = new
        taken[active] += 1
        active = active[moves > tolerance]
        if not len(active):
            break
    return Clustered(centers, _moved(blocks, centers)[2], taken)


class CentersModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the number of the nearest centre, the smallest on ties; null where there are no features."""

    centers = Param(Params._dummy(), "centers", "centres, one after another", TypeConverters.toListFloat)
    k = Param(Params._dummy(), "k", "number of centres", TypeConverters.toInt)
    cost = Param(Params._dummy(), "cost", "summed squared distances of the rows fitted on", TypeConverters.toFloat)

    def clusterCenters(self) -> list[np.ndarray]:
        return list(np.array(self.getOrDefault(self.centers)).reshape(self.getOrDefault(self.k), -1))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        centers = np.array(self.clusterCenters())

        @F.pandas_udf("int")
        def nearest(vectors: pd.Series) -> pd.Series:
            found, there = pd.Series([None] * len(vectors), dtype="Int32"), vectors.notna().to_numpy()
            if there.any():
                found[there] = _distances(np.stack(vectors[there].to_numpy()), centers).argmin(axis=1)
            return found

        column = self.getFeaturesCol()
        vectors = F.col(column) if dataset.schema[column].dataType.typeName() == "array" else F.when(F.col(column).isNotNull(), vector_to_array(column))
        return dataset.withColumn(self.getPredictionCol(), nearest(vectors.cast("array<double>")))


def kmeans_starts(df: DataFrame, features: str, k: int = 2, starts: int = 10, iterations: int = 300, tolerance: float = 1e-4, seed: int = 42):
    """The clustering with the least cost of several seeded starts, the first of equals. Returns (model, all starts).

    Copies of a row count once with their number. A start has settled when its centres' summed squared move is at most
    ``tolerance`` times the mean variance of the columns. Fewer different rows than ``k`` give centres that coincide.
    """
    rows = distinct_rows(df, features)
    blocks = hashed_blocks(rows)
    mean_variance = _mean_variance(blocks)
    if mean_variance is None:
        raise ValueError("no row to cluster")
    first = seeded_centers(blocks, k, starts, seed)
    if first.size > MOST_VALUES:
        raise ValueError(f"the driver holds the centres of all starts: at most {MOST_VALUES} values")
    found = lloyd(blocks, first, iterations, tolerance * mean_variance)
    best = int(np.argmax(found.costs <= found.costs.min() * (1 + 1e-9)))  # equal but for the rounding of sums
    model = CentersModel()
    model._set(featuresCol=features, predictionCol="prediction", centers=found.centers[best].ravel().tolist(), k=k, cost=float(found.costs[best]))
    return model, found


def _mean_variance(blocks: DataFrame) -> float | None:
    """Mean over the columns of their population variance; merged from each block's own mean and squares."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in unpacked(batch):
                w = block["w"]
                mean = (w[:, None] * block["x"]).sum(axis=0) / w.sum()
                yield pd.DataFrame({"at": np.arange(len(mean)), "n": w.sum(), "m": mean, "q": (w[:, None] * (block["x"] - mean) ** 2).sum(axis=0)})

    parts = blocks.mapInPandas(run, "at int, n double, m double, q double")
    merged = parts.groupBy("at").agg(((F.sum("q") + F.sum(F.col("n"))
        * F.greatest(F.lit(0.0), F.sum(F.col("n") * F.col("m") * F.col("m")) / F.sum("n") - F.pow(F.sum(F.col("n") * F.col("m")) / F.sum("n"), 2))) / F.sum("n")).alias("v"))
    return merged.agg(F.avg("v")).first()[0]
