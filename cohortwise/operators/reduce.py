"""Covariance, class scatter, and linear projections fitted from them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.functions.vectors import as_double
from cohortwise.session import materialize


def vector_sums(df: DataFrame, vec: str, group: str | None = None, center=None) -> DataFrame:
    """Sums of vectors per group and their products overall, as long cells (g, i, j, s, n).

    Cells with i = -1 hold the sum of position j in group g, the others (g = 0) the sum of the
    products of positions i <= j, both after subtracting ``center``. Each task folds its rows
    into one matrix and a vector per group, and only those are shuffled, however many rows. Null vectors take no part.
    """

    def fold(batches):
        sums: dict = {}
        whole, products = 0, 0.0
        for batch in batches:
            if not len(batch):
                continue
            keys = batch["g"].to_numpy()
            rows = np.stack(batch["v"].to_numpy())
            if center is not None:
                rows = rows - center
            whole, products = whole + len(rows), products + rows.T @ rows
            for key in np.unique(keys):
                part = rows[keys == key]
                n, s = sums.get(key, (0, 0.0))
                sums[key] = (n + len(part), s + part.sum(axis=0))
        for key, (n, s) in sums.items():
            yield pd.DataFrame({"g": key, "i": -1, "j": np.arange(len(s)), "s": s, "n": n})
        if whole:
            i, j = np.triu_indices(len(products))
            yield pd.DataFrame({"g": 0, "i": i, "j": j, "s": products[i, j], "n": whole})

    key = F.lit(0) if group is None else F.col(group)
    rows = df.filter(F.col(vec).isNotNull()).select(key.cast("bigint").alias("g"), as_double(vec).alias("v"))
    partial = rows.mapInPandas(fold, "g bigint, i int, j int, s double, n bigint")
    return partial.groupBy("g", "i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def vector_mean(df: DataFrame, vec: str) -> np.ndarray:
    """Mean vector; d numbers reach the driver."""

    def fold(batches):
        n, s = 0, 0.0
        for batch in batches:
            if len(batch):
                rows = np.stack(batch["v"].to_numpy())
                n, s = n + len(rows), s + rows.sum(axis=0)
        if n:
            yield pd.DataFrame({"j": np.arange(len(s)), "s": s, "n": n})

    sums = df.filter(F.col(vec).isNotNull()).select(as_double(vec).alias("v")).mapInPandas(fold, "j int, s double, n bigint")
    cells = sums.groupBy("j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("j").toPandas()
    return (cells["s"] / cells["n"]).to_numpy()


def _both_triangles(upper: DataFrame, values: list[str]) -> DataFrame:
    """(i, j) cells with i <= j completed to the full symmetric matrix."""
    cell = F.struct("i", "j", *values)
    mirror = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), *values)
    cells = F.when(F.col("i") == F.col("j"), F.array(cell)).otherwise(F.array(cell, mirror))
    return upper.select(F.explode(cells).alias("c")).select("c.*")


def covariance(df: DataFrame, vec: str) -> DataFrame:
    """Sample covariance of all vector positions as (i, j, cov)."""
    sums = vector_sums(df, vec, center=vector_mean(df, vec)).filter("i >= 0")
    return _both_triangles(sums.select("i", "j", (F.col("s") / (F.col("n") - 1)).alias("cov")), ["cov"])


def class_scatter(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Within-class and between-class scatter as (i, j, sw, sb).

    With vectors centred at the overall mean and class sums s_c, Sb = sum(s_c s_c' / n_c), and
    what is left of the total scatter is Sw. The class sums, one vector per class, are stacked and
    multiplied inside the tasks; no class needs a matrix of its own.
    """
    cells = materialize(vector_sums(df, vec, group=label, center=vector_mean(df, vec)), "scatter")
    by_place = F.array_sort(F.collect_list(F.struct("j", "s")))  # of one class, d long
    sums = cells.filter("i = -1").groupBy("g").agg(F.transform(by_place, lambda x: x["s"]).alias("s"), F.first("n").alias("n"))

    def products(batches):
        whole = 0.0
        for batch in batches:
            if len(batch):
                rows = np.stack(batch["s"].to_numpy())
                whole = whole + rows.T @ (rows / batch["n"].to_numpy()[:, None])
        if np.ndim(whole):
            i, j = np.triu_indices(len(whole))
            yield pd.DataFrame({"i": i, "j": j, "sb": whole[i, j]})

    between = sums.select("s", "n").mapInPandas(products, "i int, j int, sb double").groupBy("i", "j").agg(F.sum("sb").alias("sb"))
    total = cells.filter("i >= 0").select("i", "j", F.col("s").alias("st"))
    upper = total.join(between, ["i", "j"]).select("i", "j", (F.col("st") - F.col("sb")).alias("sw"), "sb")
    return _both_triangles(upper, ["sw", "sb"])


def _matrix(cells: DataFrame, value: str) -> np.ndarray:
    """A d x d matrix on the driver, d the vector length."""
    pdf = cells.select("i", "j", value).toPandas()
    out = np.zeros((pdf["i"].max() + 1,) * 2)
    out[pdf["i"], pdf["j"]] = pdf[value]
    return out


def _fixed_sign(rows: np.ndarray) -> np.ndarray:
    """Axes are free in sign: make the largest entry of each positive."""
    lead = rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)]
    return rows * np.where(lead < 0, -1.0, 1.0)[:, None]


class _Projection(Params):
    """Parameters of a fitted projection: axes as rows, and the subtracted centre."""

    axes = Param(Params._dummy(), "axes", "projection axes as rows", TypeConverters.identity)
    center = Param(Params._dummy(), "center", "vector subtracted first", TypeConverters.toListFloat)
    spectrum = Param(Params._dummy(), "spectrum", "eigenvalue per axis", TypeConverters.toListFloat)


class ProjectionModel(Model, HasInputCol, HasOutputCol, _Projection, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the coordinates of the input vector on the fitted axes as array<double>, null for a null vector."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        axes = np.array(self.getOrDefault(self.axes))
        center = np.array(self.getOrDefault(self.center))

        @F.pandas_udf("array<double>")
        def project(vectors: pd.Series) -> pd.Series:
            out, there = [None] * len(vectors), np.flatnonzero(vectors.notna().to_numpy())
            if len(there):
                for i, row in zip(there, (np.stack(vectors.iloc[there].to_numpy()) - center) @ axes.T):
                    out[i] = row
            return pd.Series(out, dtype=object)

        return dataset.withColumn(self.getOutputCol(), project(as_double(self.getInputCol())))


def _projection(estimator, axes: np.ndarray, center: np.ndarray, spectrum: np.ndarray) -> ProjectionModel:
    model = ProjectionModel()
    model._set(
        inputCol=estimator.getInputCol(), outputCol=estimator.getOutputCol(),
        axes=axes.tolist(), center=center.tolist(), spectrum=spectrum.tolist(),
    )
    return model


class CenteredPCA(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Principal axes of the sample covariance; vectors are centred before they are projected.

    The covariance is summed on the executors; only the d x d matrix is decomposed here.
    """

    dim = Param(Params._dummy(), "dim", "number of axes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, dim=2):
        super().__init__()
        self._setDefault(dim=2)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ProjectionModel:
        vec = self.getInputCol()
        center = vector_mean(dataset, vec)
        sums = vector_sums(dataset, vec, center=center).filter("i >= 0")
        cov = _matrix(_both_triangles(sums.select("i", "j", (F.col("s") / (F.col("n") - 1)).alias("c")), ["c"]), "c")
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values)[: self.getOrDefault(self.dim)]
        return _projection(self, _fixed_sign(vectors[:, order].T), center, values[order])


class FisherLDA(Estimator, HasInputCol, HasOutputCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Axes with the largest between-class over within-class scatter, projected without centring.

    At most classes - 1 axes separate anything; ``dim`` is the caller's cap.
    """

    dim = Param(Params._dummy(), "dim", "number of axes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, labelCol=None, dim=2):
        super().__init__()
        self._setDefault(dim=2)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ProjectionModel:
        cells = class_scatter(dataset, self.getInputCol(), self.getLabelCol()).toPandas()
        size = cells["i"].max() + 1
        sw, sb = np.zeros((size, size)), np.zeros((size, size))
        sw[cells["i"], cells["j"]] = cells["sw"]
        sb[cells["i"], cells["j"]] = cells["sb"]
        values, vectors = np.linalg.eig(np.linalg.pinv(sw) @ sb)
        order = np.argsort(-values.real)[: self.getOrDefault(self.dim)]
        axes = _fixed_sign(vectors[:, order].T.real)
        return _projection(self, axes, np.zeros(size), values.real[order])


def explained_variance(model: ProjectionModel, df: DataFrame) -> DataFrame:
    """(axis, variance, share) of a fitted spectrum; d rows."""
    values = model.getOrDefault(model.spectrum)
    whole = sum(values) or 1.0
    rows = [(i, float(v), float(v / whole)) for i, v in enumerate(values)]
    return df.sparkSession.createDataFrame(rows, "axis int, variance double, share double")


def leading(col: str, dim: int):
    """The first ``dim`` coordinates of a projected vector."""
    return F.slice(col, 1, dim)
