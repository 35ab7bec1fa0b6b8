"""A network of rectifier layers, trained by mini-batches in blocks of rows, stopped on a held-out share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.operators.blocks import distinct_rows, seeded_blocks, unpacked

# Sums of parameters over blocks are taken in whole units of this, so they are exact in any order.
UNIT = 2.0**-36
LARGEST = 2.0**20


def unflatten(flat: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, biases) of each layer, as views of the flat parameters."""
    found, at = [], 0
    for before, after in zip(layers, layers[1:]):
        found.append((flat[at : at + before * after].reshape(before, after), flat[at + before * after : at + (before + 1) * after]))
        at += (before + 1) * after
    return found


def first_parameters(layers: list[int], seed: int) -> np.ndarray:
    """Uniform draws within sqrt(6 / (inputs + outputs)) of zero, layer by layer."""
    draw = np.random.default_rng(seed)
    return np.concatenate([draw.uniform(-1, 1, (a + 1) * b) * np.sqrt(6.0 / (a + b)) for a, b in zip(layers, layers[1:])])


def _forward(flat: np.ndarray, layers: list[int], x: np.ndarray) -> list[np.ndarray]:
    """The inputs of every layer, and last the log-probabilities."""
    values, parts = [x], unflatten(flat, layers)
    for i, (weights, biases) in enumerate(parts):
        out = values[-1] @ weights + biases
        if i < len(parts) - 1:
            values.append(np.maximum(out, 0.0))
        else:
            out = out - out.max(axis=1, keepdims=True)
            values.append(out - np.log(np.exp(out).sum(axis=1, keepdims=True)))
    return values


def loss_and_gradient(
    flat: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 0.0
) -> tuple[float, np.ndarray]:
    """Weighted mean cross entropy plus ``ridge / 2`` times the squared weights (not the biases), and its gradient."""
    values, parts, mass = _forward(flat, layers, x), unflatten(flat, layers), w.sum()
    said = values.pop()
    loss = -(w * said[np.arange(len(y)), y]).sum() / mass + ridge / 2 * sum((weights**2).sum() for weights, _ in parts)
    back = np.exp(said)
    back[np.arange(len(y)), y] -= 1.0
    back *= (w / mass)[:, None]
    pieces = []
    for (weights, _), value in zip(reversed(parts), reversed(values)):
        pieces.append(np.concatenate([(value.T @ back + ridge * weights).ravel(), back.sum(axis=0)]))
        back = (back @ weights.T) * (value > 0)
    return loss, np.concatenate(pieces[::-1])


def _epoch(state: np.ndarray, layers, block: dict, epoch: int, seed: int, batch: int, rate: float, ridge: float) -> tuple[np.ndarray, float, float]:
    """(parameters, both moments) after one seeded pass of adaptive-moment steps over a block's training rows; summed loss, mass."""
    flat, first, second = state[0].copy(), state[1].copy(), state[2] ** 2
    rows = np.flatnonzero(~block["held"])
    order = np.random.default_rng([seed, epoch, block["block"]]).permutation(rows)
    steps, lost, mass = -(-len(rows) // batch), 0.0, 0.0
    for i in range(steps):
        chosen = order[i * batch : (i + 1) * batch]
        w = block["w"][chosen]
        loss, gradient = loss_and_gradient(flat, layers, block["x"][chosen], block["y"][chosen], w, ridge / len(chosen))
        lost, mass = lost + loss * w.sum(), mass + w.sum()
        done = epoch * steps + i + 1
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        flat -= rate * np.sqrt(1 - 0.999**done) / (1 - 0.9**done) * first / (np.sqrt(second) + 1e-8)
    return np.stack([flat, first, np.sqrt(second)]), lost, mass


def _pass(blocks: DataFrame, count: int, state: np.ndarray, layers: list[int], epoch: int, **how) -> tuple[np.ndarray, float, float]:
    """One job: score the parameters on the held-out rows, train every block from them, and average the blocks.

    Gives the new state, the held-out accuracy (NaN without such rows) and the mean training loss.
    """
    width = state.size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in unpacked(batch):
                held, w = block["held"], block["w"]
                right = _forward(state[0], layers, block["x"][held])[-1].argmax(axis=1) == block["y"][held]
                new, lost, mass = _epoch(state, layers, block, epoch, **how)
                if not np.isfinite(new).all() or np.abs(new).max() > LARGEST:
                    raise ValueError("the network diverged: scale the features or take a smaller rate")
                units = np.concatenate([np.rint(new.ravel() / UNIT).astype(np.int64), np.zeros(4, np.int64)])
                figures = np.concatenate([np.zeros(width), [w[held][right].sum(), w[held].sum(), lost, mass]])
                yield pd.DataFrame({"at": np.arange(width + 4), "units": units, "figure": figures})

    made = blocks.mapInPandas(run, "at int, units long, figure double")
    sums = made.groupBy("at").agg(F.sum(F.col("units").cast("decimal(20,0)")).cast("string").alias("units"), F.sum("figure").alias("figure"))
    found = sums.toPandas().sort_values("at")
    total = np.array([int(u) for u in found["units"][:width]], dtype=object) / count
    right, held, lost, mass = found["figure"].to_numpy()[width:]
    return (total.astype(float) * UNIT).reshape(state.shape), right / held if held else np.nan, lost / mass if mass else 0.0


class _Network(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    layers = Param(Params._dummy(), "layers", "inputs, units of the hidden layers, classes", TypeConverters.toListInt)
    weights = Param(Params._dummy(), "weights", "all parameters, layer by layer", TypeConverters.toListFloat)
    epochs = Param(Params._dummy(), "epochs", "passes that the training took", TypeConverters.toInt)


class RectifierNetworkModel(Model, _Network, DefaultParamsReadable, DefaultParamsWritable):
    """Adds class probabilities and the likeliest class, the smallest on ties."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        layers, flat = self.getOrDefault(self.layers), np.array(self.getOrDefault(self.weights))

        @F.pandas_udf("array<double>")
        def chances(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            return pd.Series(list(np.exp(_forward(flat, layers, np.stack(vectors.to_numpy()))[-1])))

        probability, chance = self.getProbabilityCol(), F.col("_chance")
        said = dataset.withColumn("_chance", chances(vector_to_array(self.getFeaturesCol())))
        best = (F.array_position(chance, F.array_max(chance)) - 1).cast("double")
        return said.withColumns({probability: array_to_vector(chance), self.getPredictionCol(): best}).drop("_chance")


class RectifierNetwork(Estimator, _Network, HasMaxIter, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Softmax over rectifier layers; labels are 0, 1, ... and rows without one take no part.

    Rows lie in written blocks of up to 50,000, copies once with their weight. One job is one epoch: every block goes through its rows
    in seeded mini-batches from the common parameters, and parameters and moments of all blocks are averaged. With one
    block that is plain mini-batch training; with more, what moves per epoch is the parameters per block and never the rows. Blocks,
    batches and held-out rows follow from the rows' content and sums are exact, so partitioning changes nothing. The
    training ends when ``patience`` epochs in a row have not raised the best accuracy on the held-out ``share`` by ``tol``, and the
    parameters with the best accuracy stay. Without held-out rows the training loss decides and the last parameters stay.
    """

    hidden = Param(Params._dummy(), "hidden", "units of the hidden layers", TypeConverters.toListInt)
    batch = Param(Params._dummy(), "batch", "rows of a mini-batch", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "step size", TypeConverters.toFloat)
    ridge = Param(Params._dummy(), "ridge", "penalty on squared weights", TypeConverters.toFloat)
    share = Param(Params._dummy(), "share", "share of the rows held out to stop early", TypeConverters.toFloat)
    patience = Param(Params._dummy(), "patience", "epochs without gain before the end", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "least gain that counts", TypeConverters.toFloat)
    blockRows = Param(Params._dummy(), "blockRows", "rows of a block, 0 for what fits into 32 MB", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", hidden=(64, 32), maxIter=200, batch=200, rate=0.001, ridge=0.0001,
                 share=0.1, patience=10, tol=0.0001, seed=42, blockRows=0):
        super().__init__()
        self._setDefault(hidden=[64, 32], maxIter=200, batch=200, rate=0.001, ridge=0.0001, share=0.1, patience=10, tol=0.0001, seed=42,
                         blockRows=0)
        self._set(**{k: list(v) if k == "hidden" else v for k, v in self._input_kwargs.items()})

    def _fit(self, dataset: DataFrame) -> RectifierNetworkModel:
        get = lambda name: self.getOrDefault(getattr(self, name))
        rows = distinct_rows(dataset, self.getFeaturesCol(), self.getLabelCol())
        blocks = seeded_blocks(rows, self.getSeed(), get("share"), get("blockRows") or None)
        known = blocks.select("d", "y").mapInPandas(_seen, "d int, least int, most int").agg(F.count("d"), F.max("d"), F.min("least"), F.max("most")).first()
        if not known[0]:
            raise ValueError("no labelled row to train on")
        if known[2] < 0:
            raise ValueError("labels are 0, 1, ...")
        layers = [known[1], *get("hidden"), max(2, known[3] + 1)]
        flat = first_parameters(layers, self.getSeed())
        state = np.stack([flat, np.zeros_like(flat), np.zeros_like(flat)])
        best, kept, idle, epoch = -np.inf, flat, 0, 0
        how = {"seed": self.getSeed(), "batch": get("batch"), "rate": get("rate"), "ridge": get("ridge")}
        # A pass scores the parameters it starts from, so the last one only serves to score.
        for epoch in range(get("maxIter") + 1):
            new, accuracy, loss = _pass(blocks, known[0], state, layers, epoch, **how)
            value = -loss if np.isnan(accuracy) else accuracy
            idle = 0 if value >= best + get("tol") else idle + 1
            if value > best or np.isnan(accuracy):
                best, kept = max(best, value), state[0]
            if idle > get("patience"):
                break
            state = new
        model = RectifierNetworkModel()
        model._set(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(), predictionCol=self.getPredictionCol(),
                   probabilityCol=self.getProbabilityCol(), layers=[int(n) for n in layers], weights=kept.tolist(), epochs=epoch)
        return model


def _seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for d, y in zip(batch["d"], batch["y"]):
            found = np.frombuffer(y, np.int32)
            yield pd.DataFrame({"d": [d], "least": [found.min()], "most": [found.max()]})
