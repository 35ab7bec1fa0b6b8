"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words, word pairs and the shapes of word triples are hashed into one weight table, so a score is one sparse
dot product. Training rows are dealt to shards by a hash; every shard runs proximal updates on its rows, and the
shards' weights are averaged.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.arrow import map_columns

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_SAME = np.uint64(1)  # the shape of a token that repeats the one before
_PAIR, _TRIPLE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _shape(token: str) -> str:
    if token[0].isalpha():
        return "U" if token.isupper() and len(token) > 1 else "C" if token[0].isupper() else "l"
    return "9" if token[0].isdigit() else token[:3]


class Tokens(dict):
    """Token to one number: the hash of its lower-case form above that of its shape; bounded."""

    def __missing__(self, token: str) -> int:
        word, shape = (zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in (token.lower(), "\x00" + _shape(token)))
        made = word << 32 | shape
        if len(self) >= 250_000:
            self.clear()
        if len(token) <= 48:
            self[token] = made
        return made


def features(text: str | None, bits: int, known: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's sparse vector, of length one; place 0 is the bias.

    A value is the logarithm of one plus the count. Whole texts are hashed, in order.
    """
    tokens = _TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(1, np.int64), np.ones(1)
    both = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    shape[1:][word[1:] == word[:-1]] = _SAME
    hashes = [word, word[:-1] * _PAIR + word[1:], (shape[:-2] * _PAIR + shape[1:-1]) * _TRIPLE + shape[2:], shape * _TRIPLE]
    mixed = np.concatenate(hashes) * _MIX
    places, counts = np.unique((mixed >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    values = np.log1p(counts)
    values /= np.sqrt((values * values).sum())
    return np.r_[0, places + 1], np.r_[1.0, values]


class Leader:
    """Per-coordinate proximal follow-the-regularised-leader for the logistic loss."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, places=slice(None)) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        slack = np.maximum(np.abs(z) - self.l1, 0)
        return -np.sign(z) * slack / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(places)
        gradient = (_sigmoid(float(w @ values)) - label) * values
        n = self.n[places]
        self.z[places] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.alpha * w
        self.n[places] = n + gradient**2


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def fit_quality(
    rows: DataFrame, bits: int = 18, shard_rows: int = 3_000, updates: int = 12_000, alpha: float = 0.5, beta: float = 1.0,
    l1: float = 0.05, l2: float = 0.1, seed: int = 17,
) -> np.ndarray:
    """The averaged weights from rows (doc_id, text, label), a bounded sample as ``labelled_sample`` gives it.

    Rows are dealt to shards of about ``shard_rows``, which pass over them until they have made ``updates`` (4 to 40 times). A shard takes
    its rows in the order of a hash, so the weights do not depend on partitions; it sends its non-zero weights, at most
    ``2 ** bits`` of them. Without rows all weights are 0 and every score is one half.
    """
    total = rows.count()
    shards = max(1, round(total / shard_rows))
    passes = min(40, max(4, updates * shards // max(total, 1)))
    order = F.xxhash64(F.lit(seed + 1), "doc_id", "text")
    dealt = rows.select("text", "label", order.alias("turn")).withColumn("shard", F.pmod("turn", F.lit(shards)).cast("int"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "turn")
    size = (1 << bits) + 1

    def learned(shard: int, examples: list) -> Iterator[dict]:
        leader = Leader(size, alpha, beta, l1, l2)
        for _ in range(passes):
            for places, values, label in examples:
                leader.update(places, values, label)
        w = leader.weights()
        places = np.flatnonzero(w)
        yield {"shard": [shard] * len(places), "place": places.tolist(), "weight": w[places].tolist()}

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        known, shard, examples = Tokens(), None, []
        for batch in batches:
            for at, text, label in zip(batch["shard"], batch["text"], batch["label"]):
                if at != shard and examples:
                    yield from learned(shard, examples)
                    examples = []
                shard = at
                places, values = features(text, bits, known)
                examples.append((places.astype(np.int32), values.astype(np.float32), label))
        if examples:
            yield from learned(shard, examples)

    found = map_columns(dealt, kernel, "shard int, place bigint, weight double")
    mean = found.groupBy("place").agg((F.sum("weight") / shards).alias("weight")).toPandas()
    weights = np.zeros(size)
    weights[mean["place"].to_numpy(np.int64)] = mean["weight"].to_numpy()
    return weights


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", bar: float = 0.5) -> DataFrame:
    """One row per input row: ``doc_id, score, predicted``; the score is the chance of label 1.

    A null text, an empty one or one without tokens is scored by the bias alone. Null and repeated ids keep their rows.
    Other columns are not read. No rows in, no rows out. The broadcast table has the size that ``bits`` fixed.
    """
    bits = (len(weights) - 1).bit_length() - 1
    table = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        known = Tokens()
        for batch in batches:
            scores = []
            for text in batch["text"]:
                places, values = features(text, bits, known)
                scores.append(_sigmoid(float(table.value[places] @ values)))
            yield {"doc_id": batch["doc_id"], "score": scores, "predicted": [int(s >= bar) for s in scores]}

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_columns(rows, kernel, f"doc_id {kind}, score double, predicted int")
