"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

The kernel of two spans sums over all common three-character subsequences, each weighing less the more it is
stretched, so ``idiot`` stays close to ``idi*ot`` and ``i d i o t``. Landmarks are spans that toxic training documents hold
and their nearest clean ones; the kernels with them, whitened, are a span's features. A sentence counts as toxic
as its worst span, and the machine is trained on labelled sentences with that rule. A logistic curve over the two worst
words and the number of bad ones gives the document's score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.arrow import map_columns
from cohortwise.session import materialize

DECAY, REACH = 0.6, 5  # weight per character spanned, widest span of a subsequence
NEAR = 0.35  # kernels that surely stay below this with all toxic landmarks count as none
LEAST_TELLING = 20.0
SPAN = 20  # characters of a span; longer words are cut into overlapping ones
_BITS = 18
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_NO_LETTER, _MARKS = re.compile(r"[\W\d_]+"), "'\".,;:!?()[]{}#$%&*|<>-_"
_MIX, _STEP = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def words_of(text: str) -> list[str]:
    """The words of a text, and every run of three or more words of one or two characters as one word more."""
    words = text.split()
    short = np.fromiter(map(len, words), np.int64, len(words)) <= 2
    edges = np.flatnonzero(np.diff(np.r_[False, short, False].astype(np.int8)))
    runs = [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a > 2]
    return words + ["".join(words[a:b]) for a, b in runs] if runs else words


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence in lower case; it ends at a line feed or after a closing mark before a blank."""
    parts = (words_of(s) for s in _SENTENCE.split((text or "").lower()))
    return [words for words in parts if words]


def spans_of(word: str) -> list[str]:
    """What of a word is compared: it without marks around it, and only its letters where others stand between.

    Under three characters nothing is left; longer ones than ``SPAN`` are cut into overlapping pieces.
    """
    word = word.strip(_MARKS)
    forms = [word] if word.isalpha() else [word, _NO_LETTER.sub("", word)]
    found = []
    for form in forms:
        if len(form) > SPAN:
            found += [form[i : i + SPAN] for i in range(0, len(form) - SPAN // 2, SPAN // 2)]
        elif len(form) >= 3:
            found.append(form)
    return found


def _combinations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All places i < j < k of a span of n characters with its edge marks, and their weights."""
    at = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + REACH))]
    places = np.array(at, np.int64).reshape(-1, 3)
    return places, (DECAY ** (places[:, 2] - places[:, 0] + 1)).astype(np.float32)


def subsequences(spans: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Spans of one length at a time: their positions, subsequence codes (spans x places) and the places' weights.

    Weights are scaled so that a span of distinct subsequences has length one.
    """
    lengths = np.array([len(s) for s in spans])
    for n in np.unique(lengths):
        places, weights = _combinations(n + 2)
        weights = weights / np.sqrt((weights**2).sum())
        group = np.flatnonzero(lengths == n)
        for which in np.split(group, range(8_192, len(group), 8_192)):
            yield which, _codes([spans[i] for i in which], places), weights


def _codes(spans: list[str], places: np.ndarray) -> np.ndarray:
    text = "".join(f"\x02{s}\x03" for s in spans)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(spans), -1)
    code = (points[:, places[:, 0]] * _STEP + points[:, places[:, 1]]) * _STEP + points[:, places[:, 2]]
    return (code * _MIX >> np.uint32(32 - _BITS)).astype(np.int32)


@dataclass
class Landmarks:
    """Landmark spans as a compact table: row ``index[code]`` holds a subsequence's weight in every landmark.

    ``peak`` is its largest weight in any of the first ``lead`` landmarks, the toxic ones.
    """

    spans: list[str]
    index: np.ndarray
    table: np.ndarray
    peak: np.ndarray

    @classmethod
    def of(cls, spans: list[str], lead: int) -> Landmarks:
        index, rows = np.zeros(1 << _BITS, np.int32), [np.zeros(len(spans), np.float32)]
        for which, codes, weights in subsequences(spans):
            for i, row in zip(which, codes):
                for code, weight in zip(row, weights):
                    if not index[code]:
                        index[code] = len(rows)
                        rows.append(np.zeros(len(spans), np.float32))
                    rows[index[code]][i] += weight
        table = np.array(rows)
        return cls(spans, index, table, table[:, :lead].max(axis=1))

    def kernels(self, spans: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of spans near a toxic landmark, and their kernels with every landmark to the third power.

        The peaks bound a span's kernel with any toxic landmark; below ``NEAR`` all its kernels count as zero.
        """
        for which, codes, weights in subsequences(spans):
            rows = self.index[codes]
            close = np.flatnonzero(self.peak[rows] @ weights >= NEAR)
            for i in range(0, len(close), 512):
                part = close[i : i + 512]
                span, place = np.nonzero(rows[part])
                firsts = np.flatnonzero(np.r_[True, span[1:] != span[:-1]])
                sums = np.add.reduceat(self.table[rows[part[span], place]] * weights[place, None], firsts, axis=0)
                sums = np.clip(sums, 0, 1.5)
                yield which[part], sums * sums * sums

    def kernel_matrix(self, spans: list[str]) -> np.ndarray:
        out = np.zeros((len(spans), len(self.spans)), np.float32)
        for which, kernels in self.kernels(spans):
            out[which] = kernels
        return out


@dataclass
class ToxicityModel:
    """``direction`` and ``bias`` turn a span's kernels into its margin, ``curve`` a document's evidence into a chance."""

    landmarks: Landmarks | None
    direction: np.ndarray | None
    bias: float
    curve: np.ndarray

    def margins(self, words: list[str]) -> np.ndarray:
        """The largest margin of each word's spans; that of nothing where it has none."""
        out = np.full(len(words), self.bias)
        if self.landmarks is None:
            return out
        spans, owners = [], []
        for i, word in enumerate(words):
            for span in spans_of(word):
                spans.append(span)
                owners.append(i)
        owners = np.array(owners, np.int64)
        for which, kernels in self.landmarks.kernels(spans):
            np.maximum.at(out, owners[which], kernels @ self.direction + self.bias)
        return out

    def chance(self, evidence: list[float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.curve @ evidence, -35, 35))))


class WordMargins(dict):
    """Margins of words, each computed once while it is in the bounded cache."""

    def __init__(self, model: ToxicityModel, room: int = 400_000) -> None:
        super().__init__()
        self.model, self.room = model, room

    def evidence(self, texts: list[str | None]) -> list[tuple[list[float], str]]:
        """Per text 1, the two worst margins, the logarithm of one plus the bad words, and the worst word."""
        parted = [words_of((t or "").lower()) for t in texts]
        missing = set(chain.from_iterable(parted)).difference(self)
        if len(self) + len(missing) > self.room:
            self.clear()
            missing = set(chain.from_iterable(parted))
        missing = list(missing)
        for i in range(0, len(missing), 20_000):
            part = missing[i : i + 20_000]
            self.update(zip(part, self.model.margins(part).tolist()))
        found = []
        for words in parted:
            margins = np.fromiter(map(self.__getitem__, words), float, len(words))
            top = np.argsort(-margins, kind="stable")[:2] if len(words) < 3 else np.argpartition(-margins, 1)[:2]
            top = top[np.argsort(-margins[top], kind="stable")]
            first, second = [*margins[top].tolist(), -1.0, -1.0][:2]
            bad = float(np.log1p((margins > 0).sum()))
            found.append(([1.0, max(first, -1.0), max(second, -1.0), bad], words[top[0]] if words else ""))
        return found


def _span_counts(rows: DataFrame) -> DataFrame:
    """(span, toxic, clean): the documents of either label with the span, counted in the partitions first."""

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                for span in {s for w in set(words_of((text or "").lower())) for s in spans_of(w)}:
                    counts.setdefault(span, [0, 0])[label] += 1
        yield {"span": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]}

    made = map_columns(rows.select("text", "label"), kernel, "span string, clean bigint, toxic bigint")
    return made.groupBy("span").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _labelled_sentences(rows: DataFrame, suspects: list[str], seed: int, per_label: int) -> list[tuple[int, list[str]]]:
    """Sentences of clean documents, and those sentences of toxic ones that hold a suspect span."""

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        known = set(suspects)
        for batch in batches:
            parts = [(y, [x for w in words for x in spans_of(w)]) for t, y in zip(batch["text"], batch["label"]) for words in sentences(t)]
            found = [(y, s) for y, s in parts if s and (not y or known & set(s))]
            yield {"label": [y for y, _ in found], "spans": [s for _, s in found]}

    made = map_columns(rows.select("text", "label"), kernel, "label int, spans array<string>")
    ranked = made.withColumn("turn", F.xxhash64(F.lit(seed), "spans"))
    taken = [ranked.filter(F.col("label") == y).orderBy("turn").limit(per_label).collect() for y in (0, 1)]
    return [(r["label"], list(r["spans"])) for part in taken for r in part]


def _obfuscated(span: str) -> list[str]:
    middle = len(span) // 2
    return [span[:middle] + mark + span[middle:] for mark in "*x"]


def fit_toxicity(
    sample: DataFrame, positives: int = 96, negatives: int = 96, train_sentences: int = 4_000, passes: int = 20,
    penalty: float = 1e-4, seed: int = 23,
) -> ToxicityModel:
    """Train on rows (doc_id, text, label), label 1 toxic: a bounded, written sample as ``labelled_sample`` gives it.

    Suspect spans are those that at least three toxic documents hold, that are ten times as frequent there, and whose
    likelihood ratio statistic is beyond chance for a vocabulary of millions. The ``positives`` most telling ones and the ``negatives`` clean spans nearest to them are the landmarks. The machine minimises the
    hinge loss over at most ``train_sentences`` sentences per label; toxic ones also with an inserted character.
    Without suspects, as without rows, every document gets the share of toxic rows (0 without rows) as its score.
    """
    seen = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = seen.get(1, 0), seen.get(0, 0)
    counts = materialize(_span_counts(sample), "spans")
    seen_share = (F.col("toxic") + F.col("clean")) / max(toxic + clean, 1)
    surprise = lambda n, total: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (seen_share * total))).otherwise(0.0)
    telling = 2 * (surprise("toxic", toxic) + surprise("clean", clean))
    often = (F.col("toxic") >= 3) & (F.col("toxic") * max(clean, 1) >= 10 * (F.col("clean") + 0.5) * max(toxic, 1)) & (telling >= LEAST_TELLING)
    suspects = [r["span"] for r in counts.filter(often).orderBy(telling.desc(), "span").limit(4 * positives).collect()]
    share = toxic / max(toxic + clean, 1)
    if not suspects or not clean:
        base = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return ToxicityModel(None, None, 0.0, np.array([base, 0.0, 0.0, 0.0]))
    top = suspects[:positives]
    benign = counts.filter("toxic * 2 <= clean").orderBy(F.col("clean").desc(), "span").limit(30_000)
    benign = [r["span"] for r in benign.collect()]
    near = Landmarks.of(top, len(top)).kernel_matrix(benign).max(axis=1) if benign else np.empty(0)
    landmarks = Landmarks.of(top + [benign[i] for i in np.argsort(-near, kind="stable")[:negatives]], len(top))

    own = landmarks.kernel_matrix(landmarks.spans).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    whiten = vectors * (1 / np.sqrt(np.maximum(values, 1e-3)))  # Nyström: K^-1/2 up to a rotation
    labelled = _labelled_sentences(sample, suspects, seed, train_sentences)
    bags = [(1 if y else -1, spans) for y, spans in labelled]
    known = set(suspects)
    bags += [(1, [o]) for y, spans in labelled if y for s in spans if s in known for o in _obfuscated(s)][:train_sentences]
    spans = list({s for _, b in bags for s in b})
    at = {s: i for i, s in enumerate(spans)}
    mapped = (landmarks.kernel_matrix(spans) @ whiten).astype(np.float64)
    w, bias = _train([(y, [at[s] for s in b]) for y, b in bags], mapped, passes, penalty, seed)
    model = ToxicityModel(landmarks, (whiten @ w).astype(np.float32), bias, np.zeros(4))
    model.curve = _calibrated(sample, model)
    return model


def _train(bags: list[tuple[int, list[int]]], mapped: np.ndarray, passes: int, penalty: float, seed: int) -> tuple[np.ndarray, float]:
    """Hinge loss on the worst span of each sentence by averaged subgradient steps; labels weigh the same in sum."""
    rng = np.random.default_rng(seed)
    share = {y: len(bags) / (2 * max(sum(1 for b, _ in bags if b == y), 1)) for y in (-1, 1)}
    w, bias, mean_w, mean_b, step = np.zeros(mapped.shape[1]), 0.0, 0.0, 0.0, 0
    for turn in range(passes):
        margins = mapped @ w
        worst = [b[int(np.argmax(margins[b]))] for _, b in bags]  # the spans that speak for their sentences in this pass
        for i in rng.permutation(len(bags)):
            step += 1
            rate = 1 / (1 + penalty * 10 * step) * 0.1
            y, x = bags[i][0], mapped[worst[i]]
            w *= 1 - rate * penalty
            if y * (w @ x + bias) < 1:
                w += rate * share[y] * y * x
                bias += rate * share[y] * y * 0.1
        if turn >= passes // 2:
            mean_w, mean_b = mean_w + w, mean_b + bias
    n = passes - passes // 2
    return mean_w / n, mean_b / n


def _calibrated(sample: DataFrame, model: ToxicityModel) -> np.ndarray:
    """The logistic curve over the evidence of the sampled documents, in their given shares."""
    table = sample.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        margins = WordMargins(table.value)
        for batch in batches:
            yield {"evidence": [e for e, _ in margins.evidence(batch["text"])], "label": batch["label"]}

    seen = map_columns(sample.select("text", "label"), kernel, "evidence array<double>, label int").toPandas()
    x, y = np.array(seen["evidence"].tolist()), seen["label"].to_numpy().astype(float)
    return _rising_curve(x, y)


def _rising_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of which all but the first, the constant's, are not negative: more evidence never lowers a chance.

    Weights that come out negative are held at zero, the lowest first, and the others fitted again.
    """
    free = list(range(x.shape[1]))
    while True:
        part, curve = x[:, free], np.zeros(len(free))
        ridge = np.diag([1e-6] + [0.1] * (len(free) - 1))
        for _ in range(100):  # damped Newton steps
            p = 1 / (1 + np.exp(-np.clip(part @ curve, -35, 35)))
            move = np.linalg.solve(part.T @ (part * np.maximum(p * (1 - p), 1e-9)[:, None]) + ridge, part.T @ (p - y) + ridge @ curve)
            curve = curve - move * min(1, 1 / max(np.abs(move).max(), 1e-12))
            if np.abs(move).max() < 1e-8:
                break
        if len(free) == 1 or curve[1:].min() >= 0:
            out = np.zeros(x.shape[1])
            out[free] = curve
            return out
        del free[1 + int(curve[1:].argmin())]


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", bar: float = 0.3) -> DataFrame:
    """One row per input row: ``doc_id, score, predicted, worst_word``; the score is the chance of label 1.

    A null text, an empty one or one without a span of three characters has margins of -1. Null and repeated ids keep
    their rows. Other columns are not read. No rows in, no rows out. Every sentence of the whole text is scored. The
    broadcast model is bounded by its numbers of landmarks.
    """
    table = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        margins = WordMargins(table.value)
        for batch in batches:
            for i in range(0, len(batch["text"]), 500):
                found = margins.evidence(batch["text"][i : i + 500])
                scores = [table.value.chance(e) for e, _ in found]
                yield {"doc_id": batch["doc_id"][i : i + 500], "score": scores, "predicted": [int(s >= bar) for s in scores],
                       "worst_word": [s for _, s in found]}

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_columns(rows, kernel, f"doc_id {kind}, score double, predicted int, worst_word string")
