"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators are the word shapes of a text (runs of lower case, upper case,
digits and signs, and whether a word repeats the one before) as 1-, 2- and
3-grams, and its known words. Each indicator is scaled by the log-count ratio
of the classes, and a linear hinge-loss model is fitted to the scaled
indicators by dual coordinate descent; a logistic map turns margins into
probabilities. Learning uses a bounded, balanced sample of labelled rows;
scoring is one Arrow pass over all whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import binary_docs, slices, text_bytes, trim
from grovekit.llm.language_id import balanced_sample

TRAIN_ROWS = 8000  # at most so many labelled rows are learnt from, balanced over both classes
MIN_DOCS = 4  # an indicator is kept if so many sampled rows have it
SMOOTHING = 1.0
COST = 0.5
EPOCHS = 20
_SHAPE = bytes(97 if 97 <= c <= 122 or c > 127 else 65 if 65 <= c <= 90 else 57 if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
_MAX_CACHE, _MAX_WORD = 400_000, 40


class Shapes:
    """Shape of each word, with a bounded cache."""

    def __init__(self):
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def _of(word: bytes) -> bytes:
        shape = _RUNS.sub(rb"\1", word.translate(_SHAPE))
        return shape if len(shape) <= 12 else shape[:11] + b"~"

    def __call__(self, words: list[bytes]) -> list[bytes]:
        known = self.known
        if len(known) > _MAX_CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self._of(w)
        out = [known[w] for w in words]
        if words and max(map(len, words)) > _MAX_WORD:
            for w in {w for w in words if len(w) > _MAX_WORD}:
                del known[w]
        return out


def indicators(text: bytes, shapes: Shapes) -> set:
    """The distinct n-gram indicators of one text."""
    words = text.split()
    s = shapes(words)
    out = set(words)
    out.update(zip(s))
    out.update(zip(s, s[1:], strict=False))
    out.update(zip(s, s[1:], s[2:], strict=False))
    again = [a == b for a, b in zip(words, words[1:], strict=False)]
    out.update(("same", *x) for x in set(zip(again, again[1:], strict=False)))
    out.add(("size", len(words).bit_length()))
    return out


def fit_hinge(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of an L2-regularised squared hinge loss by dual coordinate descent.

    Row ``i`` has value ``values[j]`` at each index ``j`` in ``rows[i]``; the last weight is a bias.
    """
    n = len(values)
    w, bias, alpha, diagonal = np.zeros(n), 0.0, np.zeros(len(rows)), 0.5 / cost
    scaled = [values[r] for r in rows]
    norms = np.array([v @ v + 1.0 for v in scaled]) + diagonal
    order = np.random.default_rng(0)
    for _ in range(epochs):
        largest = 0.0
        for i in order.permutation(len(rows)):
            r, v = rows[i], scaled[i]
            gradient = y[i] * (w[r] @ v + bias) - 1 + diagonal * alpha[i]
            projected = min(gradient, 0.0) if alpha[i] == 0 else gradient
            if projected:
                largest = max(largest, abs(projected))
                new = max(alpha[i] - gradient / norms[i], 0.0)
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[r] += step * v
                bias += step
        if largest < 1e-3:
            break
    return np.append(w, bias)


def _logistic(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a weighted logistic fit, by Newton steps with a small ridge."""
    x, theta = np.column_stack([margins, np.ones_like(margins)]), np.array([1.0, 0.0])
    target = np.where(y > 0, 0.999, 0.001)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-3 * (theta - [1.0, 0.0])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        theta = theta - step
        if abs(step).max() < 1e-6:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


class QualityModel:
    """Weight of each indicator, and the map from margin to probability."""

    def __init__(self, texts: list[bytes], labels: list[int], class_sizes: dict[int, int]):
        self.weights: dict = {}
        self.bias, self.slope, self.shift = 0.0, 1.0, 0.0
        if len(set(labels)) < 2:
            self.shift = 5.0 if 1 in labels else -5.0 if labels else 0.0
            return
        shapes = Shapes()
        sets = [indicators(t, shapes) for t in texts]
        counts = Counter(x for s in sets for x in s)
        vocabulary = {x: i for i, x in enumerate(sorted((x for x, k in counts.items() if k >= MIN_DOCS), key=repr))}
        rows = [np.array(sorted(vocabulary[x] for x in s if x in vocabulary), np.int64) for s in sets]
        y = np.where(np.array(labels) > 0, 1.0, -1.0)
        fold = np.arange(len(rows)) % 4 == 3  # the part that margins are mapped on
        ratio = self._ratio(rows, y, ~fold, len(vocabulary))
        w = fit_hinge([r for r, f in zip(rows, fold, strict=True) if not f], ratio, y[~fold])
        margin = np.array([ratio[r] @ w[:-1][r] + w[-1] for r in rows])
        natural = np.array([class_sizes[k] / labels.count(k) for k in (0, 1)])
        self.slope, self.shift = _logistic(margin[fold], y[fold], natural[(y[fold] > 0).astype(int)] / natural.mean())
        ratio = self._ratio(rows, y, np.ones(len(rows), bool), len(vocabulary))
        w = fit_hinge(rows, ratio, y)
        self.bias = float(w[-1])
        self.weights = {x: float(ratio[i] * w[i]) for x, i in vocabulary.items() if ratio[i] * w[i]}

    @staticmethod
    def _ratio(rows: list[np.ndarray], y: np.ndarray, used: np.ndarray, n: int) -> np.ndarray:
        """Log-count ratios of the indicators."""
        p = [np.full(n, SMOOTHING) + np.bincount(np.concatenate([r for r, v, u in zip(rows, y, used, strict=True) if u and v == sign] or [np.zeros(0, np.int64)]), minlength=n) for sign in (1, -1)]
        return np.log(p[0] / p[0].sum()) - np.log(p[1] / p[1].sum())

    def score(self, texts: list[bytes], shapes: Shapes) -> np.ndarray:
        weights, known = self.weights, self.weights.keys()
        margins = np.array([sum(weights[x] for x in known & indicators(t, shapes)) + self.bias for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = TRAIN_ROWS) -> QualityModel:
    """Learn from labelled rows; a document labelled more than once counts by its mean label.

    The sample is drawn from the labels alone, so only its documents' texts are gathered.
    """
    known = labels.select("doc_id", F.col(label_col).alias("y")).dropna().groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    sample = balanced_sample(known, "y", F.col("doc_id"), max_rows).select("doc_id", "y")
    rows = binary_docs(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return QualityModel([bytes(t) for t in rows["text"].to_pylist()], rows["y"].to_pylist(), sizes)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score`` of every row; null text counts as empty and gets the score of one without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        shapes = Shapes()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(text_bytes(b.column(1)), shapes), pa.float64())], names=["doc_id", "score"])

    return binary_docs(docs).mapInArrow(run, "doc_id long, score double")
