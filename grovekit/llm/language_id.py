"""Language identification with string kernels.

The kernel of two texts is the normalised overlap of their blended spectra:
the sets of byte n-grams of order 1 to 3 (order 3 hashed). A bounded, balanced
sample of labelled rows is embedded by Nystroem landmarks, one-versus-rest
kernel ridge regression is solved in closed form, and both maps are folded into
one matrix. Scoring is one Arrow pass: presence vectors of a batch times the
landmark matrix times the folded weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import slices, text_bytes, trim

TRAIN_ROWS = 3000  # at most so many labelled rows are learnt from, balanced over languages
LANDMARKS = 96
LANDMARK_GRAMS = (200, 3000)  # preferred size of a landmark's spectrum
RIDGE = 1e-3
BROADCAST_CLASSES = 100_000
SHARPNESS = 6.0
BINS = 256 + (1 << 16) + (1 << 16)
UNDETERMINED = "und"
_BLOCK = 128


def spectrum(text: bytes) -> np.ndarray:
    """Presence of the n-gram bins of one text (A-Z lower-cased)."""
    b = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
    seen = np.zeros(BINS, np.bool_)
    seen[b] = True
    if len(b) > 1:
        two = b[:-1] << 8 | b[1:]
        seen[two + 256] = True
        if len(b) > 2:
            three = (two[:-1] << 8 | b[2:]) * np.uint32(2654435761)
            seen[(three >> 16) + (256 + (1 << 16))] = True
    return seen


class LanguageModel:
    """Landmark spectra and folded one-versus-rest weights."""

    def __init__(self, texts: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(langs))
        if not self.langs:
            return
        x = np.stack([np.packbits(spectrum(t)) for t in texts])
        sizes = np.array([np.unpackbits(r).sum() for r in x], np.float32)
        low, high = LANDMARK_GRAMS
        fit = [i for i in range(len(texts)) if low <= sizes[i] <= high] or list(range(len(texts)))
        by_lang: dict[str, list[int]] = {}
        for i in fit:
            by_lang.setdefault(langs[i], []).append(i)
        picked = sorted(i for own in by_lang.values() for i in own[: -(-landmarks // len(by_lang))])
        marks = np.stack([np.unpackbits(x[i])[:BINS] for i in picked])
        self.grams = np.flatnonzero(marks.any(0))
        self.marks = np.ascontiguousarray(marks[:, self.grams].T, np.float32) / np.sqrt(sizes[picked])
        kernel = np.concatenate([self._kernel([np.unpackbits(r)[:BINS] for r in x[at : at + _BLOCK]]) for at in range(0, len(x), _BLOCK)])
        values, vectors = np.linalg.eigh(kernel[picked].astype(np.float64))
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        z = kernel @ root
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None], 1.0, -1.0)
        z1 = np.hstack([z, np.ones((len(z), 1))])
        w = np.linalg.solve(z1.T @ z1 + ridge * len(z) * np.diag([1.0] * z.shape[1] + [0.0]), z1.T @ y)
        self.weights, self.bias = (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)

    def _kernel(self, seen: list[np.ndarray]) -> np.ndarray:
        sizes = np.sqrt(np.maximum([np.count_nonzero(s) for s in seen], 1)).astype(np.float32)
        return np.stack([s[self.grams] for s in seen]).astype(np.float32) @ self.marks / sizes[:, None]

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        names, scores = [], []
        for at in range(0, len(texts), _BLOCK):
            f = SHARPNESS * (self._kernel([spectrum(t) for t in texts[at : at + _BLOCK]]) @ self.weights + self.bias).astype(np.float64)
            p = np.exp(f - f.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            names += [self.langs[i] for i in p.argmax(1)]
            scores.append(p.max(1))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def balanced_sample(rows: DataFrame, class_col: str, key: Column, n: int) -> DataFrame:
    """At most ``n`` rows, about as many of each class, the same on every run.

    A row's place is its hashed key, in [0, 1), times its class's size; rows
    beyond what is needed are left out before the rest is sorted.
    """
    sizes = rows.groupBy(class_col).agg(F.count(F.lit(1)).alias("__size"))
    classes, least = sizes.agg(F.count(F.lit(1)), F.min("__size")).first()
    if not classes:
        return rows.limit(0)
    if classes <= BROADCAST_CLASSES:
        sizes = F.broadcast(sizes)  # else texts would be dealt by class, and a few classes hold all
    size = F.col("__size")
    order = (F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40))) * size
    each = n / classes
    spare = n if least < each else each  # small classes leave room to the others
    return rows.join(sizes, class_col).withColumn("__order", order).filter(F.col("__order") < spare + 5 * spare**0.5 + 10).orderBy("__order", key).limit(n).select(*rows.columns, "__order")


def fit(labelled: DataFrame, max_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> LanguageModel:
    """Learn from ``doc_id, text, lang``; rows with a null in one of them are left out."""
    rows = labelled.select("doc_id", F.col("text").cast("binary").alias("text"), "lang").dropna()
    sample = balanced_sample(rows, "lang", F.col("doc_id"), max_rows).select("text", "lang").toArrow()
    return LanguageModel([bytes(t) for t in sample["text"].to_pylist()], sample["lang"].to_pylist(), landmarks)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """``doc_id, keep..., lang_pred, score`` of every row from its text alone.

    Null texts and texts without a letter are ``und`` with score 0; so is all
    where nothing was learnt. Other columns are ignored unless kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(F.col(id_col).alias("doc_id"), *keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["lang_pred string", "score double"])
    names = [*kept.columns, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for b in slices(batches):
            langs, scores = shared.value.predict(text_bytes(b.column(1)))
            letters = b.column(0).to_pylist()
            langs = [x if ok else UNDETERMINED for x, ok in zip(langs, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(langs, pa.string()), pa.array(np.where(letters, scores, 0.0), pa.float64())], names=names)

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(text.rlike(r"\p{L}").alias("__letter"), text.cast("binary").alias("__text"), F.col(id_col).alias("doc_id"), *keep).mapInArrow(run, schema)


def held_out(modulus: int, remainder: int, id_col: str = "doc_id") -> Column:
    """Whether the crc32 of the id as text has that remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
