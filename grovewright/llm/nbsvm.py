"""Quality classifier: Naive Bayes support vectors.

Indicators of word and word-shape 1- to 2-grams are scaled by the log-count ratio of the
two classes and fed to a linear hinge-loss model fitted by dual coordinate descent; the
margin becomes a score by a logistic fit. Features are hashed to 2**BITS columns, so the
model has a fixed size. Fitting uses about FIT_ROWS labelled rows (by hash of the id);
scoring reads every whole text once and shuffles nothing.

Null and empty texts have no features and get the score of the bias. Repeated rows get a
row each. Labels that contradict each other count by their mean. With labels of one class
or none, the score is their share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE, Shared, WordHash, fold, give_back, ngrams, part_of, raw, tidied

BITS = 18
FIT_ROWS = 6_000
KINDS = bytes(48 if 48 <= c < 58 else 65 if 65 <= c < 91 else 97 if 97 <= c < 123 or c > 127 else c for c in range(256))


class ShapeHash(WordHash):
    """Hash of a word's shape: runs of capitals, letters, digits and signs, each run once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        t = word.translate(KINDS)
        shape = bytes(c for i, c in enumerate(t) if not i or c != t[i - 1])
        h = xxhash.xxh64_intdigest(shape, 7) - (1 << 63)
        self[word] = h
        return h


def features(text: bytes, words: WordHash, shapes: ShapeHash) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    split = text.split()
    if not split:
        return np.zeros(0, np.int64)
    h, s = words.of([w.lower() for w in split]), shapes.of(split)
    t = ngrams(h, 3)
    again = int(10 * (1 - len(np.unique(t)) / len(t))) if len(t) else 0  # tenths of 3-grams that came before
    extra = np.array([again + 1], np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    every = np.concatenate([h, ngrams(h, 2), s, ngrams(s, 2) + np.uint64(1), ngrams(s, 3) + np.uint64(2), extra])
    return np.unique(every >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    constant: float | None = None

    def score(self, f: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        m = self.weights[f].sum() / np.sqrt(len(f)) + self.bias if len(f) else self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * m + self.shift, -40, 40))))


def descend(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, c: np.ndarray, passes: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; rows hold feature numbers, values the feature scales."""
    w, b, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    x = [values[f] / np.sqrt(max(1, len(f))) for f in rows]
    square = np.array([v @ v + 1.0 for v in x])
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(passes):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            f, v = rows[i], x[i]
            g = y[i] * (w[f] @ v + b) - 1
            a = min(max(alpha[i] - g / square[i], 0.0), c[i])
            step = (a - alpha[i]) * y[i]
            if step:
                alpha[i] = a
                w[f] += step * v
                b += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


def train(rows: list[np.ndarray], good: np.ndarray, cost: float = 1.0, smooth: float = 1.0) -> Model:
    if len(rows) == 0 or good.all() or not good.any():
        return Model(np.zeros(1 << BITS), 0, 1, 0, float(good.mean()) if len(rows) else 0.5)
    p = np.full(1 << BITS, smooth)
    q = p.copy()
    for f, g in zip(rows, good):
        (p if g else q)[f] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    y = np.where(good, 1.0, -1.0)
    half = np.arange(len(rows)) % 4 == 0  # the logistic fit uses rows that the first model has not seen
    c = cost * np.where(good, 0.5 / good.mean(), 0.5 / (1 - good.mean()))
    w, b = descend([r for r, h in zip(rows, half) if not h], ratio, y[~half], c[~half])
    margin = np.array([(w * ratio)[r].sum() / np.sqrt(max(1, len(r))) + b for r, h in zip(rows, half) if h])
    slope, shift = logistic(margin, good[half])
    w, b = descend(rows, ratio, y, c)
    return Model((w * ratio).astype(np.float64), float(b), slope, shift)


def logistic(m: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Newton's method on smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    t = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.stack([m, np.ones_like(m)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        z = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        h = (x * (z * (1 - z))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (z - t) + 1e-3 * theta)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, column: str = "quality") -> Model:
    marks = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg((F.avg(column) >= 0.5).alias("good"))
    sample = marks.where(part_of("doc_id", rows, marks.count()))

    def run(batches):
        words, shapes = WordHash(), ShapeHash()
        for batch in batches:
            found = [features(t or b"", words, shapes).astype(np.int32) for t in raw(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.tobytes() for f in found], pa.binary())], names=["doc_id", "good", "f"])

    got = (
        docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "good", "text")
        .mapInArrow(tidied(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, good boolean, f binary")
        .collect()
    )
    got.sort(key=lambda r: (r["doc_id"], bytes(r["f"])))
    model = train([np.frombuffer(bytes(r["f"]), np.int32) for r in got], np.array([r["good"] for r in got], bool))
    del got
    give_back()
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted; no shuffle. A column of docs with such a name is replaced."""
    spark = docs.sparkSession
    held = Shared(spark, model)  # 2 MB, whatever the data
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")

    def run(batches):
        words, shapes, model = WordHash(), ShapeHash(), held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                s = np.array([model.score(features(t or b"", words, shapes)) for t in raw(part.column(at))], float)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[*part.schema.names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidied(run), f"{fields}, score double, predicted int")
