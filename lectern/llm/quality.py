"""Quality scores from naive-Bayes support vectors.

Indicators of n-grams are scaled by the log ratio of their counts in the two classes
(scaled vectors have length 1), then a linear model is fitted by dual coordinate
descent on the hinge loss.  A logistic curve fitted to the margins gives scores.

The fit reads at most SAMPLE_ROWS labelled rows; every text is scored whole.

Rows: null and empty texts have no features and get the score of the bias; texts of
any length are one vector; repeated rows get equal scores, each its own; a score of
exactly 0.5 is predicted as 1; a doc_id whose labels contradict each other is not
learned from, repeated equal labels count once, and of the texts of one labelled doc_id
the smallest by hash is read; without labels of both classes the score is the share of
label 1 (0.5 without any); an empty table gives no rows; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, kept, slices
from .features import SPACE, NGrams, held_out, sample

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 8000
SMOOTH, COST, EPOCHS, LEAST_DOCS = 1.0, 1.0, 12, 3
FOLD, HELD = 3, 1


class Model:
    """weights (already times the log ratio), scale, bias and the logistic curve."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, curve: tuple[float, float]):
        self.square, self.weight, self.bias, self.curve = (ratio**2).astype(np.float32), (ratio * weight).astype(np.float32), bias, curve

    def margin(self, at: np.ndarray) -> float:
        size = float(np.sqrt(self.square[at].sum(dtype=np.float64)))
        return (float(self.weight[at].sum(dtype=np.float64)) / size if size else 0.0) + self.bias

    def score(self, at: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] * self.margin(at) + self.curve[1], -40, 40))))


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    zero = np.zeros(SPACE)
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
    if not 0 < share < 1 or len(set(y.tolist())) < 2:
        return Model(zero, zero, 0.0, (0.0, float(np.log(share / (1 - share)))))
    counts = [sum((np.bincount(r, minlength=SPACE) for r, t in zip(rows, y, strict=True) if t == c), zero.astype(np.int64)) for c in (0, 1)]
    q, p = counts[0] + SMOOTH, counts[1] + SMOOTH
    ratio = np.log((p / (SMOOTH + (y == 1).sum())) / (q / (SMOOTH + (y == 0).sum())))
    ratio[counts[0] + counts[1] < LEAST_DOCS] = 0
    ratio = np.clip(ratio, -8, 8)
    # scaled rows with a constant feature at the end
    vectors = []
    for r in rows:
        v = ratio[r]
        size = np.sqrt((v**2).sum())
        keep = v != 0
        vectors.append((r[keep], v[keep] / size if size else v[keep]))
    sign = np.where(y == 1, 1.0, -1.0)
    # both classes weigh the same in all
    cost = np.where(y == 1, COST * 0.5 / share, COST * 0.5 / (1 - share))
    square = np.array([v @ v for _, v in vectors]) + 1.0
    alpha, w, bias = np.zeros(len(rows)), np.zeros(SPACE), 0.0
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, v = vectors[i]
            g = sign[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                w[at] += step * v
                bias += step
    margin = np.array([w[at] @ v for at, v in vectors]) + bias
    return Model(ratio, w, bias, logistic(margin, y))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the likeliest logistic curve, by Newton steps with a slight ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        s = np.maximum(p * (1 - p), 1e-9)
        ga, gb = ((p - y) * x).sum() + 1e-3 * a, (p - y).sum()
        haa, hab, hbb = (s * x * x).sum() + 1e-3, (s * x).sum(), s.sum() + 1e-9
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 5.0 / (abs(da) + abs(db) + 1e-12))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def grams() -> NGrams:
    return kept(("quality",), NGrams)


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    made, y = sample(docs, labels, "quality", FOLD, HELD, SAMPLE_ROWS, lambda t: grams().of(t).tobytes())
    return fit([np.frombuffer(m, np.int32) for m in made], y)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                scores = [shared.value.score(grams().of(t or "")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(FOLD, HELD).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def good_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, columns as they were, with a score of 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    return docs.mapInArrow(filtered(lambda t: shared.value.score(grams().of(t)) >= 0.5), docs.schema)
