"""Toxicity by multiple-instance learning: document labels, sentence scores.

A document is a bag of sentences.  A sentence has a probability from a linear model
over its words; a document's is their noisy-or, one minus the chance that no sentence
offends.  Weights are learned from document labels alone, through the noisy-or.
Sentences with a probability of LOCATE or more are given back with their places.

The fit reads at most SAMPLE_ROWS labelled rows; words count that are in LEAST
different sentences, and in those of positive documents by CLEAR deviations more than
chance gives.  Every text is scored whole, sentence by sentence.

Rows: null and empty texts have no sentences and get the score of an empty bag; long
texts are many sentences; repeated rows get equal scores, each its own; a score of
exactly 0.5 is predicted as 1; a doc_id whose labels contradict each other is not
learned from, repeated equal labels count once, and of the texts of one labelled doc_id
the smallest by hash is read; without labels of both classes all scores are the share of
label 1 (0.5 without any); an empty table gives no rows; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, mixed, slices
from .features import SPACE, held_out, sample
from .quality import logistic

SAMPLE_ROWS = 8000
FOLD, HELD = 5, 0
LEAST, CLEAR, LOCATE = 5, 5.0, 0.5
STEPS, RATE, RIDGE, START = 160, 0.15, 2e-3, -6.0

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^\W\d_]+")


class Words:
    KEEP = 300_000

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> list[int]:
        known = self.known
        if len(known) > self.KEEP:
            known.clear()
        out = []
        for w in words:
            at = known.get(w)
            if at is None:
                at = known[w] = xxhash.xxh3_64_intdigest(w) & (SPACE - 1)
            out.append(at)
        return out


def words() -> Words:
    return kept(("toxicity",), Words)


def bag(text: str) -> tuple[list[list[int]], list[tuple[int, int]]]:
    """Features (places of distinct words) and span of each sentence that has words."""
    places, spans = [], []
    for m in SENTENCE.finditer(text):
        found = [w.lower() for w in WORD.findall(m[0])]
        if found:
            places.append(sorted(set(words().of(found))))
            spans.append(m.span())
    return places, spans


def _packed(text: str) -> bytes:
    places, _ = bag(text)
    return np.array([len(places), *map(len, places), *[x for p in places for x in p]], np.int32).tobytes()


class Model:
    def __init__(self, weight: np.ndarray, bias: float, curve: tuple[float, float], fixed: float | None = None):
        self.weight, self.bias, self.curve, self.fixed = weight.astype(np.float32), bias, curve, fixed

    def sentences(self, places: list[list[int]]) -> np.ndarray:
        if not places:
            return np.zeros(0)
        size = np.array([len(p) for p in places])
        each = self.weight[np.array([x for p in places for x in p], np.int64)].astype(np.float64)
        z = np.add.reduceat(each, np.cumsum(size) - size) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def document(self, p: np.ndarray) -> float:
        """Noisy-or, mapped by the curve that was fitted to its log odds."""
        if self.fixed is not None:
            return self.fixed
        z = self.curve[0] * odds(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()) + self.curve[1]
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def odds(none: float | np.ndarray):
    """Log odds of a noisy-or, given the log chance that no instance is positive."""
    none = np.minimum(none, -1e-9)
    return np.clip(np.log(-np.expm1(none)) - none, -20, 20)


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Gradient steps (with momentum and per-weight scale) on the likelihood of the document labels."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(SPACE), 0.0, (1.0, 0.0), 0.5 if not len(y) else share)
    full = [i for i, r in enumerate(rows) if r[0]]
    counts = [int(rows[i][0]) for i in full]
    sizes = np.concatenate([rows[i][1 : 1 + rows[i][0]] for i in full]).astype(np.int64)
    places = np.concatenate([rows[i][1 + rows[i][0] :] for i in full]).astype(np.int64)
    target = y[full].astype(np.float64)
    doc_of = np.repeat(np.arange(len(full)), counts)
    # in how many different sentences a word is, in both classes; copies of a document bring no new sentences
    sentence_of = np.repeat(np.arange(len(sizes)), sizes)
    cut = np.cumsum(sizes) - sizes
    _, different = np.unique(np.add.reduceat(mixed(places.astype(np.uint64) + np.uint64(1)), cut), return_index=True)
    counted = np.zeros(len(sizes), bool)
    counted[different] = True
    positive = target[doc_of] == 1
    hot = np.bincount(places[(counted & positive)[sentence_of]], minlength=SPACE)
    cold = np.bincount(places[(counted & ~positive)[sentence_of]], minlength=SPACE)
    # a word is evidence if positive documents have it clearly more often than chance gives
    base = float(np.clip((counted & positive).sum() / counted.sum(), 1e-3, 1 - 1e-3))
    hope = (hot + cold) * base
    used = (hot + cold >= LEAST) & (hot > hope) & ((hot - hope) ** 2 > CLEAR**2 * np.maximum(hope * (1 - base), 0.25))
    local = np.cumsum(used) - 1
    keep = used[places]
    at, sentence = local[places[keep]], sentence_of[keep]
    n = int(used.sum())
    w, b = np.zeros(n), START
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    weigh = np.where(target == 1, 0.5 / target.mean(), 0.5 / (1 - target.mean())) / len(full)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    for step in range(1, STEPS + 1):
        z = np.bincount(sentence, w[at], len(sizes)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), first)
        whole = np.clip(-np.expm1(none), 1e-9, 1)
        # d loss / d z of a sentence: p * (1 - label / noisy-or)
        g = (weigh * (1 - target / whole))[doc_of] * p
        grad = np.append(np.bincount(at, g[sentence], n) + RIDGE * w / len(full), g.sum())
        m += 0.1 * (grad - m)
        v += 0.01 * (grad**2 - v)
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:n]
        b = min(b - move[n], -2.0)
    weight = np.zeros(SPACE)
    weight[used] = w
    z = np.bincount(sentence, w[at], len(sizes)) + b
    none = np.add.reduceat(np.log1p(-np.minimum(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 - 1e-12)), first)
    return Model(weight, b, logistic(odds(none), target))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    made, y = sample(docs, labels, "toxic", FOLD, HELD, SAMPLE_ROWS, _packed)
    return fit([np.frombuffer(m, np.int32) for m in made], y)


OUT = "doc_id long, score double, n_sentences long, offending array<struct<start:long,end:long,score:double>>"


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, and the offending sentences with their places."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for doc, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    places, spans = bag(t or "")
                    p = shared.value.sentences(places)
                    rows.append((doc, shared.value.document(p), len(spans), [{"start": spans[i][0], "end": spans[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= LOCATE)]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "score", "n_sentences", "offending"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT)
    return out.select("doc_id", held_out(FOLD, HELD).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_sentences", "offending")
