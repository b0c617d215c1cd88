"""Quality by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are documents labelled 1 in the training folds; the unlabelled set is web text of any kind, labels unseen. A small
network over style features minimises  p * R_P(+) + max(0, R_U(-) - p * R_P(-))  with the logistic loss. The class prior p is estimated
from the data: over thresholds of a first classifier, the least ratio of unlabelled to positive documents above it (with an allowance for
the sample's error), on halves that the classifier did not see; it is then trained again with that prior.

Only the fit uses the driver: feature rows of a sample of about POSITIVE + UNLABELLED documents, whatever the size of the input. Features
and scores of whole texts are one narrow pass.

Defined results: a null text is an empty one, and empty texts have a score like any other; labels repeated for an id count as 1 if one
does; without positive or without unlabelled documents every score is 0.5; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm.common import fold, labelled, sampled, table

#: Documents of the fitting sample (by hash of the id, about so many of each kind).
POSITIVE, UNLABELLED = 6_000, 12_000
CHUNK = 64
HIDDEN, STEPS, RATE, DECAY = 16, 400, 0.02, 1e-3
PREDICT = 0.3
SYMBOLS = "#*$%&|<>"


def features(text: str | None) -> np.ndarray:
    """Style of a whole text: rates over the text and over its most unusual chunk of CHUNK words."""
    text = text or ""
    words = text.split()
    n, size = len(words), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode()

    def rates(part: str, own: list[str]) -> list[float]:
        m = max(1, len(own))
        letters = sum(map(len, own)) or 1
        return [
            sum(map(part.count, SYMBOLS)) / letters,
            sum(part.count(x) for x in ".,;:!?") / letters,
            sum(x != x.lower() for x in own) / m,
            sum(x.isupper() for x in own) / m,
            1 - len(set(own)) / m,
            sum(map(str.__eq__, own, own[1:])) / m,
            sum(not x[0].isalnum() or not x[-1].isalpha() for x in own) / m,
        ]

    whole = rates(text, words)
    chunks = [words[i : i + CHUNK] for i in range(0, max(1, n - CHUNK // 2), CHUNK)]
    worst = np.max([rates(" ".join(c), c) for c in chunks], axis=0) if n else np.zeros(len(whole))
    most = Counter(words).most_common(1)[0][1] / n if n else 0.0
    return np.array([
        *whole, *worst, most, np.log1p(n), np.log1p(n) ** 2 / 10, size / max(1, n) / 10, 1 - len(set(lines)) / max(1, len(lines)), len(lines) / max(1, n),
        len(zlib.compress(raw, 1)) / max(16, len(raw)), sum(x.isdigit() for x in words) / max(1, n), float(n == 0),
    ])


def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(x).tolist() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["kind", "x"])


def forward(weights: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ weights[0] + weights[1])
    return hidden, hidden @ weights[2] + weights[3]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 7) -> list[np.ndarray]:
    """Weights that minimise the non-negative risk by full-batch Adam; where the negative part is below zero, its ascent is followed alone."""
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 1 / np.sqrt(positive.shape[1]), (positive.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        grads = [DECAY * w for w in weights]
        (hp, zp), (hu, zu) = forward(weights, positive), forward(weights, unlabelled)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        sp, su = sigmoid(zp), sigmoid(zu)
        if negative >= 0:
            dp, du = (prior * (sp - 1) - prior * sp) / len(zp), su / len(zu)
        else:
            dp, du = prior * sp / len(zp), -su / len(zu)
        for x, h, d in ((positive, hp, dp), (unlabelled, hu, du)):
            inner = np.outer(d, weights[2]) * (1 - h * h)
            for g, more in zip(grads, (x.T @ inner, inner.sum(0), h.T @ d, d.sum(keepdims=True)), strict=True):
                g += more
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of documents that did not train."""
    at = np.unique(np.quantile(positive, np.linspace(0, 0.99, 100)))
    p = (positive[:, None] >= at).mean(0)
    u = (unlabelled[:, None] >= at).mean(0)
    error = np.sqrt(np.log(200) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin(u / p + error / p)
    return float(np.clip(u[best] / p[best], 0.05, 0.97))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], float] | None:
    """Means, scales, weights and the class prior; None without either kind."""
    if not len(positive) or not len(unlabelled):
        return None
    everything = np.concatenate([positive, unlabelled])
    mean, scale = everything.mean(0), everything.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -5, 5) for x in (positive, unlabelled))
    prior = 0.5
    for _ in range(2):
        weights = train(p[::2], u[::2], prior)
        prior = estimated_prior(forward(weights, p[1::2])[1], forward(weights, u[1::2])[1]) if len(p) > 1 and len(u) > 1 else prior
    return mean, scale, train(p, u, prior), prior


def trained(docs: DataFrame, labels: DataFrame):
    """The model of the training folds' positives and of unlabelled documents."""
    own = docs.select("doc_id", "text")
    positive = sampled(own, labelled(labels, "quality"), fold(F.col("doc_id"), 5) != 0, {1: POSITIVE}).select(F.lit(1).alias("kind"), "text", "doc_id")
    rows = own.count()
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("web")), F.lit(1 << 40))
    unlabelled = own.where(place < int((1 << 40) * min(1.0, UNLABELLED / max(1, rows)))).select(F.lit(0).alias("kind"), "text", "doc_id")
    found = {}
    for kind, few in ((1, positive), (0, unlabelled)):
        got = few.select("doc_id", "text").mapInArrow(feature_rows, "kind long, x array<double>").toPandas().sort_values("kind", kind="stable")
        found[kind] = np.array(sorted(got["x"].map(tuple).tolist())) if len(got) else np.zeros((0, 0))
        found[kind] = found[kind][np.random.default_rng(1).permutation(len(found[kind]))]
    return fit(found[1], found[0])


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score of each row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(batch.num_rows, 0.5)
            if shared.value is not None and batch.num_rows:
                mean, scale, weights, _ = shared.value
                x = np.array([features(t) for t in batch.column(1).to_pylist()])
                scores = sigmoid(forward(weights, np.clip((x - mean) / scale, -5, 5))[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = score(docs, trained(docs, table(spark, sf_dir, "labels")))
    predicted = F.when(F.col("score") >= PREDICT, 1).otherwise(0).cast("int")
    return scores.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", predicted.alias("predicted"))
