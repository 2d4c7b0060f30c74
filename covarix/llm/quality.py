"""Quality scores from Bradley-Terry pairwise ranking.

Each document becomes a fixed vector of shape features of its whole text (byte
frequencies, word and line repetition, lengths). Scores are linear: the chance
that a good document beats a bad one is the logistic function of the difference
of their scores, so training is logistic loss on feature differences. The
threshold is the quantile of the training scores at the share of bad documents,
and a one-parameter slope turns scores into probabilities around it.

Training reads at most ``max_labels`` labelled rows (documented bound: 20,000,
by smallest hash); scoring reads every document.

Defined cases: null and empty texts have an all-zero vector and are scored like
any other; labels without a document, without a quality or with a null id are
not used; a document with both labels counts as one of each; of rows repeating a
labelled id the one of smallest hash counts; with no pair of different labels every score is the share of good
labels (0.5 without labels); repeated rows are scored each. Columns other than
``doc_id`` and ``text`` are never features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, slices, text_bytes

PRINTABLE = list(range(32, 127))
N_FEATURES = len(PRINTABLE) + 17


def features(body: bytes) -> np.ndarray:
    """The feature vector of a whole text."""
    out = np.zeros(N_FEATURES)
    if not body:
        return out
    n = len(body)
    freq = np.bincount(np.frombuffer(body, np.uint8), minlength=256) / n
    words, lines = body.split(), body.split(b"\n")
    k, nw, nl = len(PRINTABLE), max(1, len(words)), len(lines)
    out[:k] = np.sqrt(freq[PRINTABLE])
    lower, upper, digit = freq[97:123].sum(), freq[65:91].sum(), freq[48:58].sum()
    high, space = freq[128:].sum(), freq[[9, 10, 11, 12, 13, 32]].sum()
    same = sum(map(bytes.__eq__, words, words[1:])) / nw
    out[k:] = (
        np.log1p(n), np.log1p(nw), lower, upper, digit, high, space, 1 - lower - upper - digit - high - space,
        len(set(words)) / nw, (n - nl) / nw / 10, len(set(lines)) / nl, np.log1p(n / nl), same,
        sum(w[-1:] in b".!?" for w in words) / nw, sum(len(w) == 1 for w in words) / nw,
        sum(w[:1].isupper() for w in words) / nw, 1.0,
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = (x - self.mean) / self.scale @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (raw - self.threshold), -30, 30)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = 40_000, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Bradley-Terry weights by Newton steps on logistic loss of feature differences."""
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    share = len(good) / len(y) if len(y) else 0.5
    if not len(good) or not len(bad):
        even = np.clip(share, 0.01, 0.99)
        return Model(mean, scale, np.zeros(len(mean)), -float(np.log(even / (1 - even))), 1.0)
    rng, z = np.random.default_rng(seed), (x - mean) / scale
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / pairs + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    threshold = float(np.quantile(raw, 1 - share))
    slope = 1.0
    for _ in range(50):  # one-parameter logistic fit around the threshold
        p = 1 / (1 + np.exp(-np.clip(slope * (raw - threshold), -30, 30)))
        g = ((p - (y == 1)) * (raw - threshold)).mean()
        h = (p * (1 - p) * (raw - threshold) ** 2).mean() + 1e-6
        slope = float(np.clip(slope - np.clip(g / h, -1, 1), 0.05, 20))
    return Model(mean, scale, w, threshold, slope)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold kept from training: crc32 of the id as text leaves 1 modulo 3. Null ids are not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000) -> Model:
    """A model from the labelled documents outside the held-out fold."""
    use = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out())
    use = use.select("doc_id", F.col("quality").alias("_quality")).distinct().orderBy(F.xxhash64("doc_id", "_quality")).limit(max_labels)
    # at most max_labels pairs of numbers: safe to broadcast
    seen = docs.select("doc_id", text_bytes().alias("body")).join(F.broadcast(use), "doc_id")

    def vectors(batches):
        for b in (part for whole in batches for part in slices(whole)):
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "h", "x"])

    rows = seen.withColumn("h", F.xxhash64("body")).mapInArrow(vectors, "doc_id long, y int, h long, x array<double>")
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("x", "h").alias("x")).toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)
    y = rows.column("y").to_numpy()
    order = np.lexsort((x[:, 0], y, rows.column("doc_id").to_numpy())) if len(y) else slice(None)
    return fit_pairs(x[order], y[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(row, score)``: each row of ``docs`` as one struct, so that its columns may have any name, and its score from 0 to 1.

    Only the text goes to Python and only a number comes back.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(body: pd.Series) -> pd.Series:
        out = [shared.value.scores(np.array([features(t) for t in body.iloc[at : at + 1000]])) for at in range(0, len(body), 1000)]
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")

    row = F.struct(*columns_of(docs))
    return docs.select(row.alias("row"), of(text_bytes()).alias("score"))


def quality_report(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000) -> DataFrame:
    model = train(docs, labels, max_labels)
    narrow = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches):
        for b in (part for whole in batches for part in slices(whole)):
            x = np.array([features(t) for t in b.column(2).to_pylist()]).reshape(-1, N_FEATURES)
            s = shared.value.scores(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype("int32"))], names=["doc_id", "held_out", "score", "predicted"])

    return narrow.select("doc_id", held_out().alias("held_out"), text_bytes().alias("body")).mapInArrow(add, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000) -> DataFrame:
    """``docs`` without those that the classifier rejects; its own columns stay as they are, whatever their names."""
    return score(docs, train(docs, labels, max_labels)).where("score >= 0.5").select("row.*")
