"""Document quality by Bradley-Terry ranking of preference pairs.

A labelled good document is preferred to a labelled bad one. The chance that one is preferred is
the logistic function of the difference of their scores, and a score is linear in features of the
text, so fitting is logistic regression on feature differences. A quantile of the training scores
is the threshold between accepted and rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import small_batches

#: At most so many labelled documents are used to fit, the first by the hash of their id.
LABELLED_ROWS = 20_000
PAIRS_PER_DOCUMENT = 8
ACCEPT_AT = 0.3
_RIDGE = 1e-2
_STEPS = 25

_BYTE_CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" ",
    b"\n\r",
    b".,;:?",
    b"!",
    b"|\t",
    b"#$%&*@^~+=<>",
    b"'\"()[]{}-_/\\`",
    bytes(range(128, 256)),
    bytes(b for b in range(32) if b not in b"\t\n\r"),
]
_CLASS_OF = np.zeros((256, len(_BYTE_CLASSES)))
for _i, _bytes in enumerate(_BYTE_CLASSES):
    _CLASS_OF[list(_bytes), _i] = 1
N_FEATURES = len(_BYTE_CLASSES) + 14


def features(text: str | None) -> np.ndarray:
    """Shares of byte classes, and lengths and repetition of words and lines; finite for any text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    shares = np.bincount(raw, minlength=256) @ _CLASS_OF / max(1, len(raw))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    lengths = np.array([len(w) for w in words] or [0])
    distinct, pairs = set(words), list(zip(words, words[1:]))
    bare = [w for w in words if not w[-1].isalnum()]
    return np.concatenate(
        (
            shares,
            [
                np.log1p(len(words)),
                lengths.mean(),
                lengths.std(),
                np.log1p(lengths.max()),
                len(distinct) / n,
                len(distinct) / np.sqrt(n),
                len(set(pairs)) / max(1, len(pairs)),
                len(set(lines)) / max(1, len(lines)),
                np.log1p(len(words) / max(1, len(lines))),
                len(bare) / n,
                sum(w.isupper() for w in words) / n,
                sum(w.islower() for w in words) / n,
                sum(w.isalpha() for w in words) / n,
                np.log1p(len(set(bare))) / np.log1p(n),
            ],
        )
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(text: pd.Series) -> pd.Series:
    return text.map(lambda t: features(t).tolist())


@dataclass(frozen=True)
class Ranker:
    """score = logistic(slope * (w . z - threshold) + logit(accept_at)), z the scaled features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float
    accept_at: float = ACCEPT_AT

    def latent(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.latent(x) - self.threshold)
        z += np.log(self.accept_at / (1 - self.accept_at))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _newton(x: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of the logistic loss mean(log(1 + exp(-x . w))) + ridge/2 |w|^2."""
    w = np.zeros(x.shape[1])
    for _ in range(_STEPS):
        p = 1 / (1 + np.exp(np.clip(x @ w, -35, 35)))
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w)),
            x.T @ p / len(x) - ridge * w,
        )
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_pairs(x: np.ndarray, good: np.ndarray, accept_at: float = ACCEPT_AT) -> Ranker:
    """Fits the ranker to feature rows ``x`` of which ``good`` are preferred to the others.

    Each document of the larger class meets PAIRS_PER_DOCUMENT of the other, dealt round in a
    fixed shuffle. Without both classes nothing can be preferred: every score is then ``accept_at``
    and nothing is rejected.
    """
    high, low = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(high) or not len(low):
        n = N_FEATURES
        return Ranker(np.zeros(n), np.ones(n), np.zeros(n), 0.0, 0.0, accept_at)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(17)
    n = PAIRS_PER_DOCUMENT * max(len(high), len(low))
    deal = lambda side: rng.permutation(np.resize(rng.permutation(side), n))
    weights = _newton(z[deal(high)] - z[deal(low)], _RIDGE)
    latent = z @ weights
    # Of the quantiles of the training scores the threshold is the one that loses least, errors
    # on either class weighing the same; within the widest gap of equals, the middle.
    order = np.argsort(latent, kind="stable")
    lost = np.concatenate(([0], np.cumsum(good[order]))) / len(high)
    passed = 1 - np.concatenate(([0], np.cumsum(~good[order]))) / len(low)
    cuts = np.concatenate(([latent[order[0]] - 1], latent[order], [latent[order[-1]] + 1]))
    error = lost + passed
    best = np.flatnonzero(error <= error.min() + 1e-12)
    at = best[np.argmax(cuts[best + 1] - cuts[best])]
    threshold = (cuts[at] + cuts[at + 1]) / 2
    spread = latent[good].mean() - latent[~good].mean()
    return Ranker(mean, scale, weights, float(threshold), float(6 / max(spread, 1e-6)), accept_at)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rows: int = LABELLED_ROWS,
) -> Ranker:
    """Fits the ranker on ``labels`` (id, label 0 or 1) of ``docs``.

    At most ``rows`` labelled ids are used, the first by the hash of the id, so the driver gets
    that many short feature arrays however large the tables are. Null ids and labels are passed
    over; an id labelled both ways counts as good and as bad; null text counts as empty.
    """
    small_batches(docs.sparkSession)
    wanted = (
        labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__good"))
        .where("__id IS NOT NULL AND __good IS NOT NULL")
        .orderBy(F.xxhash64("__id"), "__id", "__good")
        .limit(rows)
    )
    # Bounded by ``rows``, so it may be broadcast.
    labelled = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).join(
        F.broadcast(wanted), "__id"
    )
    found = (
        labelled.select("__id", "__good", _features("__text").alias("x"))
        .orderBy(F.xxhash64("__id"), "__id", "__good", "x")
        .limit(rows)
        .toPandas()
    )
    if found.empty:
        return fit_pairs(np.zeros((0, N_FEATURES)), np.zeros(0, dtype=bool))
    return fit_pairs(np.array(found["x"].tolist()), found["__good"].to_numpy() > 0)


def score(text: Column, ranker: Ranker) -> Column:
    """Score column of a text column; null counts as empty."""

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        if texts.empty:
            return pd.Series([], dtype="float64")
        return pd.Series(ranker.scores(np.array([features(t) for t in texts])))

    return scored(text)


def held_out(ident: Column, folds: int = 5) -> Column:
    """Whether an id is kept from fitting: crc32 of the id as text divides by ``folds``."""
    return F.crc32(ident.cast("string").cast("binary")) % folds == 0


def train_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels to learn from."""
    return labels.where(~held_out(F.col(id_col)))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """id, held_out, score, predicted for each row of ``docs``, fitted on the labels not held out.
    A null id is not held out."""
    ranker = fit(docs, train_labels(labels, id_col), id_col, text)
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col),
        F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"),
        score(F.col(text), ranker).alias("score"),
    ).withColumn("predicted", (F.col("score") >= ranker.accept_at).cast("int"))


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that are not rejected, columns as they are."""
    ranker = fit(docs, train_labels(labels, id_col), id_col, text)
    small_batches(docs.sparkSession)
    return docs.where(score(F.col(text), ranker) >= ranker.accept_at)
