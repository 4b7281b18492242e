"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a linear scorer that minimises the
non-negative unbiased risk: ``prior * E_p[loss(f)] + max(0, E_u[loss(-f)] - prior *
E_p[loss(-f)])``; while the second part is negative, its gradient step is reversed.
The class prior is estimated from the same two samples: a first scorer tells positives
from unlabelled text, and the prior is the least ratio, over thresholds, of the share
of unlabelled texts above the threshold to that of positives it was not fitted on,
with a confidence margin.

Features come from whole texts only: byte shares, and binned measures of repetition,
case, punctuation, word and line shape.

Defined cases: a null text counts as empty; an empty text has all-zero measures and a
score like any other; a document labelled twice is a trusted positive only if every
label is 1; without any positive, every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BINS = 12
#: Measures and the range their bins cover.
_MEASURES = {
    "words": (0.0, 10.0),  # natural log
    "distinct": (0.0, 1.0),
    "top": (0.0, 0.5),
    "pairs": (0.0, 1.0),
    "length": (0.0, 16.0),
    "upper": (0.0, 1.0),
    "letters": (0.4, 1.0),
    "marks": (0.0, 0.4),
    "digits": (0.0, 0.3),
    "lines": (0.0, 1.0),
    "ends": (0.0, 0.5),
    "runs": (0.0, 0.4),
}
WIDTH = 256 + len(_MEASURES) * _BINS

_KIND = np.zeros(256, dtype=np.int8)  # 1 lower, 2 upper, 3 digit, 4 space, 5 mark, 6 other letters
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[128:] = 6
_KIND[(_KIND == 0)] = 5


@dataclass(frozen=True)
class QualityParams:
    """``positives`` and ``unlabelled`` bound the two training samples, in documents."""

    positives: int = 6_000
    unlabelled: int = 12_000
    steps: int = 400
    rate: float = 0.02
    decay: float = 1e-4
    accept: float = 0.7
    seed: int = 5


def measures(text: str) -> np.ndarray:
    """Feature vector of one whole text."""
    out = np.zeros(WIDTH, dtype=np.float32)
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    if not len(data):
        return out
    counts = np.bincount(data, minlength=256)
    out[:256] = np.sqrt(counts / len(data))
    kinds = np.bincount(_KIND, weights=counts, minlength=7)
    letters = kinds[1] + kinds[2] + kinds[6]
    solid = max(1.0, len(data) - kinds[4])
    words = text.split()
    n = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x]
    pairs = len(set(zip(words, words[1:], strict=False)))
    kept = np.count_nonzero(data[1:] == data[:-1])
    values = (
        np.log(n),
        len(seen) / n,
        max(seen.values(), default=0) / n,
        pairs / max(1, n - 1),
        solid / n,
        kinds[2] / max(1.0, letters),
        letters / solid,
        kinds[5] / solid,
        kinds[3] / solid,
        len(set(lines)) / max(1, len(lines)),
        sum(w[-1] in ".!?" for w in words) / n,
        kept / len(data),
    )
    for i, ((low, high), v) in enumerate(zip(_MEASURES.values(), values, strict=True)):
        # A thermometer: every bin edge below the value is on.
        edges = int(min(_BINS, max(0.0, (v - low) / (high - low) * _BINS)))
        out[256 + i * _BINS : 256 + i * _BINS + edges] = 1.0
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    mean: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid((x - self.mean) @ self.weights + self.bias)


def _descend(x_p, x_u, prior, params: QualityParams, plain: bool = False):
    """Adam on the non-negative risk, or (``plain``) on positives against unlabelled."""
    d = x_p.shape[1]
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, params.steps + 1):
        p_p, p_u = _sigmoid(x_p @ w[:d] + w[d]), _sigmoid(x_u @ w[:d] + w[d])

        def grad(x, r):
            return np.append(x.T @ r, r.sum()) / len(x)

        if plain:
            g = grad(x_p, p_p - 1) + grad(x_u, p_u)
        else:
            risk = -np.log(1 - p_u + 1e-9).mean() + prior * np.log(1 - p_p + 1e-9).mean()
            g_neg = grad(x_u, p_u) - prior * grad(x_p, p_p)
            g = prior * grad(x_p, p_p - 1) + g_neg if risk >= 0 else -g_neg
        g[:d] += params.decay * w[:d]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= params.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:d], float(w[d])


def class_prior(held_p: np.ndarray, held_u: np.ndarray) -> float:
    """Least ratio of tail shares of unlabelled to positive scores, with a margin."""
    cuts = np.unique(held_p)
    q_p = 1 - np.searchsorted(np.sort(held_p), cuts) / len(held_p)
    q_u = 1 - np.searchsorted(np.sort(held_u), cuts) / len(held_u)
    slack = np.sqrt(np.log(40) / 2) * (len(held_u) ** -0.5 + len(held_p) ** -0.5)
    best = np.argmin((q_u + slack) / q_p)
    return float(np.clip(q_u[best] / q_p[best], 0.02, 0.98))


def train(x_p: np.ndarray, x_u: np.ndarray, params: QualityParams) -> QualityModel:
    """Fit on feature rows of trusted positives and of unlabelled texts."""
    if not len(x_p) or not len(x_u):
        return QualityModel(np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 0.5)
    x_p, x_u = x_p.astype(np.float64), x_u.astype(np.float64)
    mean = x_u.mean(axis=0)
    x_p, x_u = x_p - mean, x_u - mean
    rng = np.random.default_rng(params.seed)
    p_half, u_half = rng.random(len(x_p)) < 0.5, rng.random(len(x_u)) < 0.5
    prior = 0.5
    if min(p_half.sum(), (~p_half).sum(), u_half.sum(), (~u_half).sum()) >= 20:
        w, b = _descend(x_p[p_half], x_u[u_half], 0.5, params, plain=True)
        prior = class_prior(x_p[~p_half] @ w + b, x_u[~u_half] @ w + b)
    w, b = _descend(x_p, x_u, prior, params)
    return QualityModel(w, mean, b, prior)


def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = b[["positive"]].copy()
        out["x"] = [measures(t or "").tobytes() for t in b["text"]]
        yield out


def fit_quality(
    docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()
) -> QualityModel:
    """Learn from ``docs`` (doc_id, text): positives have label 1, all are unlabelled text.

    ``labels`` (doc_id, quality) may hold the labels of fewer documents.  Both samples
    are bounded by ``params`` and chosen by a hash of the id.
    """
    ids = docs.select("doc_id").where("doc_id is not null")
    order = F.xxhash64(F.lit(params.seed), "doc_id")
    trusted = (
        labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    )
    some_p = trusted.join(ids, "doc_id", "left_semi").orderBy(order, "doc_id").limit(params.positives)
    other = F.xxhash64(F.lit(params.seed + 1), "doc_id")
    some_u = ids.orderBy(other, "doc_id").limit(params.unlabelled)
    chosen = some_p.withColumn("positive", F.lit(True)).unionByName(
        some_u.withColumn("positive", F.lit(False))
    )
    # At most the two bounds together, so it may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = (
        rows.select("positive", "text")
        .mapInPandas(_feature_rows, "positive boolean, x binary")
        .toPandas()
    )
    x = np.frombuffer(b"".join(got["x"]), dtype=np.float32).reshape(-1, WIDTH)
    positive = got["positive"].to_numpy(dtype=bool)
    order = np.lexsort([*x[:, :40].T, positive])  # the order of rows is not that of tasks
    x, positive = x[order], positive[order]
    return train(x[positive], x[~positive], params)


def score_quality(docs: DataFrame, model: QualityModel, accept: float) -> DataFrame:
    """``docs`` (any columns besides ``text`` pass through) with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]

    @F.pandas_udf("double")
    def quality_score(texts: pd.Series) -> pd.Series:
        m = shared.value
        rows = np.array([measures(t or "") for t in texts], dtype=np.float32)
        return pd.Series(m.score(rows.reshape(-1, WIDTH)))

    scored = docs.select(*kept, quality_score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))
