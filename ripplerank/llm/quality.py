"""Quality classifier: Naive Bayes support vectors (NBSVM)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import WIDTH, Features, fitted, looks, scored

#: Labelled rows of the sample, least documents of a feature, smoothing of the counts, C of the hinge loss, passes of the coordinate descent, folds of the calibration, share of the mean weight.
ROWS, LEAST, SMOOTH, C, PASSES, FOLDS, MEAN = 12_000, 3, 1.0, 1.0, 12, 5, 0.25
#: Scores from here on are predicted 1.
CUT = 0.3


@dataclass
class Model:
    """Score: 1 / (1 + exp(-(a * margin + b))), margin = bias + sum of weights of the features that are set / sqrt(their number)."""

    weights: np.ndarray
    bias: float
    a: float
    b: float


def features() -> Features:
    """Words, their shapes and endings, word bigrams and bigrams of shapes."""
    return Features(looks, pairs=(0, 1))


def ratios(x: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Class log-count ratios r of the indicators, smoothed; 0 for features of fewer than LEAST documents."""
    neg, pos = np.zeros(WIDTH), np.zeros(WIDTH)
    for v, t in zip(x, y, strict=True):  # a document's features are distinct
        (pos if t else neg)[v] += 1
    p, q = pos + SMOOTH, neg + SMOOTH
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    r[pos + neg < LEAST] = 0
    return r


def dual_descent(x: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float = C, passes: int = PASSES, seed: int = 42) -> tuple[np.ndarray, float]:
    """Linear hinge-loss weights by dual coordinate descent: one multiplier a document in [0, c], each set to its optimum in turn. Rows are r * indicator / sqrt(number), and a constant 1."""
    w, bias = np.zeros(WIDTH), 0.0
    scale = [1 / np.sqrt(max(len(v), 1)) for v in x]
    norm = np.array([s * s * float(np.sum(r[v] ** 2)) + 1.0 for v, s in zip(x, scale, strict=True)])
    alpha, sign = np.zeros(len(x)), np.where(y == 1, 1.0, -1.0)
    # classes weigh alike, so that the rarer one counts
    upper = np.where(y == 1, c * len(y) / max(2 * (y == 1).sum(), 1), c * len(y) / max(2 * (y == 0).sum(), 1))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(x)).tolist():
            row = r[x[i]] * scale[i]  # worked out anew: all rows at once would be the largest thing on the driver
            g = sign[i] * (w[x[i]] @ row + bias) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), upper[i])
            if step := new - alpha[i]:
                w[x[i]] += step * sign[i] * row
                bias += step * sign[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    # NBSVM's blend: between the trained weights and their mean size, so that the Naive Bayes ratios alone still tell.
    used = r != 0
    w[used] = (1 - MEAN) * w[used] + MEAN * np.abs(w[used]).mean() if used.any() else 0.0
    return w * r, bias


def _margins(x: list[np.ndarray], w: np.ndarray, bias: float) -> np.ndarray:
    return np.array([w[v].sum() / np.sqrt(max(len(v), 1)) + bias for v in x])


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins of held-out folds, by Newton steps on smoothed labels."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z = np.stack((margin, np.ones_like(margin)), axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ at, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (p - t) + 1e-3 * at)
        at -= step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(at[0]), 1e-3), float(at[1])


def fit(x: list[np.ndarray], y: np.ndarray) -> Model:
    if len(set(y.tolist())) < 2:  # one class or none: its share, smoothed, for every text
        p = (y.sum() + 1.0) / (len(y) + 2.0)
        return Model(np.zeros(WIDTH), 0.0, 1.0, float(np.log(p / (1 - p))))
    out = np.zeros(len(y))
    fold = np.arange(len(y)) % FOLDS
    for k in range(FOLDS):
        own = np.flatnonzero(fold != k)
        rest = np.flatnonzero(fold == k)
        if len(set(y[own].tolist())) == 2:
            part, r = [x[i] for i in own], ratios([x[i] for i in own], y[own])
            out[rest] = _margins([x[i] for i in rest], *dual_descent(part, y[own], r, passes=4))
    r = ratios(x, y)
    w, bias = dual_descent(x, y, r)
    return Model(w, bias, *calibrate(out, y))


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = ROWS, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: quality 1 likelier) and predicted for every row of docs, by its whole text.

    Fitted on about `rows` labelled documents at most (a bounded sample by hashed doc_id) whose crc32(doc_id as text) mod 5 is not 0; only texts are inputs. Null and
    empty texts have no features and get the score of the bias; a null doc_id is not held out and scores by its text; repeated rows score alike; without usable
    labels every score is 0.5; an empty table gives no rows; other columns are ignored.
    """
    held = lambda c: F.crc32(c.cast("string").cast("binary")) % 5 == 0
    m = fitted(docs, labels, "quality", features, rows, fit, ~held(F.col("doc_id")))

    def finish(total: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        s = 1 / (1 + np.exp(-np.clip(m.a * (total / np.sqrt(np.maximum(n, 1)) + m.bias) + m.b, -30, 30)))
        return [s, (s >= cut).astype(np.int32)]

    out = scored(docs, features, m.weights, "score double, predicted int", finish)
    return out.select("doc_id", F.coalesce(held(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
