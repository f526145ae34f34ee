"""Toxicity: cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import WIDTH, Features, fitted, flagged, scored, sparse, stems

#: Labelled rows of the sample, features that are kept, least documents of a feature, least z of its log-odds, grades above 0, steps of the fit, L2 penalty.
ROWS, KEEP, LEAST, Z, GRADES, STEPS, PENALTY = 12_000, 4_096, 4, 2.5, 3, 1_500, 1e-4
#: Folds that choose the rejection point inside the sample, the share of other rows that it may reject there, and the probabilities between which it lies.
FOLDS, FALSE, LOWEST, HIGHEST = 3, 0.001, 0.05, 0.5


@dataclass
class Model:
    """P(grade > k) = 1 / (1 + exp(cuts[k] - sum of the weights of the features that are set)): one weight vector, ordered cuts."""

    weights: np.ndarray
    cuts: np.ndarray

    def above(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - total[:, None], -40, 40)))


def features() -> Features:
    return Features(stems)


def unlike(x: list[np.ndarray], tables: int = 4) -> list[int]:
    """Rows of which none before is a copy or near copy, by pairs of min-hashes: else the rare words of one copied document would look like signs of its class."""
    seen: list[set[tuple[int, int]]] = [set() for _ in range(tables)]
    out = []
    odd = np.random.default_rng(42).integers(1, 1 << 62, 2 * tables, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for i, v in enumerate(x):
        h = ((v.astype(np.uint64) + np.uint64(1))[:, None] * odd[None, :] >> np.uint64(20)).min(0).tolist() if len(v) else [0] * (2 * tables)
        keys = [(h[2 * t], h[2 * t + 1]) for t in range(tables)]
        if not any(k in s for k, s in zip(keys, seen, strict=True)):
            out.append(i)
        for k, s in zip(keys, seen, strict=True):
            s.add(k)
    return out


def telling(x: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The features whose log-odds between the classes lie Z standard errors from 0, the KEEP furthest ones: the sparse input of the regression."""
    row, col = sparse(x)
    a = np.bincount(col[y[row] == 1], minlength=WIDTH) + 0.5
    b = np.bincount(col[y[row] == 0], minlength=WIDTH) + 0.5
    n1, n0 = (y == 1).sum() + 1.0, (y == 0).sum() + 1.0
    odds = np.log(a / (n1 - a + 0.5)) - np.log(b / (n0 - b + 0.5))
    z = odds / np.sqrt(1 / a + 1 / b + 1 / (n1 - a + 0.5) + 1 / (n0 - b + 0.5))
    z[a + b < LEAST + 1] = 0
    at = np.flatnonzero(z > Z)
    return np.sort(at[np.argsort(-z[at], kind="stable")[:KEEP]])


def grades(x: list[np.ndarray], y: np.ndarray, kept: np.ndarray, count: int = GRADES) -> np.ndarray:
    """Severity of the labelled rows: 0 if not toxic; else 1 to `count`, by equal parts of the toxic rows in order of their share of telling features."""
    is_kept = np.zeros(WIDTH, bool)
    is_kept[kept] = True
    share = np.array([is_kept[v].sum() / max(len(v), 1) for v in x])
    out, toxic = np.zeros(len(y), int), np.flatnonzero(y == 1)
    order = toxic[np.argsort(share[toxic], kind="stable")]
    out[order] = 1 + np.arange(len(order)) * count // max(len(order), 1)
    return out


def fit(x: list[np.ndarray], y: np.ndarray, count: int = GRADES) -> Model:
    """Maximum likelihood with an L2 penalty by gradient steps with momentum and per-weight scale; cuts are a first one and positive gaps."""
    weights = np.zeros(WIDTH)
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 1.0) / (len(y) + 2.0)
        return Model(weights, np.log(1 / p - 1) + np.arange(count) * 1.0)
    kept = telling(x, y)
    g = grades(x, y, kept, count)
    place = np.full(WIDTH, -1)
    place[kept] = np.arange(len(kept))
    row, col = sparse(x)
    col = place[col]
    row, col = row[col >= 0], col[col >= 0]
    w, first, gaps = np.zeros(len(kept)), 2.0, np.zeros(count - 1)
    m, v, n = np.zeros(len(kept) + count), np.zeros(len(kept) + count), len(y)
    for step in range(1, STEPS + 1):
        eta = np.bincount(row, w[col], n) if len(row) else np.zeros(n)
        cuts = first + np.r_[0.0, np.cumsum(np.exp(gaps))]
        s = 1 / (1 + np.exp(np.clip(cuts[None, :] - eta[:, None], -40, 40)))  # P(grade > k)
        full = np.concatenate((np.ones((n, 1)), s, np.zeros((n, 1))), axis=1)
        up, down = full[np.arange(n), g], full[np.arange(n), g + 1]  # P(grade >= g), P(grade > g)
        p = np.maximum(up - down, 1e-12)
        d_up, d_down = np.where(g > 0, up * (1 - up), 0) / p, np.where(g < count, down * (1 - down), 0) / p
        d_eta = -(d_up - d_down) / n
        d_cut = np.array([(d_up[g == k + 1].sum() - d_down[g == k].sum()) / n for k in range(count)])
        tail = np.cumsum(d_cut[::-1])[::-1]
        grad = np.concatenate((np.bincount(col, d_eta[row], len(kept)) + PENALTY * w if len(row) else PENALTY * w, tail[:1], tail[1:] * np.exp(gaps)))
        m, v = 0.9 * m + 0.1 * grad, 0.95 * v + 0.05 * grad**2
        move = 0.1 * (1 - step / (STEPS + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.95**step)) + 1e-8)
        w, first, gaps = w - move[: len(kept)], first - move[len(kept)], gaps - move[len(kept) + 1 :]
    weights[kept] = w
    return Model(weights, first + np.r_[0.0, np.cumsum(np.exp(gaps))])


def choose_cut(x: list[np.ndarray], y: np.ndarray, folds: int = FOLDS) -> float:
    """The lowest probability of a grade above 0 at which at most FALSE of the other rows of the sample are rejected by models that did not see them; no label outside the sample counts.

    Between LOWEST and HIGHEST; above 1, so that nothing is rejected, where the sample lacks one of the classes.
    """
    if len(set(y.tolist())) < 2:
        return 2.0
    p, fold = np.zeros(len(y)), np.arange(len(y)) % folds
    for k in range(folds):
        own, rest = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        model = fit([x[i] for i in own], y[own])
        p[rest] = model.above(np.array([model.weights[x[i]].sum() for i in rest]))[:, 0]
    clean = np.sort(p[y == 0])[::-1]
    return float(np.clip(np.nextafter(clean[int(FALSE * len(clean))], 1), LOWEST, HIGHEST))


def _fitted(docs: DataFrame, labels: DataFrame, rows: int, cut: float | None) -> tuple[Model, float]:
    def learn(x: list[np.ndarray], y: np.ndarray) -> tuple[Model, float]:
        once = unlike(x)
        x, y = [x[i] for i in once], y[once]
        return fit(x, y), choose_cut(x, y) if cut is None else cut

    return fitted(docs, labels, "toxic", features, rows, learn)


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = ROWS, cut: float | None = None) -> DataFrame:
    """doc_id, severity (expected grade, 0 to GRADES), grade (the most likely one), probability of a grade above 0, toxic (probability >= cut), for every row of docs by its whole text.

    Labels say toxic or not; the grades of the toxic ones come from their share of telling features. Fitted on about `rows` labelled documents at most, a bounded sample by hashed
    doc_id, near copies left out; without `cut` the sample chooses it (choose_cut). Null and empty texts have no features and score by the cuts alone; null doc_ids score by their text;
    repeated rows score alike; without both labels nothing is told apart and nothing is called toxic; an empty table gives no rows; other columns are ignored.
    """
    model, cut = _fitted(docs, labels, rows, cut)

    def finish(total: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        s = model.above(total)
        p = -np.diff(np.concatenate((np.ones((len(s), 1)), s, np.zeros((len(s), 1))), axis=1), axis=1)
        return [s.sum(1), p.argmax(1).astype(np.int32), s[:, 0], s[:, 0] >= cut]

    return scored(docs, features, model.weights, "severity double, grade int, probability double, toxic boolean", finish)


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = ROWS, cut: float | None = None) -> DataFrame:
    """docs without the rows whose texts score_toxicity() calls toxic, whatever their doc_id; columns as they came. Only texts go to the Python workers; rows are filtered where they are."""
    model, cut = _fitted(docs, labels, rows, cut)
    toxic = flagged(features, model.weights, lambda total, n: model.above(total)[:, 0] >= cut, docs.sparkSession)
    return docs.where(~toxic(F.col("text").cast("string")))
