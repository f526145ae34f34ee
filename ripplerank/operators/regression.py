"""Linear models from Gram states: fixed effects, clustered errors, refits without a group, nested models.

states.gram() is the only pass over the rows; a model of p terms needs sums of p * p numbers a group. The driver solves p by p systems; groups stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as D
from . import states as S


def _g(i: int, j: int) -> F.Column:
    return F.col(f"g_{min(i, j)}_{max(i, j)}")


def _centred(states: DataFrame, at: list[int], fixed: list[str]) -> DataFrame:
    """states with c_i_j for the columns `at` of the Gram matrix: sums of products of deviations from the means of each fixed group (of all rows, without any)."""
    sums = S.merge(states, fixed).select(*fixed, *[(_g(0, i) / F.col("g_0_0")).alias(f"m_{i}") for i in at])
    both = states.join(sums, fixed) if fixed else states.crossJoin(F.broadcast(sums))  # one row
    m = lambda i: F.col(f"m_{i}")
    return both.withColumns({f"c_{i}_{j}": _g(i, j) - m(i) * _g(0, j) - m(j) * _g(0, i) + m(i) * m(j) * F.col("g_0_0") for i in at for j in at if i <= j})


def _c(i: int, j: int) -> F.Column:
    return F.col(f"c_{min(i, j)}_{max(i, j)}")


def _solve(centred: DataFrame, at: list[int], y: int) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """(inverse of X'X, coefficients, residual sum of squares, total sum of squares, rows): one row of sums comes to the driver."""
    sums = [F.sum(_c(i, j)).alias(f"x{i}_{j}") for i in at for j in at] + [F.sum(_c(i, y)).alias(f"y{i}") for i in at]
    r = centred.agg(*sums, F.sum(_c(y, y)).alias("yy"), F.sum("n_rows").alias("n")).first()
    if not r["n"]:
        raise ValueError("no rows without nulls")
    xx = np.array([[r[f"x{i}_{j}"] for j in at] for i in at], float).reshape(len(at), len(at))
    xy = np.array([r[f"y{i}"] for i in at], float)
    inv = np.linalg.pinv(xx, hermitian=True) if len(at) else xx
    beta = inv @ xy
    return inv, beta, float(max(r["yy"] - beta @ xy, 0.0)), float(r["yy"]), int(r["n"])


def fit(states: DataFrame, xs: list[str], terms: list[str] | None = None, fixed: list[str] | None = None, cluster: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """term, coef, se, stat, p, low, high, n, groups, r2: the slopes of `terms` (all of xs, if not named) of a model with an intercept, or with one for each group of `fixed`.

    states: gram() of (xs, y), keyed by the columns of fixed and cluster and any others. Without `cluster` errors are classical (t, n - parameters degrees of freedom). With it they are robust
    to dependence inside clusters: the sandwich of the clusters' scores, times G / (G - 1) * (n - 1) / (n - parameters), and normal limits. r2 is that within the fixed groups.
    """
    fixed, terms = fixed or [], terms or xs
    at, y = [xs.index(t) + 1 for t in terms], len(xs) + 1
    centred = _centred(states, [*at, y], fixed)
    inv, beta, rss, tss, n = _solve(centred, at, y)
    effects = states.select(*fixed).distinct().count() if fixed else 1
    params = len(at) + effects
    if cluster:
        score = [F.sum(_c(i, y) - sum((float(b) * _c(i, j) for j, b in zip(at, beta, strict=True)), F.lit(0.0))).alias(f"u{i}") for i in at]
        u = centred.groupBy(*cluster).agg(*score)
        r = u.agg(F.count("*").alias("k"), *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in at for j in at]).first()
        groups = r["k"]
        scale = groups / (groups - 1) * (n - 1) / (n - params) if groups > 1 and n > params else float("nan")
        cov = inv @ np.array([[r[f"m{i}_{j}"] for j in at] for i in at]) @ inv * scale
        q, tail = D.normal_ppf(0.5 + level / 2), D.normal_sf
    else:
        groups, free = effects, n - params
        cov = inv * (rss / free if free > 0 else float("nan"))
        q, tail = (D.t_ppf(0.5 + level / 2, free), lambda s: D.t_sf(s, free)) if free > 0 else (float("nan"), lambda s: float("nan"))
    rows = []
    for term, b, v in zip(terms, beta.tolist(), np.diag(cov).tolist(), strict=True):
        se = v**0.5 if v >= 0 else float("nan")
        stat = b / se if se > 0 else None
        rows.append((term, b, se, stat, None if stat is None else 2 * tail(abs(stat)), b - q * se, b + q * se, n, groups, 1 - rss / tss if tss else None))
    return states.sparkSession.createDataFrame(rows, "term string, coef double, se double, stat double, p double, low double, high double, n long, groups long, r2 double")


def compare(states: DataFrame, xs: list[str], models: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """model, params, rss, r2 (over the plain mean) and f, p of what it adds to the one before it: models by name, each (terms, fixed), every one nested in the next."""
    y, rows, last = len(xs) + 1, [], None
    whole = _solve(_centred(states, [y], []), [], y)[3]
    for name, (terms, fixed) in models.items():  # a handful, named by the caller
        at = [xs.index(t) + 1 for t in terms]
        _, _, rss, _, n = _solve(_centred(states, [*at, y], fixed), at, y)
        params = len(at) + (states.select(*fixed).distinct().count() if fixed else 1)
        f = (last[0] - rss) / (params - last[1]) / (rss / (n - params)) if last and params > last[1] and rss and n > params else None
        rows.append((name, params, rss, 1 - rss / whole if whole else None, f, D.f_sf(f, params - last[1], n - params) if f is not None else None))
        last = (rss, params)
    return states.sparkSession.createDataFrame(rows, "model string, params int, rss double, r2 double, f double, p double")


def _system(row, k: int) -> np.ndarray:
    """The Gram matrix of (1, xs, y) in a row of states."""
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"g_{i}_{j}"]
    return m


def left_out(states: DataFrame, xs: list[str], group: str) -> DataFrame:
    """group, n, r2_out: how well a model of xs, fitted on all other groups, predicts a group's rows, against the group's own mean. Total less own is the fit, the own sums are the judgement: no row is read again."""
    k = len(xs) + 2
    own = S.merge(states, [group])
    total = own.agg(*[F.sum(c).alias(c) for c in own.columns if c.startswith("g_")]).first()
    whole = _system(total, k) if total["g_0_0"] is not None else np.zeros((k, k))
    kind = own.schema[group].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                m = _system(row, k)
                rest = whole - m
                beta = np.linalg.pinv(rest[:-1, :-1], hermitian=True) @ rest[:-1, -1]
                res = m[-1, -1] - 2 * beta @ m[:-1, -1] + beta @ m[:-1, :-1] @ beta
                tot = m[-1, -1] - m[0, -1] ** 2 / m[0, 0]
                out.append((row[group], row["n_rows"], 1 - res / tot if tot > 0 and rest[0, 0] > 0.5 else None))
            yield pd.DataFrame(out, columns=[group, "n", "r2_out"])

    return own.mapInPandas(run, f"`{group}` {kind}, n long, r2_out double")


def refits(states: DataFrame, xs: list[str], group: str, fixed: list[str] | None = None) -> DataFrame:
    """group, term, coef: the slopes without each group in turn. fixed: effects of groups that lie inside `group` each, so that leaving it out leaves out theirs."""
    at, y = list(range(1, len(xs) + 1)), len(xs) + 1
    if fixed:
        centred = _centred(states, [*at, y], fixed)
        sums = centred.groupBy(group).agg(*[F.sum(_c(i, j)).alias(f"g_{i}_{j}") for i in [*at, y] for j in [*at, y] if i <= j])
    else:
        sums = S.merge(states, [group])
    total = sums.agg(*[F.sum(c).alias(c) for c in sums.columns if c.startswith("g_")]).first().asDict()
    kind = sums.schema[group].dataType.simpleString()
    start = 1 if fixed else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                rest = {c: total[c] - row[c] for c in total}
                at_ = range(start, len(xs) + 1)
                get = lambda i, j: rest[f"g_{min(i, j)}_{max(i, j)}"]  # noqa: B023, E731
                beta = np.linalg.pinv(np.array([[get(i, j) for j in at_] for i in at_]), hermitian=True) @ np.array([get(i, y) for i in at_])
                out += [(row[group], x, float(v)) for x, v in zip(xs, beta[1 - start :], strict=True)]
            yield pd.DataFrame(out, columns=[group, "term", "coef"])

    return sums.mapInPandas(run, f"`{group}` {kind}, term string, coef double")


def sign_stability(refitted: DataFrame, group: str) -> DataFrame:
    """term, same_sign, refits: the share of refits whose slope has the sign of the first one, by the order of the groups."""
    first = refitted.groupBy("term").agg(F.min_by(F.signum("coef"), group).alias("_s"))
    return refitted.join(first, "term").groupBy("term").agg(F.avg((F.signum("coef") == F.col("_s")).cast("double")).alias("same_sign"), F.count("*").alias("refits"))
