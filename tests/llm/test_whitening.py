"""Whitening against integers of Python and the contract's own checks."""

import math
import random

import numpy as np
import pytest

from ripplerank.llm import shared, whitening

COLS = "vec_id long, embedding array<double>, label int, dims int, n long, whitened string, v string, shares string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, "a", "b", "c") for i, v in rows], COLS)


def entry(c):
    f = 1024 * c
    return (1 << 62 if f > 0 else -(1 << 62)) if abs(f) >= 1 << 62 else math.floor(f)


def check(got, rows):
    """got: rows of whiten() over rows of one length, all of which are usable."""
    x = [[entry(c) + 100_000 for c in v] for _, v in rows]
    n, dims = len(x), len(x[0])
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = sorted((str(i), sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True))) for (i, _), r in zip(rows, x, strict=True))
    first = got[got["component"] == 1]
    assert sorted((str(None if i != i else int(i)), int(d)) for i, d in zip(first["vec_id"], first["deviation_exact"], strict=True)) == want
    assert all((d != d) == (int(e) >= 1 << 63) and (d != d or int(e) == int(d) or abs(int(e)) > 1 << 53) for d, e in zip(got["deviation"], got["deviation_exact"], strict=True))
    assert (got["n"] == n).all() and len(got) == n * min(8, dims)
    return np.array(x, dtype=float) - 100_000, n


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12)) * 0.3
    rows = [(i, v) for i, v in enumerate(data.tolist())]
    for salted in (False, True):
        if salted:
            monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
        got = whitening.whiten(table(spark, rows).repartition(3 + 4 * salted)).toPandas()
        y, n = check(got, rows)
        cov = (y - y.mean(0)).T @ (y - y.mean(0)) / n
        e, axes = np.linalg.eigh(cov)
        e, axes = e[::-1][:8], axes[:, ::-1][:, :8]
        w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
        mine = (y - y.mean(0)) @ axes / np.sqrt(e)
        assert np.abs(np.abs(w) - np.abs(mine)).max() < 1e-8
        assert np.abs(np.cov(w.T, bias=True) - np.eye(8)).max() < 1e-9
        assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
        assert np.allclose(got.groupby("component")["explained"].first(), e / np.trace(cov), rtol=1e-9)


def test_small_eigenvalues_beside_large_ones(spark):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(400, 8)) * 10.0 ** np.arange(7, -1, -1)
    got = whitening.whiten(table(spark, list(enumerate(data.tolist())))).toPandas()
    assert got["identity_error"].iloc[0] < 1e-4 and (got.groupby("component")["whitened"].std(ddof=0) - 1).abs().max() < 1e-4


def test_awkward_vectors(spark):
    out = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0])]
    assert whitening.whiten(table(spark, out)).count() == 0 and whitening.whiten(table(spark, [])).count() == 0
    one = whitening.whiten(table(spark, [*out, (7, [0.5, -0.25])])).toPandas()
    assert one["deviation"].tolist() == [0, 0] and one["whitened"].isna().all() and one["explained"].isna().all() and one["identity_error"].isna().all()
    rows = [(None, [0.1, 0.2]), (6, [0.1, 0.2]), (6, [0.3, 0.4])]  # one direction only
    got = whitening.whiten(table(spark, rows + out)).toPandas()
    check(got, rows)
    assert got[got["component"] == 2]["whitened"].isna().all() and got[got["component"] == 1]["whitened"].notna().all() and got["identity_error"].iloc[0] < 1e-12
    two = whitening.whiten(table(spark, [*rows, (8, [1.0, 2.0, 5.0]), (9, [2.0, 1.0, 0.0])])).toPandas()
    assert sorted(two["n"].unique()) == [2, 3] and len(two) == 3 * 2 + 2 * 3


def test_entries_of_any_size(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1e300, -1e300, 3e15, 1e-300, 0.1, -7e9]) for _ in range(3)]) for i in range(60)]
    got = whitening.whiten(table(spark, rows)).toPandas()
    check(got, rows)
    assert got["whitened"].notna().all() and got["identity_error"].iloc[0] < 1e-4


@pytest.mark.parametrize("peak", [5, 1 << 19, 1 << 40, 1 << 62])
def test_scatter_is_exact(peak):
    rng = random.Random(peak)
    y = np.array([[rng.randint(-peak, peak) for _ in range(4)] for _ in range(9000)], np.int64)
    s, parts = whitening.Scatter(4), np.array_split(y, 5)
    for p in parts:
        s.add(p)
    o = np.insert(y.astype(object), 0, 1, axis=1)
    assert (s.close() == o.T @ o).all()
    sums = [int(c) * 10**9 for c in y.astype(object).sum(0)]
    n = len(y) * 10**9
    assert whitening.deviations(y[:50], n, sums) == [sum((n * int(a) - c) ** 2 for a, c in zip(r, sums, strict=True)) for r in y[:50]]
