"""Whole components in bins against the other strategies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplerank.operators import graph, packed, whole


@pytest.fixture(scope="module")
def parts(spark):
    """Five random parts of 60 genes whose numbers lie among each other, a path and a pair."""
    rng = np.random.default_rng(7)
    pairs = {(min(a, b) * 5 + p, max(a, b) * 5 + p) for p in range(5) for a, b in rng.integers(0, 60, (150, 2)).tolist() if a != b}
    pairs |= {(900 + i, 901 + i) for i in range(8)} | {(3, 9999)} | {(5000, 5001)}
    return spark.createDataFrame([(a, b, 1.0) for a, b in sorted(pairs)], "gene_a long, gene_b long, weight double").localCheckpoint()


def rows(df, keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def bins_of(e, scaled=True):
    return whole.deal(packed.lay(graph.directed(e).select("src", "dst")), scaled)


def test_roots_are_smallest_reachable():
    a, b = np.array([5, 4, 3, 9]), np.array([4, 3, 2, 8])
    assert whole.roots(a, b, 10).tolist() == [0, 1, 2, 2, 2, 2, 6, 7, 8, 8]


@pytest.mark.parametrize("tol, rounds", [(0.0, 2), (3e-2, 200), (1e-9, 3)])
def test_whole_propagation_is_that_of_blocks(spark, parts, tol, rounds):
    genes = graph.degree(parts).select("gene")
    seeds = genes.select((F.col("gene") % 4).cast("string").alias("col"), "gene").where("gene % 3 = 0")
    only = genes.where("gene % 2 = 0").withColumn("col", F.lit("2")).unionByName(genes.withColumn("col", F.lit("3"))).unionByName(spark.createDataFrame([(-9, "3")], "gene long, col string"))
    for asked in (None, only) if rounds > 100 else (only,):
        one, other = (graph.rwr_series(parts, seeds, (0.3, 0.5), tol, rounds, s, None, asked) for s in ("whole", "blocks"))
        assert one.schema.names == other.schema.names
        a, b = ({tuple(r[k] for k in ("col", "alpha", "gene")): r for r in d.collect()} for d in (one, other))
        assert a.keys() == b.keys()
        assert all(abs(a[k]["score"] - b[k]["score"]) < 1e-12 and (a[k]["n_iter"], a[k]["converged"]) == (b[k]["n_iter"], b[k]["converged"]) for k in a)
    w = graph.transition(parts, 0.5)
    one, other = (rows(graph.rwr(parts, seeds, 0.5, 0.0, 2, s, w), ("col", "gene"), "score") for s in ("whole", "blocks"))
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-12 for k in one)


def test_large_networks_of_small_components_make_no_rounds_between_tasks(spark, parts, monkeypatch):
    """Beyond BROADCAST_EDGES components go whole, and only a component that is too large for it goes by rounds."""
    seeds = graph.degree(parts).select(F.lit("s").alias("col"), "gene").where("gene % 3 = 0")
    expected = rows(graph.rwr(parts, seeds, 0.5, 3e-2, strategy="blocks"), ("col", "gene"), "score")
    calls, real = [], packed.series
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 10)
    monkeypatch.setattr(graph, "WIDTH", 0)
    monkeypatch.setattr(packed, "series", lambda *x: calls.append(1) or real(*x))
    got = rows(graph.rwr(parts, seeds, 0.5, 3e-2), ("col", "gene"), "score")
    assert not calls and got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-12 for k in got)
    monkeypatch.setattr(whole, "WHOLE_EDGES", 100)
    got = rows(graph.rwr(parts, seeds, 0.5, 3e-2), ("col", "gene"), "score")
    assert calls and all(abs(got[k] - expected[k]) < 1e-12 for k in expected)
    with pytest.raises(ValueError):
        graph.rwr(parts, seeds.unionByName(spark.createDataFrame([("t", -5)], "col string, gene long")))


def test_searches_and_labels_in_bins(parts):
    b = bins_of(parts, False)
    assert b.n > 1
    marks = graph.degree(parts).select("gene").where("gene % 7 = 3")
    assert {g: c for (g,), c in rows(graph.components(parts), ("gene",), "component").items()} == {g: c for (g,), c in rows(graph.components(whole.stars(packed.lay(graph.directed(parts).select("src", "dst")))), ("gene",), "component").items()}
    far = rows(graph.reach_counts(parts, marks).where("n > 0"), ("gene", "distance"), "n")
    assert rows(whole.reach(b, marks, 1), ("gene", "distance"), "n") == far
    starts = marks.select((F.col("gene") % 3).cast("string").alias("source"), "gene")
    for depth in (None, 2):
        assert rows(whole.hops(b, starts, depth), ("source", "gene"), "distance") == rows(graph.bfs(parts, starts, depth), ("source", "gene"), "distance")
    assert rows(whole.propagate_labels(b, 4), ("gene",), "community") == rows(graph.label_propagation(parts, 4), ("gene",), "community")


def test_large_networks_are_searched_in_bins(parts, monkeypatch):
    """Beyond BROADCAST_EDGES searches and votes make no row an edge and round."""
    marks = graph.degree(parts).select("gene").where("gene % 7 = 3")
    starts = marks.select(F.lit("m").alias("source"), "gene")
    ways = [lambda: rows(graph.harmonic(parts, marks), ("gene",), "closeness"), lambda: rows(graph.bfs(parts, starts), ("source", "gene"), "distance"), lambda: rows(graph.label_propagation(parts, 2), ("gene",), "community"), lambda: rows(graph.largest_component(parts), ("gene_a", "gene_b"), "weight")]
    expected = [w() for w in ways]
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 10)
    calls = []
    for name in ("reach", "hops", "propagate_labels", "stars"):
        monkeypatch.setattr(whole, name, lambda *x, _real=getattr(whole, name), _name=name: calls.append(_name) or _real(*x))
    assert [w() for w in ways] == expected
    assert {"reach", "hops", "propagate_labels", "stars"} <= set(calls)
