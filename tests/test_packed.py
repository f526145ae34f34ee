"""Propagation and power iteration over packed blocks against the other strategies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplerank.operators import graph, packed


@pytest.fixture(scope="module")
def net(spark):
    """Two dense parts and a bridge, 300 genes with gaps in their numbers."""
    rng = np.random.default_rng(5)
    pairs = {(min(a, b) * 7, max(a, b) * 7) for lo in (0, 150) for a, b in rng.integers(lo, lo + 150, (700, 2)).tolist() if a != b} | {(0, 299 * 7)}
    return spark.createDataFrame([(a, b, 1.0) for a, b in sorted(pairs)], "gene_a long, gene_b long, weight double").localCheckpoint()


def near(one, other, keys, value="score"):
    a, b = ({tuple(r[k] for k in keys): r for r in d.collect()} for d in (one, other))
    assert a.keys() == b.keys()
    assert all(abs(a[k][value] - b[k][value]) < 1e-10 for k in a)
    return a, b


@pytest.mark.parametrize("tol, rounds", [(0.0, 2), (3e-2, 200)])
def test_packed_propagation_is_that_of_joins(spark, net, tol, rounds, monkeypatch):
    monkeypatch.setattr(packed, "BLOCK_VALUES", 700)  # columns go in several lots
    genes = graph.degree(net).select("gene")
    seeds = genes.select((F.col("gene") % 5).cast("string").alias("col"), "gene").where("gene % 3 = 0")
    only = genes.where("gene % 2 = 0").withColumn("col", F.lit("2")).unionByName(genes.withColumn("col", F.lit("4"))).unionByName(spark.createDataFrame([(-9, "4")], "gene long, col string"))
    for asked in (None, only) if tol else (only,):
        one, other = (graph.rwr_series(net, seeds, (0.3, 0.5), tol, rounds, s, None, asked) for s in ("packed", "joins"))
        assert one.schema.names == other.schema.names
        a, b = near(one, other, ("col", "alpha", "gene"))
        assert all((a[k]["n_iter"], a[k]["converged"]) == (b[k]["n_iter"], b[k]["converged"]) for k in a)


def test_packed_propagation_takes_weights(net):
    seeds, w = graph.degree(net).select(F.lit("s").alias("col"), "gene").where("gene % 3 = 0"), graph.transition(net, 0.5)
    near(graph.rwr(net, seeds, 0.5, 0.0, 3, "packed", w), graph.rwr(net, seeds, 0.5, 0.0, 3, "joins", w), ("col", "gene"))


def test_large_networks_go_packed(spark, net, monkeypatch):
    """Beyond BROADCAST_EDGES nothing goes edge by edge any more, several networks in a table neither."""
    seeds = graph.degree(net).select(F.lit("s").alias("col"), "gene").where("gene % 3 = 0")
    both = net.withColumn("network", F.lit("a")).unionByName(net.where("gene_a > 100").withColumn("network", F.lit("b")))
    two = seeds.withColumn("network", F.lit("a")).unionByName(seeds.where("gene > 100").withColumn("network", F.lit("b")))
    expected = graph.rwr(net, seeds, 0.5, 0.0, 3, strategy="joins"), graph.rwr(both, two, 0.5, 0.0, 3, strategy="joins")
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 10)
    monkeypatch.setattr(graph, "_by_joins", None)
    near(graph.rwr(net, seeds, 0.5, 0.0, 3), expected[0], ("col", "gene"))
    near(graph.rwr(both, two, 0.5, 0.0, 3), expected[1], ("network", "col", "gene"))
    with pytest.raises(ValueError):
        graph.rwr(net, seeds.unionByName(spark.createDataFrame([("t", -5)], "col string, gene long")))


@pytest.mark.parametrize("kind", ["pagerank", "eigenvector"])
def test_packed_power_iteration_is_that_of_joins(net, kind):
    near(graph.power_iteration(net, kind, 2, strategy="packed"), graph.power_iteration(net, kind, 2, strategy="joins"), ("gene",))
    near(graph.power_iteration(net, kind, 5000, tol=0.05, strategy="packed"), graph.power_iteration(net, kind, 5000, tol=0.05, strategy="arrays"), ("gene",))
    with pytest.raises(RuntimeError):
        graph.power_iteration(net, kind, 1, tol=1e-13, strategy="packed")


def test_large_networks_are_peeled_packed(spark, net, monkeypatch):
    """Core numbers by rounds over blocks are those of peeling; a tail of single neighbours and a clique besides."""
    more = [(9000 + i, 9001 + i, 1.0) for i in range(9)] + [(9100 + i, 9100 + j, 1.0) for j in range(13) for i in range(j)]
    every = net.unionByName(spark.createDataFrame(more, net.schema)).localCheckpoint()
    expected = {r["gene"]: r["core"] for r in graph.core_numbers(every, "arrays").collect()}
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 10)
    assert {r["gene"]: r["core"] for r in graph.core_numbers(every).collect()} == expected
    assert expected[9105] == 12 and expected[9000] == 1


def test_packed_betweenness_is_that_of_joins(spark, net, monkeypatch):
    monkeypatch.setattr(packed, "BLOCK_VALUES", 6500)  # sources go in several lots
    extra = spark.createDataFrame([(9000 + i, 9001 + i, 1.0) for i in range(6)], "gene_a long, gene_b long, weight double")  # a path out of reach of the rest
    e = net.unionByName(extra)
    near(graph.betweenness(e, 40, strategy="joins"), graph.betweenness(e, 40, strategy="packed"), ["gene"], "betweenness")
    near(graph.betweenness(extra, strategy="arrays"), graph.betweenness(extra, strategy="packed"), ["gene"], "betweenness")
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 1)
    monkeypatch.setattr(graph, "_dependencies", None)  # `auto` does without joins
    near(graph.betweenness(extra), graph.betweenness(extra, strategy="packed"), ["gene"], "betweenness")


def test_packed_triangles_are_those_of_joins(spark, net, monkeypatch):
    monkeypatch.setattr(packed, "BLOCK_EDGES", 100)
    one, other = graph.clustering(net, "joins"), graph.clustering(net, "packed")
    a, _ = near(one, other, ["gene"], "triangles")
    assert sum(r["triangles"] for r in a.values()) > 100
    near(one, other, ["gene"], "clustering")
    tree = spark.createDataFrame([(0, i, 1.0) for i in range(1, 9)], "gene_a long, gene_b long, weight double")
    assert {r["triangles"] for r in graph.clustering(tree, "packed").collect()} == {0}
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 1)
    calls, real = [], packed.triangles
    monkeypatch.setattr(packed, "triangles", lambda o: calls.append(1) or real(o))
    near(one, graph.clustering(net), ["gene"], "triangles")
    assert calls
