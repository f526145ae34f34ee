"""What network_descriptors asks for is made without the rest of the descriptors."""

import numpy as np
import pytest

from ripplerank.operators import graph


@pytest.fixture(scope="module")
def parts(spark):
    rng = np.random.default_rng(7)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, 60, (150, 2)).tolist() if a != b}
    return spark.createDataFrame([(a, b, 1.0) for a, b in sorted(pairs)], "gene_a long, gene_b long, weight double").localCheckpoint()


def rows(df, keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def test_basics_make_no_communities_and_no_paths(parts, monkeypatch):
    for name in ("louvain", "bfs", "core_numbers", "landmarks"):
        monkeypatch.setattr(graph, name, None)
    got, d = graph.basics(parts).first(), rows(graph.degree(parts), ("gene",), "degree")
    assert set(got.asDict()) == {"n_nodes", "n_edges", "mean_degree", "density", "mean_clustering", "assortativity"}
    assert (got["n_nodes"], got["n_edges"]) == (len(d), parts.count())
    ends = np.array([(d[x,], d[y,]) for r in parts.collect() for x, y in ((r["gene_a"], r["gene_b"]), (r["gene_b"], r["gene_a"]))], float)
    assert abs(got["assortativity"] - np.corrcoef(ends.T)[0, 1]) < 1e-12
