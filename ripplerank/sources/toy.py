"""Small made networks for tests and trials: no part of any other path."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def preferential(n: int, m: int, rng: np.random.Generator) -> set[tuple[int, int]]:
    """Edges of a graph that grows gene by gene, each with m edges to genes drawn by degree."""
    ends, edges = list(range(m)), set()
    for new in range(m, n):
        to: set[int] = set()
        while len(to) < m:
            to.add(ends[int(rng.integers(len(ends)))])
        for x in to:
            edges.add((x, new))
            ends += [x, new]
    return edges


def planted(edges: set[tuple[int, int]], inside: np.ndarray, swaps: int, rng: np.random.Generator) -> set[tuple[int, int]]:
    """Degree-preserving swaps that turn two edges which leave a set, (u, x) and (v, y) with u and v in it, into one within and one without: a module that degree does not tell."""
    member = set(inside.tolist())
    have = set(edges)
    out = [(a, b) if a in member else (b, a) for a, b in sorted(have) if (a in member) != (b in member)]
    order = rng.permutation(len(out)).tolist()
    done = 0
    for i, j in zip(order[::2], order[1::2], strict=False):
        if done >= swaps:
            break
        (u, x), (v, y) = out[i], out[j]
        one, two = (min(u, v), max(u, v)), (min(x, y), max(x, y))
        if len({u, v, x, y}) == 4 and one not in have and two not in have:
            have -= {(min(u, x), max(u, x)), (min(v, y), max(v, y))}
            have |= {one, two}
            done += 1
    return have


def toy_network(spark: SparkSession, scenario: str, n: int = 1500, m: int = 3, positives: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(edges, positives (gene)) of a scenario: `random` positives anywhere, `hubs` the genes of highest degree, `module` positives tied to each other by degree-preserving swaps."""
    rng = np.random.default_rng(seed)
    edges = preferential(n, m, rng)
    degree = np.bincount(np.array(sorted(edges)).ravel(), minlength=n)
    if scenario == "hubs":
        chosen = np.argsort(-degree, kind="stable")[:positives]
    elif scenario in ("random", "module"):
        chosen = np.sort(rng.choice(n, positives, replace=False))
    else:
        raise ValueError(f"unknown scenario {scenario}")
    if scenario == "module":
        edges = planted(edges, chosen, int(degree[chosen].sum() // 3), rng)
    name = lambda i: f"G{i:05d}"
    rows = [(name(a), name(b), 1.0) for a, b in sorted(edges)]
    return spark.createDataFrame(rows, "gene_a string, gene_b string, weight double"), spark.createDataFrame([(name(int(i)),) for i in chosen], "gene string")


def bench_network(spark: SparkSession, genes: int, edges: int) -> DataFrame:
    """About that many edges between hashed genes whose degrees are uneven: made where they lie, any size."""
    from pyspark.sql import functions as F

    end = lambda salt: F.floor(F.pow((F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)), F.lit(2)) * genes)
    raw = spark.range(edges).select(end(1).alias("gene_a"), end(2).alias("gene_b")).where("gene_a <> gene_b")
    return raw.select(F.least("gene_a", "gene_b").alias("gene_a"), F.greatest("gene_a", "gene_b").alias("gene_b"), F.lit(1.0).alias("weight")).distinct()
