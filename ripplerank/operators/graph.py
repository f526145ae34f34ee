"""Graphs as edge tables: cleaning, components, propagation, distances, centralities, rewiring, walks.

A network is (gene_a, gene_b, weight), one row an edge, gene_a < gene_b. Loops run on the driver, one DataFrame step a round, cut by written tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import uniform
from ..sources.shared import cut, fresh
from . import packed, whole
from .ranks import by_group

#: Edges of which arrays may be broadcast to the tasks that propagate blocks of seed sets; larger graphs go by joins.
BROADCAST_EDGES = 4_000_000
#: Columns of a block that numpy propagates, and columns of a row of the propagation by joins.
BLOCK_COLUMNS, WIDTH = 64, 16
#: Networks in one table that are propagated one by one where they are too large for `blocks`; more go by joins.
SIDE_BY_SIDE = 8
#: 64-bit words of a row of the search from many sources.
WORDS = 4


def canonical(pairs: DataFrame) -> DataFrame:
    """Edges of raw pairs (gene_a, gene_b, weight): nulls and self-loops go, ends in order, of repeated edges the largest weight."""
    good = pairs.where("gene_a is not null and gene_b is not null and gene_a <> gene_b")
    return good.groupBy(F.least("gene_a", "gene_b").alias("gene_a"), F.greatest("gene_a", "gene_b").alias("gene_b")).agg(F.max("weight").alias("weight"))


def networks(df: DataFrame) -> list[str]:
    """The column that tells networks apart, where several stand in one table."""
    return ["network"] if "network" in df.columns else []


def directed(edges: DataFrame) -> DataFrame:
    """(network if there are several, src, dst, weight): every edge from either end."""
    net = networks(edges)
    return edges.select(*net, F.col("gene_a").alias("src"), F.col("gene_b").alias("dst"), "weight").unionByName(edges.select(*net, F.col("gene_b").alias("src"), F.col("gene_a").alias("dst"), "weight"))


def _large(edges: DataFrame) -> bool:
    """Whether a network is counted to be beyond BROADCAST_EDGES, with genes that can be packed."""
    return packed.fits(edges.schema["gene_a"].dataType) and edges.count() > BROADCAST_EDGES


def _bins(edges: DataFrame) -> whole.Bins | None:
    """The components of a large network in bins, where each fits one."""
    return whole.deal(packed.lay(directed(edges).select("src", "dst"))) if _large(edges) else None


def components(edges: DataFrame, strategy: str = "auto") -> DataFrame:
    """(gene, component): the smallest gene that each reaches; large-star and small-star rounds until nothing moves. Of a large network (`auto`) blocks of genes first tell what is connected inside them, a row a gene and block; `joins`: over the edges as they are."""
    if strategy == "auto" and _large(edges):
        kind = edges.schema["gene_a"].dataType
        near = cut(whole.stars(packed.lay(directed(edges).where("src <> dst").select("src", "dst"))), "stars")
        return components(near, "joins").select(F.col("gene").cast(kind).alias("gene"), F.col("component").cast(kind).alias("component"))
    e = cut(edges.select(F.greatest("gene_a", "gene_b").alias("a"), F.least("gene_a", "gene_b").alias("b")).where("a <> b").distinct(), "star")
    marks = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
    seen = e.agg(*marks).first()
    while seen["n"]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        e = cut(large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct(), "star")
        now = e.agg(*marks).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("gene"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("gene"), F.col("b").alias("component")).distinct())


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges of the component with most genes; of equal ones that with the smallest gene."""
    comp = cut(components(edges), "components")
    best = comp.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).select("component")
    return edges.join(comp.join(F.broadcast(best), "component", "left_semi").select(F.col("gene").alias("gene_a")), "gene_a", "left_semi").select("gene_a", "gene_b", "weight")


def finalize(pairs: DataFrame, network: str) -> tuple[DataFrame, DataFrame]:
    """(edges of the largest component, one row of counts at every step of the cleaning)."""
    raw = pairs.agg(F.count("*").alias("n_input_edges"), F.count_if(F.col("gene_a").isNotNull() & F.col("gene_b").isNotNull()).alias("n_mapped_edges"), F.count_if(F.col("gene_a") == F.col("gene_b")).alias("n_self_loops"))
    edges = cut(canonical(pairs), "edges")
    comp = cut(components(edges), "components")
    best = comp.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    lcc = cut(edges.join(comp.join(F.broadcast(best), "component", "left_semi").select(F.col("gene").alias("gene_a")), "gene_a", "left_semi").select("gene_a", "gene_b", "weight"), "lcc")
    sizes = edges.agg(F.count("*").alias("n_edges_dedup")).crossJoin(comp.agg(F.count_distinct("component").alias("n_components"))).crossJoin(lcc.agg(F.count("*").alias("n_edges_lcc"))).crossJoin(best.select(F.col("count").alias("n_nodes_lcc")))
    return lcc, raw.crossJoin(sizes).withColumn("net_id", F.lit(network))  # one row each


def degree(edges: DataFrame) -> DataFrame:
    """(gene, degree): distinct neighbours (in each network, where there are several)."""
    return directed(edges).groupBy(*networks(edges), F.col("src").alias("gene")).agg(F.count("*").alias("degree"))


def transition(edges: DataFrame, beta: float | None = None) -> DataFrame:
    """(src, dst, w) whose weights leave each src as a distribution: 1 / degree, or with beta 1 / (degree_src * degree_dst) ** beta, made to sum to 1."""
    d, net = degree(edges), networks(edges)
    e = directed(edges).select(*net, "src", "dst").join(d.select(*net, F.col("gene").alias("src"), F.col("degree").alias("ds")), [*net, "src"])
    if beta is None:
        return e.select(*net, "src", "dst", (1.0 / F.col("ds")).alias("w"))
    e = e.join(d.select(*net, F.col("gene").alias("dst"), F.col("degree").alias("dd")), [*net, "dst"]).withColumn("raw", F.pow(F.col("ds") * F.col("dd"), F.lit(-beta)))
    total = e.groupBy(*net, "src").agg(F.sum("raw").alias("total"))
    return e.join(total, [*net, "src"]).select(*net, "src", "dst", (F.col("raw") / F.col("total")).alias("w"))


def transition_problems(w: DataFrame) -> DataFrame:
    """(rule, n) of what keeps (src, dst, w) from being a walk on a simple undirected network: self-loops, ends without the way back, genes that no edge leaves; empty if nothing does."""
    loops = w.where("src = dst").agg(F.lit("self_loop").alias("rule"), F.count("*").alias("n"))
    back = w.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    one_way = w.join(back, ["src", "dst"], "left_anti").agg(F.lit("asymmetric").alias("rule"), F.count("*").alias("n"))
    alone = w.select(F.col("dst").alias("src")).distinct().join(w, "src", "left_anti").agg(F.lit("isolated").alias("rule"), F.count("*").alias("n"))
    return loops.unionByName(one_way).unionByName(alone).where("n > 0")


def check_transition(w: DataFrame) -> DataFrame:
    """w, or an error that names the broken rules: at most three rows reach the driver."""
    broken = transition_problems(w).collect()
    if broken:
        raise ValueError("no walk on this network: " + ", ".join(f"{r['rule']} ({r['n']})" for r in broken))
    return w


def transition_safe(genes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, w) of the genes asked for: those without an edge have one row, with a null dst and weight 0, so that their walks end."""
    return genes.select(F.col("gene").alias("src")).distinct().join(transition(edges), "src", "left").select("src", "dst", F.coalesce("w", F.lit(0.0)).alias("w"))


def seed_matrix(seeds: DataFrame) -> DataFrame:
    """(col, gene, p0) of (col, gene): uniform over each column's distinct seeds (of a network, where there are several)."""
    net = networks(seeds)
    one = seeds.select(*net, "col", "gene").distinct()
    return one.join(one.groupBy(*net, "col").agg((1.0 / F.count("*")).alias("p0")), [*net, "col"])


def rwr(edges: DataFrame, seeds: DataFrame, alpha: float = 0.5, tol: float = 1e-8, max_iter: int = 200, strategy: str = "auto", weights: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """rwr_series() for one alpha, without its column."""
    return rwr_series(edges, seeds, (alpha,), tol, max_iter, strategy, weights, only).drop("alpha")


def rwr_series(edges: DataFrame, seeds: DataFrame, alphas: tuple[float, ...], tol: float = 1e-8, max_iter: int = 200, strategy: str = "auto", weights: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """(col, alpha, gene, score, n_iter, converged): random walk with restart, p = alpha * p0 + (1 - alpha) * W'p, from each seed column at each alpha, all from one series.

    With x(k) = W'^k p0, round n of an alpha is alpha * sum over k < n of (1 - alpha)^k x(k), and (1 - alpha)^n x(n); it moves by (1 - alpha)^n |x(n) - x(n - 1)|. So x(k) is propagated once for all
    alphas, and a (column, alpha) stops by itself at the first round that moves less than tol: n_iter says which, converged whether it came within max_iter (null for tol 0, which asks for exactly max_iter rounds).
    Where edges, seeds (and only) have a `network` column, networks stand side by side: a column belongs to one, and the result has the column too. A column without a seed in its network is an error, as is an empty
    seed set. `only` (col, gene) names the scores that are wanted; without it every column has every gene of its network.

    `joins`: a row a gene and WIDTH columns; a round is one join and one sum of a row an edge and block, any size. `blocks`: edge arrays, up to BROADCAST_EDGES of them, are broadcast and even
    blocks of columns propagated by numpy. `packed`: edges lie in blocks of genes that send each other values (packed.Blocks), any size, genes being whole numbers. `whole`: connected components are dealt whole to tasks, in
    which all rounds go on (whole.Bins); where one is too large for that, it is packed. All run each column the same rounds and differ by rounding only; `auto` takes blocks where the edges were counted to fit, else, where the genes allow it,
    whole for more than WIDTH columns and packed for fewer, since dealing out components costs more than their rounds; several networks then go one by one.
    """
    if not alphas or any(not 0 < a <= 1 for a in alphas):
        raise ValueError("alpha must be over 0 and at most 1")
    given = weights if weights is not None else directed(edges)
    net, kind = networks(given), given.schema["src"].dataType
    if strategy == "auto" and given.count() > BROADCAST_EDGES:
        strategy = "large" if packed.fits(kind) and not net else "joins"
        names = [r["network"] for r in given.select("network").distinct().limit(SIDE_BY_SIDE + 1).collect()] if net else []
        if packed.fits(kind) and 0 < len(names) <= SIDE_BY_SIDE:
            return _one_by_one(sorted(names), edges, seeds, alphas, tol, max_iter, weights, only)
    alphas = tuple(dict.fromkeys(map(float, alphas)))
    if strategy in ("packed", "whole", "large"):
        p0 = cut(seed_matrix(seeds.join(given.select(F.col("src").alias("gene")).distinct(), "gene", "left_semi")), "p0")
        many = _all_seeded(seeds, p0, []) > WIDTH
        e = given if weights is not None else given.select("src", "dst")
        laid = packed.lay(e)
        bins = whole.deal(laid) if strategy == "whole" or (strategy == "large" and many) else None
        return whole.series(bins, p0, kind, alphas, tol, max_iter, only) if bins else packed.series(e, p0, alphas, tol, max_iter, only, laid)
    w = weights if weights is not None else cut(transition(edges), "transition")
    p0 = cut(seed_matrix(seeds.join(w.select(*net, F.col("src").alias("gene")).distinct(), [*net, "gene"], "left_semi")), "p0")
    return (_by_joins if strategy == "joins" else _by_blocks)(w, p0, net, alphas, tol, max_iter, only, _all_seeded(seeds, p0, net))


def _all_seeded(seeds: DataFrame, p0: DataFrame, net: list[str]) -> int:
    """The number of seed columns, all of which have a gene in their network, else it is an error."""
    here = p0.select(*net, "col").distinct().withColumn("_in", F.lit(1))
    columns = seeds.select(*net, "col").distinct().join(here, [*net, "col"], "left").agg(F.count("*").alias("n"), F.count("_in").alias("found")).first()
    if not columns["n"] or columns["found"] < columns["n"]:
        raise ValueError("a seed set has no gene in the network")
    return columns["n"]


def _one_by_one(names: list[str], edges: DataFrame, seeds: DataFrame, alphas: tuple[float, ...], tol: float, max_iter: int, weights: DataFrame | None, only: DataFrame | None) -> DataFrame:
    """rwr_series() of each network by itself, every one by the strategy that it fits."""
    seeds, out = cut(seeds.select("network", "col", "gene"), "seeds"), None
    if not seeds.join((weights if weights is not None else edges).select("network").distinct(), "network", "left_anti").isEmpty():
        raise ValueError("a seed set has no gene in the network")
    for name in names:
        of = lambda d: d.where(F.col("network") == name).drop("network") if d is not None else None  # noqa: B023, E731
        if of(seeds).isEmpty():
            continue
        p = rwr_series(of(edges), of(seeds), alphas, tol, max_iter, "auto", of(weights), of(only)).select(F.lit(name).alias("network"), "col", "alpha", "gene", "score", "n_iter", "converged")
        out = p if out is None else out.unionByName(p)
    if out is None:
        raise ValueError("a seed set has no gene in the network")
    return out


def _dealt(p0: DataFrame, net: list[str], block: int) -> DataFrame:
    """(network, col, _block, _at): the columns of each network in blocks of up to `block`, as even as can be."""
    placed = by_group(p0.select(*net, "col").distinct(), net, ["col"])
    blocks = F.ceil(F.col("_size") / block)
    return cut(placed.select(*net, "col", F.pmod(F.col("_place") - 1, blocks).cast("int").alias("_block"), F.floor((F.col("_place") - 1) / blocks).cast("int").alias("_at")), "columns")


def _by_joins(w: DataFrame, p0: DataFrame, net: list[str], alphas: tuple[float, ...], tol: float, max_iter: int, only: DataFrame | None, columns: int) -> DataFrame:
    spark = w.sparkSession
    width = min(WIDTH, columns)
    names = [f"x{i}" for i in range(width)]
    dealt = _dealt(p0, net, width)
    home = fresh(spark, "series")  # one folder a round: the series is read once more at the end, for all alphas

    def put(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{home}/k={k}")
        return spark.read.schema(df.schema).parquet(f"{home}/k={k}")

    first = [F.sum(F.when(F.col("_at") == i, F.col("p0")).otherwise(0.0)).alias(x) for i, x in enumerate(names)]
    x = put(p0.join(dealt, [*net, "col"]).groupBy(*net, "_block", "gene").agg(*first), 0)
    slow, n, gaps = 1 - min(alphas), 0, None
    open_columns = dealt
    while n < max_iter:
        n += 1
        live = x.join(open_columns.select(*net, "_block").distinct(), [*net, "_block"], "left_semi")
        msg = live.join(w, [*[live[c] == w[c] for c in net], live["gene"] == w["src"]])
        msg = msg.groupBy(*[live[c] for c in net], live["_block"], w["dst"].alias("gene")).agg(*[F.sum(F.col(c) * w["w"]).alias(c) for c in names])
        after = put(msg, n)
        if tol > 0:
            before = live.withColumnsRenamed({c: f"_{c}" for c in names})
            moved = after.join(before, [*net, "_block", "gene"], "full").groupBy(*net, "_block").agg(*[F.sum(F.abs(F.coalesce(c, F.lit(0.0)) - F.coalesce(f"_{c}", F.lit(0.0)))).alias(c) for c in names])
            each = F.explode(F.array(*[F.struct(F.lit(i).alias("_at"), F.col(c).alias("d")) for i, c in enumerate(names)])).alias("g")
            gap = cut(moved.select(*net, "_block", each).select(*net, "_block", "g.*").join(open_columns, [*net, "_block", "_at"]).withColumn("k", F.lit(n)), "gaps")
            gaps = gap if gaps is None else gaps.unionByName(gap)
            open_columns = cut(gap.where(F.col("d") * F.lit(slow**n) >= tol).select(*net, "col", "_block", "_at"), "open")
            if open_columns.isEmpty():
                break
        x = after
    ask = F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha")
    ends = dealt.select(*net, "col", "_block", "_at", ask)
    if tol > 0:
        power = F.pow(1 - F.col("alpha"), F.col("k"))
        stops = gaps.select(*net, "col", "k", "d", ask).where(F.col("d") * power < tol).groupBy(*net, "col", "alpha").agg(F.min("k").alias("_k"))
        ends = ends.join(stops, [*net, "col", "alpha"], "left").select(*net, "col", "_block", "_at", "alpha", F.coalesce("_k", F.lit(n)).alias("n_iter"), F.col("_k").isNotNull().alias("converged"))
    else:
        ends = ends.select("*", F.lit(n).alias("n_iter"), F.lit(None).cast("boolean").alias("converged"))
    ends = cut(ends, "ends")
    series = spark.read.schema(T.StructType([*x.schema.fields, T.StructField("k", T.IntegerType())])).parquet(home)
    each = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("_at"), F.col(c).alias("v")) for i, c in enumerate(names)]), lambda s: s["v"] != 0)).alias("s")
    parts = series.select(*net, "_block", "gene", "k", each).select(*net, "_block", "gene", "k", "s.*").join(dealt, [*net, "_block", "_at"])
    grid = only.select(*net, "col", "gene").distinct() if only is not None else None
    if grid is not None:
        parts = parts.join(grid, [*net, "col", "gene"], "left_semi")
    parts = parts.select(*net, "col", "gene", "k", "v").join(ends.select(*net, "col", "alpha", "n_iter"), [*net, "col"]).where("k <= n_iter")
    weight = F.when(F.col("k") < F.col("n_iter"), F.col("alpha")).otherwise(F.lit(1.0)) * F.pow(1 - F.col("alpha"), F.col("k"))
    scores = parts.groupBy(*net, "col", "alpha", "gene").agg(F.sum(F.col("v") * weight).alias("score"))
    # every gene that is asked for has a score: those out of reach 0
    genes = w.select(*net, F.col("src").alias("gene")).distinct()
    if grid is None:
        grid = genes.join(dealt.select(*net, "col"), net) if net else dealt.select("col").crossJoin(genes)
    out = grid.join(ends.select(*net, "col", "alpha", "n_iter", "converged"), [*net, "col"]).join(scores, [*net, "col", "alpha", "gene"], "left")
    return out.select(*net, "col", "alpha", "gene", F.coalesce("score", F.lit(0.0)).alias("score"), "n_iter", "converged")


class _Matrix:
    """W' of one network by rows, for products with one column at a time."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, val: np.ndarray):
        self.genes = np.unique(src)  # every gene has an edge from it
        src, dst = np.searchsorted(self.genes, src), np.searchsorted(self.genes, dst)
        order = np.argsort(dst, kind="stable")
        self.src, dst, val = src[order].astype(np.int32), dst[order], val[order]
        self.starts = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
        self.at = dst[self.starts]
        self.scale = np.zeros(len(self.genes))
        self.scale[self.src] = val
        self.val = None if (self.scale[self.src] == val).all() else val  # weights that follow from the source alone scale the vector instead

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.genes))
        flow = (x * self.scale)[self.src] if self.val is None else x[self.src] * self.val
        out[self.at] = np.add.reduceat(flow, self.starts)
        return out


def _by_blocks(w: DataFrame, p0: DataFrame, net: list[str], alphas: tuple[float, ...], tol: float, max_iter: int, only: DataFrame | None, columns: int) -> DataFrame:
    spark = w.sparkSession
    tag = w.select(*(net or [F.lit("").alias("network")]), "src", "dst", "w")
    arrays = tag.toArrow()  # at most BROADCAST_EDGES rows, counted before
    name = np.array([str(x) for x in arrays["network"].unique().to_pylist()], object)
    which = arrays["network"].combine_chunks().dictionary_encode().indices.to_numpy()
    src, dst, val = (arrays[c].to_numpy() for c in ("src", "dst", "w"))
    shared = spark.sparkContext.broadcast({n: _Matrix(src[which == i], dst[which == i], val[which == i]) for i, n in enumerate(name)})
    fields = [p0.schema[c] for c in (*net, "col")] + [T.StructField("alpha", T.DoubleType()), T.StructField("gene", w.schema["src"].dataType), T.StructField("score", T.DoubleType()), T.StructField("n_iter", T.IntegerType()), T.StructField("converged", T.BooleanType())]
    kinds = T.StructType(fields)

    def run(pdf: pd.DataFrame, wanted: pd.DataFrame | None = None) -> pd.DataFrame:
        own = pdf["network"].iloc[0] if net else None
        m = shared.value[str(own) if net else ""]
        cols, j = np.unique(pdf["col"].to_numpy(), return_inverse=True)
        n_genes = len(m.genes)
        x = np.zeros((len(cols), n_genes))
        x[j, np.searchsorted(m.genes, pdf["gene"].to_numpy())] = pdf["p0"].to_numpy()
        if wanted is None:
            k, gene = np.repeat(np.arange(len(cols)), n_genes), np.tile(m.genes, len(cols))
        else:
            k, gene = np.searchsorted(cols, wanted["col"].to_numpy()), wanted["gene"].to_numpy()
        g = np.minimum(np.searchsorted(m.genes, gene), n_genes - 1)
        inside = m.genes[g] == gene
        order = np.argsort(k, kind="stable")
        bounds = np.searchsorted(k[order], np.arange(len(cols) + 1))
        score = np.zeros((len(alphas), len(k)))
        rounds, ok = np.zeros((len(alphas), len(cols)), np.int32), np.zeros((len(alphas), len(cols)), bool)
        for c in range(len(cols)):
            mine, now = order[bounds[c] : bounds[c + 1]], x[c]
            at, live = g[mine], list(range(len(alphas)))
            for n in range(1, max_iter + 1):
                after = m @ now
                gap = float(np.abs(after - now).sum()) if tol > 0 else np.inf
                for a in list(live):
                    less = 1 - alphas[a]
                    score[a, mine] += alphas[a] * less ** (n - 1) * now[at]
                    rounds[a, c] = n
                    ok[a, c] = less**n * gap < tol
                    if ok[a, c] or n == max_iter:
                        score[a, mine] += less**n * after[at]
                        live.remove(a)
                if not live:
                    break
                now = after
        score[:, ~inside] = 0.0
        size = len(alphas)
        out = {"network": own} if net else {}
        out |= {"col": np.tile(cols[k], size), "alpha": np.repeat(np.array(alphas), len(k)), "gene": np.tile(gene, size), "score": score.ravel()}
        return pd.DataFrame(out | {"n_iter": rounds[:, k].ravel(), "converged": ok[:, k].ravel() if tol > 0 else [None] * (size * len(k))})

    # Blocks of about as many columns as keep every core at work, BLOCK_COLUMNS at most.
    block = max(1, min(BLOCK_COLUMNS, -(-columns // (2 * spark.sparkContext.defaultParallelism))))
    dealt = _dealt(p0, net, block)
    by = [*net, "_block"]
    rows = p0.join(dealt, [*net, "col"])
    if only is None:
        return rows.groupBy(*by).applyInPandas(lambda pdf: run(pdf), kinds)
    to = dealt.select(*[F.col(c).alias(f"_{c}") for c in (*net, "col")], F.col("_block").alias("_asked"))
    asked = only.select(*net, "col", "gene").join(to, [F.col(c) == F.col(f"_{c}") for c in (*net, "col")])
    rows = rows.join(asked.select(*net, F.col("_asked").alias("_block")).distinct(), by, "left_semi")  # nothing is propagated that nobody asked for
    return rows.groupBy(*by).cogroup(asked.groupBy(*net, "_asked")).applyInPandas(lambda a, b: run(a, b), kinds)


def bfs(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(source, gene, distance) of (source, gene): hops from each source's nearest start, frontier by frontier until none is left (or as deep as asked for); what is out of reach is absent. Over a large network of components that fit a task (whole.Bins) each is searched in one."""
    bins = _bins(edges)
    if bins:
        return cut(whole.hops(bins, sources, max_depth).select("source", F.col("gene").cast(edges.schema["gene_a"].dataType).alias("gene"), "distance"), "hops")
    e = cut(directed(edges).select("src", "dst"), "edges")
    seen = cut(sources.select("source", "gene").distinct().withColumn("distance", F.lit(0)), "seen")
    front, d = seen, 0
    while max_depth is None or d < max_depth:
        d += 1
        front = cut(front.join(e, F.col("gene") == F.col("src")).select("source", F.col("dst").alias("gene")).distinct().join(seen, ["source", "gene"], "left_anti").withColumn("distance", F.lit(d)), "front")
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front), "seen")
    return seen


def proximity(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, gene, distance, score): score is minus the distance; genes out of reach stand one beyond the farthest of their source."""
    d = bfs(edges, sources)
    far = d.groupBy("source").agg((F.max("distance") + 1).alias("far"))
    grid = far.crossJoin(degree(edges).select("gene"))
    return grid.join(d, ["source", "gene"], "left").select("source", "gene", F.coalesce("distance", "far").alias("distance"), (-F.coalesce("distance", "far")).cast("double").alias("score"))


def landmarks(edges: DataFrame, most: int = 256, seed: str = "landmarks") -> DataFrame:
    """(gene): genes of the largest component in the order of their hashes, all of them where there are no more than `most`."""
    return cut(degree(largest_component(edges)).select("gene").orderBy(uniform(F.col("gene"), seed), "gene").limit(most), "landmarks")


def reach_counts(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(gene, distance, n): how many of the sources (gene) lie at each distance from a gene, 0 for itself; genes out of reach of all are absent.

    Sources are bits: a row of the frontier is a gene and WORDS * 64 sources, so a round moves one row an edge for all of them, bit by bit or'ed together, and what was seen before is masked out. The rounds end when no
    bit is new.
    """
    bins = _bins(edges)
    if bins:  # every search goes on inside a component
        kind = edges.schema["gene_a"].dataType
        return cut(whole.reach(bins, sources, WORDS).select(F.col("gene").cast(kind).alias("gene"), "distance", "n"), "reach")
    e = cut(directed(edges).select("src", "dst"), "edges")
    words = [f"b{i}" for i in range(WORDS)]
    placed = by_group(sources.select("gene").distinct(), [], ["gene"]).withColumn("_at", F.col("_place") - 1)
    word, bit = F.floor(F.col("_at") / 64 % WORDS).cast("int"), F.expr("shiftleft(1L, cast(_at % 64 as int))")
    here = placed.select("gene", F.floor(F.col("_at") / (64 * WORDS)).alias("block"), word.alias("word"), bit.alias("bit"))
    first = here.select("block", "gene", *[F.when(F.col("word") == i, F.col("bit")).otherwise(F.lit(0).cast("long")).alias(w) for i, w in enumerate(words)])
    seen = cut(first.join(degree(edges).select("gene"), "gene", "left_semi").select("block", "gene", *words, *[F.col(w).alias(f"new_{w}") for w in words]), "seen")
    count = sum((F.bit_count(f"new_{w}") for w in words), F.lit(0)).cast("long").alias("n")
    out = seen.select("gene", F.lit(0).alias("distance"), count)
    d = 0
    while True:
        d += 1
        front = seen.where(" or ".join(f"new_{w} <> 0" for w in words)).select("block", F.col("gene").alias("src"), *[F.col(f"new_{w}").alias(f"got_{w}") for w in words])
        got = front.join(e, "src").groupBy("block", F.col("dst").alias("gene")).agg(*[F.bit_or(f"got_{w}").alias(f"got_{w}") for w in words])
        both = seen.drop(*[f"new_{w}" for w in words]).join(got, ["block", "gene"], "full")
        zero = F.lit(0).cast("long")
        old, come = (lambda w: F.coalesce(F.col(w), zero)), (lambda w: F.coalesce(F.col(f"got_{w}"), zero))
        seen = cut(both.select("block", "gene", *[old(w).bitwiseOR(come(w)).alias(w) for w in words], *[come(w).bitwiseAND(F.bitwise_not(old(w))).alias(f"new_{w}") for w in words]), "seen")
        new = cut(seen.select("gene", F.lit(d).alias("distance"), count).where("n > 0"), "new")
        if new.isEmpty():
            return out.groupBy("gene", "distance").agg(F.sum("n").alias("n"))
        out = out.unionByName(new)


def harmonic(edges: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(gene, closeness): mean of 1 / max(distance, 1) from the landmarks (gene); unreachable ones count 0, and a gene out of reach of all has 0."""
    n = landmarks.agg(F.count("*").alias("k"))
    s = reach_counts(edges, landmarks).groupBy("gene").agg(F.sum(F.col("n") / F.greatest("distance", F.lit(1))).alias("s"))
    return degree(edges).select("gene").join(s, "gene", "left").crossJoin(F.broadcast(n)).select("gene", F.coalesce(F.col("s") / F.col("k"), F.lit(0.0)).alias("closeness"))


def closeness(edges: DataFrame, exact: int = 5000, most: int = 256) -> DataFrame:
    """(gene, closeness): harmonic() from every gene of a network of up to `exact` genes, from `most` landmarks of the largest component of a larger one."""
    genes = cut(degree(edges).select("gene"), "genes")
    return harmonic(edges, genes if genes.count() <= exact else landmarks(edges, most))


def power_iteration(edges: DataFrame, kind: str, rounds: int = 50, damping: float = 0.85, tol: float = 0.0, strategy: str = "auto") -> DataFrame:
    """(gene, score): `eigenvector` by repeated neighbour sums (shifted by the own score, so two-sided graphs settle), scaled to length 1; `pagerank` with uniform teleport and mass moving along the edges.

    Without tol exactly `rounds` rounds. With tol the rounds go on until the scores move less than tol in sum; `rounds` is then an error to reach. `arrays`: one task
    holds the graph; `packed`: blocks of genes send each other values, any size, genes being whole numbers; `joins`: any size; `auto` takes arrays for a tol where the edges were counted to fit, else packed where the genes allow
    it.
    """
    edges = cut(edges, "edges")
    if strategy == "auto":
        few = edges.count() <= BROADCAST_EDGES
        strategy = "arrays" if tol and few else "joins" if few or not packed.fits(edges.schema["gene_a"].dataType) else "packed"
    if strategy == "packed":
        return packed.power(directed(edges).select("src", "dst"), kind, rounds, damping, tol)
    if strategy == "arrays":
        return _power_by_arrays(edges, kind, rounds, damping, tol)
    d = cut(degree(edges), "degree")
    e = cut(directed(edges).select("src", "dst"), "edges")
    n = d.count()
    state = d.select("gene", F.lit(1.0 / max(n, 1)).alias("p"), "degree")
    for _ in range(rounds):
        share = F.col("p") / F.col("degree") if kind == "pagerank" else F.col("p")
        msg = state.select("gene", share.alias("x")).join(e, F.col("gene") == F.col("src")).groupBy(F.col("dst").alias("gene")).agg(F.sum("x").alias("m"))
        joined = state.join(msg, "gene", "left")
        if kind == "pagerank":
            after = joined.select("gene", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("m", F.lit(0.0))).alias("p"), "degree")
        else:
            after = joined.select("gene", (F.coalesce("m", F.lit(0.0)) + F.col("p")).alias("p"), "degree")
            norm = after.agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("norm"))
            after = after.crossJoin(F.broadcast(norm)).select("gene", (F.col("p") / F.col("norm")).alias("p"), "degree")
        after = cut(after, "power")
        moved = after.select("gene", F.col("p").alias("q")).join(state, "gene").agg(F.sum(F.abs(F.col("q") - F.col("p")))).first()[0] if tol else None
        state = after
        if tol and moved < tol:
            break
    else:
        if tol and n:
            raise RuntimeError(f"{kind}: no convergence to {tol} in {rounds} rounds")
    return state.select("gene", F.col("p").alias("score"))


def _power_by_arrays(edges: DataFrame, kind: str, rounds: int, damping: float, tol: float) -> DataFrame:
    shared = edges.sparkSession.sparkContext.broadcast(_adjacency(edges))
    kinds = T.StructType([T.StructField("gene", edges.schema["gene_a"].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            genes, code = np.unique(np.concatenate((shared.value["a"], shared.value["b"])), return_inverse=True)
            n, m = len(genes), len(code) // 2
            if not n:
                continue
            src, dst = code, np.concatenate((code[m:], code[:m]))
            degree = np.bincount(src, minlength=n)
            p = np.full(n, 1.0 / n)
            for _ in range(rounds):
                if kind == "pagerank":
                    after = (1 - damping) / n + damping * np.bincount(dst, (p / degree)[src], n)
                else:
                    after = np.bincount(dst, p[src], n) + p
                    after /= np.sqrt(after @ after)
                moved = np.abs(after - p).sum()
                p = after
                if tol and moved < tol:
                    break
            else:
                if tol:
                    raise RuntimeError(f"{kind}: no convergence to {tol} in {rounds} rounds")
            yield pd.DataFrame({"gene": genes, "score": p})

    return edges.sparkSession.range(1, numPartitions=1).mapInPandas(run, kinds)


def eigenvector(edges: DataFrame) -> DataFrame:
    """(gene, score): power_iteration to convergence."""
    return power_iteration(edges, "eigenvector", 100_000, tol=1e-10)


def pagerank(edges: DataFrame) -> DataFrame:
    """(gene, score): power_iteration to convergence."""
    return power_iteration(edges, "pagerank", 1_000, tol=1e-12)


def core_numbers(edges: DataFrame, strategy: str = "auto") -> DataFrame:
    """(gene, core): peels genes of at most k live neighbours, k by k, until none is left. `arrays`: one task holds the graph; `packed`: bounds of the numbers fall in rounds over blocks of genes (packed.cores), any size, genes being whole numbers; `joins`: any size; `auto` takes arrays where the edges were counted to fit, else packed where the genes allow it."""
    held = None if strategy in ("joins", "packed") else _adjacency(edges)
    if held is not None:
        return _cores_by_arrays(edges, held)
    if strategy == "packed" or (strategy == "auto" and packed.fits(edges.schema["gene_a"].dataType)):
        return packed.cores(cut(directed(edges).select("src", "dst"), "edges"))
    live, out, k = cut(directed(edges).select("src", "dst"), "core"), None, 0
    while not live.isEmpty():
        k = max(k + 1, live.groupBy("src").count().agg(F.min("count")).first()[0])
        while True:
            weak = cut(live.groupBy("src").count().where(F.col("count") <= k).select(F.col("src").alias("gene")), "weak")
            if weak.isEmpty():
                break
            after = cut(live.join(weak, F.col("src") == F.col("gene"), "left_anti").join(weak, F.col("dst") == F.col("gene"), "left_anti"), "core")
            gone = live.select(F.col("src").alias("gene")).distinct().join(after.select(F.col("src").alias("gene")).distinct(), "gene", "left_anti").withColumn("core", F.lit(k))
            out = cut(gone if out is None else out.unionByName(gone), "peeled")
            live = after
    return out if out is not None else live.select(F.col("src").alias("gene"), F.lit(0).alias("core"))


def _cores_by_arrays(edges: DataFrame, held: dict) -> DataFrame:
    shared = edges.sparkSession.sparkContext.broadcast(held)
    kinds = T.StructType([T.StructField("gene", edges.schema["gene_a"].dataType), T.StructField("core", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            genes, code = np.unique(np.concatenate((shared.value["a"], shared.value["b"])), return_inverse=True)
            m = len(code) // 2
            src, dst = code, np.concatenate((code[m:], code[:m]))
            core, alive, k = np.zeros(len(genes), np.int32), np.ones(len(genes), bool), 0
            degree = np.bincount(src, minlength=len(genes))
            while alive.any():
                k = max(k, int(degree[alive].min()))
                weak = alive & (degree <= k)
                while weak.any():
                    core[weak], alive = k, alive & ~weak
                    gone = weak[src] & alive[dst]
                    degree = degree - np.bincount(dst[gone], minlength=len(genes))
                    weak = alive & (degree <= k)
            yield pd.DataFrame({"gene": genes, "core": core})

    return edges.sparkSession.range(1, numPartitions=1).mapInPandas(run, kinds)


def clustering(edges: DataFrame, strategy: str = "auto") -> DataFrame:
    """(gene, triangles, clustering): each triangle is found once, from its end of lowest degree on. `packed`: blocks of neighbour lists meet two by two (packed.triangles), genes being whole numbers; `joins`: a row a pair of neighbours; `auto` takes joins where the edges were counted to be few, else packed where the genes allow it."""
    d = cut(degree(edges), "degree")
    e = edges.select("gene_a", "gene_b").join(d.select(F.col("gene").alias("gene_a"), F.col("degree").alias("da")), "gene_a").join(d.select(F.col("gene").alias("gene_b"), F.col("degree").alias("db")), "gene_b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("gene_a") < F.col("gene_b")))
    o = cut(e.select(F.when(first, F.col("gene_a")).otherwise(F.col("gene_b")).alias("u"), F.when(first, F.col("gene_b")).otherwise(F.col("gene_a")).alias("v")), "oriented")
    if strategy == "packed" or (strategy == "auto" and packed.fits(edges.schema["gene_a"].dataType) and o.count() > BROADCAST_EDGES):
        per = packed.triangles(o)
    else:
        wedge = o.alias("x").join(o.alias("y"), "u").where(F.col("x.v") < F.col("y.v")).select("u", F.col("x.v").alias("v"), F.col("y.v").alias("w"))
        tri = wedge.join(edges.select(F.col("gene_a").alias("v"), F.col("gene_b").alias("w")), ["v", "w"])
        per = tri.select(F.explode(F.array("u", "v", "w")).alias("gene")).groupBy("gene").agg(F.count("*").alias("t"))
    t = F.coalesce("t", F.lit(0)).cast("long")
    return d.join(per, "gene", "left").select("gene", t.alias("triangles"), F.when(F.col("degree") > 1, 2.0 * t / (F.col("degree") * (F.col("degree") - 1))).otherwise(F.lit(0.0)).alias("clustering"))


def truncate_hubs(edges: DataFrame, cap: int) -> DataFrame:
    """edges without those of genes whose degree passes the cap."""
    hubs = degree(edges).where(F.col("degree") > cap).select("gene")
    return edges.join(hubs, F.col("gene_a") == F.col("gene"), "left_anti").join(hubs, F.col("gene_b") == F.col("gene"), "left_anti")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(gene, community): each gene takes the commonest community of its neighbours and itself, the smallest of equals; a number of rounds, inside a task where the network is large and its components fit one (whole.Bins)."""
    bins = _bins(edges)
    if bins:
        kind = edges.schema["gene_a"].dataType
        return cut(whole.propagate_labels(bins, rounds).select(F.col("gene").cast(kind).alias("gene"), F.col("community").cast(kind).alias("community")), "communities")
    e = cut(directed(edges).select("src", "dst").unionByName(degree(edges).select(F.col("gene").alias("src"), F.col("gene").alias("dst"))), "edges")
    state = e.select(F.col("src").alias("gene")).distinct().withColumn("community", F.col("gene"))
    for _ in range(rounds):
        votes = state.join(e, F.col("gene") == F.col("src")).groupBy("dst", "community").count()
        state = cut(votes.groupBy(F.col("dst").alias("gene")).agg(F.min_by("community", F.struct((-F.col("count")).alias("n"), "community")).alias("community")), "communities")
    return state


def louvain(edges: DataFrame, tol: float = 1e-4, seed: str = "louvain") -> DataFrame:
    """(gene, community): communities of high modularity, named by their smallest gene; every edge counts one.

    Genes move to the neighbouring community of highest gain, round by round, until rounds gain less than tol; communities then become the nodes of a coarser network, and so on until a level gains less than tol.
    There is no number of rounds. Random choices are hashes, so the result does not depend on how rows are dealt.
    """
    e = cut(directed(edges).select("src", "dst", F.lit(1.0).alias("w")), "louvain")
    nodes = cut(e.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).withColumn("loop", F.lit(0.0)), "nodes")
    total = nodes.agg(F.sum("k")).first()[0]
    of = nodes.select(F.col("node").alias("gene"), F.col("node").alias("community"))
    level = 0
    while total:
        level += 1
        state, gained = _settle(e, nodes, total, tol, f"{seed}|{level}")
        if gained < tol:
            break
        of = cut(of.join(state.select(F.col("node").alias("community"), F.col("community").alias("to")), "community").select("gene", F.col("to").alias("community")), "communities")
        ends = e.join(state.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(state.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
        between = cut(ends.groupBy("a", "b").agg(F.sum("w").alias("w")), "between")
        inside = between.where("a = b").select(F.col("a").alias("node"), F.col("w").alias("_in"))
        held = state.groupBy(F.col("community").alias("node")).agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"))
        nodes = cut(held.join(inside, "node", "left").select("node", "k", (F.col("loop") + F.coalesce("_in", F.lit(0.0))).alias("loop")), "nodes")
        e = between.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
    least = of.groupBy("community").agg(F.min("gene").alias("name"))
    return of.join(least, "community").select("gene", F.col("name").alias("community"))


def _settle(e: DataFrame, nodes: DataFrame, total: float, tol: float, seed: str) -> tuple[DataFrame, float]:
    """((node, k, loop, community), modularity gained): one level's moves, from every node for itself until rounds gain less than tol.

    A round is one pass over the edges, which tells each node's best move and the modularity of where it stands. Communities get a hashed order, and nodes move up in it only, so that no two swap. A round that loses modularity is
    taken back and tried with fewer of the nodes; where few are not few enough, each community takes part in its best move alone: gains of such moves add up exactly, so that modularity rises with every round that is kept.
    """
    state = nodes.withColumn("community", F.col("node"))
    first = best = kept = None
    share, n, small = 1.0, 0, 0
    while True:
        n += 1
        held = state.select(F.col("node").alias("dst"), "community")
        links = e.join(held, "dst").select(F.col("src").alias("node"), "community", "w").unionByName(state.select("node", "community", F.lit(0.0).alias("w")))
        links = links.groupBy("node", "community").agg(F.sum("w").alias("w")).join(state.groupBy("community").agg(F.sum("k").alias("tot")), "community")
        seen = links.join(state.select("node", "k", "loop", F.col("community").alias("at")), "node")
        # what a community is worth to a node, itself not counted; rounded, so that the order of summation decides nothing
        mine = F.col("community") == F.col("at")
        worth = F.round(F.col("w") - F.col("k") * (F.col("tot") - F.when(mine, F.col("k")).otherwise(0.0)) / total, 9)
        ways = [F.max(F.when(mine, c)).alias(n) for c, n in ((F.col("w"), "w_at"), (F.col("tot"), "tot_at"), (worth, "stay"))]
        best_of = F.max(F.when(~mine, F.struct(worth.alias("worth"), F.col("community").alias("to")))).alias("m")
        per = seen.groupBy("node", "k", "loop", "at").agg(*ways, best_of)
        per = cut(per.select("node", "k", "loop", "at", "w_at", "tot_at", F.col("m.to").alias("to"), F.coalesce(F.col("m.worth") - F.col("stay"), F.lit(0.0)).alias("gain")), "moves")
        r = per.agg(F.sum(F.col("w_at") + F.col("loop")).alias("inside"), F.sum(F.col("k") * F.col("tot_at")).alias("square"), F.sum(F.greatest("gain", F.lit(0.0))).alias("gain")).first()
        q = round(r["inside"] / total - r["square"] / (total * total), 12)
        if best is None or q > best:
            small = small + 1 if best is not None and q - best < tol else 0
            first = q if first is None else first
            best, kept, share = q, per, share if small else min(1.0, 4 * share)
            if r["gain"] * 2 / total < tol or small > 2 or (share < 1 / 32 and small):
                break
        elif share < 1 / 32:  # moves that cannot lose have lost to rounding: nothing is left
            break
        else:
            share /= 4
        wanted = F.col("gain") > 1e-9
        if share >= 1 / 32:
            rank = lambda c: uniform(F.col(c), f"{seed}|{n}")
            taken = wanted & (rank("at") < rank("to")) & (uniform(F.col("node"), f"{seed}|{n}|node") < share)
            state = cut(kept.select("node", "k", "loop", F.when(taken, F.col("to")).otherwise(F.col("at")).alias("community")), "state")
        else:
            each = kept.where(wanted).select("node", "gain", F.explode(F.array("at", "to")).alias("c")).groupBy("c").agg(F.max(F.struct("gain", "node")).alias("top"))
            lead = lambda c: each.select(F.col("c").alias(c), F.col("top.node").alias(f"_{c}"))
            alone = kept.where(wanted).join(lead("at"), "at").join(lead("to"), "to").where((F.col("_at") == F.col("node")) & (F.col("_to") == F.col("node")))
            state = kept.join(alone.select("node", F.col("to").alias("_move")), "node", "left").select("node", "k", "loop", F.coalesce("_move", "at").alias("community"))
            state = cut(state, "state")
    return kept.select("node", "k", "loop", F.col("at").alias("community")), best - first


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row, modularity: the share of edges inside communities (gene, community) less what degrees alone would give."""
    e = directed(edges).join(communities.select(F.col("gene").alias("src"), F.col("community").alias("ca")), "src").join(communities.select(F.col("gene").alias("dst"), F.col("community").alias("cb")), "dst")
    per = e.groupBy(F.col("ca").alias("community")).agg(F.sum(F.when(F.col("ca") == F.col("cb"), 1).otherwise(0)).alias("inside"), F.count("*").alias("ends"))
    total = F.sum("ends").cast("double")
    return per.agg((F.sum("inside") / total - F.sum(F.col("ends").cast("double") * F.col("ends")) / (total * total)).alias("modularity"))


def basics(edges: DataFrame) -> DataFrame:
    """One row: genes, edges, mean degree, density, mean clustering, degree assortativity."""
    edges = cut(edges, "edges")
    d = cut(degree(edges), "degree")
    base = d.agg(F.count("*").alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.avg("degree").alias("mean_degree"))
    e = directed(edges).join(d.select(F.col("gene").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("gene").alias("dst"), F.col("degree").alias("dd")), "dst")
    return base.withColumn("density", 2.0 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).crossJoin(clustering(edges).agg(F.avg("clustering").alias("mean_clustering"))).crossJoin(e.agg(F.corr("ds", "dd").alias("assortativity")))


def descriptors(edges: DataFrame, sources: int = 20) -> DataFrame:
    """One row: basics(), modularity of the Louvain communities, mean path length from `sources` hashed genes of the largest component, the largest core number and the shares of genes in the 2-core and the 10-core."""
    edges = cut(edges, "edges")
    out = basics(edges)
    starts = landmarks(edges, sources, "paths")
    paths = bfs(edges, starts.select(F.col("gene").alias("source"), "gene")).where("distance > 0").agg(F.avg("distance").alias("mean_path"))
    core = core_numbers(edges).agg(F.max("core").alias("max_core"), F.avg((F.col("core") >= 2).cast("double")).alias("core2"), F.avg((F.col("core") >= 10).cast("double")).alias("core10"))
    return out.crossJoin(modularity(edges, louvain(edges))).crossJoin(paths).crossJoin(core)


def features(edges: DataFrame, sources: int = 300) -> DataFrame:
    """gene, degree, core, triangles, clustering, betweenness (from sampled sources), pagerank, Louvain community and its size: a row a gene."""
    edges = cut(edges, "edges")
    c = cut(louvain(edges), "communities")
    size = c.groupBy("community").agg(F.count("*").alias("community_size"))
    out = degree(edges).join(core_numbers(edges), "gene", "left").join(clustering(edges), "gene", "left").join(betweenness(edges, sources), "gene", "left")
    return out.join(pagerank(edges).withColumnRenamed("score", "pagerank"), "gene", "left").join(c, "gene", "left").join(size, "community", "left").select("gene", "degree", "core", "triangles", "clustering", "betweenness", "pagerank", "community", "community_size")


def _adjacency(edges: DataFrame) -> dict | None:
    """Neighbour arrays of a graph of at most BROADCAST_EDGES edges, for the tasks that walk or rewire it; None for a larger one."""
    edges = cut(edges, "edges")
    if edges.count() > BROADCAST_EDGES:
        return None
    p = edges.select("gene_a", "gene_b").toArrow()
    return {c[-1]: p[c].to_numpy() for c in ("gene_a", "gene_b")}


def rewire(edges: DataFrame, replicates: int, swaps: float = 10.0, seed: int = 42) -> DataFrame:
    """(rewire_id, gene_a, gene_b): degree-preserving double-edge swaps, `swaps` tries an edge; one replicate a task.

    Each swap depends on all before it, so a replicate is one task that holds the graph: at most BROADCAST_EDGES edges, more are an error.
    """
    spark, kind = edges.sparkSession, edges.schema["gene_a"].dataType
    held = _adjacency(edges)
    if held is None:
        raise ValueError(f"a rewiring holds the graph in a task: at most {BROADCAST_EDGES} edges")
    shared = spark.sparkContext.broadcast(held)
    kinds = T.StructType([T.StructField("rewire_id", T.LongType()), T.StructField("gene_a", kind), T.StructField("gene_b", kind)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for r in frame["id"].tolist():
                genes, code = np.unique(np.concatenate((shared.value["a"], shared.value["b"])), return_inverse=True)
                m = len(shared.value["a"])
                a, b = code[:m].tolist(), code[m:].tolist()
                have = {(min(x, y), max(x, y)) for x, y in zip(a, b, strict=True)}
                rng = np.random.default_rng([seed, r])
                tries = int(swaps * m)
                for i, j, flip in zip(rng.integers(0, m, tries).tolist(), rng.integers(0, m, tries).tolist(), (rng.random(tries) < 0.5).tolist(), strict=True):
                    u, v, x, y = a[i], b[i], a[j], b[j]
                    if flip:
                        x, y = y, x
                    if len({u, v, x, y}) == 4:
                        one, two = (min(u, y), max(u, y)), (min(x, v), max(x, v))
                        if one not in have and two not in have:
                            have -= {(min(u, v), max(u, v)), (min(x, y), max(x, y))}
                            have |= {one, two}
                            a[i], b[i], a[j], b[j] = u, y, x, v
                ends = np.array(sorted(have)).reshape(-1, 2)
                yield pd.DataFrame({"rewire_id": r, "gene_a": genes[ends[:, 0]], "gene_b": genes[ends[:, 1]]})

    return spark.range(replicates).repartition(max(replicates, 1)).mapInPandas(run, kinds)


def mixing(edges: DataFrame, other: DataFrame) -> DataFrame:
    """One row: edges that two graphs share, genes of the first that keep no neighbour, and how many shared edges chance gives: sum of d(d-1) over (2m-1), halved."""
    one, two = edges.select("gene_a", "gene_b"), other.select("gene_a", "gene_b")
    same = cut(one.intersect(two), "same")
    kept = same.select(F.col("gene_a").alias("gene")).unionByName(same.select(F.col("gene_b").alias("gene"))).distinct()
    lost = degree(edges).join(kept, "gene", "left_anti").agg(F.count("*").alias("n_changed_nodes"))
    chance = degree(edges).agg((F.sum(F.col("degree") * (F.col("degree") - 1.0)) / (F.sum("degree") - 1) / 2).alias("expected_shared"))
    return same.agg(F.count("*").alias("n_shared_edges")).crossJoin(lost).crossJoin(chance)


def _draw(seed: int, gene, walk, step) -> float:
    """uniform() of `seed|gene|walk` and a step, in Python."""
    return int(hashlib.md5(f"{gene}|{seed}|{walk}|{step}".encode()).hexdigest()[:8], 16) / 4294967296.0


def walks(edges: DataFrame, per_gene: int = 10, length: int = 20, p: float = 1.0, q: float = 1.0, seed: int = 42, strategy: str = "auto") -> DataFrame:
    """(gene, walk_id, walk array): second-order walks; a step never returns at once, and goes to a neighbour of the last gene with weight 1/p, to others with 1/q.

    A step proposes hashed places in the list of neighbours, one after the other, and takes the first that a second hash accepts: never the last gene, others in proportion to their weights. So a walk reads the neighbours
    that it proposes, not all of them, and a hub costs what any gene does. `arrays`: each task holds the graph; `joins`: a step of all walks is a join on (gene, place), any size; both walk the same ways, and `auto`
    takes arrays where the edges were counted to fit.
    """
    spark, kind = edges.sparkSession, edges.schema["gene_a"].dataType
    held = None if strategy == "joins" else _adjacency(edges)
    if held is None:
        return _walks_by_joins(edges, per_gene, length, p, q, seed)
    shared = spark.sparkContext.broadcast(held)
    kinds = T.StructType([T.StructField("gene", kind), T.StructField("walk_id", T.IntegerType()), T.StructField("walk", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        genes, code = np.unique(np.concatenate((shared.value["a"], shared.value["b"])), return_inverse=True)
        m, n = len(code) // 2, len(genes)
        ends = np.unique(np.concatenate((code[:m] * n + code[m:], code[m:] * n + code[:m])))
        near, first = ends % n, np.searchsorted(ends, np.arange(n + 1) * n)
        names = genes.tolist()
        for frame in batches:
            own = np.searchsorted(genes, frame["gene"].to_numpy())
            for lo in range(0, len(own) * per_gene, 2048):  # walks side by side
                ids = np.arange(lo, min(lo + 2048, len(own) * per_gene))
                start, walk = own[ids // per_gene], ids % per_gene
                path, at, last, live = [start], start.copy(), np.full(len(ids), -1), np.ones(len(ids), bool)
                for step in range(1, length):
                    many = first[at + 1] - first[at]
                    live &= ~((many == 1) & (last >= 0))  # the only way leads back
                    who, attempt = np.flatnonzero(live), 0
                    while len(who):
                        u, v = (np.array([_draw(seed, names[g], w, f"{step}|{attempt}{x}") for g, w in zip(start[who].tolist(), walk[who].tolist(), strict=True)]) for x in ("", "|keep"))
                        to = near[first[at[who]] + (u * many[who]).astype(np.int64)]
                        edge = last[who] * n + to
                        place = np.minimum(np.searchsorted(ends, edge), len(ends) - 1)
                        share = np.where(ends[place] == edge, 1 / p, 1 / q) / max(1 / p, 1 / q)
                        ok = (last[who] < 0) | ((to != last[who]) & (v < share))
                        last[who[ok]], at[who[ok]] = at[who[ok]], to[ok]
                        who, attempt = who[~ok], attempt + 1
                    path.append(np.where(live, at, -1))
                steps = np.stack(path, axis=1)
                yield pd.DataFrame({"gene": genes[start], "walk_id": walk.astype(np.int32), "walk": [[str(names[x]) for x in r if x >= 0] for r in steps.tolist()]})

    return degree(edges).select("gene").mapInPandas(run, kinds)


def _walks_by_joins(edges: DataFrame, per_gene: int, length: int, p: float, q: float, seed: int) -> DataFrame:
    e = cut(directed(edges).select("src", "dst").distinct(), "edges")
    placed = by_group(e, ["src"], ["dst"])
    size = e.groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("to_degree"))
    near = cut(placed.select("src", (F.col("_place") - 1).alias("place"), "dst").join(size, "dst").select("src", "place", F.col("dst").alias("to"), "to_degree"), "neighbours")
    known = e.select(F.col("src").alias("last"), F.col("dst").alias("to"), F.lit(True).alias("known"))
    kind = edges.schema["gene_a"].dataType
    state = size.select(F.col("dst").alias("gene"), F.explode(F.sequence(F.lit(0), F.lit(per_gene - 1))).alias("walk_id"), F.col("to_degree").alias("degree"))
    state = state.select("gene", "walk_id", F.col("gene").alias("at"), "degree", F.lit(None).cast(kind).alias("last"))
    steps = [state.select("gene", "walk_id", F.lit(0).alias("step"), "at")]
    for step in range(1, length):
        pending, begun, tries, taken = state.where("degree > 1 or last is null"), 0, 4, None
        while True:  # a walk is refused with a chance of a half at most where p and q are equal, so each round leaves few
            salt = F.concat_ws("|", F.lit(str(seed)), F.col("walk_id").cast("string"), F.lit(str(step)), F.col("attempt").cast("string"))
            asks = pending.withColumn("attempt", F.explode(F.sequence(F.lit(begun), F.lit(begun + tries - 1))))
            asks = asks.withColumn("place", F.floor(uniform(F.col("gene"), salt) * F.col("degree"))).withColumn("v", uniform(F.col("gene"), F.concat(salt, F.lit("|keep"))))
            offers = asks.join(near, (asks["at"] == near["src"]) & (asks["place"] == near["place"])).select("gene", "walk_id", "at", "last", "attempt", "v", "to", "to_degree").where("last is null or to <> last")
            if p != q:
                share = F.when(F.col("known"), F.lit(1 / p)).otherwise(F.lit(1 / q)) / F.lit(max(1 / p, 1 / q))
                offers = offers.join(known, ["last", "to"], "left").where(F.col("last").isNull() | (F.col("v") < share))
            first = offers.groupBy("gene", "walk_id").agg(F.min_by(F.struct("to", "to_degree", "at"), "attempt").alias("m"))
            got = cut(first.select("gene", "walk_id", F.col("m.to").alias("at"), F.col("m.to_degree").alias("degree"), F.col("m.at").alias("last")), "walks")
            taken = got if taken is None else taken.unionByName(got)
            pending = cut(pending.join(got.select("gene", "walk_id"), ["gene", "walk_id"], "left_anti"), "pending")
            begun, tries = begun + tries, 4 * tries
            if pending.isEmpty():
                break
        state = taken
        steps.append(state.select("gene", "walk_id", F.lit(step).alias("step"), "at"))
    every = steps[0]
    for x in steps[1:]:
        every = every.unionByName(x)
    path = F.transform(F.array_sort(F.collect_list(F.struct("step", "at"))), lambda x: x["at"].cast("string"))
    return every.groupBy("gene", "walk_id").agg(path.alias("walk"))


def embed(walked: DataFrame, size: int = 16, window: int = 5, seed: int = 42) -> DataFrame:
    """(gene string, vector): word vectors of the walks."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=size, windowSize=window, minCount=0, seed=seed, maxIter=1, inputCol="walk", outputCol="v").fit(walked)
    return model.getVectors().select(F.col("word").alias("gene"), vector_to_array("vector").alias("vector"))


def betweenness(edges: DataFrame, sources: int = 50, seed: str = "betweenness", strategy: str = "auto") -> DataFrame:
    """(gene, betweenness): shortest-path dependencies from sampled sources (all genes where they are fewer), scaled to all sources.

    `arrays`: sources are dealt to tasks, each holding the graph; `packed`: blocks of genes send each other the paths of the sources that have reached them (packed.dependencies), any size, genes being whole numbers; `joins`: paths are counted
    frontier by frontier, and dependencies passed back level by level, any size; `auto` takes arrays where the edges were counted to fit, else packed where the genes allow it.
    """
    kind = edges.schema["gene_a"].dataType
    picked = cut(degree(edges).select("gene").orderBy(uniform(F.col("gene"), seed), "gene").limit(sources), "sources")
    n, sources = degree(edges).count(), max(picked.count(), 1)
    scaled = lambda part: degree(edges).select("gene").join(part.groupBy("gene").agg(F.sum("part").alias("part")), "gene", "left").select("gene", (F.coalesce("part", F.lit(0.0)) * n / sources / 2).alias("betweenness"))
    held = None if strategy in ("joins", "packed") else _adjacency(edges)
    if held is None:
        if strategy == "packed" or (strategy == "auto" and packed.fits(kind)):
            return scaled(packed.dependencies(cut(directed(edges).select("src", "dst"), "edges"), picked))
        return scaled(_dependencies(edges, picked))
    shared = edges.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        genes, code = np.unique(np.concatenate((shared.value["a"], shared.value["b"])), return_inverse=True)
        m = len(shared.value["a"])
        near: list[list[int]] = [[] for _ in genes]
        for x, y in zip(code[:m].tolist(), code[m:].tolist(), strict=True):
            near[x].append(y)
            near[y].append(x)
        total = np.zeros(len(genes))
        for frame in batches:
            for s in np.searchsorted(genes, frame["gene"].to_numpy()).tolist():
                depth, paths, order = {s: 0}, {s: 1.0}, [s]
                for u in order:
                    for v in near[u]:
                        if v not in depth:
                            depth[v], paths[v] = depth[u] + 1, 0.0
                            order.append(v)
                        if depth[v] == depth[u] + 1:
                            paths[v] += paths[u]
                owed = dict.fromkeys(order, 0.0)
                for v in reversed(order):
                    for u in near[v]:
                        if depth[u] == depth[v] - 1:
                            owed[u] += paths[u] / paths[v] * (1 + owed[v])
                    if v != s:
                        total[v] += owed[v]
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gene": genes[at], "part": total[at]})

    return scaled(picked.repartition(edges.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, T.StructType([T.StructField("gene", kind), T.StructField("part", T.DoubleType())])))


def _dependencies(edges: DataFrame, picked: DataFrame) -> DataFrame:
    """(gene, part): for each source the share of its shortest paths that run through each other gene."""
    e = cut(directed(edges).select("src", "dst"), "edges")
    front = cut(picked.select(F.col("gene").alias("source"), "gene", F.lit(1.0).alias("paths")), "front")
    seen, levels = front.select("source", "gene"), [front]
    while True:
        front = front.join(e, F.col("gene") == F.col("src")).groupBy("source", F.col("dst").alias("gene")).agg(F.sum("paths").alias("paths")).join(seen, ["source", "gene"], "left_anti")
        front = cut(front, "front")
        if front.isEmpty():
            break
        levels.append(front)
        seen = cut(seen.unionByName(front.select("source", "gene")), "seen")
    owed, out = levels[-1].withColumn("part", F.lit(0.0)), None
    for level in reversed(levels[:-1]):
        out = owed.select("gene", "part") if out is None else out.unionByName(owed.select("gene", "part"))
        back = owed.select("source", F.col("gene").alias("v"), ((1 + F.col("part")) / F.col("paths")).alias("share"))
        up = level.join(e, F.col("gene") == F.col("src")).withColumnRenamed("dst", "v").join(back, ["source", "v"])
        gained = up.groupBy("source", "gene").agg(F.sum(F.col("paths") * F.col("share")).alias("part"))
        owed = cut(level.join(gained, ["source", "gene"], "left").select("source", "gene", "paths", F.coalesce("part", F.lit(0.0)).alias("part")), "owed")
    if out is None:  # no source has a neighbour
        return owed.select("gene", "part").where("part > 0")
    return out
