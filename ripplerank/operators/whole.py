"""Rounds that never leave a task: connected components of a network of any size, dealt whole to bins.

Walks, searches and communities never leave a component. Where every component fits a task, a bin holds some of them as arrays, and all rounds of a column go on in it; only what the components decide together (when a column
stops, whether a round of moves is kept) is added up between tasks. Networks with a larger component go by the rounds of `packed` instead.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, fresh, numbered
from . import packed
from .ranks import by_group

#: Directed edges up to which a component goes whole into a task.
WHOLE_EDGES = 4_000_000

_PART = "bin int, first long, genes binary, counts binary, need binary, src binary, val binary"
_BIN = "bin int, genes binary, counts binary, src binary, val binary"


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest that it reaches over the edges a - b."""
    f = np.arange(n)
    while len(a):
        x, y = f[a], f[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(f, np.maximum(x, y), np.minimum(x, y))
        while True:
            g = f[f]
            if (g == f).all():
                break
            f = g
    return f


def stars(laid: DataFrame) -> DataFrame:
    """(gene_a, gene_b): for each block of packed.lay() its genes and the smallest that each reaches inside it: the components of the whole network in a row a gene and block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for r in frame.to_dict("records"):
                genes, need = np.frombuffer(r["genes"], np.int64), np.frombuffer(r["need"], np.int64)
                ends = np.union1d(genes, need)
                to = np.repeat(np.searchsorted(ends, genes), np.frombuffer(r["counts"], np.int32))
                root = roots(np.searchsorted(ends, need)[np.frombuffer(r["src"], np.int32)], to, len(ends))
                away = root != np.arange(len(ends))
                yield pd.DataFrame({"gene_a": ends[root[away]], "gene_b": ends[away]})

    return laid.select("genes", "counts", "need", "src").mapInPandas(run, "gene_a long, gene_b long")


def _bucketed(df: DataFrame, n: int) -> DataFrame:
    """df written in n buckets of its bins, so that rounds move no edges."""
    name = f"ripplerank_{uuid.uuid4().hex}"
    df.repartition(n, "bin").write.bucketBy(n, "bin").option("path", fresh(df.sparkSession, "bins")).saveAsTable(name)
    return df.sparkSession.table(name)


class Bins:
    """The components of packed.lay()'s blocks in bins; without weights a gene's value leaves it divided by its degree."""

    def __init__(self, homes: DataFrame, laid: DataFrame, n: int, scaled: bool):
        self.n, self.scaled = n, scaled

        def part(own: pd.DataFrame, homes: pd.DataFrame) -> pd.DataFrame:
            if not len(own):
                return pd.DataFrame([], columns=["bin", "first", "genes", "counts", "need", "src", "val"])
            r = own.iloc[0]
            genes, counts, need, src = np.frombuffer(r["genes"], np.int64), np.frombuffer(r["counts"], np.int32), np.frombuffer(r["need"], np.int64), np.frombuffer(r["src"], np.int32)
            of, rows = homes.sort_values("gene")["bin"].to_numpy(), []
            for b in np.unique(of):
                keep = of == b
                edges = np.repeat(keep, counts)
                some, at = np.unique(src[edges], return_inverse=True)
                val = np.frombuffer(r["val"])[edges].tobytes() if len(r["val"]) else b""
                rows.append((int(b), int(genes[keep][0]), genes[keep].tobytes(), counts[keep].tobytes(), need[some].tobytes(), at.astype(np.int32).tobytes(), val))
            return pd.DataFrame(rows, columns=["bin", "first", "genes", "counts", "need", "src", "val"])

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("first")
            genes = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["genes"]])
            src = []
            for need, at in zip(pdf["need"], pdf["src"], strict=True):
                need = np.frombuffer(need, np.int64)
                place = np.minimum(np.searchsorted(genes, need), len(genes) - 1)
                if (genes[place] != need).any():
                    raise ValueError("a gene that edges leave is reached by none")
                src.append(place.astype(np.int32)[np.frombuffer(at, np.int32)])
            return pd.DataFrame({"bin": pdf["bin"].iloc[:1], "genes": [genes.tobytes()], "counts": [b"".join(pdf["counts"])], "src": [np.concatenate(src).tobytes()], "val": [b"".join(pdf["val"])]})

        parts = laid.select("block", "genes", "counts", "need", "src", "val").groupBy("block").cogroup(homes.groupBy("block")).applyInPandas(part, _PART)
        self.held = _bucketed(parts.repartition(n, "bin").groupBy("bin").applyInPandas(merge, _BIN), 2 * n)
        #: (gene, bin)
        self.genes = cut(homes.select("gene", "bin"), "homes")

    def meet(self, rows: DataFrame, run, out: str) -> DataFrame:
        """run(bin's arrays, its rows) for every bin."""
        scaled = self.scaled
        return self.held.groupBy("bin").cogroup(rows.groupBy("bin")).applyInPandas(lambda held, pdf: run(_Bin(held.iloc[0], scaled), pdf), out)

    def meet_in(self, groups: int, rows: DataFrame, run, out: str) -> DataFrame:
        """run(bin's arrays, its rows, group) for every bin and group of columns; rows have a slot, whose remainder is its group."""
        scaled, n = self.scaled, 2 * self.n * groups
        held = self.held.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartition(n, "bin", "group")
        rows = rows.withColumn("group", (F.col("slot") % groups).cast("int")).repartition(n, "bin", "group")

        def one(held: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
            return run(_Bin(held.iloc[0], scaled), pdf, int(held["group"].iloc[0]))

        return held.groupBy("bin", "group").cogroup(rows.groupBy("bin", "group")).applyInPandas(one, out)


def deal(laid: DataFrame, scaled: bool = True) -> Bins | None:
    """The bins of packed.lay()'s blocks, or None where a component is larger than WHOLE_EDGES."""
    from .graph import components

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for b, raw, counts in zip(frame["block"], frame["genes"], frame["counts"], strict=True):
                yield pd.DataFrame({"gene": np.frombuffer(raw, np.int64), "block": np.int32(b), "n": np.frombuffer(counts, np.int32)})

    genes = laid.select("block", "genes", "counts").mapInPandas(spread, "gene long, block int, n int")
    comp = cut(components(cut(stars(laid), "stars"), "joins").join(genes, "gene"), "components")
    sizes = cut(comp.groupBy("component").agg(F.sum("n").alias("n")), "sizes")
    most = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("edges")).first()
    if not most["edges"] or most["most"] > WHOLE_EDGES:
        return None
    size = min(packed.BLOCK_EDGES, max(1, most["edges"] // (2 * laid.sparkSession.sparkContext.defaultParallelism)))
    bins = cut(numbered(sizes, ["component"], "n").select("component", F.floor(F.col("_before") / size).alias("_bin")), "bins")
    named = by_group(bins.select("_bin").distinct(), [], ["_bin"]).select("_bin", (F.col("_place") - 1).cast("int").alias("bin"))
    homes = cut(comp.join(bins.join(named, "_bin").select("component", "bin"), "component").select("gene", "block", "bin"), "homes")
    return Bins(homes, laid, homes.agg(F.max("bin")).first()[0] + 1, scaled)


class _Bin:
    """The arrays of one bin in its task."""

    def __init__(self, r, scaled: bool):
        self.id = int(r["bin"])
        self.genes, self.src, self.counts = np.frombuffer(r["genes"], np.int64), np.frombuffer(r["src"], np.int32), np.frombuffer(r["counts"], np.int32)
        self.val = np.frombuffer(r["val"]) if len(r["val"]) else None
        self.starts = np.r_[0, np.cumsum(self.counts[:-1], dtype=np.int64)]
        self.scale = 1.0 / self.counts if scaled and self.val is None else None

    def step(self, x: np.ndarray) -> np.ndarray:
        """W'x."""
        x = x if self.scale is None else x * self.scale
        return np.add.reduceat(x[self.src] if self.val is None else x[self.src] * self.val, self.starts)

    def places(self, genes: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.genes, genes), len(self.genes) - 1)


def _groups(bins: Bins, columns: int) -> int:
    """Groups of columns, so that few bins keep every core at work."""
    return max(1, min(columns, -(-4 * bins.held.sparkSession.sparkContext.defaultParallelism // bins.n)))


def series(bins: Bins, p0: DataFrame, kind, alphas: tuple[float, ...], tol: float, max_iter: int, only: DataFrame | None) -> DataFrame:
    """(col, alpha, gene, score, n_iter, converged) of graph.rwr_series() from p0 (col, gene, p0).

    With a tol, bins first tell how far each round moves their part of a column, until their parts cannot matter any more: the sums say where a column stops. Then the scores are made in one go.
    """
    spark = p0.sparkSession
    dealt = cut(by_group(p0.select("col").distinct(), [], ["col"]).select("col", (F.col("_place") - 1).cast("int").alias("slot")), "columns")
    columns = dealt.count()
    groups = _groups(bins, columns)
    seeds = cut(p0.join(bins.genes, "gene").join(dealt, "col").select("bin", "slot", F.col("gene").cast("long").alias("gene"), "p0"), "seeds")

    def begin(b: _Bin, own: pd.DataFrame) -> np.ndarray:
        x = np.zeros(len(b.genes))
        x[np.searchsorted(b.genes, own["gene"].to_numpy())] = own["p0"].to_numpy()
        return x

    stops = _stops(bins, seeds, groups, columns, begin, alphas, tol, max_iter) if tol > 0 else {}
    ends = [(s, a, *stops.get((s, a), (max_iter, None))) for s in range(columns) for a in alphas]
    last, whole = np.array([e[2] for e in ends]).reshape(columns, len(alphas)), only is None

    def end(b: _Bin, pdf: pd.DataFrame, group: int) -> pd.DataFrame:
        seeded = dict(iter(pdf[pdf["p0"].notna()].groupby("slot")))
        asked = None if whole else dict(iter(pdf[pdf["p0"].isna()].groupby("slot")["gene"]))
        slots, genes, scores = [], [], []
        for s in range(group, columns, groups) if whole else sorted(asked):
            gene = b.genes if whole else np.unique(asked[s].to_numpy(np.int64))
            at = b.places(gene)
            score = np.zeros((len(alphas), len(gene)))
            if s in seeded:
                x = begin(b, seeded[s])
                for k in range(int(last[s].max()) + 1):
                    x = b.step(x) if k else x
                    for i, a in enumerate(alphas):
                        if k <= last[s, i]:
                            score[i] += (a if k < last[s, i] else 1.0) * (1 - a) ** k * x[at]
                score[:, b.genes[at] != gene] = 0.0
            slots.append(np.full(len(gene), s, np.int32))
            genes.append(gene)
            scores.append(score)
        if not slots:
            return pd.DataFrame([], columns=["slot", "alpha", "gene", "score"])
        slot, gene, score = np.concatenate(slots), np.concatenate(genes), np.concatenate(scores, axis=1)
        return pd.DataFrame({"slot": np.tile(slot, len(alphas)), "alpha": np.repeat(np.array(alphas), len(slot)), "gene": np.tile(gene, len(alphas)), "score": score.ravel()})

    rows = seeds
    if only is not None:  # genes outside the network score 0 somewhere
        asks = only.select("col", F.col("gene").cast("long").alias("gene")).join(dealt, "col").join(bins.genes, "gene", "left")
        rows = seeds.unionByName(asks.select(F.coalesce("bin", F.lit(0)).alias("bin"), "slot", "gene", F.lit(None).cast("double").alias("p0")))
    part = bins.meet_in(groups, rows, end, "slot int, alpha double, gene long, score double")
    named = spark.createDataFrame(ends, "slot int, alpha double, n_iter int, converged boolean").join(dealt, "slot")  # a row a column and alpha
    return part.join(F.broadcast(named), ["slot", "alpha"]).select("col", "alpha", F.col("gene").cast(kind).alias("gene"), "score", "n_iter", "converged")


def _stops(bins: Bins, seeds: DataFrame, groups: int, columns: int, begin, alphas: tuple[float, ...], tol: float, max_iter: int) -> dict:
    """{(slot, alpha): (n_iter, converged)}. A bin leaves off where its part moves by less than an eighth of its share of tol; what it does not tell lies between 0 and its last (parts move ever less). Where that leaves a stop open, more rounds are told."""
    slow, share, least = 1 - min(alphas), tol / (8 * bins.n), 1
    while True:

        def gaps(b: _Bin, pdf: pd.DataFrame, group: int) -> pd.DataFrame:
            rows = []
            for s, own in pdf.groupby("slot"):
                x, told = begin(b, own), []
                while len(told) < max_iter and (len(told) < least or slow ** len(told) * told[-1] >= share):  # noqa: B023
                    y = b.step(x)
                    told.append(float(np.abs(y - x).sum()))
                    x = y
                rows.append((s, told))
            return pd.DataFrame(rows, columns=["slot", "told"])

        told = cut(bins.meet_in(groups, seeds, gaps, "slot int, told array<double>"), "gaps")
        rounds = told.agg(F.max(F.size("told"))).first()[0]
        each = told.select("slot", "told", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("k"))
        low, high = F.get("told", F.col("k") - 1), F.element_at("told", F.least("k", F.size("told")))
        sums = each.groupBy("slot", "k").agg(F.sum(F.coalesce(low, F.lit(0.0))).alias("low"), F.sum(high).alias("high")).collect()  # a row a column and round
        lows, highs = np.zeros((columns, rounds + 1)), np.zeros((columns, rounds + 1))
        for r in sums:
            lows[r["slot"], r["k"]], highs[r["slot"], r["k"]] = r["low"], r["high"]
        stops, sure = {}, True
        for i in range(columns):
            for a in alphas:
                for n in range(1, rounds + 1):
                    if (1 - a) ** n * lows[i, n] < tol:
                        stops[i, a] = n, True
                        sure &= bool((1 - a) ** n * highs[i, n] < tol)
                        break
                else:
                    stops[i, a] = rounds, False
                    sure &= rounds == max_iter
        if sure:
            return stops
        least = min(rounds + 1, max_iter) if least >= rounds else rounds


def reach(bins: Bins, sources: DataFrame, words: int) -> DataFrame:
    """(gene, distance, n) of graph.reach_counts() from sources (gene): they are bits, `words` of 64 at a time."""

    def run(b: _Bin, pdf: pd.DataFrame) -> pd.DataFrame:
        at, found = np.searchsorted(b.genes, np.sort(pdf["gene"].to_numpy(np.int64))), {}
        for lo in range(0, len(at), 64 * words):
            some = at[lo : lo + 64 * words]
            new = np.zeros((-(-len(some) // 64), len(b.genes)), np.uint64)
            place = np.arange(len(some))
            new[place // 64, some] = np.uint64(1) << (place % 64).astype(np.uint64)
            seen, d = new.copy(), 0
            while new.any():
                found[d] = found.get(d, 0) + sum(np.bitwise_count(w).astype(np.int64) for w in new)
                new = np.stack([np.bitwise_or.reduceat(w[b.src], b.starts) for w in new]) & ~seen
                seen |= new
                d += 1
        frames = [pd.DataFrame({"gene": b.genes[n > 0], "distance": np.int32(d), "n": n[n > 0]}) for d, n in found.items()]
        return pd.concat(frames) if frames else pd.DataFrame([], columns=["gene", "distance", "n"])

    return bins.meet(sources.select(F.col("gene").cast("long").alias("gene")).distinct().join(bins.genes, "gene"), run, "gene long, distance int, n long")


def hops(bins: Bins, sources: DataFrame, max_depth: int | None) -> DataFrame:
    """(source, gene, distance) of graph.bfs() from (source, gene)."""
    dealt = cut(by_group(sources.select("source").distinct(), [], ["source"]).select("source", (F.col("_place") - 1).cast("int").alias("slot")), "sources")
    starts = sources.select("source", F.col("gene").cast("long").alias("gene")).distinct().join(dealt, "source").join(bins.genes, "gene").select("bin", "slot", "gene")

    def run(b: _Bin, pdf: pd.DataFrame, group: int) -> pd.DataFrame:
        frames = []
        for s, own in pdf.groupby("slot"):
            distance = np.full(len(b.genes), -1, np.int32)
            distance[np.searchsorted(b.genes, own["gene"].to_numpy())] = 0
            d = 0
            while max_depth is None or d < max_depth:
                new = (distance < 0) & np.logical_or.reduceat((distance == d)[b.src], b.starts)
                d += 1
                if not new.any():
                    break
                distance[new] = d
            here = distance >= 0
            frames.append(pd.DataFrame({"slot": np.int32(s), "gene": b.genes[here], "distance": distance[here]}))
        return pd.concat(frames) if frames else pd.DataFrame([], columns=["slot", "gene", "distance"])

    found = bins.meet_in(_groups(bins, max(dealt.count(), 1)), starts, run, "slot int, gene long, distance int")
    return found.join(dealt, "slot").select("source", "gene", "distance")


def propagate_labels(bins: Bins, rounds: int) -> DataFrame:
    """(gene, community) of graph.label_propagation()."""

    def run(b: _Bin, pdf: pd.DataFrame) -> pd.DataFrame:
        n = len(b.genes)
        label = np.arange(n)
        dst = np.concatenate((np.repeat(np.arange(n), b.counts), np.arange(n))) * n
        for _ in range(rounds):
            key, votes = np.unique(dst + np.concatenate((label[b.src], label)), return_counts=True)
            order = np.lexsort((key % n, -votes, key // n))
            first = np.r_[True, np.diff(key[order] // n) > 0]
            label = key[order][first] % n
        return pd.DataFrame({"gene": b.genes, "community": b.genes[label]})

    return bins.meet(bins.genes.select("bin").distinct(), run, "gene long, community long")
