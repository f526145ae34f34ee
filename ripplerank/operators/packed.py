"""Rounds over a network of any size that lies packed in blocks of genes.

A block holds the edges into a range of genes as arrays, and a round is one cogroup of the blocks with what they were sent: one row for each two blocks that share edges, with the values that the other one needs, never a row an
edge. The blocks are written once as a bucketed table, so that rounds shuffle values and no edges.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import Steps, cut, fresh, swept
from .ranks import by_group

#: Directed edges of a block, about; and values that a block may need at once, which bounds how many columns go together.
BLOCK_EDGES, BLOCK_VALUES = 2_000_000, 8_000_000
#: What a row of a round is, by its sender: a block's own state, its partial sums, its last state, the places (slot, gene) that are asked for, their scores so far; or values of another block.
STATE, SUMS, LAST, ASKED, SCORE = -1, -2, -3, -4, -5

_LAID = "block int, lo long, hi long, genes binary, counts binary, need binary, src binary, val binary"
_HELD = "block int, to int, start int, data binary, n_need int, genes binary, counts binary, val binary"
_SENT = "block int, sender int, start int, data binary"


def fits(genes: T.DataType) -> bool:
    """Whether genes can be packed: whole numbers."""
    return isinstance(genes, T.LongType | T.IntegerType | T.ShortType)


def _wanted(e: DataFrame) -> int:
    return max(-(-e.count() // BLOCK_EDGES), 2 * e.sparkSession.sparkContext.defaultParallelism)


def lay(e: DataFrame) -> DataFrame:
    """The edges (src, dst) or (src, dst, w) in blocks of ranges of dst, a row a block, written."""
    weighted = "w" in e.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [f for f in batches if len(f)]
        if not frames:
            return
        src, dst = (np.concatenate([f[c].to_numpy(np.int64) for f in frames]) for c in ("src", "dst"))
        val = np.concatenate([f["w"].to_numpy(float) for f in frames]) if weighted else None
        order = np.lexsort((src, dst))
        genes, counts = np.unique(dst, return_counts=True)
        need, at = np.unique(src[order], return_inverse=True)
        yield pd.DataFrame({"block": [TaskContext.get().partitionId()], "lo": [genes[0]], "hi": [genes[-1]], "genes": [genes.tobytes()], "counts": [counts.astype(np.int32).tobytes()], "need": [need.tobytes()], "src": [at.astype(np.int32).tobytes()], "val": [val[order].tobytes() if weighted else b""]})

    return cut(e.repartitionByRange(_wanted(e), "dst").mapInPandas(run, _LAID), "laid")


class Blocks:
    """The packed blocks of (src, dst) or (src, dst, w); without w a gene's value leaves it divided by its degree, or whole (`even`). `laid`: lay() of the edges, where it is there already."""

    def __init__(self, e: DataFrame, even: bool = False, laid: DataFrame | None = None):
        spark = e.sparkSession
        weighted = "w" in e.columns
        laid = lay(e) if laid is None else laid
        about = laid.select("block", "lo", "hi", (F.length("need") / 8).cast("int").alias("need"), (F.length("genes") / 8).cast("int").alias("n")).orderBy("lo").collect()  # a row a block
        wanted = max(len(about), 2 * spark.sparkContext.defaultParallelism)
        self.n_genes, self.most = sum(r["n"] for r in about), max((max(r["need"], r["n"]) for r in about), default=1)
        self.scaled = not weighted and not even
        block, lo, hi = (np.array([r[c] for r in about], np.int64) for c in ("block", "lo", "hi"))

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                for to, raw in zip(frame["block"], frame["need"], strict=True):
                    need = np.frombuffer(raw, np.int64)
                    home = np.searchsorted(lo, need, "right") - 1
                    if (home < 0).any() or (need > hi[home]).any():
                        raise ValueError("a gene that edges leave is reached by none")
                    first = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
                    ends = np.r_[first[1:], len(need)]
                    yield pd.DataFrame({"block": block[home[first]].astype(np.int32), "to": np.int32(to), "start": first.astype(np.int32), "ids": [need[a:b].tobytes() for a, b in zip(first, ends, strict=True)]})

        def route(own: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
            genes = np.frombuffer(own["genes"].iloc[0], np.int64)
            at = [np.searchsorted(genes, np.frombuffer(ids, np.int64)).astype(np.int32).tobytes() for ids in asks["ids"]]
            return pd.DataFrame({"block": asks["block"], "to": asks["to"], "start": asks["start"], "data": at, "n_need": 0, "genes": b"", "counts": b"", "val": b""})

        asks = laid.select("block", "need").mapInPandas(ask, "block int, to int, start int, ids binary")
        routes = laid.select("block", "genes").groupBy("block").cogroup(asks.groupBy("block")).applyInPandas(route, _HELD)
        main = laid.select("block", F.lit(-1).alias("to"), F.lit(0).alias("start"), F.col("src").alias("data"), (F.length("need") / 8).cast("int").alias("n_need"), "genes", "counts", "val")
        name = f"ripplerank_{uuid.uuid4().hex}"
        with swept(spark):
            main.unionByName(routes).repartition(wanted, "block").write.bucketBy(wanted, "block").option("path", fresh(spark, "blocks")).saveAsTable(name)
        self.held = spark.table(name)

        def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                for b, raw in zip(frame["block"], frame["genes"], strict=True):
                    yield pd.DataFrame({"gene": np.frombuffer(raw, np.int64), "block": np.int32(b)})

        #: (gene, block)
        self.genes = cut(laid.select("block", "genes").mapInPandas(spread, "gene long, block int"), "homes")

    def meet(self, rows: DataFrame, run, out: str) -> DataFrame:
        """run(block's arrays, its rows) for every block."""
        scaled = self.scaled
        return self.held.groupBy("block").cogroup(rows.groupBy("block")).applyInPandas(lambda held, pdf: run(_Block(held, scaled), pdf), out)


class _Block:
    """The arrays of one block in its task."""

    def __init__(self, held: pd.DataFrame, scaled: bool):
        own = held[held["to"] == -1].iloc[0]
        self.id, self.need = int(own["block"]), int(own["n_need"])
        self.genes, self.src, self.counts = np.frombuffer(own["genes"], np.int64), np.frombuffer(own["data"], np.int32), np.frombuffer(own["counts"], np.int32)
        self.val = np.frombuffer(own["val"]) if len(own["val"]) else None
        self.starts = np.r_[0, np.cumsum(self.counts[:-1], dtype=np.int64)]
        self.scale = 1.0 / self.counts if scaled else None
        to = held[held["to"] >= 0]
        self.routes = [(int(b), int(s), np.frombuffer(d, np.int32)) for b, s, d in zip(to["to"], to["start"], to["data"], strict=True)]

    def leaving(self, x: np.ndarray) -> np.ndarray:
        return x if self.scale is None else x * self.scale

    def got(self, pdf: pd.DataFrame, columns: int) -> tuple[np.ndarray, np.ndarray]:
        """(state, values needed) of the rows that the block was sent."""
        state, x = np.zeros((columns, len(self.genes))), np.zeros((columns, self.need))
        for sender, start, raw in zip(pdf["sender"], pdf["start"], pdf["data"], strict=True):
            if sender == STATE:
                state = np.frombuffer(raw).reshape(columns, -1)
            elif sender >= 0:
                part = np.frombuffer(raw).reshape(columns, -1)
                x[:, start : start + part.shape[1]] = part
        out = self.leaving(state)
        for to, start, at in self.routes:
            if to == self.id:
                x[:, start : start + len(at)] = out[:, at]
        return state, x

    def sums(self, x: np.ndarray) -> np.ndarray:
        """For each gene the sum over its edges, column by column."""
        y = np.zeros((len(x), len(self.genes)))
        for i, c in enumerate(x):
            if c.any():
                y[i] = np.add.reduceat(c[self.src] if self.val is None else c[self.src] * self.val, self.starts)
        return y

    def sent(self, y: np.ndarray, *more: tuple[int, np.ndarray]) -> pd.DataFrame:
        """The block's state, values for the others and more rows (sender, data) for itself."""
        rows = [(self.id, s, 0, d.tobytes()) for s, d in more]
        if y.any():
            out = self.leaving(y)
            rows += [(self.id, STATE, 0, y.tobytes())] + [(to, self.id, start, np.ascontiguousarray(out[:, at]).tobytes()) for to, start, at in self.routes if to != self.id]
        return pd.DataFrame(rows, columns=["block", "sender", "start", "data"])


def _total(rows: DataFrame) -> np.ndarray:
    """The partial sums of all blocks, a row a block, added up."""
    return sum((np.frombuffer(r["data"]) for r in rows.where(F.col("sender") == SUMS).select("block", "data").orderBy("block").collect()), np.zeros(1))


def series(e: DataFrame, p0: DataFrame, alphas: tuple[float, ...], tol: float, max_iter: int, only: DataFrame | None, laid: DataFrame | None = None) -> DataFrame:
    """(col, alpha, gene, score, n_iter, converged) of graph.rwr_series() over (src, dst, w or none) from p0 (col, gene, p0)."""
    spark, kind = e.sparkSession, e.schema["src"].dataType
    net = Blocks(e, laid=laid)
    dealt = cut(by_group(p0.select("col").distinct(), [], ["col"]).select("col", (F.col("_place") - 1).cast("int").alias("slot")), "columns")
    columns, width = dealt.count(), max(1, BLOCK_VALUES // net.most)
    seeds = cut(p0.join(net.genes, "gene").join(dealt, "col").select("block", "slot", F.col("gene").cast("long").alias("gene"), "p0"), "seeds")
    grid = away = None
    if only is not None:
        asks = cut(only.select("col", F.col("gene").cast("long").alias("gene")).distinct().join(dealt, "col").join(net.genes, "gene", "left").select("block", "slot", "gene"), "grid")
        grid, away = asks.where("block is not null"), asks.where("block is null")  # genes outside the network score 0
    out = None
    for lo in range(0, columns, width):
        n = min(width, columns - lo)
        some = lambda d: d.where(F.col("slot").between(lo, lo + n - 1)).withColumn("slot", F.col("slot") - lo)  # noqa: B023, E731
        part, ends = _columns(net, some(seeds), n, alphas, tol, max_iter, some(grid) if grid is not None else None)
        ends = spark.createDataFrame([(s + lo, *r) for s, *r in ends], "slot int, alpha double, n_iter int, converged boolean")
        named = F.broadcast(dealt.join(ends, "slot"))  # a row a column and alpha
        if away is not None:
            part = part.unionByName(some(away).select("slot", F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha"), "gene", F.lit(0.0).alias("score")))
        part = part.withColumn("slot", F.col("slot") + lo).join(named, ["slot", "alpha"]).select("col", "alpha", F.col("gene").cast(kind).alias("gene"), "score", "n_iter", "converged")
        out = part if out is None else out.unionByName(part)
    return out


def _columns(net: Blocks, seeds: DataFrame, columns: int, alphas: tuple[float, ...], tol: float, max_iter: int, grid: DataFrame | None) -> tuple[DataFrame, list[tuple]]:
    """((slot, alpha, gene, score), [(slot, alpha, n_iter, converged)]) of columns that go together.

    Scores are added up round by round where the genes lie, only those that are asked for, so no more than two rounds are ever on disk.
    """
    steps, stops, whole = Steps(seeds.sparkSession, "series"), {}, grid is None
    first = seeds.select("block", "slot", "gene", "p0")
    if grid is not None:
        first = first.unionByName(grid.select("block", "slot", "gene", F.lit(None).cast("double").alias("p0")))

    def begin(b: _Block, pdf: pd.DataFrame) -> pd.DataFrame:
        own, asked = pdf[pdf["p0"].notna()], pdf[pdf["p0"].isna()]
        x = np.zeros((columns, len(b.genes)))
        x[own["slot"].to_numpy(), np.searchsorted(b.genes, own["gene"].to_numpy())] = own["p0"].to_numpy()
        if whole:
            return b.sent(x)
        places = np.stack([asked["slot"].to_numpy(), np.searchsorted(b.genes, asked["gene"].to_numpy(np.int64))]).astype(np.int32)
        return b.sent(x, (ASKED, places), (SCORE, np.zeros((len(alphas), len(asked))))) if len(asked) else b.sent(x)

    def weights(k: int) -> np.ndarray:
        """What x(k) counts for in the score of each alpha and column, once it is known which of them stop at k."""
        ends = np.array([[stops.get((s, a), max_iter) for s in range(columns)] for a in alphas])
        a = np.array(alphas)[:, None]
        return np.where(k < ends, a, 1.0) * (1 - a) ** k * (k <= ends)

    def scored(b: _Block, pdf: pd.DataFrame, state: np.ndarray, weight: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The rows that hold the scores, with x(k) added."""
        held = {s: d for s, d in zip(pdf["sender"], pdf["data"], strict=True) if s in (ASKED, SCORE)}
        if whole:
            score = np.frombuffer(held[SCORE]).reshape(len(alphas), columns, -1) if SCORE in held else 0.0
            score = score + weight[:, :, None] * state
            return [(SCORE, score)] if score.any() else []
        if ASKED not in held:
            return []
        asked = np.frombuffer(held[ASKED], np.int32).reshape(2, -1)
        (slot, at), score = asked, np.frombuffer(held[SCORE]).reshape(len(alphas), -1)
        return [(ASKED, asked), (SCORE, score + weight[:, slot] * state[slot, at])]

    rows, n = steps.put(net.meet(first, begin, _SENT)), 0
    while n < max_iter and len(stops) < columns * len(alphas):
        weight = weights(n)

        def step(b: _Block, pdf: pd.DataFrame) -> pd.DataFrame:
            state, x = b.got(pdf, columns)
            y = b.sums(x)
            return b.sent(y, *([(SUMS, np.abs(y - state).sum(axis=1))] if tol > 0 else []), *scored(b, pdf, state, weight))  # noqa: B023

        n += 1
        rows = steps.put(net.meet(rows, step, _SENT))
        if tol > 0:
            gap = np.broadcast_to(_total(rows), columns)
            for a in alphas:
                for s in np.flatnonzero((1 - a) ** n * gap < tol).tolist():
                    stops.setdefault((s, a), n)
    ends = [(s, a, stops.get((s, a), n), (s, a) in stops if tol > 0 else None) for s in range(columns) for a in alphas]
    weight = weights(n)

    def end(b: _Block, pdf: pd.DataFrame) -> pd.DataFrame:
        state = np.zeros((columns, len(b.genes)))
        for raw in pdf["data"][pdf["sender"] == STATE]:
            state = np.frombuffer(raw).reshape(columns, -1)
        held = dict(scored(b, pdf, state, weight))
        if whole:
            slot, gene = np.repeat(np.arange(columns), len(b.genes)), np.tile(b.genes, columns)
            score = held.get(SCORE, np.zeros((len(alphas), len(slot))))
        elif ASKED in held:
            (slot, at), score = held[ASKED], held[SCORE]
            gene = b.genes[at]
        else:
            return pd.DataFrame([], columns=["slot", "alpha", "gene", "score"])
        return pd.DataFrame({"slot": np.tile(slot, len(alphas)).astype(np.int32), "alpha": np.repeat(np.array(alphas), len(slot)), "gene": np.tile(gene, len(alphas)), "score": score.ravel()})

    mine = rows.where(F.col("sender").isin(STATE, ASKED, SCORE))
    out = cut(net.meet(mine, end, "slot int, alpha double, gene long, score double"), "scores")
    steps.drop()
    return out, ends


def power(e: DataFrame, kind: str, rounds: int, damping: float, tol: float) -> DataFrame:
    """(gene, score) of graph.power_iteration() over (src, dst). A round sends its scores before their length is known; the next one divides by it."""
    net, genes = Blocks(e, even=kind == "eigenvector"), e.schema["src"].dataType
    n, norm = max(net.n_genes, 1), 1.0
    least = 0.0 if kind == "eigenvector" else (1 - damping) / n

    def begin(b: _Block, pdf: pd.DataFrame) -> pd.DataFrame:
        return b.sent(np.full((1, len(b.genes)), 1.0 / n))

    def step(b: _Block, pdf: pd.DataFrame) -> pd.DataFrame:
        state, x = b.got(pdf, 1)
        p = state / norm
        old = pdf[pdf["sender"] == LAST]["data"]
        moved = np.abs(p[0] - np.frombuffer(old.iloc[0])).sum() if len(old) else np.inf
        y = b.sums(x / norm) + p if kind == "eigenvector" else least + damping * b.sums(x)
        return b.sent(y, (SUMS, np.array([moved, (y * y).sum()])), (LAST, p[0]))

    def end(b: _Block, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"gene": b.genes, "score": np.frombuffer(pdf["data"].iloc[0]) / norm})

    # Whether round k moved by less than tol is known in round k + 1, which keeps its scores.
    steps, done = Steps(e.sparkSession, "power"), False
    rows = steps.put(net.meet(net.genes.select("block").distinct(), begin, _SENT))
    for k in range(rounds + (1 if tol else 0)):
        rows = steps.put(net.meet(rows, step, _SENT))
        moved, square = np.broadcast_to(_total(rows), 2)
        norm = float(np.sqrt(square)) if kind == "eigenvector" else 1.0
        if tol and k and moved < tol:
            done = True
            break
    if tol and net.n_genes and not done:
        raise RuntimeError(f"{kind}: no convergence to {tol} in {rounds} rounds")
    if done:
        norm = 1.0
    out = net.meet(rows.where(F.col("sender") == (LAST if done else STATE)), end, "gene long, score double")
    return out.select(F.col("gene").cast(genes).alias("gene"), "score")


def cores(e: DataFrame) -> DataFrame:
    """(gene, core) of (src, dst), every edge from either end: a gene's number begins as its degree and falls to the largest h that h of its neighbours reach, until none falls; what is left are the core numbers."""
    net, genes = Blocks(e, even=True), e.schema["src"].dataType

    def begin(b: _Block, pdf: pd.DataFrame) -> pd.DataFrame:
        return b.sent(b.counts[None].astype(float))

    def step(b: _Block, pdf: pd.DataFrame) -> pd.DataFrame:
        state, x = b.got(pdf, 1)
        near = x[0].astype(np.int64)[b.src]
        most = int(near.max()) + 1
        sizes = b.counts.astype(np.int64)
        falling = most - 1 - np.sort(np.repeat(np.arange(len(sizes)), sizes) * most + (most - 1 - near)) % most  # in each gene's own stretch
        place = np.arange(len(near)) - np.repeat(b.starts, sizes) + 1
        y = np.minimum(state, np.add.reduceat((falling >= place).astype(np.int64), b.starts))
        return b.sent(y, (SUMS, np.array([float((y < state).sum())])))

    def end(b: _Block, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"gene": b.genes, "core": np.frombuffer(pdf["data"].iloc[0]).astype(np.int32)})

    steps = Steps(e.sparkSession, "cores")
    rows = steps.put(net.meet(net.genes.select("block").distinct(), begin, _SENT))
    while net.n_genes:
        rows = steps.put(net.meet(rows, step, _SENT))
        if not _total(rows)[0]:
            break
    out = net.meet(rows.where(F.col("sender") == STATE), end, "gene long, core int")
    return out.select(F.col("gene").cast(genes).alias("gene"), "core")


def _packed(cols: np.ndarray, *arrays: np.ndarray) -> bytes:
    """Columns and their arrays, a row a column."""
    return b"".join([np.int32(len(cols)).tobytes(), np.asarray(cols, np.int32).tobytes(), *[a.tobytes() for a in arrays]])


def _unpacked(raw: bytes, *kinds: str) -> tuple[np.ndarray, ...]:
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    cols, at = np.frombuffer(raw, np.int32, n, 4), 4 + 4 * n
    many = (len(raw) - at) // sum(np.dtype(k).itemsize for k in kinds)
    out = [cols]
    for k in kinds:
        out.append(np.frombuffer(raw, k, many, at).reshape(n, -1).copy())
        at += many * np.dtype(k).itemsize
    return tuple(out)


def dependencies(e: DataFrame, picked: DataFrame) -> DataFrame:
    """(gene, part) of (src, dst), every edge from either end: for each picked gene the share of its shortest paths that run through each other gene, summed in lots of sources; genes without any are absent.

    A source is a column. Rounds out count the paths to each next level, rounds back pass the shares level by level; a block holds and sends the columns that have reached it only.
    """
    net, kind = Blocks(e, even=True), e.schema["src"].dataType
    placed = by_group(picked.select(F.col("gene").cast("long").alias("gene")).distinct(), [], ["gene"]).select("gene", (F.col("_place") - 1).cast("int").alias("slot"))
    starts = cut(placed.join(net.genes, "gene"), "sources")
    columns, width, out = starts.count(), max(1, BLOCK_VALUES // net.most), None
    for lo in range(0, columns, width):
        part = _paths(net, starts.where(F.col("slot").between(lo, lo + width - 1)))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return picked.select("gene", F.lit(0.0).alias("part")).limit(0)
    return out.select(F.col("gene").cast(kind).alias("gene"), "part")


def _paths(net: Blocks, starts: DataFrame) -> DataFrame:
    def leaving(depth: np.ndarray, paths: np.ndarray, owed: np.ndarray, level: int, back: bool) -> np.ndarray:
        here = depth == level
        return np.where(here, (1 + owed) / np.where(here, paths, 1.0), 0.0) if back else np.where(here, paths, 0.0)

    def sent(b: _Block, cols, depth, paths, owed, level: int, back: bool, new: int) -> pd.DataFrame:
        rows = [(b.id, SUMS, 0, np.array([float(new)]).tobytes()), (b.id, STATE, 0, _packed(cols, depth, paths, owed))]
        x = leaving(depth, paths, owed, level, back)
        for to, start, at in b.routes:
            if to != b.id:
                some = x[:, at]
                live = np.flatnonzero(some.any(axis=1))
                if len(live):
                    rows.append((to, b.id, start, _packed(cols[live], some[live])))
        return pd.DataFrame(rows, columns=["block", "sender", "start", "data"])

    def begin(b: _Block, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame([], columns=["block", "sender", "start", "data"])
        cols = pdf["slot"].to_numpy(np.int32)
        depth, paths = np.full((len(cols), len(b.genes)), -1, np.int16), np.zeros((len(cols), len(b.genes)))
        at = np.arange(len(cols)), np.searchsorted(b.genes, pdf["gene"].to_numpy())
        depth[at], paths[at] = 0, 1.0
        return sent(b, cols, depth, paths, np.zeros_like(paths), 0, False, len(cols))

    def step(level: int, back: bool, turn: bool = False):
        """The round that fills a level: from the one before it or, back, from the one behind it. Where the paths turn back nothing is filled."""

        def run(b: _Block, pdf: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf):
                return pd.DataFrame([], columns=["block", "sender", "start", "data"])
            own = pdf[pdf["sender"] == STATE]["data"]
            none = np.zeros((0, len(b.genes)))
            cols, depth, paths, owed = _unpacked(own.iloc[0], "i2", "f8", "f8") if len(own) else (np.zeros(0, np.int32), none.astype(np.int16), none, none)
            if turn:
                return sent(b, cols, depth, paths, owed, level, back, 0)
            got: dict[int, list] = {}
            for sender, start, raw in zip(pdf["sender"], pdf["start"], pdf["data"], strict=True):
                if sender >= 0:
                    for c, values in zip(*_unpacked(raw, "f8"), strict=True):
                        got.setdefault(int(c), []).append((start, values))
            x = leaving(depth, paths, owed, level + 1 if back else level - 1, back)
            for to, start, at in b.routes:
                if to == b.id:
                    some = x[:, at]
                    for i in np.flatnonzero(some.any(axis=1)):
                        got.setdefault(int(cols[i]), []).append((start, some[i]))
            extra = np.array(sorted(set(got) - set(cols.tolist())), np.int32)
            if len(extra):
                more = np.zeros((len(extra), len(b.genes)))
                cols, depth = np.concatenate((cols, extra)), np.concatenate((depth, np.full(more.shape, -1, np.int16)))
                paths, owed = np.concatenate((paths, more)), np.concatenate((owed, more))
            row, new = {c: i for i, c in enumerate(cols.tolist())}, 0
            for c, parts in got.items():
                i, need = row[c], np.zeros(b.need)
                for start, values in parts:
                    need[start : start + len(values)] = values
                y = np.add.reduceat(need[b.src], b.starts)
                fill = (depth[i] == level) if back else (depth[i] < 0) & (y > 0)
                if back:
                    owed[i][fill] = paths[i][fill] * y[fill]
                else:
                    depth[i][fill], paths[i][fill] = level, y[fill]
                    new += int(fill.sum())
            return sent(b, cols, depth, paths, owed, level, back, new)

        return run

    def end(b: _Block, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame([], columns=["gene", "part"])
        _, depth, _, owed = _unpacked(pdf["data"].iloc[0], "i2", "f8", "f8")
        part = np.where(depth > 0, owed, 0.0).sum(axis=0)
        at = np.flatnonzero(part)
        return pd.DataFrame({"gene": b.genes[at], "part": part[at]})

    steps, level = Steps(starts.sparkSession, "paths"), 0
    rows = steps.put(net.meet(starts, begin, _SENT))
    while _total(rows)[0]:
        level += 1
        rows = steps.put(net.meet(rows, step(level, False), _SENT))
    level -= 1  # the last round found nothing
    rows = steps.put(net.meet(rows.where(F.col("sender") == STATE), step(level, True, True), _SENT))
    for k in range(level - 1, 0, -1):
        rows = steps.put(net.meet(rows, step(k, True), _SENT))
    return net.meet(rows.where(F.col("sender") == STATE), end, "gene long, part double")


_LISTS = "block int, a int, b int, us binary, sizes binary, near binary"


def triangles(o: DataFrame) -> DataFrame:
    """(gene, t) of (u, v), every edge once and no cycle among them: in how many triangles a gene is; genes in none are absent.

    A block holds the lists of a range of genes. Each two blocks with an edge from the one to the other meet in one task: the lists of the first that lead into the second, and those of the second that are asked for.
    """
    spark, kind = o.sparkSession, o.schema["u"].dataType
    wanted = max(-(-o.count() // (BLOCK_EDGES // 2)), 2 * spark.sparkContext.defaultParallelism)

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [f for f in batches if len(f)]
        if not frames:
            return
        u, v = (np.concatenate([f[c].to_numpy(np.int64) for f in frames]) for c in ("u", "v"))
        order = np.lexsort((v, u))
        us, sizes = np.unique(u, return_counts=True)
        yield pd.DataFrame({"block": [TaskContext.get().partitionId()], "lo": [us[0]], "us": [us.tobytes()], "sizes": [sizes.astype(np.int32).tobytes()], "near": [v[order].tobytes()]})

    laid = cut(o.repartitionByRange(wanted, "u").mapInPandas(lay, "block int, lo long, us binary, sizes binary, near binary"), "lists")
    about = laid.select("block", "lo").orderBy("lo").collect()  # a row a block
    block, lo = (np.array([r[c] for r in about], np.int64) for c in ("block", "lo"))

    def some(us: np.ndarray, sizes: np.ndarray, near: np.ndarray, keep: np.ndarray) -> dict:
        return {"us": us[keep].tobytes(), "sizes": sizes[keep].tobytes(), "near": near[np.repeat(keep, sizes)].tobytes()}

    def arrays(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(r["us"], np.int64), np.frombuffer(r["sizes"], np.int32), np.frombuffer(r["near"], np.int64)

    def ask(batches: Iterator[pd.DataFrame], ids: bool) -> Iterator[pd.DataFrame]:
        """The genes that a block asks of each other one, or its own lists that lead there."""
        for frame in batches:
            for r in frame.to_dict("records"):
                us, sizes, near = arrays(r)
                home = np.maximum(np.searchsorted(lo, near, "right") - 1, 0)  # a gene without a list has none anywhere
                starts = np.r_[0, np.cumsum(sizes[:-1], dtype=np.int64)]
                for h in np.unique(home):
                    into, to = home == h, {"block": int(block[h]), "a": r["block"], "b": int(block[h])}
                    if ids:
                        yield pd.DataFrame([to | {"us": b"", "sizes": b"", "near": np.unique(near[into]).tobytes()}])
                    else:
                        yield pd.DataFrame([to | some(us, sizes, near, np.logical_or.reduceat(into, starts))])

    def lend(own: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        us, sizes, near = arrays(own.iloc[0])
        rows = [{"block": -1, "a": a, "b": b, **some(us, sizes, near, np.isin(us, np.frombuffer(raw, np.int64)))} for a, b, raw in zip(asks["a"], asks["b"], asks["near"], strict=True)]
        return pd.DataFrame(rows, columns=["block", "a", "b", "us", "sizes", "near"])

    def meet(asks: pd.DataFrame, lent: pd.DataFrame) -> pd.DataFrame:
        us, sizes, near = arrays(asks.iloc[0])
        vs, counts, far = arrays(lent.iloc[0])
        none = pd.DataFrame([], columns=["gene", "t"])
        if not len(vs):
            return none
        genes = np.unique(np.concatenate((us, near, vs, far)))
        u_at, near, v_at, far = (np.searchsorted(genes, x).astype(np.int32) for x in (us, near, vs, far))
        begin, size = np.zeros(len(genes), np.int64), np.zeros(len(genes), np.int64)
        begin[v_at], size[v_at] = np.r_[0, np.cumsum(counts[:-1], dtype=np.int64)], counts
        found, mark, at = np.zeros(len(genes), np.int64), np.zeros(len(genes), bool), 0
        for u, n in zip(u_at, sizes, strict=True):
            mine = near[at : at + n]
            at += n
            mark[mine] = True
            # the lists of the neighbours that lie in the second block, about a million places at a time
            to = mine[size[mine] > 0]
            ends = np.cumsum(size[to])
            lo_, hi_ = 0, 0
            while lo_ < len(to):
                base = ends[lo_ - 1] if lo_ else 0
                hi_ = max(lo_ + 1, int(np.searchsorted(ends, base + 1_000_000, "right")))
                part, many = to[lo_:hi_], size[to[lo_:hi_]]
                first = ends[lo_:hi_] - many - base
                w = far[np.arange(int(many.sum())) + np.repeat(begin[part] - first, many)]
                hit = np.flatnonzero(mark[w])
                if len(hit):
                    found[u] += len(hit)
                    np.add.at(found, w[hit], 1)
                    np.add.at(found, part[np.searchsorted(first, hit, "right") - 1], 1)
                lo_ = hi_
            mark[mine] = False
        got = np.flatnonzero(found)
        return pd.DataFrame({"gene": genes[got], "t": found[got]})

    # Lists go from the blocks into a shuffle and are never written together: a reader of files takes many rows into one buffer.
    asks, ids = laid.mapInPandas(lambda x: ask(x, False), _LISTS), laid.mapInPandas(lambda x: ask(x, True), _LISTS)
    lent = laid.groupBy("block").cogroup(ids.groupBy("block")).applyInPandas(lambda own, a: lend(own, a), _LISTS)
    per = asks.groupBy("a", "b").cogroup(lent.groupBy("a", "b")).applyInPandas(lambda a, b: meet(a, b), "gene long, t long")
    return per.groupBy(F.col("gene").cast(kind).alias("gene")).agg(F.sum("t").alias("t"))
