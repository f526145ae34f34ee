"""Exact top-k search with vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import partitions, table

#: Bits of a cell number in one dimension, rows of a block, exact vectors read at a time, queries bounded at a time, deals of the copies of a vector.
BITS, BLOCK, READ, ASKED, DEALS = 8, 16_384, 16, 128, 256
#: Up to here sums of products of two components are exact in double precision (times the dimensions); beyond it Python's integers count.
EXACT = float(2**53)
#: Scores beyond a long count as the largest or smallest one; so do components beyond a double.
MOST, LARGEST = (1 << 63) - 1, 1.7976931348623157e308
#: The row number of a query, behind all rows of its block.
ASK = (1 << 31) - 1


def approximate(x: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The approximation of a block's vectors: cell numbers (uint8) and each dimension's least and greatest value in each cell, cells by quantiles of the block, so that a crowd of like vectors has cells of its own."""
    cells = 1 << bits
    edges = np.quantile(x, np.linspace(0, 1, cells + 1)[1:-1], axis=0, method="lower")
    code = np.empty(x.shape, np.uint8)
    low, high = np.full((x.shape[1], cells), np.inf), np.full((x.shape[1], cells), -np.inf)
    for d in range(x.shape[1]):
        code[:, d] = np.searchsorted(edges[:, d], x[:, d], "left")
        np.minimum.at(low[d], code[:, d], x[:, d])
        np.maximum.at(high[d], code[:, d], x[:, d])
    empty = low > high
    low[empty], high[empty] = 0, 0
    return code, low, high


class Block:
    """One block of the file: cells of all its vectors, and the vectors, of which only those that are asked for are decoded."""

    def __init__(self, code: np.ndarray, low: np.ndarray, high: np.ndarray, raw: list[bytes], ids: list[np.ndarray]):
        self.raw, self.ids = raw, ids
        dims = np.arange(code.shape[1])
        least, most = low[dims, code], high[dims, code]
        self.mid, self.half = least / 2 + most / 2, most / 2 - least / 2
        with np.errstate(over="ignore"):
            self.large = (np.abs(self.mid) + self.half).max(0, initial=0)
        self.most = float(self.large.max(initial=0))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(query, row): numbers that no inner product passes: q.mid + |q|.half, in single precision where that holds them, and what rounding may take off; where doubles overflow, infinity."""
        with np.errstate(over="ignore", invalid="ignore"):
            return self._bounds(q)

    def _bounds(self, q: np.ndarray) -> np.ndarray:
        size = np.abs(q) @ self.large
        kind, step = (np.float32, 2.0**-23) if size.max(initial=0) < 1e30 else (np.float64, 2.0**-52)
        if self.mid.dtype != kind:
            self.mid, self.half = self.mid.astype(kind), self.half.astype(kind)
        up = q.astype(kind) @ self.mid.T + np.abs(q).astype(kind) @ self.half.T
        up = up + ((2 * q.shape[1] + 16) * step * size + 1e-30)[:, None].astype(kind)
        if kind == np.float32:
            return up
        up[np.isnan(up)] = np.inf
        return np.maximum(up, -float(MOST))  # no score is less

    def scores(self, q: np.ndarray, rows: np.ndarray) -> list[int]:
        n = 8 * len(q)
        x = np.array([np.frombuffer(self.raw[r], np.float64 if len(self.raw[r]) == n else np.float32) for r in rows.tolist()], float).reshape(len(rows), len(q))
        if float(np.abs(q).max(initial=0)) * (float(np.abs(x).max(initial=0)) * len(q)) < EXACT:
            return (x @ q).astype(np.int64).tolist()
        own = list(map(int, q.tolist()))
        return [max(-MOST, min(MOST, sum(a * int(c) for a, c in zip(own, row, strict=True)))) for row in x.tolist()]

    def search(self, q: np.ndarray, q_ids: np.ndarray, k: int, stats: dict | None = None) -> list[tuple[int, int, int]]:
        """(query id, id, score) of each query's k best ids in the block, ties to smaller ids: bounds of all rows, then exact vectors in their order until the k-th is certain."""
        out = []
        for lo in range(0, len(q), ASKED):
            bound = self.bounds(q[lo : lo + ASKED])
            for i, b in enumerate(bound):
                mine, read, ask = int(q_ids[lo + i]), 0, READ
                best: dict[int, int] = {}
                floor = -np.inf
                while read < len(b):
                    cut = np.partition(b, len(b) - ask)[len(b) - ask] if ask < len(b) else -np.inf
                    at = np.flatnonzero(b >= cut)
                    at = at[np.argsort(-b[at], kind="stable")][read:]
                    if len(at) and b[at[0]] < floor:
                        break
                    for step in range(0, len(at), READ):
                        rows = at[step : step + READ]
                        rows = rows[b[rows] >= floor]
                        if not len(rows):
                            break
                        read += len(rows)
                        for r, s in zip(rows.tolist(), self.scores(q[lo + i], rows), strict=True):
                            for v in self.ids[r].tolist():
                                if v != mine and best.get(v, s - 1) < s:
                                    best[v] = s
                        kept = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
                        best = dict(kept)
                        floor = kept[-1][1] if len(kept) == k else -np.inf
                    else:
                        ask = 4 * max(ask, len(at))
                        continue
                    break
                if stats is not None:
                    stats["read"], stats["rows"] = stats.get("read", 0) + read, stats.get("rows", 0) + len(b)
                out += [(mine, v, s) for v, s in best.items()]
        return out


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * component) as doubles, of the rows with an id whose vector is neither null nor empty nor holds null or non-finite components."""
    ok = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.greatest(F.least(F.lit(float(scale)) * x, F.lit(LARGEST)), F.lit(-LARGEST)))
    # From 2**53 on every double is an integer, and a long would be too short for some.
    whole = F.transform("v", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x) + F.lit(0.0))
    return vectors.select("vec_id", "embedding").where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).select("vec_id", whole.alias("v"))


def approximation(vectors: DataFrame, scale: int = 256, k: int = 5, block: int = BLOCK) -> DataFrame:
    """The file: (dim, block, row, ids, code, raw), a row a distinct vector of floor(scale * component), and for each block a row of its cells' bounds (row -1: low and high as raw).

    A vector's ids are the k + 1 smallest that have it: more of them no query returns. The file is written; blocks hold about `block` distinct vectors, dealt by hash, so equal vectors, however many, are one row.
    """
    given = integers(vectors, scale)
    few = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1)
    dealt = given.groupBy("v", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(DEALS)).alias("deal")).agg(few(F.collect_set("vec_id")).alias("ids"))
    one = table(dealt.groupBy("v").agg(few(F.flatten(F.collect_list("ids"))).alias("ids")).withColumn("dim", F.size("v")), "classes", "snappy")
    blocks = -(-one.count() // block) or 1

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1)
        code, low, high = approximate(x)
        short = x.astype(np.float32)
        raw = [s.tobytes() if (s == r).all() else r.tobytes() for s, r in zip(short, x, strict=True)]
        head = {"dim": pdf["dim"].iloc[:1], "block": pdf["block"].iloc[:1], "row": -1, "ids": [np.zeros(0, np.int64)], "code": b"", "raw": [np.stack((low, high)).tobytes()]}
        body = {"dim": pdf["dim"], "block": pdf["block"], "row": np.arange(len(pdf)), "ids": pdf["ids"], "code": [c.tobytes() for c in code], "raw": raw}
        return pd.concat([pd.DataFrame(head), pd.DataFrame(body)], ignore_index=True)

    kind = "dim int, block int, row int, ids array<long>, code binary, raw binary"
    return table(one.withColumn("block", F.pmod(F.xxhash64("v", F.lit(1)), F.lit(blocks)).cast("int")).groupBy("dim", "block").applyInPandas(encode, kind), "approximation")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest inner product of floor(scale * component) for each query, ties to the smaller vec_id.

    Queries are the rows whose vec_id `every` divides; candidates all rows but those of the query's vec_id. Each block of the approximation file lies in one task, once, and all queries
    stream past it; only their k best rows of the block go on, merged by an aggregate. Null ids, null and empty vectors and
    vectors with null or non-finite components take no part, nor do vectors of another length meet. A vec_id that repeats, with one vector or several, counts once for a query, by its best score;
    queries that repeat an id with different vectors are searched each and merged under that id. Scores beyond a long count as the
    largest (or, but for its sign, smallest) one, so that they tie, and go by vec_id; a product 256 * component beyond a double counts as the largest double. An empty table gives no rows; other columns are ignored.
    """
    file = approximation(vectors, scale, k, block)
    heads = file.where("row = -1").select("dim", "block")
    asks = integers(vectors, scale).where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id").distinct()
    asks = table(asks.withColumn("dim", F.size("v")), "asks", "snappy")
    none = lambda t: F.lit(None).cast(t)
    data = file.select("dim", "block", "row", "ids", "code", "raw", F.lit(0).cast("long").alias("query_id"), none("array<double>").alias("v"))
    past = asks.join(heads, "dim").select("dim", "block", F.lit(ASK).alias("row"), none("array<long>").alias("ids"), none("binary").alias("code"), none("binary").alias("raw"), "query_id", "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, ready = None, [], None
        for b in batches:
            if not len(b):
                continue
            key = b[["dim", "block"]].to_numpy()
            new = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(b)], strict=True):
                part = b.iloc[lo:hi]
                if at != tuple(key[lo]):
                    at, held, ready = tuple(key[lo]), [], None
                asked = part["row"].to_numpy() == ASK
                if not asked.all():
                    held.append(part[~asked][["ids", "code", "raw"]])
                if asked.any():
                    if ready is None:
                        rows = pd.concat(held, ignore_index=True)
                        low, high = np.frombuffer(rows["raw"].iloc[0], float).reshape(2, int(at[0]), 1 << BITS)
                        code = np.frombuffer(b"".join(rows["code"].iloc[1:]), np.uint8).reshape(len(rows) - 1, int(at[0]))
                        ready, held = Block(code, low, high, rows["raw"].tolist()[1:], rows["ids"].tolist()[1:]), []
                    q = part[asked]
                    yield pd.DataFrame(ready.search(np.array(q["v"].tolist(), float).reshape(len(q), -1), q["query_id"].to_numpy(), k), columns=["query_id", "vec_id", "score"])

    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])
    cells = data.unionByName(past).repartition(max(partitions(vectors.sparkSession), 1), "dim", "block").sortWithinPartitions("dim", "block", "row")
    local = cells.mapInPandas(run, kind).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col("vec_id")))), 1, k)
    merged = local.groupBy("query_id").agg(best.alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).alias("score"))
