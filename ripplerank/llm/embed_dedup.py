"""Embedding near-dedup: cross-polytope hashes after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_cell, cell_pairs, components, forest, split_hot, table, whole_cells

#: Tables, hashes joined to one bucket, buckets of each table that a vector goes to, rotations of a hash, rows of a block.
TABLES, HASHES, PROBES, ROUNDS, BLOCK = 8, 3, 4, 3, 512
#: Standard deviations by which the sketches of a pair may differ more than its cosine lets expect before it counts as no candidate (1 in 30,000 pairs at the threshold).
SLACK = 4.0


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def buckets(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 42) -> np.ndarray:
    """(row, table, probe): bucket numbers. A hash is the vertex (axis and sign) of the cross-polytope nearest to the rotated vector.

    Probes go by what they lose: the first is the nearest vertex in every hash; the next ones take the second or third nearest vertex in the hash where it is least further off.
    """
    n, d = unit.shape
    wide = 1 << max(1, (d - 1).bit_length())
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, ROUNDS, wide))
    out = np.empty((n, tables, probes), np.int64)
    padded = np.zeros((n, wide))
    padded[:, :d] = unit
    top = min(1 + probes, 2 * wide)
    rows = np.arange(n)[:, None]
    for t in range(tables):
        vertex, loss = [], []
        for h in range(hashes):
            y = padded
            for r in range(ROUNDS):
                y = hadamard(y * signs[t, h, r])
            both = np.concatenate((y, -y), axis=1)
            near = np.argpartition(-both, top - 1, axis=1)[:, :top]
            near = near[rows, np.argsort(-both[rows, near], axis=1, kind="stable")]
            vertex.append(near)
            loss.append(both[rows[:, 0], near[:, 0]][:, None] - both[rows, near])
        base = sum(v[:, 0] * (2 * wide) ** h for h, v in enumerate(vertex))
        out[:, t, 0] = base
        other = np.concatenate([base[:, None] + (v[:, 1:] - v[:, :1]) * (2 * wide) ** h for h, v in enumerate(vertex)], axis=1)
        cost = np.concatenate([x[:, 1:] for x in loss], axis=1)
        order = np.argsort(cost, axis=1, kind="stable")[:, : probes - 1]
        out[:, t, 1:] = other[rows, order]
    return out


def sketches(unit: np.ndarray, seed: int = 43) -> np.ndarray:
    """(row, 2) uint64: 128 signs of each rotated vector. Vectors at an angle a differ in about a / pi of them."""
    d = unit.shape[1]
    wide = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((len(unit), wide))
    padded[:, :d] = unit
    rng, out = np.random.default_rng(seed), []
    while sum(x.shape[1] for x in out) < 128:
        y = padded
        for _ in range(ROUNDS):
            y = hadamard(y * rng.choice([-1.0, 1.0], wide))
        out.append(y > 0)
    return np.packbits(np.concatenate(out, axis=1)[:, :128], axis=1).view(np.uint64)


def apart(threshold: float) -> int:
    """Signs of 128 in which the sketches of a pair of that cosine differ at most, but for SLACK standard deviations."""
    p = np.arccos(min(1.0, max(-1.0, threshold))) / np.pi
    return int(np.ceil(128 * p + SLACK * np.sqrt(128 * p * (1 - p))))


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Links are pairs with cosine >= threshold in double precision that share a bucket; all are verified, so none is false. Equal vectors are one class
    (represented by its smallest vec_id) whose members all link. What goes to every bucket of a vector is its number and a sketch of 128 signs; only members whose sketch is near that of
    another member follow with their vectors, which are compared in full. A pair that shares several buckets counts in the one of smallest number.
    Vectors of different length never link. Null, zero, empty or non-finite vectors link with nothing. Rows that repeat a vec_id and vector count as separate
    members of the class; a vec_id that repeats with different vectors is a row each, linked by its own vector. Rows with a null vec_id take no part in links and come back with n_links 0 and a null component.
    An empty table gives no rows; other columns are ignored.
    """
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).withColumn("h", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(2), "embedding"))
    part = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()
    classes = every.where(part).groupBy("h", "h2", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = table(classes.withColumn("id", F.monotonically_increasing_id()), "classes", "snappy")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, g in b.groupby(b["embedding"].map(len)):
                for lo in range(0, len(g), 2000):
                    part = g.iloc[lo : lo + 2000]
                    x = np.array(part["embedding"].tolist(), float)
                    with np.errstate(over="ignore"):
                        short = x.astype(np.float32)
                    raw = [s.tobytes() if (s == r).all() else r.tobytes() for s, r in zip(short, x, strict=True)]  # single precision only where nothing is lost
                    x /= np.abs(x).max(1, keepdims=True)  # else squares may overflow
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    keys = (buckets(x, tables, hashes, probes) * tables + np.arange(tables)[None, :, None]) * 4099 + d
                    signs = sketches(x).view(np.int64)
                    yield pd.DataFrame({"id": part["id"].to_numpy(), "n": part["n"].to_numpy(), "dim": d, "raw": raw, "keys": list(keys.reshape(len(x), -1)), "s": signs[:, 0], "s2": signs[:, 1]})

    dealt = table(classes.select("id", "n", "embedding").mapInPandas(deal, "id long, n long, dim int, raw binary, keys array<long>, s long, s2 long"), "dealt", "snappy")
    most = apart(threshold)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, ends in whole_cells(batches, "bucket"):
            s, s2 = frame["s"].to_numpy().view(np.uint64), frame["s2"].to_numpy().view(np.uint64)
            live = np.zeros(len(frame), bool)
            for a, b in cell_pairs(frame, ends, 500_000):
                ok = np.bitwise_count(s[a] ^ s[b]).astype(np.int16) + np.bitwise_count(s2[a] ^ s2[b]) <= most
                live[a[ok]] = True
                live[b[ok]] = True
            if live.any():
                yield frame.loc[live, ["bucket", "id"]]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, ends in whole_cells(batches, "bucket"):
            own, n, bucket, dims = (frame[c].to_numpy() for c in ("id", "n", "bucket", "dim"))
            count, found = np.zeros(len(frame), np.int64), []
            keys = np.stack(frame["keys"].tolist()).reshape(len(frame), tables, probes)
            for d in np.unique(dims):
                mine = np.flatnonzero(dims == d)
                place = np.zeros(len(frame), np.int64)
                place[mine] = np.arange(len(mine))
                unit = np.array([np.frombuffer(r, np.float32 if len(r) == 4 * d else float) for r in frame["raw"].iloc[mine]], float)
                unit /= np.abs(unit).max(1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                for a, b in cell_pairs(frame, ends, 60_000):
                    both = (dims[a] == d) & (dims[b] == d)
                    a, b = a[both], b[both]
                    cos = np.einsum("ij,ij->i", unit[place[a]], unit[place[b]])
                    a, b = a[cos >= threshold], b[cos >= threshold]
                    for lo in range(0, len(a), 20_000):
                        x, y = a[lo : lo + 20_000], b[lo : lo + 20_000]
                        same = (keys[x][:, :, :, None] == keys[y][:, :, None, :]).any(3)  # (pair, table, probe of x)
                        here = np.where(same, keys[x], np.iinfo(np.int64).max).min((1, 2)) == bucket[x]
                        x, y = x[here], y[here]
                        np.add.at(count, x, n[y])
                        np.add.at(count, y, n[x])
                        found.append((x, y))
            a, b = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))
            root = own[forest(len(frame), a, b)]
            out = pd.DataFrame({"a": own, "b": root, "links": count})[count > 0]
            if len(out):
                yield out

    sent = dealt.select(F.explode(F.array_distinct("keys")).alias("bucket"), "id", "s", "s2")
    live = table(by_cell(split_hot(sent, "bucket", "id", 4 * block), "bucket").mapInPandas(near, "bucket long, id long").distinct(), "live", "snappy")
    full = live.join(dealt.select("id", "n", "dim", "raw", "keys"), "id")
    found = table(by_cell(split_hot(full, "bucket", "id", block), "bucket").mapInPandas(meet, "a long, b long, links long"), "found", "snappy")
    degree = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    reach = table(components(found.select("a", "b")).withColumnRenamed("id", "member"), "reach", "snappy")
    reps = classes.select("id", "rep")
    least = reach.join(reps, F.col("member") == F.col("id")).groupBy("component").agg(F.min("rep").alias("least"))
    of = classes.select("id", "h", "h2", "n", "rep").join(degree, "id", "left").join(reach.join(least, "component").select(F.col("member").alias("id"), "least"), "id", "left")
    of = of.select(F.col("h").alias("k"), F.col("h2").alias("k2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("least", "rep").alias("least"))
    # Vectors come back by the 128 bits of their hash; one that takes no part has a null key, which joins with nothing.
    out = every.select("vec_id", F.when(part, F.col("h")).alias("h"), "h2").join(of, (F.col("h") == F.col("k")) & (F.col("h2") == F.col("k2")), "left")
    component = F.coalesce("least", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
