"""Whitening of embeddings from an exact integer scatter."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import meet, table

#: x = floor(SCALE * component) + SHIFT; floor(SCALE * component) counts as +-MOST beyond it, so that x is a long.
SCALE, SHIFT, MOST = 1024, 100_000, 1 << 62
#: Components that come back.
COMPONENTS = 8
#: A product of two limbs of LIMB bits, summed over ROWS rows, is exact in double precision; so many sums of ROWS rows are exact in a long.
LIMB, ROWS, SUMS = 20, 4096, 256


def integers(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, y) for each length of vector in a batch: the rows of that length and their floor(SCALE * component)."""
    lists = batch.column(column)
    ends = lists.offsets.to_numpy()
    flat, many = lists.values.to_numpy(zero_copy_only=False), np.diff(ends)
    for dims in np.unique(many).tolist():
        rows = np.flatnonzero(many == dims)
        with np.errstate(over="ignore"):
            y = np.floor(flat[ends[rows][:, None] + np.arange(dims)] * SCALE)
        yield rows, np.clip(y, -float(MOST), float(MOST)).astype(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors as doubles, without null and empty ones and those with null or non-finite entries."""
    ok = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(ok).withColumnRenamed("embedding", "v")


class Scatter:
    """Exact sums over vectors y of one length: entry (0, 0) counts them, (0, i) sums component i, (i, j) sums products. Integers of any size."""

    def __init__(self, dims: int):
        self.total = np.zeros((dims + 1, dims + 1), object)
        self.open: dict[int, np.ndarray] = {}
        self.sums = 0

    def add(self, y: np.ndarray) -> None:
        for at in range(0, len(y), ROWS):
            part = y[at : at + ROWS]
            size, sign = np.abs(part), np.sign(part)
            limbs = max(1, -(-int(size.max(initial=0)).bit_length() // LIMB))
            cut = [np.insert((((size >> (LIMB * k)) & ((1 << LIMB) - 1)) * sign).astype(float), 0, float(k == 0), axis=1) for k in range(limbs)]
            for a in range(limbs):
                for b in range(limbs):
                    here = self.open.setdefault(a + b, np.zeros(self.total.shape, np.int64))
                    here += (cut[a].T @ cut[b]).astype(np.int64)
            self.sums += 1
            if self.sums == SUMS:
                self.close()

    def close(self) -> np.ndarray:
        for k, part in self.open.items():
            self.total += part.astype(object) << (LIMB * k)
        self.open, self.sums = {}, 0
        return self.total


@dataclass
class Model:
    """What one length of vectors is whitened by: n, sums S of y, the columns `axes` (unit eigenvectors by falling eigenvalue), their eigenvalues and shares of the trace (None where the trace is 0)."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: list[float | None]


def scatters(vectors: DataFrame) -> DataFrame:
    """(dims, i, sums array<string>): row i of the upper triangle of each length's Scatter, as decimal numbers.

    Every task adds up its own rows; the states, of a size that follows from the vectors' length alone, are merged row by row of the matrix, so that no task holds more than its rows' share of one state.
    """
    kind = "dims int, i int, sums array<string>"

    def rows(dims: int, i: int, sums: list) -> pd.DataFrame:
        return pd.DataFrame({"dims": [dims], "i": [i], "sums": [[str(s) for s in sums]]})

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, Scatter] = {}
        for b in batches:
            for _, y in integers(b, 0):
                states.setdefault(y.shape[1], Scatter(y.shape[1])).add(y)
        for dims, s in states.items():
            total = s.close()
            for i in range(dims + 1):
                yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([i], pa.int32()), pa.array([[str(x) for x in total[i, i:]]], pa.list_(pa.string()))], names=["dims", "i", "sums"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for dims, i, sums in b.itertuples(index=False):
                more = np.array([int(s) for s in sums], object)
                totals[dims, i] = totals[dims, i] + more if (dims, i) in totals else more
        for (dims, i), sums in totals.items():
            yield rows(dims, i, sums)

    return vectors.select("v").mapInArrow(local, kind).repartition("dims", "i").mapInPandas(merge, kind)


def decompose(dims: int, upper: dict[int, list[int]], most: int = COMPONENTS) -> Model:
    """The model of a length from its exact sums.

    n * Y'Y - SS' is formed in integers (it is the same for x and y, which differ by a constant) and divided once, so each entry of the covariance is the double next to its exact
    value; only then eigh. An eigenvalue is the exact quotient w'Cw / w'w of its vector, so that small ones do not drown in the rounding of large ones. Signs: the largest entry is positive.
    """
    n, sums = upper[0][0], upper[0][1:]
    exact = np.zeros((dims, dims), object)
    for i in range(dims):
        exact[i, i:] = [n * p - sums[i] * s for p, s in zip(upper[i + 1], sums[i:], strict=True)]
        exact[i:, i] = exact[i, i:]
    trace = sum(exact[i, i] for i in range(dims))
    _, axes = np.linalg.eigh(np.array([[p / (n * n) for p in row] for row in exact], float))
    axes = axes[:, ::-1][:, :most]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    whole = [np.array([int(w) for w in np.rint(a * 2.0**60)], object) for a in axes.T]
    tops = [(int(w @ (exact @ w)), int(w @ w)) for w in whole]
    least = dims * 2.0**-50
    values = np.array([top / (size * n * n) if trace and top / (size * trace) > least else 0.0 for top, size in tops])
    return Model(n, sums, axes, values, [top / (size * trace) if trace else None for top, size in tops])


def fit(vectors: DataFrame) -> dict[int, Model]:
    """A model for each length of vector: its matrix comes to the driver, of a size that follows from the length alone."""
    upper: dict[int, dict[int, list[int]]] = {}
    for r in scatters(vectors).toLocalIterator():
        upper.setdefault(r["dims"], {})[r["i"]] = [int(s) for s in r["sums"]]
    return {dims: decompose(dims, rows) for dims, rows in upper.items()}


def deviations(y: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * y - S)^2, exact: n^2 * sum(y^2) - 2 n * sum(y S) + sum(S^2)."""
    square = sum(s * s for s in sums)
    if int(np.abs(y).max(initial=0)) < 1 << LIMB and y.shape[1] < 1 << 12:
        own = (y * y).sum(1).tolist()
        cross, at, rest = [0] * len(y), 0, [abs(s) for s in sums]
        while any(rest):  # S limb by limb, so that products stay in a long
            limb = np.array([(r & ((1 << 30) - 1)) * (1 if s >= 0 else -1) for r, s in zip(rest, sums, strict=True)], np.int64)
            cross = [c + (p << at) for c, p in zip(cross, (y @ limb).tolist(), strict=True)]
            rest, at = [r >> 30 for r in rest], at + 30
    else:
        whole = y.astype(object)
        own, cross = (whole * whole).sum(1).tolist(), (whole @ np.array(sums, object)).tolist()
    return [n * n * a - 2 * n * b + square for a, b in zip(own, cross, strict=True)]


def transform(vectors: DataFrame, models: dict[int, Model]) -> DataFrame:
    """(vec_id, dims, n, deviation long, deviation_exact string, whitened array<double>) for each of vectors; deviation is null where it is beyond a long."""
    kind = pa.list_(pa.float64())
    ready = {dims: (m, np.array([s / m.n for s in m.sums]), np.where(m.values > 0, m.values, 1.0) ** -0.5) for dims, m in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, y in integers(b, 1):
                m, mean, factor = ready[y.shape[1]]
                w = ((y - mean) @ m.axes) * factor
                off = deviations(y, m.n, m.sums)
                flat = pa.array(w.ravel(), mask=np.broadcast_to(m.values <= 0, w.shape).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), flat)
                cols = [b.column(0).take(pa.array(rows)), pa.array(np.full(len(y), y.shape[1], np.int32)), pa.array(np.full(len(y), m.n, np.int64))]
                short = [d if d < 1 << 63 else None for d in off]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(short, pa.int64()), pa.array([str(d) for d in off]), lists.cast(kind)], names=["vec_id", "dims", "n", "deviation", "deviation_exact", "whitened"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(run, "vec_id long, dims int, n long, deviation long, deviation_exact string, whitened array<double>")


def identity_error(whitened: DataFrame, components: int) -> Column:
    """The largest absolute entry of the covariance of `components` whitened components minus the identity; components without variance are left out."""
    at = lambda i: F.get("whitened", F.lit(i))
    entries = [F.abs(F.covar_pop(at(i), at(j)) - float(i == j)) for i in range(components) for j in range(i, components)]
    return F.array_max(F.array(*entries))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component int (from 1), n, deviation, whitened, explained, identity_error, deviation_exact: up to eight rows for each usable vector.

    y = floor(1024 * component) is summed and multiplied in integers (x = y + 100000 has the same covariance and deviations), so covariance and deviation do not depend on how rows are
    dealt. Left out: null and empty vectors and those with null or non-finite entries. Each length of vector is a fit list of its own. y beyond 2**62 counts as
    2**62. A component without variance (all of them for one vector, or equal ones) has whitened null and does not count in identity_error (null if none is
    left); explained is null where the whole trace is 0. deviation is null beyond a long, deviation_exact has its digits always. Repeated and null ids are rows
    each; an empty table gives no rows; other columns are ignored. A length's matrix and model are on the driver and in each task, whatever the number of rows.
    """
    given = usable(vectors)
    models = fit(given)
    rows = table(transform(given, models), "whitened")
    error = rows.groupBy("dims").agg(identity_error(rows, components).alias("identity_error"))
    shares = vectors.sparkSession.createDataFrame([(d, m.explained) for d, m in models.items()], "dims int, shares array<double>")
    few = table(error.join(shares, "dims"), "shares", "snappy")
    out = meet(rows, few, ["dims"], 16, 8 * F.size("shares"))
    each = out.select("vec_id", "n", "deviation", "deviation_exact", "shares", "identity_error", F.posexplode("whitened").alias("p", "whitened"))
    return each.select("vec_id", (F.col("p") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("shares", F.col("p")).alias("explained"), "identity_error", "deviation_exact")
