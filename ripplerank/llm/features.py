"""Sparse text features for the classifiers, and the bounded samples that they are fitted on."""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Width of the hashed feature space, words whose features a worker keeps, most features of a word, words looked up at a time.
WIDTH, KEPT, MOST, CHUNK = 1 << 20, 300_000, 4, 1 << 16

_SIGNS = re.compile(r"[^\w]+|_+")


def hashed(*parts: str) -> int:
    return zlib.crc32("\0".join(parts).encode("utf-8", "surrogatepass")) % WIDTH


def stems(word: str) -> tuple[int, ...]:
    """A lower-cased word without signs, and its first 4, 5 and 6 letters: inflected and joined forms share their stem."""
    core = _SIGNS.sub("", word.lower())
    return (hashed("w", core), *(hashed("p", core[:n]) for n in (4, 5, 6) if len(core) > n)) if core else ()


def shape(word: str) -> str:
    """What kinds of signs a word is made of: A for capitals, a for letters, 9 for digits, others as they are, runs as one or two."""
    out: list[str] = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if out[-2:] != [k, k]:
            out.append(k)
    return "".join(out)


def looks(word: str) -> tuple[int, ...]:
    """A word as written, without signs and lower-cased, by its shape and by its last three characters."""
    core = _SIGNS.sub("", word.lower())
    return hashed("c", core), hashed("s", shape(word)), hashed("e", word[-3:])


class _Rows(dict):
    """Numbers of the rows in which words' features stand: KEPT of them for good, others (and words over 64 characters) until the next chunk."""

    def __init__(self, of: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.of, self.most, self.spare = of, KEPT, 0
        self.table = np.full((self.most + CHUNK, MOST), -1, np.int32)

    def __missing__(self, word: str) -> int:
        keep = len(self) < self.most and len(word) <= 64
        at = len(self) if keep else self.most + self.spare
        found = self.of(word)
        self.table[at, : len(found)] = found
        self.table[at, len(found) :] = -1
        if keep:
            self[word] = at
        else:
            self.spare += 1
        return at


class Features:
    """Indicator features of whole texts: those of each word and, for the columns `pairs` of them, the bigrams: the pairs of words that stand side by side, by that feature of either."""

    def __init__(self, of: Callable[[str], tuple[int, ...]], pairs: tuple[int, ...] = ()):
        self.rows, self.pairs = _Rows(of), pairs

    def __call__(self, text: str | None) -> np.ndarray:
        words, out, last = (text or "").split(), [], None
        for lo in range(0, len(words), CHUNK):
            part = words[lo : lo + CHUNK]
            self.rows.spare = 0
            own = self.rows.table[np.fromiter(map(self.rows.__getitem__, part), np.int64, len(part))]
            out.append(own.ravel())
            line = own if last is None else np.concatenate((last, own))
            for c in self.pairs:
                x = line[:, c].astype(np.uint64)
                h = (x[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ x[1:]) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(c)
                out.append((h >> np.uint64(44)).astype(np.int32))  # the upper 20 bits: below WIDTH
            last = own[-1:]
        ids = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int32)
        return ids[1:] if len(ids) and ids[0] < 0 else ids


def labelled(docs: DataFrame, labels: DataFrame, column: str, features: Callable[[], Features], rows: int, where: F.Column | None = None) -> DataFrame:
    """(doc_id, y, x): features and 0/1 labels of about `rows` labelled documents at most, the same ones each time: those whose hashed doc_id falls under rows / all.

    Labels other than 0 and 1 are left out; a document labelled more than once has its largest label.
    """
    given = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
    if where is not None:
        given = given.where(where)
    given = given.groupBy("doc_id").agg(F.max(column).cast("int").alias("_y"))
    n = given.count()
    if n > rows:
        given = given.where(F.pmod(F.xxhash64(F.lit(5), F.col("doc_id").cast("long")), F.lit(1 << 30)) < int((1 << 30) * rows / n))
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(given), "doc_id").select("doc_id", "text", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = features()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array([f(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["doc_id", "y", "x"])

    return chosen.mapInArrow(run, "doc_id long, y int, x binary")


def _in_order(rows: Iterable[tuple[int, int, bytes]]) -> tuple[list[np.ndarray], np.ndarray]:
    got = sorted(rows)
    return [np.frombuffer(x, np.int32) for _, _, x in got], np.array([y for _, y, _ in got], int)


def fitted(docs: DataFrame, labels: DataFrame, column: str, features: Callable[[], Features], rows: int, learn: Callable[[list[np.ndarray], np.ndarray], Any], where: F.Column | None = None) -> Any:
    """What `learn` makes of the labelled() sample: worked out in one task, which `rows` bounds, so that the driver gets the model and never the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn(*_in_order(rows)))], pa.binary())], names=["model"])

    got = labelled(docs, labels, column, features, rows, where).repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(got["model"])) if got else learn(*_in_order([]))


def sparse(x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every indicator that is set."""
    return np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate(x) if x else np.zeros(0, np.int32)


def scored(docs: DataFrame, features: Callable[[], Features], weights: np.ndarray, outputs: str, finish: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> DataFrame:
    """(doc_id, outputs) of every row: the sum of its features' weights and their number go through `finish`. Weights have a fixed width and are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, w = features(), shared.value
        for b in batches:
            x = [f(t.as_py()) for t in b.column(1)]
            total = np.array([w[v].sum(dtype=float) for v in x], float)
            out = finish(total, np.array([len(v) for v in x], float))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)], names=["doc_id", *(o.split()[0] for o in outputs.split(", "))])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {outputs}")


def flagged(features: Callable[[], Features], weights: np.ndarray, finish: Callable[[np.ndarray, np.ndarray], np.ndarray], spark: SparkSession) -> Callable[[F.Column], F.Column]:
    """A column function of texts: what `finish` makes of the sum of the weights of a text's features and their number, as in scored()."""
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("boolean")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f, w = features(), shared.value
        for b in texts:
            x = [f(t.as_py()) for t in b]
            yield pa.array(finish(np.array([w[v].sum(dtype=float) for v in x], float), np.array([len(v) for v in x], float)).astype(bool), pa.bool_())

    return run
