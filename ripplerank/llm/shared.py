"""What the operators of this subpackage share: written tables, global order, hot groups, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_dir

#: A side of at most this many bytes, counted before, may be broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/ripplerank-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df, written to the shared folder and read back: lineage ends there, and a lost executor costs no more than a read."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, name: str = "rows") -> DataFrame:
    """(id, row): docs written once, with a number for each row and its columns in one struct, so that repeated and null doc_ids tell rows apart and no working column clashes."""
    return table(docs.select(F.monotonically_increasing_id().alias("id"), F.struct("*").alias("row")), name)


def side(df: DataFrame, width: int, *cells: F.Column) -> DataFrame:
    """df marked for broadcast where its rows, at `width` bytes each and what `cells` (columns of byte counts) add, come to BROADCAST_BYTES at most; else as it is. df is a table()."""
    extra = [F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in cells]
    n, *more = df.agg(F.count("*"), *extra).first()
    return F.broadcast(df) if n * width + sum(more) <= BROADCAST_BYTES else df


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table() that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_order(df: DataFrame, order: list[str], weight: str | None = None, name: str = "ordered") -> DataFrame:
    """df with its place in the global order of the order columns: _index (long, gapless from 0) and, with weight, _before (long, the sum of weight over all rows before it).

    Range partitions are sorted and written once; their counts and sums, one row a partition, give each partition's start. The order columns should tell
    rows apart, so that a value that many rows share is cut between partitions; rows alike in all of them get places in any order. Null weights count 0.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    kinds = T.StructType([*df.schema.fields, T.StructField("_part", T.LongType()), T.StructField("_row", T.LongType()), T.StructField("_sum", T.LongType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            k = b.num_rows
            w = np.zeros(k, np.int64) if weight is None else b.column(b.schema.get_field_index(weight)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(w)
            extra = [np.full(k, part, np.int64), np.arange(row, row + k, dtype=np.int64), ends - w]
            row, total = row + k, int(ends[-1]) if k else total
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, extra)], names=[*b.schema.names, "_part", "_row", "_sum"])

    laid = table(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(local, kinds), name)
    add = F.coalesce(F.col(weight).cast("long"), F.lit(0)) if weight else F.lit(0).cast("long")
    parts = laid.groupBy("_part").agg(F.count("*").alias("_n"), F.sum(add).alias("_w"))
    # One row for each range partition: at most spark.sql.shuffle.partitions rows, whatever the input.
    rows, starts, weights = sorted((r["_part"], r["_n"], r["_w"]) for r in parts.collect()), 0, 0
    at = []
    for p, k, w in rows:
        at.append((p, starts, weights))
        starts, weights = starts + k, weights + w
    first = spark.createDataFrame(at, "_part long, _first long, _base long")
    out = laid.join(F.broadcast(first), "_part", "left").withColumn("_index", F.col("_first") + F.col("_row"))
    if weight:
        out = out.withColumn("_before", F.col("_base") + F.col("_sum"))
    return out.drop("_part", "_row", "_sum", "_first", "_base")


def split_hot(rows: DataFrame, key: str, member: str, block: int = 1024) -> DataFrame:
    """rows with _i, _j, _home: the cells in which the members of a key meet.

    A key of up to `block` rows is one cell (0, 0). The rows of a larger one are dealt to blocks by a hash of `member`, and a row goes to every cell
    (i, j), i <= j, of its block: all pairs of rows still meet in exactly one cell (rows of one block in (i, i), others where _home differs), but no
    cell holds much over two blocks, however large the key's group is.
    """
    hot = table(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > block).select(key, F.ceil(F.col("_n") / block).cast("int").alias("_blocks")), "hot")
    if hot.isEmpty():
        return rows.withColumns({x: F.lit(0) for x in ("_i", "_j", "_home")})
    laid = rows.join(side(hot, 16), key, "left")
    laid = laid.withColumn("_home", F.coalesce(F.pmod(F.xxhash64(F.lit(7), member), F.col("_blocks").cast("long")).cast("int"), F.lit(0)))
    cells = F.expr("transform(sequence(0, coalesce(_blocks, 1) - 1), x -> struct(least(x, _home) as i, greatest(x, _home) as j))")
    laid = laid.withColumn("_cell", F.explode(cells))
    return laid.withColumn("_i", F.col("_cell.i")).withColumn("_j", F.col("_cell.j")).drop("_cell", "_blocks")


def by_cell(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by cell and sorted, so that a task meets each cell's rows one after the other."""
    return rows.repartition(partitions(rows.sparkSession), key, "_i", "_j").sortWithinPartitions(key, "_i", "_j")


def whole_cells(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Of sorted batches: frames that cut no cell, and the end position of each row's cell."""
    rest: list[pd.DataFrame] = []
    for b in (b for b in batches if len(b)):
        k = [b[c].to_numpy() for c in (key, "_i", "_j")]
        new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in k])) + 1
        if rest and all(x[0] == rest[-1][c].iloc[-1] for x, c in zip(k, (key, "_i", "_j"), strict=True)) and not len(new):
            rest.append(b)
            continue
        cut = int(new[-1]) if len(new) else 0
        if rest or cut:
            yield _ended(pd.concat([*rest, b.iloc[:cut]], ignore_index=True), key)
        rest = [b.iloc[cut:]]
    if rest:
        yield _ended(pd.concat(rest, ignore_index=True), key)


def _ended(frame: pd.DataFrame, key: str) -> tuple[pd.DataFrame, np.ndarray]:
    k = [frame[c].to_numpy() for c in (key, "_i", "_j")]
    starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in k])])
    ends = np.r_[starts[1:], len(frame)]
    return frame, np.repeat(ends, ends - starts)


def cell_pairs(frame: pd.DataFrame, ends: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs that meet in a frame's cells, about `most` at a time, each once."""
    n, home = len(frame), frame["_home"].to_numpy()
    cross = frame["_i"].to_numpy() != frame["_j"].to_numpy()
    todo = ends - np.arange(n) - 1
    upto, at = np.cumsum(todo), 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        many = todo[at:stop]
        if total := int(many.sum()):
            a = np.repeat(np.arange(at, stop), many)
            b = a + 1 + np.arange(total) - np.repeat(np.cumsum(many) - many, many)
            keep = ~cross[a] | (home[a] != home[b])
            yield a[keep], b[keep]
        at = stop


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each id that the links (a long, b long) touch, the smallest id that it reaches.

    Alternating large-star and small-star rounds: a number of rounds that grows with the logarithm of the longest path, each a few shuffles of the links,
    written to the shared folder. No task holds a component.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = table(edges, "links")
    marks = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
    seen = edges.agg(*marks).first()
    while seen["n"]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        after = table(small, "links")
        now = after.agg(*marks).first()
        drop_table(edges)
        edges = after
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


#: Copies of a key's row, so that no task meets all the rows that share it.
SALTS = 16


def meet(rows: DataFrame, few: DataFrame, on: list[str], width: int, *cells: F.Column, how: str = "inner") -> DataFrame:
    """rows joined with the written table `few` on columns of one name (nulls match nulls), however many rows share a key.

    Where few's rows, at `width` bytes each and `cells`, come to BROADCAST_BYTES at most, they are broadcast. Otherwise each goes out in SALTS copies and a
    row of `rows` meets one of them, dealt by its other columns' hash: a key that a third of all rows share is spread over SALTS tasks.
    """
    right = few.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    marked = side(few, width, *cells)
    if marked is not few:
        out = rows.join(F.broadcast(right), same, how)
    else:
        salted = right.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [*same, F.col("_salt") == F.col("_copy")], how)
    return out.drop("_salt", "_copy", *[f"_on_{c}" for c in on])
