"""Sharding along a Hilbert curve over metadata."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import in_order, new_path, partitions, side, table

#: Shards, and bits of each quantised dimension.
SHARDS, BITS = 16, 5


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The index along the Hilbert curve of integer cells (row, dimension), each below 2**bits.

    Gray-code form: from the highest bit down, undo the reflection or exchange that the curve makes in each subcube, then weave the bits and decode the Gray code.
    """
    x = cells.astype(np.uint64).copy()
    n, dims = x.shape
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(level), (one << np.uint64(level)) - one
        for d in range(dims):
            upper = (x[:, d] & bit) > 0
            swap = np.where(upper, np.uint64(0), (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(upper, low, swap)
            x[:, d] ^= swap if d else np.uint64(0)
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    parity = np.zeros(n, np.uint64)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        parity ^= np.where(x[:, -1] & bit, bit - one, np.uint64(0))
    x ^= parity[:, None]
    out = np.zeros(n, np.uint64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << one) | ((x[:, d] >> np.uint64(level)) & one)
    return out.astype(np.int64)


def size_cell(size: F.Column, bits: int = BITS) -> F.Column:
    """The cell of a size: its logarithm in half steps."""
    return F.least(F.floor(2 * F.log2(size)), F.lit((1 << bits) - 1).cast("long")).cast("int")


def ranks(rows: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(value, cell): the values of a column in order, nulls last, cut into 2**bits cells by the middle of their rows in the running count: neighbours in name share a cell, so that a file's least and greatest value bound few others."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).withColumn("none", F.col("value").isNull().cast("int"))
    placed = table(in_order(counts, ["none", "value"], "n", "ranks"), "ranks", "snappy")
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    return table(placed.select("value", F.floor((F.col("_before") + F.col("n") / 2) * (1 << bits) / total).cast("int").alias("cell")), "ranks", "snappy")


def ranges(cells: list[tuple[int, int, int]], heavy: list[tuple[int, int, int, int]], most: int) -> tuple[list[tuple], list[tuple]]:
    """Ranges of about `most` bytes along the curve, from (curve, cell, bytes) and the classes (cell, h, h2, bytes) that are heavier than that.

    Returns (cell, curve, first, parts) and (h, h2, first, parts): small cells share a range, a larger one is cut into parts by the hash of the text, and the copies of a heavy class, which
    stand behind the rest of their cell, into parts by a hash of the row.
    """
    own: dict[int, list] = {}
    for cell, h, h2, b in sorted(heavy):
        own.setdefault(cell, []).append((h, h2, b))
    out, big, at, load = [], [], 0, 0
    for curve, cell, b in sorted(cells):
        b -= sum(x for _, _, x in own.get(cell, ()))
        if load and load + b > most:
            at, load = at + 1, 0
        parts = max(1, math.ceil(b / most))
        out.append((cell, curve, at, parts))
        at, load = (at, load + b) if parts == 1 else (at + parts, 0)
        for h, h2, x in own.get(cell, ()):
            at, load = at + bool(load), 0
            parts = math.ceil(x / most)
            big.append((h, h2, at, parts))
            at += parts
    return out, big


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS, where: str | None = None) -> DataFrame:
    """docs written in shards, read back: its columns with size, curve, shard and slot. One folder a shard, its files in the curve's order.

    Dimensions: the logarithm of the size (UTF-8 bytes of the text, null none, plus 1) in half steps, and source and lang in the order of their names. Rows follow the curve
    index, in a cell the hash of the text, then doc_id. Equal texts stand together: a class of copies whose metadata differ takes the least cell among them. Law `rows`: row i of n goes to shard
    floor(i * shards / n), so counts differ by one at most and only a class on one of these cuts lies in more than one shard; slots count from 0 in each.

    What the driver sees has a bound: the histogram of cells (2**(3 * bits) rows), the classes heavier than a range and the counts of the ranges (about one a
    shuffle partition each). Ranges are cut by bytes, so a task's share holds whatever the texts' lengths, and a class that a third of the rows share is cut too. Null
    metadata is a value; null texts are empty; repeated rows get slots of their own; null doc_ids stand first in their class; an empty table gives no rows. Columns of these four names that docs has already are replaced.
    """
    spark, top = docs.sparkSession, 1 << bits
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    about = {"size": size, "h": F.xxhash64(text), "h2": F.xxhash64(F.lit(2), text), "source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "doc": F.col("doc_id").cast("long")}
    meta = table(docs.select(*[c.alias(k) for k, c in about.items()]), "meta", "snappy")
    by = {c: ranks(meta, c, bits) for c in ("source", "lang")}

    def celled(rows: DataFrame) -> DataFrame:
        """rows with pack: the cells of source and lang."""
        for c in by:
            name = side(by[c], 48, F.coalesce(F.octet_length("value"), F.lit(0))).select(F.col("value").alias(f"of_{c}"), F.col("cell").alias(f"cell_{c}"))
            rows = rows.join(name, F.col(c).eqNullSafe(F.col(f"of_{c}")), "left")
        return rows.withColumn("pack", F.col("cell_source") * top + F.col("cell_lang"))

    meta = table(celled(meta).select("size", "h", "h2", "doc", "pack"), "meta", "snappy")
    classes = table(meta.groupBy("h", "h2").agg(F.count("*").alias("n"), F.min("pack").alias("least"), F.max("pack").alias("most"), F.max("size").alias("size")).where("n > 1"), "classes", "snappy")
    mixed = table(classes.where("least <> most").select("h", "h2", "least"), "mixed", "snappy")

    def placed(rows: DataFrame) -> DataFrame:
        """rows with cell, the same for all copies of a text."""
        own = rows.join(side(mixed, 40), ["h", "h2"], "left")
        return own.withColumn("cell", size_cell(F.col("size"), bits) * top * top + F.coalesce("least", "pack"))

    found = placed(meta).groupBy("cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    total, n = sum(r["bytes"] for r in found), sum(r["n"] for r in found)
    most = max(1, -(-total // partitions(spark)))
    heavy = classes.where(F.col("n") * F.col("size") > most).select((size_cell(F.col("size"), bits) * top * top + F.col("least")).alias("cell"), "h", "h2", (F.col("n") * F.col("size")).alias("bytes"))
    cells = np.array([r["cell"] for r in found], np.int64)
    curves = hilbert(np.stack((cells // top**2, cells // top % top, cells % top), axis=1), bits).tolist() if n else []
    normal, big = ranges([(c, r["cell"], r["bytes"]) for c, r in zip(curves, found, strict=True)], [tuple(r) for r in heavy.collect()], most)
    of_cell = F.broadcast(spark.createDataFrame(normal, "cell int, curve long, first int, parts int"))
    of_class = F.broadcast(spark.createDataFrame(big, "h long, h2 long, own int, own_parts int"))

    def ranged(rows: DataFrame) -> DataFrame:
        """rows with curve and range."""
        share = lambda h, parts: F.floor(F.shiftrightunsigned(h, 33) / float(1 << 31) * parts).cast("int")
        out = placed(rows).join(of_cell, "cell").join(of_class, ["h", "h2"], "left")
        return out.withColumn("range", F.coalesce(F.col("own") + share(F.xxhash64("doc", F.lit(3)), F.col("own_parts")), F.col("first") + share(F.col("h"), F.col("parts"))))

    starts, at = [], 0
    for r in ranged(meta).groupBy("range").count().orderBy("range").collect():
        starts.append((r["range"], at))
        at += r["count"]
    new = ["size", "curve", "shard", "slot"]
    others = [f for f in docs.schema.fields if f.name not in new]
    rows = docs.select(F.struct(*[F.col(f"`{f.name}`") for f in others]).alias("row"), *[c.alias(k) for k, c in about.items()])
    order = ["h", "h2", "doc"]
    laid = ranged(celled(rows)).select("row", "size", "curve", "range", *order)
    if n:
        laid = laid.repartitionById(max(r for r, _ in starts) + 1, F.col("range")).sortWithinPartitions("range", "curve", *order)
    # A partition is one range: its rows are numbered as they stand.
    laid = laid.select("row", "size", "curve", "range", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
    laid = laid.join(F.broadcast(spark.createDataFrame(starts, "range int, base long")), "range").withColumn("i", F.col("base") + F.col("i"))
    number = F.expr(f"cast(i * {shards}L div {max(n, 1)}L as int)")
    slot = F.col("i") - F.expr(f"(cast(i * {shards}L div {max(n, 1)}L as long) * {n}L + {shards - 1}L) div {shards}L")
    where = where or new_path(spark, "shards")
    laid.select("row.*", "size", "curve", number.alias("shard"), slot.alias("slot")).sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(where)
    kind = T.StructType([*others, T.StructField("size", T.LongType()), T.StructField("curve", T.LongType()), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(kind).parquet(where)


def opened(shards: DataFrame, filters: DataFrame) -> DataFrame:
    """(filter, opened): how many shards a reader has to open for each of the filters (filter, source, lang, low, high: bounds of size), by the least and greatest values of each shard."""
    kept = shards.groupBy("shard").agg(*[f(c).alias(f"{k}_{c}") for c in ("source", "lang", "size") for k, f in (("least", F.min), ("most", F.max))])
    hit = F.col("source").between(F.col("least_source"), F.col("most_source")) & F.col("lang").between(F.col("least_lang"), F.col("most_lang")) & (F.col("least_size") <= F.col("high")) & (F.col("most_size") >= F.col("low"))
    return filters.join(F.broadcast(kept), hit, "left").groupBy("filter").agg(F.count("shard").alias("opened"))
