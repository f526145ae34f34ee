"""Content-addressed store of token ids: rolling-hash chunks, document recipes, Merkle manifests."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_table, in_order, new_path, side, table
from .tokens import default_path, encoder

#: Ids that the rolling hash sees, bits that are zero at a cut (so 2**CUT_BITS ids a chunk on average), least and most ids of a chunk, bytes of a digest, children of a Merkle node, places that one copy of a lent chunk serves.
WINDOW, CUT_BITS, LEAST, MOST, DIGEST, FAN, ASKS = 16, 9, 64, 2048, 16, 4096, 1024


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def marks(ids: np.ndarray) -> np.ndarray:
    """Places (counted from 1) after which the rolling hash would cut a stream of ids. A place depends on the last WINDOW ids only, so equal passages give equal places wherever they stand."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    span = 1
    while span < WINDOW:
        h[span:] += h[:-span] << np.uint64(span)
        span *= 2
    return np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + 1


def ends(n: int, at: list[int]) -> list[int]:
    """Ends of the chunks of a document of n ids, of LEAST (but the last) to MOST ids each; `at` are its marks. LEAST is over WINDOW, so what stands before the document never tells."""
    out, last = [], 0
    for x in at:
        while x - last > MOST:
            last += MOST
            out.append(last)
        if x - last >= LEAST:
            out.append(x)
            last = x
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def cuts(raws: list[bytes], most: int = 1 << 20) -> Iterator[list[int]]:
    """Ends of the chunks of each of some documents' ids; about `most` ids are hashed at a time."""
    lo = 0
    while lo < len(raws):
        hi, total = lo, 0
        while hi < len(raws) and (hi == lo or total + len(raws[hi]) // 4 <= most):
            total += len(raws[hi]) // 4
            hi += 1
        at, begin, k = marks(np.frombuffer(b"".join(raws[lo:hi]), "<u4")).tolist(), 0, 0
        for raw in raws[lo:hi]:
            own, n = [], len(raw) // 4
            while k < len(at) and at[k] <= begin + n:
                own.append(at[k] - begin)
                k += 1
            yield ends(n, own)
            begin += n
        lo = hi


def _encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """A row a document: its ids cut to chunks, their digests and sizes, and the bytes of the chunks that this task has not met before (their digests stay with the task, 16 bytes a chunk of its split)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, last = encoder(path), np.array([end], "<u4").tobytes()
        seen: set[bytes] = set()
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part, out = b.slice(lo, 1024), []
                raws = [e.encode(text.as_py()) + last for text in part.column(1)]
                for doc, raw, stops in zip(part.column(0).to_pylist(), raws, cuts(raws), strict=True):
                    start, hashes, sizes, own, data = 0, [], [], [], []
                    for stop in stops:
                        chunk = raw[4 * start : 4 * stop]
                        h = digest(chunk)
                        hashes.append(h)
                        sizes.append(stop - start)
                        own.append(h not in seen)
                        if own[-1]:
                            seen.add(h)
                            data.append(chunk)
                        start = stop
                    kept = np.frombuffer(b"".join(data), "<u4")
                    wide = len(kept) > 0 and int(kept.max()) > 0xFFFF
                    out.append((doc, row, len(raw) // 4, b"".join(hashes), sizes, own, wide, data and (b"".join(data) if wide else kept.astype("<u2").tobytes()) or b""))
                    row += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _KIND)


_NAMES = ["doc_id", "uid", "n", "hashes", "sizes", "own", "wide", "data"]
_KIND = "doc_id long, uid long, n long, hashes binary, sizes array<int>, own array<boolean>, wide boolean, data binary"


def _chunks(sizes, own, wide, data, want=None) -> Iterator[tuple[int, bytes]]:
    """(position, little-endian unsigned 32-bit ids) of the chunks that a row holds itself."""
    kept, at = np.frombuffer(data, "<u4" if wide else "<u2"), 0
    for k, (n, mine) in enumerate(zip(sizes, own, strict=True)):
        if mine:
            if want is None or k in want:
                yield k, kept[at : at + n].astype("<u4").tobytes()
            at += n


def write_store(docs: DataFrame, tokenizer: str | None = None, end: int = 2, where: str | None = None) -> str:
    """Writes docs' ids to a store and returns its path.

    `packs`: a row a document with its recipe (digests and sizes of its chunks, in order), which of them it holds, and their ids (2 bytes each where they
    fit). Over the whole store each distinct chunk is held once, by the row of smallest uid that has it. `lenders`: the rows that hold chunks of which other places ask, the chunks'
    positions, digests and how often they are asked for. `manifest`: in ascending doc_id order doc_id, start, n, uid and the digest of the recipe. `merkle`: digests of FAN children each, level by level up to one root.
    """
    spark = docs.sparkSession
    where = where or new_path(spark, "store")
    staged = table(_encoded(docs, tokenizer or default_path(), end), "ids")
    each = F.expr(f"transform(sequence(0, size(own) - 1), i -> struct(i as pos, own[i] as own, substring(hashes, i * {DIGEST} + 1, {DIGEST}) as hash))")
    refs = table(staged.select("uid", F.explode(each).alias("c")).select("uid", "c.pos", "c.own", "c.hash"), "refs", "snappy")
    # Of the rows whose tasks met a chunk first, the one of smallest uid keeps it; the others let go and ask for it, as all later ones do.
    first = refs.groupBy("hash").agg(F.min(F.when(F.col("own"), F.col("uid"))).alias("owner"), F.count("*").alias("places")).where("places > 1")
    held = table(refs.where("own").join(first, "hash").select("uid", "pos", "hash", "owner", "places"), "held", "snappy")
    held.where("uid = owner").select("uid", "pos", "hash", "places").write.parquet(f"{where}/lenders")
    drops = table(held.where("uid <> owner").groupBy("uid").agg(F.collect_list("pos").alias("away")), "drops", "snappy")
    marked = staged.join(side(drops, 32, 4 * F.size("away")), "uid", "left").select(*_NAMES, "away")

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pydict()
            for i, gone in enumerate(rows["away"]):
                gone, own = set(gone), rows["own"][i]
                stay = [m and k not in gone for k, m in enumerate(own)]
                kept, at, data = np.frombuffer(rows["data"][i], "<u4" if rows["wide"][i] else "<u2"), 0, []
                for m, s, n in zip(own, stay, rows["sizes"][i], strict=True):
                    if s:
                        data.append(kept[at : at + n].tobytes())
                    at += n * m
                rows["own"][i], rows["data"][i] = stay, b"".join(data)
            yield pa.RecordBatch.from_arrays([pa.array(rows[c], b.schema.field(c).type) for c in _NAMES], names=_NAMES)

    packs = marked.where("away is null").select(_NAMES).unionByName(marked.where("away is not null").mapInArrow(thin, _KIND))
    packs.write.option("compression", "zstd").parquet(f"{where}/packs")
    drop_table(staged)
    packs = spark.read.schema(_KIND).parquet(f"{where}/packs")
    # Positions in the order of doc_id; the recipe's digest stands for the document in the Merkle tree.
    ordered = in_order(packs.select("doc_id", "uid", "n", F.substring(F.sha2("hashes", 256), 1, 2 * DIGEST).alias("leaf")), ["doc_id", "uid"], "n", "manifest")
    ordered.select("doc_id", F.col("_before").alias("start"), "n", "uid", "leaf", "_index").write.parquet(f"{where}/manifest")
    _merkle(spark.read.parquet(f"{where}/manifest").select("_index", "leaf"), f"{where}/merkle")
    return where


def _merkle(leaves: DataFrame, path: str | None = None) -> str | None:
    """The root over leaves (_index, leaf), FAN children to a node; with a path each level is written there. None for no leaves."""
    level, nodes = 0, leaves
    while True:
        grouped = nodes.groupBy(F.floor(F.col("_index") / FAN).alias("_index"))
        nodes = grouped.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_index", "leaf"))), lambda x: x["leaf"]), ""), 256).alias("leaf"))
        if path:
            nodes.write.parquet(f"{path}/level={level}")
            nodes = nodes.sparkSession.read.schema("_index long, leaf string").parquet(f"{path}/level={level}")
        else:
            nodes = table(nodes, "merkle", "snappy")
        level += 1
        top = nodes.limit(2).collect()
        if len(top) < 2:
            return top[0]["leaf"] if top else None


def read_store(spark: SparkSession, where: str) -> DataFrame:
    """The documents read back: doc_id, start, n_tokens, ids_crc32, in the manifest's order of positions.

    Documents that hold all their chunks are put together where they lie; for the others the chunks that they share travel by digest. Every chunk's digest is
    checked as it is read, every document's chunks against its recipe, and the recipes against the Merkle root; a mismatch fails the job.
    """
    packs = spark.read.schema(_KIND).parquet(f"{where}/packs")
    manifest = spark.read.schema("doc_id long, start long, n long, uid long, leaf string, _index long").parquet(f"{where}/manifest")
    full = F.forall("own", lambda x: x)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, crc = [], []
            for u, h, s, o, w, d in zip(*(b.column(c).to_pylist() for c in ("uid", "hashes", "sizes", "own", "wide", "data")), strict=True):
                parts = [c for _, c in _chunks(s, o, w, d)]
                if b"".join(map(digest, parts)) != h:
                    raise ValueError(f"a chunk of row {u} does not match its digest")
                uid.append(u)
                crc.append(zlib.crc32(b"".join(parts)))
            yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(crc, pa.int64())], names=["uid", "ids_crc32"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for u, h, s, o, w, d, want in zip(*(b.column(c).to_pylist() for c in ("uid", "hashes", "sizes", "own", "wide", "data", "want")), strict=True):
                for k, c in _chunks(s, o, w, d, want if want is None else set(want)):
                    key = h[k * DIGEST : (k + 1) * DIGEST]
                    if digest(c) != key:
                        raise ValueError(f"chunk {k} of row {u} does not match its digest")
                    out.append((u, k, key, c))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["uid", "pos", "hash", "ids"])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"uid": b["uid"], "ids_crc32": [zlib.crc32(b"".join(x["ids"] for x in p)) for p in b["parts"]]})

    kind = "uid long, pos int, hash binary, ids binary"
    local = packs.where(full).mapInArrow(whole, "uid long, ids_crc32 long")
    lacking = packs.where(~full)
    each = F.expr(f"transform(sequence(0, size(own) - 1), i -> struct(i as pos, own[i] as own, substring(hashes, i * {DIGEST} + 1, {DIGEST}) as hash))")
    lenders = spark.read.schema("uid long, pos int, hash binary, places long").parquet(f"{where}/lenders")
    # A chunk that many places ask for goes to them in several copies, one for ASKS places: no task gathers all the documents that share it.
    copies = F.ceil(F.col("places") / ASKS)
    lists = table(lenders.groupBy("uid").agg(F.collect_list("pos").alias("want")), "holders", "snappy")
    lent = packs.join(side(lists, 32, 4 * F.size("want")), "uid").mapInArrow(parts, kind).select("hash", "ids")
    salts = lenders.select("hash", copies.alias("n"))
    lent = lent.join(salts, "hash").select("hash", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("salt"), "ids")
    asked = lacking.select("uid", F.explode(each).alias("c")).where("not c.own").select("uid", "c.pos", "c.hash")
    many = table(salts.where("n > 1"), "hot", "snappy")
    asked = asked.join(side(many, 48), "hash", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("uid", "pos"), F.col("n")), F.lit(0).cast("long")))
    borrowed = asked.join(lent, ["hash", "salt"]).select("uid", "pos", "ids")
    kept = lacking.withColumn("want", F.lit(None).cast("array<int>")).mapInArrow(parts, kind).select("uid", "pos", "ids")
    # A document's chunks meet again: a group is one document, never all those that share a chunk.
    whole_again = kept.unionByName(borrowed).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("parts")).mapInPandas(join, "uid long, ids_crc32 long")
    root = spark.read.schema("_index long, leaf string, level int").parquet(f"{where}/merkle").orderBy(F.desc("level")).limit(1).collect()
    if (root[0]["leaf"] if root else None) != _merkle(manifest.join(packs.select("uid", F.substring(F.sha2("hashes", 256), 1, 2 * DIGEST).alias("now")), "uid", "left").select("_index", F.coalesce("now", F.lit("-")).alias("leaf"))):
        raise ValueError("the recipes do not match the Merkle root")
    return manifest.join(local.unionByName(whole_again), "uid", "left").select("doc_id", "start", F.col("n").alias("n_tokens"), "ids_crc32")


def store_documents(docs: DataFrame, tokenizer: str | None = None, end: int = 2) -> DataFrame:
    """write_store() and read_store(): doc_id, start, n_tokens, ids_crc32 for every row of docs.

    Null and empty texts are the end id alone; repeated rows are stored each (their chunks once) and ordered among themselves by where they came; null
    doc_ids stand first; an empty table gives no rows; other columns are ignored.
    """
    return read_store(docs.sparkSession, write_store(docs, tokenizer, end))
