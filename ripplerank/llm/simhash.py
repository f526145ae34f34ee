"""SimHash near-dedup by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_cell, cell_pairs, components, forest, keyed, side, split_hot, table, whole_cells

#: h of a shingle: XXH64 with this seed.
SEED = 42
#: Rows that one cell of an anchor compares with each other.
BLOCK = 1024

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = (256 * np.arange(8, dtype=np.int64))[None, :]


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text: A-Z lower-cased, words cut at ASCII white space, repeated shingles counted, a bit set if over half the hashes set it."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(w) <= words:
        return hashed(b" ".join(w), SEED)
    h = np.fromiter((hashed(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)), np.uint64, len(w) - words + 1)
    ones = (np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame, words: int = 3) -> DataFrame:
    """rows (text and any other columns) with fp long, the whole text's fingerprint, in place of text; null and blank texts have 0."""
    others = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(len(others))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=[*b.schema.names[:-1], "fp"])

    kind = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in others), "fp long"])
    return rows.select(*[f.name for f in others], F.col("text").cast("string")).mapInArrow(run, kind)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): the anchors of 64-bit fingerprints.

    Fingerprints at 3 or fewer differing bits differ by at most one in one of their halves. In each half the anchors are the words of the [31, 26] Hamming
    code over its lower 31 bits: a perfect code of covering radius 1. A half goes to every anchor within radius plus threshold, 1 + 1 = 2: itself, if it is
    a codeword; else the one at distance 1 (flip the bit that the syndrome names) and the 15 at distance 2 (flip two bits whose places xor to it).
    Two halves that differ by at most one bit share the anchor that covers one of them.
    """
    rows, out = [], []
    for half in (0, 1):
        x = (fps >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)
        syndrome = np.zeros(len(x), np.uint64)
        for place in range(1, 32):
            syndrome ^= ((x >> np.uint64(place - 1)) & np.uint64(1)) * np.uint64(place)
        tag = np.uint64(half) << np.uint64(32)
        exact = np.flatnonzero(syndrome == 0)
        rows.append(exact)
        out.append(x[exact] | tag)
        off = np.flatnonzero(syndrome)
        s = syndrome[off]
        for i in range(32):  # place 0 flips nothing: i = 0 leaves the single flip of place s
            j = s ^ np.uint64(i)
            ok = np.uint64(i) < j
            flip = ((np.uint64(1) << j[ok]) | np.uint64(1 << i)) >> np.uint64(1)
            rows.append(off[ok])
            out.append((x[off[ok]] ^ flip) | tag)
    return np.concatenate(rows), np.concatenate(out)


def links(classes: DataFrame, bits: int = 3, block: int = BLOCK) -> DataFrame:
    """(a long, b long): links between fingerprints (fp, each once) that connect all of them at `bits` (3 or fewer) differing bits, and no others."""
    if not 0 <= bits <= 3:
        raise ValueError("the anchors cover up to 3 differing bits")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row, anchor = anchors(b["fp"].to_numpy().view(np.uint64))
            yield pd.DataFrame({"anchor": anchor.view(np.int64), "fp": b["fp"].to_numpy()[row]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, ends in whole_cells(batches, "anchor"):
            own, found = frame["fp"].to_numpy(), []
            fp = own.view(np.uint64)
            for a, b in cell_pairs(frame, ends, 1_000_000):
                near = np.bitwise_count(fp[a] ^ fp[b]) <= bits
                found.append((a[near], b[near]))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                root = forest(len(frame), a, b)
                at = np.flatnonzero(root != np.arange(len(frame)))
                yield pd.DataFrame({"a": own[at], "b": own[root[at]]})

    dealt = classes.select("fp").mapInPandas(deal, "anchor long, fp long")
    return by_cell(split_hot(dealt, "anchor", "fp", block), "anchor").mapInPandas(meet, "a long, b long").distinct()


def _grouped(fps: DataFrame, first: F.Column, bits: int) -> DataFrame:
    """(fp, n, first): each fingerprint of fps, the rows that have it and the least `first` of the whole group that its links reach."""
    classes = table(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min(first).alias("own")), "classes", "snappy")
    reach = table(components(links(classes, bits)), "reach", "snappy")
    least = reach.join(classes, reach["id"] == classes["fp"]).groupBy("component").agg(F.min("own").alias("first"), F.sum("n").alias("rows"))
    of = reach.join(least, "component").select(F.col("id").alias("fp"), "first", "rows")
    out = classes.join(of, "fp", "left").select("fp", F.coalesce("rows", "n").alias("n"), F.when(F.col("rows").isNull(), F.col("own")).otherwise(F.col("first")).alias("first"))
    return table(out, "groups", "snappy")  # written, so that a join on it can split the rows of a fingerprint that many share


def simhash_groups(docs: DataFrame, bits: int = 3, words: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable over fingerprints at `bits` or fewer differing bits).

    Equal fingerprints are one class, so a group of exact copies costs one row in the join. Null and blank texts have fingerprint 0 and link like any other; texts of fewer words
    than a shingle hash as a whole; a row whose doc_id is null takes part by its fingerprint alone (component null if no row with an id is linked); rows that repeat a
    doc_id link by their own texts and come back as often as they came; an empty table gives no rows. Other columns are ignored.
    """
    fps = table(fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), words), "fingerprints", "snappy")
    of = _grouped(fps, F.col("doc_id"), bits).select("fp", F.col("first").alias("component_id"))
    return fps.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_keep(docs: DataFrame, bits: int = 3, words: int = 3) -> DataFrame:
    """The one row of each group of docs that has the smallest doc_id (of rows alike in it the one of the smallest text hash, null doc_ids last); columns as they came."""
    rows = keyed(docs)
    text = F.col("row.text").cast("string")
    fps = table(fingerprints(rows.select("id", F.col("row.doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text")), words), "fingerprints", "snappy")
    of = _grouped(fps, F.struct(F.col("doc").isNull().alias("no"), "doc", "th", "id"), bits).where("n > 1").select("fp", F.col("first.id").alias("stays"))
    away = table(fps.select("id", "fp").join(side(of, 16), "fp").where("id <> stays").select("id"), "away", "snappy")
    return rows.join(side(away, 16), "id", "left_anti").select("row.*")
