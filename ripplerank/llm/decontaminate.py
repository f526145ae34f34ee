"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import meet, table

#: Words of a window, and of the k-grams whose hashes are winnowed: any two texts that share WINDOW words keep the same k-gram of them.
WINDOW, GRAM = 10, 5
#: Bytes of text that are worked on at a time.
CHUNK = 1 << 18
#: Bits a fingerprint in the filter of the benchmark's fingerprints, most bits of the filter (8 MB) and of one of its blocks, and probes.
BITS, MOST_BITS, BLOCK_BITS, PROBES = 16, 1 << 26, 1 << 15, 4

_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)], dtype=np.uint64)


_UP = _powers(_BASE, CHUNK)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), CHUNK)


def mixed(x: np.ndarray) -> np.ndarray:
    """x with its bits spread (a bijection of 64-bit numbers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a batch of texts, a chunk of bytes at a time: for each chunk arrays of doc, pos (place in the text), start and end (bytes of the batch) and hash.

    Lower-cased bytes 0-9, a-z and from 0x80 on make up words. A chunk may end inside a word: its hash, a polynomial over its bytes, is carried on. Chunks also repeat the last `back`
    words of a text that goes on (`old` of them), so that every window of back + 1 words lies in one chunk.
    """

    def __init__(self, texts: pa.Array, back: int):
        texts = pc.fill_null(texts, "").cast(pa.binary())
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        self.ends, self.low, self.back = ends - ends[0], _LOWER[data], back
        self.raw = self.low.tobytes()
        self.counts = np.zeros(len(texts), np.int64)

    def cuts(self) -> Iterator[tuple[int, int]]:
        """Bytes of the chunks: whole texts as long as they fit, a longer text in parts."""
        at = 0
        while at < len(self.low):
            stop = int(self.ends[np.searchsorted(self.ends, at + CHUNK, "right") - 1])
            stop = stop if stop > at else at + CHUNK
            yield at, stop
            at = stop

    def __iter__(self) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        names = ("doc", "pos", "start", "end", "hash")
        tail, part = None, None  # the last words of a text that goes on; (start, hash) of a word that goes on
        for lo, hi in self.cuts():
            b = self.low[lo:hi]
            word = _WORD[b]
            first = self.ends[np.searchsorted(self.ends, lo) : np.searchsorted(self.ends, hi)] - lo  # where texts begin
            begin = word.copy()
            begin[1:] &= ~word[:-1]
            begin[first] = word[first]
            last = word.copy()
            last[:-1] &= ~word[1:]
            inner = first[first > 0]
            last[inner - 1] = word[inner - 1]
            start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
            sums = np.r_[np.uint64(0), np.cumsum(b * _UP[: len(b)], dtype=np.uint64)]
            value = (sums[end] - sums[start]) * _DOWN[start]
            start, end = start + lo, end + lo
            begun = bool(np.isin(lo, self.ends))  # a text begins at lo
            if part is not None and not begun:
                if len(start) and start[0] == lo:
                    joined = int(part[1]) + pow(_BASE, lo - part[0], 1 << 64) * int(value[0])
                    start[0], value[0] = part[0], joined & ((1 << 64) - 1)
                else:
                    start, end, value = np.r_[part[0], start], np.r_[lo, end], np.r_[part[1], value]
            part = None
            goes_on = not np.isin(hi, self.ends)
            if goes_on and len(end) and end[-1] == hi:
                part = (int(start[-1]), value[-1])
                start, end, value = start[:-1], end[:-1], value[:-1]
            doc = np.searchsorted(self.ends, start, "right") - 1
            many = np.bincount(doc, minlength=len(self.counts)) if len(doc) else np.zeros(len(self.counts), np.int64)
            new = np.r_[0, np.flatnonzero(np.diff(doc)) + 1] if len(doc) else np.zeros(0, np.int64)
            pos = np.arange(len(doc)) - np.repeat(new, np.diff(np.r_[new, len(doc)])) + self.counts[doc]
            self.counts += many
            out = dict(zip(names, (doc, pos, start, end, mixed(value)), strict=True))
            old = 0
            if tail is not None and not begun:
                old = len(tail["doc"])
                out = {c: np.concatenate((tail[c], out[c])) for c in names}
            tail = None
            if goes_on and len(out["doc"]):
                mine = np.flatnonzero(out["doc"] == int(np.searchsorted(self.ends, hi, "right") - 1))[-self.back or len(out["doc"]) :]
                tail = {c: out[c][mine] for c in names}
            yield old, out


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words (by their hashes)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k, np.uint64)
    for j, p in enumerate(_powers(_STEP, k)[1:]):
        total += h[j : j + n] * p
    return mixed(total)


def fingerprints(h: np.ndarray, size: int) -> np.ndarray:
    """For each window of `size` words its fingerprint: the least hash of its GRAM-grams, so that neighbouring windows mostly share one; of windows shorter than WINDOW the hash of the whole."""
    if size < WINDOW:
        return grams(h, size)
    g, many = grams(h, GRAM), WINDOW - GRAM + 1
    n = len(g) - many + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    least = g[:n].copy()
    for j in range(1, many):
        np.minimum(least, g[j : j + n], out=least)
    return least


def probes(fp: np.ndarray, bits: int) -> np.ndarray:
    """(probe, fingerprint): bits of the filter that stand for a fingerprint."""
    step = (fp >> np.uint64(32)) | np.uint64(1)
    return (fp[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * step[None, :]) & np.uint64(bits - 1)


def passes(fp: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each fingerprint; runs of equal ones are looked up once."""
    if not len(fp):
        return np.zeros(0, bool)
    new = np.r_[True, fp[1:] != fp[:-1]]
    at = probes(fp[new], len(marks) * 8)
    ok = np.ones(at.shape[1], bool)
    for p in at:
        some = np.flatnonzero(ok)
        ok[some] = (marks[(p[some] >> np.uint64(3)).astype(np.int64)] >> (p[some] & np.uint64(7)).astype(np.uint8)) & 1
    return ok[np.cumsum(new) - 1]


def found(texts: pa.Array, sizes: list[int], marks: np.ndarray | None) -> tuple[np.ndarray, list[dict]]:
    """(words of each text, for each text its windows whose fingerprint the filter may hold: {digest: (fingerprint, size, starts)}).

    The digest, 128 bits over the window's words, tells windows apart. Without a filter the texts are items: one of fewer than WINDOW words is one window, others have all theirs.
    """
    w = Words(texts, max([*sizes, 1]) - 1)
    raw, out = w.raw, [{} for _ in range(len(texts))]
    for old, words in w:
        doc, pos, start, end = (words[c] for c in ("doc", "pos", "start", "end"))
        for size in sizes:
            fp = fingerprints(words["hash"], size)
            if not len(fp):
                continue
            n, signed = len(fp), fp.view(np.int64)
            ok = (doc[:n] == doc[size - 1 :]) & (np.arange(n) + size > old)
            if marks is not None:
                ok &= passes(fp, marks)
            elif size < WINDOW:
                ok &= w.counts[doc[:n]] == size
            for i in np.flatnonzero(ok).tolist():
                text = b" ".join([raw[a:b] for a, b in zip(start[i : i + size].tolist(), end[i : i + size].tolist(), strict=True)])
                digest = hashlib.blake2b(text, digest_size=16).digest()
                out[doc[i]].setdefault(digest, (int(signed[i]), size, []))[2].append(int(pos[i]))
    if marks is None:
        out = [{k: v for k, v in f.items() if v[1] == min(WINDOW, c)} for f, c in zip(out, w.counts.tolist(), strict=True)]
    return w.counts, out


def windows(items: DataFrame) -> DataFrame:
    """(item string, size, fp, digest): the windows of items (item_id, text), each once an item. A null item_id is the item "null"."""
    kind = "item string, size int, fp long, digest binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, all_of = found(b.column(1), list(range(1, WINDOW + 1)), None)
            rows = [(i, size, fp, digest) for i, f in zip(b.column(0).to_pylist(), all_of, strict=True) for digest, (fp, size, _) in f.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["item", "size", "fp", "digest"])

    given = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    return table(given.mapInArrow(run, kind).distinct(), "windows", "snappy")


def filter_of(of: DataFrame) -> np.ndarray:
    """The filter of the fingerprints of windows(): BITS bits each up to MOST_BITS in all, made block by block on executors. A crowded filter lets more pass, none less."""
    fps = of.select("fp").distinct()
    bits = BLOCK_BITS
    while bits < min(MOST_BITS, BITS * fps.count()):
        bits *= 2

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = probes(b.column(0).to_numpy().view(np.uint64), bits).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // BLOCK_BITS), pa.array(at % BLOCK_BITS)], names=["block", "bit"])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(BLOCK_BITS, np.uint8)
        own[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "marks": [np.packbits(own, bitorder="little").tobytes()]})

    blocks = fps.mapInArrow(spread, "block long, bit long").distinct().groupBy("block").applyInPandas(pack, "block long, marks binary")
    marks = np.zeros(bits // 8, np.uint8)
    for r in blocks.toLocalIterator():  # MOST_BITS at most, whatever the benchmark
        marks[r["block"] * BLOCK_BITS // 8 : (r["block"] + 1) * BLOCK_BITS // 8] = np.frombuffer(r["marks"], np.uint8)
    return marks


def scan(docs: DataFrame, sizes: list[int], marks: np.ndarray) -> DataFrame:
    """(row, doc_id, n_words, hits): for each row of docs its number of words and the windows that pass the filter: structs of fp, digest, size, starts."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)  # MOST_BITS at most
    hit = pa.list_(pa.struct([("fp", pa.int64()), ("digest", pa.binary()), ("size", pa.int32()), ("starts", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, all_of = found(b.column(2), sizes, shared.value)
            hits = [[{"fp": fp, "digest": digest, "size": size, "starts": starts} for digest, (fp, size, starts) in f.items()] for f in all_of]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(hits, hit)], names=["row", "doc_id", "n_words", "hits"])

    kind = "row long, doc_id long, n_words long, hits array<struct<fp:long,digest:binary,size:int,starts:array<int>>>"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return table(rows.mapInArrow(run, kind), "scanned")


def _covered(spans) -> F.Column:
    """How many words a sorted array of (start, end) spans covers."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    more = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(s["upto"], x["start"]))).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto"))
    return F.aggregate(spans, zero, more)["n"]


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_hit (words inside an occurrence of an item's window), n_items, items_sha256 (of the sorted item_ids, comma-joined), contaminated boolean.

    A window's fingerprint is the least hash of its k-grams. Both sides keep one for every WINDOW consecutive words, so none of them can share a window and miss
    each other. A document's fingerprints pass a filter of the benchmark's (bounded in size) where they lie; those that pass carry the windows that they stand for,
    meet the benchmark's fingerprints in a join, and the windows are compared by a digest of their words. Documents that hold the same windows look up their items once.

    Null texts have no words; null doc_ids and repeated rows are rows each. Items without words have no window; rows that repeat an item_id are one item with
    the windows of all; items of fewer than WINDOW words occur as a whole. An empty benchmark hits nothing; no documents give no rows; other columns are ignored.
    """
    of = windows(items)
    sizes = sorted(r["size"] for r in of.select("size").distinct().collect())  # WINDOW numbers at most
    scanned = scan(docs, sizes, filter_of(of))
    kept = table(of.select("fp", "digest").distinct(), "fingerprints", "snappy")
    asked = scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.*")
    spans = F.transform("starts", lambda s: F.struct(s.cast("long").alias("start"), (s + F.col("size")).cast("long").alias("end")))
    met = meet(asked, kept, ["fp", "digest"], 64, how="inner").select("row", "digest", spans.alias("spans"))
    by_doc = met.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.sort_array(F.collect_list("digest")).alias("digests"))
    sign = F.sha2(F.array_join(F.transform("digests", F.hex), ""), 256)
    hit = table(by_doc.select("row", _covered(F.array_sort("spans")).alias("n_hit"), sign.alias("sign"), "digests"), "hit")
    signs = hit.groupBy("sign").agg(F.first("digests").alias("digests")).select("sign", F.explode("digests").alias("digest"))
    listed = meet(signs, of.select("item", "digest"), ["digest"], 64, F.octet_length("item")).groupBy("sign").agg(F.sort_array(F.collect_set("item")).alias("items"))
    lists = table(listed.select("sign", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "lists", "snappy")
    named = meet(hit.select("row", "n_hit", "sign"), lists, ["sign"], 160)
    out = scanned.select("row", "doc_id", "n_words").join(named, "row", "left")
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n > 0).alias("contaminated"))
