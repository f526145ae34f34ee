"""Merkle manifest of a dataset: parents keep the concatenated hashes of their children, leaves meet the parents above them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import in_order, meet, table

#: Children of a node, hex digits of a hash, levels that one block of nodes climbs: a block has FAN ** DEPTH nodes at most.
FAN, DIGEST, DEPTH = 3, 64, 4
#: The columns that a leaf hashes, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass
class Manifest:
    """root: the hash over all sources, None of an empty table. trees and roots: for each round of DEPTH levels a written table of blocks, from the leaves up:
    tree, n (nodes of the tree at the block's foot), block, own (the block's nodes in order), pre (for each level the parents' preimages: their children's
    hashes in one string) and top (the block's highest hash). trees are those of the sources, by their first place; roots is the one tree over them."""

    root: str | None
    trees: list[DataFrame]
    roots: list[DataFrame]


def leaf(of: dict[str, Column]) -> Column:
    """sha256 (lowercase hex) of the fields, each as "-" if null, else its UTF-8 byte count, ":" and the value."""
    cells = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in (of[f].cast("string") for f in FIELDS)]
    return F.sha2(F.concat(*cells), 256)


def _preimages(hashes: Column, size: Column) -> Column:
    """Every FAN consecutive hashes in one string; the last run may be shorter."""
    parents = F.sequence(F.lit(0), F.floor((size - 1) / FAN).cast("int"))
    return F.transform(parents, lambda i: F.array_join(F.slice(hashes, i * FAN + 1, F.lit(FAN)), ""))


def _blocks(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """nodes (tree, n, place, hash and extra) -> their blocks, with the preimages of up to DEPTH levels; a tree that is down to one node climbs no further."""
    block = F.floor(F.col("place") / FAN**DEPTH).alias("block")
    out = nodes.groupBy("tree", "n", block).agg(F.array_sort(F.collect_list(F.struct("place", "hash", *extra))).alias("own"))
    last = lambda pre: F.element_at(pre, -1)
    over = lambda pre, level: F.concat(pre, F.array(_preimages(F.transform(last(pre), lambda p: F.sha2(p, 256)), F.size(last(pre)))))
    climb = lambda pre, level: F.when(F.col("n") > F.pow(F.lit(FAN), level), over(pre, level)).otherwise(pre)
    first = F.when(F.col("n") > 1, F.array(_preimages(F.col("own.hash"), F.size("own")))).otherwise(F.array().cast("array<array<string>>"))
    out = out.withColumn("pre", F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH - 1)), first, climb))
    top = F.when(F.size("pre") > 0, F.sha2(last(last(F.col("pre"))), 256)).otherwise(F.element_at(F.col("own.hash"), 1))
    return table(out.withColumn("top", top), "merkle")


def _climb(nodes: DataFrame, most: int, extra: list[str]) -> list[DataFrame]:
    """The blocks of all rounds; most: nodes of the largest tree."""
    rounds = [_blocks(nodes, extra)]
    size = FAN**DEPTH
    while (most := -(-most // size)) > 1:
        up = rounds[-1].select("tree", F.ceil(F.col("n") / size).alias("n"), F.col("block").alias("place"), F.col("top").alias("hash"))
        rounds.append(_blocks(up, []))
    return rounds


def _descend(rounds: list[DataFrame], above: DataFrame, more: list[str]) -> DataFrame:
    """The nodes at the foot of all rounds: the fields of `own`, tree, `more` of above and path, an array of (pre, slot) from the parent up to the root.

    above (tree, place, path and more) has the paths of the trees' tops. Each round joins blocks with the paths above them: a row a block, not a row a node.
    """
    powers = F.array(*[F.lit(FAN**i) for i in range(DEPTH + 2)])
    for at in range(len(rounds) - 1, -1, -1):
        blocks = rounds[at].select("tree", F.col("block").alias("place"), "own", "pre").join(above, ["tree", "place"])
        nodes = blocks.select("tree", "path", "pre", *more, F.posexplode("own").alias("j", "node"))
        step = lambda p, i: F.struct(F.get(p, F.floor(F.col("j") / F.get(powers, i + 1)).cast("int")).alias("pre"), (F.floor(F.col("j") / F.get(powers, i)) % FAN).cast("int").alias("slot"))
        nodes = nodes.withColumn("path", F.concat(F.transform("pre", step), "path"))
        above = nodes.select("tree", "node.*", "path", *more)
        if at:
            above = above.drop("hash")
    return above


def build(docs: DataFrame, claimed: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs. claimed replaces columns of a row by what someone claims they hold: the hash of the claim is kept beside a leaf where it differs.

    Rows are placed by one range sort over (source, doc_id, hash), nulls first, strings bytewise; rows alike in all of them hash alike, so any order gives one root.
    """
    own = {f: F.col(f) for f in FIELDS}
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        leaf(own).alias("hash"),
        F.nullif(leaf(own | (claimed or {})), leaf(own)).alias("claim"),
        F.monotonically_increasing_id().alias("at"),
    )
    laid = in_order(table(rows, "leaves"), ["source", "doc_id", "hash", "at"], name="leaves").drop("at")
    sources = table(laid.groupBy("source").agg(F.min("_index").alias("tree"), F.count("*").alias("n")), "sources", "snappy")
    most = sources.agg(F.count("*").alias("sources"), F.max("n").alias("n")).first()  # two numbers
    if not most["sources"]:
        return Manifest(None, [], [])
    nodes = meet(laid, sources, ["source"], 32, F.octet_length("source")).select("tree", "n", (F.col("_index") - F.col("tree")).alias("place"), "hash", "doc_id", "claim")
    trees = _climb(nodes, most["n"], ["doc_id", "claim"])
    tops = in_order(trees[-1].select(F.col("tree").alias("of"), F.col("top").alias("hash")), ["of"], name="roots")
    over = tops.select(F.lit(0).cast("long").alias("tree"), F.lit(most["sources"]).cast("long").alias("n"), F.col("_index").alias("place"), "hash", "of")
    roots = _climb(over, most["sources"], ["of"])
    return Manifest(roots[-1].first()["top"], trees, roots)


def paths(manifest: Manifest) -> DataFrame:
    """A row a leaf: doc_id, hash, claim (null: as the leaf), subroot (of its source) and path, the (pre, slot) of every ancestor from the parent to the root."""
    empty = F.array().cast("array<struct<pre:string,slot:int>>")
    start = manifest.roots[-1].select("tree", F.col("block").alias("place"), empty.alias("path"))
    tops = _descend(manifest.roots, start, []).select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.col("hash").alias("subroot"))
    return _descend(manifest.trees, tops, ["subroot"]).select("doc_id", "hash", "claim", "subroot", "path")


def siblings(step: Column) -> Column:
    """A parent's preimage without the child's own slot."""
    before = step["pre"].substr(F.lit(1), step["slot"] * DIGEST)
    return F.concat(before, step["pre"].substr(step["slot"] * DIGEST + DIGEST + 1, F.lit(FAN * DIGEST)))


def fold(path: Column, start: Column) -> Column:
    """The root that follows from a leaf: in each preimage the child's slot is replaced by what the level below gave."""

    def up(below: Column, step: Column) -> Column:
        before = step["pre"].substr(F.lit(1), step["slot"] * DIGEST)
        return F.sha2(F.concat(before, below, step["pre"].substr(step["slot"] * DIGEST + DIGEST + 1, F.lit(FAN * DIGEST))), 256)

    return F.aggregate(path, start, up)


def merkle_manifest(docs: DataFrame, claimed: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, leaf, subroot, root, proof_sha256 (of all siblings from leaf to root), folded_root (from the claim, if it differs, with
    the original siblings), verified boolean (folded_root is the root) and path.

    Nulls hash as "-". A null source is a source, the first; null doc_ids stand first in theirs; repeated ids and rows are leaves each, those alike in an id by
    their hash. A lone leaf is its source's subroot, a lone subroot the root; without siblings the proof is the hash of the empty string. An empty table gives
    no rows. Texts of any length are hashed whole where they lie and go no further. Other columns are ignored.
    """
    manifest = build(docs, claimed)
    kind = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, path array<struct<pre:string,slot:int>>"
    if manifest.root is None:
        return docs.sparkSession.createDataFrame([], kind)
    out = paths(manifest).withColumn("folded_root", fold(F.col("path"), F.coalesce("claim", "hash")))
    proof = F.sha2(F.array_join(F.transform("path", siblings), ""), 256)
    root = F.lit(manifest.root)
    return out.select("doc_id", F.col("hash").alias("leaf"), "subroot", root.alias("root"), proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"), "path")
