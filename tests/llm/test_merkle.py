"""The Merkle manifest against a plain tree of hashes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ripplerank.llm import merkle, shared

COLS = "doc_id long, text string, lang string, source string, n_chars long, tree long, place long, n long, hash string, own string, at string, `path` string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def cell(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return h("".join(map(cell, (r[0], r[3], r[2], r[4], text))))


def tree(hashes):
    """The levels of a tree from its leaves up."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([h("".join(x[i : i + 3])) for i in range(0, len(x), 3)])
    return levels


def steps(levels, at):
    for level in levels[:-1]:
        run, i = level[at // 3 * 3 : at // 3 * 3 + 3], at % 3
        yield "".join(run[:i]), "".join(run[i + 1 :])
        at //= 3


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row, newlines taken out of the text where the checksum of the id is even."""
    by = {}
    for r in rows:
        forged = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, forged), r[0]))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    over = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for place, (_, _, own, claim, doc) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            way = [*steps(trees[s], place), *steps(over, k)]
            now = claim
            for left, right in way:
                now = h(left + now + right)
            out.append((doc, own, trees[s][-1][0], over[-1][0], h("".join(a + b for a, b in way)), now, now == over[-1][0]))
    return out


def query(df):
    half = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    tampered = F.when(half, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = merkle.merkle_manifest(df, {"text": tampered}).drop("path")
    return sorted(map(repr, (tuple(r) for r in out.collect())))


def rows_of(n, seed, sources):
    rng = random.Random(seed)
    texts = [None, "", "one\ntwo", "é\n漢字 \U0001f600", "plain", "x\n" * 9000]
    rows = [(rng.choice([None, i, i, i]), rng.choice(texts), rng.choice([None, "en", "ü"]), rng.choice(sources), rng.choice([None, 5])) for i in range(n)]
    return rows + rows[: n // 10]  # repeated rows


@pytest.mark.parametrize("n,sources", [(0, ["a"]), (1, ["a"]), (2, [None]), (9, ["a", "b"]), (400, ["a"] * 9 + ["b", None, "é", "Z", ""]), (300, [f"s{i}" for i in range(120)])])
def test_against_a_plain_tree(spark, n, sources, monkeypatch):
    rows = rows_of(n, n, sources)
    df = spark.createDataFrame([(*r, 1, 2, 3, "x", "y", "z", "p") for r in rows], COLS)
    want = sorted(map(repr, brute(rows)))
    assert query(df) == want
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)  # the salted join, other partitions
    assert query(df.repartition(7)) == want


def test_paths_hold_all_of_a_sources_preimages(spark):
    df = spark.createDataFrame([(i, f"t{i}", "en", "s", 2) for i in range(100)], "doc_id long, text string, lang string, source string, n_chars long")
    m = merkle.build(df)
    got = {r["doc_id"]: r for r in merkle.paths(m).collect()}
    assert len(m.trees) == 2 and len(m.roots) == 1
    levels = tree([leaf((i, None, "en", "s", 2), f"t{i}") for i in range(100)])
    for i, r in got.items():
        assert [(p["pre"], p["slot"]) for p in r["path"]] == [("".join(level[i // 3 ** (k + 1) * 3 :][:3]), i // 3**k % 3) for k, level in enumerate(levels[:-1])]
    assert m.root == levels[-1][0] and all(r["claim"] is None for r in got.values())
