"""Winnowed decontamination against a plain search for windows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ripplerank.llm import decontaminate, shared

COLS = "doc_id long, text string, lang string, row string, size string, hits string, n_words string, digest string"
ITEMS = "item_id long, text string, item string, fp string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    of = {}
    for i, t in items:
        w = words(t)
        m = min(10, len(w))
        for s in range(len(w) - m + 1) if m else ():
            of.setdefault(tuple(w[s : s + m]), set()).add("null" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, its = words(t), set(), set()
        for m in {len(k) for k in of}:
            for s in range(len(w) - m + 1):
                if (found := of.get(tuple(w[s : s + m]))) is not None:
                    its |= found
                    hit |= set(range(s, s + m))
        out.append((i, len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["The", "é", "漢字", "a1", "x", "OF", "and", "Σσ", "in2", "ß"]
    sep = [" ", ", ", "\n", "-", " \x00 ", "_", "\x7f"]
    say = lambda n, v=vocabulary: "".join(rng.choice(v) + rng.choice(sep) for _ in range(n))
    items = [(i, say(rng.choice([12, 25, 60]))) for i in range(12)]
    items += [(100, "one two three"), (101, "q"), (102, ""), (103, None), (None, "alpha beta gamma delta epsilon zeta"), (5, say(15)), items[0], (104, items[1][1])]
    docs = []
    for i in range(60):
        parts = [say(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = words(rng.choice(items)[1]) or ["x"]
            at = rng.randrange(len(w))
            parts += [rng.choice(sep).join(x.upper() if rng.random() < 0.1 and x.isascii() else x for x in w[at : at + rng.choice([3, 9, 10, 11, 40])]), say(rng.randint(0, 12))]
        docs.append((rng.choice([None, i]), " ".join(parts)))
    docs += [(900, None), (901, ""), (902, " .,"), (903, "q"), (904, " ".join(["q", "Alpha"] * 400)), (905, "w" * 3000 + " one TWO three"), (906, (items[2][1] + " ") * 30), docs[0], docs[0]]
    return docs, items


def tables(spark, docs, items):
    return spark.createDataFrame([(i, t, "en", "a", "b", "c", "d", "e") for i, t in docs], COLS), spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEMS)


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    docs, items = corpus(seed)
    want = sorted(map(repr, brute(docs, items)))
    d, b = tables(spark, docs, items)
    assert rows(decontaminate.contamination(d, b)) == want
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    assert rows(decontaminate.contamination(d.repartition(5), b.repartition(3))) == want


def test_empty_tables(spark):
    docs, items = corpus(3)
    d, b = tables(spark, docs, items)
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    for none in (b.limit(0), b.where("item_id in (102, 103)")):
        got = decontaminate.contamination(d, none).collect()
        assert len(got) == len(docs) and not any(r["contaminated"] or r["n_items"] for r in got)
        assert sorted(r["n_words"] for r in got) == sorted(len(words(t)) for _, t in docs)


@pytest.mark.parametrize("chunk", [1, 7, 64, 1000])
def test_words_of_any_chunk(monkeypatch, chunk):
    docs, _ = corpus(4)
    texts = pa.array([t for _, t in docs])
    whole = decontaminate.Words(texts, 9)
    ((_, all_of),) = list(whole)
    monkeypatch.setattr(decontaminate, "CHUNK", chunk)
    parts, w = {}, decontaminate.Words(texts, 9)
    for _, x in w:
        for row in zip(*(x[c].tolist() for c in ("doc", "pos", "start", "end", "hash")), strict=True):
            parts[row[:2]] = row[2:]
    want = {(d, p): (s, e, h) for d, p, s, e, h in zip(*(all_of[c].tolist() for c in ("doc", "pos", "start", "end", "hash")), strict=True)}
    assert parts == want and w.counts.tolist() == whole.counts.tolist() == [len(words(t)) for _, t in docs]
    assert [w.raw[s:e].decode() for (d, _), (s, e, _) in sorted(parts.items())] == [x for _, t in docs for x in words(t)]
    n, found = decontaminate.found(texts[3:], [1, 3, 10], None)
    monkeypatch.undo()
    assert found == decontaminate.found(texts[3:], [1, 3, 10], None)[1]


def test_both_sides_keep_the_same_gram_of_a_shared_span():
    rng = np.random.default_rng(7)
    for _ in range(200):
        span = rng.integers(0, 5, 10).astype(np.uint64)  # few words, so that grams tie
        a, b = (np.concatenate((rng.integers(0, 5, rng.integers(0, 9)), span, rng.integers(0, 5, rng.integers(0, 9)))).astype(np.uint64) for _ in range(2))
        fp = [set(decontaminate.fingerprints(x, 10).tolist()) for x in (a, b, span)]
        assert fp[2] <= fp[0] & fp[1]
    long = decontaminate.fingerprints(rng.integers(0, 1 << 40, 100_000).astype(np.uint64), 10)
    assert (long[1:] != long[:-1]).mean() < 0.32  # two of seven grams are kept


def test_a_crowded_filter_loses_nothing(spark, monkeypatch):
    docs, items = corpus(5)
    d, b = tables(spark, docs, items)
    monkeypatch.setattr(decontaminate, "MOST_BITS", decontaminate.BLOCK_BITS)
    of = decontaminate.windows(b)
    marks = decontaminate.filter_of(of)
    fps = np.array([r["fp"] for r in of.collect()], np.int64).view(np.uint64)
    assert len(marks) * 8 == decontaminate.BLOCK_BITS and decontaminate.passes(fps, marks).all()
    full = np.full_like(marks, 255)
    assert decontaminate.passes(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64), full).all()
    assert not decontaminate.passes(fps, np.zeros_like(marks)).any()
