"""Stages and operators on repeated and null doc_ids, clashing names, empty tables; methods against brute force and optima."""

import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplerank.llm import embed_dedup, features, lines, mixing, packing, quality, shared, sharding, simhash, store, tokens, topk, toxicity

#: Names that operators might use for their own columns.
CLASH = ["id", "row", "away", "fp", "n", "h", "h2", "th", "doc", "src", "times", "copy", "of", "k", "under", "stays", "cell", "pack", "range", "i", "base", "_part", "_row", "_sum", "_first", "_away", "_doc", "_d", "_s", "_n", "_index"]
COLS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def table(spark, rows):
    """Rows (doc_id, text, source) with every clashing column."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *["x"] * len(CLASH)) for i, t, s in rows], COLS)


LONG = " ".join(f"w{i % 977}" for i in range(9000))
ROWS = [(1, "X\nY", "a"), (1, "Z\nX", "a"), (2, "one two three four five", "a"), (2, "one two three four five", "a"), (None, "one two three four five", "b"), (None, "one two three four five", "b"), (3, None, None), (4, "", "b"), (5, LONG, "c"), (6, LONG, "c"), (7, "ONE two three four five", "a"), (None, None, None)]
LABELS = [(2, 1, 0), (4, 0, 1), (5, 1, 0), (None, 1, 1)]


def labels(spark, rows=LABELS):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def stages(spark):
    import corpus_pipeline

    d = corpus_pipeline
    return {"toxicity": lambda x: toxicity.without_toxic(x, labels(spark)), **{n: (lambda x, f=f: f(spark, x, "")) for n, f in d.STAGES[1:]}}


def test_stages_keep_clashing_columns_and_bear_empty_tables(spark):
    docs, none = table(spark, ROWS), table(spark, [])
    nulls = spark.createDataFrame([(None,) * (5 + len(CLASH))] * 3, COLS)
    for name, f in stages(spark).items():
        for x in (docs, none, nulls):
            out = f(x)
            n = out.count()
            if name != "packing":
                assert out.columns == x.columns and (n == 0 or out.where("_row <> 'x'").count() == 0), name
            if x is none:
                assert n == 0, name
        assert f(docs).count() > 0, name
    laid = sharding.shard(docs, 4)
    assert set(docs.columns) <= set(laid.columns) and laid.count() == len(ROWS)
    assert sharding.shard(none).count() == 0 and sharding.shard(nulls).count() == 3


def test_pipeline_on_awkward_tables(spark, tmp_path):
    import corpus_pipeline

    for name, rows in (("awkward", ROWS), ("empty", []), ("nulls", [(None, None, None)] * 3)):
        table(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels(spark).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert set(out.columns) >= {"doc_id", "piece", "start", "length", "sequence_id", "offset"}
        assert (out.count() == 0) == (not rows)


def test_lines_by_row(spark):
    docs = spark.createDataFrame([(1, "X\nY"), (1, "Z\nX"), (2, "Y"), (None, "Q\nX"), (None, "Q"), (3, "R\nR"), (3, "R\nR")], "doc_id long, text string")
    left = sorted((r["doc_id"] if r["doc_id"] is not None else 0, r["text"]) for r in lines.without_repeated_lines(docs, exact=1).collect())
    everything = [s for _, t in left for s in t.split("\n") if s]
    assert sorted(everything) == ["Q", "R", "X", "Y", "Z"]  # each line once, none lost
    assert len(left) == 7 and ("X" in "".join(t for i, t in left if i == 0))  # null ids stand first


def test_lines_by_row_against_brute_force(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(30, 45))) for _ in range(12)]
    change = lambda s: s[:10] + rng.choice("xyz") + s[11:] if rng.random() < 0.4 else s
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), "\n".join(change(rng.choice(base)) for _ in range(rng.randint(1, 4)))) for _ in range(40)]
    rows += rows[:6]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    th = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], th[r[1]]))
    first, kept = {}, []
    every = [(k, n, s) for k, (_, t) in enumerate(order) for n, s in enumerate(t.split("\n"))]
    for k, n, s in every:
        first.setdefault(s, (k, n))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            over, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                over, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, over + (x != y))
        return row[-1]

    long = [s for s in first if len(s) >= 32]
    near = {s for s in long if any(first[o] < first[s] and distance(s, o) <= 2 for o in long)}
    for k, (i, _) in enumerate(order):
        kept.append((str(i), "\n".join(s for q, n, s in every if q == k and first[s] == (q, n) and s not in near)))
    got = [(str(r["doc_id"]), r["text"]) for r in lines.without_repeated_lines(docs, exact=1).collect()]
    assert sorted(got) == sorted(kept)


def test_simhash_keeps_one_row_of_each_group(spark):
    docs = table(spark, ROWS)
    got = [(r["doc_id"], r["text"]) for r in simhash.simhash_keep(docs).collect()]
    fp = [simhash.fingerprint(t) for _, t, _ in ROWS]
    root = list(range(len(ROWS)))
    for _ in root:
        for i in range(len(ROWS)):
            for j in range(len(ROWS)):
                if (fp[i] ^ fp[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    want = []
    for g in set(root):
        ids = [ROWS[i][0] for i in range(len(ROWS)) if root[i] == g]
        want.append(min((x for x in ids if x is not None), default=None))
    assert sorted(map(str, (i for i, _ in got))) == sorted(map(str, want))
    only = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert simhash.simhash_keep(only).count() == 1


def test_toxic_rows_go_whatever_their_id(spark):
    rng = random.Random(0)
    some = ["".join(rng.choice("aeioubdklmnrst") for _ in range(6)) for _ in range(400)]
    text = lambda bad: " ".join(rng.sample(some, 25) + (["vilething", "nastyword"] if bad else []))
    rows = [(i, text(i % 3 == 0)) for i in range(300)]
    lab = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([*rows, (None, text(True)), (None, text(False)), (7, text(True)), (7, None)], "doc_id long, text string")
    left = toxicity.without_toxic(docs, lab).collect()
    assert not any("vilething" in (r["text"] or "") for r in left) and 198 <= len(left) <= 200 + 2
    found = toxicity.score_toxicity(docs, lab).where("toxic").count()
    assert found == len(rows) + 4 - len(left)


def test_mixed_documents_are_what_mix_says(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(60)]), " ".join(["w"] * rng.randint(0, 9)), rng.choice(["a", "b", "c", None])) for _ in range(200)]
    docs = table(spark, rows)
    want: dict = {}
    for r in mixing.mix(docs).collect():
        if r["copies"]:
            k = (str(r["doc_id"]), str(r["source"]))
            want[k] = want.get(k, 0) + r["copies"]
    got: dict = {}
    for r in mixing.mixed_documents(docs).collect():
        k = (str(r["doc_id"]), str(r["source"]))
        got[k] = got.get(k, 0) + 1
    assert got == want


# --- op1, op3

def test_op10_sources_of_null_and_equal_ids_come_near_their_target(spark):
    rows = [(None, "five words in this row", "a")] * 50 + [(None, f"w{i} x y", "b") for i in range(40)] + [(7, "one two three four", "c")] * 30 + [(7, "t " * (i % 9), "d") for i in range(30)]
    rows += [(i, "many words " * 20, "e") for i in range(200)] + [(None, None, None)] * 5 + [(None, "", "f")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for df in (docs, docs.repartition(7)):
        got = mixing.mix(df).toPandas()
        for s, own in got.groupby(got["source"].fillna("-")):
            assert abs(own["taken"].sum() - own["target"].iloc[0]) <= max(own["size"].max() / 2, 1e-9) + 1e-6 * own["target"].iloc[0], s
            assert (own["taken"] <= 3 * own["size"]).all()
        out = mixing.mixed_documents(df)
        assert out.columns == df.columns and out.count() == got["copies"].sum()
        per = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()}
        assert all(per.get(s, 0) == n for s, n in got.groupby("source")["taken"].sum().items())
    again = [sorted(map(repr, mixing.mix(d).select("doc_id", "size", "taken").collect())) for d in (docs, docs.repartition(3))]
    assert again[0] == again[1]


def test_op1_repeated_ids_and_dense_groups(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 24))
    x[:50] = x[0] + rng.normal(size=(50, 24)) * 0.08  # a dense group of near copies
    x[60] = x[61]
    ids = [i // 2 if 80 <= i < 90 else i for i in range(120)]  # some ids twice, with different vectors
    df = spark.createDataFrame([(i, [float(v) for v in r], "x", "y") for i, r in zip(ids, x, strict=True)] + [(None, [1.0] * 24, "x", "y")], "vec_id long, embedding array<double>, h string, rep string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    root = list(range(120))
    for _ in range(5):
        for i in range(120):
            for j in np.flatnonzero(near[i]):
                root[i] = root[j] = min(root[i], root[j])
    low = {g: min(ids[i] for i in range(120) if root[i] == g) for g in set(root)}
    want = sorted([(ids[i], int(near[i].sum()) - 1, low[root[i]]) for i in range(120)])
    rows = embed_dedup.near_duplicate_vectors(df, block=8).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in rows if r["vec_id"] is not None) == want
    assert [tuple(r) for r in rows if r["vec_id"] is None] == [(None, 0, None, None)]


def test_op1_recall_on_clusters_and_at_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    for cos, least in ((0.9, 0.985), (0.95, 0.999)):
        c = cos * a + math.sqrt(1 - cos * cos) * b
        one, two = embed_dedup.buckets(a), embed_dedup.buckets(c)
        met = (one[:, :, :, None] == two[:, :, None, :]).any((1, 2, 3))
        close = np.bitwise_count(embed_dedup.sketches(a) ^ embed_dedup.sketches(c)).sum(1) <= embed_dedup.apart(0.9)
        assert (met & close).mean() >= least
    far = rng.normal(size=a.shape)
    far /= np.linalg.norm(far, axis=1, keepdims=True)
    assert (np.bitwise_count(embed_dedup.sketches(a) ^ embed_dedup.sketches(far)).sum(1) <= embed_dedup.apart(0.9)).mean() == 0
    # clusters: a centre and points around it
    centre = rng.normal(size=(200, 1, 64))
    pts = (centre + 0.2 * rng.normal(size=(200, 5, 64))).reshape(-1, 64)
    pts /= np.linalg.norm(pts, axis=1, keepdims=True)
    k = embed_dedup.buckets(pts).reshape(200, 5, embed_dedup.TABLES, embed_dedup.PROBES)
    p = pts.reshape(200, 5, 64)
    pairs = [(c, i, j) for c in range(200) for i in range(5) for j in range(i) if p[c, i] @ p[c, j] >= 0.9]
    assert len(pairs) > 500 and np.mean([(k[c, i][:, :, None] == k[c, j][:, None, :]).any() for c, i, j in pairs]) >= 0.99


def test_op1_buckets_of_wide_vectors_do_not_wrap():
    x = np.random.default_rng(0).normal(size=(4, 768))
    k = embed_dedup.buckets(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert k.dtype == np.int64 and k.min() >= 0 and k.max() > 2**31 and k.max() < 2048**3


def test_op3_repeats_nulls_and_extra_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 6))
    rows = [(i * 5, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [rows[0], (0, [float(v) for v in rng.normal(size=6)]), rows[7], (None, rows[3][1]), (11, []), (12, None), (13, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], "vec_id long, embedding array<double>, row string, ids string")
    use = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None and len(v) == 6]
    want = []
    for q in sorted({i for i, _ in use if i % 50 == 0}):
        best: dict = {}
        for i, v in use:
            if i == q:
                for j, o in use:
                    if j != q:
                        best[j] = max(best.get(j, -(10**18)), int(v @ o))
        want += [(q, k + 1, j, s) for k, (j, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))[:5])]
    assert sorted(map(tuple, topk.top_k(df, block=20).collect())) == sorted(want)


def test_op3_ties_beyond_k_and_large_ids(spark):
    big = 1 << 60
    rows = [(big + 50 * i, [1.0, 2.0]) for i in range(40)] + [(big + 1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in topk.top_k(df, block=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    queries = [i for i, _ in rows if i % 50 == 0]
    assert sorted(got) == sorted(queries)
    for q, found in got.items():
        assert [v for _, v in sorted(found)] == [i for i, v in sorted(rows) if i != q and v == [1.0, 2.0]][:5]


def test_op3_finite_vectors_of_any_size(spark):
    rng = random.Random(8)
    sizes = [0.0, 1.0, -3.5, 1e15, -1e15, 1e30, -1e200, 1.7e308, -1.7e308, 5e-324]
    rows = [(i, [rng.choice(sizes) for _ in range(3)]) for i in range(120)] + [(200, [1e15, 1.0, 0.0]), (250, [1e15, 2.0, 0.0])]
    most = (1 << 63) - 1

    def whole(x):
        f = 256.0 * x
        return int(math.copysign(1.7976931348623157e308, f)) if math.isinf(f) else math.floor(f)

    want = {}
    for q, a in rows:
        if q % 50 == 0:
            scores = sorted((-max(-most, min(most, sum(whole(x) * whole(y) for x, y in zip(a, b, strict=True)))), i) for i, b in rows if i != q)
            want[q] = [(r, i, -s) for r, (s, i) in enumerate(scores[:5], 1)]
    for block in (16_384, 20):
        got = {}
        for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert {q: sorted(v) for q, v in got.items()} == want
    assert any(s == most for v in want.values() for _, _, s in v)


def test_op3_reads_few_exact_vectors():
    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.normal(size=(4000, 64)))
    x[:1300] = np.floor(x[0] + 12 * rng.normal(size=(1300, 64)))  # a third of the rows close together
    code, low, high = topk.approximate(x)
    b = topk.Block(code, low, high, [r.astype(np.float32).tobytes() for r in x], [np.array([i]) for i in range(4000)])
    stats: dict = {}
    q = x[::80]
    found: dict = {}
    for a, v, s in b.search(q, np.arange(0, 4000, 80), 5, stats):
        found.setdefault(a, []).append((-s, v))
    for k, a in enumerate(range(0, 4000, 80)):
        s = (x @ q[k]).astype(np.int64)
        assert sorted(found[a]) == sorted((-int(s[v]), v) for v in range(4000) if v != a)[:5]
    assert stats["read"] / stats["rows"] < 0.05


# --- op2, op6

def test_op6_weights_are_the_optimum_of_the_hinge_loss(monkeypatch):
    monkeypatch.setattr(quality, "MEAN", 0.0)
    rng = np.random.default_rng(0)
    y = (rng.random(60) < 0.4).astype(int)
    x = [np.unique(np.r_[rng.integers(0, 30, 6), 40 + 2 * t + rng.integers(0, 2)]).astype(np.int32) for t in y]
    r = rng.normal(size=features.WIDTH)
    w, bias = quality.dual_descent(x, y, r, passes=2000)
    sign = np.where(y == 1, 1.0, -1.0)
    c = np.where(y == 1, 60 / (2 * (y == 1).sum()), 60 / (2 * (y == 0).sum()))
    used = np.unique(np.concatenate(x))
    z = np.zeros((60, len(used)))
    for i, v in enumerate(x):
        z[i, np.searchsorted(used, v)] = r[v] / math.sqrt(len(v))
    loss = lambda w, b: 0.5 * (w @ w + b * b) + (c * np.maximum(0, 1 - sign * (z @ w + b))).sum()
    own = w[used] / r[used]
    at = loss(own, bias)
    for _ in range(400):
        step = rng.normal(size=len(used) + 1) * 10 ** rng.uniform(-4, 0)
        assert loss(own + step[:-1], bias + step[-1]) >= at - 1e-4 * at


def test_op6_features_have_word_bigrams():
    f = quality.features()
    one, two = set(f("alpha beta gamma").tolist()), set(f("alpha gamma beta").tolist())
    assert one != two and len(one & two) >= 3
    assert features.Features(features.looks)("alpha beta gamma").tolist() == features.Features(features.looks)("alpha gamma beta").tolist()
    long = "x" * 500 + "7" * 3
    assert features.shape(long) == "aa99"[:4] and set(f(long).tolist())
    kept = features.KEPT
    try:
        features.KEPT = 2  # what is not kept is worked out again, alike
        g = quality.features()
        assert set(g("alpha beta gamma delta beta").tolist()) == set(f("alpha beta gamma delta beta").tolist())
    finally:
        features.KEPT = kept
    many = " ".join(f"w{i}" for i in range(2 * features.CHUNK // 1000))
    assert set(f(many).tolist()) == set(quality.features()(many).tolist())


def test_op2_fit_is_near_the_optimum_of_its_likelihood():
    rng = np.random.default_rng(3)
    y = (rng.random(300) < 0.4).astype(int)
    x = [np.array(sorted({int(v) for v in rng.integers(100, 140, 5)} | ({7} if t and rng.random() < 0.9 else set()) | ({8} if t and rng.random() < 0.6 else set())), np.int32) for t in y]
    m = toxicity.fit(x, y)
    kept = np.flatnonzero(m.weights)
    g = toxicity.grades(x, y, toxicity.telling(x, y))

    def loss(w, cuts):
        eta = np.array([sum(w[k] for k in v if k in w) for v in x])
        s = 1 / (1 + np.exp(cuts[None, :] - eta[:, None]))
        full = np.concatenate((np.ones((300, 1)), s, np.zeros((300, 1))), axis=1)
        p = full[np.arange(300), g] - full[np.arange(300), g + 1]
        return -np.log(np.maximum(p, 1e-12)).mean() + toxicity.PENALTY / 2 * sum(v * v for v in w.values())

    own = {int(k): float(m.weights[k]) for k in kept}
    at = loss(own, m.cuts)
    for _ in range(150):
        size = 10 ** rng.uniform(-3, -0.5)
        cuts = np.sort(m.cuts + size * rng.normal(size=len(m.cuts)))
        assert loss({k: v + size * rng.normal() for k, v in own.items()}, cuts) >= at - 2e-3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_op2_held_out_recall_and_monotone_severity(spark):
    docs, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fitted = lab.where("doc_id % 2 = 0")
    p = toxicity.score_toxicity(docs, fitted).withColumnRenamed("toxic", "found").join(lab.where("doc_id % 2 = 1").select("doc_id", "toxic").distinct(), "doc_id").toPandas()
    bad = p["toxic"] == 1
    assert bad.sum() > 50 and p["found"][bad].mean() >= 0.75 and p["found"][~bad].mean() <= 0.04  # half of the labels: some 100 toxic texts once copies are left out
    # Severity rises with the share of toxic documents, on rows that no fit saw: thirds of the rows by severity.
    thirds = np.array_split(p.sort_values("severity")["toxic"].to_numpy(), 8)
    share = [t.mean() for t in thirds]
    assert share[-1] > 0.7 and all(a <= b + 0.03 for a, b in zip(share, share[1:], strict=False))


# --- op4, op7, op9, tokens

def test_op4_finds_the_fewest_sequences_of_small_instances():
    rng = random.Random(1)

    def fewest(items, room):
        items, best = sorted(items, reverse=True), [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[i] <= room and bins[j] not in bins[:j]:
                    bins[j] += items[i]
                    go(i + 1, bins)
                    bins[j] -= items[i]
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best[0]

    for _ in range(1500):
        room = rng.choice([7, 10, 15, 20, 30, 100])
        items = [rng.randint(1, room) if rng.random() < 0.5 else rng.randint(max(1, room // 5), max(1, room // 2)) for _ in range(rng.randint(1, 10))]
        counts = {x: items.count(x) for x in items}
        p, used = packing.plan(counts, room), {}
        for s, n in p:
            assert sum(s) <= room
            for v in s:
                used[v] = used.get(v, 0) + n
        assert used == counts and sum(n for _, n in p) == fewest(items, room)


def test_op4_dominance():
    left = packing._Left({10: 1, 6: 1, 5: 2, 4: 1, 3: 1, 1: 1})
    assert packing.dominated((10, 4, 1), left, 16)  # 5 or 6 for 4 and 1, with more in the room
    assert packing.dominated((10, 5), left, 16)  # 1 fits beside, 6 in its place
    assert not packing.dominated((10, 6), left, 16)
    assert packing.dominated((10, 5, 1), left, 16)  # one 6 for 5 and 1
    best = list(packing.completions(left, 16, [10**6]))
    assert best[0] == (10, 6) and len(best) == 1
    assert packing.plan({5: 3, 4: 3, 3: 3}, 12, 1)  # out of steps at once: best fit stands


def test_op7_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    texts = ["t" * rng.randint(0, 400) for _ in range(25)] + [None, "same text"]
    rows = [(rng.choice([None, *range(500)]), rng.choice(texts) if rng.random() < 0.7 else "same text", rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None])) for _ in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    where = f"file://{tmp_path}/shards"
    got = sharding.shard(df, 16, where=where).toPandas()
    assert sorted(os.listdir(tmp_path / "shards")) == sorted(["_SUCCESS", *(f"shard={i}" for i in range(16))] + [f for f in os.listdir(tmp_path / "shards") if f.startswith(".")])

    def cells(values):
        names = sorted({v for v in values if v is not None}) + ([None] if None in values else [])
        out, before = {}, 0
        for v in names:
            n = sum(x == v for x in values)
            out[v], before = math.floor((before + n / 2) * 32 / len(values)), before + n
        return out

    src, lang = cells([r[3] for r in rows]), cells([r[2] for r in rows])
    rep: dict = {}
    for _, t, la, s in rows:
        rep[t or ""] = min(rep.get(t or "", 10**9), src[s] * 32 + lang[la])
    curve = {t: int(sharding.hilbert(np.array([[min(31, math.floor(2 * math.log2(len(t) + 1))), p // 32, p % 32]]))[0]) for t, p in rep.items()}
    assert sorted(zip(got["text"].fillna(""), got["curve"], strict=True)) == sorted((t or "", curve[t or ""]) for _, t, _, _ in rows)
    o = got.sort_values(["shard", "slot"])
    assert o["curve"].is_monotonic_increasing and o.groupby("shard").size().tolist() == [15] * 16 and o.groupby("shard")["slot"].apply(list).tolist() == [list(range(15))] * 16
    # Copies of a text are neighbours: they lie in more shards than one only where a cut falls on them.
    run = (o["text"].fillna("") != o["text"].fillna("").shift()).sum()
    assert run == o["text"].fillna("").nunique()
    there = [(None if i != i else int(i), None if t != t else t) for i, t in zip(got["doc_id"].astype(float), got["text"], strict=True)]
    assert sorted(map(str, there)) == sorted(str((i, t)) for i, t, _, _ in rows)


def test_op7_ranges_are_even_in_bytes():
    cells = [(i, 100 + i, b) for i, b in enumerate([5, 5, 5, 100, 1, 40, 3])]
    normal, heavy = sharding.ranges(cells, [(103, 1, 2, 60)], 20)
    assert [(c, first, parts) for c, _, first, parts in normal] == [(100, 0, 1), (101, 0, 1), (102, 0, 1), (103, 1, 2), (104, 6, 1), (105, 7, 2), (106, 9, 1)]
    assert heavy == [(1, 2, 3, 3)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_op7_prunes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    q = F.expr("percentile(octet_length(text) + 1, array(0.4, 0.6))")
    filters = docs.groupBy("source", "lang").agg(q.alias("q")).select(F.monotonically_increasing_id().alias("filter"), "source", "lang", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    own = sharding.opened(sharding.shard(docs), filters).agg(F.avg("opened")).first()[0]
    random_order = docs.withColumn("size", F.octet_length("text") + 1).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    assert own < 0.6 * sharding.opened(random_order, filters).agg(F.avg("opened")).first()[0]


def test_op9_lends_hot_chunks_in_copies(spark, monkeypatch):
    monkeypatch.setattr(store, "ASKS", 3)
    rng = random.Random(1)
    body = " ".join(rng.choice(["river", "stone", "cloud", "bread", "night", "seven"]) + str(i) for i in range(900))
    rows = [(i, f"head {i} " + body + f" tail {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    where = store.write_store(df)
    lend = spark.read.parquet(f"{where}/lenders")
    assert lend.where("places >= 40").count() >= 1
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in store.read_store(spark, where).collect()}
    for i, t in rows:
        ids = np.array([*tokens.encoder().tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_tokens_of_another_vocabulary_are_the_librarys():
    e, rng = tokens.encoder(tokens.default_path("byte_bpe_50k.json")), random.Random(8)
    assert not e.by_word and tokens.encoder().by_word
    for _ in range(300):
        s = "".join(rng.choice("abc XY\n\t 12 .,'Ää") for _ in range(rng.randint(0, 25)))
        assert e.encode(s) == e.whole(s)


def test_shared_folder_is_no_local_one_on_a_cluster():
    from ripplerank.sources import shared as folder

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        folder.shared_dir(type("Spark", (), {"conf": Conf(), "sparkContext": Context()})())
    assert re.match(r".+", shared.__doc__)


def test_short_way_of_plain_words_gives_the_ids_of_the_library():
    from ripplerank.llm.tokens import Encoder, default_path

    e = Encoder(default_path())
    for w in ("the", "The", "THNDHAIN", "ndshin,", "Sterch,", "halyin.", ".", ",", ".,", "a,,", "A.,", "it's.", "É.", "x" * 90 + ".", "7,", "Is###"):
        assert e.word(w.encode()) == e.whole(w), w
