"""The ten operators and the pipeline against brute force, on small and awkward tables."""

import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplerank.llm import embed_dedup, features, lines, mixing, packing, quality, sharding, shared, simhash, store, tokens, topk, toxicity

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _index string, fp string"

needs_data = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def awkward(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing column names."""
    long = " ".join(f"wort{i % 977}" for i in range(9000))
    rows = [
        (1, "one two three four five", "en", "a", 3, "x", "y"), (2, "one two three four five", "en", "a", 3, None, None), (3, None, None, None, None, None, None),
        (4, "", "de", "b", 0, "", ""), (5, long, "en", None, 1, "x", "y"), (6, long, "en", "b", 1, "x", "y"), (7, "ONE two three four five", "en", "a", 3, "x", "y"),
        (8, "\n\n  \t", "en", "c", 1, "x", "y"), (8, "\n\n  \t", "en", "c", 1, "x", "y"), (None, "null id text that is long enough to be a line", "en", "a", 2, "x", "y"),
        (-9, "a line that is long enough to count as one line\nother", "fr", "c", 2, "x", "y"), (10, "a line that is long enough to count as 1 line\nmore", "fr", "c", 2, "x", "y"),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def union_find(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in links:
        p[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in shared.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_in_order(spark):
    df = spark.createDataFrame([(random.Random(i).randint(0, 5), i, None if i % 7 == 0 else i % 3) for i in range(200)], "k long, i long, w long")
    rows = sorted(shared.in_order(df, ["k", "i"], "w").collect(), key=lambda r: r["_index"])
    assert [r["_index"] for r in rows] == list(range(200)) and [(r["k"], r["i"]) for r in rows] == sorted((r["k"], r["i"]) for r in rows)
    assert [r["_before"] for r in rows] == [sum(x["w"] or 0 for x in rows[:i]) for i in range(200)]


def test_split_hot_meets_every_pair_once(spark):
    df = spark.createDataFrame([(1, i) for i in range(60)] + [(2, 100), (2, 101), (3, 5)], "k long, m long")

    def meet(batches):
        import pandas as pd

        for frame, ends in shared.whole_cells(batches, "k"):
            for a, b in shared.cell_pairs(frame, ends, 50):
                m = frame["m"].to_numpy()
                yield pd.DataFrame({"a": np.minimum(m[a], m[b]), "b": np.maximum(m[a], m[b])})

    got = shared.by_cell(shared.split_hot(df, "k", "m", 8), "k").mapInPandas(meet, "a long, b long").collect()
    assert sorted(map(tuple, got)) == sorted([(i, j) for i in range(60) for j in range(i + 1, 60)] + [(100, 101)])


def vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 16))
    x[10:25] = x[9] + rng.normal(size=(15, 16)) * 0.12
    x[30] = x[31] = x[32]
    x[33] = 2 * x[32]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(90, None, None), (91, [0.0] * 16, 1), (92, [float("nan")] + [1.0] * 15, 1), (93, [float("inf")] + [1.0] * 15, 1), (94, [None] + [1.0] * 15, 1), (95, [1.0, 2.0], 1), (96, [], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), x


def test_op1_against_brute_force(spark):
    df, x = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    root = union_find(60, [(i, j) for i in range(60) for j in range(i) if near[i, j]])
    low = {r: min(i for i in range(60) if root[i] == r) for r in root}
    assert embed_dedup.apart(0.9) == 35
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicate_vectors(df, block=6).collect()}
    assert len(got) == 67
    for i in range(60):
        assert got[i] == (near[i].sum() - 1, low[root[i]], low[root[i]] == i)
    for i in (90, 91, 92, 93, 94, 95, 96):
        assert got[i] == (0, i, True)
    assert embed_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def test_op1_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    one, two = embed_dedup.buckets(a), embed_dedup.buckets(0.9 * a + np.sqrt(1 - 0.81) * b)
    assert (one[:, :, :, None] == two[:, :, None, :]).any((1, 2, 3)).mean() >= 0.99


def test_op3_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 8))
    x[:50] = x[0]  # a third of the rows alike: ties go to smaller ids
    df = spark.createDataFrame([(i * 5, [float(v) for v in r]) for i, r in enumerate(x)] + [(9999, None), (10000, [float("nan")] * 8)], "vec_id long, embedding array<double>")
    q, ids = np.floor(256 * x).astype(int), np.arange(150) * 5
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        order = sorted((-int(q[i] @ q[j]), int(ids[j])) for j in range(150) if j != i)[:5]
        want += [(int(ids[i]), k + 1, v, -s) for k, (s, v) in enumerate(order)]
    got = topk.top_k(df, block=40)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e12, -3e11]), (1, [1e12, 1.0]), (2, [5.0, 7.0])], "vec_id long, embedding array<double>")
    fail = False
    try:
        huge_rows = topk.top_k(huge.where("vec_id <> 1")).collect()
    except Exception:
        fail = True
    assert not fail and huge_rows[0]["score"] == int(256e12) * 1280 - int(256 * 3e11) * 1792


def ids_of(text, end):
    t = tokens.encoder().tokenizer
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_tokens_are_the_librarys():
    e, rng = tokens.encoder(), random.Random(5)
    signs = "abcXYZ 'sdlltmrve0123.,!?<|>endoftext\t\nßÄéñ×÷µªº́ 　\x1c\x85Σς你好İı_-—ÿÀ"
    for _ in range(3000):
        s = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|endoftext|>", " it's DON'T", "..."])
        assert e.encode(s) == e.whole(s), repr(s)


def test_op4_packs_every_piece_once(spark):
    df = awkward(spark)
    got = packing.pack_documents(df, capacity=64).toPandas()
    want = []
    for r in df.collect():
        ids = ids_of(r["text"], 0)
        want += [(r["doc_id"], k, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    key = lambda t: tuple(-(10**9) if x is None or x != x else x for x in t)
    assert sorted(map(key, got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))) == sorted(map(key, want))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 64 and g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]]
    assert packing.pack_documents(empty(spark)).count() == 0


def test_op4_plans_near_the_optimum():
    rng = np.random.default_rng(0)
    for n in (1, 50, 3000):
        x = np.minimum(2048, np.maximum(1, rng.lognormal(6, 1.1, n).astype(int)))
        counts = dict(zip(*(a.tolist() for a in np.unique(x, return_counts=True)), strict=True))
        p, used = packing.plan(counts), {}
        for s, k in p:
            assert sum(s) <= 2048
            for v in s:
                used[v] = used.get(v, 0) + k
        assert used == counts and sum(k for _, k in p) <= -(-int(x.sum()) // 2048) + 1
    # best fit takes 3 sequences here; the search finds 2
    assert sum(k for _, k in packing.plan({6: 1, 5: 2, 4: 1, 3: 1, 7: 1}, 15)) == 2
    assert packing.plan({}) == []


def test_op5_against_brute_force(spark):
    import xxhash

    def fp(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    for df in (awkward(spark), spark.read.parquet(f"{D}/documents.parquet") if os.path.isdir(D) else awkward(spark)):
        rows = df.select("doc_id", "text").collect()
        f = [fp(r["text"]) for r in rows]
        root = union_find(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 3])
        low = {x: min((rows[i]["doc_id"] for i in range(len(f)) if root[i] == x and rows[i]["doc_id"] is not None), default=None) for x in root}
        want = [(r["doc_id"], f"{x:016x}", low[k]) for r, x, k in zip(rows, f, root, strict=True)]
        got = [tuple(r) for r in simhash.simhash_groups(df).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert simhash.simhash_groups(empty(spark)).count() == 0


def test_op5_anchors_cover():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys = [{(r, k) for r, k in zip(*(v.tolist() for v in simhash.anchors(x)), strict=True)} for x in (a, b)]
    assert {r for r, _ in keys[0] & keys[1]} == set(range(400))


@needs_data
def test_op6_and_op2_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    q = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (q["predicted"] == q["quality"]).mean() >= 0.9 and q["score"].between(0, 1).all() and ((q["score"] >= 0.3) == q["predicted"]).all()
    t = toxicity.score_toxicity(docs, labels)
    p = t.withColumnRenamed("toxic", "found").join(labels, "doc_id").toPandas()
    assert (p["found"] == (p["toxic"] == 1)).mean() >= 0.9 and p["severity"].between(0, toxicity.GRADES).all() and t.count() == docs.count()


def test_classifiers_on_awkward_tables(spark):
    df = awkward(spark)
    lab = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (6, 7, 7), (77, 0, 0)], "doc_id long, quality int, toxic int")
    for f in (quality.score_quality, toxicity.score_toxicity):
        assert f(df, lab).count() == df.count() and f(df, lab.limit(0)).count() == df.count() and f(empty(spark), lab).count() == 0
    assert quality.score_quality(df, lab.limit(0)).where("score <> 0.5").count() == 0


def test_op2_cuts_are_ordered():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.3).astype(int)
    x = [np.array(sorted({int(v) for v in rng.integers(100, 400, 20)} | ({7} if t else set()) | ({8} if t and rng.random() < 0.5 else set())), np.int32) for t in y]
    m = toxicity.fit(x, y)
    s = m.above(np.array([m.weights[v].sum() for v in x]))
    assert (np.diff(m.cuts) > 0).all() and ((s[:, 0] >= 0.5) == (y == 1)).mean() > 0.97 and (np.diff(s, axis=1) <= 0).all()


def test_op2_sample_chooses_the_rejection_point(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(600) < 0.3).astype(int)
    x = [np.array(sorted({int(v) for v in rng.integers(100, 400, 20)} | ({7} if t else set())), np.int32) for t in y]
    cut, m = toxicity.choose_cut(x, y), toxicity.fit(x, y)
    assert toxicity.LOWEST <= cut <= toxicity.HIGHEST
    p = m.above(np.array([m.weights[v].sum() for v in x]))[:, 0]
    assert (p[y == 1] >= cut).mean() > 0.97 and (p[y == 0] >= cut).mean() < 0.02
    assert toxicity.choose_cut(x, np.zeros(600, int)) > 1 and toxicity.choose_cut([], np.zeros(0, int)) > 1
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.without_toxic(docs, none).count() == 2 and toxicity.score_toxicity(docs, none).where("toxic").count() == 0


def test_op6_descent_separates():
    y = np.array([0, 1] * 50)
    x = [np.array([1 + t, 10 + i % 5], np.int32) for i, t in enumerate(y)]
    r = quality.ratios(x, y)
    w, b = quality.dual_descent(x, y, r)
    assert all((w[v].sum() / np.sqrt(2) + b > 0) == (t == 1) for v, t in zip(x, y, strict=True)) and features.WIDTH == len(r)


def test_op7_shards(spark):
    for dims, bits in ((2, 3), (3, 2)):
        g = np.array(list(np.ndindex(*[1 << bits] * dims)))
        h = sharding.hilbert(g, bits)
        assert sorted(h) == list(range(len(g))) and (np.abs(np.diff(g[np.argsort(h)], axis=0)).sum(1) == 1).all()
    df = awkward(spark)
    got = sharding.shard(df, 4).toPandas()
    n = got.groupby("shard")["slot"].agg(["count", "min", "max", "nunique"])
    assert n["count"].max() - n["count"].min() <= 1 and (n["min"] == 0).all() and (n["max"] + 1 == n["count"]).all() and (n["nunique"] == n["count"]).all()
    assert sorted(got["size"]) == sorted(len((r["text"] or "").encode()) + 1 for r in df.collect())
    assert sharding.shard(empty(spark)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        over, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            over, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, over + (x != y))
    return row[-1]


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        i, how = rng.randrange(len(s) + 1), rng.random()
        if how < 0.34:
            s.insert(i, rng.choice("abcd "))
        elif s:
            i = min(i, len(s) - 1)
            s[i : i + 1] = [] if how < 0.67 else [rng.choice("abcd ")]
    return "".join(s)


def test_op8_kernels():
    rng = random.Random(0)
    for _ in range(4000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 16)))
        b = edited(rng, a, rng.randint(0, 4))
        for m in (1, 2, 3):
            assert lines.within(a, b, m) == (distance(a, b) <= m), (a, b, m)
            if distance(a, b) <= m < min(len(a), len(b)) and a != b:
                one, two = lines.signatures(a, m), lines.signatures(b, m)
                assert {k for k, p in one if not p} & {k for k, _ in two} or {k for k, p in two if not p} & {k for k, _ in one}


def test_op8_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(30, 60))) for _ in range(40)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    rows += [(100 + i, edited(rng, base[0], 1) + "\n" + base[1]) for i in range(90)] + [(500, None), (501, ""), (None, base[0])]  # one crowded line
    monkeypatch.setattr(lines, "FEW", 8)
    monkeypatch.setattr(lines, "BLOCK", 16)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rows[-1] = (None, base[0])
    every = [(-1 if i is None else i, n, s) for i, t in rows for n, s in enumerate((t or "").split("\n")) if len(s) >= 32]
    first = {}
    for i, n, s in sorted(every):
        first.setdefault(s, (i, n))
    order, gone = sorted(first, key=first.get), set()
    for k, s in enumerate(order):
        if any(abs(len(s) - len(o)) <= 2 and distance(s, o) <= 2 for o in order[:k]):
            gone.add(s)
    want = {}
    for i, n, s in every:
        if s in gone or first[s] != (i, n):
            want.setdefault(i, []).append(n)
    got = {-1 if r["doc_id"] is None else r["doc_id"]: r["away"] for r in lines.repeated_lines(df).collect() if r["away"]}
    assert got == want
    left = {r["doc_id"]: r["text"] for r in lines.without_repeated_lines(df).collect()}
    assert left[500] is None and left[None] == base[0] and len(left) == len(rows)
    for i, t in rows[:80]:
        assert left[i] == "\n".join(s for n, s in enumerate(t.split("\n")) if n not in want.get(i, []))
    assert lines.repeated_lines(empty(spark)).count() == 0 and lines.without_repeated_lines(awkward(spark)).count() == 12


def test_op8_equal_lines_of_every_length(spark, tmp_path):
    import corpus_pipeline
    from ripplerank.llm import queries

    notice = "Released under the MIT License."  # 31 characters
    rows = [(1, "}\n" * 3 + notice), (2, f"{notice}\n\n \n}}\nReleased under the MIT License!"), (3, "\n\n \nnew"), (4, "All rights reserved."), (5, "All rights reserved."), (6, " " * 40 + "\n" + " " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["removed_lines"] for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: [1, 2], 2: [0, 3], 3: [], 4: [], 5: [0], 6: []}
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert left == {1: "}\n" + notice, 2: "\n \nReleased under the MIT License!", 3: "\n\n \nnew", 4: rows[3][1], 5: "", 6: rows[5][1]}


def test_op9_round_trip(spark):
    df = awkward(spark)
    where = store.write_store(df)
    got = store.read_store(spark, where).toPandas().sort_values("start")
    at, want = 0, []
    for r in sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"])):
        ids = ids_of(r["text"], 2)
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    clean = lambda t: tuple(None if x != x else int(x) for x in t)
    assert [clean(t) for t in got[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False, name=None)] == want
    packs = spark.read.parquet(f"{where}/packs").collect()
    held = [bytes(p["hashes"])[16 * k : 16 * k + 16] for p in packs for k, o in enumerate(p["own"]) if o]
    assert len(held) == len(set(held)) == len({bytes(p["hashes"])[16 * k : 16 * k + 16] for p in packs for k in range(len(p["own"]))})
    assert store.store_documents(empty(spark)).count() == 0


def test_op9_chunks_follow_content():
    rng = np.random.default_rng(0)
    body = rng.integers(0, 49000, 20000).astype("<u4")
    alone = lambda ids: next(store.cuts([ids.tobytes()]))
    other = np.concatenate((rng.integers(0, 49000, 137).astype("<u4"), body))
    one, two = alone(body), alone(other)
    assert list(store.cuts([other.tobytes(), b"", body.tobytes(), body[:9].tobytes()], 100)) == list(store.cuts([other.tobytes(), b"", body.tobytes(), body[:9].tobytes()])) == [two, [], one, [9]]
    assert one[-1] == 20000 and max(np.diff([0, *one])) <= store.MOST and len({x + 137 for x in one} & set(two)) > len(one) * 0.8
    assert alone(np.zeros(5000, "<u4"))[-1] == 5000


def test_op9_finds_damage(spark):
    where = store.write_store(awkward(spark))
    packs = spark.read.parquet(f"{where}/packs")
    packs.withColumn("data", F.when(F.col("n") > 100, F.expr("concat(substring(data, 3, 2), substring(data, 1, 2), substring(data, 5))")).otherwise(F.col("data"))).write.parquet(f"{where}/x")
    for a, b in (("packs", "old"), ("x", "packs")):
        os.rename(f"{where.removeprefix('file:')}/{a}", f"{where.removeprefix('file:')}/{b}")
    with pytest.raises(Exception, match="does not match"):
        store.read_store(spark, where).collect()


def test_op10_targets_and_taken(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), s) for i in range(900) for s in [rng.choice(["a", "a", "a", "b", "c", "d", None])]] + [(2000, None, "e"), (2001, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    assert all(size[i] == n for i, n in zip(got["doc_id"], got["size"], strict=True)) and len(got) == len(rows)
    sums = {}
    for i, _, s in rows:
        sums[s] = sums.get(s, 0) + size[i]
    names = sorted((s for s in sums if s is not None)) + [None]
    weight, total = {s: k % 3 + 1 for k, s in enumerate(names)}, sum(sums.values())
    full: set = set()
    while True:
        level = (total - sum(3 * sums[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and weight[s] * level > 3 * sums[s]}
        if not more:
            break
        full |= more
    for s in names:
        own = got[got["source"].isna()] if s is None else got[got["source"] == s]
        want = 3 * sums[s] if s in full else weight[s] * level
        assert own["source_size"].iloc[0] == sums[s] and abs(own["target"].iloc[0] - want) < 1e-6 * max(want, 1)
        assert abs(own["taken"].sum() - want) <= 20.001 and (own["taken"] <= 3 * own["size"]).all()
    again = mixing.mix(df.repartition(7)).toPandas().sort_values("doc_id")["taken"].tolist()
    assert again == got.sort_values("doc_id")["taken"].tolist()
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mix(awkward(spark)).count() == 12
    level = mixing.targets(spark.createDataFrame([(f"s{i:03d}", i * i % 97) for i in range(200)], "source string, source_size long")).toPandas()
    assert abs(level["target"].sum() - level["source_size"].sum()) < 1e-6  # many sources stop, and what they leave is all shared out
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()}
    out = mixing.mixed_documents(df).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in out} == {k: v for k, v in copies.items() if v}


@needs_data
@pytest.mark.parametrize("name", ["op1_embedding_near_dedup", "op3_exact_topk", "op10_source_mixing", "op11_merkle_manifest", "op13_winnowing_decontamination"])
def test_queries_against_sql(spark, name):
    import duckdb

    from ripplerank.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, D).toPandas(), con.execute(queries.SQL[name]).fetchdf()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(repr, got[cols].astype(object).values.tolist())) == sorted(map(repr, want[cols].astype(object).values.tolist()))


@needs_data
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{D}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = shared.table(stage(spark, before, D), name)
        assert docs.columns == before.columns
        counts.append(docs.count())
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.score_toxicity(before, spark.read.parquet(f"{D}/labels.parquet")).where("toxic").collect()}
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()} - bad
        if name == "simhash":
            assert {r["doc_id"] for r in docs.collect()} == {r["component_id"] for r in simhash.simhash_groups(before).collect()}
    assert counts[2] == counts[1] and counts[3] <= counts[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D)
    assert packed.agg(F.sum("length")).first()[0] == packing.pieces(docs).agg(F.sum("length")).first()[0]
