"""Merged states against one pass, regressions from Gram sums against numpy, a stream's running degrees against the batch."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplerank.operators import regression, states


def table(spark, n=240, seed=2):
    rng = np.random.default_rng(seed)
    group, net = rng.integers(0, 6, n), rng.integers(0, 4, n)
    a, b = rng.normal(size=n) + group, rng.normal(size=n)
    y = 2 * a - b + 0.7 * group + rng.normal(size=n) * (1 + group / 3)
    rows = [(f"g{g}", f"n{m}", float(p), float(q), float(v)) for g, m, p, q, v in zip(group, net, a, b, y, strict=True)]
    return rows, spark.createDataFrame([*rows, ("g0", "n0", None, 1.0, 2.0), ("g1", "n1", 1.0, 1.0, None)], "g string, m string, a double, b double, y double").repartition(5)


def test_chunks_merge_to_one_pass(spark, tmp_path):
    rows, df = table(spark)
    path = f"file:{tmp_path}/chunks"
    parts = {"one": df.where("m = 'n0'"), "two": df.where("m = 'n1'"), "three": df.where("m > 'n1'")}
    for name, part in parts.items():
        states.append(states.moments(part, ["g"], ["a", "y"]), path, name)
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "chunks" / "chunk=one").iterdir()}
    want = {r["g"]: r for r in states.describe(states.moments(df, ["g"], ["a", "y"]), ["a", "y"]).collect()}

    def same():
        got = states.describe(states.merge(states.read(spark, path), ["g"]), ["a", "y"]).collect()
        assert len(got) == 6
        for r in got:
            assert r["n_a"] == want[r["g"]]["n_a"] and r["n_y"] == want[r["g"]]["n_y"]
            assert all(abs(r[c] - want[r["g"]][c]) < 1e-9 for c in ("mean_a", "sd_a", "mean_y", "sd_y"))

    same()
    states.append(states.moments(parts["two"], ["g"], ["a", "y"]), path, "two")  # a late chunk again: counted once, others untouched
    same()
    assert before == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "chunks" / "chunk=one").iterdir()}
    values = [r[4] for r in rows if r[0] == "g3"]
    assert abs(want["g3"]["sd_y"] - np.std(values, ddof=1)) < 1e-9
    none = states.describe(states.moments(df.where("a is null"), ["g"], ["a"]), ["a"]).first()
    assert (none["n_a"], none["mean_a"], none["sd_a"]) == (0, None, None)


def test_sums_of_all_other_groups(spark):
    rows, df = table(spark)
    got = {r["g"]: r for r in states.describe(states.without(states.moments(df, ["g"], ["y"]), [], "g"), ["y"]).collect()}
    for g, r in got.items():
        rest = [x[4] for x in rows if x[0] != g] + [2.0] * (g != "g0")
        assert r["n_y"] == len(rest) and abs(r["mean_y"] - np.mean(rest)) < 1e-9 and abs(r["sd_y"] - np.std(rest, ddof=1)) < 1e-9
    by = states.without(states.moments(df, ["m", "g"], ["y"]), ["m"], "g")
    one = by.where("m = 'n2' and g = 'g4'").first()
    assert one["n_y"] == sum(1 for x in rows if x[1] == "n2" and x[0] != "g4")


def test_sketches_merge(spark, tmp_path):
    df = spark.range(30_000).select((F.col("id") % 3).cast("string").alias("k"), (F.col("id") % 7001).alias("v"))
    path = f"file:{tmp_path}/sketches"
    for name, part in (("a", df.where("id < 20000")), ("b", df.where("id >= 10000"))):  # overlapping chunks
        states.append(states.sketches(part, ["k"], ["v"]), path, name)
    merged, one = (states.estimates(s, ["v"]) for s in (states.merge(states.read(spark, path), ["k"]), states.sketches(df, ["k"], ["v"])))
    got, exact = ({r["k"]: r["distinct_v"] for r in d.collect()} for d in (merged, one))
    true = {r["k"]: r["n"] for r in df.groupBy("k").agg(F.count_distinct("v").alias("n")).collect()}
    assert got.keys() == true.keys() and all(abs(got[k] - n) < 0.03 * n and abs(got[k] - exact[k]) < 0.02 * n for k, n in true.items())


def design(rows, fixed):
    a, b, y = (np.array([r[i] for r in rows]) for i in (2, 3, 4))
    names = sorted({r[0] for r in rows})
    effects = np.array([[r[0] == g for g in names] for r in rows], float) if fixed else np.ones((len(rows), 1))
    return np.c_[a, b, effects], y


@pytest.mark.parametrize("fixed", [True, False])
@pytest.mark.parametrize("clustered", [None, "g", "m"])
def test_fit_against_dummies(spark, fixed, clustered):
    rows, df = table(spark)
    s = states.gram(df, "y", ["a", "b"], ["g", "m"])
    got = {r["term"]: r for r in regression.fit(s, ["a", "b"], fixed=["g"] if fixed else None, cluster=[clustered] if clustered else None).collect()}
    x, y = design(rows, fixed)
    n, k = x.shape
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = y - x @ beta
    if clustered:
        at = 0 if clustered == "g" else 1
        names = sorted({r[at] for r in rows})
        meat = sum(np.outer(u, u) for c in names for u in [x[[r[at] == c for r in rows]].T @ e[[r[at] == c for r in rows]]])
        cov = inv @ meat @ inv * len(names) / (len(names) - 1) * (n - 1) / (n - k)
    else:
        cov = inv * (e @ e / (n - k))
    for i, term in enumerate(("a", "b")):
        r = got[term]
        assert abs(r["coef"] - beta[i]) < 1e-8 and abs(r["se"] - math.sqrt(cov[i, i])) < 1e-8 and r["n"] == n == 240
        assert r["low"] < r["coef"] < r["high"] and 0 <= r["p"] < 1 and abs(r["stat"] - r["coef"] / r["se"]) < 1e-9
    inside = y - (np.array([np.mean([q[4] for q in rows if q[0] == r[0]]) for r in rows]) if fixed else y.mean())
    assert abs(got["a"]["r2"] - (1 - e @ e / (inside @ inside))) < 1e-9


def test_left_out_groups_and_refits(spark):
    rows, df = table(spark)
    s = states.gram(df, "y", ["a", "b"], ["g", "m"])
    out = {r["m"]: r for r in regression.left_out(s, ["a", "b"], "m").collect()}
    slopes = {(r["m"], r["term"]): r["coef"] for r in regression.refits(s, ["a", "b"], "m").collect()}
    for m in ("n0", "n1", "n2", "n3"):
        rest, own = [r for r in rows if r[1] != m], [r for r in rows if r[1] == m]
        x, y = design(rest, False)
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        x1, y1 = design(own, False)
        res, tot = y1 - x1 @ beta, y1 - y1.mean()
        assert abs(out[m]["r2_out"] - (1 - res @ res / (tot @ tot))) < 1e-8 and out[m]["n"] == len(own)
        assert abs(slopes[m, "a"] - beta[0]) < 1e-8 and abs(slopes[m, "b"] - beta[1]) < 1e-8
    # effects of g, left out whole: groups lie inside what is left out
    within = {(r["g"], r["term"]): r["coef"] for r in regression.refits(s, ["a", "b"], "g", fixed=["g"]).collect()}
    x, y = design([r for r in rows if r[0] != "g2"], True)
    assert np.allclose([within["g2", "a"], within["g2", "b"]], np.linalg.lstsq(x, y, rcond=None)[0][:2])
    signs = regression.sign_stability(spark.createDataFrame([("x", "t", 1.0), ("y", "t", -2.0), ("z", "t", 3.0), ("w", "t", 4.0), ("x", "u", -1.0)], "g string, term string, coef double"), "g")
    assert {r["term"]: (r["same_sign"], r["refits"]) for r in signs.collect()} == {"t": (0.75, 4), "u": (1.0, 1)}  # "w" is the first of t


def test_nested_models_and_edges(spark):
    rows, df = table(spark)
    s = states.gram(df, "y", ["a", "b"], ["g"])
    got = {r["model"]: r for r in regression.compare(s, ["a", "b"], {"a": (["a"], []), "ab": (["a", "b"], []), "g": (["a", "b"], ["g"])}).collect()}
    rss = []
    for x, y in (design([(*r[:3], 0.0, r[4]) for r in rows], False), design(rows, False), design(rows, True)):
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        rss.append(float(((y - x @ beta) ** 2).sum()))
    assert np.allclose([got[m]["rss"] for m in ("a", "ab", "g")], rss) and [got[m]["params"] for m in ("a", "ab", "g")] == [2, 3, 8]
    assert got["a"]["f"] is None and abs(got["g"]["f"] - (rss[1] - rss[2]) / 5 / (rss[2] / 232)) < 1e-8 and got["ab"]["p"] < 1e-6
    with pytest.raises(ValueError, match="no rows"):
        regression.fit(states.gram(df.where("y is null"), "y", ["a", "b"], ["g"]), ["a", "b"])
    alone = regression.left_out(states.gram(df.where("g = 'g0'"), "y", ["a", "b"], ["g"]), ["a", "b"], "g").first()
    assert alone["r2_out"] is None
    flat = regression.fit(states.gram(df.withColumn("b", F.lit(1.0)), "y", ["a", "b"], ["g"]), ["a", "b"]).collect()
    assert abs(flat[1]["coef"]) < 1e-9 and flat[1]["stat"] is None


def test_running_degrees_and_restart(spark, tmp_path):
    from ripplerank.streaming import edges

    def event(i):
        return i, f"2026-01-01 00:{i % 60:02d}:00", (i * 7) % 5, "abc"[(i * i) % 3], 1.0, ""

    for n in range(4):
        rows = spark.createDataFrame([event(i) for i in range(n * 5, n * 5 + 7)], "event_id long, t string, user_id long, event_type string, value double, props string")
        rows.select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")

    def run(upto):
        seen = []
        stream = spark.readStream.schema(edges.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        pairs = stream.where(F.col("event_id") < 1000).select(F.concat(F.lit("u"), "user_id").alias("gene_a"), F.concat(F.lit("v"), "event_type").alias("gene_b"))

        def note(df, batch):
            seen.append((batch, [tuple(r) for r in df.collect()]))
            if upto is not None and len(seen) == upto:
                raise RuntimeError("stopped")

        try:
            edges.keep_ranking(pairs, f"{tmp_path}/check", note).awaitTermination()
        except Exception as stop:
            assert upto is not None and "stopped" in str(stop)
        return seen

    first = run(2)  # fails after its second batch was written: that batch runs again
    assert [b for b, _ in first] == [0, 1]
    rest = run(None)
    assert rest[0] == first[1] and [b for b, _ in rest] == [1, 2, 3]
    pairs = {(f"u{(i * 7) % 5}", f"v{'abc'[(i * i) % 3]}") for i in range(22)}
    want: dict = {}
    for p in pairs:
        for g in p:
            want[g] = want.get(g, 0) + 1
    assert rest[-1][1] == sorted(want.items(), key=lambda x: (-x[1], x[0]))
    assert run(None) == [] or run(None)[-1][1] == rest[-1][1]
    with pytest.raises(Exception, match="another checkpoint"):
        stream = spark.readStream.schema(edges.EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        pairs = stream.select(F.concat(F.lit("u"), "user_id").alias("gene_a"), F.concat(F.lit("v"), "event_type").alias("gene_b"))
        edges.keep_ranking(pairs, f"{tmp_path}/other", lambda *_: None, f"{tmp_path}/elsewhere").awaitTermination()
        import shutil

        shutil.rmtree(f"{tmp_path}/elsewhere")
        rows.select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{tmp_path}/in/9")
        edges.keep_ranking(pairs, f"{tmp_path}/other", lambda *_: None, f"{tmp_path}/elsewhere").awaitTermination()
