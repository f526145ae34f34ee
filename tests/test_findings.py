"""Small cases of what a review found."""

import itertools
import math

from pyspark.sql import functions as F

from ripplerank.operators import ranks, stability, templates


def test_relative_crowding_has_the_logarithms_of_the_c_library(spark):
    rows = [("k", i, float(i)) for i in range(1, 1200)]
    df = spark.createDataFrame(rows, "k string, gene long, score double")
    low, high = math.log(0.9), math.log(1.1)
    logs = [math.log(x) for _, _, x in rows]
    want = {i + 1: sum(a + low <= b <= a + high for b in logs) for i, a in enumerate(logs)}
    assert {r["gene"]: r["crowd"] for r in stability.relative_crowding(df, ["k"]).collect()} == want


def test_nearest_takes_the_first_of_equal_scores_below(spark):
    rows = [("k", i, float(i // 10)) for i in range(60)] + [("k", 100, 2.5), ("k", 101, 40.0)]
    df = spark.createDataFrame(rows, "k string, gene long, score double")
    got = {}
    for r in stability.nearest(df, ["k"], 3).orderBy("place").collect():
        got.setdefault(r["gene"], []).append((r["near"], r["distance"], r["near_score"]))
    for _, g, s in rows:
        want = sorted((abs(s - t), t, h) for _, h, t in rows if h != g)[:3]
        assert got[g] == [(h, x, t) for x, t, h in want], g


def test_seed_fractions_propagate_once(spark, monkeypatch):
    from ripplerank.operators import graph

    calls, real = [], graph.rwr_series
    monkeypatch.setattr(graph, "rwr_series", lambda *a, **k: calls.append(1) or real(*a, **k))
    e = spark.createDataFrame([(i, j, 1.0) for i in range(12) for j in range(i + 1, 12) if (i * j + i) % 3 != 1], "gene_a long, gene_b long, weight double")
    splits = spark.createDataFrame([(i, r, i // 2 % 2, i % 2) for i in range(12) for r in range(2)], "gene long, repeat int, fold int, y int")
    cells, sd = templates.seed_fractions(e, splits, (1.0, 0.5), k=2)
    assert cells.count() == 8 and sd.count() == 2
    assert len(calls) == 1


def broadcast(df):
    """The plans, as text, of what a query that has run sent round by way of the driver."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines(), []
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            below = itertools.takewhile(lambda y: depth(y) > depth(x), lines[i + 1 :])  # noqa: B023
            out.append("\n".join(below))
    return out


def test_bait_null_sends_no_draws_to_the_driver(spark):
    v = spark.range(400).select(F.col("id").alias("gene"), (F.col("id") % 37).alias("value"), (F.col("id") % 11).cast("double").alias("log_n"))
    got = templates.bait_null(v, v.where("gene % 9 = 0").select("gene"), "log_n", 500)
    assert {r["kind"] for r in got.collect()} == {"matched", "unmatched"}
    plans = broadcast(got)
    assert plans and not [p for p in plans if "Generate" in p]


def test_panel_deals_classes_beyond_a_window(spark, monkeypatch):
    universe = spark.range(200).select(F.col("id").alias("gene"))
    sets = universe.where("gene < 60").select((F.col("gene") % 2).cast("string").alias("label_set"), "gene")
    want = sorted(map(tuple, templates.panel(universe, sets, 2).collect()))
    monkeypatch.setattr(ranks, "GROUP_ROWS", 20)
    assert sorted(map(tuple, templates.panel(universe, sets, 2).collect())) == want and len(want) == 800
    named = universe.select("gene", F.lit("a").alias("_p"), F.lit(1).alias("_k0"))
    rows = ranks.by_group(named, ["_k0"], ["gene"]).collect()
    assert all((r["_p"], r["_place"], r["_size"]) == ("a", r["gene"] + 1, 200) for r in rows) and len(rows) == 200
