"""Closed forms, planted truths and small known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplerank.functions import distributions as D
from ripplerank.functions.columns import harmonic_sum, split_multi, weighted_median
from ripplerank.operators import graph, labels, metrics, resample, stability, stats
from ripplerank.sources import tables


def net(spark, pairs):
    return spark.createDataFrame([(min(a, b), max(a, b), 1.0) for a, b in pairs], "gene_a string, gene_b string, weight double")


def test_messy_edges(spark):
    raw = [("TP53", "MDM2", 0.9), ("MDM2", "TP53", 0.8), ("TP53", "TP53", 1.0), ("EGFR", "KRAS", 0.5), ("EGFR", "KRAS", 0.7), ("KRAS", "BRAF", 0.6), (None, "TP53", 1.0), ("X1", "X2", 1.0)]
    lcc, meta = graph.finalize(spark.createDataFrame(raw, "gene_a string, gene_b string, weight double"), "n")
    assert {tuple(r) for r in lcc.collect()} == {("EGFR", "KRAS", 0.7), ("BRAF", "KRAS", 0.6)}
    m = meta.first().asDict()
    assert (m["n_input_edges"], m["n_mapped_edges"], m["n_self_loops"], m["n_components"], m["n_nodes_lcc"], m["n_edges_lcc"]) == (8, 7, 1, 3, 3, 2)


def test_contracts(spark):
    bad = spark.createDataFrame([("B", "A", 1.0), ("A", "B", 1.0)], "gene_a string, gene_b string, weight double")
    with pytest.raises(ValueError, match="order"):
        tables.check(bad, "network")
    s = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 1, 1), ("b", 0, 0, 0)], "gene string, repeat int, fold int, y int")
    assert {r["rule"] for r in tables.violations(s, "splits").collect()} == {"more_than_one_fold"}


@pytest.mark.parametrize("strategy", ["blocks", "joins"])
def test_rwr_closed_form(spark, strategy):
    rng = random.Random(1)
    pairs = {(f"g{i:02d}", f"g{i + 1:02d}") for i in range(19)} | {tuple(sorted(rng.sample([f"g{i:02d}" for i in range(20)], 2))) for _ in range(25)}
    genes = sorted({g for p in pairs for g in p})
    a = np.zeros((len(genes), len(genes)))
    for x, y in pairs:
        a[genes.index(x), genes.index(y)] = a[genes.index(y), genes.index(x)] = 1
    w = (a / a.sum(1, keepdims=True)).T
    p0 = np.zeros(len(genes))
    p0[[0, 3]] = 0.5
    want = 0.5 * np.linalg.solve(np.eye(len(genes)) - 0.5 * w, p0)
    seeds = spark.createDataFrame([("s", genes[0]), ("s", genes[3]), ("s", genes[3])], "col string, gene string")
    got = {r["gene"]: r["score"] for r in graph.rwr(net(spark, pairs), seeds, 0.5, 1e-10, strategy=strategy).collect()}
    assert np.allclose([got[g] for g in genes], want, atol=1e-8) and abs(sum(got.values()) - 1) < 1e-9
    one = graph.rwr(net(spark, pairs), seeds, 1.0, strategy=strategy).where("score > 0").collect()
    assert {r["gene"]: r["score"] for r in one} == {genes[0]: 0.5, genes[3]: 0.5}


def test_star_and_core(spark):
    star = net(spark, [("c", f"l{i}") for i in range(4)])
    assert sorted(r["degree"] for r in graph.degree(star).collect()) == [1, 1, 1, 1, 4]
    k4 = net(spark, [(a, b) for a in "abcd" for b in "abcd" if a < b] + [("d", "e")])
    assert {r["gene"]: r["core"] for r in graph.core_numbers(k4).collect()} == {"a": 3, "b": 3, "c": 3, "d": 3, "e": 1}
    assert {r["gene"]: r["betweenness"] for r in graph.betweenness(net(spark, [("a", "b"), ("b", "c")]), 3).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}


def test_core_numbers_over_1000(spark):
    clique = lambda lo, n: spark.range(lo, lo + n).select(F.col("id").alias("gene_a")).crossJoin(spark.range(lo, lo + n).select(F.col("id").alias("gene_b"))).where("gene_a < gene_b").withColumn("weight", F.lit(1.0))
    got = graph.core_numbers(clique(0, 1001).unionByName(clique(5000, 1002))).groupBy("core").count().collect()
    assert {r["core"]: r["count"] for r in got} == {1000: 1001, 1001: 1002}


def test_closeness_of_every_gene(spark):
    from ripplerank.operators import arms

    e = net(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")])
    marks = graph.landmarks(e)
    assert {r["gene"] for r in marks.collect()} == set("abcd") and graph.landmarks(e, 3).count() == 3
    got = {r["gene"]: round(r["closeness"], 12) for r in graph.harmonic(e, marks).collect()}
    ends, inner = round((1 + 1 + 1 / 2 + 1 / 3) / 4, 12), round((1 + 1 + 1 + 1 / 2) / 4, 12)
    assert got == {"a": ends, "b": inner, "c": inner, "d": ends, "x": 0.0, "y": 0.0}
    assert {r["count"] for r in arms.baselines(e, marks).groupBy("method").count().collect()} == {6}


def test_power_iterations_converge(spark):
    from ripplerank.operators import arms

    pairs = [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(14)] + [("x", "y")]  # a path: 10 rounds leave it far from its vector
    e, genes = net(spark, pairs), sorted({g for p in pairs for g in p})
    a = np.zeros((len(genes), len(genes)))
    for x, y in pairs:
        a[genes.index(x), genes.index(y)] = a[genes.index(y), genes.index(x)] = 1
    vector = np.abs(np.linalg.eigh(a)[1][:, -1])
    rank = np.linalg.solve(np.eye(len(genes)) - 0.85 * (a / a.sum(1, keepdims=True)).T, np.full(len(genes), 0.15 / len(genes)))
    scores = arms.baselines(e, graph.landmarks(e)).collect()
    for name, want in (("eigenvector", vector), ("pagerank", rank)):
        got = {r["gene"]: r["score"] for r in scores if r["method"] == name}
        assert np.allclose([got[g] for g in genes], want, atol=1e-7)
    for strategy in ("arrays", "joins"):
        with pytest.raises(Exception, match="no convergence"):
            graph.power_iteration(e, "eigenvector", 2, tol=1e-10, strategy=strategy).collect()


def test_rewire_keeps_degrees(spark):
    e = net(spark, [(f"a{i}", f"a{(i + k) % 30}") for i in range(30) for k in (1, 3)]).distinct()
    before = {r["gene"]: r["degree"] for r in graph.degree(e).collect()}
    for i in range(2):
        r = graph.rewire(e, 2, 5.0).where(F.col("rewire_id") == i).select("gene_a", "gene_b", F.lit(1.0).alias("weight"))
        assert {x["gene"]: x["degree"] for x in graph.degree(r).collect()} == before
        assert tables.violations(r, "network").count() == 0


def test_tie_break_and_metrics(spark):
    df = spark.createDataFrame([("k", g, s, y) for g, s, y in zip("CABD", [1.0, 1.0, 1.0, 0.0], [0, 1, 0, 1], strict=True)], "k string, gene string, score double, y int")
    assert metrics.precision_at(df, ["k"], (1, 2, 10)).first().asDict() == {"k": "k", "p_at_1": 1.0, "p_at_2": 0.5, "p_at_10": None}
    perfect = spark.createDataFrame([("k", str(i), 5.0 - i, int(i < 2)) for i in range(5)], "k string, gene string, score double, y int")
    assert metrics.auroc(perfect, ["k"]).first()["auroc"] == 1.0 and abs(metrics.auprc(perfect, ["k"]).first()["auprc"] - 1) < 1e-12
    assert metrics.auroc(perfect.withColumn("y", F.lit(0)), ["k"]).first()["auroc"] is None


def test_harmonic_sum_and_cells(spark):
    rows = spark.createDataFrame([([0.7],), ([0.4, 0.6],)], "s array<double>").select(harmonic_sum(F.col("s")).alias("h")).collect()
    assert rows[0]["h"] == 0.7 and abs(rows[1]["h"] - 0.7 / (math.pi**2 / 6)) < 1e-12
    cells = spark.createDataFrame([('"A| B||C "',), (None,)], "c string").select(split_multi(F.col("c")).alias("v")).collect()
    assert [r["v"] for r in cells] == [["A", "B", "C"], []]
    m = spark.sql("select array(struct(1d as value, 1d as weight), struct(5d as value, 3d as weight)) as p").select(weighted_median(F.col("p")).alias("m"))
    assert m.first()["m"] == 5.0


def test_symbol_map(spark):
    t = spark.createDataFrame([("TP53", "", '"P53"'), ("MDM2", '"HDM2"', '"SHARED"'), ("EGFR", '"TESTA"', '"SHARED"'), ("TESTA", "", "")], "symbol string, prev_symbol string, alias_symbol string")
    m = labels.symbol_map(t)
    ids = spark.createDataFrame([("tp53",), ("HDM2",), ("SHARED",), ("TESTA",), ("",), (None,)], "id string")
    got = {r["id"]: r["mapped"] for r in labels.map_ids(ids, "id", m, "symbol").collect()}
    assert got == {"tp53": "TP53", "HDM2": "MDM2", "SHARED": None, "TESTA": "TESTA", "": None, None: None}
    with pytest.raises(ValueError):
        labels.map_ids(ids, "id", m, "other")


def test_splits(spark):
    u = spark.range(200).select(F.format_string("G%04d", "id").alias("gene"))
    s = labels.stratified_splits(u, u.limit(20), 3, 5)
    assert s.count() == 600 and tables.violations(s, "splits").count() == 0
    assert s.where("y = 1").groupBy("repeat", "fold").count().where("count <> 4").count() == 0
    c = spark.createDataFrame([(f"c{i}", f"G{i * 12 + j:04d}") for i in range(5) for j in range(12)], "complex_id string, gene string")
    g = labels.grouped_splits(u, u.limit(20), c, 2, 5)
    assert tables.violations(g.drop("group"), "splits").count() == 0
    assert g.where("not moved").join(c, "gene").groupBy("repeat", "complex_id").agg(F.count_distinct("fold").alias("f")).where("f > 1").count() == 0


def test_degree_matched(spark):
    d = spark.createDataFrame(list(zip("ABCDEFGHIJKLM", [1, 1, 1, 2, 2, 3, 3, 4, 4, 4, 4, 4, 99], strict=True)), "gene string, degree long")
    s = spark.createDataFrame([("A",), ("D",), ("M",)], "gene string")
    r = resample.degree_matched(d, s, 50).collect()
    assert len(r) == 150 and not {x["gene"] for x in r} & {"A", "D", "M"}
    assert {x["gene"] for x in r if x["seed_gene"] == "D"} == {"E"} and {x["gene"] for x in r if x["seed_gene"] == "M"} <= set("HIJKL")


def test_knn_against_brute_force(spark):
    rng = random.Random(3)
    rows = [("k", f"g{i:03d}", float(rng.randint(0, 400))) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, gene string, score double")
    got = {}
    for r in stability.nearest(df, ["k"], 5).collect():
        got.setdefault(r["gene"], []).append(r["distance"])
    for _, g, s in rows:
        want = sorted(abs(s - t) for _, h, t in rows if h != g)[:5]
        assert sorted(got[g]) == want


def test_distributions():
    assert abs(D.t_sf(2.0, 10) - 0.036694017) < 1e-8 and abs(D.chi2_sf(3.84145882, 1) - 0.05) < 1e-8
    assert abs(D.f_sf(4.0, 2, 10) - 0.052922150) < 1e-7 and abs(D.normal_sf(1.959963985) - 0.025) < 1e-9
    assert abs(D.t_ppf(0.975, 4) - 2.776445105) < 1e-6 and abs(D.hypergeom_sf(1, 50, 5, 10) - 0.258064) < 2e-3
    assert D.normal_sf(20) > 0


def test_bh_and_tost(spark):
    p = spark.createDataFrame([("k", i, v) for i, v in enumerate([0.01, 0.04, 0.03, 0.5])], "k string, i int, p double")
    assert [round(r["q"], 6) for r in stats.bh(p, ["k"]).orderBy("i").collect()] == [0.04, 0.053333, 0.053333, 0.5]
    v = spark.createDataFrame([("a", x) for x in (0.001, -0.001, 0.0005)] + [("b", 0.5), ("b", 0.5)], "k string, value double")
    assert {r["k"]: r["verdict"] for r in stats.tost(v, ["k"], 0.01).collect()} == {"a": "equivalent", "b": "zero variance"}


def test_loro_confidence(spark):
    df = spark.createDataFrame([(r, g, v) for r, row in enumerate([[1, 1], [100, 1], [1, 1]]) for g, v in enumerate(row)], "repeat int, gene int, score int").withColumn("k", F.lit("k")).withColumn("score", F.col("score").cast("double"))
    c = {(r["repeat"], r["gene"]): r["confidence"] for r in stability.loro_confidence(df, ["k"]).collect()}
    assert c[1, 0] == 1 and c[0, 0] < 0.5 and c[2, 0] < 0.5 and c[0, 1] > 0.9


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([("A", "B", 1.0), ("C", "D", 0.5)], tables.NETWORK)
    tables.write_tsv(rows, str(tmp_path / "n"))
    back = tables.read_tsv(spark, str(tmp_path / "n"), tables.NETWORK)
    assert tables.fingerprint(back).first() == tables.fingerprint(rows).first()
    assert tables.write_guarded(rows, str(tmp_path / "g"), {"net": ["x"]}).endswith("_restricted-net-x")
    assert tables.todo(rows.select("gene_a"), rows.select("gene_a").limit(1), ["gene_a"]).count() == 1
    raw = spark.createDataFrame([("9606.P1", "9606.P2", "900")], "protein1 string, protein2 string, combined_score string")
    assert tuple(tables.string_edges(raw).first()) == ("P1", "P2", 0.9)
    mi = spark.createDataFrame([("a:1|intact-miscore:0.45",), ("none",)], "c string").select(tables.mi_score("c").alias("m"))
    assert [r["m"] for r in mi.collect()] == [0.45, 0.0]


def test_streaming(spark, tmp_path):
    from ripplerank.streaming import edges

    src = spark.createDataFrame([(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, "view", 1.0, "{}") for i in range(30)], "event_id long, ts string, user_id long, event_type string, value double, props string")
    src.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "e"))
    ranked = []
    edges.keep_ranking(edges.edges(edges.read_events(spark, str(tmp_path / "e"), 100)), str(tmp_path / "c"), lambda df, n: ranked.append([tuple(r) for r in df.collect()])).awaitTermination()
    assert ranked[0][0] == ("vview", 3)
    q = edges.counts(edges.read_events(spark, str(tmp_path / "e"), 100)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 30


def test_stream_sessions(spark, tmp_path):
    from datetime import datetime, timedelta

    from ripplerank.streaming import edges

    at = datetime(2024, 1, 1, 10)
    rows = [(k, at + timedelta(minutes=m), u, "click", 1.0, "{}") for k, (u, m) in enumerate([(1, 0), (1, 20), (1, 45), (1, 120), (2, 5), (3, 60 * 24 * 30)])]
    spark.createDataFrame(rows, edges.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events")
    q = edges.sessions(edges.read_events(spark, f"{tmp_path}/events")).writeStream.format("memory").queryName("sessions_seen").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["user_id"], int((r["end"] - r["start"]).total_seconds() // 60), r["n"]) for r in spark.table("sessions_seen").collect())
    assert got == [(1, 30, 1), (1, 75, 3), (2, 30, 1)]
