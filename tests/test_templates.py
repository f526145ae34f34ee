"""Guards of the core, strategies that have to agree, control templates, builders, scans: closed forms, brute force, planted truths."""

import io
import math
import os
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplerank.functions import distributions as D
from ripplerank.operators import arms, catalogues, controls, graph, labels, metrics, resample, stability, stats, templates
from ripplerank.sources import scans, tables, toy

EDGES = "gene_a string, gene_b string, weight double"


def edges(spark, pairs):
    return spark.createDataFrame([(min(a, b), max(a, b), 1.0) for a, b in pairs], EDGES)


def small(spark, n=40, m=120, seed=0):
    rng = np.random.default_rng(seed)
    pairs = {tuple(sorted(rng.choice(n, 2, replace=False).tolist())) for _ in range(m)} | {(i, i + 1) for i in range(n - 1)}
    return edges(spark, [(f"g{a:03d}", f"g{b:03d}") for a, b in pairs])


def as_dict(df, key="gene", value=None):
    return {r[key]: r[value] for r in df.collect()}


# --- graphs

def test_bfs_reaches_the_end_of_a_long_path(spark):
    e = edges(spark, [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(90)] + [("x", "y")])
    d = as_dict(graph.bfs(e, spark.createDataFrame([("s", "p000")], "source string, gene string")), value="distance")
    assert d == {f"p{i:03d}": i for i in range(91)}
    assert graph.bfs(e, spark.createDataFrame([("s", "p000")], "source string, gene string"), 3).count() == 4
    p = as_dict(graph.proximity(e, spark.createDataFrame([("s", "p000")], "source string, gene string")), value="distance")
    assert p["x"] == p["y"] == 91


def test_cores_of_cliques(spark):
    clique = lambda name, n: [(f"{name}{i:02d}", f"{name}{j:02d}") for i in range(n) for j in range(i)]
    e = edges(spark, clique("a", 6) + clique("b", 9) + [("a00", "z")])
    want = {**{f"a{i:02d}": 5 for i in range(6)}, **{f"b{i:02d}": 8 for i in range(9)}, "z": 1}
    for how in ("arrays", "joins"):
        assert as_dict(graph.core_numbers(e, how), value="core") == want


def test_walks_by_arrays_and_by_joins_are_the_same(spark):
    e = small(spark, 12, 14)
    for p, q in ((1.0, 1.0), (0.5, 2.0)):
        one, two = (sorted((r["gene"], r["walk_id"], tuple(r["walk"])) for r in graph.walks(e, 2, 5, p, q, strategy=s).collect()) for s in ("auto", "joins"))
        assert one == two and len(one) == 24
    near = {frozenset((r["gene_a"], r["gene_b"])) for r in e.collect()}
    assert all(frozenset(x) in near for _, _, w in one for x in zip(w, w[1:])) and all(a != c for _, _, w in one for a, c in zip(w, w[2:]))


def test_walks_follow_their_weights(spark):
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("d", "f"), ("d", "g"), ("a", "h"), ("h", "c")])
    near: dict = {}
    for r in e.collect():
        near.setdefault(r["gene_a"], set()).add(r["gene_b"])
        near.setdefault(r["gene_b"], set()).add(r["gene_a"])
    p, q, n, seen = 0.5, 2.0, 3000, {}
    for r in graph.walks(e, n, 3, p, q).collect():
        seen.setdefault(tuple(r["walk"][:2]), []).append(r["walk"][2:])
    for (u, v), ends in seen.items():
        ways = sorted(near[v] - {u})
        assert bool(ways) == any(ends)  # a walk whose only way leads back ends
        weight = np.array([1 / p if x in near[u] else 1 / q for x in ways])
        got = np.array([sum(x == [w] for x in ends) for w in ways], float)
        want = weight / weight.sum() * len(ends) if ways else weight
        assert ((got - want) ** 2 / want).sum() < 20 if len(ways) > 1 else got.sum() == len(ends) * len(ways)  # chi-square, four degrees of freedom at most: p of 5e-4
        assert abs(len(ends) - n / len(near[u])) < 5 * np.sqrt(n)


def test_walks_around_a_hub_by_joins(spark):
    star = edges(spark, [("hub", f"l{i:04d}") for i in range(1500)])
    got = graph.walks(star, 1, 3, strategy="joins").collect()
    assert len(got) == 1501 and all(len(r["walk"]) == 3 and r["walk"][1] == "hub" and r["walk"][2] != r["gene"] for r in got if r["gene"] != "hub")
    assert len({r["walk"][2] for r in got if r["gene"] != "hub"}) > 700 and [len(r["walk"]) for r in got if r["gene"] == "hub"] == [2]


def test_betweenness_by_arrays_and_by_joins_and_of_a_path(spark):
    e = small(spark, 15, 20)
    one, two = (as_dict(graph.betweenness(e, 15, strategy=s), value="betweenness") for s in ("auto", "joins"))
    assert one.keys() == two.keys() and all(abs(one[g] - two[g]) < 1e-9 for g in one)
    path = as_dict(graph.betweenness(edges(spark, [("a", "b"), ("b", "c"), ("c", "d")]), 10, strategy="joins"), value="betweenness")
    assert path == {"a": 0.0, "b": 2.0, "c": 2.0, "d": 0.0}


def test_rwr_strategies_agree_in_scores_and_rounds(spark):
    e = small(spark)
    seeds = spark.createDataFrame([("one", "g000"), ("two", "g005"), ("two", "g017"), ("far", "g039")], "col string, gene string")
    rows = []
    for how in ("blocks", "joins"):
        rows.append({(r["col"], r["gene"]): (r["score"], r["n_iter"], r["converged"]) for r in graph.rwr(e, seeds, 0.3, 1e-8, strategy=how).collect()})
    assert rows[0].keys() == rows[1].keys() and len(rows[0]) == 120
    for k, (s, n, ok) in rows[0].items():
        assert abs(s - rows[1][k][0]) < 1e-9 and (n, ok) == rows[1][k][1:] and ok
    only = spark.createDataFrame([("one", "g003"), ("far", "g000")], "col string, gene string")
    for how in ("blocks", "joins"):
        got = {(r["col"], r["gene"]): r["score"] for r in graph.rwr(e, seeds, 0.3, strategy=how, only=only).collect()}
        assert got.keys() == {("one", "g003"), ("far", "g000")} and all(abs(v - rows[0][k][0]) < 1e-9 for k, v in got.items())
    short = graph.rwr(e, seeds, 0.01, 1e-8, 3).select("n_iter", "converged").distinct().collect()
    assert [tuple(r) for r in short] == [(3, False)]
    assert [r[0] for r in graph.rwr(e, seeds, 0.5, 0.0, 4).select("converged").distinct().collect()] == [None]


def test_search_from_many_sources(spark, monkeypatch):
    monkeypatch.setattr(graph, "WORDS", 2)  # 130 genes: two blocks
    e = small(spark, 130, 90, 11).unionByName(edges(spark, [("x", "y")]))
    near: dict = {}
    for r in e.collect():
        near.setdefault(r["gene_a"], set()).add(r["gene_b"])
        near.setdefault(r["gene_b"], set()).add(r["gene_a"])
    want = {}
    for s in near:
        seen, front, d = {s: 0}, [s], 0
        while front:
            d += 1
            front = [x for g in front for x in near[g] if x not in seen and not seen.update({x: d})]
        for g, x in seen.items():
            want[g] = want.get(g, 0.0) + 1 / max(x, 1)
    got = as_dict(graph.closeness(e), value="closeness")
    assert got.keys() == near.keys() and all(abs(got[g] - want[g] / len(near)) < 1e-12 for g in near)
    few = as_dict(graph.closeness(e, exact=10, most=8), value="closeness")
    assert few.keys() == near.keys() and few["x"] == 0.0
    by_hops = graph.bfs(e, graph.landmarks(e, 8).select(F.col("gene").alias("source"), "gene"))
    counts = {(r["gene"], r["distance"]): r["n"] for r in graph.reach_counts(e, graph.landmarks(e, 8)).where("n > 0").collect()}
    assert counts == {(r["gene"], r["distance"]): r["n"] for r in by_hops.groupBy("gene", "distance").agg(F.count("*").alias("n")).collect()}


def test_rwr_series_is_separate_runs(spark):
    nets = {"one": small(spark), "two": small(spark, 30, 40, 9), "three": edges(spark, [("g000", "g001"), ("g001", "g002")])}
    union = arms.side_by_side(nets)
    seeds = spark.createDataFrame([(n, f"{n}{c}", g) for n in nets for c, g in (("a", "g000"), ("b", "g002"), ("b", "g001"))], "network string, col string, gene string")
    alphas = (0.5, 0.7, 0.9)
    want = {}
    for n, e in nets.items():
        for a in alphas:
            own = seeds.where(F.col("network") == n).drop("network")
            want |= {(n, r["col"], a, r["gene"]): (r["score"], r["n_iter"], r["converged"]) for r in graph.rwr(e, own, a, 1e-6, strategy="blocks").collect()}
    assert len({v[1] for v in want.values()}) > 3
    for how in ("blocks", "joins"):
        got = {(r["network"], r["col"], r["alpha"], r["gene"]): (r["score"], r["n_iter"], r["converged"]) for r in graph.rwr_series(union, seeds, alphas, 1e-6, strategy=how).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k][0] - v[0]) < 1e-8 and got[k][1:] == v[1:] for k, v in want.items())
    # more columns than a row of the joins holds
    many = spark.createDataFrame([(f"c{i:02d}", f"g{i:03d}") for i in range(39)], "col string, gene string")
    one, two = ({(r["col"], r["gene"]): round(r["score"], 9) for r in graph.rwr(nets["one"], many, 0.7, 1e-6, strategy=how).collect()} for how in ("blocks", "joins"))
    assert one == two and len(one) == 39 * 40


def test_rwr_of_weights_that_depend_on_both_ends(spark):
    e = small(spark)
    seeds = spark.createDataFrame([("one", "g000")], "col string, gene string")
    w = graph.transition(e, 0.7)
    one, two = ({r["gene"]: r["score"] for r in graph.rwr(e, seeds, 0.3, 1e-10, strategy=how, weights=w).collect()} for how in ("blocks", "joins"))
    assert one.keys() == two.keys() and all(abs(one[g] - two[g]) < 1e-12 for g in one) and abs(sum(one.values()) - 1) < 1e-8


def test_factorial_over_networks_of_their_own(spark):
    nets = {"one": small(spark), "two": small(spark, 30, 40, 9)}
    splits = {n: labels.stratified_splits(graph.degree(e).select("gene"), graph.degree(e).select("gene").where("gene < 'g012'"), 2, 3).withColumn("label_set", F.lit("l")) for n, e in nets.items()}
    both = splits["one"].withColumn("network", F.lit("one")).unionByName(splits["two"].withColumn("network", F.lit("two")))
    got = {tuple(r[c] for c in ("network", "alpha", "repeat", "fold", "method")): (r["auroc"], r["auprc"], r["n_iter"]) for r in arms.factorial(nets, both, (0.3, 0.6), k=3).collect()}
    for n, e in nets.items():
        for a in (0.3, 0.6):
            for r in arms.run_arm(e, splits[n].drop("label_set"), (a,), k=3).collect():
                x = got[(n, r["alpha"], r["repeat"], r["fold"], r["method"])]
                assert abs(x[0] - r["auroc"]) < 1e-8 and abs(x[1] - r["auprc"]) < 1e-8 and x[2] == r["n_iter"]
    with pytest.raises(ValueError, match="not in the network"):
        arms.factorial(nets, splits["one"], (0.5,), k=3)


def test_rwr_refuses_empty_seed_sets(spark):
    e = small(spark)
    for rows in ([], [("c", "nowhere")], [("c", "g000"), ("d", "nowhere")]):
        with pytest.raises(ValueError, match="seed set"):
            graph.rwr(e, spark.createDataFrame(rows, "col string, gene string"))
    with pytest.raises(ValueError, match="alpha"):
        graph.rwr(e, spark.createDataFrame([("c", "g000")], "col string, gene string"), 0.0)


def test_transition_problems(spark):
    w = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 0.5), ("b", "b", 0.5), ("a", "c", 1.0)], "src string, dst string, w double")
    assert {(r["rule"], r["n"]) for r in graph.transition_problems(w).collect()} == {("self_loop", 1), ("asymmetric", 1), ("isolated", 1)}
    with pytest.raises(ValueError, match="asymmetric"):
        graph.check_transition(w)
    e = edges(spark, [("a", "b"), ("b", "c")])
    assert graph.check_transition(graph.transition(e)).count() == 4
    safe = graph.transition_safe(spark.createDataFrame([("a",), ("z",)], "gene string"), e).collect()
    assert sorted((r["src"], r["dst"] or "", r["w"]) for r in safe) == [("a", "b", 1.0), ("z", "", 0.0)]


def test_descriptors_of_two_triangles(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")])
    comm = spark.createDataFrame([(x, "abc") for x in "abc"] + [(x, "def") for x in "def"], "gene string, community string")
    assert abs(graph.modularity(e, comm).first()[0] - (6 / 7 - 0.5)) < 1e-12
    r = graph.descriptors(e).first()
    assert (r["n_nodes"], r["n_edges"], r["max_core"], r["core2"], r["core10"]) == (6, 7, 2, 1.0, 0.0)
    assert abs(r["mean_path"] - 1.8) < 1e-12
    f = graph.features(e, 6)
    assert f.count() == 6 and set(f.columns) >= {"degree", "core", "clustering", "betweenness", "pagerank", "community_size"}


# --- splits and arms

def test_degree_matched_takes_both_sides_and_needs_candidates(spark):
    deg = spark.createDataFrame([("s", 5), ("l1", 4), ("l2", 4), ("h1", 6), ("far", 9)], "gene string, degree long")
    got = resample.degree_matched(deg, spark.createDataFrame([("s",)], "gene string"), 200)
    n = as_dict(got.groupBy("gene").count(), value="count")
    assert set(n) == {"l1", "l2", "h1"} and sum(n.values()) == 200 and min(n.values()) > 30
    with pytest.raises(ValueError, match="fewer candidates"):
        resample.degree_matched(deg, deg.where("gene <> 'far'").select("gene").limit(4), 2)
    cells = spark.createDataFrame([(0, "s"), (1, "l1")], "fold int, gene string")
    got = resample.degree_matched(deg, cells, 60, keys=["fold"]).select("fold", "gene").distinct().collect()
    assert {tuple(r) for r in got} == {(0, "l1"), (0, "l2"), (0, "h1"), (1, "l2")}


def test_complex_groups_skip_whole_complexes(spark):
    u = spark.createDataFrame([(f"g{i}",) for i in range(10)], "gene string")
    cx = spark.createDataFrame([("big", f"g{i}") for i in range(5)] + [("mid", f"g{i}") for i in (4, 5, 6, 7)] + [("low", "g8"), ("low", "g9")], "complex_id string, gene string")
    of = as_dict(labels.complex_groups(u, cx, max_group=6), value="group")
    assert {of[f"g{i}"] for i in range(5)} == {"g0"} and [of[f"g{i}"] for i in (5, 6, 7)] == ["g5", "g6", "g7"] and of["g8"] == of["g9"] == "g8"
    assert len(set(as_dict(labels.complex_groups(u, cx, max_group=50), value="group").values())) == 2


def test_grouped_splits(spark):
    u = spark.createDataFrame([(f"g{i:03d}",) for i in range(100)], "gene string")
    pos = spark.createDataFrame([(f"g{i:03d}",) for i in range(0, 100, 4)], "gene string")
    cx = spark.createDataFrame([(f"c{i // 12}", f"g{i:03d}") for i in range(60)], "complex_id string, gene string")
    s = labels.grouped_splits(u, pos, cx, 3, 5)
    r = labels.group_invariants(s).first()
    assert (r["n_genes"], r["n_groups"], r["n_groups_larger_than_k"], r["n_groups_split"]) == (100, 45, 5, 0) and r["pos_min"] >= 3 and r["pos_max"] <= 8
    assert s.groupBy("repeat").count().where("count <> 100").count() == 0 and s.where("moved").count() == 0
    one = {tuple(x) for x in s.where("repeat = 0").select("gene", "fold").collect()}
    assert one != {tuple(x) for x in s.where("repeat = 1").select("gene", "fold").collect()}
    # one group holds every positive: four folds are mended from it, one gene each
    few = labels.grouped_splits(u, spark.createDataFrame([(f"g{i:03d}",) for i in range(8)], "gene string"), cx, 1, 5)
    assert few.where("moved").count() == 4 and labels.group_invariants(few).first()["pos_min"] == 1
    none = spark.createDataFrame([], "complex_id string, gene string")
    plain = {tuple(x) for x in labels.stratified_splits(u, pos, 2, 5).collect()}
    assert {tuple(x) for x in labels.grouped_splits(u, pos, none, 2, 5).select("gene", "repeat", "fold", "y").collect()} == plain


def test_split_genes_outside_the_network_are_an_error(spark):
    e = small(spark)
    s = labels.stratified_splits(spark.createDataFrame([("g000",), ("g001",), ("nowhere",), ("g003",)], "gene string"), spark.createDataFrame([("g000",), ("g003",)], "gene string"), 1, 2)
    with pytest.raises(ValueError, match="1 genes of the splits are not in the network: nowhere"):
        arms.fold_scores(e, s, k=2)


@pytest.mark.parametrize("scenario", ["random", "hubs", "module"])
def test_toy_arms_find_what_was_planted(spark, scenario):
    e, pos = toy.toy_network(spark, scenario, 500, 3, 60)
    s = labels.stratified_splits(graph.degree(e).select("gene"), pos, 2, 5)
    r = arms.arm_margins(arms.run_arm(e, s), [], ["auroc"]).agg(F.avg("degree_auroc").alias("d"), F.avg("rwr_auroc").alias("r"), F.avg("delta_auroc").alias("m")).first()
    if scenario == "random":
        assert abs(r["d"] - 0.5) < 0.12 and abs(r["r"] - 0.5) < 0.12
    elif scenario == "hubs":
        assert r["d"] > 0.85 and r["m"] < 0.05
    else:
        assert abs(r["d"] - 0.5) < 0.12 and r["m"] > 0.1


@pytest.fixture(scope="module")
def arm(spark):
    e, pos = toy.toy_network(spark, "module", 300, 3, 50)
    e = graph.cut(e, "toy")
    return e, graph.cut(labels.stratified_splits(graph.degree(e).select("gene"), pos, 1, 5), "toysplits"), pos


def test_dump_and_contract(spark, arm, tmp_path):
    e, s, _ = arm
    scores = graph.cut(arms.fold_scores(e, s, (0.3, 0.5)), "dump")
    results = arms.run_arm(e, s, scores=scores)
    assert arms.dump_check(scores, results).agg(F.max("gap")).first()[0] < 1e-12
    table = arms.result_table(results, "toy", "module", "native")
    assert table.columns == tables.RESULT.names and table.count() == 15 and table.where("method = 'degree' and alpha is not null").count() == 0
    scans.write_scores(scores.withColumn("arm", F.lit("toy")), f"{tmp_path}/dump", ["arm"])
    back = scans.read_scores(spark, f"{tmp_path}/dump", 0.49)
    assert {r[0] for r in back.select("alpha").distinct().collect()} == {None, 0.5}
    scans.write_scores(scores.limit(7).withColumn("arm", F.lit("other")), f"{tmp_path}/dump", ["arm"])
    n = as_dict(scans.read_scores(spark, f"{tmp_path}/dump").groupBy("arm").count(), "arm", "count")
    assert n == {"toy": scores.count(), "other": 7}


def test_seed_null_tells_a_module(spark, arm):
    cells, z = templates.seed_null(*arm[:2], 10)
    r = z.first()
    assert cells.count() == 11 * 5 and r["observed"] > r["null_mean"] and r["z"] > 2 and r["n_null"] == 10 and abs(r["p_rank"] - 1 / 11) < 1e-12


def test_rewiring_null_tells_a_module(spark, arm):
    cells, z = templates.rewiring_null(*arm[:2], 4, 10.0)
    r = z.first()
    assert cells.count() == 25 and r["observed"] > r["null_mean"] and r["n_null"] == 4
    own = templates.cell_margins(arm[0], labels.fold_seeds(arm[1]), arm[1], ["repeat", "fold"])
    one, two = (sorted((x["fold"], round(x["delta"], 9)) for x in d.collect()) for d in (cells.where("rewire_id = -1"), own))
    assert one == two


def test_transfer_temporal_and_caps(spark, arm):
    e, s, pos = arm
    genes = sorted(r[0] for r in pos.collect())
    a, b = (spark.createDataFrame([(g,) for g in part], "gene string") for part in (genes[::2], genes[1::2]))
    pools = labels.transfer_pools(a, b, graph.degree(e), 200)
    t = templates.transfer(e, a, pools, 10, 50)
    assert t.count() == 10 and t.where("n_pos <> 25 or n_test <> 75").count() == 0 and t.agg(F.avg("delta")).first()[0] > 0.1
    # a full background leaves nothing to draw
    full = templates.transfer(e, a, pools, 2, 10_000).collect()
    assert full[0]["rwr_auroc"] == full[1]["rwr_auroc"]
    d = templates.temporal(e, pos, b, 4, (0.5,))
    assert d.count() == 4 and d.where("n_seeds < 25 and n_seeds > 8").count() == 4 and d.agg(F.avg("delta")).first()[0] > 0.1 and d.select("rwr_auroc").distinct().count() > 1
    sets = a.withColumn("label_set", F.lit("a")).unionByName(b.limit(10).withColumn("label_set", F.lit("b"))).withColumn("rank", F.row_number().over(__import__("pyspark").sql.Window.partitionBy("label_set").orderBy("gene")))
    c = templates.equal_size(e, sets, 1)
    assert c.count() == 10 and set(as_dict(c.groupBy("label_set").count(), "label_set", "count").values()) == {5}
    both = templates.panel(graph.degree(e).select("gene"), labels.cap_all(sets, graph.degree(e)), 1).groupBy("label_set").agg(F.sum("y").alias("p"))
    assert as_dict(both, "label_set", "p") == {"a": 10, "b": 10}


def test_strata_fractions_random_input_and_variants(spark, arm):
    e, s, pos = arm
    st = templates.seed_strata(e, s)
    assert st.count() == 15 and st.groupBy("fold").agg(F.sum("n_seeds").alias("n")).where("n <> 40").count() == 0
    cells, sd = templates.seed_fractions(e, labels.stratified_splits(graph.degree(e).select("gene"), pos, 2, 5), (1.0, 0.5))
    full = templates.cell_margins(e, labels.fold_seeds(s), s, ["repeat", "fold"])
    one = sorted((r["fold"], round(r["delta"], 9)) for r in cells.where("fraction = 1 and repeat = 0").collect())
    assert one == sorted((r["fold"], round(r["delta"], 9)) for r in full.collect()) and as_dict(sd, "fraction", "n_seeds") == {1.0: 40.0, 0.5: 20.0}
    runs, folds = templates.random_input(e, s, 2, 20)
    assert {r["run"] for r in runs.collect()} == {-1, 0, 1} and folds.count() == 10 and folds.where("jaccard < 0 or jaccard > 1 or abs(rho) > 1").count() == 0
    v = templates.hub_variants(e, s, (10,))
    assert {r[0] for r in v.select("variant").distinct().collect()} == {"full", "degpen0.5", "trunc10"}
    assert sorted((r["fold"], round(r["delta"], 9)) for r in v.where("variant = 'full'").collect()) == one


def test_endpoints_tiers_and_matched_background(spark, arm):
    e, s, pos = arm
    scores = graph.cut(arms.fold_scores(e, s), "scores")
    cells, ci = templates.early_endpoints(scores, 0.1)
    assert cells.count() == 5 and {r["endpoint"] for r in ci.collect()} == {"excess", "top_delta"}
    assert abs(spark.range(1).select(metrics.pauc_excess(F.lit(0.02), F.lit(0.0002), 0.02)).first()[0] - 1) < 1e-12
    tiers = pos.withColumn("tier", F.when(F.pmod(F.xxhash64("gene"), F.lit(2)) == 0, "a").otherwise("b"))
    m = templates.tier_margins(scores, tiers)
    assert m.count() == 10
    y = scores.where("fold = 0 and method = 'rwr'").join(tiers, "gene", "left").where("y = 0 or tier = 'a'").select("score", "y").collect()
    p, n = [r[0] for r in y if r[1]], [r[0] for r in y if not r[1]]
    want = sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))
    assert abs(m.where("tier = 'a' and fold = 0").first()["rwr_auroc"] - want) < 1e-9
    noisy = templates.tier_margins(scores, tiers, 0.5)
    assert noisy.count() == 10 and noisy.exceptAll(m).count() > 0
    counts = graph.degree(e).select("gene", F.log("degree").alias("log_n"))
    assert templates.matched_background(scores, counts).count() == 10
    v = graph.degree(e).withColumnRenamed("degree", "value").withColumn("log_n", F.col("value").cast("double"))
    got = {r["kind"]: r for r in templates.bait_null(v, v.orderBy(F.desc("value"), "gene").limit(20).select("gene"), "log_n", 99).collect()}
    assert got["unmatched"]["p"] == 0.01 and got["unmatched"]["ratio"] > 2 and got["matched"]["ratio"] < got["unmatched"]["ratio"]


def test_consensus_and_embedding(spark, arm):
    ranks = spark.createDataFrame([("n1", "a", 3.0), ("n1", "b", 2.0), ("n1", "c", 1.0), ("n2", "a", 1.0), ("n2", "b", 3.0), ("n2", "c", 2.0)], "net string, gene string, score double")
    y = spark.createDataFrame([("a",)], "gene string")
    got = {r["left_out"]: r["auroc"] for r in templates.consensus_left_out(ranks, "net", y).collect()}
    assert got == {"n1": 0.0, "n2": 1.0, None: 0.5}
    w = as_dict(templates.reliable_consensus(ranks, "net", spark.createDataFrame([("n1", 3.0), ("n2", 1.0)], "net string, weight double")), value="weighted_rank")
    assert w == {"a": 0.75, "b": 0.625, "c": 0.125}
    e, s, _ = arm
    vec = graph.degree(e).select("gene", F.array(F.lit(1.0), (F.pmod(F.xxhash64("gene"), F.lit(7)) / 7)).alias("vector"))
    assert templates.embedding_margins(vec, e, s).count() == 5
    assert templates.fold_shift(s, 2).where("fold not between 0 and 4").count() == 0


# --- statistics and stability

def test_tests_and_intervals_in_closed_form(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 1.0), ("b", 1.0)], "arm string, value double")
    r = {x["arm"]: x for x in stats.one_sample_t(df, ["arm"]).collect()}
    m, sd = 7 / 3, math.sqrt(7 / 3)
    t = m / (sd / math.sqrt(3))
    assert abs(r["a"]["t"] - t) < 1e-12 and abs(r["a"]["d"] - m / sd) < 1e-12 and r["b"]["t"] is None
    # two degrees of freedom: P(T > t) = (1 - t / sqrt(t^2 + 2)) / 2
    assert abs(r["a"]["p"] - (1 - t / math.sqrt(t * t + 2)) / 2) < 1e-10
    ti = {x["arm"]: x for x in stats.t_interval(df, ["arm"]).collect()}["a"]
    q = 4.302652729911275
    assert abs(ti["low"] - (m - q * sd / math.sqrt(3))) < 1e-8 and abs(ti["high"] - (m + q * sd / math.sqrt(3))) < 1e-8
    tt = {x["arm"]: x for x in stats.tost(df, ["arm"], 10.0).collect()}
    low = (m + 10) / (sd / math.sqrt(3))
    high = (10 - m) / (sd / math.sqrt(3))
    sf = lambda x: (1 - x / math.sqrt(x * x + 2)) / 2
    assert abs(tt["a"]["p_tost"] - max(sf(low), sf(high))) < 1e-10 and tt["a"]["verdict"] == "equivalent"
    assert tt["b"]["verdict"] == "zero variance" and all(tt["b"][c] is None for c in ("t_low", "p_high", "p_tost", "ci90_low", "ci95_high"))
    se = sd / math.sqrt(3)
    assert abs(tt["a"]["ci95_high"] - (m + q * se)) < 1e-8 and abs(tt["a"]["ci90_low"] - (m - 2.919985580355516 * se)) < 1e-8
    assert stats.tost(df, ["arm"], 0.5).where("arm = 'a'").first()["verdict"] == "superior"
    assert stats.tost(df.limit(1), ["arm"]).first()["verdict"] == "insufficient data"
    assert abs(D.f_sf(3.0, 2, 4) - (1 / (1 + 2 * 3.0 / 4)) ** 2) < 1e-12 and abs(D.chi2_sf(3.0, 2) - math.exp(-1.5)) < 1e-12
    k = stats.kruskal(spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 3.0), ("y", 4.0), ("z", 5.0), ("z", 6.0)], "g string, value double"), "g").first()
    assert abs(k["h"] - 32 / 7) < 1e-12 and abs(k["p"] - math.exp(-16 / 7)) < 1e-10
    z = stats.null_z(spark.createDataFrame([(3.0,)], "value double"), spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "value double"), []).first()
    assert z["z"] == 2.0 and abs(z["p"] - 0.5 * math.erfc(2 / math.sqrt(2))) < 1e-12


def test_bca_and_percentile_against_brute_force(spark):
    from statistics import NormalDist

    values = [0.3, 1.2, 2.5, 2.9, 7.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "arm string, repeat int, value double")
    boot = np.sort([r["value"] for r in stats.bootstrap(df, ["arm"], 400).collect()])
    x = np.array(values)
    j = (x.sum() - x) / 4
    d = j.mean() - j
    a = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
    z0 = NormalDist().inv_cdf((boot.round(12) < x.mean().round(12)).mean())
    at = [NormalDist().cdf(z0 + (z0 + NormalDist().inv_cdf(q)) / (1 - a * (z0 + NormalDist().inv_cdf(q)))) for q in (0.025, 0.975)]
    (r,) = {tuple(stats.bca_interval(df.repartition(n), ["arm"], 400).first()[1:]) for n in (1, 3, 8)}
    r = dict(zip(("low", "high"), r, strict=True))
    assert np.allclose([r["low"], r["high"]], np.quantile(boot, at), atol=1e-9)
    two = stats.bca_interval(df.limit(2), ["arm"], 50).first()
    assert abs(two["low"] - (0.75 - 12.706204736174698 * 0.45)) < 1e-6
    lone = stats.bca_interval(df.limit(1), ["arm"], 50).first()
    assert lone["low"] is None or math.isnan(lone["low"])
    one = stats.bca_interval(df.withColumn("value", F.lit(2.0)), ["arm"], 50).first()
    assert (one["low"], one["high"]) == (2.0, 2.0)
    p = stats.percentile_interval(df, ["arm"], 400).first()
    assert np.allclose([p["low"], p["high"]], np.quantile(boot, [0.025, 0.975]), atol=1e-9)


def test_permutation_p_against_brute_force(spark):
    import hashlib

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=12), rng.normal(size=12)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k int, x double, y double")
    rank = lambda v: np.argsort(np.argsort(v)) + 1.0
    rx, ry, hit = rank(x), rank(y), 0
    own = np.corrcoef(rx, ry)[0, 1]
    for p in range(300):
        u = [int(hashlib.md5(f"{i}|perm|{p}".encode()).hexdigest()[:8], 16) for i in range(1, 13)]
        dealt = np.empty(12, int)
        dealt[np.argsort(u, kind="stable")] = np.arange(12)
        hit += abs(np.corrcoef(rx, ry[dealt])[0, 1]) >= abs(own) - 1e-12
    r = stats.permutation(df, "x", "y", "k", 300).first()
    assert r["k"] == hit and abs(r["rho"] - own) < 1e-12 and abs(r["p"] - (hit + 1) / 301) < 1e-12


def test_verdict_units_standardise_components(spark):
    ci = spark.createDataFrame([("fold", "n1", "a", 0.1), ("fold", "n2", "a", -0.1), ("repeat", "n1", "a", 0.2)], "unit string, net string, lab string, low double")
    got = {r["unit"]: r for r in stats.verdict(ci, ["unit"], ["net", "lab"]).collect()}
    assert (got["fold"]["arms"], got["fold"]["excluding"], got["fold"]["holds"], got["fold"]["failing"]) == (2, 1, False, "n2/a") and got["repeat"]["holds"]
    m = spark.createDataFrame([("a", r, f, float(r + f % 2)) for r in range(6) for f in range(5)], "arm string, repeat int, fold int, delta double")
    u = stats.all_units(m, ["arm"], replicates=50).collect()
    assert {(r["unit"], r["method"]) for r in u} == {(x, y) for x in ("fold", "repeat") for y in ("percentile", "t", "bca")} and all(r["low"] <= r["mean"] <= r["high"] for r in u)
    s = stats.standardise(spark.createDataFrame([("a", 1.0, 5.0), ("a", 3.0, 5.0)], "k string, x double, y double"), ["x", "y"], ["k"]).orderBy("x").collect()
    assert abs(s[0]["x"] + 1 / math.sqrt(2)) < 1e-12 and s[0]["y"] is None
    rows = [(f"a{i}", f"b{j}", float(10 * i + j % 2 + k)) for i in range(3) for j in range(2) for k in range(2)]
    c = {r["component"]: r for r in stats.variance_components(spark.createDataFrame(rows, "a string, b string, value double"), "a", "b").collect()}
    assert abs(c["within"]["variance"] - 0.5) < 1e-9 and abs(c["a"]["variance"] - 100) < 1e-6 and abs(sum(r["share"] for r in c.values()) - 1) < 1e-12
    pca = stats.principal_shares(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5)], "x double, y double"), ["x", "y"]).orderBy("component").collect()
    assert abs(sum(r["share"] for r in pca) - 1) < 1e-12 and pca[0]["share"] > 0.99 and abs(pca[0]["x"] - pca[0]["y"]) < 1e-9


def scored(spark, n=30, repeats=4, seed=0):
    rng = np.random.default_rng(seed)
    rows = [("k", r, f"g{i:02d}", float(np.round(rng.normal() + i / 6, 6)), int(i > 20)) for r in range(repeats) for i in range(n)]
    return spark.createDataFrame(rows, "key string, repeat int, gene string, score double, y int"), rows


def weighted(values, weights):
    o = np.argsort(values, kind="stable")
    c = np.cumsum(np.array(weights)[o])
    return np.array(values)[o][np.count_nonzero(c < c[-1] / 2)]


def test_clms_against_brute_force(spark):
    df, rows = scored(spark, repeats=1)
    conf = {g: (i * 7 % 5 + 1) / 8 for i, (_, _, g, _, _) in enumerate(rows)}
    df = df.withColumn("confidence", F.create_map(*[x for g, c in conf.items() for x in (F.lit(g), F.lit(c))])[F.col("gene")])
    order = sorted((s, g) for _, _, g, s, _ in rows)
    crowd = {g: sum(abs(s - o) <= 0.5 for o, _ in order) for s, g in order}
    crowded = stability.crowding(df, ["key"], 0.5)
    for variant in ("global", "crowding"):
        got = as_dict(stability.clms(crowded, ["key"], 3, 0.5, variant), value="smoothed")
        for i, (s, g) in enumerate(order):
            near = sorted(((abs(o - s), j) for j, (o, _) in enumerate(order) if j != i))[:3]
            at = [i, *[j for _, j in near]]
            m = weighted([order[j][0] for j in at], [conf[order[j][1]] for j in at])
            lam = 0.5 * (crowd[g] / max(crowd.values()) if variant == "crowding" else 1)
            assert abs(got[g] - (s + lam * (m - s))) < 1e-9
    with pytest.raises(ValueError, match="variant"):
        stability.clms(df, ["key"], 3, 0.5, "else")
    zero = as_dict(stability.clms(df, ["key"], 3, 0.0), value="smoothed")
    assert all(abs(zero[g] - s) < 1e-12 for s, g in order)


def test_crowding_pool_and_band_against_brute_force(spark):
    df, rows = scored(spark, repeats=2)
    w = spark.createDataFrame([("k", 0, 0.4), ("k", 1, 1.1)], "key string, repeat int, width double")
    width = {0: 0.4, 1: 1.1}
    by = {r: [(s, g) for _, q, g, s, _ in rows if q == r] for r in (0, 1)}
    for r in stability.crowding_by(df, ["key", "repeat"], w).collect():
        assert r["crowd"] == sum(r["score"] - width[r["repeat"]] <= s <= r["score"] + width[r["repeat"]] for s, _ in by[r["repeat"]])
    ties = spark.createDataFrame([("k", f"n{i:02d}", float(i // 7)) for i in range(28)], "key string, gene string, score double")
    asks = spark.createDataFrame([("k", "x", 1.0), ("k", "y", 1.5), ("k", "z", 9.0)], "key string, gene string, score double")
    pool = [(float(i // 7), f"n{i:02d}") for i in range(28)]
    for g, s in (("x", 1.0), ("y", 1.5), ("z", 9.0)):
        want = [n for _, _, n in sorted((abs(v - s), v, n) for v, n in pool)[:4]]
        got = stability.nearest_in_pool(asks, ties, ["key"], 4).where(f"gene = '{g}'").orderBy("place").collect()
        assert [r["near"] for r in got] == want
    for r in stability.rank_band(df, ["key", "repeat"], 0.1).collect():
        o = sorted(by[r["repeat"]], key=lambda t: (-t[0], t[1]))
        p = o.index((r["score"], r["gene"]))
        band = o[max(p - 3, 0) : p + 4]
        assert r["near_ranks"] == len(band) and abs(r["band_spread"] - (band[0][0] - band[-1][0])) < 1e-9


def test_diagnosis_against_brute_force(spark):
    df, rows = scored(spark, 12, 3)
    mean = {}
    for _, _, g, s, _ in rows:
        mean[g] = mean.get(g, 0) + s / 3
    mean = {g: round(m, 10) for g, m in mean.items()}
    own = {g: [sum(m > s for o, m in mean.items() if o != g) / 11 for _, _, h, s, _ in rows if h == g] for g in mean}
    others = {g: [sum(s > mean[g] for _, q, h, s, _ in rows if q == r and h != g) / 11 for r in range(3)] for g in mean}
    for r in stability.diagnose(df.drop("y"), ["key"]).collect():
        assert abs(r["own_sd"] - np.std(own[r["gene"]], ddof=1)) < 1e-9 and abs(r["others_sd"] - np.std(others[r["gene"]], ddof=1)) < 1e-9


def test_grid_control_scorecard_and_operators(spark):
    df, rows = scored(spark, 24, 4)
    table, chosen = stability.smoothing_grid(df, ["key"], (3,), (0.0, 0.5), 2)
    assert table.count() == 2 * 2 * 2 and chosen.count() == 4
    base = {r["part"]: r for r in table.where("shrink = 0 and variant = 'global'").collect()}
    for part in (0, 1):
        want = []
        for rep in range(4):
            if rep % 2 != part:
                p = [s for _, q, _, s, y in rows if q == rep and y]
                n = [s for _, q, _, s, y in rows if q == rep and not y]
                want.append(sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n)))
        assert abs(base[part]["auroc"] - np.mean(want)) < 1e-9
    c = stability.random_control(df.drop("y"), ["key"], 3, 0.5, 5).first()
    assert c["p"] >= 1 / 6 and c["null_sd"] > 0
    ops = stability.operators_side_by_side(df.where("repeat = 0").drop("repeat", "y"), ["key"], 3)
    assert as_dict(ops.groupBy("operator").count(), "operator", "count") == {o: 24 for o in ("none", "local", "clms", "clms_crowding", "global", "flat", "moving")}
    t = spark.createDataFrame([("k", 0.0, 0.80, 0.10), ("k", 0.5, 0.795, 0.08), ("k", 1.0, 0.70, 0.05)], "key string, shrink double, auroc double, rank_sd double")
    assert as_dict(stability.scorecard(t, ["key"]), "check", "holds") == {"monotone": True, "tenth": True, "full_keeps": False, "some_keeps": True}
    per = spark.createDataFrame([(f"n{i}", f"l{j}", float(i + j)) for i in range(4) for j in range(2)], "net string, lab string, value double")
    about = spark.createDataFrame([(f"n{i}", float(i * i), float(-i)) for i in range(4)], "net string, size double, other double")
    got = {r["predictor"]: r for r in stability.network_stability(per, about, "net", "value", ["size", "other"]).collect()}
    assert got["size"]["n"] == 8 and got["size"]["rho"] > 0.9 and got["other"]["rho"] < -0.9 and got["size"]["rho_least"] <= got["size"]["rho"]
    two = stability.within_and_transfer(per.withColumnRenamed("value", "delta"), per.withColumnRenamed("value", "delta"), ["lab"])
    assert two.count() == 4


def test_medians_and_random_neighbours(spark):
    e = edges(spark, [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c")])
    s = spark.createDataFrame([("a", 9.0, 1.0), ("b", 1.0, 1.0), ("c", 2.0, 5.0), ("d", 3.0, 1.0)], "gene string, score double, confidence double")
    assert as_dict(stability.network_median(s, e), value="median") == {"a": 2.0, "b": 2.0, "c": 1.0, "d": 9.0}
    df, _ = scored(spark, 10, 1)
    r = stability.random_neighbours(df, ["key"], 1, 200)
    scores = as_dict(df, value="score")
    assert r.count() == 2000
    # one other: the lower of the two is the first at which half of an even weight is reached
    assert all(x["median"] <= scores[x["gene"]] for x in r.collect()) and {x["median"] for x in r.collect()} >= set(sorted(scores.values())[:-1])
    heavy = stability.random_neighbours(df.withColumn("confidence", F.when(F.col("gene") == df.first()["gene"], 100.0).otherwise(1.0)), ["key"], 4, 20)
    assert {x["median"] for x in heavy.where(F.col("gene") == df.first()["gene"]).collect()} == {scores[df.first()["gene"]]}
    assert [x["median"] for x in stability.random_neighbours(df.limit(1), ["key"], 4, 2).collect()] == [df.first()["score"]] * 2


def test_louvain(spark):
    rng = np.random.default_rng(3)
    planted = [(i, j) for i in range(120) for j in range(i) if rng.random() < (0.5 if i // 20 == j // 20 else 0.02)]
    e = edges(spark, [(f"g{j:03d}", f"g{i:03d}") for i, j in planted])
    got = as_dict(graph.louvain(e), value="community")
    assert got == {f"g{i:03d}": f"g{i // 20 * 20:03d}" for i in range(120)}  # each planted group, by its smallest gene
    assert got == as_dict(graph.louvain(e.repartition(7)), value="community")
    q = lambda x, c: graph.modularity(x, c).first()[0]
    loose = small(spark, 150, 500, 4)
    c = graph.louvain(loose)
    assert q(loose, c) >= q(loose, graph.label_propagation(loose)) and q(loose, c) > 0.25
    # no single gene can be moved to a neighbour's community with a gain
    near: dict = {}
    for r in loose.collect():
        near.setdefault(r["gene_a"], set()).add(r["gene_b"])
        near.setdefault(r["gene_b"], set()).add(r["gene_a"])
    where, m2 = as_dict(c, value="community"), sum(map(len, near.values()))
    apart = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")])
    assert as_dict(graph.louvain(apart), value="community") == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert graph.louvain(apart.limit(0)).count() == 0 and len(where) == len(near) and m2 > 0


def test_label_propagation_joins_cliques(spark):
    clique = lambda name: [(f"{name}{i}", f"{name}{j}") for i in range(5) for j in range(i)]
    c = as_dict(graph.label_propagation(edges(spark, clique("a") + clique("b") + [("a0", "b0")]), 10), value="community")
    assert len({c[f"a{i}"] for i in range(5)}) == 1 and len({c[f"b{i}"] for i in range(5)}) == 1


def test_greedy_pairs_against_brute_force(spark):
    import hashlib

    rows = [(f"g{i:02d}", float(i * 37 % 23), int(i < 6)) for i in range(20)]
    df = spark.createDataFrame([(0, *r) for r in rows], "fold int, gene string, v double, y int")
    u = lambda g: int(hashlib.md5(f"{g}|greedy".encode()).hexdigest()[:8], 16)
    free = sorted((v, g) for g, v, y in rows if not y)
    want = {}
    for g, v in sorted(((g, v) for g, v, y in rows if y), key=lambda x: u(x[0])):
        best = min(free, key=lambda x: (abs(x[0] - v), x[0]))
        want[g] = best[0]
        free.remove(best)
    value = {g: v for g, v, _ in rows}
    got = {r["gene"]: value[r["near"]] for r in resample.greedy_pairs(df, ["fold"], "v").collect()}
    assert got == want


def test_coexpression_in_blocks_is_pearson(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 6))
    x[1] = 2 * x[0] + 1
    x[8] = 3.0
    df = spark.createDataFrame([("c", f"g{i}", s, float(x[i, s])) for i in range(9) for s in range(6)], "cohort string, gene string, sample int, value double")
    r = np.corrcoef(x[:8])
    want = {(f"g{i}", f"g{j}"): np.arctanh(np.clip(r[i, j], -0.999999, 0.999999)) for i in range(8) for j in range(i + 1, 8)}
    for block in (3, 100):
        got = {(q["gene_a"], q["gene_b"]): q["z"] for q in resample.coexpression(df, 1000, 1000, block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        top = resample.coexpression(df, 4, 4, block).collect()
        assert {(q["gene_a"], q["gene_b"]) for q in top} == set(sorted(want, key=lambda k: -abs(want[k]))[:4])


# --- catalogues and scans

def test_catalogues(spark):
    hgnc = spark.createDataFrame([("TP53", "P53|", "LFS1", "7157", "ENSG1", "P04637"), ("MDM2", None, "HDM2|X", "4193; 9", "ENSG2", None), ("KRAS", "", "X", "3845", "ENSG3", "P01116|P01117")], "symbol string, prev_symbol string, alias_symbol string, entrez_id string, ensembl_gene_id string, uniprot_ids string")
    names = labels.symbol_map(hgnc)
    assert sorted((r["symbol"], r["prev_symbol"] or "", r["alias_symbol"], r["uniprot_ids"] or "") for r in catalogues.explode_map(hgnc).collect()) == [("KRAS", "", "X", "P01116"), ("KRAS", "", "X", "P01117"), ("MDM2", "", "HDM2", ""), ("MDM2", "", "X", ""), ("TP53", "P53", "LFS1", "P04637")]
    ok = catalogues.is_approved(spark.createDataFrame([("TP53",), ("P53",), (None,)], "s string"), "s", hgnc).collect()
    assert {r["s"]: r["approved"] for r in ok} == {"TP53": True, "P53": False, None: False}
    rows = spark.createDataFrame([("P53", "a"), ("TP53", "b"), ("KRAS", "a"), ("KRAS", "a"), ("HDM2", "c"), ("X", "z")], "SYMBOL string, CANCER_TYPE string")
    assert [(r["gene"], r["rank"]) for r in catalogues.drivers(rows, names, "r").orderBy("rank").collect()] == [("TP53", 1), ("KRAS", 2), ("MDM2", 3)]
    with pytest.raises(ValueError, match="CANCER_TYPE"):
        catalogues.drivers(rows.drop("CANCER_TYPE"), names, "r")
    dis = spark.createDataFrame([("D1", ["O"], None), ("D2", None, ["x", "O"]), ("D3", [], ["x"])], "id string, therapeuticAreas array<string>, ancestors array<string>")
    ids = catalogues.cancer_ids(dis, "O")
    assert sorted(r[0] for r in ids.collect()) == ["D1", "D2"]
    val = spark.createDataFrame([("TP53", "D1", "Definitive"), ("TP53", "D2", "Moderate"), ("KRAS", "D1", "Strong"), ("KRAS", "D3", "Strong"), ("HDM2", "D1", "Limited")], "symbol string, disease string, classification string")
    assert [(r["gene"], r["rank"]) for r in catalogues.validity(val, ids, names, "r").orderBy("rank").collect()] == [("TP53", 1), ("KRAS", 2)]
    ncg = catalogues.catalogue(spark.createDataFrame([("TP53", 7157), ("MDM2", 9), ("NEW", 1)], "symbol string, entrez long"), spark.createDataFrame([("TP53", 0, 1)], "symbol string, oncogene int, tsg int"), spark.createDataFrame([("TP53",), ("MDM2",)], "symbol string"), spark.createDataFrame([("MDM2", "p1", "lung", ""), ("MDM2", "p2", "skin", None), ("MDM2", "p2", "skin", "arm"), ("MDM2", "p2", "-", "multiple"), ("NEW", "p9", "nan", "multiple"), *[("TP53", "p1", f"t{i}", "-") for i in range(7)]], "symbol string, publication string, cancer_type string, primary_site string"), hgnc)
    got = {r["symbol"]: r for r in ncg.collect()}
    assert [got[g]["tier"] for g in ("TP53", "MDM2", "NEW")] == ["known", "candidate", "screening"] and got["MDM2"]["cancer_type"] == "lung;skin" and got["MDM2"]["primary_site"] == "arm" and got["MDM2"]["n_publications"] == 2 and got["MDM2"]["matches"] and not got["NEW"]["matches"] and got["TP53"]["is_tsg"] == 1
    assert got["TP53"]["cancer_type"] == ";".join(f"t{i}" for i in range(7)) and got["TP53"]["primary_site"] == "" and (got["NEW"]["cancer_type"], got["NEW"]["primary_site"]) == ("", "multiple")
    sc = spark.createDataFrame([("t1", "D1", "lit", 0.9), ("t1", "D1", "exp", 0.5), ("t1", "D1", "gen", 0.4), ("t2", "D2", "exp", 0.6), ("t2", "D3", "exp", 1.0)], "targetId string, diseaseId string, datasourceId string, score double")
    tg = spark.createDataFrame([("t1", "A"), ("t2", "B")], "id string, symbol string")
    assert [r["gene"] for r in catalogues.association_labels(sc, tg, ids, 5, "r").orderBy("rank").collect()] == ["A", "B"]
    assert [r["gene"] for r in catalogues.association_labels(sc, tg, ids, 5, "r", "lit").orderBy("rank").collect()] == ["B", "A"]  # (0.5 + 0.1) / (pi^2 / 6) < 0.6
    cx = catalogues.complex_map(spark.createDataFrame([("c1", "P04637; P01116-2,Q0")], "complex_id string, members string"), spark.createDataFrame([("P04637", "TP53"), ("P01116", "KRAS"), ("Q0", "KRAS")], "uniprot string, gene string"), "s")
    assert sorted((r["gene"], r["n_members"]) for r in cx.collect()) == [("KRAS", 3), ("KRAS", 3), ("TP53", 3)]  # two accessions of one gene are two members
    tiers = catalogues.evidence_tiers(spark.createDataFrame([("a", "w"), ("b", "s1"), ("b", "s2"), ("c", "s1"), ("c", "w")], "gene string, source string"), ["s1", "s2"])
    assert as_dict(tiers, value="tier") == {"a": "only_weak", "b": "strong", "c": "mixed"}
    best = catalogues.best_channel(spark.createDataFrame([(1.0, 2.0, None), (3.0, 3.0, 1.0), (None, None, None)], "x double, y double, z double"), ["x", "y", "z"]).collect()
    assert [(r["best"], r["channel"]) for r in best] == [(2.0, "y"), (3.0, "x"), (None, None)]


def test_network_builders_and_sinks(spark, tmp_path):
    (tmp_path / "links.txt").write_text("protein1 protein2 combined_score\n9606.P53 9606.MDM2 900\n9606.MDM2 9606.P53 800\n9606.P53 9606.P53 999\n9606.KRAS 9606.MDM2 650\n9606.A1 9606.B1 990\n")
    raw = scans.read_links(spark, f"{tmp_path}/links.txt")
    names = spark.createDataFrame([("P53", "TP53"), ("MDM2", "MDM2"), ("KRAS", "KRAS")], "key string, symbol string")
    e, counts = catalogues.build_network(raw, "links", names)
    r = counts.first()
    assert {(x["gene_a"], x["gene_b"], x["weight"]) for x in e.collect()} == {("MDM2", "TP53", 0.9), ("KRAS", "MDM2", 0.65)}
    assert (r["n_input_edges"], r["n_mapped_edges"], r["n_self_loops"], r["n_edges_dedup"], r["n_nodes_lcc"]) == (5, 4, 1, 2, 3)
    many = catalogues.build_networks(raw, "links", [0.6, 0.8], names)
    assert {k: v[0].count() for k, v in many.items()} == {"links600": 2, "links800": 1}
    scans.write_network(e, counts, f"{tmp_path}/net")
    genes, both = scans.read_network(spark, f"{tmp_path}/net/edges")
    assert [x[0] for x in genes.collect()] == ["KRAS", "MDM2", "TP53"] and both.count() == 4
    meta = scans.read_meta(spark, f"{tmp_path}/net", "n_input_edges long, net_id string").first()
    assert (meta["n_input_edges"], meta["net_id"]) == (5, "links") and meta["date"].year >= 2024
    bad = spark.createDataFrame([("B", "A", 1.0), ("A", "B", 1.0)], EDGES)
    tables.write_tsv(bad, f"{tmp_path}/bad")
    with pytest.raises(ValueError, match="order"):
        scans.read_network(spark, f"{tmp_path}/bad")


def test_scans(spark, tmp_path):
    cells = ["uniprotkb:P1", "uniprotkb:P2", "", "", "", "", "", "", "", "taxid:9606(human)", "taxid:9606", "", "", "", "author|intact-miscore:0.56"]
    other = [*cells[:9], "taxid:10090", *cells[10:]]
    (tmp_path / "intact.txt").write_text("\t".join(scans.INTERACTION) + "\n" + "\t".join(cells) + "\n" + "\t".join(other) + "\n")
    assert [tuple(r) for r in scans.read_interactions(spark, f"{tmp_path}/intact.txt").collect()] == [("P1", "P2", 0.56)]
    (tmp_path / "path.txt").write_text("# comment\nuniprotkb:A\t-\t-\tuniprotkb:B\t-\t-\tx\ty\tz\n")
    assert [tuple(r) for r in scans.read_pathway(spark, f"{tmp_path}/path.txt").collect()] == [("A", "B", 1.0)]
    (tmp_path / "pairs.txt").write_text("A\tB\nC\tD\n")
    assert scans.read_pairs(spark, f"{tmp_path}/pairs.txt").count() == 2
    (tmp_path / "g2p.tsv").write_text("#tax_id\tGeneID\tPubMed_ID\n9606\t7157\t1\n9606\t7157\t1\n9606\t7157\t2\n23\t7157\t9\n")
    assert [tuple(r) for r in scans.read_counts(spark, f"{tmp_path}/g2p.tsv").collect()] == [("7157", 2)]
    (tmp_path / "pre.csv").write_text('one\ntwo\nGENE,CLASS\n+++++,+++++\nTP53,"a, b"\n\nKRAS,c\n')
    assert [tuple(r) for r in scans.read_preamble(spark, f"{tmp_path}/pre.csv", "gene string, class string", 2).collect()] == [("TP53", "a, b"), ("KRAS", "c")]
    (tmp_path / "wide.csv").write_text("model,main,TP53 (7157),KRAS (3845)\nm1,No,-9,-9\nm1,Yes,-1.5,0.2\nm2,yes,,0.3\nm1,Yes,-3,0.1\n")
    assert sorted(tuple(r) for r in scans.read_wide(spark, f"{tmp_path}/wide.csv", "model", default="main").collect()) == [("m1", "KRAS", 0.2), ("m1", "TP53", -1.5), ("m2", "KRAS", 0.3)]
    assert ("m1", "TP53", -9.0) in [tuple(r) for r in scans.read_wide(spark, f"{tmp_path}/wide.csv", "model", meta=("main",)).collect()]
    (tmp_path / "hgnc.txt").write_text("\t".join(scans.NOMENCLATURE) + "\nTP53\tApproved\t\t\t1\tE\tP\nOLD\tWithdrawn\t\t\t\t\t\n")
    assert [r["symbol"] for r in scans.read_nomenclature(spark, f"{tmp_path}/hgnc.txt").collect()] == ["TP53"]
    (tmp_path / "lack.txt").write_text("symbol\tstatus\nA\tApproved\n")
    with pytest.raises(ValueError, match="missing columns: prev_symbol"):
        scans.read_nomenclature(spark, f"{tmp_path}/lack.txt")


def test_archives_and_expression(spark, tmp_path):
    os.makedirs(tmp_path / "arc")
    body = "gene\ts1\ts2\ts3\nA\t1\t0\t3\nB\t0\t0\tNA\nÄ\t1\t2\t3\n"
    with tarfile.open(tmp_path / "arc/x.tgz", "w:gz") as t:
        raw = body.encode("latin-1")
        info = tarfile.TarInfo("dir/m_expr.txt")
        info.size = len(raw)
        t.addfile(info, io.BytesIO(raw))
        t.addfile(tarfile.TarInfo("dir/readme.md"))
    with zipfile.ZipFile(tmp_path / "arc/y.zip", "w") as z:
        z.writestr("n_expr.txt", body)
    m = scans.read_members(spark, f"{tmp_path}/arc", "_expr.txt")
    v = scans.matrix(m)
    assert v.groupBy("member").count().collect() and {(r["member"], r["gene"], r["sample"], r["value"]) for r in v.where("gene in ('A', 'Ä') and sample = 's3'").collect()} == {(x, g, "s3", 3.0) for x in ("dir/m_expr.txt", "n_expr.txt") for g in ("A", "Ä")}
    kept = scans.expressed(v.withColumnRenamed("member", "cohort"))
    assert {r[0] for r in kept.select("gene").distinct().collect()} == {"A", "Ä"}


def test_parts_lines_and_digests(spark, tmp_path):
    spark.range(3).withColumn("x", F.lit(1)).coalesce(1).write.parquet(f"{tmp_path}/parts")
    assert scans.unreadable_parts(spark, f"{tmp_path}/parts").count() == 0
    (tmp_path / "parts/part-broken.parquet").write_bytes(b"nonsense")
    assert scans.unreadable_parts(spark, f"{tmp_path}/parts").count() == 1
    assert tables.read_parts(spark, f"{tmp_path}/parts", ["id"]).count() == 3
    (tmp_path / "u.txt").write_text("A\n\n B \nA\n")
    assert sorted(r[0] for r in tables.read_lines(spark, f"{tmp_path}/u.txt").collect()) == ["A", "B"]
    (tmp_path / "m.json").write_text('{"n": 3,\n "name": "x"}')
    assert tuple(tables.read_json(spark, f"{tmp_path}/m.json", "n long, name string").first()) == (3, "x")
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.html").write_bytes(b"  <!DOCTYPE html><p>\r\n")
    (tmp_path / "f/b.bin").write_bytes(b"\x1f\x8bxx")
    d = {os.path.basename(r["path"]): r for r in tables.file_digests(spark, f"{tmp_path}/f").collect()}
    import hashlib

    assert d["a.html"]["kind"] == "html" and d["b.bin"]["kind"] == "gzip" and d["a.html"]["md5"] == hashlib.md5(b"  <!DOCTYPE html><p>\r\n").hexdigest()
    assert d["a.html"]["sha256_normalised"] == hashlib.sha256(b"  <!DOCTYPE html><p>\n").hexdigest()
    want, have = (spark.createDataFrame(x, "name string, fingerprint string") for x in ([("a", "1"), ("b", "2"), ("c", "3")], [("a", "1"), ("b", "9"), ("d", "4")]))
    assert {r["name"]: r["state"] for r in tables.manifest_changes(want, have).collect()} == {"a": "same", "b": "changed", "c": "missing", "d": "new"}
    ch = tables.channel_edges(spark.createDataFrame([("a", "b", 0.0, 0.2), ("a", "c", 0.0, 0.0)], "x string, y string, e double, f double"), ["e", "f"])
    assert [r["weight"] for r in ch.collect()] == [0.2]
    sp = spark.createDataFrame([("l", "u", "g", 0, 1, 1)], "label_set string, universe string, gene string, repeat int, fold int, y int")
    tables.write_splits(sp, f"{tmp_path}/splits")
    assert spark.read.parquet(f"{tmp_path}/splits/label_set=l/universe=u").count() == 1
    facts = controls.compare_facts(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "quantity string, value double"), spark.createDataFrame([("a", 1.0), ("b", 2.5)], "quantity string, value double"))
    assert as_dict(facts, "quantity", "status") == {"a": "PASS", "b": "FAIL", "c": "MISSING"}
    audit = controls.audit({"n": (spark.range(2).agg(F.count("*").alias("n")), "n = 2"), "m": (spark.range(2).agg(F.count("*").alias("n")), "n = 3")})
    assert as_dict(audit, "test_id", "status") == {"n": "PASS", "m": "FAIL"}


def test_bench_network_is_canonical(spark):
    e = toy.bench_network(spark, 200, 1000)
    assert tables.violations(e, "network").count() == 0 and e.count() > 500
