"""Queries over controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import controls, graph, labels, stability
from . import base
from .base import S_DEG, S_DIR, S_DOC, S_E1, S_REP, query, t, with_
from .q_graph import S_SEED, R, _auroc_sql, _seeds, _splits_sql
from .q_metrics import _means
from .q_stability import S_M

S_CAT = "cat AS (SELECT p_partkey AS gene FROM part WHERE p_retailprice >= 1500)"


def _catalogue(spark, d):
    return t(spark, d, "part").where("p_retailprice >= 1500").select(F.col("p_partkey").alias("gene"))


def _splits(spark, d):
    return labels.stratified_splits(graph.degree(base.edges(spark, d)).select("gene"), _seeds(spark, d).select("gene"), 2, 5)


@query(with_(S_E1, S_DIR, S_DEG, S_SEED, _splits_sql(2), S_CAT) + " SELECT repeat, fold, count(*)::BIGINT AS n, sum(y)::BIGINT AS positives FROM sp WHERE y = 1 OR gene NOT IN (SELECT gene FROM cat) GROUP BY 1, 2")
def clean_background(spark, d):
    return controls.clean_background(_splits(spark, d), _catalogue(spark, d)).groupBy("repeat", "fold").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"))


@query(with_(S_E1, S_DIR, S_DEG, S_SEED, _splits_sql(2), S_CAT) + " SELECT repeat, fold, count(*)::BIGINT AS negatives, count(cat.gene)::BIGINT AS listed, round(count(cat.gene)::DOUBLE / count(*), 8) AS frac FROM sp LEFT JOIN cat ON sp.gene = cat.gene WHERE y = 0 GROUP BY 1, 2")
def negative_contamination(spark, d):
    return controls.contamination(_splits(spark, d), _catalogue(spark, d)).withColumn("frac", F.round("frac", 8))


@query(with_(S_E1, S_DIR, S_DEG, S_SEED, S_CAT) + f", s AS (SELECT 'degree' AS method, deg.gene, degree::DOUBLE AS score, CASE WHEN cat.gene IS NULL THEN 0 ELSE 1 END AS y FROM deg LEFT JOIN cat ON deg.gene = cat.gene WHERE deg.gene NOT IN (SELECT gene FROM seeds)) SELECT method, round(auroc, 8) AS auroc FROM ({_auroc_sql('s', 'method')})")
def catalogue_arbitration(spark, d):
    scored = graph.degree(base.edges(spark, d)).select(F.lit("degree").alias("method"), "gene", F.col("degree").cast("double").alias("score"))
    return controls.arbitration(scored, _seeds(spark, d), _catalogue(spark, d), ["method"]).withColumn("auroc", F.round("auroc", 8))


@query(f"WITH {S_REP}, m AS (SELECT arm, gene, avg(score) AS v FROM r GROUP BY 1, 2) SELECT arm, count(*)::BIGINT AS members, round(avg(v), 8) AS mean, round(stddev_samp(v), 8) AS sd FROM m GROUP BY 1")
def provenance_means(spark, d):
    x = base.repeats(spark, d).withColumnRenamed("score", "value")
    return controls.class_means(x, "gene", "arm").select("arm", "members", R("mean", 8), R("sd", 8))


@query(f"WITH {S_M}, a AS (SELECT *, quantile_cont(score, 0.5) OVER (PARTITION BY arm, repeat) AS md FROM m), b AS (SELECT *, 1.4826 * quantile_cont(abs(score - md), 0.5) OVER (PARTITION BY arm, repeat) AS mad FROM a) SELECT arm, repeat, gene, round(CASE WHEN mad > 0 THEN (score - md) / mad END, 4) AS z FROM b")
def robust_z(spark, d):
    return controls.robust_z(_means(spark, d).withColumnRenamed("score", "value"), ["arm", "repeat"]).select("arm", "repeat", "gene", R("z", 4))


@query(f"WITH {S_REP}, o AS (SELECT arm, fold, avg(score) AS v FROM r WHERE repeat = 0 GROUP BY 1, 2), n AS (SELECT arm, fold, avg(score) AS m, stddev_samp(score) AS s FROM r WHERE repeat > 0 GROUP BY 1, 2), z AS (SELECT arm, (v - m) / s AS z FROM o JOIN n USING (arm, fold) WHERE s > 0) SELECT arm, count(*)::BIGINT AS units, round(avg(z), 6) AS mean_z, round(avg(z) * sqrt(count(*)), 6) AS joint_z FROM z GROUP BY 1")
def fine_z(spark, d):
    r = base.repeats(spark, d).withColumnRenamed("score", "value")
    return controls.fine_z(r.where("repeat = 0").groupBy("arm", "fold").agg(F.avg("value").alias("value")), r.where("repeat > 0"), ["arm"], "fold").select("arm", "units", R("mean_z"), R("joint_z"))


@query("SELECT round(regr_r2(l_extendedprice, l_quantity) / (1 - regr_r2(l_extendedprice, l_quantity)) * (count(*) - 2), 2) AS f FROM lineitem")
def nested_model_f(spark, d):
    return controls.nested_f(t(spark, d, "lineitem"), "l_extendedprice", [], ["l_quantity"]).select(R("f", 2))


@query("WITH v AS (SELECT l_returnflag || l_linestatus AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem), w AS (SELECT g, x - avg(x) OVER (PARTITION BY g) AS x, y - avg(y) OVER (PARTITION BY g) AS y FROM v), b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS s FROM w), u AS (SELECT g, sum(x * (y - b * x)) AS u, sum(x * y) AS c FROM w, b GROUP BY 1) SELECT round(any_value(b), 4) AS slope, round(sqrt(sum(u * u)) / any_value(s), 4) AS se, count(*) FILTER (sign(c) = sign(b))::BIGINT AS same_sign, count(*)::BIGINT AS groups FROM u, b")
def clustered_slope(spark, d):
    x = t(spark, d, "lineitem").withColumn("g", F.concat("l_returnflag", "l_linestatus"))
    return controls.within_slope(x, "l_extendedprice", "l_quantity", "g").select(R("slope", 4), R("se", 4), "same_sign", "groups")


@query("WITH v AS (SELECT p_type AS k, p_size AS x, p_retailprice AS y FROM part), w AS (SELECT k, x - avg(x) OVER z AS x, y - avg(y) OVER z AS y, count(*) OVER z AS n FROM v WINDOW z AS (PARTITION BY k)), s AS (SELECT *, sum(x * x) OVER (PARTITION BY k) AS sxx, sum(x * y) OVER (PARTITION BY k) AS sxy FROM w), e AS (SELECT k, y, y - sxy / sxx * x AS e, (y - sxy / sxx * x) / (1 - 1.0::DOUBLE / n - x * x / sxx) AS l FROM s) SELECT k AS arm, count(*)::BIGINT AS n, round(1 - sum(e * e) / sum(y * y), 8) AS r2, round(1 - sum(l * l) / sum(y * y), 8) AS loo_r2 FROM e GROUP BY 1")
def leave_one_out_r2(spark, d):
    p = t(spark, d, "part").select(F.col("p_type").alias("arm"), "p_size", "p_retailprice")
    return controls.leave_one_out_r2(p, ["arm"], "p_retailprice", "p_size").select("arm", "n", R("r2", 8), R("loo_r2", 8))


@query(f"WITH {S_M}, p AS (SELECT *, percent_rank() OVER (PARTITION BY arm, repeat ORDER BY score DESC, gene) AS pct FROM m), g AS (SELECT arm, gene, stddev_samp(pct) AS sd FROM p GROUP BY 1, 2) SELECT arm, count(*)::BIGINT AS genes, count(*) FILTER (sd < 0.2)::BIGINT AS stable, round(quantile_cont(sd, 0.25), 6) AS q25, round(quantile_cont(sd, 0.5), 6) AS q50, round(quantile_cont(sd, 0.75), 6) AS q75 FROM g GROUP BY 1")
def stability_atlas(spark, d):
    g = stability.rank_sd(_means(spark, d), ["arm"])
    return g.groupBy("arm").agg(F.count("*").alias("genes"), F.count_if(F.col("rank_sd") < 0.2).alias("stable"), *[F.round(F.percentile("rank_sd", F.lit(q / 100)), 6).alias(f"q{q}") for q in (25, 50, 75)])


@query(f"WITH {S_DOC}, md AS (SELECT source, quantile_cont(score, 0.5) AS m FROM s GROUP BY 1), c AS (SELECT l / 4.0::DOUBLE AS shrink, source, stddev_samp(score + l / 4.0::DOUBLE * (m - score)) AS sd FROM s JOIN md USING (source), range(5) z(l) GROUP BY 1, 2) SELECT source, shrink, round(sd, 6) AS sd, sd <= coalesce(lag(sd) OVER (PARTITION BY source ORDER BY shrink), sd) AS falls FROM c")
def shrinkage_tradeoff(spark, d):
    from pyspark.sql import Window

    x = base.doc_scores(spark, d)
    m = x.groupBy("source").agg(F.percentile("score", F.lit(0.5)).alias("m"))
    grid = x.join(m, "source").withColumn("shrink", F.explode(F.array(*[F.lit(i / 4) for i in range(5)])))
    c = grid.groupBy("source", "shrink").agg(F.stddev_samp(F.col("score") + F.col("shrink") * (F.col("m") - F.col("score"))).alias("sd"))
    before = F.lag("sd").over(Window.partitionBy("source").orderBy("shrink"))
    return c.withColumn("falls", F.col("sd") <= F.coalesce(before, F.col("sd"))).select("source", "shrink", R("sd"), "falls")


@query("SELECT 0::BIGINT AS only_a, 0::BIGINT AS only_b")
def splits_prefix(spark, d):
    """The first repeats of a longer panel are those of a shorter one."""
    u, s = t(spark, d, "part").select(F.col("p_partkey").alias("gene")), _seeds(spark, d).select("gene")
    return controls.same_rows(labels.stratified_splits(u, s, 4, 5).where("repeat < 2"), labels.stratified_splits(u, s, 2, 5))


@query("SELECT 'parts' AS quantity, count(*)::DOUBLE AS value FROM part UNION ALL SELECT 'price', round(sum(p_retailprice), 2) FROM part UNION ALL SELECT 'orders', count(DISTINCT o_custkey)::DOUBLE FROM orders")
def ground_truth(spark, d):
    return controls.facts(parts=(t(spark, d, "part"), "count(*)"), price=(t(spark, d, "part"), "round(sum(p_retailprice), 2)"), orders=(t(spark, d, "orders"), "count(distinct o_custkey)"))


@query()
def cap_search(spark, d):
    e, k = controls.cap_search(base.edges(spark, d), 10_000, 18)
    return e.withColumn("k", F.lit(k))


@query()
def label_participation(spark, d):
    p = t(spark, d, "part").select(*[F.col("p_type").contains(k).cast("double").alias(k.lower()) for k in ("ECONOMY", "PROMO", "SMALL")], (F.col("p_size") / 1.0).alias("size"), F.col("p_retailprice").alias("price"))
    return controls.participation(p, p.columns)


@query()
def coverage_simulation(spark, d):
    return controls.coverage_simulation(spark, 1000)


S_LINES = """sc AS (SELECT p_type AS arm, p_partkey AS gene, p_retailprice AS score, (p_size <= 5)::INTEGER AS y FROM part), ms AS (SELECT p_partkey AS gene FROM part WHERE p_size <= 45),
es AS (SELECT DISTINCT l_partkey AS gene, s_nationkey AS line FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 45), ce AS (SELECT arm, count(*) AS rows FROM sc GROUP BY 1),
pl AS (SELECT arm, gene, row_number() OVER (PARTITION BY arm ORDER BY score DESC, gene) AS place, count(*) OVER (PARTITION BY arm) AS size FROM sc WHERE y = 0), ks AS (SELECT unnest([0.2, 20.0])::DOUBLE AS k),
ro AS (SELECT arm, k, gene, place <= least(CASE WHEN k < 1 THEN ceil(k * rows) ELSE k END, size) AS cand FROM pl JOIN ce USING (arm) JOIN ms USING (gene), ks WHERE size - least(CASE WHEN k < 1 THEN ceil(k * rows) ELSE k END, size) >= 20),
wh AS (SELECT arm, k, count(*) FILTER (cand) AS candidates, count(*) AS population FROM ro GROUP BY 1, 2 HAVING count(*) FILTER (cand) >= 5 AND count(*) FILTER (NOT cand) >= 20),
hi AS (SELECT arm, k, line, count(*) FILTER (cand) AS hits, count(*) FILTER (NOT cand) AS hits_rest FROM ro JOIN es USING (gene) GROUP BY 1, 2, 3 HAVING count(*) FILTER (NOT cand) > 0), j AS (SELECT * FROM hi JOIN wh USING (arm, k)),
pp AS (SELECT arm, k, line, sum(CASE WHEN i >= hits AND i <= least(candidates, hits_rest) AND hits_rest - i <= population - candidates THEN exp(lgamma(candidates + 1) - lgamma(i + 1) - lgamma(candidates - i + 1) + lgamma(population - candidates + 1) - lgamma(hits_rest - i + 1) - lgamma(population - candidates - hits_rest + i + 1)
 - lgamma(population + 1) + lgamma(hits_rest + 1) + lgamma(population - hits_rest + 1)) ELSE 0 END) AS p FROM (SELECT *, unnest(range(0, least(candidates, hits_rest) + 1)) AS i FROM j) GROUP BY 1, 2, 3)"""


@query(f"WITH {S_LINES} SELECT j.arm, j.k, j.line, hits::BIGINT AS hits, hits_rest::BIGINT AS hits_rest, candidates::BIGINT AS candidates, population::BIGINT AS population, round(least(1.0, p), 6) AS p FROM j JOIN pp ON j.arm = pp.arm AND j.k = pp.k AND j.line = pp.line")
def line_enrichment(spark, d):
    """Are a type's dearest parts sold in large lots in a nation more often than its others?"""
    return _lines(spark, d).withColumn("p", F.round(F.least(F.lit(1.0), "p"), 6))


def _lines(spark, d):
    part = t(spark, d, "part").select(F.col("p_type").alias("arm"), F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("score"), (F.col("p_size") <= 5).cast("int").alias("y"), "p_size")
    sold = t(spark, d, "lineitem").where("l_quantity >= 45").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("gene"), F.col("s_nationkey").alias("line"))
    return controls.line_enrichment(part, sold, part.where("p_size <= 45"), ["arm"], (0.2, 20))


@query(f"WITH {S_LINES}, m AS (SELECT k, median(candidates) AS c, count(*)::BIGINT AS n_cells FROM (SELECT DISTINCT arm, k, candidates FROM j) GROUP BY 1) SELECT j.k, any_value(m.n_cells) AS n_cells, count(*)::BIGINT AS n_lines, round(avg((p < 0.05)::INTEGER), 6) AS below_05, round(avg((p < 0.01)::INTEGER), 6) AS below_01, round(median(p), 6) AS median_p, round(min(p), 6) AS least_p, any_value(m.c)::DOUBLE AS median_candidates FROM j JOIN pp ON j.arm = pp.arm AND j.k = pp.k AND j.line = pp.line JOIN m ON j.k = m.k GROUP BY 1")
def line_enrichment_summary(spark, d):
    r = lambda c: F.round(c, 6).alias(c)
    s = controls.enrichment_summary(_lines(spark, d), [], ["arm"])
    return s.select("k", "n_cells", "n_lines", r("below_05"), r("below_01"), r("median_p"), r("least_p"), "median_candidates")
