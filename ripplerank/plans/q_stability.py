"""Queries over stability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stability
from . import base
from .base import S_DOC, S_REP, query
from .q_graph import R
from .q_metrics import _means

S_M = f"{S_REP}, m AS (SELECT arm, repeat, gene, round(avg(score), 8) AS score FROM r GROUP BY 1, 2, 3)"


@query(f"WITH {S_DOC} SELECT source, gene, round(percent_rank() OVER (PARTITION BY source ORDER BY score DESC, gene), 10) AS pct FROM s")
def percentile_rank(spark, d):
    return stability.percentile_ranks(base.doc_scores(spark, d), ["source"]).select("source", "gene", R("pct", 10))


@query(f"WITH {S_REP} SELECT arm, gene, repeat, round(avg(score), 8) AS score FROM r GROUP BY 1, 2, 3")
def by_repeat(spark, d):
    return stability.by_repeat(base.repeats(spark, d), ["arm"]).withColumn("score", F.round("score", 8))


@query(f"WITH {S_M}, p AS (SELECT *, percent_rank() OVER (PARTITION BY arm, repeat ORDER BY score DESC, gene) AS pct FROM m) SELECT arm, gene, round(stddev_samp(pct), 8) AS rank_sd, round(stddev_samp(score) / greatest(abs(avg(score)), 1e-300), 8) AS score_cv FROM p GROUP BY 1, 2")
def rank_sd(spark, d):
    return stability.rank_sd(_means(spark, d), ["arm"]).select("arm", "gene", R("rank_sd", 8), R("score_cv", 8))


@query(f"WITH {S_DOC} SELECT source, round(1.06 * least(stddev_samp(score), (quantile_cont(score, 0.75) - quantile_cont(score, 0.25)) / 1.349) * pow(count(*), -0.2), 6) AS width FROM s GROUP BY 1")
def scott_bandwidth(spark, d):
    return stability.bandwidth(base.doc_scores(spark, d), ["source"]).withColumn("width", F.round("width", 6))


@query(f"WITH {S_DOC} SELECT source, gene, count(*) OVER (PARTITION BY source ORDER BY score RANGE BETWEEN 200 PRECEDING AND 200 FOLLOWING)::BIGINT AS crowd FROM s")
def crowding_range(spark, d):
    return stability.crowding(base.doc_scores(spark, d), ["source"], 200.0).select("source", "gene", "crowd")


@query(f"WITH {S_DOC} SELECT a.source, a.gene, count(*)::BIGINT AS crowd FROM s a JOIN s b ON a.source = b.source AND ln(b.score) BETWEEN ln(a.score) + ln(0.9::DOUBLE) AND ln(a.score) + ln(1.1::DOUBLE) GROUP BY 1, 2")
def crowding_relative(spark, d):
    return stability.relative_crowding(base.doc_scores(spark, d), ["source"]).select("source", "gene", "crowd")


S_KNN = "p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score, gene) AS q FROM s), n AS (SELECT a.source, a.gene, b.gene AS near, abs(a.score - b.score) AS distance, b.score AS bs, row_number() OVER (PARTITION BY a.source, a.gene ORDER BY abs(a.score - b.score), b.q) AS place FROM p a JOIN p b ON a.source = b.source AND a.gene <> b.gene)"


@query(f"WITH {S_DOC}, {S_KNN} SELECT source, gene, near, place::INTEGER AS place, distance FROM n WHERE place <= 3")
def knn_1d(spark, d):
    return stability.nearest(base.doc_scores(spark, d), ["source"], 3).select("source", "gene", "near", "place", "distance")


@query(f"WITH {S_DOC}, {S_KNN}, m AS (SELECT source, gene, quantile_cont(bs, 0.5) AS m FROM n WHERE place <= 3 GROUP BY 1, 2) SELECT s.source, s.gene, round(score + 0.5 * (m - score), 8) AS smoothed FROM s JOIN m ON s.source = m.source AND s.gene = m.gene")
def knn_smoothing(spark, d):
    return stability.smooth(base.doc_scores(spark, d), ["source"], 3).select("source", "gene", R("smoothed", 8))


@query(f"WITH {S_DOC}, m AS (SELECT source, quantile_cont(score, 0.5) AS m FROM s GROUP BY 1) SELECT source, gene, round(score + 0.5 * (m - score), 8) AS smoothed FROM s JOIN m USING (source)")
def global_median(spark, d):
    return stability.global_shrink(base.doc_scores(spark, d), ["source"]).select("source", "gene", R("smoothed", 8))


@query(f"WITH {S_DOC}, m AS (SELECT *, min(score) OVER (PARTITION BY source) AS lo, max(score) OVER (PARTITION BY source) AS hi FROM s) SELECT source, gene, round(CASE WHEN hi > lo THEN lo + (hi - lo) * pow((score - lo) / (hi - lo), 0.5) ELSE score END, 6) AS flat FROM m")
def monotone_flatten(spark, d):
    return stability.flatten(base.doc_scores(spark, d), ["source"]).select("source", "gene", R("flat"))


@query(f"WITH {S_M}, w AS (SELECT *, count(*) OVER v - 1 AS n, sum(score) OVER v - score AS s1, sum(score * score) OVER v - score * score AS s2 FROM m WINDOW v AS (PARTITION BY arm, gene)) SELECT arm, gene, repeat, round(CASE WHEN n >= 2 THEN 1 / (1 + greatest((s2 - s1 * s1 / n) / (n - 1), 0) / greatest((s1 / n) * (s1 / n), 1e-300)) ELSE 1.0 END::DOUBLE, 6) AS confidence FROM w")
def loro_confidence(spark, d):
    return stability.loro_confidence(_means(spark, d), ["arm"]).select("arm", "gene", "repeat", R("confidence"))


@query(f"WITH {S_DOC} SELECT source, gene, quantile_cont(score, 0.5) OVER (PARTITION BY source ORDER BY score DESC, gene ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS median FROM s")
def moving_median(spark, d):
    return stability.moving_median(base.doc_scores(spark, d), ["source"], 2).select("source", "gene", "median")


@query(f"WITH {S_M}, x AS (SELECT arm || '-' || repeat AS run, gene, score FROM m), p AS (SELECT *, 1 - percent_rank() OVER (PARTITION BY run ORDER BY score DESC, gene) AS good FROM x) SELECT gene, count(*)::BIGINT AS runs, round(avg(good), 8) AS mean_rank, round(quantile_cont(good, 0.5), 8) AS median_rank, round(sum(1 / (60 + (1 - good))), 8) AS rrf FROM p GROUP BY 1")
def consensus_mean_rank(spark, d):
    x = _means(spark, d).withColumn("run", F.concat_ws("-", "arm", F.col("repeat").cast("string")))
    return stability.consensus(x, "run").select("gene", "runs", *[R(c, 8) for c in ("mean_rank", "median_rank", "rrf")])


S_ST = "n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score, gene) AS r, count(*) OVER (PARTITION BY source) AS n FROM s)"


@query(f"WITH {S_DOC}, {S_ST} SELECT source, gene, CASE WHEN r <= floor(n / 3.0) THEN 'low' WHEN r <= floor(2 * n / 3.0) THEN 'mid' ELSE 'high' END AS stratum FROM n")
def tercile(spark, d):
    return stability.strata(base.doc_scores(spark, d), ["source"], "score").select("source", "gene", "stratum")


@query(f"WITH {S_DOC}, {S_ST} SELECT source, gene, greatest(ceil((r - 1) * 10.0::DOUBLE / greatest(n - 1, 1)) - 1, 0)::INTEGER AS decile FROM n")
def decile(spark, d):
    return stability.deciles(base.doc_scores(spark, d), ["source"], "score").select("source", "gene", "decile")


@query("WITH v AS (SELECT l_partkey AS gene, l_quantity AS value, l_extendedprice AS weight FROM lineitem), c AS (SELECT gene, value, sum(weight) AS weight FROM v GROUP BY 1, 2), w AS (SELECT *, sum(weight) OVER (PARTITION BY gene ORDER BY value) AS cum, sum(weight) OVER (PARTITION BY gene) AS tot FROM c) SELECT gene, min(value) FILTER (cum >= tot / 2) AS median FROM w GROUP BY 1")
def weighted_median(spark, d):
    from ..functions.columns import weighted_median as wm

    g = base.t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.collect_list(F.struct(F.col("l_quantity").alias("value"), F.col("l_extendedprice").alias("weight"))).alias("p"))
    return g.select("gene", wm(F.col("p")).alias("median"))


@query()
def random_neighbourhood(spark, d):
    return stability.random_neighbours(base.doc_scores(spark, d), ["source"], 3, 2)


@query()
def network_median(spark, d):
    s = base.t(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("score"), (1.0 / F.col("p_size")).alias("confidence"))
    return stability.network_median(s, base.edges(spark, d))
