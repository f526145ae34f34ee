"""Queries over ranking metrics, on documents' lengths against their quality labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from . import base
from .base import S_DOC, S_REP, query
from .q_graph import R, _auroc_sql


@query(f"WITH {S_DOC} SELECT source, round(auroc, 8) AS auroc FROM ({_auroc_sql('s', 'source')})")
def auroc_doc_quality(spark, d):
    return metrics.auroc(base.doc_scores(spark, d), ["source"]).withColumn("auroc", F.round("auroc", 8))


@query(f"WITH {S_DOC}, g AS (SELECT source, score, sum(y) AS p, count(*) AS n FROM s GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w / (sum(n) OVER w)::DOUBLE AS pr FROM g WINDOW w AS (PARTITION BY source ORDER BY score DESC)) SELECT source, round(CASE WHEN sum(p) > 0 THEN sum(p * pr) / sum(p) END, 8) AS auprc FROM c GROUP BY 1")
def auprc_doc_quality(spark, d):
    return metrics.auprc(base.doc_scores(spark, d), ["source"]).withColumn("auprc", F.round("auprc", 8))


S_RANK = "k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, gene) AS r, count(*) OVER (PARTITION BY source) AS n FROM s)"


@query(f"WITH {S_DOC}, {S_RANK} SELECT source, " + ", ".join(f"CASE WHEN max(n) >= {k} THEN sum(CASE WHEN r <= {k} THEN y ELSE 0 END) / {k}.0::DOUBLE END AS p_at_{k}" for k in (5, 20, 500)) + " FROM k GROUP BY 1")
def precision_at_k(spark, d):
    return metrics.precision_at(base.doc_scores(spark, d), ["source"], (5, 20, 500))


@query(f"WITH {S_DOC}, {S_RANK} SELECT source, round(avg(y), 8) AS p_top FROM k WHERE r <= ceil(0.1::DOUBLE * n) GROUP BY 1")
def p_top10pct(spark, d):
    return metrics.precision_top(base.doc_scores(spark, d), ["source"]).withColumn("p_top", F.round("p_top", 8))


S_ROC = "g AS (SELECT source, score, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM s GROUP BY 1, 2), roc AS (SELECT source, score, sum(n) OVER w / nullif(sum(n) OVER (PARTITION BY source), 0) AS fpr, sum(p) OVER w / nullif(sum(p) OVER (PARTITION BY source), 0) AS tpr FROM g WINDOW w AS (PARTITION BY source ORDER BY score DESC))"


@query(f"WITH s AS (SELECT lang AS source, doc_id AS gene, n_chars::DOUBLE AS score, quality AS y FROM documents JOIN labels USING (doc_id)), {S_ROC} SELECT source, score, round(fpr, 8) AS fpr, round(tpr, 8) AS tpr FROM roc")
def roc_points(spark, d):
    x = base.t(spark, d, "documents").join(base.t(spark, d, "labels"), "doc_id").select(F.col("lang").alias("source"), F.col("doc_id").alias("gene"), F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("y"))
    return metrics.roc_points(x, ["source"]).select("source", "score", R("fpr", 8), R("tpr", 8))


@query(f"WITH s AS (SELECT 'all' AS source, doc_id AS gene, n_chars::DOUBLE AS score, quality AS y FROM documents JOIN labels USING (doc_id)), {S_ROC}, l AS (SELECT *, coalesce(lag(fpr) OVER w, 0) AS x0, coalesce(lag(tpr) OVER w, 0) AS y0 FROM roc WINDOW w AS (PARTITION BY source ORDER BY score DESC)) SELECT source, round(sum(CASE WHEN x0 < 0.2 THEN (least(fpr, 0.2) - x0) * (y0 + CASE WHEN fpr > x0 THEN y0 + (tpr - y0) * (least(fpr, 0.2) - x0) / (fpr - x0) ELSE tpr END) / 2 ELSE 0 END)::DOUBLE, 8) AS pauc, round(sum(CASE WHEN x0 < 0.2 THEN (least(fpr, 0.2) - x0) * (y0 + CASE WHEN fpr > x0 THEN y0 + (tpr - y0) * (least(fpr, 0.2) - x0) / (fpr - x0) ELSE tpr END) / 2 ELSE 0 END)::DOUBLE / 0.2, 7) AS pauc_norm FROM l GROUP BY 1")
def pauc(spark, d):
    return metrics.partial_auc(base.doc_scores(spark, d).withColumn("source", F.lit("all")), ["source"], 0.2).select("source", R("pauc", 8), R("pauc_norm", 7))


@query(f"WITH {S_DOC}, {S_RANK} SELECT source, round(quantile_cont(r, 0.5) / max(n), 8) AS medrr FROM k WHERE y = 1 GROUP BY 1")
def medrr(spark, d):
    return metrics.median_rank(base.doc_scores(spark, d), ["source"]).withColumn("medrr", F.round("medrr", 8))


@query("WITH s AS (SELECT lang AS source, n_chars::DOUBLE AS score, quality AS y, (doc_id % 3)::DOUBLE AS w FROM documents JOIN labels USING (doc_id)) SELECT a.source, round(sum(a.w * b.w * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE / sum(a.w * b.w), 8) AS auroc FROM s a JOIN s b ON a.source = b.source AND a.y = 1 AND b.y = 0 GROUP BY 1")
def weighted_auroc(spark, d):
    x = base.t(spark, d, "documents").join(base.t(spark, d, "labels"), "doc_id").select(F.col("lang").alias("source"), F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("y"), (F.col("doc_id") % 3).cast("double").alias("w"))
    return metrics.auroc(x, ["source"], "w").where("auroc is not null").withColumn("auroc", F.round("auroc", 8))


@query(f"WITH {S_REP}, k AS (SELECT arm, repeat, gene, row_number() OVER (PARTITION BY arm, repeat ORDER BY avg(score) DESC, gene) AS rk FROM (SELECT arm, repeat, gene, round(avg(score), 8) AS score FROM r GROUP BY 1, 2, 3) GROUP BY arm, repeat, gene), tp AS (SELECT * FROM k WHERE rk <= 8) SELECT a.arm, a.repeat AS run_a, b.repeat AS run_b, round(count(*)::DOUBLE / (16.0 - count(*)), 8) AS jaccard FROM tp a JOIN tp b ON a.arm = b.arm AND a.gene = b.gene AND a.repeat < b.repeat GROUP BY 1, 2, 3")
def topk_jaccard(spark, d):
    return metrics.top_overlap(_means(spark, d), ["arm"], "repeat", 8).withColumn("jaccard", F.round("jaccard", 8))


def _means(spark, d):
    return base.repeats(spark, d).groupBy("arm", "repeat", "gene").agg(F.round(F.avg("score"), 8).alias("score"))


@query(f"WITH {S_REP}, m AS (SELECT arm, repeat, gene, round(avg(score), 8) AS score FROM r GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY arm, repeat ORDER BY score DESC, gene) AS rk FROM m) SELECT arm, gene, count(*)::BIGINT AS runs FROM k WHERE rk <= 8 GROUP BY 1, 2 HAVING count(*) > (SELECT count(DISTINCT repeat) FROM m z WHERE z.arm = k.arm) / 2.0")
def persistence(spark, d):
    return metrics.persistence(_means(spark, d), ["arm"], "repeat", 8)


@query("WITH z AS (SELECT p_brand AS label, avg(p_retailprice) FILTER (p_type LIKE '%ECONOMY%') AS a, avg(p_retailprice) FILTER (p_type LIKE '%PROMO%') AS b FROM part GROUP BY 1) SELECT label, round(a - b, 6) AS delta_price, round(a, 6) AS eco_price, round(b, 6) AS promo_price FROM z")
def margin_table(spark, d):
    p = base.t(spark, d, "part").where("p_type like '%ECONOMY%' or p_type like '%PROMO%'").groupBy(F.col("p_brand").alias("label"), F.when(F.col("p_type").contains("ECONOMY"), "eco").otherwise("promo").alias("method")).agg(F.avg("p_retailprice").alias("price"))
    all_ = base.t(spark, d, "part").select(F.col("p_brand").alias("label")).distinct()
    return all_.join(metrics.margins(p, ["label"], ["price"], "eco", "promo"), "label", "left").select("label", R("delta_price"), R("eco_price"), R("promo_price"))
