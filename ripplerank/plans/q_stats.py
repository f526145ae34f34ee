"""Queries over statistics; p-values come from our own distribution functions, so SQL compares the statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, stats
from . import base
from .base import S_DOC, S_REP, query, su, t
from .q_graph import R, _auroc_sql

S_U = f"{S_REP}, u AS (SELECT arm, repeat, avg(score) AS value FROM r GROUP BY 1, 2)"


def _units(spark, d):
    return stats.unit_values(base.repeats(spark, d), ["arm"], "repeat", "score")


@query(f"WITH {S_U} SELECT arm, count(*)::BIGINT AS n, round(avg(value), 8) AS mean, round(stddev_samp(value), 8) AS sd, round(stddev_samp(value) / sqrt(count(*)), 8) AS se FROM u GROUP BY 1")
def unit_summary(spark, d):
    return stats.summary(_units(spark, d), ["arm"]).select("arm", "n", *[R(c, 8) for c in ("mean", "sd", "se")])


@query(f"WITH {S_U} SELECT arm, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round((avg(value) + 1) / (stddev_samp(value) / sqrt(count(*))), 4) AS t_low, round((avg(value) - 1) / (stddev_samp(value) / sqrt(count(*))), 4) AS t_high FROM u GROUP BY 1")
def tost_statistics(spark, d):
    return stats.tost(_units(spark, d), ["arm"], 1.0).select("arm", "n", R("mean"), R("t_low", 4), R("t_high", 4))


@query()
def t_interval(spark, d):
    return stats.t_interval(_units(spark, d), ["arm"])


_DRAW = su("_i", "'boot|' || rep")


@query(f"""WITH {S_U}, n AS (SELECT arm, round(value, 8) AS value, row_number() OVER (PARTITION BY arm ORDER BY repeat, value) - 1 AS _i, count(*) OVER (PARTITION BY arm) AS k FROM u),
g AS (SELECT arm, k, rep, floor({_DRAW} * k) AS at FROM n, range(1000) z(rep)), b AS (SELECT g.arm, g.rep, avg(n.value) AS value FROM g JOIN n ON n.arm = g.arm AND n._i = g.at GROUP BY 1, 2)
SELECT arm, round(quantile_cont(value, 0.025), 5) AS low, round(quantile_cont(value, 0.975), 5) AS high FROM b GROUP BY 1""")
def bootstrap_ci(spark, d):
    return stats.percentile_interval(_units(spark, d).withColumn("value", F.round("value", 8)), ["arm"], 1000).select("arm", R("low", 5), R("high", 5))


@query()
def bca_interval(spark, d):
    return stats.bca_interval(_units(spark, d).withColumn("value", F.round("value", 8)), ["arm"], 1000)


@query("WITH p AS (SELECT p_brand AS arm, p_partkey AS id, round((p_retailprice - 900) / 1200.0::DOUBLE, 8) AS p FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY p, id) AS r, count(*) OVER (PARTITION BY arm) AS n FROM p) SELECT arm, id, p, round(least(1.0, min(p * n / r) OVER (PARTITION BY arm ORDER BY r DESC))::DOUBLE, 8) AS q, least(1.0, min(p * n / r) OVER (PARTITION BY arm ORDER BY r DESC)) < 0.05 AS reject FROM k")
def bh_fdr(spark, d):
    p = t(spark, d, "part").select(F.col("p_brand").alias("arm"), F.col("p_partkey").alias("id"), F.round((F.col("p_retailprice") - 900) / 1200.0, 8).alias("p"))
    return stats.bh(p, ["arm"]).select("arm", "id", "p", R("q", 8), "reject")


@query(f"""WITH {S_U}, a AS (SELECT arm, avg(value) AS mean, stddev_samp(value) / sqrt(count(*)) AS se FROM u GROUP BY 1), w AS (SELECT mean, se, 1 / (se * se) AS w FROM a),
s AS (SELECT count(*) AS k, sum(w) AS sw, sum(w * w) AS sww, sum(w * mean) AS swm, sum(w * mean * mean) AS swmm FROM w), q AS (SELECT *, swmm - swm * swm / sw AS q FROM s), t AS (SELECT *, greatest(0, (q - (k - 1)) / (sw - sww / sw)) AS tau2 FROM q)
SELECT k::BIGINT AS k, round(any_value(swm / sw), 6) AS fixed, round(any_value(sqrt(1 / sw)), 6) AS fixed_se, round(any_value(q), 4) AS q_stat, round(any_value(tau2), 6) AS tau2, round(sum(mean / (se * se + tau2)) / sum(1 / (se * se + tau2)), 6) AS random, round(sqrt(1 / sum(1 / (se * se + tau2))), 6) AS random_se FROM t, w GROUP BY k""")
def meta_analysis(spark, d):
    return stats.meta(stats.summary(_units(spark, d), ["arm"]).select("mean", "se"), []).select("k", R("fixed"), R("fixed_se"), R("q_stat", 4), R("tau2"), R("random"), R("random_se"))


@query("""WITH v AS (SELECT p_type AS a, p_brand AS b, p_retailprice AS x FROM part), g AS (SELECT *, avg(x) OVER () AS m, avg(x) OVER (PARTITION BY a) AS ma, avg(x) OVER (PARTITION BY b) AS mb, avg(x) OVER (PARTITION BY a, b) AS mab FROM v),
s AS (SELECT sum((ma - m) * (ma - m)) AS ss_a, sum((mb - m) * (mb - m)) AS ss_b, sum((mab - ma - mb + m) * (mab - ma - mb + m)) AS ss_ab, sum((x - mab) * (x - mab)) AS ss_w FROM g)
SELECT round(ss_a, 2) AS ss_a, round(ss_b, 2) AS ss_b, round(ss_ab, 2) AS ss_ab, round(ss_w, 2) AS ss_within, round(ss_a / (ss_a + ss_b + ss_ab + ss_w), 8) AS share_a, round(ss_w / (ss_a + ss_b + ss_ab + ss_w), 8) AS share_within, round(ss_a / (na - 1) / (ss_w / (n - na * nb)), 6) AS f_a, round(ss_b / (nb - 1) / (ss_w / (n - na * nb)), 6) AS f_b FROM s, (SELECT count(*) AS n, count(DISTINCT a) AS na, count(DISTINCT b) AS nb FROM v)""")
def anova_components(spark, d):
    v = t(spark, d, "part").select(F.col("p_type").alias("a"), F.col("p_brand").alias("b"), F.col("p_retailprice").alias("value"))
    return stats.anova(v, "a", "b").select(*[R(c, 2) for c in ("ss_a", "ss_b", "ss_ab", "ss_within")], R("share_a", 8), R("share_within", 8), R("f_a"), R("f_b"))


@query(f"WITH {S_REP}, g AS (SELECT arm, repeat, count(*) AS n, avg(score) AS m, var_pop(score) AS v FROM r GROUP BY 1, 2), s AS (SELECT arm, count(*) AS k, sum(n) AS n, sum(n * v) AS ssw, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS ssb FROM g GROUP BY 1), z AS (SELECT arm, ssb / (k - 1) AS msb, ssw / (n - k) AS msw, n / k::DOUBLE AS size FROM s) SELECT arm, round(msb, 5) AS msb, round(msw, 5) AS msw, round((msb - msw) / (msb + (size - 1) * msw), 6) AS icc, round(1 + (size - 1) * (msb - msw) / (msb + (size - 1) * msw), 6) AS design_effect FROM z")
def icc(spark, d):
    return stats.icc(base.repeats(spark, d).withColumnRenamed("score", "value"), ["arm"], "repeat").select("arm", R("msb", 5), R("msw", 5), R("icc"), R("design_effect"))


@query(f"WITH {S_DOC}, k AS (SELECT *, rank() OVER (PARTITION BY y ORDER BY score) + (count(*) OVER (PARTITION BY y, score) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY y ORDER BY gene % 50) + (count(*) OVER (PARTITION BY y, gene % 50) - 1) / 2.0::DOUBLE AS b FROM s) SELECT y, count(*)::BIGINT AS n, round(corr(a, b), 8) AS rho, round(corr(score, gene % 50), 8) AS pearson FROM k GROUP BY 1")
def spearman(spark, d):
    return stats.spearman(base.doc_scores(spark, d).withColumn("other", F.col("gene") % 50), ["y"], "score", "other").select("y", "n", R("rho", 8), R("pearson", 8))


@query("WITH v AS (SELECT p_type AS g, p_size AS x FROM part), r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS r FROM v), s AS (SELECT g, count(*) AS n, sum(r) AS s FROM r GROUP BY 1), ti AS (SELECT sum(pow(c, 3) - c) AS t FROM (SELECT count(*) AS c FROM v GROUP BY x)), q AS (SELECT sum(n)::DOUBLE AS n, count(*)::BIGINT AS groups, sum(s * s / n) AS q FROM s) SELECT n::BIGINT AS n, groups, round((12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (pow(n, 3) - n)), 6) AS h, round(((12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (pow(n, 3) - n)) - groups + 1) / (n - groups), 8) AS eta2 FROM q, ti")
def kruskal(spark, d):
    return stats.kruskal(t(spark, d, "part").select(F.col("p_type").alias("g"), F.col("p_size").alias("value")), "g").select("n", "groups", R("h"), R("eta2", 8))


@query("""WITH a AS (SELECT count(*)::DOUBLE AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS c, regr_r2(l_extendedprice, l_quantity) AS r2, regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, avg(l_quantity) AS mx FROM lineitem),
e AS (SELECT *, sqrt(syy * (1 - r2) / (n - 2) / sxx) AS sb, sqrt(syy * (1 - r2) / (n - 2) * (1 / n + mx * mx / sxx)) AS sc FROM a),
z AS (SELECT 'intercept' AS term, c AS coef, sc AS se, r2, n FROM e UNION ALL SELECT 'l_quantity', b, sb, r2, n FROM e) SELECT term, round(coef, 4) AS coef, round(se, 4) AS se, round(coef / se, 3) AS t, round(coef * coef / (se * se) / (coef * coef / (se * se) + n - 2), 6) AS partial_r2, round(r2, 8) AS r2 FROM z""")
def ols_size(spark, d):
    return stats.ols(t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"]).select("term", R("coef", 4), R("se", 4), R("t", 3), R("partial_r2"), R("r2", 8))


@query("WITH o AS (SELECT p_brand AS arm, avg(p_retailprice) AS value FROM part WHERE p_size <= 10 GROUP BY 1), n AS (SELECT p_brand AS arm, p_retailprice AS value FROM part WHERE p_size > 10) SELECT o.arm, round(any_value(o.value), 6) AS observed, round(avg(n.value), 6) AS null_mean, round(quantile_cont(n.value, 0.95), 6) AS q95, round((any_value(o.value) - avg(n.value)) / stddev_samp(n.value), 6) AS z FROM o JOIN n ON o.arm = n.arm GROUP BY 1")
def null_z(spark, d):
    p = t(spark, d, "part").select(F.col("p_brand").alias("arm"), F.col("p_retailprice").alias("value"), "p_size")
    return stats.null_z(p.where("p_size <= 10").groupBy("arm").agg(F.avg("value").alias("value")), p.where("p_size > 10"), ["arm"]).select("arm", R("observed"), R("null_mean"), R("q95"), R("z"))


@query(f"WITH {S_DOC}, b AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS _i, count(*) OVER () AS n FROM (SELECT DISTINCT gene FROM s)), w AS (SELECT rep, floor({su('_i', chr(39) + 'genes|' + chr(39) + ' || rep')} * n) AS at FROM b, range(10) z(rep)), m AS (SELECT rep, gene, count(*)::DOUBLE AS w FROM w JOIN b ON w.at = b._i GROUP BY 1, 2), x AS (SELECT rep::INTEGER AS rep, score, y, w FROM s JOIN m USING (gene)) SELECT a.rep, round(sum(a.w * b.w * CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE / sum(a.w * b.w), 8) AS auroc FROM x a JOIN x b ON a.rep = b.rep AND a.y = 1 AND b.y = 0 GROUP BY 1")
def gene_bootstrap(spark, d):
    x = base.doc_scores(spark, d).select(F.lit("all").alias("arm"), "gene", "score", "y")
    return stats.gene_bootstrap(x, ["arm"], 10).select("rep", R("auroc", 8))


@query(f"""WITH {S_DOC}, sc AS (SELECT source, gene, y, 'rwr' AS method, score FROM s UNION ALL SELECT source, gene, y, 'degree', (gene % 97)::DOUBLE FROM s),
b AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS _i, count(*) OVER () AS n FROM (SELECT DISTINCT gene FROM s)), w AS (SELECT rep, floor({su('_i', chr(39) + 'genes|' + chr(39) + ' || rep')} * n) AS at FROM b, range(300) z(rep)),
m AS (SELECT rep, gene, count(*)::DOUBLE AS w FROM w JOIN b ON w.at = b._i GROUP BY 1, 2 UNION ALL SELECT -1, gene, 1 FROM b),
g AS (SELECT rep, source, method, score, sum(w * y) AS p, sum(w * (1 - y)) AS n FROM sc JOIN m USING (gene) GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY rep, source, method ORDER BY score) - n AS below FROM g),
a AS (SELECT rep, source, method, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * (below + n / 2)) / (sum(p) * sum(n)) END AS auroc FROM c GROUP BY ALL),
d AS (SELECT rep, source, max(auroc) FILTER (method = 'rwr') - max(auroc) FILTER (method = 'degree') AS delta FROM a GROUP BY ALL), r AS (SELECT rep, avg(delta) AS value FROM d WHERE rep >= 0 AND delta IS NOT NULL GROUP BY 1), o AS (SELECT * FROM d WHERE rep = -1 AND delta IS NOT NULL)
SELECT round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, round(avg(value), 6) AS boot_mean, round((SELECT avg(delta) FROM o), 6) AS observed_mean, (SELECT count(*) FROM o)::BIGINT AS n_cells, count(*)::BIGINT AS n_boot FROM r""")
def gene_interval(spark, d):
    """The interval over documents of the difference between two scores of their quality, over sources."""
    s = base.doc_scores(spark, d)
    both = s.withColumn("method", F.lit("rwr")).unionByName(s.withColumns({"method": F.lit("degree"), "score": (F.col("gene") % 97).cast("double")}))
    return stats.gene_interval(both, [], ["source"], 300).select(R("low"), R("high"), R("boot_mean"), R("observed_mean"), "n_cells", "n_boot")


@query()
def permutation_p(spark, d):
    return stats.permutation(base.doc_scores(spark, d).withColumn("other", F.col("y").cast("double")), "score", "other", "gene", 10_000)


@query("WITH top AS (SELECT p_partkey AS gene FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100), l AS (SELECT DISTINCT s_nationkey AS line, l_partkey AS gene FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), c AS (SELECT line, count(*) FILTER (gene IN (SELECT gene FROM top))::BIGINT AS hits, (SELECT count(*) FROM part)::BIGINT AS population, count(*)::BIGINT AS good, 100::BIGINT AS draws FROM l GROUP BY 1), lc AS (SELECT line, sum(exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + lgamma(population - good + 1) - lgamma(draws - i + 1) - lgamma(population - good - draws + i + 1) - lgamma(population + 1) + lgamma(draws + 1) + lgamma(population - draws + 1))) AS p FROM c, range(0, 101) r(i) WHERE i >= hits AND i <= good AND draws - i <= population - good GROUP BY 1) SELECT c.*, round(least(1.0, p), 6) AS p FROM c JOIN lc USING (line)")
def hypergeom(spark, d):
    top = t(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(100).select(F.col("p_partkey").alias("gene"), F.lit(1).alias("top"))
    lines = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("line"), F.col("l_partkey").alias("gene")).distinct()
    n = t(spark, d, "part").agg(F.count("*").alias("population"))
    counts = lines.join(F.broadcast(top), "gene", "left").groupBy("line").agg(F.count("top").alias("hits"), F.count("*").alias("good")).crossJoin(n)
    return stats.hypergeometric(counts.withColumn("draws", F.lit(100).cast("long"))).select("line", "hits", "population", "good", "draws", R("p"))


@query(f"WITH {S_REP} SELECT arm, repeat, fold, round(auroc, 8) AS auroc FROM ({_auroc_sql('(SELECT *, CASE WHEN gene < ' + chr(39) + 'Brand#3' + chr(39) + ' THEN 1 ELSE 0 END AS y FROM r)', 'arm, repeat, fold')})")
def subset_auroc(spark, d):
    x = base.repeats(spark, d).withColumn("y", (F.col("gene") < "Brand#3").cast("int"))
    return metrics.auroc(x, ["arm", "repeat", "fold"]).withColumn("auroc", F.round("auroc", 8))
