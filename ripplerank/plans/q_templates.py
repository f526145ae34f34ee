"""Queries over catalogue builders, control templates and the layers above single statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arms, catalogues, controls, graph, labels, metrics, stability, stats, templates
from ..sources import scans
from ..sources.shared import cut
from . import base
from .base import S_DEG, S_DIR, S_DOC, S_E1, S_REP, query, su, t, with_
from .q_graph import S_SEED, R, _auroc_sql, _seeds
from .q_labels import S_IDS, _ids
from .q_metrics import _means
from .q_stability import S_M

# --- catalogues

S_EV = "ev AS (SELECT p_brand || ' ' || p_type AS sym, n_name AS nation, n_nationkey AS nk, p_size, p_partkey AS pk, l_returnflag AS src, l_quantity AS q, l_discount AS dc FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"


def _evidence(spark, d):
    """Lines as pieces of evidence: part names as symbols, supplier nations as diseases, return flags as sources."""
    x = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return x.select(F.concat_ws(" ", "p_brand", "p_type").alias("sym"), F.col("n_name").alias("nation"), F.col("n_nationkey").alias("nk"), "p_size", F.col("p_partkey").alias("pk"), F.col("l_returnflag").alias("src"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("dc"))


@query(f"WITH {S_EV}, {S_IDS}, s AS (SELECT symbol AS gene, count(DISTINCT nation) AS n FROM ev JOIN mp ON mp.key = upper(sym) WHERE q >= 30 OR p_size < 20 GROUP BY 1) SELECT gene, row_number() OVER (ORDER BY n DESC, gene)::INTEGER AS rank, 'intogen' AS source, '2024' AS release FROM s")
def catalogue_drivers(spark, d):
    rows = _evidence(spark, d).where("q >= 30 or p_size < 20").select(F.col("sym").alias("SYMBOL"), F.col("nation").alias("CANCER_TYPE"))
    return catalogues.drivers(rows, labels.symbol_map(_ids(spark, d)), "2024")


@query("WITH b AS (SELECT p_brand AS id, list(DISTINCT p_type) FILTER (p_size > 48) AS areas, list(DISTINCT p_type) FILTER (p_size < 3) AS above FROM part GROUP BY 1) SELECT id FROM b WHERE coalesce(list_contains(areas, 'PROMO BRUSHED'), false) OR coalesce(list_contains(above, 'PROMO BRUSHED'), false) OR EXISTS (SELECT 1 FROM part p WHERE p.p_brand = b.id AND p.p_type LIKE 'PROMO%' AND (p_size > 48 OR p_size < 3))")
def catalogue_areas(spark, d):
    kind = F.when(F.col("p_type").startswith("PROMO"), "PROMO").otherwise(F.col("p_type"))
    pick = lambda c: F.nullif(F.collect_set(F.when(c, kind)), F.array().cast("array<string>"))
    b = t(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(pick(F.col("p_size") > 48).alias("therapeuticAreas"), pick(F.col("p_size") < 3).alias("ancestors"))
    return catalogues.cancer_ids(b, "PROMO")


@query(f"WITH {S_EV}, {S_IDS}, w AS (SELECT symbol AS gene, CASE WHEN p_size <= 10 THEN 1.0 WHEN p_size <= 20 THEN 1.0 WHEN p_size <= 30 THEN 0.5 ELSE 0 END::DOUBLE AS w FROM ev JOIN mp ON mp.key = upper(sym) WHERE nk < 10), s AS (SELECT gene, sum(w) AS score FROM w WHERE w > 0 GROUP BY 1) SELECT gene, row_number() OVER (ORDER BY score DESC, gene)::INTEGER AS rank, 'clingen_cancer_validity' AS source, 'v1' AS release FROM s")
def catalogue_validity(spark, d):
    size = F.col("p_size")
    kind = F.when(size <= 10, "Definitive").when(size <= 20, "Strong").when(size <= 30, "Moderate").when(size <= 40, "Limited").otherwise("Unheard of")
    rows = _evidence(spark, d).select(F.col("sym").alias("symbol"), F.concat(F.lit("MONDO:"), F.col("nk").cast("string")).alias("disease"), kind.alias("classification"))
    cancers = t(spark, d, "nation").where("n_nationkey < 10").select(F.concat(F.lit("MONDO_"), F.col("n_nationkey").cast("string")).alias("id"))
    return catalogues.validity(rows, cancers, labels.symbol_map(_ids(spark, d)), "v1")


def _associations(spark, d, without=None):
    e = _evidence(spark, d).select(F.col("pk").cast("string").alias("targetId"), F.col("nk").cast("string").alias("diseaseId"), F.col("src").alias("datasourceId"), (F.col("q") / 50).alias("score"))
    scores = e.groupBy("targetId", "diseaseId", "datasourceId").agg(F.max("score").alias("score"))
    targets = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("symbol"))
    cancers = t(spark, d, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").cast("string").alias("id"))
    return catalogues.association_labels(scores, targets, cancers, 200, "v1", without)


S_ASSOC = f"{S_EV}, sc AS (SELECT pk, nk, src, max(q / 50) AS score FROM ev WHERE nk < 10 GROUP BY 1, 2, 3), tg AS (SELECT p_partkey AS pk, p_brand || '-' || p_partkey AS gene FROM part)"


@query(f"WITH {S_ASSOC}, s AS (SELECT gene, max(score) AS score FROM sc JOIN tg USING (pk) GROUP BY 1) SELECT gene, row_number() OVER (ORDER BY score DESC, gene)::INTEGER AS rank, 'associations' AS source, 'v1' AS release FROM s QUALIFY rank <= 200")
def catalogue_associations(spark, d):
    return _associations(spark, d)


@query(f"WITH {S_ASSOC}, o AS (SELECT gene, nk, score, row_number() OVER (PARTITION BY gene, nk ORDER BY score DESC) AS i, count(*) OVER (PARTITION BY gene, nk) AS n FROM sc JOIN tg USING (pk) WHERE src <> 'N'), h AS (SELECT gene, nk, CASE WHEN any_value(n) = 1 THEN max(score) ELSE sum(score / (i * i)) / (pi() * pi() / 6) END AS score FROM o GROUP BY 1, 2), s AS (SELECT gene, max(score) AS score FROM h GROUP BY 1) SELECT gene, row_number() OVER (ORDER BY score DESC, gene)::INTEGER AS rank, 'associations' AS source, 'v1' AS release FROM s QUALIFY rank <= 200")
def catalogue_without_source(spark, d):
    return _associations(spark, d, "N")


@query(f"WITH {S_EV}, g AS (SELECT pk AS gene, list_sort(list(DISTINCT src)) AS sources FROM ev WHERE q >= 45 GROUP BY 1) SELECT gene, CASE WHEN NOT list_contains(sources, 'A') AND NOT list_contains(sources, 'R') THEN 'only_weak' WHEN list_contains(sources, 'A') AND list_contains(sources, 'R') THEN 'strong' ELSE 'mixed' END AS tier, array_to_string(sources, ';') AS sources FROM g")
def source_tiers(spark, d):
    rows = _evidence(spark, d).where("q >= 45").select(F.col("pk").alias("gene"), F.col("src").alias("source"))
    return catalogues.evidence_tiers(rows, ["A", "R"]).withColumn("sources", F.array_join("sources", ";"))


@query("SELECT p_partkey AS gene, CASE WHEN p_retailprice >= 1000 THEN 'gold' WHEN p_retailprice >= 950 THEN 'silver' ELSE 'rest' END AS tier FROM part")
def star_tiers(spark, d):
    return catalogues.star_tiers(t(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("value")), {"gold": 1000.0, "silver": 950.0})


@query("WITH p AS (SELECT p_partkey, p_brand AS symbol, p_name, p_type FROM part) SELECT p_partkey AS id, symbol, u.w AS prev_symbol, v.w AS alias_symbol FROM p, unnest(string_split(p_name, ' ')) u(w), unnest(string_split(p_type, ' ')) v(w)")
def explode_map(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("symbol"), F.replace("p_name", F.lit(" "), F.lit("|")).alias("prev_symbol"), F.replace("p_type", F.lit(" "), F.lit("|")).alias("alias_symbol"))
    return catalogues.explode_map(p, ("prev_symbol", "alias_symbol"))


@query("SELECT p_partkey AS gene, (p_name IN (SELECT p_name FROM part WHERE p_size <= 5)) AS approved FROM part")
def is_approved(spark, d):
    p = t(spark, d, "part")
    return catalogues.is_approved(p, "p_name", p.where("p_size <= 5").select(F.col("p_name").alias("symbol"))).select(F.col("p_partkey").alias("gene"), "approved")


@query("WITH m AS (SELECT DISTINCT l_suppkey AS complex_id, l_partkey AS pk FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 40) SELECT complex_id, p_brand || '_' || (p_partkey // 2) AS gene, 'P' || pk AS uniprot, 'supply' AS source, (count(*) OVER (PARTITION BY complex_id))::INTEGER AS n_members FROM m JOIN part ON pk = p_partkey")
def complex_map(spark, d):
    rows = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("complex_id")).agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit("-1")))), "; ").alias("members"))
    by = t(spark, d, "part").where("p_size <= 40").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("uniprot"), F.concat_ws("_", "p_brand", F.floor(F.col("p_partkey") / 2).cast("string")).alias("gene"))  # two accessions of a brand and pair of keys name one gene
    return catalogues.complex_map(rows, by, "supply")


@query("SELECT l_orderkey, l_linenumber, l_partkey, greatest(l_discount, l_tax) AS best, CASE WHEN l_discount >= l_tax THEN 'l_discount' ELSE 'l_tax' END AS channel FROM lineitem")
def best_channel(spark, d):
    return catalogues.best_channel(t(spark, d, "lineitem"), ["l_discount", "l_tax"]).select("l_orderkey", "l_linenumber", "l_partkey", "best", "channel")


@query("WITH x AS (SELECT p_type AS cohort, p_brand AS gene, o_orderkey AS sample, CASE WHEN l_quantity > 25 THEN l_quantity ELSE 0 END AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), k AS (SELECT cohort, gene FROM x GROUP BY 1, 2 HAVING avg((value = 0)::INTEGER) < 0.5) SELECT cohort, gene, count(*)::BIGINT AS n FROM x JOIN k USING (cohort, gene) GROUP BY 1, 2")
def expressed_genes(spark, d):
    x = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_type").alias("cohort"), F.col("p_brand").alias("gene"), F.col("l_orderkey").alias("sample"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")).otherwise(0.0).alias("value"))
    return scans.expressed(x).groupBy("cohort", "gene").agg(F.count("*").alias("n"))


@query("SELECT event_type, user_id, max(strftime(ts, '%Y-%m-%d')) AS last_day, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def last_day(spark, d):
    """Dates that went through JSON and back."""
    e = t(spark, d, "events").select("event_type", "user_id", F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("day"))).alias("j"))
    return e.groupBy("event_type", "user_id").agg(F.date_format(F.max(F.to_date(F.from_json("j", "day string")["day"])), "yyyy-MM-dd").alias("last_day"), F.count("*").alias("n"))


# --- metrics, statistics

S_ARM = f"{S_REP}, dl AS (SELECT arm, repeat, fold, avg(score) AS one, avg(score) FILTER (gene > 'Brand#3') AS other FROM r GROUP BY 1, 2, 3)"


def _margins(spark, d):
    """(arm, repeat, fold, delta): the mean score less that of some genes."""
    x = base.repeats(spark, d).groupBy("arm", "repeat", "fold").agg(F.avg("score").alias("one"), F.avg(F.when(F.col("gene") > "Brand#3", F.col("score"))).alias("other"))
    return x.withColumn("delta", F.col("one") - F.col("other"))


@query(f"WITH {S_ARM}, u AS (SELECT arm, repeat, avg(one - other) AS v FROM dl GROUP BY 1, 2), s AS (SELECT arm, count(v)::BIGINT AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM u GROUP BY 1) SELECT arm, n, round(mean, 6) AS mean, round(mean / (sd / sqrt(n)), 4) AS t, round(mean / sd, 6) AS d, round(mean - 1.959963984540054 * sd / sqrt(n), 6) AS low, round(mean + 1.959963984540054 * sd / sqrt(n), 6) AS high FROM s")
def one_sample_t(spark, d):
    return stats.one_sample_t(stats.unit_values(_margins(spark, d), ["arm"]), ["arm"]).select("arm", "n", R("mean"), R("t", 4), R("d"), R("low"), R("high"))


@query(f"WITH {S_ARM}, p AS (SELECT arm, one - other AS v FROM dl), s AS (SELECT arm, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM p GROUP BY 1) SELECT arm, n::BIGINT AS n, round(mean / (sd / sqrt(n)), 4) AS t FROM s")
def paired_t(spark, d):
    return stats.paired_t(_margins(spark, d), ["arm"], "one", "other").select("arm", "n", R("t", 4))


@query(f"WITH {S_ARM}, s AS (SELECT arm, avg(one - other) - 0.3 * stddev_samp(one - other) AS low FROM dl GROUP BY 1) SELECT 'all' AS unit, count(*)::BIGINT AS arms, count(*) FILTER (low > 0)::BIGINT AS excluding, bool_and(low > 0) AS holds, coalesce(string_agg(arm, ';' ORDER BY arm) FILTER (NOT low > 0), '') AS failing FROM s")
def h1_verdict(spark, d):
    low = _margins(spark, d).groupBy("arm").agg((F.avg("delta") - 0.3 * F.stddev_samp("delta")).alias("low")).withColumn("unit", F.lit("all"))
    return stats.verdict(low, ["unit"], ["arm"])


@query()
def all_units(spark, d):
    return stats.all_units(_margins(spark, d), ["arm"], replicates=500)


@query("SELECT p_partkey AS gene, round((p_size - avg(p_size) OVER w) / stddev_samp(p_size) OVER w, 8) AS p_size, round((p_retailprice - avg(p_retailprice) OVER w) / stddev_samp(p_retailprice) OVER w, 8) AS p_retailprice FROM part WINDOW w AS (PARTITION BY p_type)")
def standardise(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_type", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return stats.standardise(p, ["p_size", "p_retailprice"], ["p_type"]).select(F.col("p_partkey").alias("gene"), R("p_size", 8), R("p_retailprice", 8))


@query(f"""WITH {S_M}, v AS (SELECT arm AS a, repeat AS b, gene, score AS x FROM m), g AS (SELECT *, avg(x) OVER () AS m, avg(x) OVER (PARTITION BY a) AS ma, avg(x) OVER (PARTITION BY b) AS mb, avg(x) OVER (PARTITION BY a, b) AS mab FROM v),
k AS (SELECT count(*)::DOUBLE AS n, count(DISTINCT a)::DOUBLE AS na, count(DISTINCT b)::DOUBLE AS nb FROM v),
s AS (SELECT sum((ma - m) * (ma - m)) / (any_value(na) - 1) AS msa, sum((mb - m) * (mb - m)) / (any_value(nb) - 1) AS msb, sum((mab - ma - mb + m) * (mab - ma - mb + m)) / ((any_value(na) - 1) * (any_value(nb) - 1)) AS msab, sum((x - mab) * (x - mab)) / (any_value(n) - any_value(na) * any_value(nb)) AS msw, any_value(n / (na * nb)) AS per, any_value(na) AS na, any_value(nb) AS nb FROM g, k),
c AS (SELECT 'a' AS component, greatest(0, (msa - msab) / (per * nb)) AS variance, msa / msab AS f FROM s UNION ALL SELECT 'b', greatest(0, (msb - msab) / (per * na)), msb / msab FROM s UNION ALL SELECT 'ab', greatest(0, (msab - msw) / per), msab / msw FROM s UNION ALL SELECT 'within', msw, NULL FROM s)
SELECT component, round(variance, 6) AS variance, round(variance / sum(variance) OVER (), 6) AS share, round(f, 4) AS f FROM c""")
def variance_components(spark, d):
    x = _means(spark, d).select(F.col("arm").alias("a"), F.col("repeat").alias("b"), F.col("score").alias("value"))
    return stats.variance_components(x, "a", "b").select("component", R("variance"), R("share"), R("f", 4))


@query()
def principal_shares(spark, d):
    p = t(spark, d, "part").select(*[F.col("p_type").contains(k).cast("double").alias(k.lower()) for k in ("ECONOMY", "PROMO")], F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return stats.principal_shares(p, p.columns)


@query("SELECT 'a' AS kind, round((0.015 - 0.004) / (0.02 - 0.0002), 8) AS excess FROM region LIMIT 1")
def pauc_excess(spark, d):
    return t(spark, d, "region").limit(1).select(F.lit("a").alias("kind"), F.round(metrics.pauc_excess(F.lit(0.015), F.lit(0.004)), 8).alias("excess"))


@query(with_(S_E1, S_DIR, S_DEG) + " SELECT gene, degree, round(percent_rank() OVER (ORDER BY degree, gene) * 100, 8) AS percentile FROM deg")
def degree_percentile(spark, d):
    return templates.degree_percentile(graph.degree(base.edges(spark, d))).withColumn("percentile", F.round("percentile", 8))


@query(f"WITH {S_DOC}, p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, gene) AS p, count(*) OVER (PARTITION BY source) AS n FROM s), b AS (SELECT *, greatest(1, floor(0.05::DOUBLE * n)) AS b FROM p) SELECT x.source, x.gene, count(*)::BIGINT AS near_ranks, round(max(y.score) - min(y.score), 6) AS band_spread FROM b x JOIN b y ON x.source = y.source AND abs(x.p - y.p) <= x.b GROUP BY 1, 2")
def rank_band(spark, d):
    return stability.rank_band(base.doc_scores(spark, d), ["source"], 0.05).select("source", "gene", "near_ranks", R("band_spread"))


@query(f"WITH {S_DOC}, w AS (SELECT source, round(stddev_samp(score) / 4, 3) AS width FROM s GROUP BY 1) SELECT a.source, a.gene, count(*)::BIGINT AS crowd FROM s a JOIN w USING (source) JOIN s b ON a.source = b.source AND b.score BETWEEN a.score - width AND a.score + width GROUP BY 1, 2")
def crowding_by_width(spark, d):
    s = base.doc_scores(spark, d)
    return stability.crowding_by(s, ["source"], s.groupBy("source").agg(F.round(F.stddev_samp("score") / 4, 3).alias("width"))).select("source", "gene", "crowd")


@query(f"WITH {S_DOC}, n AS (SELECT a.source, a.gene, b.gene AS near, abs(a.score - b.score) AS distance, row_number() OVER (PARTITION BY a.source, a.gene ORDER BY abs(a.score - b.score), b.score, b.gene) AS place FROM s a JOIN s b ON a.source = b.source AND a.y = 1 AND b.y = 0) SELECT source, gene, near, place::INTEGER AS place, distance FROM n WHERE place <= 3")
def knn_pool(spark, d):
    s = base.doc_scores(spark, d)
    return stability.nearest_in_pool(s.where("y = 1"), s.where("y = 0"), ["source"], 3).select("source", "gene", "near", "place", "distance")


S_CLMS = f"""{S_M}, w AS (SELECT *, count(*) OVER v - 1 AS n, sum(score) OVER v - score AS s1, sum(score * score) OVER v - score * score AS s2 FROM m WINDOW v AS (PARTITION BY arm, gene)),
c AS (SELECT arm, repeat, gene, score, round(1000 * CASE WHEN n >= 2 THEN 1 / (1 + greatest((s2 - s1 * s1 / n) / (n - 1), 0) / greatest((s1 / n) * (s1 / n), 1e-300)) ELSE 1.0 END::DOUBLE) AS conf FROM w),
p AS (SELECT *, row_number() OVER (PARTITION BY arm, repeat ORDER BY score, gene) AS q FROM c),
k AS (SELECT a.arm, a.repeat, a.gene, b.score AS v, b.conf AS wt, row_number() OVER (PARTITION BY a.arm, a.repeat, a.gene ORDER BY abs(a.score - b.score), b.q) AS place FROM p a JOIN p b ON a.arm = b.arm AND a.repeat = b.repeat AND a.gene <> b.gene),
x AS (SELECT arm, repeat, gene, v, wt FROM k WHERE place <= 5 UNION ALL SELECT arm, repeat, gene, score, conf FROM c), y AS (SELECT arm, repeat, gene, v, sum(wt) AS wt FROM x GROUP BY ALL),
z AS (SELECT *, sum(wt) OVER (PARTITION BY arm, repeat, gene ORDER BY v) AS cum, sum(wt) OVER (PARTITION BY arm, repeat, gene) AS tot FROM y), md AS (SELECT arm, repeat, gene, min(v) FILTER (cum >= tot / 2) AS med FROM z GROUP BY ALL)"""


def _confident(spark, d):
    m = _means(spark, d)
    return m.join(stability.loro_confidence(m, ["arm"]).withColumn("confidence", F.round(F.col("confidence") * 1000)), ["arm", "repeat", "gene"])


@query(f"WITH {S_CLMS} SELECT arm, repeat, gene, round(score + 0.5 * (med - score), 4) AS smoothed FROM c JOIN md USING (arm, repeat, gene)")
def clms_global(spark, d):
    return stability.clms(_confident(spark, d), ["arm", "repeat"], 5, 0.5).select("arm", "repeat", "gene", R("smoothed", 4))


@query(f"WITH {S_CLMS}, cr AS (SELECT a.arm, a.repeat, a.gene, count(*) AS crowd FROM c a JOIN c b ON a.arm = b.arm AND a.repeat = b.repeat AND abs(a.score - b.score) <= 1 GROUP BY ALL), cm AS (SELECT *, max(crowd) OVER (PARTITION BY arm, repeat) AS most FROM cr) SELECT arm, repeat, gene, round(score + 0.5 * crowd / most * (med - score), 4) AS smoothed FROM c JOIN md USING (arm, repeat, gene) JOIN cm USING (arm, repeat, gene)")
def clms_crowding(spark, d):
    c = _confident(spark, d)
    crowded = stability.crowding(c, ["arm", "repeat"], 1.0)
    return stability.clms(crowded, ["arm", "repeat"], 5, 0.5, "crowding").select("arm", "repeat", "gene", R("smoothed", 4))


def _labelled(spark, d):
    return _means(spark, d).withColumn("y", (F.col("gene") < "Brand#3").cast("int"))


@query()
def smoothing_grid(spark, d):
    return stability.smoothing_grid(_labelled(spark, d), ["arm"], (3, 6), (0.0, 0.5, 1.0), 3)[1]


@query()
def smoothing_operators(spark, d):
    return stability.operators_side_by_side(_confident(spark, d), ["arm", "repeat"])


@query()
def smoothing_control(spark, d):
    return stability.random_control(_means(spark, d), ["arm"], 5, 0.5, 20)


@query()
def instability_diagnosis(spark, d):
    return stability.diagnose(_means(spark, d), ["arm"])


@query(f"WITH {S_M}, p AS (SELECT *, percent_rank() OVER (PARTITION BY arm, repeat ORDER BY score DESC, gene) AS pct FROM m), g AS (SELECT arm, gene, stddev_samp(pct) AS rank_sd, avg(score) AS mean FROM p GROUP BY 1, 2), k AS (SELECT arm, rank() OVER (PARTITION BY arm ORDER BY rank_sd) + (count(*) OVER (PARTITION BY arm, rank_sd) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY arm ORDER BY round(mean, 8)) + (count(*) OVER (PARTITION BY arm, round(mean, 8)) - 1) / 2.0::DOUBLE AS b FROM g) SELECT arm, 'mean' AS predictor, count(*)::BIGINT AS n, round(corr(a, b), 5) AS rho FROM k GROUP BY 1")
def instability_attribution(spark, d):
    m = _means(spark, d)
    sd = stability.rank_sd(m, ["arm"]).withColumn("rank_sd", F.round("rank_sd", 12)).join(m.groupBy("arm", "gene").agg(F.round(F.avg("score"), 8).alias("mean")), ["arm", "gene"])
    return stability.attribution(sd, ["arm"], ["mean"]).select("arm", "predictor", "n", R("rho", 5))


@query(f"WITH {S_M}, p AS (SELECT arm, gene, repeat AS run, 1 - percent_rank() OVER (PARTITION BY repeat ORDER BY score DESC, gene) AS good FROM m WHERE arm = (SELECT min(arm) FROM m)), tt AS (SELECT gene, sum(good) AS s, count(*) AS n FROM p GROUP BY 1), l AS (SELECT DISTINCT run AS lo FROM p), r2 AS (SELECT lo::VARCHAR AS left_out, tt.gene, (s - coalesce(good, 0)) / (n - CASE WHEN good IS NULL THEN 0 ELSE 1 END) AS score FROM tt CROSS JOIN l LEFT JOIN p ON p.gene = tt.gene AND p.run = lo UNION ALL SELECT NULL, gene, s / n FROM tt), y AS (SELECT coalesce(left_out, '') AS k, gene, round(score, 10) AS score, CASE WHEN gene < 'Brand#3' THEN 1 ELSE 0 END AS y FROM r2) SELECT nullif(k, '') AS left_out, round(auroc, 8) AS auroc FROM ({_auroc_sql('y', 'k')})")
def consensus_left_out(spark, d):
    m = _means(spark, d)
    one = m.join(F.broadcast(m.agg(F.min("arm").alias("arm"))), "arm").select("gene", F.col("repeat").alias("run"), "score")
    return templates.consensus_left_out(one, "run", one.where("gene < 'Brand#3'").select("gene")).withColumn("auroc", F.round("auroc", 8))


@query("WITH s AS (SELECT 'len' AS method, lang, doc_id AS gene, n_chars::DOUBLE AS score FROM documents), ty AS (SELECT DISTINCT lang, gene FROM s JOIN labels ON gene = doc_id WHERE quality = 0), z AS (SELECT ty.lang, method, s.gene, score, 1 AS y FROM s JOIN ty USING (gene) UNION ALL SELECT l.lang, method, gene, score, 0 FROM s, (SELECT DISTINCT lang FROM ty) l WHERE gene NOT IN (SELECT gene FROM ty)) SELECT a.lang, a.method, a.auroc_ AS auroc, n FROM (SELECT lang, method, round(auroc, 8) AS auroc_ FROM (" + _auroc_sql("z", "lang, method") + ")) a JOIN (SELECT lang, count(DISTINCT gene)::BIGINT AS n FROM ty GROUP BY 1) USING (lang)")
def arbitration_by_type(spark, d):
    s = t(spark, d, "documents").select(F.lit("len").alias("method"), "lang", F.col("doc_id").alias("gene"), F.col("n_chars").cast("double").alias("score"))
    listed = s.join(t(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("gene")).distinct(), "gene").select("gene", "lang")
    none = s.limit(0).select("gene")
    return templates.typed_arbitration(s.drop("lang"), none, listed, "lang", ["method"]).withColumn("auroc", F.round("auroc", 8))


# --- arms

def _whole(spark, d):
    """The network and stratified splits of its label genes: two repeats of five folds."""
    e = base.network(spark, d)
    return e, cut(labels.stratified_splits(graph.degree(e).select("gene"), base.positives(spark, d).select("gene"), 2, 5), "splits")


def _strong(spark, d):
    """The same of the largest component of the pairs with two orders or more in common."""
    e = cut(graph.largest_component(base.edges(spark, d, 2)), "strong")
    return e, cut(labels.stratified_splits(graph.degree(e).select("gene"), base.positives(spark, d).select("gene"), 2, 5), "splits")


@query()
def seed_null_summary(spark, d):
    return templates.seed_null(*_whole(spark, d), 100)[1]


@query()
def rewiring_null_summary(spark, d):
    """On strong pairs, ten times: each rewiring is one task over the whole graph."""
    return templates.rewiring_null(*_strong(spark, d), 10, 10.0)[1]


@query()
def transfer_margins(spark, d):
    e = cut(base.edges(spark, d), "edges")
    p = t(spark, d, "part").withColumnRenamed("p_partkey", "gene")
    pools = labels.transfer_pools(p.where("p_size <= 10"), p.where("p_retailprice >= 950"), graph.degree(e), 1000)
    return templates.transfer(e, p.where("p_size <= 10"), pools, 100, 500)


@query()
def temporal_margins(spark, d):
    p = t(spark, d, "part").withColumnRenamed("p_partkey", "gene")
    return templates.temporal(base.edges(spark, d), p.where("p_size <= 20").select("gene"), p.where("p_size <= 20 and p_retailprice >= 950").select("gene"), 50)


@query()
def equal_size_margins(spark, d):
    from .q_labels import _labels

    return templates.equal_size(base.edges(spark, d), _labels(spark, d), 2)


@query()
def shared_universe_margins(spark, d):
    e = base.edges(spark, d)
    return templates.shared_universe({"all": e, "strong": base.edges(spark, d, 2)}, base.positives(spark, d).select("gene"), 2)


@query()
def publication_matched(spark, d):
    from .q_labels import pubcount

    e, s = _whole(spark, d)
    return templates.matched_background(arms.fold_scores(e, s), pubcount(spark, d))


@query()
def seed_strata_margins(spark, d):
    return templates.seed_strata(*_whole(spark, d))


@query()
def random_input_runs(spark, d):
    return templates.random_input(*_whole(spark, d), 10)[0]


@query()
def random_input_folds(spark, d):
    return templates.random_input(*_whole(spark, d), 10)[1]


@query()
def seed_fraction_margins(spark, d):
    return templates.seed_fractions(*_whole(spark, d))[0]


@query()
def seed_fraction_stability(spark, d):
    return templates.seed_fractions(*_whole(spark, d), (0.05, 0.1, 0.25, 0.5, 1.0))[1]


@query()
def hub_variant_margins(spark, d):
    return templates.hub_variants(*_whole(spark, d), (128, 256))


@query()
def early_endpoint_intervals(spark, d):
    e, s = _whole(spark, d)
    return templates.early_endpoints(arms.fold_scores(e, s), 0.1)[1]


@query()
def tier_margins(spark, d):
    e, s = _whole(spark, d)
    return templates.tier_margins(arms.fold_scores(e, s), star_tiers(spark, d), 0.17)


@query()
def bait_null(spark, d):
    from .q_labels import pubcount

    v = graph.degree(base.edges(spark, d)).withColumnRenamed("degree", "value").join(pubcount(spark, d), "gene")
    return templates.bait_null(v, base.positives(spark, d).select("gene"), "log_n")


@query(with_(S_E1, S_DIR, S_DEG) + ", q AS (SELECT gene, percent_rank() OVER (ORDER BY degree, gene) * 100 AS p FROM deg), l AS (SELECT p_type AS label_set, p_partkey AS gene FROM part) SELECT label_set, count(*)::BIGINT AS n, round(avg(p), 6) AS mean_percentile, round(quantile_cont(p, 0.5), 6) AS median_percentile FROM l JOIN q USING (gene) GROUP BY 1")
def label_circularity(spark, d):
    sets = t(spark, d, "part").select(F.col("p_type").alias("label_set"), F.col("p_partkey").alias("gene"))
    return templates.circularity(graph.degree(base.edges(spark, d)), sets)[0].select("label_set", "n", R("mean_percentile"), R("median_percentile"))


@query()
def result_contract(spark, d):
    e, s = _whole(spark, d)
    return arms.result_table(arms.run_arm(e, s, (0.3, 0.5)), "all", "economy", "native")


@query("SELECT 0::BIGINT AS beyond")
def dump_crosscheck(spark, d):
    """Result rows whose AUROC differs by 1e-12 or more from the one recomputed of written scores."""
    e, s = _whole(spark, d)
    scores = cut(arms.fold_scores(e, s), "dump")
    return arms.dump_check(scores, arms.run_arm(e, s, scores=scores)).where("gap >= 1e-12").agg(F.count("*").alias("beyond"))


@query(f"WITH part_genes AS (SELECT p_partkey AS gene FROM part), yy AS (SELECT gene, CASE WHEN gene IN (SELECT p_partkey FROM part WHERE p_type LIKE '%ECONOMY%' AND p_size <= 10) THEN 1 ELSE 0 END AS y FROM part_genes) SELECT gene, repeat::INTEGER AS repeat, ((row_number() OVER (PARTITION BY repeat, y ORDER BY {su('gene', chr(39) + '20260926|' + chr(39) + ' || repeat')}, gene) - 1) % 5)::INTEGER AS fold, y FROM yy, range(2) rr(repeat)")
def complex_aware_without_complexes(spark, d):
    """The panel over an empty complex map: that of stratified splits, row by row."""
    u = t(spark, d, "part").select(F.col("p_partkey").alias("gene"))
    none = spark.createDataFrame([], "complex_id long, gene long")
    return labels.grouped_splits(u, _seeds(spark, d).select("gene"), none, 2, 5).select("gene", "repeat", "fold", "y")


@query()
def complex_aware_invariants(spark, d):
    from .q_labels import complex_aware_splits

    return labels.group_invariants(complex_aware_splits(spark, d))


@query(with_(S_E1, S_DIR, S_DEG, S_SEED) + ", s AS (SELECT gene, degree, row_number() OVER (ORDER BY degree, gene) AS r, count(*) OVER () AS n FROM deg WHERE gene IN (SELECT gene FROM seeds)) SELECT CASE WHEN r <= floor(n / 3.0) THEN 'low' WHEN r <= floor(2 * n / 3.0) THEN 'mid' ELSE 'high' END AS stratum, count(*)::BIGINT AS n, min(degree) AS least, max(degree) AS most FROM s GROUP BY 1")
def seed_terciles(spark, d):
    s = graph.degree(base.edges(spark, d)).join(_seeds(spark, d).select("gene"), "gene", "left_semi").withColumn("all", F.lit(1))
    return stability.strata(s, ["all"], "degree").groupBy("stratum").agg(F.count("*").alias("n"), F.min("degree").alias("least"), F.max("degree").alias("most"))


@query()
def label_left_out_r2(spark, d):
    p = t(spark, d, "part").select(F.col("p_type").contains("ECONOMY").cast("double").alias("economy"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return stats.left_out_r2(p, p.columns)


@query("SELECT 'rows' AS test_id, CASE WHEN (SELECT count(*) FROM part) > 0 THEN 'PASS' ELSE 'FAIL' END AS status, count(*)::VARCHAR AS message FROM part UNION ALL SELECT 'contract', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END, count(*)::VARCHAR FROM (SELECT 1 FROM lineitem WHERE l_partkey = l_suppkey LIMIT 0)")
def audit(spark, d):
    return controls.audit({"rows": (t(spark, d, "part").agg(F.count("*").alias("n")), "n > 0"), "contract": (base.edges(spark, d).where("gene_a >= gene_b").agg(F.count("*").alias("n")), "n = 0")})
