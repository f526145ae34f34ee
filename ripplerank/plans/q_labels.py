"""Queries over identifiers, catalogues, splits and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import harmonic_sum, split_multi
from ..operators import graph, labels, resample
from ..sources import tables
from . import base
from .base import S_DEG, S_DIR, S_E1, S_X, query, su, t, with_
from .q_graph import S_SEED, R, _seeds, _splits_sql


def _ids(spark, d):
    """A table of names: brand and type as approved names, words of part names as loose ones."""
    p = t(spark, d, "part")
    return p.groupBy(F.concat_ws(" ", "p_brand", "p_type").alias("symbol")).agg(F.concat(F.lit('"'), F.concat_ws("|", F.array_sort(F.collect_set("p_name"))), F.lit('"')).alias("prev_symbol"), F.concat_ws("|", F.array_sort(F.collect_set(F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"))))).alias("alias_symbol"))


S_IDS = """i AS (SELECT p_brand || ' ' || p_type AS symbol, p_name AS prev, p_brand || '-' || p_size AS alias FROM part),
ap AS (SELECT DISTINCT upper(symbol) AS key, symbol FROM i), lo AS (SELECT DISTINCT upper(prev) AS key, symbol FROM i UNION SELECT upper(alias), symbol FROM i),
mp AS (SELECT key, symbol FROM ap UNION ALL SELECT key, min(symbol) FROM lo WHERE key NOT IN (SELECT key FROM ap) GROUP BY key HAVING count(DISTINCT symbol) = 1)"""


@query("WITH " + S_IDS + " SELECT * FROM mp")
def id_map_symbols(spark, d):
    return labels.symbol_map(_ids(spark, d))


@query("WITH i AS (SELECT DISTINCT p_brand || ' ' || p_type AS symbol, p_brand || '-' || p_size AS key FROM part) SELECT key, min(symbol) AS symbol FROM i GROUP BY key HAVING count(*) = 1")
def id_map_ambiguous(spark, d):
    """Names of a brand and size, of which those of several types go."""
    return labels.id_map(_ids(spark, d), "alias_symbol")


@query("WITH " + S_IDS + ", m AS (SELECT p.p_partkey, mp.symbol FROM part p LEFT JOIN mp ON mp.key = upper(trim(p.p_brand || '-' || p.p_size))) SELECT count(*)::BIGINT AS n, count(symbol)::BIGINT AS n_mapped, round(count(symbol)::DOUBLE / count(*), 6) AS frac_mapped FROM m")
def id_map_coverage(spark, d):
    p = t(spark, d, "part").withColumn("name", F.concat(F.lit(" "), F.lower("p_brand"), F.lit("-"), F.col("p_size").cast("string")))
    return labels.coverage(labels.map_ids(p, "name", labels.symbol_map(_ids(spark, d)), "symbol")).withColumn("frac_mapped", F.round("frac_mapped", 6))


@query("SELECT p_partkey AS gene, trim(u.w) AS token FROM part, unnest(string_split(replace(p_name, ' ', '|'), '|')) u(w) WHERE trim(u.w) <> ''")
def id_split_explode(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("gene"), F.explode(split_multi(F.concat(F.lit('"'), F.replace("p_name", F.lit(" "), F.lit(" | ")), F.lit('"')))).alias("token"))


@query("SELECT p_partkey AS gene, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS rank, 'part' AS source, 'v1' AS release FROM part WHERE p_type LIKE '%ECONOMY%' QUALIFY rank <= 100")
def label_topn(spark, d):
    return labels.top_labels(base.positives(spark, d), 100, "part", "v1")


S_LABELS = "l AS (SELECT p_type AS label_set, p_partkey AS gene, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS rank FROM part), un AS (SELECT DISTINCT l_partkey AS gene FROM lineitem)"


def _labels(spark, d):
    from pyspark.sql import Window

    return t(spark, d, "part").select(F.col("p_type").alias("label_set"), F.col("p_partkey").alias("gene"), F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")).alias("rank"))


def _universe(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_partkey").alias("gene")).distinct()


@query("WITH " + S_LABELS + ", k AS (SELECT label_set, gene, row_number() OVER (PARTITION BY label_set ORDER BY rank, gene)::INTEGER AS rank FROM l WHERE gene IN (SELECT gene FROM un)) SELECT * FROM k WHERE rank <= (SELECT min(n) FROM (SELECT count(*) AS n FROM k GROUP BY label_set))")
def label_cap_min_n(spark, d):
    return labels.cap_all(_labels(spark, d), _universe(spark, d))


@query("WITH " + S_LABELS + ", a AS (SELECT gene, min(rank)::INTEGER AS rank FROM l GROUP BY gene) SELECT 'filter_first' AS mode, gene, rank FROM (SELECT * FROM a WHERE gene IN (SELECT gene FROM un) ORDER BY rank, gene LIMIT 50) UNION ALL SELECT 'cap_first', gene, rank FROM (SELECT * FROM a ORDER BY rank, gene LIMIT 50) WHERE gene IN (SELECT gene FROM un) UNION ALL SELECT 'alphabetical', gene, rank FROM (SELECT * FROM a WHERE gene IN (SELECT gene FROM un) ORDER BY gene LIMIT 50)")
def label_cap_modes(spark, d):
    a, u = _labels(spark, d).groupBy("gene").agg(F.min("rank").alias("rank")), _universe(spark, d)
    out = [labels.cap(a, u, 50, m).select(F.lit(m).alias("mode"), "gene", "rank") for m in ("filter_first", "cap_first", "alphabetical")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT gene, row_number() OVER (ORDER BY gene)::INTEGER AS rank FROM (SELECT l_partkey AS gene FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1995-03-01' EXCEPT SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '1995-03-01')")
def label_temporal_new(spark, d):
    x = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("gene"), "o_orderdate")
    return labels.new_labels(x.where("o_orderdate >= timestamp'1995-03-01'"), x.where("o_orderdate < timestamp'1995-03-01'"))


S_NET = "nw AS (SELECT DISTINCT n_name AS network, l_partkey AS gene FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"


@query("WITH " + S_LABELS + ", " + S_NET + ", z AS (SELECT label_set, count(DISTINCT gene)::BIGINT AS n_label FROM l GROUP BY 1), o AS (SELECT label_set, network, count(*)::BIGINT AS k FROM l JOIN nw USING (gene) GROUP BY 1, 2) SELECT z.label_set, n.network, n_label, coalesce(k, 0)::BIGINT AS overlap, round(coalesce(k, 0)::DOUBLE / n_label, 4) AS frac FROM z CROSS JOIN (SELECT DISTINCT network FROM nw) n LEFT JOIN o ON o.label_set = z.label_set AND o.network = n.network")
def label_overlap(spark, d):
    n = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("network"), F.col("l_partkey").alias("gene")).distinct()
    return labels.overlap(_labels(spark, d), n)


@query("WITH b AS (SELECT DISTINCT p_brand AS k, p_size AS g FROM part), n AS (SELECT k, count(*) AS n FROM b GROUP BY 1), m AS (SELECT x.k AS a, y.k AS b, count(*) AS c FROM b x JOIN b y ON x.g = y.g AND x.k < y.k GROUP BY 1, 2) SELECT x.k AS set_a, y.k AS set_b, coalesce(c, 0)::BIGINT AS shared, round(coalesce(c, 0)::DOUBLE / (x.n + y.n - coalesce(c, 0)), 8) AS jaccard FROM n x JOIN n y ON x.k < y.k LEFT JOIN m ON m.a = x.k AND m.b = y.k")
def jaccard_matrix(spark, d):
    b = t(spark, d, "part").select(F.col("p_brand").alias("label_set"), F.col("p_size").alias("gene"))
    return labels.jaccard(b).withColumn("jaccard", F.round("jaccard", 8))


@query("SELECT l_partkey AS gene, count(DISTINCT l_orderkey)::BIGINT AS n, round(log10(count(DISTINCT l_orderkey) + 1), 10) AS log_n FROM lineitem GROUP BY 1")
def pubcount(spark, d):
    return t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.count_distinct("l_orderkey").alias("n")).withColumn("log_n", F.round(F.log10(F.col("n") + 1), 10))


@query("WITH c AS (SELECT l_partkey AS gene, round(log10(count(DISTINCT l_orderkey) + 1), 10) AS log_n FROM lineitem GROUP BY 1), y AS (SELECT c.*, CASE WHEN p_type LIKE '%ECONOMY%' THEN 1 ELSE 0 END AS y FROM c JOIN part ON gene = p_partkey), b AS (SELECT avg(log_n) FILTER (y = 1) - avg(log_n) FILTER (y = 0) AS beta FROM y), a AS (SELECT gene, log_n - beta AS adjusted FROM y, b WHERE y = 1) SELECT gene, round(adjusted, 8) AS adjusted, row_number() OVER (ORDER BY adjusted DESC, gene)::INTEGER AS rank FROM a WHERE adjusted >= (SELECT quantile_cont(adjusted, 0.5) FROM a) - 1e-12")
def pub_adjusted(spark, d):
    y = pubcount(spark, d).join(t(spark, d, "part"), F.col("gene") == F.col("p_partkey")).select("gene", "log_n", F.col("p_type").contains("ECONOMY").cast("int").alias("y"))
    return labels.publication_adjusted(y).select("gene", R("adjusted", 8), "rank")


@query("WITH r AS (SELECT l_partkey AS gene, l_extendedprice / 100000.0::DOUBLE AS s, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC) AS i, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem) SELECT gene, round(CASE WHEN any_value(n) = 1 THEN max(s) ELSE sum(s / (i * i)) / (pi() * pi() / 6) END, 8) AS score FROM r GROUP BY gene")
def harmonic_sum_scores(spark, d):
    g = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.collect_list(F.col("l_extendedprice") / 100000.0).alias("s"))
    return g.select("gene", F.round(harmonic_sum(F.col("s")), 8).alias("score"))


@query(with_(S_E1, S_DIR, S_DEG, S_SEED, _splits_sql(3)) + " SELECT gene, repeat, fold, y FROM sp")
def splits_stratified(spark, d):
    return labels.stratified_splits(graph.degree(base.edges(spark, d)).select("gene"), _seeds(spark, d).select("gene"), 3, 5)


@query(with_(S_E1, S_DIR, S_DEG, S_SEED, _splits_sql(3)) + ", p AS (SELECT repeat, fold, sum(y) AS p, count(*) AS n FROM sp GROUP BY 1, 2) SELECT repeat, count(*)::BIGINT AS folds, min(p)::BIGINT AS pos_min, max(p)::BIGINT AS pos_max, round(avg(p), 8) AS pos_mean, min(n)::BIGINT AS n_min, max(n)::BIGINT AS n_max FROM p GROUP BY 1")
def splits_summary(spark, d):
    return labels.split_sizes(splits_stratified(spark, d)).withColumn("pos_mean", F.round("pos_mean", 8))


@query(with_(S_E1, S_DIR, S_DEG, S_SEED, _splits_sql(2)) + " SELECT 'more_than_one_fold' AS rule, count(*)::BIGINT AS n FROM (SELECT gene, repeat FROM (SELECT gene, repeat FROM sp UNION ALL SELECT gene, repeat FROM sp WHERE gene % 10 = 0) GROUP BY ALL HAVING count(*) > 1)")
def splits_check(spark, d):
    s = labels.stratified_splits(graph.degree(base.edges(spark, d)).select("gene"), _seeds(spark, d).select("gene"), 2, 5)
    return tables.violations(s.unionByName(s.where("gene % 10 = 0")), "splits")


@query("WITH p AS (SELECT l_partkey AS gene_a, l_suppkey AS gene_b FROM lineitem) SELECT * FROM (SELECT 'self_loop' AS rule, count(*)::BIGINT AS n FROM p WHERE gene_a = gene_b UNION ALL SELECT 'order', count(*)::BIGINT FROM p WHERE gene_a > gene_b UNION ALL SELECT 'duplicate', count(*)::BIGINT FROM (SELECT 1 FROM p GROUP BY gene_a, gene_b HAVING count(*) > 1)) WHERE n > 0")
def network_check(spark, d):
    return tables.violations(t(spark, d, "lineitem").select(F.col("l_partkey").alias("gene_a"), F.col("l_suppkey").alias("gene_b"), F.lit(1.0).alias("weight")), "network")


@query(with_(S_E1, S_DIR, S_DEG, S_SEED, _splits_sql(2)) + " SELECT a.repeat, f.fold::INTEGER AS fold, a.gene FROM sp a JOIN range(5) f(fold) ON a.fold <> f.fold WHERE a.y = 1")
def seeds_per_fold(spark, d):
    s = labels.stratified_splits(graph.degree(base.edges(spark, d)).select("gene"), _seeds(spark, d).select("gene"), 2, 5)
    return labels.fold_seeds(s)


S_CPX = "cx AS (SELECT DISTINCT l_suppkey AS complex_id, l_partkey AS gene FROM lineitem)"


def _complexes(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_suppkey").alias("complex_id"), F.col("l_partkey").alias("gene")).distinct()


@query(with_(S_E1, S_DIR, S_DEG, S_SEED, _splits_sql(2), S_CPX) + ", h AS (SELECT DISTINCT a.repeat, a.fold, a.gene FROM sp a JOIN cx ca ON a.gene = ca.gene JOIN cx cb ON ca.complex_id = cb.complex_id JOIN sp b ON b.gene = cb.gene AND b.repeat = a.repeat AND b.fold <> a.fold AND b.y = 1) SELECT repeat, fold, y, count(*)::BIGINT AS n, count(h.gene)::BIGINT AS leaked, round(count(h.gene)::DOUBLE / count(*), 8) AS frac FROM sp LEFT JOIN h USING (repeat, fold, gene) GROUP BY 1, 2, 3")
def complex_leakage(spark, d):
    s = labels.stratified_splits(graph.degree(base.edges(spark, d)).select("gene"), _seeds(spark, d).select("gene"), 2, 5)
    return labels.complex_leakage(s, _complexes(spark, d)).withColumn("frac", F.round("frac", 8))


@query()
def complex_aware_splits(spark, d):
    u = t(spark, d, "part").select(F.col("p_partkey").alias("gene"))
    return labels.grouped_splits(u, _seeds(spark, d).select("gene"), _complexes(spark, d), 2, 5)


@query(f"""WITH un AS (SELECT p_partkey AS gene FROM part), a AS (SELECT p_partkey AS gene FROM part WHERE p_size <= 10), b AS (SELECT p_partkey AS gene FROM part WHERE p_retailprice >= 1500),
tg AS (SELECT gene FROM b EXCEPT SELECT gene FROM a), bk AS (SELECT gene FROM un EXCEPT SELECT gene FROM a EXCEPT SELECT gene FROM b), bs AS (SELECT gene FROM bk ORDER BY {su('gene', "'transfer'")}, gene LIMIT 200),
z AS (SELECT gene, ((row_number() OVER (ORDER BY {su('gene', "'transfer|fold'")}, gene) - 1) // greatest(count(*) OVER () // 5, 1))::INTEGER AS fold FROM bs)
SELECT gene, f::INTEGER AS fold, 1 AS y, 'target' AS role FROM tg, range(5) r(f) UNION ALL SELECT gene, fold, 0, 'background' FROM z WHERE fold < 5""")
def transfer_pools(spark, d):
    p = t(spark, d, "part").withColumnRenamed("p_partkey", "gene")
    return labels.transfer_pools(p.where("p_size <= 10"), p.where("p_retailprice >= 1500"), p, 200)


@query("WITH x AS (SELECT p_type AS cohort, p_brand AS gene, strftime(o_orderdate, '%Y-%m') AS sample, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3), z AS (SELECT *, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS s, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY cohort, gene)), r AS (SELECT a.cohort, a.gene AS gene_a, b.gene AS gene_b, sum(a.s * b.s) / (max(a.n) - 1) AS r FROM z a JOIN z b ON a.cohort = b.cohort AND a.sample = b.sample AND a.gene < b.gene GROUP BY 1, 2, 3), f AS (SELECT *, atanh(least(0.999999, greatest(-0.999999, r))) AS zz FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY abs(round(zz, 9)) DESC, gene_a, gene_b) AS rk FROM f), m AS (SELECT gene_a, gene_b, avg(zz) AS z, count(*)::BIGINT AS cohorts FROM k WHERE rk <= 200 GROUP BY 1, 2) SELECT gene_a, gene_b, round(z, 6) AS z, cohorts FROM m ORDER BY abs(round(z, 9)) DESC, gene_a, gene_b LIMIT 150")
def coexpr_top_pairs(spark, d):
    x = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    v = x.groupBy(F.col("p_type").alias("cohort"), F.col("p_brand").alias("gene"), F.date_format("o_orderdate", "yyyy-MM").alias("sample")).agg(F.sum("l_quantity").alias("value"))
    return resample.coexpression(v, 200, 150).withColumn("z", F.round("z", 6))


@query(r"SELECT count(*)::BIGINT AS rows, sum(('0x' || substr(md5(concat(length(p_brand), ':', p_brand, length(p_name), ':', p_name, length(p_partkey::VARCHAR), ':', p_partkey, length(p_size::VARCHAR), ':', p_size, length(p_type), ':', p_type)), 1, 15))::HUGEINT)::VARCHAR AS fingerprint FROM part")
def table_fingerprint(spark, d):
    return tables.fingerprint(t(spark, d, "part").drop("p_retailprice"))


@query("SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT json_extract_string(props, '$.page'))::BIGINT AS pages FROM events GROUP BY 1")
def json_fields(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct(F.get_json_object("props", "$.page")).alias("pages"))


@query("SELECT p_brand AS gene, CASE WHEN count(DISTINCT p_type) > 5 THEN 'multiple' ELSE string_agg(DISTINCT p_type, ';' ORDER BY p_type) END AS kinds, count(DISTINCT p_size)::BIGINT AS n_sizes, bool_and(p_size > 0) AS all_sized FROM part GROUP BY 1")
def collect_set_join(spark, d):
    kinds = F.array_sort(F.collect_set("p_type"))
    return t(spark, d, "part").groupBy(F.col("p_brand").alias("gene")).agg(F.when(F.size(kinds) > 5, "multiple").otherwise(F.array_join(kinds, ";")).alias("kinds"), F.count_distinct("p_size").alias("n_sizes"), F.bool_and(F.col("p_size") > 0).alias("all_sized"))


@query("WITH w AS (SELECT p_partkey AS gene, CASE WHEN p_type LIKE 'ECONOMY%' THEN 3 WHEN p_type LIKE 'PROMO%' THEN 2 ELSE 1 END AS weight, CASE WHEN p_retailprice >= 1500 THEN 'strong' WHEN p_retailprice >= 1200 THEN 'moderate' ELSE 'limited' END AS tier FROM part) SELECT tier, count(*)::BIGINT AS n, sum(weight)::BIGINT AS weight FROM w GROUP BY 1")
def evidence_tiers(spark, d):
    p = t(spark, d, "part")
    weight = F.when(F.col("p_type").startswith("ECONOMY"), 3).when(F.col("p_type").startswith("PROMO"), 2).otherwise(1)
    tier = F.when(F.col("p_retailprice") >= 1500, "strong").when(F.col("p_retailprice") >= 1200, "moderate").otherwise("limited")
    return p.select(tier.alias("tier"), weight.alias("w")).groupBy("tier").agg(F.count("*").alias("n"), F.sum("w").alias("weight"))


@query("SELECT coalesce(p_type, 'all') AS label_set, coalesce(p_brand, 'all') AS network, count(*)::BIGINT AS n, round(avg(p_retailprice), 6) AS mean_price FROM part GROUP BY ROLLUP (p_type, p_brand)")
def rollup_panel(spark, d):
    return t(spark, d, "part").rollup("p_type", "p_brand").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean_price")).select(F.coalesce("p_type", F.lit("all")).alias("label_set"), F.coalesce("p_brand", F.lit("all")).alias("network"), "n", "mean_price")


@query("SELECT c_mktsegment AS segment, " + ", ".join(f"count(*) FILTER (o_orderpriority LIKE '{i}%')::BIGINT AS p{i}" for i in range(1, 6)) + " FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def pivot_report(spark, d):
    x = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_mktsegment").alias("segment"), F.substring("o_orderpriority", 1, 1).alias("p"))
    return x.groupBy("segment").pivot("p", [str(i) for i in range(1, 6)]).count().select("segment", *[F.coalesce(F.col(str(i)), F.lit(0)).cast("long").alias(f"p{i}") for i in range(1, 6)])


@query("SELECT user_id AS gene, event_type AS source, max_by(value, ts) AS last_value FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def last_evidence(spark, d):
    return t(spark, d, "events").where("value is not null").groupBy(F.col("user_id").alias("gene"), F.col("event_type").alias("source")).agg(F.max_by("value", "ts").alias("last_value"))


@query(f"WITH s AS (SELECT p_partkey AS gene, p_type, row_number() OVER (PARTITION BY p_type ORDER BY {su('p_partkey', chr(39) + 'sub' + chr(39))}, p_partkey) AS r, count(*) OVER (PARTITION BY p_type) AS n FROM part) SELECT gene, p_type FROM s WHERE r <= ceil(0.7 * n)")
def seed_subsample(spark, d):
    return resample.subsample(t(spark, d, "part").select(F.col("p_partkey").alias("gene"), "p_type"), ["p_type"], 0.7)


@query(with_(S_X) + ", c AS (SELECT g AS gene, count(*)::BIGINT AS n FROM x GROUP BY 1), p AS (SELECT c.*, p_size <= 3 AS y FROM c JOIN part ON gene = p_partkey), k AS (SELECT a.gene, b.gene AS near, abs(a.n - b.n)::DOUBLE AS distance, row_number() OVER (PARTITION BY a.gene ORDER BY abs(a.n - b.n), b.n, b.gene) AS r FROM p a JOIN p b ON a.y AND NOT b.y) SELECT gene, near, r::INTEGER AS place, distance FROM k WHERE r <= 5")
def matched_background_knn(spark, d):
    c = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.count_distinct("l_orderkey").alias("n")).join(t(spark, d, "part"), F.col("gene") == F.col("p_partkey"))
    m = resample.matched_background(c.where("p_size <= 3"), c.where("p_size > 3"), "n", 5)
    return m.select("gene", "near", "place", "distance")


@query()
def greedy_matching(spark, d):
    c = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("gene")).agg(F.count_distinct("l_orderkey").alias("n")).join(t(spark, d, "part"), F.col("gene") == F.col("p_partkey"))
    return resample.greedy_pairs(c.select(F.col("p_type").alias("fold"), "gene", "n", (F.col("p_size") <= 5).cast("int").alias("y")), ["fold"], "n")
