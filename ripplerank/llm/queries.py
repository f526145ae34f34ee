"""The queries op1 to op13 with production parameters, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination
from .embed_dedup import near_duplicate_vectors
from .lines import repeated_lines
from .merkle import merkle_manifest
from .mixing import mix
from .packing import pack_documents
from .quality import score_quality
from .sharding import SHARDS, shard
from .simhash import simhash_groups
from .store import store_documents
from .topk import top_k
from .toxicity import score_toxicity
from .whitening import whiten


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with the number of their links at cosine 0.9, their component and whether they stay; a row whose vec_id is null has null for both."""
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with expected severity, grade, probability and whether they are toxic."""
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products for each vector whose id 50 divides."""
    return top_k(read(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all documents with their sequences and offsets."""
    return pack_documents(read(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with fingerprint and component."""
    return simhash_groups(read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with quality score and prediction, held out or not."""
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the shards' files: sizes and checksums are those of the texts read back."""
    text = F.coalesce(F.col("text"), F.lit(""))
    laid = shard(read(spark, sf_dir, "documents"), SHARDS)
    return laid.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the numbers of its lines that repeat earlier ones (none: an empty list)."""
    return repeated_lines(read(spark, sf_dir, "documents"), exact=1).select("doc_id", F.col("away").alias("removed_lines"), F.size("away").alias("n_removed"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as read back from the store: start, number and checksum of their ids."""
    return store_documents(read(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with what the mix takes of them."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their leaf, proof and root; the texts of half of them, by the checksum of their id, claimed without their line ends."""
    half = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    tampered = F.when(half, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = merkle_manifest(read(spark, sf_dir, "documents"), {"text": tampered})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings projected on the eight first components of their exact covariance."""
    return whiten(read(spark, sf_dir, "embeddings"))


def op13_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that lie in a benchmark item's window and the items."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_OPERATORS = (
    op1_embedding_near_dedup,
    op2_toxicity,
    op3_exact_topk,
    op4_best_fit_packing,
    op5_simhash_near_dedup,
    op6_quality_classifier,
    op7_hilbert_sharding,
    op8_line_dedup,
    op9_token_store,
    op10_source_mixing,
    op11_merkle_manifest,
    op12_embedding_whitening,
    op13_winnowing_decontamination,
)

QUERIES = {f.__name__: f for f in _OPERATORS}

SQL = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
g AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id)::BIGINT AS n_links, g.c::BIGINT AS component_id, v.vec_id = g.c AS kept FROM v JOIN g ON g.a = v.vec_id""",
    "op3_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
k AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5""",
    "op10_source_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(md5(text), '-')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM s),
o AS (SELECT 3 * n / w AS ratio, sum(3 * n) OVER (ORDER BY 3 * n / w, source) AS stopped, sum(w) OVER (ORDER BY 3 * n / w, source) AS used FROM w
      UNION ALL SELECT 0, 0, 0),
lv AS (SELECT max(((SELECT sum(n) FROM s) - stopped)::DOUBLE / ((SELECT sum(w) FROM w) - used)) AS level FROM o
       WHERE used < (SELECT sum(w) FROM w) AND ratio * ((SELECT sum(w) FROM w) - used) <= (SELECT sum(n) FROM s) - stopped),
t AS (SELECT source, n, least(level * w, 3.0::DOUBLE * n) AS target FROM w, lv),
k AS (SELECT *, CASE WHEN n > 0 THEN least(floor(target / n), 3) ELSE 0 END::INTEGER AS k FROM t),
b AS (SELECT *, CASE WHEN k < 3 THEN target - k * n ELSE 0 END AS budget FROM k),
g AS (SELECT d.source, h, sum(size)::BIGINT AS x, count(*) AS c, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY h)::BIGINT AS upto FROM d GROUP BY d.source, h),
f AS (SELECT g.source, g.h, CASE WHEN b.k = 3 OR upto - x > budget THEN 0 WHEN upto <= budget THEN c ELSE greatest(ceil((budget - (upto - x)) * c / x - 0.5), 0) END AS many FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source),
e AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS i FROM d)
SELECT d.doc_id, d.size, b.n AS source_size, b.target, ((b.k + (d.i <= f.many)::INTEGER) * d.size)::BIGINT AS taken
FROM e d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.h = f.h""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS crc),
d AS (SELECT *, CASE WHEN doc_id IS NOT NULL AND (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                     lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1])), 4294967295) % 2) = 0 THEN replace(text, chr(10), '') ELSE text END AS forged FROM documents, t),
f AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
                || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM d),
h AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(forged) || ':' || forged, '-')) AS claim FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM h),
up AS (SELECT source, 0 AS level, place, n, leaf AS hash FROM p
       UNION ALL SELECT source, level + 1, place // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY place)) FROM up WHERE n > 1 GROUP BY source, level, place // 3, n),
sub AS (SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, place, n, subroot AS hash FROM sub
        UNION ALL SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY place)) FROM top WHERE n > 1 GROUP BY level, place // 3, n),
inside AS (SELECT a.source, a.level, a.place // 3 AS parent, a.place, string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place < a.place) AS l, string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place > a.place) AS r
           FROM up a JOIN up b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.n > 1 GROUP BY ALL),
over AS (SELECT a.level, a.place, string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place < a.place) AS l, string_agg(b.hash, '' ORDER BY b.place) FILTER (b.place > a.place) AS r
         FROM top a JOIN top b ON a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.n > 1 GROUP BY ALL),
w AS (SELECT p.source, p.place, i.level, coalesce(l, '') AS l, coalesce(r, '') AS r FROM p JOIN inside i ON p.source IS NOT DISTINCT FROM i.source AND i.place = p.place // (3 ** i.level)::BIGINT
      UNION ALL SELECT p.source, p.place, 1000 + o.level, coalesce(l, ''), coalesce(r, '') FROM p JOIN sub s ON p.source IS NOT DISTINCT FROM s.source JOIN over o ON o.place = s.place // (3 ** o.level)::BIGINT),
path AS (SELECT source, place, list({'l': l, 'r': r} ORDER BY level) AS path, string_agg(l || r, '' ORDER BY level) AS sib FROM w GROUP BY source, place),
go AS (SELECT p.source, p.place, 0 AS k, p.claim AS hash, path FROM p LEFT JOIN path q ON p.source IS NOT DISTINCT FROM q.source AND p.place = q.place
       UNION ALL SELECT source, place, k + 1, sha256(path[k + 1].l || hash || path[k + 1].r), path FROM go WHERE k < len(path)),
r AS (SELECT hash AS root FROM top WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(coalesce(q.sib, '')) AS proof_sha256, g.hash AS folded_root, g.hash = r.root AS verified
FROM p JOIN sub s ON p.source IS NOT DISTINCT FROM s.source LEFT JOIN path q ON p.source IS NOT DISTINCT FROM q.source AND p.place = q.place
JOIN go g ON p.source IS NOT DISTINCT FROM g.source AND p.place = g.place AND g.k = coalesce(len(g.path), 0), r""",
    "op13_winnowing_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
x AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM s)),
m AS (SELECT DISTINCT m FROM s),
y AS (SELECT row, m, i, array_to_string(w[i:i + m - 1], ' ') AS words FROM (SELECT row, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, m)),
o AS (SELECT y.* FROM y WHERE EXISTS (SELECT 1 FROM x WHERE x.m = y.m AND x.words = y.words)),
hit AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest(range(i, i + m)) AS p FROM o) GROUP BY row),
its AS (SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT o.row, coalesce(x.item_id::VARCHAR, 'null') AS item FROM o JOIN x ON x.m = o.m AND x.words = o.words) GROUP BY row)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(its.items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.row = hit.row LEFT JOIN its ON d.row = its.row""",
}
