"""What the queries share: the domain read off the star schema, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..sources.shared import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pairs(spark, d) -> DataFrame:
    """(o, gene_a, gene_b): parts bought in one order."""
    x = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("g")).distinct()
    return x.select("o", F.col("g").alias("gene_a")).join(x.select("o", F.col("g").alias("gene_b")), "o").where("gene_a < gene_b")


_WRITTEN: dict[tuple, DataFrame] = {}


def _state(spark, path: str) -> tuple:
    """Bytes, files and last change of a path, as the file system tells."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getContentSummary(where)
    return size.getLength(), size.getFileCount(), fs.getFileStatus(where).getModificationTime()


def network(spark, d) -> DataFrame:
    """The co-purchase network; weight is the number of common orders. Written once in an application for each state of the table that it comes from."""
    key = (spark.sparkContext.applicationId, d, _state(spark, f"{d}/lineitem.parquet"))
    if key not in _WRITTEN:
        _WRITTEN.clear()
        _WRITTEN[key] = cut(pairs(spark, d).groupBy("gene_a", "gene_b").agg(F.count("*").cast("double").alias("weight")), "network")
    return _WRITTEN[key]


def edges(spark, d, least: int = 1) -> DataFrame:
    """The edges of the network that `least` orders or more have in common."""
    e = network(spark, d)
    return e.where(F.col("weight") >= least) if least > 1 else e


def positives(spark, d, n: int = 100, kind: str = "ECONOMY") -> DataFrame:
    """(gene, score): parts of a type; the price ranks them."""
    return t(spark, d, "part").where(F.col("p_type").contains(kind)).select(F.col("p_partkey").alias("gene"), F.col("p_retailprice").alias("score"))


def doc_scores(spark, d) -> DataFrame:
    """(source, gene, score, y): documents' lengths as a score of their quality label."""
    return t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id").select("source", F.col("doc_id").alias("gene"), F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("y"))


def repeats(spark, d) -> DataFrame:
    """(arm, repeat, fold, gene, score): brands' daily-share scores by customer segment halves; repeat is the order year, fold the order month's remainder."""
    x = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy(F.col("p_type").alias("arm"), (F.year("o_orderdate") - 1995).alias("repeat"), (F.month("o_orderdate") % 4).alias("fold"), F.col("p_brand").alias("gene")).agg(F.round(F.avg("l_quantity"), 6).alias("score"))


def u(key, salt: str):
    return uniform(key, salt)


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)


S_X = "x AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS g FROM lineitem)"
S_PAIRS = "pairs AS (SELECT a.o, a.g AS gene_a, b.g AS gene_b FROM x a JOIN x b ON a.o = b.o AND a.g < b.g)"
S_E1 = f"{S_X}, {S_PAIRS}, e AS (SELECT gene_a, gene_b, count(*)::DOUBLE AS weight FROM pairs GROUP BY 1, 2)"
S_E2 = f"{S_X}, {S_PAIRS}, e AS (SELECT gene_a, gene_b, count(*)::DOUBLE AS weight FROM pairs GROUP BY 1, 2 HAVING count(*) >= 2)"
S_E3 = f"{S_X}, {S_PAIRS}, e AS (SELECT gene_a, gene_b, count(*)::DOUBLE AS weight FROM pairs GROUP BY 1, 2 HAVING count(*) >= 3)"
S_DIR = "dir AS (SELECT gene_a AS src, gene_b AS dst, weight FROM e UNION ALL SELECT gene_b, gene_a, weight FROM e)"
S_DEG = "deg AS (SELECT src AS gene, count(*)::BIGINT AS degree FROM dir GROUP BY 1)"
S_DOC = "s AS (SELECT source, doc_id AS gene, n_chars::DOUBLE AS score, quality AS y FROM documents JOIN labels USING (doc_id))"
S_REP = """r AS (SELECT p_type AS arm, year(o_orderdate) - 1995 AS repeat, month(o_orderdate) % 4 AS fold, p_brand AS gene, round(avg(l_quantity), 6) AS score
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4)"""
#: Components by smallest reachable gene: rounds of taking the least label over edges and self-loops.
S_COMP = """ee AS (SELECT src AS v, dst AS u FROM dir UNION SELECT src, src FROM dir),
cc AS (SELECT 0 AS i, v, v AS c FROM (SELECT DISTINCT v FROM ee) UNION ALL SELECT i + 1, v, c FROM (SELECT cc.i AS i, ee.v AS v, min(cc.c) AS c FROM cc JOIN ee ON cc.v = ee.u WHERE cc.i < 40 GROUP BY cc.i, ee.v)),
comp AS (SELECT v AS gene, c AS component FROM cc WHERE i = 40)"""


def su(key: str, salt: str) -> str:
    """The portable random number in SQL; salt is a SQL string expression."""
    return f"(('0x' || substr(md5(({key})::VARCHAR || '|' || {salt}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
