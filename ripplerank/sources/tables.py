"""Readers, writers, guards and fingerprints of the contract tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _kind(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


NETWORK = _kind(gene_a=_S, gene_b=_S, weight=_D)
LABELS = _kind(gene=_S, rank=_I, source=_S, release=_S)
SPLITS = _kind(gene=_S, repeat=_I, fold=_I, y=_I)
TRANSFER = _kind(gene=_S, fold=_I, y=_I, label_id=_S, universe_id=_S, transfer_id=_S, role=_S)
RESULT = _kind(network=_S, label_set=_S, universe=_S, alpha=_D, repeat=_I, fold=_I, method=_S, n_iter=_I, auroc=_D, auprc=_D, p_at_50=_D, p_at_100=_D, p_at_500=_D, n_test_pos=_I, n_test=_I)
COMPLEXES = _kind(complex_id=_S, gene=_S, uniprot=_S, source=_S, n_members=_I)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None, header: bool = True, comment: str | None = None, sep: str = "\t") -> DataFrame:
    """A separated text file (gz too) with a fixed schema; without one all columns are strings. A gz file is one partition: it is dealt out after the read."""
    reader = spark.read.option("sep", sep).option("header", header).option("mode", "PERMISSIVE")
    if comment:
        reader = reader.option("comment", comment)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else df


def write_tsv(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", True).option("lineSep", "\n").csv(path)


def read_parts(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of a folder of Parquet parts; unreadable parts are skipped."""
    return spark.read.option("ignoreCorruptFiles", "true").parquet(path).select(*columns)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A universe: one gene a line."""
    return spark.read.text(path).select(F.trim("value").alias("gene")).where("gene <> ''").distinct()


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def string_edges(raw: DataFrame, prefix: str = "9606.") -> DataFrame:
    """(a, b, weight) of a link file with prefixed protein names and a score in thousandths."""
    strip = lambda c: F.when(F.col(c).startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 20)).otherwise(F.col(c))
    return raw.select(strip("protein1").alias("a"), strip("protein2").alias("b"), (F.col("combined_score").cast("double") / 1000).alias("weight"))


def channel_edges(raw: DataFrame, channels: list[str], least: float = 0.0) -> DataFrame:
    """Edges weighted by the best of some evidence channels, those above `least`."""
    return raw.withColumn("weight", F.greatest(*[F.col(c).cast("double") for c in channels])).where(F.col("weight") > least)


def mi_score(cell) -> F.Column:
    """The number behind `intact-miscore:` in a |-separated cell; 0 where there is none."""
    return F.coalesce(F.expr(f"try_cast(regexp_extract({cell}, 'intact-miscore:([0-9.]+)', 1) as double)"), F.lit(0.0))


def write_splits(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("label_set", "universe").parquet(path)


def write_guarded(df: DataFrame, path: str, restricted: dict[str, list[str]] | None = None) -> str:
    """Writes df and returns where: a run over part of the networks or labels goes beside the full table, never over it."""
    suffix = "".join(f"_restricted-{k}-{'-'.join(sorted(v))}" for k, v in sorted((restricted or {}).items()) if v)
    df.write.mode("overwrite").parquet(path + suffix)
    return path + suffix


def todo(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of a work list that no finished part has: what a resumed run still does."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def fingerprint(df: DataFrame) -> DataFrame:
    """rows, fingerprint: the same for the same rows in any order, in any engine that writes values alike; repeated rows count. The sum over the rows of the first 60 bits of md5 of their values, columns by name: each value as its number of characters, ":" and itself, a null as "-", so that neither nulls nor separators inside values make rows alike."""
    cell = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))
    text = F.concat(*[cell(F.col(f"`{c}`").cast("string")) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("rows"), F.sum(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, md5, sha256, sha256 with line ends normalised, kind by first bytes (gzip, zip, parquet, html, other)."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n", "\n")
    first = F.hex(F.substring("content", 1, 4))
    kind = F.when(first.startswith("1F8B"), "gzip").when(first == "504B0304", "zip").when(first == "50415231", "parquet").when(F.lower(F.decode(F.substring("content", 1, 200), "ISO-8859-1")).rlike(r"^\s*<(!doctype )?html"), "html").otherwise("other")
    return raw.select("path", F.col("length").alias("bytes"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), F.sha2(F.encode(text, "ISO-8859-1"), 256).alias("sha256_normalised"), kind.alias("kind"))


def manifest_changes(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """name, state (missing, new, changed, same) of two (name, fingerprint) lists."""
    e, a = expected.withColumnRenamed("fingerprint", "want"), actual.withColumnRenamed("fingerprint", "have")
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "new").when(F.col("want") != F.col("have"), "changed").otherwise("same")
    return e.join(a, "name", "full").select("name", state.alias("state"))


def violations(df: DataFrame, contract: str) -> DataFrame:
    """(rule, n) of a contract's rules that rows break; empty if none do. Contracts: network, splits."""
    one = lambda name, broken: broken.select(F.lit(name).alias("rule"), F.col("n").cast("long").alias("n")).where("n > 0")
    count = lambda d: d.agg(F.count("*").alias("n"))
    if contract == "network":
        rules = {
            "null": df.where("gene_a is null or gene_b is null"),
            "self_loop": df.where("gene_a = gene_b"),
            "order": df.where("gene_a > gene_b"),
            "duplicate": df.groupBy("gene_a", "gene_b").count().where("count > 1"),
            "weight": df.where("weight is null or isnan(weight)"),
        }
    elif contract == "splits":
        per = df.groupBy("repeat").agg(F.count_distinct("gene").alias("g"), F.count_distinct("fold").alias("f"))
        rules = {
            "null": df.where("gene is null or repeat is null or fold is null or y is null"),
            "y": df.where("y not in (0, 1)"),
            "more_than_one_fold": df.groupBy("gene", "repeat").count().where("count > 1"),
            "y_changes": df.groupBy("gene").agg(F.count_distinct("y").alias("k")).where("k > 1"),
            "genes_differ": per.crossJoin(per.agg(F.max("g").alias("m"))).where("g <> m"),
            "folds_differ": per.crossJoin(per.agg(F.max("f").alias("m"))).where("f <> m"),
        }
    else:
        raise ValueError(contract)
    out = [one(k, count(v)) for k, v in rules.items()]
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total


def check(df: DataFrame, contract: str) -> DataFrame:
    """df, or an error that names the broken rules: at most six rows reach the driver."""
    broken = violations(df, contract).collect()
    if broken:
        raise ValueError(f"contract {contract} broken: " + ", ".join(f"{r['rule']} ({r['n']})" for r in broken))
    return df
