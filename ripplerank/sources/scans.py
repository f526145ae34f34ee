"""Readers of the raw inputs, each with the shape that its source has, and the sinks that go with them."""

from __future__ import annotations

import re

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables

#: Columns that a gene nomenclature table has to have.
NOMENCLATURE = ["symbol", "status", "prev_symbol", "alias_symbol", "entrez_id", "ensembl_gene_id", "uniprot_ids"]
#: The leading columns of a tab-separated interaction file of 15 columns, by place.
INTERACTION = ["id_a", "id_b", "alt_a", "alt_b", "alias_a", "alias_b", "method", "author", "publication", "taxid_a", "taxid_b", "kind", "database", "interaction", "confidence"]
#: Columns of a pathway interaction file without a header, by place.
PATHWAY = ["uniprot_a", "ensembl_a", "entrez_a", "uniprot_b", "ensembl_b", "entrez_b", "kind", "context", "publications"]


def need(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_network(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(genes in order, (src, dst) from either end) of a written network; the contract is checked."""
    from ..operators.graph import directed

    edges = tables.check(tables.read_tsv(spark, path, tables.NETWORK), "network")
    both = directed(edges).select("src", "dst")
    return both.select(F.col("src").alias("gene")).distinct().orderBy("gene"), both


def read_nomenclature(spark: SparkSession, path: str) -> DataFrame:
    """The approved rows of a nomenclature table, all columns strings."""
    return need(tables.read_tsv(spark, path), NOMENCLATURE).where("status = 'Approved'")


def read_links(spark: SparkSession, path: str, prefix: str = "9606.") -> DataFrame:
    """(a, b, weight) of a space-separated link file with a header, prefixed names and scores in thousandths."""
    return tables.string_edges(need(tables.read_tsv(spark, path, sep=" "), ["protein1", "protein2", "combined_score"]), prefix)


def read_interactions(spark: SparkSession, path: str, taxon: str = "9606") -> DataFrame:
    """(a, b, weight) of a 15-column interaction file: both ends of the taxon, names after the first colon of their id, weight from the confidence cell."""
    raw = tables.read_tsv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in INTERACTION]))
    name = lambda c: F.regexp_extract(c, r"^[^:]+:([^|]+)", 1)
    return raw.where(F.col("taxid_a").contains(taxon) & F.col("taxid_b").contains(taxon)).select(name("id_a").alias("a"), name("id_b").alias("b"), tables.mi_score("confidence").alias("weight")).where("a <> '' and b <> ''")


def read_pathway(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, weight 1) of a pathway interaction file: no header, lines with # are comments, nine columns."""
    raw = tables.read_tsv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in PATHWAY]), header=False, comment="#")
    name = lambda c: F.regexp_extract(c, r"^(?:[^:]+:)?(.+)$", 1)
    return raw.select(name("uniprot_a").alias("a"), name("uniprot_b").alias("b"), F.lit(1.0).alias("weight"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, weight 1) of two columns without a header."""
    raw = tables.read_tsv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b")]), header=False)
    return raw.withColumn("weight", F.lit(1.0))


def read_counts(spark: SparkSession, path: str, taxon: str = "9606") -> DataFrame:
    """(gene, n) of a gene-to-publication file (gz too) whose header begins with #: distinct publications of a taxon's genes."""
    raw = tables.read_tsv(spark, path)
    raw = need(raw.toDF(*[c.lstrip("#").strip().lower() for c in raw.columns]), ["tax_id", "geneid", "pubmed_id"])
    return raw.where(F.col("tax_id") == taxon).groupBy(F.col("geneid").alias("gene")).agg(F.count_distinct("pubmed_id").alias("n"))


def read_preamble(spark: SparkSession, path: str, schema: str, skip: int, divider: str = "+++") -> DataFrame:
    """Rows of small CSV files with `skip` lines before the header: rows whose first cell begins with the divider go. A file is read as one value."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("no", "line")).where(F.col("no") > skip)
    rows = lines.select(F.from_csv("line", F.lit(schema), {"mode": "PERMISSIVE"}).alias("r"), "line").where(F.trim("line") != "").select("r.*")
    first = rows.columns[0]
    return rows.where(F.col(first).isNotNull() & ~F.col(first).cast("string").startswith(divider))


def read_wide(spark: SparkSession, path: str, key: str, value: str = "value", default: str | None = None, meta: tuple[str, ...] = ()) -> DataFrame:
    """(key, gene, value) of a wide CSV, a column a gene: what stands in brackets behind a name goes.

    Of the lines that repeat a key one stays whole, the first in the file (by file name, then by where it stands); with `default`, the name of a flag column, only lines that it marks (yes, true, 1) count. `meta` are other columns that hold no gene.
    """
    raw = need(spark.read.option("header", True).csv(path), [key, *([default] if default else [])])
    genes = [c for c in raw.columns if c not in {key, default, *meta}]
    lines = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    if default:
        lines = lines.where(F.upper(F.trim(F.col(f"`{default}`"))).isin("YES", "TRUE", "1"))
    cells = F.array(*[F.struct(F.lit(re.sub(r" \([^)]*\)$", "", c)).alias("gene"), F.expr(f"try_cast(`{c}` as double)").alias("value")) for c in genes])
    first = lines.groupBy(F.col(f"`{key}`").alias(key)).agg(F.min_by(cells, F.struct("_file", "_line")).alias("cells"))
    return first.select(key, F.explode("cells").alias("c")).select(key, F.col("c.gene").alias("gene"), F.col("c.value").alias(value)).where(F.col(value).isNotNull())


def read_members(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(archive, member, no, line) of the text members of tar (gz too) and zip archives whose names end so: UTF-8, else Latin-1. A task holds one archive at a time and gives its lines on member by member."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                held = io.BytesIO(content)
                if zipfile.is_zipfile(held):
                    with zipfile.ZipFile(held) as z:
                        parts = [(m, z.read(m)) for m in sorted(z.namelist()) if m.endswith(suffix)]
                else:
                    held.seek(0)
                    with tarfile.open(fileobj=held) as t:
                        parts = [(m.name, t.extractfile(m).read()) for m in sorted(t.getmembers(), key=lambda m: m.name) if m.isfile() and m.name.endswith(suffix)]
                for member, raw in parts:
                    try:
                        text = raw.decode("utf-8")
                    except UnicodeDecodeError:
                        text = raw.decode("latin-1")
                    lines = text.splitlines()
                    for lo in range(0, len(lines), 10_000):
                        part = lines[lo : lo + 10_000]
                        yield pd.DataFrame({"archive": name, "member": member, "no": range(lo, lo + len(part)), "line": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, no long, line string")


def matrix(members: DataFrame, sep: str = "\t") -> DataFrame:
    """(member, gene, sample, value) of members that hold a matrix: samples in the first line, genes in the first column; cells that are no numbers go."""
    cells = members.withColumn("cell", F.split("line", sep))
    head = cells.where("no = 0").select("archive", "member", F.slice("cell", 2, 1 << 30).alias("samples"))
    rows = cells.where("no > 0").join(head, ["archive", "member"]).select("member", F.col("cell")[0].alias("gene"), F.explode(F.arrays_zip("samples", F.slice("cell", 2, 1 << 30).alias("v"))).alias("x"))
    return rows.select("member", "gene", F.col("x.samples").alias("sample"), F.expr("try_cast(x.v as double)").alias("value")).where("value is not null")


def expressed(values: DataFrame, most: float = 0.5) -> DataFrame:
    """Rows (cohort, gene, sample, value) of the genes of which less than that share of the values is 0."""
    keep = values.groupBy("cohort", "gene").agg(F.avg((F.col("value") == 0).cast("double")).alias("zero")).where(F.col("zero") < most)
    return values.join(keep.select("cohort", "gene"), ["cohort", "gene"], "left_semi")


def unreadable_parts(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the Parquet files below a folder that do not begin and end as such: what read_parts() would skip. Reads them whole; a check for a delivery, not for each scan."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    mark = F.lit("PAR1").cast("binary")
    return raw.where((F.substring("content", 1, 4) != mark) | (F.expr("substring(content, -4, 4)") != mark)).select("path")


def write_network(edges: DataFrame, counts: DataFrame, path: str) -> None:
    """The edges of a network and, beside them, the row of counts of its cleaning as JSON with the day it was written."""
    tables.write_tsv(edges.select("gene_a", "gene_b", "weight"), f"{path}/edges")
    day = counts.withColumn("date", F.date_format(F.current_date(), "yyyy-MM-dd"))
    day.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/meta")


def read_meta(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The counts that write_network() wrote, with their day as a date."""
    raw = spark.read.text(f"{path}/meta").select(F.from_json("value", schema + ", date string").alias("m")).select("m.*")
    return raw.withColumn("date", F.to_date("date"))


def write_scores(scores: DataFrame, path: str, keys: list[str]) -> None:
    """Score dumps, a folder for each cell (arm): a cell that is written again replaces its own files and no others, so a broken run goes on where it stopped."""
    scores.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_scores(spark: SparkSession, path: str, alpha: float | None = None) -> DataFrame:
    """Dumped scores; with alpha those of the nearest alpha that was dumped, and the rows without one (degree)."""
    scores = spark.read.parquet(path)
    if alpha is None:
        return scores
    near = scores.where("alpha is not null").select("alpha").distinct().orderBy(F.abs(F.col("alpha") - alpha), "alpha").limit(1).select(F.col("alpha").alias("near"))
    return scores.crossJoin(F.broadcast(near)).where("alpha is null or alpha = near").drop("near")
