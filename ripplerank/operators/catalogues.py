"""Catalogue and network builders: raw tables in, contract tables (gene, rank, source, release or edges with counts) out."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import harmonic_sum, split_multi
from . import graph, labels, ranks

#: The weight of each class of evidence of a gene-disease curation.
EVIDENCE = {"Definitive": 1.0, "Strong": 1.0, "Moderate": 0.5, "Limited": 0.0, "Disputed": 0.0, "Refuted": 0.0, "No Known Disease Relationship": 0.0}


def ranked(scores: DataFrame, source: str, release: str, by: str = "score") -> DataFrame:
    """gene, rank, source, release of (gene, score): the highest first, ties by gene. One label catalogue's genes."""
    placed = ranks.by_group(scores, [], [F.desc(by), "gene"])
    return placed.select("gene", F.col("_place").cast("int").alias("rank"), F.lit(source).alias("source"), F.lit(release).alias("release"))


def mapped(rows: DataFrame, column: str, mapping: DataFrame, kind: str = "symbol") -> DataFrame:
    """rows whose id maps, with the approved symbol as `gene`."""
    return labels.map_ids(rows, column, mapping, kind).where("mapped is not null").withColumnRenamed("mapped", "gene")


def is_approved(rows: DataFrame, column: str, nomenclature: DataFrame) -> DataFrame:
    """rows with approved: whether the name is an approved symbol as it stands."""
    names = nomenclature.select(F.trim("symbol").alias("_s"), F.lit(True).alias("_in")).distinct()
    return rows.join(names, F.col(column) == F.col("_s"), "left").withColumn("approved", F.coalesce("_in", F.lit(False))).drop("_s", "_in")


def explode_map(nomenclature: DataFrame, columns: tuple[str, ...] = ("prev_symbol", "alias_symbol", "ensembl_gene_id", "uniprot_ids")) -> DataFrame:
    """A row for each combination of the values of the multi-valued columns of a nomenclature row; an empty cell gives a null."""
    out = nomenclature
    for c in columns:
        values = split_multi(F.col(c))
        out = out.withColumn(c, F.explode_outer(F.when(F.size(values) > 0, values)))
    return out


def drivers(rows: DataFrame, mapping: DataFrame, release: str, source: str = "intogen") -> DataFrame:
    """The label of a driver compendium (SYMBOL, CANCER_TYPE): genes by the number of distinct cancer types."""
    from ..sources.scans import need

    m = mapped(need(rows, ["SYMBOL", "CANCER_TYPE"]), "SYMBOL", mapping)
    return ranked(m.groupBy("gene").agg(F.count_distinct("CANCER_TYPE").alias("score")), source, release)


def cancer_ids(diseases: DataFrame, area: str) -> DataFrame:
    """(id) of the diseases (id, therapeuticAreas, ancestors) that stand in an area or below it; null lists hold nothing."""
    inside = lambda c: F.coalesce(F.array_contains(c, area), F.lit(False))
    return diseases.where(inside("therapeuticAreas") | inside("ancestors")).select("id").distinct()


def validity(rows: DataFrame, cancers: DataFrame, mapping: DataFrame, release: str, source: str = "clingen_cancer_validity", weights: dict[str, float] | None = None) -> DataFrame:
    """The label of a gene-disease curation (symbol, disease, classification): summed weights of the classes over the cancer diseases (id), classes of weight 0 left out."""
    weight = F.create_map(*[F.lit(x) for x in chain(*(weights or EVIDENCE).items())])
    inside = rows.withColumn("id", F.replace("disease", F.lit(":"), F.lit("_"))).join(cancers.select("id").distinct(), "id", "left_semi")
    kept = inside.withColumn("weight", F.coalesce(F.try_element_at(weight, F.col("classification")), F.lit(0.0))).where("weight > 0")
    return ranked(mapped(kept, "symbol", mapping).groupBy("gene").agg(F.sum("weight").alias("score")), source, release)


def catalogue(genes: DataFrame, known: DataFrame, candidates: DataFrame, screens: DataFrame, nomenclature: DataFrame) -> DataFrame:
    """symbol, entrez, tier, is_oncogene, is_tsg, cancer_type, primary_site, n_publications, symbol_hgnc, matches: four sheets joined into one row a gene.

    genes (symbol, entrez); known (symbol, oncogene, tsg); candidates (symbol); screens (symbol, publication, cancer_type, primary_site). Known beats candidate, the rest are screening. Types and sites are all that any
    screen names ("-", "nan" and empty name none), sorted; "multiple" stands as a site only where no specific one is named. The symbol is checked against the nomenclature's for the same entrez id.
    """
    named = lambda c: F.array_sort(F.collect_set(F.when(~F.col(c).isin("", "-", "nan"), F.col(c))))
    per = screens.groupBy("symbol").agg(F.count_distinct("publication").cast("int").alias("n_publications"), named("cancer_type").alias("types"), named("primary_site").alias("sites"))
    specific = F.array_remove("sites", "multiple")
    per = per.select("symbol", "n_publications", F.array_join("types", ";").alias("cancer_type"), F.array_join(F.when(F.size(specific) > 0, specific).otherwise(F.col("sites")), ";").alias("primary_site"))
    role = known.groupBy("symbol").agg(F.max("oncogene").cast("int").alias("is_oncogene"), F.max("tsg").cast("int").alias("is_tsg")).withColumn("_known", F.lit(True))
    cand = candidates.select("symbol").distinct().withColumn("_candidate", F.lit(True))
    ids = nomenclature.select(F.explode(F.split("entrez_id", ";")).alias("entrez"), F.col("symbol").alias("symbol_hgnc")).withColumn("entrez", F.trim("entrez")).where("entrez rlike '^[0-9]+$'")
    ids = ids.groupBy("entrez").agg(F.min("symbol_hgnc").alias("symbol_hgnc"))
    out = genes.select("symbol", F.col("entrez").cast("string").alias("entrez")).join(per, "symbol", "left").join(role, "symbol", "left").join(cand, "symbol", "left").join(ids, "entrez", "left")
    tier = F.when(F.col("_known"), "known").when(F.col("_candidate"), "candidate").otherwise("screening")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return out.select("symbol", "entrez", tier.alias("tier"), zero("is_oncogene"), zero("is_tsg"), text("cancer_type"), text("primary_site"), zero("n_publications"), text("symbol_hgnc"), F.coalesce(F.col("symbol") == F.col("symbol_hgnc"), F.lit(False)).alias("matches"))


def association_labels(scores: DataFrame, targets: DataFrame, cancers: DataFrame, n: int, release: str, without: str | None = None, source: str = "associations") -> DataFrame:
    """The label of association scores (targetId, diseaseId, datasourceId, score): the n genes (targets: id, symbol) of highest score for any cancer disease (id).

    A gene's score for a disease is the largest of its sources; with `without` the harmonic sum of the sources other than that one.
    """
    rows = scores.join(cancers.select(F.col("id").alias("diseaseId")).distinct(), "diseaseId", "left_semi").join(targets.select(F.col("id").alias("targetId"), F.col("symbol").alias("gene")), "targetId")
    if without is not None:
        rows = rows.where(F.col("datasourceId") != without).groupBy("gene", "diseaseId").agg(F.collect_list("score").alias("s")).select("gene", harmonic_sum(F.col("s")).alias("score"))
    return labels.top_labels(rows.select("gene", "score"), n, source, release)


def evidence_tiers(rows: DataFrame, strong: list[str], least: int = 2) -> DataFrame:
    """gene, tier, sources: `only_weak` where all sources of a gene are outside `strong`, `strong` with `least` strong ones or more, else `mixed`; sources are the sorted distinct names."""
    names = F.array_sort(F.collect_set("source"))
    inside = F.array(*[F.lit(x) for x in strong])
    per = rows.groupBy("gene").agg(names.alias("sources"))
    n = F.size(F.array_intersect("sources", inside))
    return per.select("gene", F.when(F.forall("sources", lambda x: ~F.array_contains(inside, x)), "only_weak").when(n >= least, "strong").otherwise("mixed").alias("tier"), "sources")


def star_tiers(rows: DataFrame, cuts: dict[str, float]) -> DataFrame:
    """gene, tier of (gene, value): the first tier of `cuts` (name to least value, highest first) that a gene's largest value reaches; none: `rest`."""
    tier = None
    for name, least in cuts.items():
        tier = F.when(F.col("value") >= least, name) if tier is None else tier.when(F.col("value") >= least, name)
    return rows.groupBy("gene").agg(F.max("value").alias("value")).select("gene", tier.otherwise("rest").alias("tier"))


def complex_map(rows: DataFrame, by_accession: DataFrame, source: str) -> DataFrame:
    """complex_id, gene, uniprot, source, n_members of (complex_id, members: accessions with separators): members that map (uniprot, gene), with the number of the complex's rows: two accessions of one gene are two members."""
    each = rows.select("complex_id", F.explode(split_multi(F.regexp_replace("members", "[;,]", "|"))).alias("uniprot")).withColumn("uniprot", F.substring_index("uniprot", "-", 1))
    named = each.join(by_accession.select("uniprot", "gene"), "uniprot").select("complex_id", "gene", "uniprot").distinct()
    n = named.groupBy("complex_id").agg(F.count("*").cast("int").alias("n_members"))
    return named.join(n, "complex_id").select("complex_id", "gene", "uniprot", F.lit(source).alias("source"), "n_members")


def build_network(raw: DataFrame, name: str, mapping: DataFrame | None = None, kind: str = "symbol", least: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, counts) of raw pairs (a, b, weight): those of `least` weight or more, ids mapped to symbols (unmapped ones count as such), cleaned to the largest component. Every network builder is this over one of the scans."""
    rows = raw if least is None else raw.where(F.col("weight") >= least)
    if mapping is not None:
        for c in ("a", "b"):
            rows = labels.map_ids(rows, c, mapping, kind).drop(c).withColumnRenamed("mapped", c)
    return graph.finalize(rows.select(F.col("a").alias("gene_a"), F.col("b").alias("gene_b"), "weight"), name)


def build_networks(raw: DataFrame, name: str, thresholds: list[float], mapping: DataFrame | None = None, kind: str = "symbol") -> dict[str, tuple[DataFrame, DataFrame]]:
    """One network for each threshold of the weight: name700 for 0.7."""
    return {f"{name}{round(1000 * x)}": build_network(raw, f"{name}{round(1000 * x)}", mapping, kind, x) for x in thresholds}


def best_channel(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with best (the largest of some columns) and channel (which column that is, the first of equal ones); nulls are passed over."""
    pairs = F.array(*[F.struct(F.col(c).cast("double").alias("v"), F.lit(-i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(columns)])
    top = F.array_max(F.filter(pairs, lambda x: x["v"].isNotNull()))
    return rows.withColumn("best", top["v"]).withColumn("channel", top["name"])
