"""Arms: a network, a label set and splits in, fold metrics out; and the controls built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from . import graph, metrics


def check_genes(splits: DataFrame, degree: DataFrame) -> None:
    """An error if a gene of the splits is not in its network."""
    net = graph.networks(degree)
    missing = splits.select(*net, "gene").distinct().join(degree.select(*net, "gene"), [*net, "gene"], "left_anti")
    n = missing.count()
    if n:
        some = ", ".join(str(r["gene"]) for r in missing.orderBy("gene").limit(3).collect())
        raise ValueError(f"{n} genes of the splits are not in the network: {some}")


def fold_scores(edges: DataFrame, splits: DataFrame, alphas: tuple[float, ...] = (0.5,), tol: float = 1e-8, max_iter: int = 200, digits: int = 10, k: int = 5, strategy: str = "auto", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, repeat, fold, method, alpha, n_iter, converged, gene, y, score: the test rows of every fold, scored by propagation from the other folds' positives and by degree.

    `keys` are columns of the splits (label_set, resample, ...) that tell arms apart; where edges carry a `network` column, it is one of them. All arms, folds, alphas and networks are columns of one propagation, and only
    test rows come back. Genes outside their network are an error. Scores are rounded before they are ranked, so summation order does not matter.
    """
    edges, net = cut(edges, "edges"), graph.networks(edges)
    degree = cut(graph.degree(edges), "degree")
    splits = cut(splits, "splits")
    check_genes(splits, degree)
    by = [*dict.fromkeys([*net, *keys, "repeat", "fold"])]
    column = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in by])
    others = F.array_except(F.sequence(F.lit(0), F.lit(k - 1)), F.array("fold"))
    seeds = splits.where("y = 1").withColumn("fold", F.explode(others)).select(*net, column.alias("col"), "gene")
    test = cut(splits.withColumn("col", column).join(degree, [*net, "gene"]), "test")
    seeds = seeds.join(test.select("col").distinct(), "col", "left_semi")
    none = lambda t: F.lit(None).cast(t)
    own = test.select(*by, F.lit("degree").alias("method"), none("double").alias("alpha"), none("int").alias("n_iter"), none("boolean").alias("converged"), "gene", "y", F.col("degree").cast("double").alias("score"))
    p = graph.rwr_series(edges, seeds, alphas, tol, max_iter, strategy, None, test.select(*net, "col", "gene")).drop(*net)
    return own.unionByName(test.join(p, ["col", "gene"]).select(*by, F.lit("rwr").alias("method"), "alpha", "n_iter", "converged", "gene", "y", F.round("score", digits).alias("score")))


def run_arm(edges: DataFrame, splits: DataFrame, alphas: tuple[float, ...] = (0.5,), ks: tuple[int, ...] = (50, 100, 500), keys: tuple[str, ...] = (), scores: DataFrame | None = None, **how) -> DataFrame:
    """The result table of the arms of one network: keys, alpha, repeat, fold, method, n_iter and the metrics; degree rows have a null alpha. `scores`: fold_scores() that are there already."""
    # alpha as text: keys that are doubles are normalised anew by every step, which then shuffles again
    scored = (scores if scores is not None else fold_scores(edges, splits, alphas, keys=keys, **how)).withColumn("_a", F.coalesce(F.col("alpha").cast("string"), F.lit("")))
    scored, by = cut(scored, "scores"), [*keys, "_a", "repeat", "fold", "method"]
    rounds = scored.groupBy(*by).agg(F.max("n_iter").alias("n_iter"))
    m = metrics.all_metrics(scored, by, ks).join(rounds, by)
    return m.withColumn("alpha", F.when(F.col("_a") != "", F.col("_a").cast("double"))).drop("_a")


def result_table(results: DataFrame, network: str, label_set: str, universe: str) -> DataFrame:
    """run_arm()'s rows under the columns of the result contract, in their order."""
    from ..sources.tables import RESULT

    named = results.withColumns({"network": F.lit(network), "label_set": F.lit(label_set), "universe": F.lit(universe)})
    return named.select(*[(F.col(f.name) if f.name in named.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RESULT.fields])


def dump_check(scores: DataFrame, results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, method, alpha, repeat, fold, gap: how far the AUROC recomputed from dumped scores lies from the result table's; the largest gap should stay under 1e-12."""
    by = [*keys, "method", "_a", "repeat", "fold"]
    again = metrics.auroc(scores.withColumn("_a", F.coalesce("alpha", F.lit(-1.0))), by).withColumnRenamed("auroc", "again")
    return results.withColumn("_a", F.coalesce("alpha", F.lit(-1.0))).join(again, by).select(*keys, "method", "alpha", "repeat", "fold", F.abs(F.col("auroc") - F.col("again")).alias("gap"))


def arm_margins(results: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, alpha, repeat, fold and margins over degree: every alpha of a fold meets the fold's one degree row."""
    degree = results.where("method = 'degree'").select(*keys, "repeat", "fold", *[F.col(m).alias(f"degree_{m}") for m in names])
    rwr = results.where("method = 'rwr'").select(*keys, "alpha", "repeat", "fold", *[F.col(m).alias(f"rwr_{m}") for m in names])
    both = rwr.join(degree, [*keys, "repeat", "fold"])
    return both.select(*keys, "alpha", "repeat", "fold", *[c for m in names for c in ((F.col(f"rwr_{m}") - F.col(f"degree_{m}")).alias(f"delta_{m}"), f"rwr_{m}", f"degree_{m}")])


def side_by_side(networks: dict[str, DataFrame]) -> DataFrame:
    """One edge table of several, told apart by `network`."""
    out = None
    for name, edges in networks.items():  # a handful, named by the caller
        e = edges.select(F.lit(name).alias("network"), "gene_a", "gene_b", "weight")
        out = e if out is None else out.unionByName(e)
    return out


def factorial(networks: dict[str, DataFrame] | DataFrame, splits: DataFrame, alphas: tuple[float, ...], **how) -> DataFrame:
    """network, label_set and the results of every arm: all networks, label sets, folds and alphas are one propagation.

    networks: edge tables by name, or one with a `network` column. Splits carry label_set and, where networks have splits of their own, network; otherwise every network takes all of them.
    """
    edges = cut(side_by_side(networks) if isinstance(networks, dict) else networks, "networks")
    if "network" not in splits.columns:
        splits = splits.crossJoin(edges.select("network").distinct())  # one row a network
    return run_arm(edges, splits, alphas, keys=("network", "label_set"), **how)


def table_one(margins: DataFrame, keys: list[str], alphas: tuple[float, ...], value: str = "delta_auroc") -> DataFrame:
    """keys and a{alpha}_mean, a{alpha}_std, a{alpha}_n: the values of the pivot are given, so it costs one aggregate."""
    at = lambda a: F.when(F.col("alpha") == a, F.col(value))
    return margins.groupBy(*keys).agg(*[c for a in alphas for c in (F.avg(at(a)).alias(f"a{a}_mean"), F.stddev_samp(at(a)).alias(f"a{a}_std"), F.count(at(a)).alias(f"a{a}_n"))])


def seed_null(edges: DataFrame, seeds: DataFrame, targets: DataFrame, resamples: int = 20, alpha: float = 0.5, seed: str = "null", **how) -> DataFrame:
    """resample, auroc of the targets (gene, y) under propagation from degree-matched random seeds; all resamples are columns of one propagation."""
    from .resample import degree_matched

    drawn = degree_matched(graph.degree(edges), seeds, resamples, seed)
    p = graph.rwr(edges, drawn.select(F.col("resample").cast("string").alias("col"), "gene"), alpha, **how)
    scored = p.join(targets.select("gene", "y"), "gene").select(F.col("col").cast("int").alias("resample"), "gene", F.round("score", 10).alias("score"), "y")
    return metrics.auroc(scored, ["resample"])


def baselines(edges: DataFrame, landmarks: DataFrame) -> DataFrame:
    """method, gene, score: degree, closeness, eigenvector and pagerank side by side for one metric pass."""
    tag = lambda name, d, c: d.select(F.lit(name).alias("method"), "gene", F.round(F.col(c).cast("double"), 10).alias("score"))
    return tag("degree", graph.degree(edges), "degree").unionByName(tag("closeness", graph.harmonic(edges, landmarks), "closeness")).unionByName(tag("eigenvector", graph.eigenvector(edges), "score")).unionByName(tag("pagerank", graph.pagerank(edges), "score"))
