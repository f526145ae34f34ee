"""Whole controls around an arm, each one plan over a cell key: nulls, transfer, temporal, caps, strata, random input, variants.

Splits are (gene, repeat, fold, y), label sets (label_set, gene). A cell (a resample, a rewiring, a stratum, ...) is a column of one propagation, never a round of a loop over arms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import uniform
from ..sources.shared import cut
from . import arms, graph, labels, metrics, ranks, resample, stability, stats

SEP = "\x1f"


def _col(keys: list[str]) -> F.Column:
    return F.concat_ws(SEP, *[F.col(c).cast("string") for c in keys])


def _training(splits: DataFrame, k: int = 5) -> DataFrame:
    """(repeat, fold, gene): the positives of every other fold."""
    return labels.fold_seeds(splits, k)


def cell_margins(edges: DataFrame, seeds: DataFrame, test: DataFrame, keys: list[str], alpha: float | tuple[float, ...] = 0.5, digits: int = 10, weights: DataFrame | None = None, scores: DataFrame | None = None, **how) -> DataFrame:
    """keys (and alpha, where several are given), rwr_auroc, degree_auroc, delta: of each cell's test rows (keys, gene, y) under propagation from its seeds (keys, gene) and under degree. All cells and alphas are one propagation; `scores` (col, gene, score): one that is there already."""
    alphas = alpha if isinstance(alpha, tuple) else (alpha,)
    by = [*keys, *(["alpha"] if isinstance(alpha, tuple) else [])]
    degree = cut(graph.degree(edges), "degree")
    test = cut(test.select(*keys, "gene", "y").join(degree, "gene").withColumn("col", _col(keys)), "test")
    p = scores if scores is not None else graph.rwr_series(edges, seeds.select(_col(keys).alias("col"), "gene").distinct(), alphas, weights=weights, only=test.select("col", "gene"), **how)
    scored = test.join(p, ["col", "gene"]).withColumn("score", F.round("score", digits))
    one = metrics.auroc(cut(scored.select(*by, "gene", "y", "score"), "scored"), by).withColumnRenamed("auroc", "rwr_auroc")
    other = metrics.auroc(test.select(*keys, "gene", "y", F.col("degree").cast("double").alias("score")), keys).withColumnRenamed("auroc", "degree_auroc")
    return one.join(other, keys).select(*by, "rwr_auroc", "degree_auroc", (F.col("rwr_auroc") - F.col("degree_auroc")).alias("delta"))


def seed_null(edges: DataFrame, splits: DataFrame, resamples: int = 100, alpha: float = 0.5, k: int = 5, seed: str = "null", **how) -> tuple[DataFrame, DataFrame]:
    """(resample, repeat, fold, rwr_auroc, degree_auroc, delta; resample -1 is the observed one) and one row of stats.null_z() with the one-sided p = (reached + 1) / (resamples + 1), over means of folds.

    Each fold's seeds are replaced, seed by seed, by genes of the same degree that are no seeds of the fold.
    """
    real = cut(_training(splits, k), "seeds")
    drawn = resample.degree_matched(cut(graph.degree(edges), "degree"), real, resamples, seed, ["repeat", "fold"]).select("resample", "repeat", "fold", "gene")
    seeds = real.withColumn("resample", F.lit(-1)).select("resample", "repeat", "fold", "gene").unionByName(drawn)
    test = splits.withColumn("resample", F.explode(F.sequence(F.lit(-1), F.lit(resamples - 1))))
    cells = cut(cell_margins(edges, seeds, test, ["resample", "repeat", "fold"], alpha, **how), "cells")
    return cells, null_summary(cells, "resample")


def null_summary(cells: DataFrame, key: str, kind: str = "sd") -> DataFrame:
    """One row: observed mean delta (key -1) against the mean deltas of the other keys: stats.null_z() and the rank p."""
    means = cells.groupBy(key).agg(F.avg("delta").alias("value"))
    own, null = means.where(F.col(key) < 0).select("value"), means.where(F.col(key) >= 0)
    z = stats.null_z(own, null, [], kind)
    reached = null.crossJoin(F.broadcast(own.select(F.col("value").alias("own")))).agg(((F.count_if(F.col("value") >= F.col("own")) + 1) / (F.count("*") + 1)).alias("p_rank"), F.count("*").alias("n_null"))
    return z.crossJoin(reached)


def rewiring_null(edges: DataFrame, splits: DataFrame, replicates: int = 100, swaps: float = 10.0, alpha: float = 0.5, k: int = 5, kind: str = "sd", **how) -> tuple[DataFrame, DataFrame]:
    """(rewire_id, repeat, fold, ..., delta; -1 is the network itself) and null_summary(): the arm on degree-preserving rewirings.

    The rewired networks stand side by side as one network whose genes carry the rewiring's number, so all of them are columns of one propagation.
    """
    every = edges.select(F.lit(-1).cast("long").alias("rewire_id"), "gene_a", "gene_b").unionByName(graph.rewire(edges, replicates, swaps).select("rewire_id", "gene_a", "gene_b"))
    name = lambda c: F.concat_ws(SEP, F.col("rewire_id").cast("string"), F.col(c).cast("string"))
    union = cut(every.select(name("gene_a").alias("gene_a"), name("gene_b").alias("gene_b"), F.lit(1.0).alias("weight")), "rewired")
    ids = every.select("rewire_id").distinct()
    own = lambda d: d.crossJoin(F.broadcast(ids)).withColumn("gene", name("gene"))
    cells = cut(cell_margins(union, own(_training(splits, k)), own(splits), ["rewire_id", "repeat", "fold"], alpha, **how), "cells")
    return cells, null_summary(cells, "rewire_id", kind)


def transfer(edges: DataFrame, seeds: DataFrame, pools: DataFrame, draws: int = 100, size: int = 1000, alpha: float = 0.5, seed: str = "transfer", **how) -> DataFrame:
    """draw, rwr_auroc, degree_auroc, delta, n_pos, n_test: targets (pools.role target) of one label under propagation from another's genes that are no targets, against hashed samples of the background."""
    degree = cut(graph.degree(edges), "degree")
    target = pools.where("role = 'target'").select("gene").distinct().join(degree.select("gene"), "gene", "left_semi")
    from_a = seeds.select("gene").distinct().join(target, "gene", "left_anti").withColumn("col", F.lit("a"))
    p = graph.rwr(edges, from_a.join(degree.select("gene"), "gene", "left_semi"), alpha, **how)
    scored = cut(p.select("gene", F.round("score", 10).alias("score")).join(degree, "gene"), "scored")
    back = pools.where("role = 'background'").select("gene").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = uniform(F.col("gene"), F.concat(F.lit(f"{seed}|"), F.col("draw").cast("string")))
    back = ranks.by_group(back.withColumn("_u", u), ["draw"], ["_u", "gene"]).where(F.col("_place") <= size).select("draw", "gene", F.lit(0).alias("y"))
    test = target.select(F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), "gene", F.lit(1).alias("y")).unionByName(back).join(scored, "gene")
    rows = test.select("draw", F.lit("rwr").alias("method"), "gene", "y", "score").unionByName(test.select("draw", F.lit("degree").alias("method"), "gene", "y", F.col("degree").cast("double").alias("score")))
    m = metrics.margins(metrics.auroc(rows, ["draw", "method"]), ["draw"], ["auroc"])
    n = test.groupBy("draw").agg(F.sum("y").cast("long").alias("n_pos"), F.count("*").alias("n_test"))
    return m.join(n, "draw").select("draw", "rwr_auroc", "degree_auroc", F.col("delta_auroc").alias("delta"), "n_pos", "n_test")


def temporal(edges: DataFrame, now: DataFrame, new: DataFrame, repeats: int = 50, alphas: tuple[float, ...] = (0.3, 0.5, 0.7), seed: str = "temporal", **how) -> DataFrame:
    """alpha, repeat, rwr_auroc, degree_auroc, delta, n_seeds: a later release's new genes against all others of the network, from the earlier genes drawn with replacement."""
    degree = cut(graph.degree(edges), "degree")
    pool = now.select("gene").distinct().join(new.select("gene"), "gene", "left_anti").join(degree.select("gene"), "gene", "left_semi")
    placed = cut(ranks.by_group(pool, [], ["gene"]).withColumn("i", F.col("_place") - 1).select("gene", "i"), "pool")
    n = placed.agg(F.count("*").alias("n"))
    grid = placed.crossJoin(F.broadcast(n)).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    u = uniform(F.col("i"), F.concat(F.lit(f"{seed}|"), F.col("repeat").cast("string")))
    seeds = cut(grid.select("repeat", F.floor(u * F.col("n")).alias("i")).distinct().join(placed, "i").select("repeat", "gene"), "seeds")
    y = degree.select("gene").join(new.select("gene", F.lit(1).alias("_y")).distinct(), "gene", "left").select("gene", F.coalesce("_y", F.lit(0)).alias("y"))
    test = y.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    size = seeds.groupBy("repeat").agg(F.count("*").alias("n_seeds"))
    return cell_margins(edges, seeds, test, ["repeat"], tuple(alphas), **how).join(size, "repeat")


def panel(universe: DataFrame, label_sets: DataFrame, repeats: int = 10, k: int = 5, seed: str = "20260926") -> DataFrame:
    """label_set, gene, repeat, fold, y: labels.stratified_splits() of each label set over one universe."""
    names = label_sets.select("label_set").distinct()
    y = universe.select("gene").distinct().crossJoin(F.broadcast(names)).join(label_sets.select("label_set", "gene", F.lit(1).alias("_p")).distinct(), ["label_set", "gene"], "left").select("label_set", "gene", F.coalesce("_p", F.lit(0)).alias("y"))
    grid = y.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    u = uniform(F.col("gene"), F.concat(F.lit(f"{seed}|"), F.col("repeat").cast("string")))
    placed = ranks.by_group(grid.withColumn("_u", u), ["label_set", "repeat", "y"], ["_u", "gene"])
    return placed.select("label_set", "gene", "repeat", ((F.col("_place") - 1) % k).cast("int").alias("fold"), "y")


def equal_size(edges: DataFrame, label_sets: DataFrame, repeats: int = 10, alphas: tuple[float, ...] = (0.5,), **how) -> DataFrame:
    """label_set, alpha, repeat, fold and margins: all label sets (label_set, gene, rank) cut to the size of the smallest in the network, by rank."""
    universe = cut(graph.degree(edges).select("gene"), "universe")
    splits = panel(universe, labels.cap_all(label_sets, universe), repeats)
    return arms.arm_margins(arms.run_arm(edges, splits, alphas, keys=("label_set",), **how), ["label_set"], ["auroc"])


def shared_universe(networks: dict[str, DataFrame], positives: DataFrame, repeats: int = 10, alphas: tuple[float, ...] = (0.5,), **how) -> DataFrame:
    """network, alpha, repeat, fold and margins over the genes that all networks have; degrees stay those of each whole network. Folds of one repeat differ by one gene a class at most, else it is an error."""
    universe = None
    for e in networks.values():
        genes = graph.degree(e).select("gene")
        universe = genes if universe is None else universe.intersect(genes)
    splits = cut(labels.stratified_splits(universe, positives, repeats), "splits")
    sizes = labels.split_sizes(splits)
    if not sizes.where("n_max - n_min > 2").isEmpty():
        raise ValueError("folds of the shared universe differ in size")
    out = None
    for name, e in networks.items():  # a handful, named by the caller
        m = arms.arm_margins(arms.run_arm(e, splits, alphas, **how), [], ["auroc"]).withColumn("network", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def matched_background(scores: DataFrame, counts: DataFrame, value: str = "log_n") -> DataFrame:
    """method, repeat, fold, standard, matched: AUROC against all negatives of a fold, and against one negative for each positive, the nearest in publication count that is still free."""
    keys = ["method", "repeat", "fold"]
    rows = cut(scores.select(*keys, "gene", "y", "score").join(counts.select("gene", value), "gene"), "counted")
    folds = rows.select("repeat", "fold", "gene", "y", value).distinct()
    pairs = resample.greedy_pairs(folds, ["repeat", "fold"], value)
    kept = pairs.select("repeat", "fold", F.explode(F.array("gene", "near")).alias("gene"))
    standard = metrics.auroc(rows, keys).withColumnRenamed("auroc", "standard")
    matched = metrics.auroc(rows.join(kept, ["repeat", "fold", "gene"], "left_semi"), keys).withColumnRenamed("auroc", "matched")
    return standard.join(matched, keys)


def seed_strata(edges: DataFrame, splits: DataFrame, alpha: float = 0.5, k: int = 5, **how) -> DataFrame:
    """stratum, repeat, fold, rwr_auroc, degree_auroc, delta, n_seeds: each fold's seeds cut into thirds by degree, each third propagated by itself."""
    seeds = _training(splits, k).join(graph.degree(edges), "gene")
    cut3 = cut(stability.strata(seeds, ["repeat", "fold"], "degree"), "strata")
    n = cut3.groupBy("stratum", "repeat", "fold").agg(F.count("*").alias("n_seeds"))
    test = splits.join(n.select("stratum", "repeat", "fold"), ["repeat", "fold"])
    return cell_margins(edges, cut3, test, ["stratum", "repeat", "fold"], alpha, **how).join(n, ["stratum", "repeat", "fold"])


def degree_percentile(degrees: DataFrame) -> DataFrame:
    """degrees with percentile: place in the order of degree and gene over n - 1, times 100."""
    place = F.when(F.col("_size") > 1, (F.col("_place") - 1) / (F.col("_size") - 1)).otherwise(F.lit(0.0))
    return ranks.by_group(degrees, [], ["degree", "gene"]).withColumn("percentile", place * 100).drop("_place", "_size")


def random_input(edges: DataFrame, splits: DataFrame, replicates: int = 10, top: int = 100, alpha: float = 0.5, k: int = 5, seed: str = "random", **how) -> tuple[DataFrame, DataFrame]:
    """Rankings under real and under random seeds of the same number, drawn outside the fold's test rows.

    First: run (-1 the real one), n_persistent (genes in the top of more than half the folds), top_percentile (mean degree percentile of the tops), hub_overlap (with the `top` genes of highest degree).
    Second: run, repeat, fold, rho (rank correlation with the real ranking), jaccard (of the tops).
    """
    by = ["run", "repeat", "fold"]
    degree = cut(degree_percentile(graph.degree(edges)), "degree")
    real = cut(_training(splits, k), "seeds")
    n = real.groupBy("repeat", "fold").agg(F.count("*").alias("n"))
    pool = degree.select("gene").crossJoin(n).join(splits.select("repeat", "fold", "gene"), ["repeat", "fold", "gene"], "left_anti").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = uniform(F.col("gene"), F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in by]))
    drawn = ranks.by_group(pool.withColumn("_u", u), by, ["_u", "gene"]).where("_place <= n")
    seeds = real.withColumn("run", F.lit(-1)).select(*by, "gene").unionByName(drawn.select(*by, "gene"))
    genes = splits.select("gene").distinct()
    cells = seeds.select(*by).distinct()
    asked = cut(genes.crossJoin(cells).withColumn("col", _col(by)), "asked")
    p = graph.rwr(edges, seeds.select(_col(by).alias("col"), "gene"), alpha, only=asked.select("col", "gene"), **how)
    scored = cut(asked.join(p.select("col", "gene", F.round("score", 10).alias("score")), ["col", "gene"]).select(*by, "gene", "score"), "scored")
    tops = cut(metrics.ranked(scored, by).where(F.col("rank") <= top).select(*by, "gene", "rank"), "tops")
    hubs = degree.orderBy(F.desc("degree"), "gene").limit(top).select("gene", F.lit(1).alias("hub"))
    about = tops.join(degree, "gene").join(F.broadcast(hubs), "gene", "left").groupBy("run").agg(F.avg("percentile").alias("top_percentile"), (F.sum(F.coalesce("hub", F.lit(0))) / F.count("*")).alias("hub_overlap"))
    folds = cells.groupBy("run").agg(F.count("*").alias("folds"))
    often = tops.groupBy("run", "gene").agg(F.count("*").alias("n")).join(folds, "run").where("n > folds / 2").groupBy("run").agg(F.count("*").alias("n_persistent"))
    own = scored.where("run = -1").select("repeat", "fold", "gene", F.col("score").alias("real"))
    rho = stats.spearman(scored.where("run >= 0").join(own, ["repeat", "fold", "gene"]), by, "score", "real").select(*by, "rho")
    real_top = tops.where("run = -1").select("repeat", "fold", "gene")
    both = tops.where("run >= 0").join(real_top, ["repeat", "fold", "gene"], "left_semi").groupBy(*by).agg(F.count("*").alias("both"))
    sizes = tops.groupBy(*by).agg(F.count("*").alias("size"))
    jac = sizes.where("run >= 0").join(both, by, "left").withColumn("b", F.coalesce("both", F.lit(0))).select(*by, (F.col("b") / (2 * F.col("size") - F.col("b"))).alias("jaccard"))
    return folds.select("run").join(often, "run", "left").join(about, "run").select("run", F.coalesce("n_persistent", F.lit(0)).alias("n_persistent"), "top_percentile", "hub_overlap"), rho.join(jac, by)


def seed_fractions(edges: DataFrame, splits: DataFrame, fractions: tuple[float, ...] = (1.0, 0.9, 0.7, 0.5), alpha: float = 0.5, k: int = 5, seed: str = "sub", **how) -> tuple[DataFrame, DataFrame]:
    """(fraction, repeat, fold, rwr_auroc, degree_auroc, delta) and (fraction, mean_rank_sd, n_seeds): the hashed first share of each fold's seeds; the SD of a gene's percentile rank over repeats, averaged."""
    train = _training(splits, k)
    w = Window.partitionBy("repeat", "fold")
    salted = uniform(F.col("gene"), F.concat_ws("|", F.lit(seed), F.col("repeat").cast("string"), F.col("fold").cast("string")))
    placed = train.withColumn("_r", F.row_number().over(w.orderBy(salted, "gene"))).withColumn("_n", F.count("*").over(w))
    grid = placed.withColumn("fraction", F.explode(F.array(*[F.lit(float(x)) for x in fractions])))
    by = ["fraction", "repeat", "fold"]
    seeds = cut(grid.where(F.col("_r") <= F.ceil(F.col("fraction") * F.col("_n"))).select(*by, "gene"), "seeds")
    test = cut(splits.withColumn("fraction", F.explode(F.array(*[F.lit(float(x)) for x in fractions]))).withColumn("col", _col(by)), "test")
    p = cut(graph.rwr(edges, seeds.select(_col(by).alias("col"), "gene"), alpha, only=test.select("col", "gene"), **how).select("col", "gene", "score"), "scores")
    cells = cell_margins(edges, seeds, test, by, alpha, scores=p)
    scores = test.join(p.select("col", "gene", F.round("score", 10).alias("score")), ["col", "gene"]).select("fraction", "repeat", "gene", "score")
    sd = stability.rank_sd(scores, ["fraction"]).groupBy("fraction").agg(F.avg("rank_sd").alias("mean_rank_sd"))
    size = seeds.groupBy(*by).count().groupBy("fraction").agg(F.avg("count").alias("n_seeds"))
    return cells, sd.join(size, "fraction")


def hub_variants(edges: DataFrame, splits: DataFrame, caps: tuple[int, ...] = (128, 256), beta: float = 0.5, alpha: float = 0.5, k: int = 5, **how) -> DataFrame:
    """variant, repeat, fold, rwr_auroc, degree_auroc, delta: the arm as it is (`full`), with a walk that degrees penalise (`degpen`), and without the edges of genes over a cap (`trunc{cap}`), for the test genes and seeds that are left.

    Variants are a handful, named by the caller; degree is that of the whole network throughout.
    """
    edges = cut(edges, "edges")
    degree = cut(graph.degree(edges), "degree")
    shapes = {"full": (edges, None), f"degpen{beta}": (edges, cut(graph.transition(edges, beta), "penalised"))} | {f"trunc{c}": (cut(graph.truncate_hubs(edges, c), "truncated"), None) for c in caps}
    out = None
    for name, (e, w) in shapes.items():
        if e.isEmpty():
            continue
        left = graph.degree(e).select("gene")
        seeds, test = _training(splits, k).join(left, "gene", "left_semi"), splits.join(left, "gene", "left_semi")
        by = ["repeat", "fold"]
        live = test.join(seeds.select(*by).distinct(), by, "left_semi")
        rwr = cell_margins(e, seeds, live, by, alpha, weights=w, **how).select(*by, "rwr_auroc")
        base = metrics.auroc(live.join(degree, "gene").withColumn("score", F.col("degree").cast("double")), by).withColumnRenamed("auroc", "degree_auroc")
        m = rwr.join(base, by).select(F.lit(name).alias("variant"), *by, "rwr_auroc", "degree_auroc", (F.col("rwr_auroc") - F.col("degree_auroc")).alias("delta"))
        out = m if out is None else out.unionByName(m)
    return out


def early_endpoints(scores: DataFrame, most: float = 0.02, share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(repeat, fold, excess, top_delta) and their means over repeats with t intervals: the partial AUC that propagation has over degree, in units of what a perfect ranking has over a random one, and the margin of the precision among the first share."""
    keys = ["method", "repeat", "fold"]
    pauc = metrics.margins(metrics.partial_auc(scores, keys, most), ["repeat", "fold"], ["pauc"])
    top = metrics.margins(metrics.precision_top(scores, keys, share), ["repeat", "fold"], ["p_top"])
    cells = cut(pauc.join(top, ["repeat", "fold"]).select("repeat", "fold", metrics.pauc_excess(F.col("rwr_pauc"), F.col("degree_pauc"), most).alias("excess"), F.col("delta_p_top").alias("top_delta")), "cells")
    long = cells.select("repeat", "fold", F.explode(F.create_map(F.lit("excess"), F.col("excess"), F.lit("top_delta"), F.col("top_delta"))).alias("endpoint", "delta"))
    return cells, stats.t_interval(stats.unit_values(long, ["endpoint"], "repeat"), ["endpoint"])


def bait_null(values: DataFrame, label: DataFrame, matching: str, draws: int = 1000, near: int = 10, seed: str = "bait") -> DataFrame:
    """kind (unmatched, matched), observed, null_mean, ratio, p: the mean value (gene, value) of a label's genes against hashed draws of as many other genes, and against draws in which each gene is replaced by one of its `near` nearest in another column."""
    inside = values.join(label.select("gene").distinct(), "gene", "left_semi")
    rest = cut(values.join(label.select("gene").distinct(), "gene", "left_anti"), "rest")
    pairs = cut(resample.matched_background(inside, rest, matching, near).select("gene", F.col("near").alias("other")).join(rest.select(F.col("gene").alias("other"), F.col("value").alias("v")), "other"), "near")
    grid = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    place = lambda salt, n: F.floor(uniform(F.col("gene"), F.concat(F.lit(salt), F.col("draw").cast("string"))) * n)
    # A gene draws from its own `near` values where they lie; rows that draws have multiplied meet no join that could send them to the driver.
    held = pairs.groupBy("gene").agg(F.transform(F.array_sort(F.collect_list(F.struct("other", "v"))), lambda x: x["v"]).alias("_v"))
    ask = held.select("gene", "_v", grid)
    matched = ask.select("draw", F.get("_v", place(f"{seed}|", F.size("_v")).cast("int")).alias("v")).groupBy("draw").agg(F.avg("v").alias("value"))
    numbered = ranks.by_group(rest, [], ["gene"]).select(F.col("value").alias("v"), (F.col("_place") - 1).alias("_p"))
    n = rest.agg(F.count("*").alias("_n"))
    free = inside.select("gene", grid).crossJoin(F.broadcast(n)).select("draw", place(f"{seed}|any|", F.col("_n")).alias("_p"))
    unmatched = free.join(numbered.hint("shuffle_hash"), "_p").groupBy("draw").agg(F.avg("v").alias("value"))
    null = unmatched.withColumn("kind", F.lit("unmatched")).unionByName(matched.withColumn("kind", F.lit("matched")))
    own = inside.agg(F.avg("value").alias("observed"))
    return null.crossJoin(F.broadcast(own)).groupBy("kind", "observed").agg(F.avg("value").alias("null_mean"), ((F.count_if(F.col("value") >= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p")).withColumn("ratio", F.col("observed") / F.col("null_mean"))


def circularity(degrees: DataFrame, label_sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label_set, n, mean_percentile, median_percentile) of the labels' degrees in the network, and labels.jaccard() of the label sets."""
    p = degree_percentile(degrees)
    own = label_sets.join(p, "gene").groupBy("label_set").agg(F.count("*").alias("n"), F.avg("percentile").alias("mean_percentile"), F.percentile("percentile", F.lit(0.5)).alias("median_percentile"))
    return own, labels.jaccard(label_sets)


def tier_margins(scores: DataFrame, tiers: DataFrame, noise: float = 0.0, seed: str = "tier") -> DataFrame:
    """tier, repeat, fold, rwr_auroc, degree_auroc, delta: the positives of each evidence tier (gene, tier) against all negatives of the fold; with `noise` that hashed share of the genes of the first tier (by name) counts as of the second."""
    keys = ["repeat", "fold", "method"]
    if noise:
        names = [r["tier"] for r in tiers.select("tier").distinct().orderBy("tier").limit(2).collect()]  # two names
        if len(names) == 2:
            tiers = tiers.withColumn("tier", F.when((F.col("tier") == names[0]) & (uniform(F.col("gene"), seed) < noise), names[1]).otherwise(F.col("tier")))
    pos = scores.where("y = 1").join(tiers.select("gene", "tier").distinct(), "gene").select("tier", *keys, "gene", "y", "score")
    neg = scores.where("y = 0").crossJoin(F.broadcast(tiers.select("tier").distinct())).select("tier", *keys, "gene", "y", "score")
    m = metrics.margins(metrics.auroc(pos.unionByName(neg), ["tier", *keys]), ["tier", "repeat", "fold"], ["auroc"])
    return m.select("tier", "repeat", "fold", "rwr_auroc", "degree_auroc", F.col("delta_auroc").alias("delta"))


def typed_arbitration(scored: DataFrame, known: DataFrame, untouched: DataFrame, kind: str, keys: list[str], least: int = 1) -> DataFrame:
    """kind, keys, n, auroc: controls.arbitration() for each type (a column of the untouched catalogue) with `least` genes or more, against genes that no type lists."""
    rest = scored.drop("y").join(known.select("gene").distinct(), "gene", "left_anti")
    listed = untouched.select("gene", kind).distinct()
    big = rest.select("gene").distinct().join(listed, "gene").groupBy(kind).agg(F.count_distinct("gene").alias("n")).where(F.col("n") >= least)
    pos = rest.join(listed, "gene").join(big.select(kind), kind, "left_semi").withColumn("y", F.lit(1))
    neg = rest.join(listed.select("gene").distinct(), "gene", "left_anti").crossJoin(F.broadcast(big.select(kind))).withColumn("y", F.lit(0))
    cols = [kind, *keys, "gene", "score", "y"]
    return metrics.auroc(pos.select(cols).unionByName(neg.select(cols)), [kind, *keys]).join(big, kind)


def consensus_left_out(ranks: DataFrame, run: str, targets: DataFrame) -> DataFrame:
    """left_out, auroc of the mean percentile rank over the other runs (networks), one run left out at a time, and of all (left_out null): from totals less the own value."""
    p = stability.percentile_ranks(ranks, [run]).withColumn("good", 1 - F.col("pct"))
    total = p.groupBy("gene").agg(F.sum("good").alias("s"), F.count("*").alias("n"))
    runs = p.select(F.col(run).alias("left_out")).distinct()
    grid = total.crossJoin(F.broadcast(runs)).join(p.select("gene", F.col(run).alias("left_out"), "good"), ["gene", "left_out"], "left")
    rest = grid.withColumn("n", F.col("n") - F.when(F.col("good").isNotNull(), 1).otherwise(0)).where("n > 0").select("left_out", "gene", ((F.col("s") - F.coalesce("good", F.lit(0.0))) / F.col("n")).alias("score"))
    every = rest.unionByName(total.select(F.lit(None).cast(p.schema[run].dataType).alias("left_out"), "gene", (F.col("s") / F.col("n")).alias("score")))
    y = every.join(targets.select("gene", F.lit(1).alias("_y")).distinct(), "gene", "left").withColumn("y", F.coalesce("_y", F.lit(0))).withColumn("score", F.round("score", 10))
    return metrics.auroc(y.withColumn("k", F.coalesce(F.col("left_out").cast("string"), F.lit(""))), ["k"]).select(F.nullif(F.col("k"), F.lit("")).alias("left_out"), "auroc")


def reliable_consensus(ranks: DataFrame, run: str, reliability: DataFrame) -> DataFrame:
    """gene, weighted_rank: the mean percentile rank (1 the best) over runs, weighted by each run's reliability (run, weight)."""
    p = stability.percentile_ranks(ranks, [run]).withColumn("good", 1 - F.col("pct")).join(reliability.select(run, "weight"), run)
    return p.groupBy("gene").agg((F.sum(F.col("good") * F.col("weight")) / F.sum("weight")).alias("weighted_rank"))


def embedding_margins(vectors: DataFrame, edges: DataFrame, splits: DataFrame, k: int = 5) -> DataFrame:
    """repeat, fold, rwr_auroc (of the cosine to the mean vector of the fold's seeds), degree_auroc, delta: embedded genes (gene, vector) as another learner."""
    from ..functions.columns import cosine

    train = _training(splits, k).join(vectors, "gene").select("repeat", "fold", F.posexplode("vector").alias("i", "x"))
    mean = train.groupBy("repeat", "fold", "i").agg(F.avg("x").alias("x")).groupBy("repeat", "fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    rows = splits.join(vectors, "gene").join(mean, ["repeat", "fold"]).join(graph.degree(edges), "gene")
    both = rows.select("repeat", "fold", "gene", "y", F.explode(F.create_map(F.lit("rwr"), F.round(cosine(F.col("vector"), F.col("mean")), 10), F.lit("degree"), F.col("degree").cast("double"))).alias("method", "score"))
    m = metrics.margins(metrics.auroc(both, ["repeat", "fold", "method"]), ["repeat", "fold"], ["auroc"])
    return m.select("repeat", "fold", "rwr_auroc", "degree_auroc", F.col("delta_auroc").alias("delta"))


def fold_shift(splits: DataFrame, shift: int, k: int = 5) -> DataFrame:
    """splits whose fold numbers are moved round by `shift`."""
    return splits.withColumn("fold", F.pmod(F.col("fold") + shift, F.lit(k)).cast("int"))
