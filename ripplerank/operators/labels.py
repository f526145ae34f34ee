"""Identifier maps and label catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import split_multi, uniform
from ..sources.shared import cut
from . import ranks


def symbol_map(table: DataFrame) -> DataFrame:
    """(key, symbol) of rows (symbol, prev_symbol, alias_symbol), keys in capitals: approved names stand for themselves; of previous and alias names those that name one symbol only."""
    approved = table.select(F.upper(F.trim("symbol")).alias("key"), F.trim("symbol").alias("symbol")).where("key <> ''").distinct()
    other = [table.select(F.explode(split_multi(F.col(c))).alias("key"), F.trim("symbol").alias("symbol")).withColumn("key", F.upper("key")) for c in ("prev_symbol", "alias_symbol")]
    loose = other[0].unionByName(other[1]).join(approved.select("key"), "key", "left_anti")
    clear = loose.groupBy("key").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("symbol")).where("n = 1")
    return approved.groupBy("key").agg(F.min("symbol").alias("symbol")).unionByName(clear.select("key", "symbol"))


def id_map(table: DataFrame, column: str, strip: str | None = None) -> DataFrame:
    """(key, symbol) of a multi-valued id column; with strip (`.` or `-`) what follows it goes; keys of several symbols go."""
    keys = table.select(F.explode(split_multi(F.col(column))).alias("key"), F.trim("symbol").alias("symbol"))
    if strip:
        keys = keys.withColumn("key", F.substring_index("key", strip, 1))
    return keys.groupBy("key").agg(F.count_distinct("symbol").alias("n"), F.min("symbol").alias("symbol")).where("n = 1").select("key", "symbol")


def map_ids(df: DataFrame, column: str, mapping: DataFrame, kind: str) -> DataFrame:
    """df with `mapped`: null where empty, unknown or ambiguous. Kinds: symbol (in capitals), entrez, ensembl (version cut), uniprot (isoform cut)."""
    key = {"symbol": F.upper(F.trim(column)), "entrez": F.trim(column), "ensembl": F.substring_index(F.trim(column), ".", 1), "uniprot": F.substring_index(F.trim(column), "-", 1)}
    if kind not in key:
        raise ValueError(f"unknown id type {kind}")
    return df.withColumn("_key", key[kind]).join(mapping.select(F.col("key").alias("_key"), F.col("symbol").alias("mapped")), "_key", "left").drop("_key")


def coverage(mapped: DataFrame) -> DataFrame:
    """n, n_mapped, frac_mapped of rows with `mapped`."""
    return mapped.agg(F.count("*").alias("n"), F.count("mapped").alias("n_mapped"), (F.count("mapped") / F.count("*")).alias("frac_mapped"))


def top_labels(scores: DataFrame, n: int, source: str = "", release: str = "") -> DataFrame:
    """gene, rank, source, release: the n genes of highest largest score, ties by gene."""
    best = scores.groupBy("gene").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "gene").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "gene"))).select("gene", "rank", F.lit(source).alias("source"), F.lit(release).alias("release"))


def cap(labels: DataFrame, universe: DataFrame, n: int, mode: str = "filter_first") -> DataFrame:
    """labels cut to n: `filter_first` those in the universe, then the first n by rank; `cap_first` the first n, then those in the universe; `alphabetical` the first n names in the universe."""
    inside = labels.join(universe.select("gene").distinct(), "gene", "left_semi")
    if mode == "cap_first":
        return labels.orderBy("rank", "gene").limit(n).join(universe.select("gene").distinct(), "gene", "left_semi")
    if mode not in ("filter_first", "alphabetical"):
        raise ValueError(mode)
    return inside.orderBy(*(["rank"] if mode == "filter_first" else []), "gene").limit(n)


def cap_all(labels: DataFrame, universe: DataFrame) -> DataFrame:
    """(label_set, gene, rank) cut to the size of the smallest label set in the universe, by rank."""
    inside = labels.join(universe.select("gene").distinct(), "gene", "left_semi")
    least = inside.groupBy("label_set").count().agg(F.min("count").alias("n"))
    placed = ranks.by_group(inside, ["label_set"], ["rank", "gene"])
    return placed.withColumn("rank", F.col("_place").cast("int")).drop("_place", "_size").crossJoin(F.broadcast(least)).where("rank <= n").drop("n")


def new_labels(now: DataFrame, before: DataFrame) -> DataFrame:
    """gene, rank: what a later release has and an earlier one has not, by name."""
    new = now.select("gene").subtract(before.select("gene"))
    return ranks.by_group(new, [], ["gene"]).select("gene", F.col("_place").cast("int").alias("rank"))


def overlap(labels: DataFrame, networks: DataFrame) -> DataFrame:
    """label_set, network, n_label, overlap, frac for every pair of (label_set, gene) and (network, gene)."""
    sizes = labels.groupBy("label_set").agg(F.count_distinct("gene").alias("n_label"))
    both = labels.select("label_set", "gene").distinct().join(networks.select("network", "gene").distinct(), "gene").groupBy("label_set", "network").agg(F.count("*").alias("overlap"))
    grid = sizes.crossJoin(F.broadcast(networks.select("network").distinct()))  # label sets times networks, a handful each
    n = F.coalesce("overlap", F.lit(0)).cast("long")
    return grid.join(both, ["label_set", "network"], "left").select("label_set", "network", "n_label", n.alias("overlap"), F.round(n / F.col("n_label"), 4).alias("frac"))


def jaccard(sets: DataFrame, key: str = "label_set") -> DataFrame:
    """set_a, set_b, shared, jaccard of every two sets, those that share nothing too: a row a pair, as the matrix has. Shared genes are counted by a join on the gene, so only the sets' sizes meet pair by pair."""
    one = sets.select(F.col(key).alias("k"), "gene").distinct()
    n = cut(one.groupBy("k").agg(F.count("*").alias("n")), "sizes")
    both = one.alias("a").join(one.alias("b"), "gene").where("a.k < b.k").groupBy(F.col("a.k").alias("set_a"), F.col("b.k").alias("set_b")).agg(F.count("*").alias("both"))
    pairs = n.select(F.col("k").alias("set_a"), F.col("n").alias("na")).join(n.select(F.col("k").alias("set_b"), F.col("n").alias("nb")), F.col("set_a") < F.col("set_b"))
    shared = F.coalesce("both", F.lit(0)).cast("long")
    return pairs.join(both, ["set_a", "set_b"], "left").select("set_a", "set_b", shared.alias("shared"), (shared / (F.col("na") + F.col("nb") - shared)).alias("jaccard"))


def publication_adjusted(df: DataFrame, q: float = 0.5) -> DataFrame:
    """gene, adjusted, rank: positives (y = 1) whose log count, less the mean gap between the classes, reaches their own quantile."""
    beta = df.agg((F.avg(F.when(F.col("y") == 1, F.col("log_n"))) - F.avg(F.when(F.col("y") == 0, F.col("log_n")))).alias("beta"))
    adj = df.crossJoin(F.broadcast(beta)).withColumn("adjusted", F.col("log_n") - F.col("beta") * F.col("y")).where("y = 1")
    cut = adj.agg(F.percentile("adjusted", F.lit(q)).alias("cut"))
    kept = adj.crossJoin(F.broadcast(cut)).where("adjusted >= cut")
    return ranks.by_group(kept.select("gene", "adjusted"), [], [F.desc("adjusted"), "gene"]).select("gene", "adjusted", F.col("_place").cast("int").alias("rank"))


def stratified_splits(universe: DataFrame, positives: DataFrame, repeats: int = 10, k: int = 5, seed: str = "20260926") -> DataFrame:
    """gene, repeat, fold, y: each gene once a repeat, classes dealt evenly over the folds in the order of a hash of gene, repeat and seed."""
    y = universe.select("gene").distinct().join(positives.select("gene", F.lit(1).alias("_p")).distinct(), "gene", "left").select("gene", F.coalesce("_p", F.lit(0)).alias("y"))
    grid = y.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    u = uniform(F.col("gene"), F.concat(F.lit(f"{seed}|"), F.col("repeat").cast("string")))
    placed = ranks.by_group(grid.withColumn("_u", u), ["repeat", "y"], ["_u", "gene"], most=ranks.largest(y, ["y"]))  # a repeat's class is as large as the class
    return placed.withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).select("gene", "repeat", "fold", "y")


def split_sizes(splits: DataFrame) -> DataFrame:
    """repeat, folds, positives and rows: least, most and mean of the folds."""
    per = splits.groupBy("repeat", "fold").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    return per.groupBy("repeat").agg(F.count("*").alias("folds"), F.min("p").cast("long").alias("pos_min"), F.max("p").cast("long").alias("pos_max"), F.avg("p").alias("pos_mean"), F.min("n").alias("n_min"), F.max("n").alias("n_max"))


def fold_seeds(splits: DataFrame, k: int = 5) -> DataFrame:
    """(repeat, fold, gene): positives of every other fold. Each positive goes to k - 1 folds by an explode, without a join."""
    others = F.array_except(F.sequence(F.lit(0), F.lit(k - 1)), F.array("fold"))
    return splits.where("y = 1").select("repeat", F.explode(others).alias("fold"), "gene")


def complex_leakage(splits: DataFrame, complexes: DataFrame) -> DataFrame:
    """repeat, fold, y, n, leaked, frac: rows with a partner of one of their complexes among the positives of another fold."""
    member = complexes.select("complex_id", "gene").distinct()
    train = splits.where("y = 1").join(member, "gene").groupBy("complex_id", "repeat").agg(F.collect_set("fold").alias("folds"))
    test = splits.join(member, "gene", "left").join(train, ["complex_id", "repeat"], "left")
    hit = F.coalesce(F.size(F.array_except("folds", F.array("fold"))) > 0, F.lit(False))
    per = test.groupBy("repeat", "fold", "y", "gene").agg(F.max(hit.cast("int")).alias("hit"))
    return per.groupBy("repeat", "fold", "y").agg(F.count("*").alias("n"), F.sum("hit").cast("long").alias("leaked"), F.avg("hit").alias("frac"))


def transfer_pools(a: DataFrame, b: DataFrame, universe: DataFrame, sample: int = 1000, folds: int = 5, seed: str = "transfer") -> DataFrame:
    """gene, fold, y, role: targets are of b, not of a, in the universe, and stand in every fold; the background, a hash-ordered sample of genes of neither, is cut into slices of
    floor(sample / folds) genes (one at least), a fold each; what is left behind the last slice has no fold and no row."""
    target = b.select("gene").subtract(a.select("gene")).intersect(universe.select("gene"))
    rest = universe.select("gene").subtract(a.select("gene")).subtract(b.select("gene"))
    back = rest.orderBy(uniform(F.col("gene"), seed), "gene").limit(sample)
    placed = ranks.by_group(back.select("gene", uniform(F.col("gene"), f"{seed}|fold").alias("_u")), [], ["_u", "gene"], most=sample)
    fold = F.floor((F.col("_place") - 1) / F.greatest(F.floor(F.col("_size") / folds), F.lit(1))).cast("int")
    sliced = placed.select("gene", fold.alias("fold"), F.lit(0).alias("y"), F.lit("background").alias("role")).where(F.col("fold") < folds)
    every = target.select("gene", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"), F.lit(1).alias("y"), F.lit("target").alias("role"))
    return every.unionByName(sliced)


def complex_groups(universe: DataFrame, complexes: DataFrame, max_links: int = 10, max_group: int = 1000) -> DataFrame:
    """(gene, group): genes that share complexes, joined complex by complex.

    A gene keeps its `max_links` largest complexes. Complexes are taken from the one that most genes kept down (ties by id); one joins all its groups if together they have at most `max_group` genes, and is
    passed over as a whole if not. The group's name is its smallest gene. The order matters, so one task holds the list of kept links, which `max_links` bounds for each gene.
    """
    import pandas as pd

    inside = complexes.select("complex_id", "gene").distinct().join(universe.select("gene").distinct(), "gene", "left_semi")
    sized = inside.withColumn("_n", F.count("*").over(Window.partitionBy("complex_id")))
    links = sized.withColumn("_r", F.row_number().over(Window.partitionBy("gene").orderBy(F.desc("_n"), "complex_id"))).where(F.col("_r") <= max_links).select("complex_id", "gene")
    gene = universe.schema["gene"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members = pdf.groupby("complex_id")["gene"].apply(list)
        group: dict = {}
        of: dict = {}
        for _, genes in sorted(members.items(), key=lambda x: (-len(x[1]), x[0])):
            names = {of.get(g, g) for g in genes}
            joined = [x for n in names for x in group.get(n, [n])]
            if len(joined) <= max_group and len(names) > 1:
                name = min(joined)
                for n in names:
                    group.pop(n, None)
                group[name] = joined
                of.update(dict.fromkeys(joined, name))
        return pd.DataFrame({"gene": list(of), "group": list(of.values())})

    found = links.groupBy(F.lit(0).alias("_one")).applyInPandas(run, f"gene {gene}, group {gene}")
    return universe.select("gene").distinct().join(found, "gene", "left").select("gene", F.coalesce("group", "gene").alias("group"))


def grouped_splits(universe: DataFrame, positives: DataFrame, complexes: DataFrame, repeats: int = 10, k: int = 5, max_links: int = 10, max_group: int = 1000, tolerance: float = 0.02, seed: str = "20260926") -> DataFrame:
    """gene, repeat, fold, y, group, moved: no group of genes that share complexes (complex_groups) is cut between folds.

    Groups go from the one of most positives down (then most genes, then by hash of group and repeat) to a fold whose share of positives plus share of genes is least, of those within `tolerance` of it to a
    hashed one. A fold without a positive then takes one (moved) out of the group of fewest positives that has two or more. Without any complex the folds are those of stratified_splits(). Repeats are independent: a task
    holds one repeat of one universe.
    """
    import hashlib

    import numpy as np
    import pandas as pd

    if complexes.join(universe.select("gene"), "gene", "left_semi").isEmpty():
        return stratified_splits(universe, positives, repeats, k, seed).select("*", F.col("gene").alias("group"), F.lit(False).alias("moved"))
    y = universe.select("gene").distinct().join(positives.select("gene", F.lit(1).alias("_p")).distinct(), "gene", "left").select("gene", F.coalesce("_p", F.lit(0)).alias("y"))
    rows = y.join(complex_groups(universe, complexes, max_links, max_group), "gene").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gene", ignore_index=True)
        r = int(pdf["repeat"].iloc[0])
        draw = lambda what: int(hashlib.md5(f"{seed}|{r}|{what}".encode()).hexdigest()[:8], 16) / 4294967296.0
        per = pdf.groupby("group")["y"].agg(["sum", "count"])
        groups = sorted(((g, int(p), int(n)) for g, p, n in per.itertuples()), key=lambda x: (-x[1], -x[2], draw(x[0])))
        want_p, want_n = max(pdf["y"].sum() / k, 1.0), max(len(pdf) / k, 1.0)
        have_p, have_n, fold_of = np.zeros(k), np.zeros(k), {}
        for g, p, n in groups:
            cost = have_p / want_p + have_n / want_n
            near = np.flatnonzero(cost <= cost.min() * (1 + tolerance) + tolerance)
            f = int(near[int(draw(f"fold|{g}") * len(near))])
            fold_of[g] = f
            have_p[f] += p
            have_n[f] += n
        fold = pdf["group"].map(fold_of).to_numpy().astype("int32")
        moved, positive = np.zeros(len(pdf), bool), pdf["y"].to_numpy() == 1
        # A donor group of two or more positives; a gene is moved once.
        donors = sorted((p, n, g) for g, p, n in groups if p >= 2)
        for f in np.flatnonzero(have_p == 0).tolist():
            at = np.flatnonzero(positive & ~moved & (pdf["group"] == donors[0][2]).to_numpy()) if donors else []
            if not len(at):
                break
            fold[at[0]], moved[at[0]] = f, True
        return pdf.assign(fold=fold, moved=moved)[["gene", "repeat", "fold", "y", "group", "moved"]]

    gene = universe.schema["gene"].dataType.simpleString()
    return rows.groupBy("repeat").applyInPandas(run, f"gene {gene}, repeat int, fold int, y int, group {gene}, moved boolean")


def group_invariants(splits: DataFrame) -> DataFrame:
    """One row: genes, groups, groups larger than the number of folds, groups that a repeat cuts between folds (genes moved on purpose aside), and the least, most and mean number of positives of a fold, folds without any counted."""
    folds = splits.select("fold").distinct()
    group = splits.where("repeat = 0").groupBy("group").agg(F.count("*").alias("n")).crossJoin(folds.agg(F.count("*").alias("k")))
    size = group.agg(F.sum("n").alias("n_genes"), F.count("*").alias("n_groups"), F.count_if(F.col("n") > F.col("k")).alias("n_groups_larger_than_k"))
    cut = splits.where("not moved").groupBy("repeat", "group").agg(F.count_distinct("fold").alias("f")).agg(F.count_if(F.col("f") > 1).alias("n_groups_split"))
    grid = splits.select("repeat").distinct().crossJoin(folds).join(splits.groupBy("repeat", "fold").agg(F.sum("y").alias("p")), ["repeat", "fold"], "left").select(F.coalesce("p", F.lit(0)).alias("p"))
    return size.crossJoin(cut).crossJoin(grid.agg(F.min("p").cast("long").alias("pos_min"), F.max("p").cast("long").alias("pos_max"), F.avg("p").alias("pos_mean")))
