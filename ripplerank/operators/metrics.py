"""Ranking metrics of groups of scored, labelled rows, as window expressions.

Input columns: the group's keys, gene, score, y (0 or 1). Ties count half in AUROC; ranks order by score falling, then gene.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks


def auroc(df: DataFrame, keys: list[str], weight: str | None = None, most: int | None = None) -> DataFrame:
    """keys, auroc: mid-rank Mann-Whitney; null if a class is missing. With a weight column each row counts that often."""
    w = F.col(weight) if weight else F.lit(1.0)
    ties = df.groupBy(*keys, "score").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("y") == 0, w).otherwise(0.0)).alias("n"))
    placed = ranks.by_group(ties, keys, ["score"], {"n": "n"}, most)
    won = placed.withColumn("won", F.col("p") * (F.col("_before_n") + F.col("n") / 2)).groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return won.select(*keys, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))).alias("auroc"))


def auprc(df: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """keys, auprc: average precision over the distinct thresholds; null without positives."""
    ties = df.groupBy(*keys, "score").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    placed = ranks.by_group(ties, keys, [F.desc("score")], {"p": "p", "n": "n"}, most)
    cum = placed.withColumn("precision", (F.col("_before_p") + F.col("p")) / (F.col("_before_n") + F.col("n")))
    out = cum.groupBy(*keys).agg(F.sum(F.col("p") * F.col("precision")).alias("s"), F.sum("p").alias("p"))
    return out.select(*keys, F.when(F.col("p") > 0, F.col("s") / F.col("p")).alias("auprc"))


def ranked(df: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """df with rank (from 1) and size of its group."""
    return ranks.by_group(df, keys, [F.desc("score"), "gene"], most=most).withColumnsRenamed({"_place": "rank", "_size": "size"})


def precision_at(df: DataFrame, keys: list[str], ks: tuple[int, ...] = (50, 100, 500), most: int | None = None) -> DataFrame:
    """keys and p_at_k for each k; null where the group has fewer rows."""
    r = ranked(df, keys, most)
    cols = [F.when(F.max("size") >= k, F.sum(F.when(F.col("rank") <= k, F.col("y")).otherwise(0)) / float(k)).alias(f"p_at_{k}") for k in ks]
    return r.groupBy(*keys).agg(*cols)


def precision_top(df: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """keys, p_top: precision among the first ceil(share * n)."""
    r = ranked(df, keys).where(F.col("rank") <= F.ceil(F.col("size") * F.lit(share)))
    return r.groupBy(*keys).agg(F.avg("y").alias("p_top"))


def _roc(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score, x0, y0, fpr, tpr: each distinct score with the rates before and at it."""
    ties = df.groupBy(*keys, "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    placed = ranks.by_group(ties, keys, [F.desc("score")], {"p": "p", "n": "n"})
    rate = lambda c, more: F.try_divide(F.col(f"_before_{c}") + more, F.col(f"_all_{c}"))
    return placed.select(*keys, "score", rate("n", F.lit(0)).alias("x0"), rate("p", F.lit(0)).alias("y0"), rate("n", F.col("n")).alias("fpr"), rate("p", F.col("p")).alias("tpr"))


def roc_points(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, score, fpr, tpr at each distinct score."""
    return _roc(df, keys).drop("x0", "y0")


def partial_auc(df: DataFrame, keys: list[str], most: float = 0.02) -> DataFrame:
    """keys, pauc: area under the ROC up to a false positive rate, cut linearly; pauc_norm: over that rate."""
    end = F.least(F.col("fpr"), F.lit(most))
    height = F.when(F.col("fpr") > F.col("x0"), F.col("y0") + (F.col("tpr") - F.col("y0")) * (end - F.col("x0")) / (F.col("fpr") - F.col("x0"))).otherwise(F.col("tpr"))
    area = F.when(F.col("x0") < most, (end - F.col("x0")) * (F.col("y0") + height) / 2).otherwise(F.lit(0.0))
    return _roc(df, keys).groupBy(*keys).agg(F.sum(area).alias("pauc")).withColumn("pauc_norm", F.col("pauc") / most)


def pauc_excess(one, other, most: float = 0.02):
    """What one partial AUC has over another, in units of what a perfect ranking has over a random one."""
    return (one - other) / (most - most * most / 2)


def median_rank(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, medrr: median rank of the positives over the group's size."""
    return ranked(df, keys).where("y = 1").groupBy(*keys).agg((F.percentile("rank", F.lit(0.5)) / F.max("size")).alias("medrr"))


def all_metrics(df: DataFrame, keys: list[str], ks: tuple[int, ...] = (50, 100, 500)) -> DataFrame:
    """keys with auroc, auprc, p_at_k, n_test_pos, n_test. Groups of up to ranks.GROUP_ROWS rows are shuffled once for all metrics."""
    most = ranks.largest(df, keys)
    if most > ranks.GROUP_ROWS:
        n = df.groupBy(*keys).agg(F.sum("y").cast("long").alias("n_test_pos"), F.count("*").alias("n_test"))
        return auroc(df, keys, most=most).join(auprc(df, keys, most), keys).join(precision_at(df, keys, ks, most), keys).join(n, keys)
    hits = [F.sum(F.when(F.col("_place") <= k, F.col("y")).otherwise(0)).alias(f"_at_{k}") for k in ks]
    count = lambda y: F.count_if(F.col("y") == y)
    ties = ranks.by_group(df.select(*keys, "gene", "score", "y"), keys, [F.desc("score"), "gene"], most=most)
    ties = ties.groupBy(*keys, "score").agg(count(1).alias("p"), count(0).alias("n"), F.count("*").alias("rows"), F.sum("y").alias("_y"), *hits)
    placed = ranks.by_group(ties, keys, [F.desc("score")], {"p": "p", "n": "n", "rows": "rows"}, most)
    precision = (F.col("_before_p") + F.col("p")) / (F.col("_before_rows") + F.col("rows"))
    won = F.col("p") * (F.col("_all_n") - F.col("_before_n") - F.col("n") / 2)  # whole and half numbers: exact in any order
    sums = [F.sum(won).alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * precision).alias("s"), F.sum("_y").cast("long").alias("n_test_pos"), F.sum("rows").alias("n_test"), *[F.sum(f"_at_{k}").alias(f"_at_{k}") for k in ks]]
    roc = F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))).alias("auroc")
    out = [roc, F.when(F.col("p") > 0, F.col("s") / F.col("p")).alias("auprc"), *[F.when(F.col("n_test") >= k, F.col(f"_at_{k}") / float(k)).alias(f"p_at_{k}") for k in ks]]
    return placed.groupBy(*keys).agg(*sums).select(*keys, *out, "n_test_pos", "n_test")


def margins(results: DataFrame, keys: list[str], metrics: list[str], one: str = "rwr", other: str = "degree") -> DataFrame:
    """keys and delta_m, rwr_m, degree_m of each metric, in one pass."""
    pick = lambda method, m: F.max(F.when(F.col("method") == method, F.col(m)))
    cols = [c for m in metrics for c in ((pick(one, m) - pick(other, m)).alias(f"delta_{m}"), pick(one, m).alias(f"{one}_{m}"), pick(other, m).alias(f"{other}_{m}"))]
    return results.groupBy(*keys).agg(*cols)


def top_overlap(df: DataFrame, keys: list[str], run: str, k: int) -> DataFrame:
    """keys, run_a, run_b, jaccard of the first k genes of every two runs."""
    top = ranked(df, [*keys, run]).where(F.col("rank") <= k).select(*keys, run, "gene")
    pair = top.alias("a").join(top.alias("b"), [*keys, "gene"]).where(F.col(f"a.{run}") < F.col(f"b.{run}"))
    return pair.groupBy(*keys, F.col(f"a.{run}").alias("run_a"), F.col(f"b.{run}").alias("run_b")).agg(F.count("*").alias("both")).select(*keys, "run_a", "run_b", (F.col("both") / (2.0 * k - F.col("both"))).alias("jaccard"))


def persistence(df: DataFrame, keys: list[str], run: str, k: int) -> DataFrame:
    """keys, gene, runs: genes that stand in the first k of more than half the runs."""
    n = df.groupBy(*keys).agg(F.count_distinct(run).alias("_runs"))
    top = ranked(df, [*keys, run]).where(F.col("rank") <= k).groupBy(*keys, "gene").agg(F.count("*").alias("runs"))
    return (top.join(n, keys) if keys else top.crossJoin(n)).where("runs > _runs / 2").select(*keys, "gene", "runs")
