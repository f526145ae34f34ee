"""Stability of rankings: percentile ranks, crowding, neighbours, smoothing, confidence, consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import log_c, uniform, weighted_median
from ..sources.shared import cut
from . import ranks


def percentile_ranks(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with pct: (rank - 1) / (n - 1), 0 for the best, ties by gene."""
    placed = ranks.by_group(df, keys, [F.desc("score"), "gene"])
    return placed.withColumn("pct", F.when(F.col("_size") > 1, (F.col("_place") - 1) / (F.col("_size") - 1)).otherwise(F.lit(0.0))).drop("_place", "_size")


def by_repeat(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gene, repeat, score: folds collapsed to their mean."""
    return df.groupBy(*keys, "gene", "repeat").agg(F.avg("score").alias("score"))


def rank_sd(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gene, rank_sd, score_cv over repeats: the SD of percentile ranks and SD / |mean| of scores; null below two."""
    p = percentile_ranks(df, [*keys, "repeat"])
    return p.groupBy(*keys, "gene").agg(F.stddev_samp("pct").alias("rank_sd"), (F.stddev_samp("score") / F.greatest(F.abs(F.avg("score")), F.lit(1e-300))).alias("score_cv"))


def bandwidth(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, width: 1.06 * min(sd, IQR / 1.349) * n ** -0.2."""
    iqr = (F.percentile("score", F.lit(0.75)) - F.percentile("score", F.lit(0.25))) / 1.349
    return df.groupBy(*keys).agg((1.06 * F.least(F.stddev_samp("score"), iqr) * F.pow(F.count("score").cast("double"), F.lit(-0.2))).alias("width"))


def _within(keys: list[str], by: str, low: float, high: float) -> F.Column:
    """Rows of the group from `low` below (negative) to `high` above in a column: a range frame over doubles, which only SQL text can name."""
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return F.expr(f"count(*) OVER ({part}ORDER BY {by} RANGE BETWEEN {-low!r}D PRECEDING AND {high!r}D FOLLOWING)")


def crowding(df: DataFrame, keys: list[str], width: float) -> DataFrame:
    """df with crowd: rows of the group whose score lies within `width`, itself among them. A window over a range of scores, or in groups over ranks.GROUP_ROWS the counts at both ends (crowding_by)."""
    if ranks.largest(df, keys) > ranks.GROUP_ROWS:
        widths = df.select(*keys).distinct() if keys else df.sparkSession.range(1)
        crowd = crowding_by(df, keys, widths.select(*keys, F.lit(float(width)).alias("width"))).select(*keys, "gene", "crowd")
        return df.join(crowd, [*keys, "gene"])
    return df.withColumn("crowd", _within(keys, "score", -width, width))


def relative_crowding(df: DataFrame, keys: list[str], share: float = 0.1) -> DataFrame:
    """df (positive scores) with crowd: rows whose score lies within a factor 1 - share to 1 + share, by the C library's logarithms: at the very end of the band the last bit of a logarithm decides."""
    import math

    logged = df.where("score > 0").withColumn("_l", log_c(F.col("score")))
    return logged.withColumn("crowd", _within(keys, "_l", math.log(1 - share), math.log(1 + share))).drop("_l")


def nearest(df: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """keys, gene, near, distance, place: the k nearest other rows by score, ties to the earlier place in the order of score and gene; rows without a score take no part.

    Of rows with one score only the first k + 1 can be anyone's neighbours, on either side of the asker. So scores are lined up with that many rows each, upwards and downwards, and every score meets its own rows, the k places above
    and the k below: a join on places, not on all pairs of a group. A row takes the first k of its score's list, itself left out.
    """
    rows = df.select(*keys, "gene", "score").where("score is not null")
    pool = ranks.by_group(rows, [*keys, "score"], ["gene"]).where(F.col("_place") <= k + 1)
    pool = cut(pool.select(*keys, "score", "gene", F.col("_place").alias("_i")), "pool")
    counts = pool.groupBy(*keys, "score").agg(F.count("*").alias("_n"))
    values = ranks.by_group(counts, keys, ["score"], {"n": "_n"})
    values = cut(values.select(*keys, "score", "_n", F.col("_before_n").alias("_up"), (F.col("_all_n") - F.col("_before_n") - F.col("_n")).alias("_down")), "values")
    line = pool.join(values, [*keys, "score"]).select(*keys, F.col("gene").alias("near"), F.col("score").alias("_s"), F.explode(F.array(F.struct(F.lit(True).alias("up"), (F.col("_up") + F.col("_i")).alias("q")), F.struct(F.lit(False).alias("up"), (F.col("_down") + F.col("_i")).alias("q")))).alias("_at"))
    places = lambda up, first, last: F.transform(F.sequence(first, last), lambda q: F.struct(F.lit(up).alias("up"), q.alias("q")))
    end = F.col("_down") + F.col("_n")
    asks = values.select(*keys, "score", F.explode(F.concat(places(True, F.col("_up") + 1, F.col("_up") + F.col("_n") + k), places(False, end + 1, end + k))).alias("_at"))
    distance = F.abs(F.col("score") - F.col("_s")).alias("distance")
    near = asks.join(line, [*keys, "_at"]).groupBy(*keys, "score").agg(F.slice(F.array_sort(F.collect_list(F.struct(distance, "_s", "near"))), 1, k + 1).alias("_near"))
    own = rows.join(near, [*keys, "score"]).select(*keys, "gene", F.posexplode(F.slice(F.filter("_near", lambda x: x["near"] != F.col("gene")), 1, k)).alias("_at", "_x"))
    return own.select(*keys, "gene", "_x.near", "_x.distance", (F.col("_at") + 1).alias("place"), F.col("_x._s").alias("near_score"))


def smooth(df: DataFrame, keys: list[str], k: int = 5, shrink: float = 0.5) -> DataFrame:
    """keys, gene, score, smoothed: score + shrink * (median of the k nearest - score)."""
    m = nearest(df, keys, k).groupBy(*keys, "gene").agg(F.percentile("near_score", F.lit(0.5)).alias("m"))
    return df.join(m, [*keys, "gene"]).select(*keys, "gene", "score", (F.col("score") + shrink * (F.col("m") - F.col("score"))).alias("smoothed"))


def global_shrink(df: DataFrame, keys: list[str], shrink: float = 0.5) -> DataFrame:
    """df with smoothed: towards the group's median."""
    m = df.groupBy(*keys).agg(F.percentile("score", F.lit(0.5)).alias("_m"))
    return (df.join(m, keys) if keys else df.crossJoin(m)).withColumn("smoothed", F.col("score") + shrink * (F.col("_m") - F.col("score"))).drop("_m")


def flatten(df: DataFrame, keys: list[str], gamma: float = 0.5) -> DataFrame:
    """df with flat: lo + (hi - lo) * z ** gamma, z the place between the group's ends; ranks stay."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return df.withColumn("flat", F.when(hi > lo, lo + (hi - lo) * F.pow((F.col("score") - lo) / (hi - lo), F.lit(gamma))).otherwise(F.col("score")))


def random_neighbours(df: DataFrame, keys: list[str], k: int = 5, reps: int = 3, seed: str = "random") -> DataFrame:
    """keys, gene, rep, median: of the row's own score and those of k others drawn with replacement (at most as many as there are), weighted by `confidence` (1 where df has none): clms() with neighbours drawn at random."""
    df = df if "confidence" in df.columns else df.withColumn("confidence", F.lit(1.0))
    placed = ranks.by_group(df.select(*keys, "gene", "score", "confidence"), keys, ["gene"]).withColumn("_p", F.col("_place") - 1).withColumnRenamed("_size", "_n").drop("_place")
    most = F.greatest(F.least(F.lit(k), F.col("_n").cast("int") - 1), F.lit(1))
    grid = placed.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("_d", F.explode(F.sequence(F.lit(0), most - 1)))
    u = uniform(F.col("gene"), F.concat_ws("|", F.lit(seed), F.col("rep").cast("string"), F.col("_d").cast("string")))
    step = F.floor(u * (F.col("_n") - 1)) + 1  # a way round the circle that never comes back to the row itself, unless it is alone
    asks = grid.withColumn("_q", F.pmod(F.col("_p") + step, F.col("_n")))
    pair = lambda v, c: F.struct(F.col(v).cast("double").alias("value"), F.col(c).cast("double").alias("weight"))
    other = placed.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], pair("score", "confidence").alias("_s"), F.col("_p").alias("_r"))
    drawn = asks.join(other, [*[F.col(c) == F.col(f"_k{i}") for i, c in enumerate(keys)], F.col("_q") == F.col("_r")])
    lists = drawn.groupBy(*keys, "gene", "rep").agg(F.collect_list("_s").alias("_near"), F.first(pair("score", "confidence")).alias("_own"))
    return lists.select(*keys, "gene", "rep", weighted_median(F.concat(F.array("_own"), "_near")).alias("median"))


def loro_confidence(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gene, repeat, confidence: 1 / (1 + CV ** 2) over the other repeats, from totals less the own value; 1 below three repeats."""
    w = Window.partitionBy(*keys, "gene")
    n = F.count("score").over(w) - 1
    s, q = F.sum("score").over(w) - F.col("score"), F.sum(F.col("score") * F.col("score")).over(w) - F.col("score") * F.col("score")
    mean, var = F.try_divide(s, n), F.greatest(F.try_divide(q - F.try_divide(s * s, n), n - 1), F.lit(0.0))
    cv2 = var / F.greatest(mean * mean, F.lit(1e-300))
    return df.select(*keys, "gene", "repeat", F.when(n >= 2, 1 / (1 + cv2)).otherwise(F.lit(1.0)).alias("confidence"))


def moving_median(df: DataFrame, keys: list[str], half: int = 5) -> DataFrame:
    """df with median: of the rows up to `half` places away in the order of score and gene."""
    if ranks.largest(df, keys) <= ranks.GROUP_ROWS:
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), "gene").rowsBetween(-half, half)
        return df.withColumn("median", F.expr("percentile(score, 0.5)").over(w))
    placed = cut(ranks.by_group(df, keys, [F.desc("score"), "gene"], most=ranks.GROUP_ROWS + 1).drop("_size"), "placed")
    near = placed.select(*keys, "score", F.explode(F.sequence(F.col("_place") - half, F.col("_place") + half)).alias("_place"))
    return placed.join(near.groupBy(*keys, "_place").agg(F.percentile("score", F.lit(0.5)).alias("median")), [*keys, "_place"]).select(*df.columns, "median")


def network_median(df: DataFrame, edges: DataFrame) -> DataFrame:
    """gene, median: the lower median of the neighbours' scores, weighted by their confidence (gene, score, confidence)."""
    from .graph import directed

    near = directed(edges).join(df.select(F.col("gene").alias("dst"), "score", "confidence"), "dst")
    pairs = F.collect_list(F.struct(F.col("score").alias("value"), F.col("confidence").alias("weight")))
    return near.groupBy(F.col("src").alias("gene")).agg(pairs.alias("p")).select("gene", weighted_median(F.col("p")).alias("median"))


def consensus(df: DataFrame, run: str) -> DataFrame:
    """gene, runs, mean_rank, median_rank, rrf: percentile ranks over runs (networks); rrf is the sum of 1 / (60 + (1 - pct)), pct 1 for the best."""
    p = percentile_ranks(df, [run]).withColumn("good", 1 - F.col("pct"))
    return p.groupBy("gene").agg(F.count("*").alias("runs"), F.avg("good").alias("mean_rank"), F.percentile("good", F.lit(0.5)).alias("median_rank"), F.sum(1 / (60 + (1 - F.col("good")))).alias("rrf"))


def strata(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """df with stratum low, mid, high: cut at floor(n / 3) and floor(2n / 3) in the order of a column and gene."""
    r, n = F.col("_place"), F.col("_size")
    stratum = F.when(r <= F.floor(n / 3), "low").when(r <= F.floor(2 * n / 3), "mid").otherwise("high")
    return ranks.by_group(df, keys, [by, "gene"]).withColumn("stratum", stratum).drop("_place", "_size")


def deciles(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """df with decile 0 to 9 by place: (rn - 1) * 10 / (n - 1), as quantile bins cut it."""
    decile = F.greatest(F.ceil((F.col("_place") - 1) * 10.0 / F.greatest(F.col("_size") - 1, F.lit(1))) - 1, F.lit(0)).cast("int")
    return ranks.by_group(df, keys, [by, "gene"]).withColumn("decile", decile).drop("_place", "_size")


def crowding_by(df: DataFrame, keys: list[str], widths: DataFrame) -> DataFrame:
    """keys, gene, score, crowd: rows of the group whose score lies within the group's own width (widths: keys, width), itself among them.

    A frame cannot vary by group, so both ends are counted: rows at or below score + width less rows below score - width, each from the running count of the scores and the ends put in one order.
    """
    w = df.join(widths.select(*keys, "width"), keys) if keys else df.crossJoin(F.broadcast(widths.select("width")))
    point = w.select(*keys, F.col("score").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("n"), F.lit(None).cast(df.schema["gene"].dataType).alias("gene"), F.lit(None).cast("double").alias("score"))
    ends = lambda sign, kind: w.select(*keys, (F.col("score") + sign * F.col("width")).alias("at"), F.lit(kind).alias("kind"), F.lit(0).alias("n"), "gene", "score")
    every = point.unionByName(ends(-1, 0)).unionByName(ends(1, 2))
    counted = ranks.by_group(every, keys, ["at", "kind", "gene"], {"n": "n"}).where("kind <> 1").withColumnRenamed("_before_n", "below")
    return counted.groupBy(*keys, "gene", "score").agg((F.max(F.when(F.col("kind") == 2, F.col("below"))) - F.max(F.when(F.col("kind") == 0, F.col("below")))).alias("crowd"))


def rank_band(df: DataFrame, keys: list[str], share: float = 0.01) -> DataFrame:
    """df with near_ranks (rows within a share of the group's size by rank, at least one place, itself among them) and band_spread (the range of their scores)."""
    placed = ranks.by_group(df, keys, [F.desc("score"), "gene"]).withColumnsRenamed({"_place": "_p", "_size": "_n"})
    placed = placed.withColumn("_b", F.greatest(F.floor(F.lit(share) * F.col("_n")), F.lit(1)))
    lo, hi = F.greatest(F.col("_p") - F.col("_b"), F.lit(1)), F.least(F.col("_p") + F.col("_b"), F.col("_n"))
    first, last = placed.select(*keys, F.col("_p").alias("_lo"), F.col("score").alias("_top")), placed.select(*keys, F.col("_p").alias("_hi"), F.col("score").alias("_bottom"))
    out = placed.withColumn("_lo", lo).withColumn("_hi", hi).join(first, [*keys, "_lo"]).join(last, [*keys, "_hi"])
    return out.select(*[out[c] for c in df.columns], (F.col("_hi") - F.col("_lo") + 1).alias("near_ranks"), (F.col("_top") - F.col("_bottom")).alias("band_spread"))


def nearest_in_pool(df: DataFrame, pool: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """keys, gene, near, near_score, distance, place: the k rows of a pool (keys, gene, score) nearest to each row by score, ties to the smaller score and gene."""
    from .resample import nearest_in

    return nearest_in(df, pool, keys, "score", k).withColumnRenamed("value", "near_score")


def clms(df: DataFrame, keys: list[str], k: int = 5, shrink: float | F.Column = 0.5, variant: str = "global", crowd: str = "crowd", neighbours: DataFrame | None = None) -> DataFrame:
    """keys, gene, score, smoothed: score + lambda * (m - score), m the median of the row and its k nearest by score, weighted by `confidence`.

    `global`: lambda is `shrink` for every row; `crowding`: shrink times the row's crowd over the largest of its group, so crowded rows move fully and lone ones hardly (all alike where no crowd is over 0). `neighbours` (keys, gene,
    near_score, near_confidence) take the place of the nearest rows.
    """
    if variant not in ("global", "crowding"):
        raise ValueError(f"unknown variant {variant}")
    if neighbours is None:
        near = nearest(df, keys, k)
        other = df.select(*keys, F.col("gene").alias("near"), F.col("confidence").alias("near_confidence"))
        neighbours = near.join(other, [*keys, "near"]).select(*keys, "gene", "near_score", "near_confidence")
    pair = lambda v, w: F.struct(F.col(v).cast("double").alias("value"), F.col(w).cast("double").alias("weight"))
    lists = neighbours.groupBy(*keys, "gene").agg(F.collect_list(pair("near_score", "near_confidence")).alias("_near"))
    own = df.join(lists, [*keys, "gene"], "left").withColumn("_m", weighted_median(F.concat(F.array(pair("score", "confidence")), F.coalesce("_near", F.array().cast("array<struct<value:double,weight:double>>")))))
    size = shrink if isinstance(shrink, F.Column) else F.lit(float(shrink))
    if variant == "crowding":
        most = F.max(crowd).over(Window.partitionBy(*keys))
        size = F.when(most > 0, size * F.col(crowd) / most).otherwise(size)
    return own.select(*keys, "gene", "score", (F.col("score") + size * (F.col("_m") - F.col("score"))).alias("smoothed"))


def smoothing_grid(df: DataFrame, keys: list[str], ks: tuple[int, ...] = (5, 20), shrinks: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0), groups: int = 4, tolerance: float = 0.010) -> tuple[DataFrame, DataFrame]:
    """Smoothing by every k, variant and shrinkage, chosen on some repeats and judged on the others.

    df: keys, repeat, gene, y, score. First: keys, variant, k, shrink, part, auroc, rank_sd (means over the repeats outside the part `repeat % groups`, on which the choice is made, and `auroc_out`, `rank_sd_out` over those inside).
    Second: keys, variant, k, part, shrink, auroc_out, rank_sd_out: the shrinkage of least rank SD whose AUROC stays within `tolerance` of no shrinkage, chosen without the part. Parameters are columns: each k is one neighbour join, shrinkages are an explode.
    """
    from .metrics import auroc

    by = [*keys, "repeat"]
    conf = df.join(loro_confidence(df, keys), [*by, "gene"])
    crowded = cut(conf.join(crowding_by(conf, by, bandwidth(conf, by)).select(*by, "gene", "crowd"), [*by, "gene"]), "crowded")
    out = None
    for k in ks:
        for variant in ("global", "crowding"):
            full = clms(crowded, by, k, 1.0, variant).withColumns({"k": F.lit(k), "variant": F.lit(variant)})
            out = full if out is None else out.unionByName(full)
    grid = out.withColumn("shrink", F.explode(F.array(*[F.lit(float(x)) for x in shrinks]))).withColumn("score", F.round(F.col("score") + F.col("shrink") * (F.col("smoothed") - F.col("score")), 10)).drop("smoothed")
    grid = cut(grid.join(df.select(*by, "gene", "y"), [*by, "gene"]), "grid")
    cell = [*keys, "variant", "k", "shrink"]
    parts = df.select((F.col("repeat") % groups).alias("part")).distinct()
    per = auroc(grid, [*cell, "repeat"]).crossJoin(F.broadcast(parts)).withColumn("inside", F.col("repeat") % groups == F.col("part"))
    fit = per.groupBy(*cell, "part").agg(F.avg(F.when(~F.col("inside"), F.col("auroc"))).alias("auroc"), F.avg(F.when(F.col("inside"), F.col("auroc"))).alias("auroc_out"))
    pct = percentile_ranks(grid, [*cell, "repeat"]).crossJoin(F.broadcast(parts)).withColumn("inside", F.col("repeat") % groups == F.col("part"))
    sd = pct.groupBy(*cell, "part", "gene").agg(F.stddev_samp(F.when(~F.col("inside"), F.col("pct"))).alias("s"), F.stddev_samp(F.when(F.col("inside"), F.col("pct"))).alias("t"))
    spread = sd.groupBy(*cell, "part").agg(F.avg("s").alias("rank_sd"), F.avg("t").alias("rank_sd_out"))
    table = cut(fit.join(spread, [*cell, "part"]), "grid")
    none = table.where("shrink = 0").select(*keys, "variant", "k", "part", F.col("auroc").alias("_base"))
    fair = table.join(none, [*keys, "variant", "k", "part"]).where(F.col("auroc") >= F.col("_base") - tolerance)
    best = F.min_by(F.struct("shrink", "auroc_out", "rank_sd_out"), F.struct("rank_sd", "shrink"))
    chosen = fair.groupBy(*keys, "variant", "k", "part").agg(best.alias("b")).select(*keys, "variant", "k", "part", "b.*")
    return table, chosen


def operators_side_by_side(df: DataFrame, keys: list[str], k: int = 5, shrink: float = 0.5, gamma: float = 0.5) -> DataFrame:
    """keys, operator, gene, score: the scores as they are and after each smoothing: local median, confidence-weighted, by crowding, global median, flattened and a moving median."""
    c = df if "confidence" in df.columns else df.withColumn("confidence", F.lit(1.0))
    crowded = c.join(crowding_by(c, keys, bandwidth(c, keys)).select(*keys, "gene", "crowd"), [*keys, "gene"])
    ways = {"none": df.withColumn("v", F.col("score").cast("double")), "local": smooth(df, keys, k, shrink).withColumn("v", F.col("smoothed")), "clms": clms(c, keys, k, shrink).withColumn("v", F.col("smoothed")), "clms_crowding": clms(crowded, keys, k, shrink, "crowding").withColumn("v", F.col("smoothed")), "global": global_shrink(df, keys, shrink).withColumn("v", F.col("smoothed")), "flat": flatten(df, keys, gamma).withColumn("v", F.col("flat").cast("double")), "moving": moving_median(df, keys, k).withColumn("v", F.col("median"))}
    out = None
    for name, d in ways.items():
        x = d.select(*keys, F.lit(name).alias("operator"), "gene", F.col("v").alias("score"))
        out = x if out is None else out.unionByName(x)
    return out


def random_control(df: DataFrame, keys: list[str], k: int = 5, shrink: float = 0.5, replicates: int = 20, seed: str = "c1") -> DataFrame:
    """keys, observed, null_mean, null_sd, p: the mean rank SD after clms() with the k nearest, against the same operator with k others drawn at random, replicate by replicate. df: keys, repeat, gene, score and, if it is to weight, confidence."""
    df = df if "confidence" in df.columns else df.withColumn("confidence", F.lit(1.0))
    by = [*keys, "repeat"]
    own = clms(df, by, k, shrink).select(*by, "gene", F.round("smoothed", 10).alias("score"))
    mean = lambda d, more: rank_sd(d, [*keys, *more]).groupBy(*keys, *more).agg(F.avg("rank_sd").alias("value"))
    drawn = random_neighbours(df, by, k, replicates, seed).join(df, [*by, "gene"]).select(*by, "rep", "gene", F.round(F.col("score") + shrink * (F.col("median") - F.col("score")), 10).alias("score"))
    null = mean(drawn, ["rep"])
    j = null.join(mean(own, []).withColumnRenamed("value", "observed"), keys) if keys else null.crossJoin(mean(own, []).withColumnRenamed("value", "observed"))
    return j.groupBy(*keys, "observed").agg(F.avg("value").alias("null_mean"), F.stddev_samp("value").alias("null_sd"), ((F.count_if(F.col("value") <= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p"))


def attribution(df: DataFrame, keys: list[str], predictors: list[str]) -> DataFrame:
    """keys, predictor, n, rho: rank correlation of rank_sd with each predictor column."""
    from .stats import spearman

    out = None
    for c in predictors:  # a handful of columns
        x = spearman(df.where(f"rank_sd is not null and {c} is not null"), keys, "rank_sd", c).select(*keys, F.lit(c).alias("predictor"), "n", "rho")
        out = x if out is None else out.unionByName(x)
    return out


def diagnose(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gene, rank_sd, own_sd, others_sd: the SD of a gene's percentile rank over repeats; with the others at their mean scores, so that only its own score moves; and with its own at its mean.

    A rank against frozen scores is a place among them: counted by a running sum over scores and askers in one order.
    """
    w = Window.partitionBy(*keys, "gene")
    m = df.withColumn("mean", F.round(F.avg("score").over(w), 10))
    n = df.groupBy(*keys, "repeat").agg(F.count("*").alias("n"))

    def placed(points: DataFrame, asks: DataFrame, by: list[str]) -> DataFrame:
        """by, repeat, gene, pct of asks (by, repeat, gene, at, mean): points (by, at) above each over n - 1, the gene's own point left out."""
        every = points.select(*by, F.col("at"), F.lit(0).alias("kind"), F.lit(1).alias("one"), F.lit(None).cast("int").alias("repeat"), F.lit(None).cast(df.schema["gene"].dataType).alias("gene"), F.lit(None).cast("double").alias("self"))
        ask = asks.select(*by, "at", F.lit(1).alias("kind"), F.lit(0).alias("one"), F.col("repeat").cast("int").alias("repeat"), "gene", "self")
        run = F.sum("one").over(Window.partitionBy(*by).orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        above = every.unionByName(ask).withColumn("above", run).where("kind = 1")
        return above.withColumn("above", F.col("above") - (F.col("self") > F.col("at")).cast("int"))

    means = m.select(*keys, "gene", "mean").distinct()
    own = placed(means.withColumnRenamed("mean", "at"), m.select(*keys, "repeat", "gene", F.col("score").cast("double").alias("at"), F.col("mean").alias("self")), keys)
    others = placed(m.select(*keys, F.col("repeat").alias("r"), F.col("score").cast("double").alias("at")), m.select(*keys, F.col("repeat").alias("r"), "repeat", "gene", F.col("mean").alias("at"), F.col("score").cast("double").alias("self")), [*keys, "r"])
    sd = lambda d, name: d.join(n, [*keys, "repeat"]).groupBy(*keys, "gene").agg(F.stddev_samp(F.col("above") / F.greatest(F.col("n") - 1, F.lit(1))).alias(name))
    return rank_sd(df, keys).select(*keys, "gene", "rank_sd").join(sd(own, "own_sd"), [*keys, "gene"]).join(sd(others, "others_sd"), [*keys, "gene"])


def network_stability(per_arm: DataFrame, described: DataFrame, network: str, value: str, columns: list[str]) -> DataFrame:
    """predictor, n, rho, rho_least, rho_most: rank correlation of an arm's stability with its network's descriptors, over all arms and, at its least and most, with each network left out."""
    from .stats import spearman

    j = per_arm.join(described, network)
    left = j.select(F.col(network).alias("left_out")).distinct()
    out = None
    for c in columns:  # a handful of descriptors
        full = spearman(j.withColumn("_k", F.lit(0)), ["_k"], value, c).select("n", "rho")
        each = spearman(j.crossJoin(F.broadcast(left)).where(F.col(network) != F.col("left_out")), ["left_out"], value, c).agg(F.min("rho").alias("rho_least"), F.max("rho").alias("rho_most"))
        x = full.crossJoin(each).select(F.lit(c).alias("predictor"), "n", "rho", "rho_least", "rho_most")
        out = x if out is None else out.unionByName(x)
    return out


def scorecard(tradeoff: DataFrame, keys: list[str], tolerance: float = 0.010) -> DataFrame:
    """keys, check, holds of a trade-off (keys, shrink, auroc, rank_sd): the spread never grows with shrinkage, some shrinkage cuts it by a tenth or more, AUROC stays within the tolerance at full shrinkage, and some shrinkage keeps it while the spread falls."""
    w = Window.partitionBy(*keys).orderBy("shrink")
    t = tradeoff.withColumn("_before", F.lag("rank_sd").over(w)).withColumn("_base", F.first("auroc").over(w)).withColumn("_sd", F.first("rank_sd").over(w)).withColumn("_last", F.max("shrink").over(Window.partitionBy(*keys)))
    near = F.col("auroc") >= F.col("_base") - tolerance
    c = t.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("rank_sd") <= F.col("_before") + 1e-12, F.lit(True))).alias("monotone"), F.bool_or(F.col("rank_sd") <= 0.9 * F.col("_sd")).alias("tenth"), F.bool_and((F.col("shrink") < F.col("_last")) | near).alias("full_keeps"), F.bool_or(near & (F.col("rank_sd") < F.col("_sd"))).alias("some_keeps"))
    return c.select(*keys, F.explode(F.create_map(*[x for n in ("monotone", "tenth", "full_keeps", "some_keeps") for x in (F.lit(n), F.col(n))])).alias("check", "holds"))


def within_and_transfer(within: DataFrame, transferred: DataFrame, keys: list[str]) -> DataFrame:
    """keys, system (within, transfer), n, mean, sd of `delta`: how a margin holds inside a label set and from one to another."""
    both = within.select(*keys, F.lit("within").alias("system"), "delta").unionByName(transferred.select(*keys, F.lit("transfer").alias("system"), "delta"))
    return both.groupBy(*keys, "system").agg(F.count("*").alias("n"), F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd"))
