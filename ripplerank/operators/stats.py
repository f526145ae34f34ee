"""Intervals, tests and models on small result tables, as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions.columns import uniform
from ..sources.shared import cut, mid_ranks, numbered
from . import ranks


def unit_values(margins: DataFrame, keys: list[str], unit: str = "repeat", value: str = "delta") -> DataFrame:
    """keys, unit, value: means over the folds of a repeat, or the folds themselves."""
    return margins.groupBy(*keys, "repeat", *([] if unit == "repeat" else ["fold"])).agg(F.avg(value).alias("value"))


def summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, mean, sd, se of `value`."""
    return df.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).withColumn("se", F.col("sd") / F.sqrt("n"))


def t_interval(df: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    """keys, n, mean, sd, se, low, high."""
    q = D.column(lambda n: D.t_ppf(0.5 + level / 2, n - 1) if n > 1 else float("nan"))
    s = summary(df, keys).withColumn("_q", q(F.col("n").cast("double")))
    return s.select(*keys, "n", "mean", "sd", "se", (F.col("mean") - F.col("_q") * F.col("se")).alias("low"), (F.col("mean") + F.col("_q") * F.col("se")).alias("high"))


def ordered_mean(values) -> F.Column:
    """Mean of an array, summed in the order of its values: the same on any number of partitions."""
    return F.try_divide(F.aggregate(F.array_sort(values), F.lit(0.0), lambda s, x: s + x), F.size(values))


def bootstrap(df: DataFrame, keys: list[str], replicates: int = 1000, seed: str = "boot") -> DataFrame:
    """keys, rep, value: means of resamples with replacement by the portable generator.

    The values of a group are numbered; draw i of a replicate is the value of a hashed number. Replicates are rows, so groups and replicates run side by side.
    """
    w = Window.partitionBy(*keys)
    tie = [c for c in df.columns if c not in {*keys, "value"}]
    numbered = df.where("value is not null").withColumn("_i", F.row_number().over(w.orderBy(*tie, "value")) - 1).withColumn("_n", F.count("*").over(w))
    salt = F.concat(F.lit(f"{seed}|"), F.col("rep").cast("string"))
    draws = numbered.select(*keys, "_n", "_i").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_at", F.floor(uniform(F.col("_i"), salt) * F.col("_n")))
    drawn = draws.drop("_i").join(numbered.select(*[F.col(k).alias(f"_k{j}") for j, k in enumerate(keys)], F.col("_i").alias("_at2"), "value"), [*[F.col(k).eqNullSafe(F.col(f"_k{j}")) for j, k in enumerate(keys)], F.col("_at") == F.col("_at2")])
    return drawn.groupBy(*keys, "rep").agg(F.collect_list("value").alias("_v")).select(*keys, "rep", ordered_mean("_v").alias("value"))


def percentile_interval(df: DataFrame, keys: list[str], replicates: int = 1000, level: float = 0.95, seed: str = "boot") -> DataFrame:
    b = bootstrap(df, keys, replicates, seed)
    return b.groupBy(*keys).agg(F.percentile("value", F.lit((1 - level) / 2)).alias("low"), F.percentile("value", F.lit((1 + level) / 2)).alias("high"))


def bca_interval(df: DataFrame, keys: list[str], replicates: int = 1000, level: float = 0.95, seed: str = "boot") -> DataFrame:
    """keys, low, high: bias-corrected and accelerated; acceleration from leave-one-out means.

    Means are summed in one order and compared at 12 decimals, so that a resample that is a permutation of the sample ties with it wherever it is computed. The
    share of resamples below the mean is kept at least 1 / (2 * replicates) from 0 and 1; without spread there is no acceleration; fewer than three values have the t interval.
    """
    good = df.where("value is not null")
    own = good.groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("value").cast("double"))).alias("x"))
    add = lambda xs, f: F.aggregate(F.transform(xs, f), F.lit(0.0), lambda s, x: s + x)
    own = own.withColumn("n", F.size("x")).withColumn("sum", add("x", lambda v: v)).withColumn("j", F.transform("x", lambda v: F.try_divide(F.col("sum") - v, F.col("n") - 1)))
    own = own.withColumn("m", F.try_divide(add("j", lambda v: v), F.col("n")))
    cube = add("j", lambda v: (F.col("m") - v) * (F.col("m") - v) * (F.col("m") - v))
    square = add("j", lambda v: (F.col("m") - v) * (F.col("m") - v))
    base = own.select(*keys, (F.col("sum") / F.col("n")).alias("mean"), F.when(square > 0, cube / (6 * F.pow(square, F.lit(1.5)))).otherwise(F.lit(0.0)).alias("a"))
    b = bootstrap(good, keys, replicates, seed)
    b = b.join(base, keys) if keys else b.crossJoin(base)
    less = (F.round("value", 12) < F.round("mean", 12)).cast("double")
    per = b.groupBy(*keys).agg(F.avg(less).alias("p"), F.max("a").alias("a"), F.array_sort(F.collect_list("value")).alias("v"))
    least = 1 / (2 * replicates)
    at = D.column(lambda p, a, q: _bca_share(min(max(p, least), 1 - least), a, q))
    place = lambda q: at("p", "a", F.lit(q)) * (F.size("v") - 1)
    pick = lambda c: F.element_at("v", F.floor(c).cast("int") + 1) + (c - F.floor(c)) * (F.element_at("v", F.least(F.ceil(c).cast("int") + 1, F.size("v"))) - F.element_at("v", F.floor(c).cast("int") + 1))
    per = per.withColumn("_l", place((1 - level) / 2)).withColumn("_h", place((1 + level) / 2))
    few = t_interval(good, keys, level).select(*keys, "n", F.col("low").alias("_tl"), F.col("high").alias("_th"))
    out = per.join(few, keys) if keys else per.crossJoin(few)
    return out.select(*keys, F.when(F.col("n") < 3, F.col("_tl")).otherwise(pick(F.col("_l"))).alias("low"), F.when(F.col("n") < 3, F.col("_th")).otherwise(pick(F.col("_h"))).alias("high"))


def _bca_share(p: float, a: float, q: float) -> float:
    """The share of the resamples that a bound at q moves to."""
    z = D.normal_ppf(p) + D.normal_ppf(q)
    return min(max(1 - D.normal_sf(D.normal_ppf(p) + z / (1 - a * z)), 0.0), 1.0)


def tost(df: DataFrame, keys: list[str], bound: float = 0.01, alpha: float = 0.05) -> DataFrame:
    """keys, n, mean, sd, se, t_low, t_high, p_low, p_high, p_tost, ci90_low, ci90_high, ci95_low, ci95_high, verdict: two one-sided tests against +-bound at alpha, and the intervals at 1 - 2 alpha and 1 - alpha.

    equivalent (both tests reject) or, by the mean, superior, inferior or open; `zero variance` without spread and `insufficient data` below two values have neither tests nor intervals.
    """
    s = summary(df, keys)
    usable = (F.col("n") > 1) & (F.col("sd") > 0)
    when = lambda c: F.when(usable, c)
    sf = D.column(lambda t, n: D.t_sf(t, n - 1))
    n = F.col("n").cast("double")
    quantile = lambda q: D.column(lambda k: D.t_ppf(q, k - 1) if k > 1 else float("nan"))(n)
    s = s.withColumn("t_low", when((F.col("mean") + bound) / F.col("se"))).withColumn("t_high", when((F.col("mean") - bound) / F.col("se")))
    s = s.withColumn("p_low", when(sf("t_low", n))).withColumn("p_high", when(sf(-F.col("t_high"), n))).withColumn("p_tost", F.greatest("p_low", "p_high"))
    for name, q in (("ci90", 1 - alpha), ("ci95", 1 - alpha / 2)):
        s = s.withColumn("_q", quantile(q)).withColumns({f"{name}_low": when(F.col("mean") - F.col("_q") * F.col("se")), f"{name}_high": when(F.col("mean") + F.col("_q") * F.col("se"))}).drop("_q")
    verdict = F.when(F.col("n") < 2, "insufficient data").when(F.col("sd") == 0, "zero variance").when((F.col("p_low") < alpha) & (F.col("p_high") < alpha), "equivalent")
    return s.withColumn("verdict", verdict.when(F.col("mean") > bound, "superior").when(F.col("mean") < -bound, "inferior").otherwise("open"))


def bh(df: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """df with q and reject (q < 0.05): Benjamini-Hochberg in each group of keys."""
    most = ranks.largest(df, keys)
    placed = ranks.by_group(df, keys, [p, *[c for c in df.columns if c not in {*keys, p}]], most=most)
    least = ranks.least_after(placed.withColumn("_q", F.col(p) * F.col("_size") / F.col("_place")), keys, ["_place"], "_q", "q", most)
    return least.withColumn("q", F.least(F.lit(1.0), "q")).withColumn("reject", F.col("q") < 0.05).drop("_q", "_place", "_size")


def meta(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k, fixed, fixed_se, q_stat, tau2, random, random_se of rows with mean and se: inverse variance, and DerSimonian-Laird."""
    w = 1 / (F.col("se") * F.col("se"))
    s = df.groupBy(*keys).agg(F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * F.col("mean")).alias("swm"), F.sum(w * F.col("mean") * F.col("mean")).alias("swmm"))
    s = s.withColumn("fixed", F.col("swm") / F.col("sw")).withColumn("fixed_se", F.sqrt(1 / F.col("sw"))).withColumn("q_stat", F.col("swmm") - F.col("swm") * F.col("swm") / F.col("sw"))
    s = s.withColumn("tau2", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q_stat") - (F.col("k") - 1), F.col("sw") - F.col("sww") / F.col("sw")), F.lit(0.0))))
    j = df.join(s, keys) if keys else df.crossJoin(s)
    v = 1 / (F.col("se") * F.col("se") + F.col("tau2"))
    cols = ["k", "fixed", "fixed_se", "q_stat", "tau2"]
    return j.groupBy(*keys, *cols).agg((F.sum(v * F.col("mean")) / F.sum(v)).alias("random"), F.sqrt(1 / F.sum(v)).alias("random_se"))


def anova(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: sums of squares of a two-way layout of `value` (a, b, interaction, within), F ratios and shares of the total."""
    wa, wb, wab, all_ = Window.partitionBy(a), Window.partitionBy(b), Window.partitionBy(a, b), F.avg("value")
    g = df.crossJoin(F.broadcast(df.agg(all_.alias("m")))).withColumn("ma", F.avg("value").over(wa)).withColumn("mb", F.avg("value").over(wb)).withColumn("mab", F.avg("value").over(wab))
    sq = lambda x: F.sum(x * x)
    s = g.agg(sq(F.col("ma") - F.col("m")).alias("ss_a"), sq(F.col("mb") - F.col("m")).alias("ss_b"), sq(F.col("mab") - F.col("ma") - F.col("mb") + F.col("m")).alias("ss_ab"), sq(F.col("value") - F.col("mab")).alias("ss_within"), F.count_distinct(a).alias("na"), F.count_distinct(b).alias("nb"), F.count("*").alias("n"))
    within = F.try_divide(F.col("ss_within"), F.col("n") - F.col("na") * F.col("nb"))
    s = s.withColumn("f_a", F.try_divide(F.try_divide(F.col("ss_a"), F.col("na") - 1), within)).withColumn("f_b", F.try_divide(F.try_divide(F.col("ss_b"), F.col("nb") - 1), within))
    total = F.col("ss_a") + F.col("ss_b") + F.col("ss_ab") + F.col("ss_within")
    return s.select("ss_a", "ss_b", "ss_ab", "ss_within", "f_a", "f_b", (F.col("ss_a") / total).alias("share_a"), (F.col("ss_b") / total).alias("share_b"), (F.col("ss_ab") / total).alias("share_ab"), (F.col("ss_within") / total).alias("share_within"))


def icc(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """keys, msb, msw, icc, design_effect of `value` in groups of about equal size."""
    g = df.groupBy(*keys, group).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    s = g.groupBy(*keys).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("ssw"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), F.lit(2)) / F.sum("n")).alias("ssb"))
    s = s.withColumn("msb", F.try_divide(F.col("ssb"), F.col("k") - 1)).withColumn("msw", F.try_divide(F.col("ssw"), F.col("n") - F.col("k"))).withColumn("size", F.col("n") / F.col("k"))
    s = s.withColumn("icc", F.try_divide(F.col("msb") - F.col("msw"), F.col("msb") + (F.col("size") - 1) * F.col("msw")))
    return s.select(*keys, "msb", "msw", "icc", (1 + (F.col("size") - 1) * F.col("icc")).alias("design_effect"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, rho, pearson."""
    most = ranks.largest(df, keys)
    r = ranks.mid_ranks(ranks.mid_ranks(df, keys, x, "_x", most), keys, y, "_y", most)
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("rho"), F.corr(x, y).alias("pearson"))


def permutation(df: DataFrame, x: str, y: str, key: str, permutations: int = 1000, seed: str = "perm") -> DataFrame:
    """One row: rho, how many of the hashed permutations reach its size, p = (k + 1) / (n + 1)."""
    r = cut(numbered(mid_ranks(mid_ranks(df, x, "_x"), y, "_y"), [key], name="_i").withColumn("_i", F.col("_i") + 1), "ranked")
    perms = r.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    salt = F.concat(F.lit(f"{seed}|"), F.col("perm").cast("string"))
    dealt = perms.withColumn("_at", F.row_number().over(Window.partitionBy("perm").orderBy(uniform(F.col("_i"), salt), "_i")))
    paired = dealt.select("perm", "_i", "_x", "_at").join(r.select(F.col("_i").alias("_at"), F.col("_y").alias("_other")), "_at")
    rho = r.agg(F.corr("_x", "_y").alias("rho"))
    sims = paired.groupBy("perm").agg(F.corr("_x", "_other").alias("r"))
    return sims.crossJoin(F.broadcast(rho)).groupBy("rho").agg(F.count_if(F.abs("r") >= F.abs("rho") - 1e-12).alias("k"), F.count("*").alias("n")).withColumn("p", (F.col("k") + 1) / (F.col("n") + 1))


def kruskal(df: DataFrame, group: str) -> DataFrame:
    """One row: n, groups, h with tie correction, p, eta2 of `value`."""
    r = mid_ranks(df, "value", "_r")
    g = r.groupBy(group).agg(F.count("*").alias("n"), F.sum("_r").alias("s"))
    ties = df.groupBy("value").count().agg(F.sum(F.pow("count", F.lit(3)) - F.col("count")).alias("t"))
    s = g.agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q")).crossJoin(F.broadcast(ties))
    n = F.col("n")
    h = (12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("t") / (F.pow(n, F.lit(3)) - n))
    s = s.withColumn("h", h)
    return s.select("n", "groups", "h", D.column(D.chi2_sf)("h", (F.col("groups") - 1).cast("double")).alias("p"), ((F.col("h") - F.col("groups") + 1) / (n - F.col("groups"))).alias("eta2"))


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """term, coef, se, t, p, partial_r2, and r2, rss, n of the whole: normal equations from one aggregate; the driver solves a matrix of len(xs) + 1 columns."""
    import numpy as np

    cols = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
    good = df.where(" and ".join(f"{c} is not null" for c in [y, *xs]))
    sums = [F.sum(a * b) for a in cols for b in cols] + [F.sum(a * F.col(y)) for a in cols] + [F.sum(F.col(y) * F.col(y)), F.sum(F.col(y)), F.count("*")]
    r, k = list(good.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()), len(cols)
    m, v = np.array(r[: k * k], float).reshape(k, k), np.array(r[k * k : k * k + k], float)
    inv = np.linalg.pinv(m)
    beta, yy, sy, n = inv @ v, r[-3], r[-2], r[-1]
    rss = float(yy - 2 * beta @ v + beta @ m @ beta)
    se = np.sqrt(np.maximum(np.diag(inv) * rss / max(n - k, 1), 0))
    rows = [(t, float(b), float(s), float(b / s) if s else None, float(2 * D.t_sf(abs(b / s), n - k)) if s else None, float((b / s) ** 2 / ((b / s) ** 2 + n - k)) if s else None, 1 - rss / (yy - sy * sy / n), rss, n) for t, b, s in zip(["intercept", *xs], beta, se, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, t double, p double, partial_r2 double, r2 double, rss double, n long")


def null_z(observed: DataFrame, null: DataFrame, keys: list[str], kind: str = "sd") -> DataFrame:
    """keys, observed, null_mean, null_sd, q05, q50, q95, z, p: against null values; z over the SD, or over the SE with kind `se`."""
    n = null.groupBy(*keys).agg(F.avg("value").alias("null_mean"), F.stddev_samp("value").alias("null_sd"), F.percentile("value", F.lit(0.05)).alias("q05"), F.percentile("value", F.lit(0.5)).alias("q50"), F.percentile("value", F.lit(0.95)).alias("q95"), F.count("*").alias("n"))
    scale = F.col("null_sd") if kind == "sd" else F.col("null_sd") / F.sqrt("n")
    j = observed.join(n, keys) if keys else observed.crossJoin(n)
    j = j.withColumn("z", F.try_divide(F.col("value") - F.col("null_mean"), scale))
    return j.select(*keys, F.col("value").alias("observed"), "null_mean", "null_sd", "q05", "q50", "q95", "z", D.column(D.normal_sf)("z").alias("p"))


def hypergeometric(df: DataFrame) -> DataFrame:
    """df (hits, population, good, draws) with p: chance of at least so many hits."""
    return df.withColumn("p", D.column(lambda k, m, g, d: D.hypergeom_sf(int(k) - 1, int(m), int(g), int(d)))(*[F.col(c).cast("double") for c in ("hits", "population", "good", "draws")]))


def gene_bootstrap(scored: DataFrame, keys: list[str], replicates: int = 200, seed: str = "genes") -> DataFrame:
    """keys, rep, auroc: multiplicities of genes, drawn once a replicate and shared by all groups, weight the AUROC."""
    from .metrics import auroc

    genes = numbered(scored.select("gene").distinct(), ["gene"], name="_i")
    n = genes.agg(F.count("*").alias("_n"))
    grid = genes.crossJoin(F.broadcast(n)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    salt = F.concat(F.lit(f"{seed}|"), F.col("rep").cast("string"))
    drawn = grid.select("rep", F.floor(uniform(F.col("_i"), salt) * F.col("_n")).alias("_i")).groupBy("rep", "_i").agg(F.count("*").cast("double").alias("w"))
    return auroc(scored.join(drawn.join(genes, "_i").select("rep", "gene", "w"), "gene"), [*keys, "rep"], "w")


def gene_interval(scored: DataFrame, keys: list[str], cells: list[str], replicates: int = 1000, level: float = 0.95, one: str = "rwr", other: str = "degree", seed: str = "genes") -> DataFrame:
    """keys, low, high, boot_mean, boot_sd, observed_mean, observed_sd, n_cells, n_boot: the percentile interval over genes of the mean difference in AUROC of two methods.

    scored: keys, cells (repeat, fold), method, gene, y, score. Genes are drawn with replacement once a replicate and shared by all cells, so a gene moves as a block; a replicate's value is the mean over
    the cells in which both methods have both classes, and replicates without such a cell are left out.
    """
    from .metrics import auroc

    scored = cut(scored.select(*keys, *cells, "method", "gene", "y", "score"), "scored")

    def differences(d: DataFrame, by: list[str]) -> DataFrame:
        of = lambda m: F.max(F.when(F.col("method") == m, F.col("auroc")))
        return d.groupBy(*by).agg((of(one) - of(other)).alias("delta")).where("delta is not null")

    own = differences(auroc(scored, [*keys, *cells, "method"]), [*keys, *cells])
    boot = differences(gene_bootstrap(scored, [*keys, *cells, "method"], replicates, seed), [*keys, *cells, "rep"]).groupBy(*keys, "rep").agg(F.avg("delta").alias("value"))
    q = lambda p: F.percentile("value", F.lit(p))
    b = boot.groupBy(*keys).agg(q((1 - level) / 2).alias("low"), q((1 + level) / 2).alias("high"), F.avg("value").alias("boot_mean"), F.stddev_samp("value").alias("boot_sd"), F.count("*").alias("n_boot"))
    o = own.groupBy(*keys).agg(F.avg("delta").alias("observed_mean"), F.stddev_samp("delta").alias("observed_sd"), F.count("*").alias("n_cells"))
    both = b.join(o, keys) if keys else b.crossJoin(o)
    return both.select(*keys, "low", "high", "boot_mean", "boot_sd", "observed_mean", "observed_sd", "n_cells", "n_boot")


def one_sample_t(df: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    """keys, n, mean, sd, se, t, p (one-sided, for a mean over 0), d (mean over sd) and low, high (normal limits) of `value`; null t, p and d without spread."""
    s = summary(df, keys).withColumn("t", F.try_divide(F.col("mean"), F.col("se"))).withColumn("d", F.try_divide(F.col("mean"), F.col("sd")))
    z = D.normal_ppf(0.5 + level / 2)
    p = D.column(lambda t, n: D.t_sf(t, n - 1) if n > 1 else float("nan"))
    return s.withColumn("p", p("t", F.col("n").cast("double"))).withColumn("low", F.col("mean") - z * F.col("se")).withColumn("high", F.col("mean") + z * F.col("se"))


def paired_t(df: DataFrame, keys: list[str], one: str, other: str) -> DataFrame:
    """one_sample_t() of the differences of two columns."""
    return one_sample_t(df.withColumn("value", F.col(one) - F.col(other)), keys)


def all_units(margins: DataFrame, keys: list[str], value: str = "delta", replicates: int = 1000) -> DataFrame:
    """keys, unit (fold, repeat), method (percentile, t, bca), n, mean, low, high: every interval over either unit."""
    out = None
    for unit in ("fold", "repeat"):
        u = unit_values(margins, keys, unit, value).withColumn("value", F.round("value", 10))
        base = summary(u, keys).select(*keys, "n", "mean")
        ways = {"percentile": percentile_interval(u, keys, replicates), "t": t_interval(u, keys).select(*keys, "low", "high"), "bca": bca_interval(u, keys, replicates)}
        for name, d in ways.items():
            x = base.join(d, keys).select(*keys, F.lit(unit).alias("unit"), F.lit(name).alias("method"), "n", "mean", "low", "high")
            out = x if out is None else out.unionByName(x)
    return out


def verdict(intervals: DataFrame, by: list[str], arm: list[str]) -> DataFrame:
    """by, arms, excluding, holds, failing: in how many arms an interval lies over 0, whether in all, and which ones fail, in order."""
    name = F.concat_ws("/", *[F.col(c).cast("string") for c in arm])
    over = F.col("low") > 0
    return intervals.groupBy(*by).agg(F.count("*").alias("arms"), F.count_if(over).alias("excluding"), F.bool_and(over).alias("holds"), F.array_join(F.array_sort(F.collect_list(F.when(~over, name))), ";").alias("failing"))


def standardise(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """df with each column less its mean over its sample SD, in each group of keys; null without spread. Means and SDs are one aggregate, joined back."""
    keys = keys or []
    m = df.groupBy(*keys).agg(*[f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    j = df.join(m, keys) if keys else df.crossJoin(F.broadcast(m))
    out = j.withColumns({c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in columns})
    return out.select(*df.columns)


def variance_components(df: DataFrame, a: str, b: str) -> DataFrame:
    """component (a, b, ab, within), variance, share, f, p of `value`: random effects of a balanced two-way layout by expected mean squares, negative ones 0; f of a and b over the interaction, of the interaction over within."""
    sums = anova(df, a, b).crossJoin(df.agg(F.count_distinct(a).alias("na"), F.count_distinct(b).alias("nb"), F.count("*").alias("n")))
    df_a, df_b, df_ab, df_w = F.col("na") - 1, F.col("nb") - 1, (F.col("na") - 1) * (F.col("nb") - 1), F.col("n") - F.col("na") * F.col("nb")
    per = F.col("n") / (F.col("na") * F.col("nb"))
    ms = {k: F.try_divide(F.col(f"ss_{k}"), d) for k, d in (("a", df_a), ("b", df_b), ("ab", df_ab), ("within", df_w))}
    s = sums.select(*[ms[k].alias(k) for k in ms], per.alias("per"), "na", "nb", df_a.alias("df_a"), df_b.alias("df_b"), df_ab.alias("df_ab"), df_w.alias("df_w"))
    zero = lambda c: F.greatest(c, F.lit(0.0))
    c, ab, w = F.col, F.col("ab"), F.col("within")
    parts = [("a", zero((c("a") - ab) / (c("per") * c("nb"))), F.try_divide(c("a"), ab), c("df_a"), c("df_ab")), ("b", zero((c("b") - ab) / (c("per") * c("na"))), F.try_divide(c("b"), ab), c("df_b"), c("df_ab")), ("ab", zero((ab - w) / c("per")), F.try_divide(ab, w), c("df_ab"), c("df_w")), ("within", w, F.lit(None).cast("double"), c("df_w"), c("df_w"))]
    rows = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("component"), v.alias("variance"), f.alias("f"), x.cast("double").alias("d1"), y.cast("double").alias("d2")) for k, v, f, x, y in parts])).alias("r")).select("r.*")
    total = F.sum("variance").over(Window.partitionBy(F.lit(1)))  # four rows
    return rows.withColumn("share", F.col("variance") / total).withColumn("p", D.column(D.f_sf)("f", "d1", "d2")).select("component", "variance", "share", "f", "p")


def principal_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """component, share, and the loading of each column: principal components of the correlation matrix. The driver gets that matrix only."""
    import numpy as np

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    r = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)], F.count("*").alias("n")).first()
    m = np.eye(len(columns))
    for i, (a, b) in enumerate(pairs):
        m[columns.index(a), columns.index(b)] = m[columns.index(b), columns.index(a)] = r[f"r{i}"] or 0.0
    value, vector = np.linalg.eigh(m)
    rows = []
    for i, k in enumerate(np.argsort(-value)):
        v = vector[:, k] * (1 if vector[np.argmax(np.abs(vector[:, k])), k] > 0 else -1)
        rows.append((i + 1, float(value[k] / value.sum()), *map(float, v)))
    return df.sparkSession.createDataFrame(rows, "component int, share double, " + ", ".join(f"`{c}` double" for c in columns))


def left_out_r2(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, r2: how much of each column a linear model of the others explains."""
    out = None
    for c in columns:  # a handful of columns
        x = ols(df, c, [o for o in columns if o != c]).limit(1).select(F.lit(c).alias("column"), "r2")
        out = x if out is None else out.unionByName(x)
    return out
