"""Controls around an arm: cleaned backgrounds, provenance, nested models, robust z, simulation, audits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..sources.shared import cut, numbered
from . import graph, metrics
from .ranks import by_group
from .stats import hypergeometric


def clean_background(splits: DataFrame, catalogue: DataFrame) -> DataFrame:
    """splits without the negatives that a catalogue lists; its positives stay."""
    return splits.join(catalogue.select("gene", F.lit(0).alias("y")).distinct(), ["gene", "y"], "left_anti")


def contamination(splits: DataFrame, catalogue: DataFrame) -> DataFrame:
    """repeat, fold, negatives, listed, frac: how many of a fold's negatives another catalogue lists."""
    marked = splits.where("y = 0").join(catalogue.select("gene", F.lit(1).alias("_in")).distinct(), "gene", "left")
    return marked.groupBy("repeat", "fold").agg(F.count("*").alias("negatives"), F.count("_in").alias("listed"), (F.count("_in") / F.count("*")).alias("frac"))


def arbitration(scored: DataFrame, known: DataFrame, untouched: DataFrame, keys: list[str]) -> DataFrame:
    """keys, auroc of genes of an untouched catalogue against the rest, genes already known left out."""
    rest = scored.drop("y").join(known.select("gene").distinct(), "gene", "left_anti")
    return metrics.auroc(rest.join(untouched.select("gene", F.lit(1).alias("_y")).distinct(), "gene", "left").withColumn("y", F.coalesce("_y", F.lit(0))), keys)


def class_means(df: DataFrame, member: str, group: str) -> DataFrame:
    """group, members, mean, sd: means of `value` per member, then over the members of a group."""
    one = df.groupBy(group, member).agg(F.avg("value").alias("value"))
    return one.groupBy(group).agg(F.count("*").alias("members"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def cap_search(edges: DataFrame, target: int, steps: int = 18) -> tuple[DataFrame, int]:
    """(edges of the largest component of the k strongest edges, k): the k whose component comes nearest to a number of edges, by bisection on the driver."""
    placed = graph.cut(numbered(edges, [F.desc("weight"), "gene_a", "gene_b"], name="_k").withColumn("_k", F.col("_k") + 1), "placed")
    low, high, best = 1, placed.count(), None
    for _ in range(steps):
        if low > high:
            break
        k = (low + high) // 2
        part = graph.cut(graph.largest_component(placed.where(F.col("_k") <= k)), "lcc")
        n = part.count()
        if best is None or abs(n - target) < abs(best[2] - target):
            best = (part, k, n)
        if n == target:
            break
        low, high = (k + 1, high) if n < target else (low, k - 1)
    return best[0], best[1]


def robust_z(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with z: distance of `value` from the group's median over 1.4826 times the median absolute deviation; null without spread."""
    m = df.groupBy(*keys).agg(F.percentile("value", F.lit(0.5)).alias("_m"))
    d = df.join(m, keys)
    s = d.groupBy(*keys).agg((1.4826 * F.percentile(F.abs(F.col("value") - F.col("_m")), F.lit(0.5))).alias("_s"))
    return d.join(s, keys).withColumn("z", F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def fine_z(observed: DataFrame, null: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """keys, units, mean_z, joint_z: z of each unit (fold) against its own null values, and their mean times the root of their number."""
    n = null.groupBy(*keys, unit).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    z = observed.join(n, [*keys, unit]).where("s > 0").withColumn("z", (F.col("value") - F.col("m")) / F.col("s"))
    return z.groupBy(*keys).agg(F.count("*").alias("units"), F.avg("z").alias("mean_z"), (F.avg("z") * F.sqrt(F.count("*"))).alias("joint_z"))


def nested_f(df: DataFrame, y: str, small: list[str], large: list[str]) -> DataFrame:
    """One row: rss of two linear models, F and p of what the larger adds."""
    from .stats import ols

    a, b = ols(df, y, small).first(), ols(df, y, large).first()
    extra, rest = len(large) - len(small), b["n"] - len(large) - 1
    f = (a["rss"] - b["rss"]) / extra / (b["rss"] / rest)
    return df.sparkSession.createDataFrame([(a["rss"], b["rss"], float(f), float(D.f_sf(f, extra, rest)))], "rss_small double, rss_large double, f double, p double")


def within_slope(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    """One row: slope of y on x within groups (fixed effects), its cluster-robust SE, and in how many groups its sign holds."""
    w = Window.partitionBy(group)
    d = df.select(group, (F.col(x) - F.avg(x).over(w)).alias("_x"), (F.col(y) - F.avg(y).over(w)).alias("_y"))
    slope = d.agg((F.sum(F.col("_x") * F.col("_y")) / F.sum(F.col("_x") * F.col("_x"))).alias("slope"), F.sum(F.col("_x") * F.col("_x")).alias("_sxx"))
    own = d.crossJoin(F.broadcast(slope)).groupBy(group, "slope", "_sxx").agg(F.sum(F.col("_x") * (F.col("_y") - F.col("slope") * F.col("_x"))).alias("_u"), F.sum(F.col("_x") * F.col("_y")).alias("_sxy"))
    return own.groupBy("slope", "_sxx").agg(F.sqrt(F.sum(F.col("_u") * F.col("_u"))).alias("_r"), F.count_if(F.signum("_sxy") == F.signum("slope")).alias("same_sign"), F.count("*").alias("groups")).select("slope", (F.col("_r") / F.col("_sxx")).alias("se"), "same_sign", "groups")


def leave_one_out_r2(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """keys, n, r2, loo_r2 of a line: residuals over 1 - leverage stand for refits without each row."""
    w = Window.partitionBy(*keys)
    mx, my = F.avg(x).over(w), F.avg(y).over(w)
    d = df.select(*keys, (F.col(x) - mx).alias("_x"), (F.col(y) - my).alias("_y"), F.count("*").over(w).alias("_n"))
    s = d.withColumn("_sxx", F.sum(F.col("_x") * F.col("_x")).over(w)).withColumn("_b", F.try_divide(F.sum(F.col("_x") * F.col("_y")).over(w), F.col("_sxx")))
    e = F.col("_y") - F.col("_b") * F.col("_x")
    h = 1.0 / F.col("_n") + F.try_divide(F.col("_x") * F.col("_x"), F.col("_sxx"))
    loo = F.try_divide(e, 1 - h)
    total = F.sum(F.col("_y") * F.col("_y"))
    return s.groupBy(*keys).agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum(e * e), total)).alias("r2"), (1 - F.try_divide(F.sum(loo * loo), total)).alias("loo_r2"))


def participation(df: DataFrame, columns: list[str]) -> DataFrame:
    """component, share, ratio: eigenvalues of the correlation matrix of some columns, and how many of them count: their squared sum over the sum of squares. The driver gets the matrix only."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    r = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)], F.count("*").alias("n")).first()
    m = np.eye(len(columns))
    for i, (a, b) in enumerate(pairs):
        m[columns.index(a), columns.index(b)] = m[columns.index(b), columns.index(a)] = r[f"r{i}"] or 0.0
    v = np.sort(np.linalg.eigvalsh(m))[::-1]
    ratio = float(v.sum() ** 2 / (v**2).sum())
    return df.sparkSession.createDataFrame([(i + 1, float(x / v.sum()), ratio) for i, x in enumerate(v)], "component int, share double, ratio double")


def coverage_simulation(spark, iterations: int = 1000, n: int = 40, effect: float = 0.0, within: float = 0.5, groups: int = 8, seed: int = 42) -> DataFrame:
    """method, coverage, width: how often t intervals over units and over group means hold the truth when units of a group share a part of their noise."""
    t_unit, t_group = D.t_ppf(0.975, n - 1), D.t_ppf(0.975, groups - 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for i in frame["id"].tolist():
                rng = np.random.default_rng([seed, i])
                x = effect + np.repeat(rng.normal(size=groups), -(-n // groups))[:n] * np.sqrt(within) + rng.normal(size=n) * np.sqrt(1 - within)
                for method, v, q in (("unit", x, t_unit), ("group", np.array([g.mean() for g in np.array_split(x, groups)]), t_group)):
                    half = q * v.std(ddof=1) / np.sqrt(len(v))
                    out.append((method, float(abs(v.mean() - effect) <= half), 2 * half))
            yield pd.DataFrame(out, columns=["method", "held", "width"])

    return spark.range(iterations).repartition(8).mapInPandas(run, "method string, held double, width double").groupBy("method").agg(F.avg("held").alias("coverage"), F.avg("width").alias("width"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows that only a, and only b, has (repeats count)."""
    return a.exceptAll(b).agg(F.count("*").alias("only_a")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("only_b")))


def facts(**named: tuple[DataFrame, str]) -> DataFrame:
    """quantity, value: one number from each (table, SQL aggregate)."""
    out = None
    for name, (df, what) in named.items():
        row = df.agg(F.expr(what).cast("double").alias("value")).select(F.lit(name).alias("quantity"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def compare_facts(want: DataFrame, have: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """quantity, status (PASS, FAIL, MISSING) of two tables of facts."""
    h = have.withColumnRenamed("value", "found")
    status = F.when(F.col("found").isNull(), "MISSING").when(F.abs(F.col("found") - F.col("value")) <= tolerance, "PASS").otherwise("FAIL")
    return want.join(h, "quantity", "left").select("quantity", status.alias("status"))


def audit(checks: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """test_id, status (PASS, FAIL), message of named checks: one row with `n`, and the condition that it should meet."""
    out = None
    for name, (df, holds) in checks.items():  # named by the caller
        row = df.select(F.lit(name).alias("test_id"), F.when(F.expr(holds), "PASS").otherwise("FAIL").alias("status"), F.col("n").cast("string").alias("message"))
        out = row if out is None else out.unionByName(row)
    return out


def line_enrichment(scored: DataFrame, essential: DataFrame, measured: DataFrame, keys: list[str], ks: tuple[float, ...] = (0.01, 0.05, 100), least: tuple[int, int] = (5, 20)) -> DataFrame:
    """keys, k, line, hits, hits_rest, candidates, population, p: are the best-ranked unlabelled genes of a cell (keys: a fold of an arm) needed in a cell line more often than the others?

    scored: keys, gene, y, score; essential: (gene, line); measured: (gene). Candidates are the first k negatives by score, ties by gene (k under 1: that share of the cell's rows, rounded up), the rest of the negatives is the background;
    both count measured genes only, and cells with fewer than `least` candidates or background genes are left out. p is the chance of at least `hits` candidates among hits_rest genes drawn from the population; lines without a hit
    in the background are left out. All ks are columns of one join; p is worked out once for equal numbers.
    """
    cells = scored.groupBy(*keys).agg(F.count("*").alias("_rows"))
    negatives = scored.where("y = 0").select(*keys, "gene", "score")
    placed = by_group(negatives, keys, [F.desc("score"), "gene"]).join(cells, keys).join(measured.select("gene").distinct(), "gene", "left_semi")
    size = lambda k: F.least(F.ceil(F.lit(float(k)) * F.col("_rows")) if k < 1 else F.lit(int(k)).cast("long"), F.col("_size"))
    roles = placed.select(*keys, "gene", F.array(*[F.when(F.col("_size") - size(k) >= least[1], F.col("_place") <= size(k)) for k in ks]).alias("in"))
    roles = cut(roles, "roles")
    at = lambda i: F.get("in", F.lit(i))
    count = lambda d, by: d.groupBy(*by).agg(*[c for i in range(len(ks)) for c in (F.count_if(at(i)).alias(f"c{i}"), F.count_if(~at(i)).alias(f"b{i}"))])
    each = F.explode(F.array(*[F.struct(F.lit(float(k)).alias("k"), F.col(f"c{i}").alias("c"), F.col(f"b{i}").alias("b")) for i, k in enumerate(ks)])).alias("x")
    whole = count(roles, keys).select(*keys, each).select(*keys, "x.k", F.col("x.c").alias("candidates"), (F.col("x.c") + F.col("x.b")).alias("population"), F.col("x.b").alias("_b"))
    whole = whole.where((F.col("candidates") >= least[0]) & (F.col("_b") >= least[1])).drop("_b")
    lines = count(roles.join(essential.select("gene", "line").distinct(), "gene"), [*keys, "line"])
    hits = lines.select(*keys, "line", each).select(*keys, "line", "x.k", F.col("x.c").alias("hits"), F.col("x.b").alias("hits_rest")).where("hits_rest > 0")
    out = cut(hits.join(whole, [*keys, "k"]), "enrichment")
    by = ["hits", "population", "candidates", "hits_rest"]
    p = hypergeometric(out.select("hits", "population", F.col("candidates").alias("good"), F.col("hits_rest").alias("draws")).distinct()).withColumnsRenamed({"good": "candidates", "draws": "hits_rest"})
    return out.join(p, by).select(*keys, "k", "line", *["hits", "hits_rest", "candidates", "population"], "p")


def enrichment_summary(lines: DataFrame, keys: list[str], cells: list[str]) -> DataFrame:
    """keys, k, n_cells, n_lines, below_05, below_01 (shares of p), median_p, least_p, median_candidates of line_enrichment()'s rows; cells: the columns that tell an arm's folds apart."""
    sizes = lines.select(*keys, *cells, "k", "candidates").distinct().groupBy(*keys, "k").agg(F.count("*").alias("n_cells"), F.percentile("candidates", F.lit(0.5)).alias("median_candidates"))
    share = lambda x: F.avg((F.col("p") < x).cast("double"))
    p = lines.groupBy(*keys, "k").agg(F.count("*").alias("n_lines"), share(0.05).alias("below_05"), share(0.01).alias("below_01"), F.percentile("p", F.lit(0.5)).alias("median_p"), F.min("p").alias("least_p"))
    return sizes.join(p, [*keys, "k"]).select(*keys, "k", "n_cells", "n_lines", "below_05", "below_01", "median_p", "least_p", "median_candidates")
