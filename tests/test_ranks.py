"""Keyed places and sums by ranges against windows, and what one task gets to see of a hot group."""

import random

import pytest
from pyspark.sql import functions as F

from ripplerank.operators import labels, metrics, ranks, resample, stability, stats
from ripplerank.sources import shared


def table(spark, n=3000):
    """Groups of one row, of a few, and one of most rows; scores tie."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.9 else rng.choice([None, "a", "b", f"k{i}"]), i, round(rng.random(), 2), int(rng.random() < 0.2), rng.randint(0, 9)) for i in range(n)]
    return spark.createDataFrame(rows, "key string, gene int, score double, y int, w int").repartition(7)


def rows(df):
    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(repr([cell(v) for v in r]) for r in df.select(*sorted(df.columns)).collect())


def big(monkeypatch, f):
    """f() with windows, then by ranges."""
    one = rows(f())
    with monkeypatch.context() as m:
        m.setattr(ranks, "GROUP_ROWS", 50)
        assert rows(f()) == one
    return one


def test_by_group_and_least_after(spark, monkeypatch):
    df = table(spark)
    for keys in (["key"], [], ["key", "y"]):
        got = big(monkeypatch, lambda k=keys: ranks.by_group(df, k, [F.desc("score"), "gene"], {"w": "w", "y": F.col("y") * 2}))
        assert len(got) == 3000
        big(monkeypatch, lambda k=keys: ranks.least_after(df, k, ["gene"], "score", "least"))
        big(monkeypatch, lambda k=keys: ranks.mid_ranks(df, k, "score", "mid"))
    assert ranks.by_group(df.limit(0), ["key"], ["gene"]).count() == 0


def test_no_task_sees_more_than_its_share(spark):
    df = table(spark, 20_000)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = [r["count"] for r in ranks.laid_out(df, ["key"], ["score", "gene"]).groupBy("_part").count().collect()]
    assert len(parts) == n and max(parts) < 1.5 * 20_000 / n
    hot = ranks.laid_out(df, ["key"], ["score", "gene"]).where("key = 'hot'").groupBy("_part").count().collect()
    assert len(hot) >= n - 1  # the group of nine tenths of the rows lies in all ranges but one at most


@pytest.mark.parametrize("f", [metrics.auroc, metrics.auprc, metrics.ranked, metrics.roc_points, metrics.partial_auc, metrics.median_rank, lambda d, k: metrics.precision_at(d, k, (5, 50)), lambda d, k: metrics.auroc(d, k, "w"), lambda d, k: metrics.all_metrics(d, k, (5,)), lambda d, k: metrics.precision_top(d, k)])
def test_metrics(spark, monkeypatch, f):
    df = table(spark).where("key is not null")
    big(monkeypatch, lambda: f(df, ["key"]))


@pytest.mark.parametrize("f", [stability.percentile_ranks, lambda d, k: stability.strata(d, k, "score"), lambda d, k: stability.deciles(d, k, "score"), lambda d, k: stability.crowding(d, k, 0.05), lambda d, k: stability.moving_median(d, k, 3), stability.rank_band, lambda d, k: stability.nearest(d, k, 2), lambda d, k: stability.random_neighbours(d, k, 2, 2), lambda d, k: resample.subsample(d, k, 0.3)])
def test_stability(spark, monkeypatch, f):
    df = table(spark, 900).where("key is not null")
    big(monkeypatch, lambda: f(df, ["key"]))


def test_splits_statistics_and_caps(spark, monkeypatch):
    df = table(spark, 900).where("key is not null")
    u = df.select(F.concat(F.lit("G"), F.col("gene")).alias("gene"))
    big(monkeypatch, lambda: labels.stratified_splits(u, u.limit(0).unionByName(u.where("gene like '%7'")), 3, 5))
    big(monkeypatch, lambda: stats.bh(df.select("key", "gene", F.col("score").alias("p")), ["key"]))
    big(monkeypatch, lambda: stats.spearman(df, ["key"], "score", "w"))
    sets = df.select(F.col("key").alias("label_set"), "gene", F.col("w").alias("rank"))
    big(monkeypatch, lambda: labels.cap_all(sets, df))
    big(monkeypatch, lambda: labels.transfer_pools(u.where("gene like '%1'"), u.where("gene like '%2'"), u, 400))
    pools = labels.transfer_pools(u.where("gene like '%1'"), u.where("gene like '%2'"), u, 42)
    assert [r["n"] for r in pools.groupBy("role", "fold").agg(F.count("*").alias("n")).orderBy("role", "fold").collect()] == [8] * 5 + [pools.where("role = 'target' and fold = 0").count()] * 5
    big(monkeypatch, lambda: resample.matched_background(df.where("y = 1"), df.where("y = 0"), "score", 3))


def test_places_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(ranks, "GROUP_ROWS", 50)
    df = table(spark)
    assert len({tuple(rows(ranks.by_group(df.repartition(n), ["key"], ["score", "gene"], {"w": "w"}))) for n in (1, 3, 8)}) == 1
    assert shared.shared_dir(spark)
