"""What lies on disk while a query runs: neither the shuffle files of written tables nor the rounds that a loop has left behind."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from ripplerank.operators import graph, metrics, ranks
from ripplerank.sources.shared import Steps, cut, shared_dir


def shuffle_files(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in glob.glob(f"{d.getPath()}/**/shuffle_*.data", recursive=True)}


def tables(spark, name):
    """Written tables of a name, in folders of their own or inside one."""
    return {os.path.dirname(f) for f in glob.glob(f"{shared_dir(spark)}/ripplerank-{name}-*/**/_SUCCESS", recursive=True)}


@pytest.fixture(scope="module")
def net(spark):
    return spark.createDataFrame([(i, j, 1.0) for i in range(9) for j in range(i + 1, 9) if (i + j) % 3 or j == i + 1], "gene_a long, gene_b long, weight double").localCheckpoint()


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    out = cut(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.collect_list("id").alias("ids")))
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert out.select(F.sum(F.size("ids"))).first()[0] == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_steps_keep_the_last_tables(spark):
    before, steps = tables(spark, "some"), Steps(spark, "some", keep=2)
    kept = [steps.put(spark.range(i)) for i in range(4)]
    assert [t.count() for t in kept[2:]] == [2, 3]
    assert len(tables(spark, "some") - before) == 2
    steps.drop()
    assert tables(spark, "some") == before


def test_propagation_keeps_no_rounds(spark, net):
    seeds = spark.createDataFrame([("a", 0), ("b", 4)], "col string, gene long")
    only = spark.createDataFrame([("a", 1), ("b", 4), ("b", 77)], "col string, gene long")
    before = tables(spark, "series")
    got = {(r["col"], r["alpha"], r["gene"]): r["score"] for r in graph.rwr_series(net, seeds, (0.4, 0.7), 1e-3, 50, "packed", None, only).collect()}
    want = {(r["col"], r["alpha"], r["gene"]): r["score"] for r in graph.rwr_series(net, seeds, (0.4, 0.7), 1e-3, 50, "blocks", None, only).collect()}
    assert got.keys() == want.keys() and len(got) == 6
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert tables(spark, "series") == before


def test_metrics_shuffle_rows_once(spark, monkeypatch):
    rows = [(g % 3, ("", "0.5")[g % 2], g, float(g * 7 % 11), int(g % 4 == 0)) for g in range(60)] + [(7, "", g, 1.0, 0) for g in range(4)]
    df = cut(spark.createDataFrame(rows, "fold int, _a string, gene long, score double, y int"))
    once = metrics.all_metrics(df, ["fold", "_a"], (3, 8))
    assert once._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r["fold"], r["_a"]): r for r in once.collect()}
    monkeypatch.setattr(ranks, "GROUP_ROWS", 3)
    want = {(r["fold"], r["_a"]): r for r in metrics.all_metrics(df, ["fold", "_a"], (3, 8)).collect()}
    assert got == want and len(got) == 7
    assert got[7, ""]["auroc"] is None and got[7, ""]["p_at_8"] is None


@pytest.mark.parametrize("name, run", [("power", lambda e: graph.power_iteration(e, "eigenvector", 4, strategy="packed")), ("cores", lambda e: graph.core_numbers(e)), ("paths", lambda e: graph.betweenness(e, 3, strategy="packed"))])
def test_loops_over_blocks_keep_one_round(spark, net, monkeypatch, name, run):
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 1)
    before = tables(spark, name)
    assert run(net).count() == 9
    assert len(tables(spark, name) - before) == 1
