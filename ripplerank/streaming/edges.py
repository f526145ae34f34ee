"""Structured Streaming over events: beyond the batch operators, incremental forms of edge building, degree counts and re-ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import states

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of Parquet files of events, some at a time."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def counts(events: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """start, event_type, n, users: events in tumbling or sliding windows; later than the watermark they are left out."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("start"), "event_type", "n", "users")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """user_id, start, end, n: runs of a user's events without a longer gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def edges(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(gene_a, gene_b, ts): each user and event type that met, once within the watermark."""
    pair = events.select("ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("gene_a"), F.concat(F.lit("v"), F.col("event_type")).alias("gene_b"))
    return pair.where("gene_a is not null and gene_b is not null").withWatermark("ts", late).dropDuplicatesWithinWatermark(["gene_a", "gene_b"])


def keep_ranking(pairs: DataFrame, checkpoint: str, done: Callable[[DataFrame, int], None], state: str | None = None):
    """Runs `done(degrees, batch)` after each micro-batch with the degrees (gene, count) of all edges so far, most first.

    Two states make the stream go on after a restart as if there had been none. The edges met, each once, are a keyed state of the query in its checkpoint. The degrees are a written table under
    `state` (a folder beside the checkpoint, if not named): batch n adds its new edges' counts to the table of batch n - 1, so a batch costs its own rows and one row a gene, and a batch that is run again after a failure
    writes the same table again.
    """
    home = (state or f"{checkpoint.rstrip('/')}-degrees").rstrip("/")
    fresh = pairs.dropDuplicates(["gene_a", "gene_b"])
    ends = fresh.select(F.explode(F.array(F.col("gene_a").cast("string"), F.col("gene_b").cast("string"))).alias("gene"))

    def rank(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("gene").agg(F.count("*").alias("n_edges"))
        before = f"{home}/upto={number - 1}"
        if number:
            if not _exists(spark, before):
                raise ValueError(f"no degrees of batch {number - 1} under {home}: the state belongs to another checkpoint")
            new = states.merge(new.unionByName(spark.read.schema(new.schema).parquet(before)), ["gene"])
        new.write.mode("overwrite").parquet(f"{home}/upto={number}")
        _drop(spark, f"{home}/upto={number - 2}")  # the one before stays, for a batch that is run again
        done(spark.read.schema(new.schema).parquet(f"{home}/upto={number}").select("gene", F.col("n_edges").alias("count")).orderBy(F.desc("count"), "gene"), number)

    return ends.writeStream.foreachBatch(rank).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.exists(where)


def _drop(spark: SparkSession, path: str) -> None:
    fs, where = _path(spark, path)
    fs.delete(where, True)
