"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a folder of our own, on a local master only: elsewhere the executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not own.isDefined():
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ripplerank-"))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get()
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/ripplerank-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@contextlib.contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written in here go as soon as it is written; otherwise they would lie on the executors' disks until the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _put(df: DataFrame, path: str) -> DataFrame:
    with swept(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read back; the files go when the application ends."""
    return _put(df, fresh(df.sparkSession, name))


class Steps:
    """Written tables of a loop: a table goes once `keep` later ones are written, so nothing may read it any more by then."""

    def __init__(self, spark: SparkSession, name: str, keep: int = 1):
        self.spark, self.name, self.keep, self.paths = spark, name, keep, []

    def put(self, df: DataFrame) -> DataFrame:
        path = fresh(self.spark, self.name)
        out = _put(df, path)
        self.paths.append(path)
        self.drop(self.keep)
        return out

    def drop(self, keep: int = 0) -> None:
        """All tables but the last `keep` go."""
        while len(self.paths) > keep:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(0))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, order: list, weight: str | None = None, name: str = "_number") -> DataFrame:
    """df with its place in a global order (from 0) and, with a weight, `_before`: the sum of the weight over all rows before it. The order has to tell rows apart.

    Range partitions are sorted and written once; their counts and sums, a row a partition, give each one's start: no task sees more than its range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    w = F.coalesce(F.col(weight).cast("long"), F.lit(0)) if weight else F.lit(0).cast("long")
    starts, at, sums = [], 0, 0
    for r in laid.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.sum(w).alias("w")).orderBy("p").collect():  # a row a partition
        starts.append((r["p"], at, sums))
        at, sums = at + r["n"], sums + r["w"]
    first = spark.createDataFrame(starts, "_part long, _first long, _base long")
    out = laid.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + row)
    if weight:
        out = out.withColumn("_before", F.col("_base") + F.sum(w).over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - w)
    return out.drop("_id", "_part", "_first", "_base")


def mid_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the mid-rank of a column over all rows: distinct values are numbered with their counts, not the rows."""
    counts = df.groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    ranks = numbered(counts, ["_value"], "_n").select("_value", (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(name))
    return df.join(ranks, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")
