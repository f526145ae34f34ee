"""Mergeable partial states: counts, sums and squares, distinct-value sketches and the Gram sums of a regression.

A state table has key columns and columns of sums; states of any rows merge by adding (sketches by union), so chunks are aggregated once, as they arrive, and every question is asked of the states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a state by the prefix of their name: how two states become one.
ADDED, JOINED = ("n_", "s_", "q_", "g_"), ("d_",)


def moments(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and for each value v: n_v (not null), s_v (sum), q_v (sum of squares)."""
    v = lambda c: F.col(c).cast("double")
    cols = [x for c in values for x in (F.count(c).alias(f"n_{c}"), F.coalesce(F.sum(v(c)), F.lit(0.0)).alias(f"s_{c}"), F.coalesce(F.sum(v(c) * v(c)), F.lit(0.0)).alias(f"q_{c}"))]
    return df.groupBy(*keys).agg(*cols)


def sketches(df: DataFrame, keys: list[str], columns: list[str], bits: int = 14) -> DataFrame:
    """keys and for each column c: d_c, a HyperLogLog sketch of its distinct values; 2 ** bits registers bound its size and an error of some 1.04 / sqrt(2 ** bits)."""
    return df.groupBy(*keys).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(bits)).alias(f"d_{c}") for c in columns])


def gram(df: DataFrame, y: str, xs: list[str], keys: list[str]) -> DataFrame:
    """keys, n_rows and for every two of (1, xs, y): g_i_j, the sum of their product; rows with a null in one of them are left out."""
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in (*xs, y)]]
    good = df.where(" and ".join(f"`{c}` is not null" for c in (*xs, y)))
    cols = [F.sum(z[i] * z[j]).alias(f"g_{i}_{j}") for i in range(len(z)) for j in range(i, len(z))]
    return good.groupBy(*keys).agg(F.count("*").alias("n_rows"), *cols)


def merge(states: DataFrame, keys: list[str]) -> DataFrame:
    """One state for each value of keys: the sum of the states that share it. With no keys, of all; a subset of groups is a filter before."""
    cols = [F.sum(c).alias(c) for c in states.columns if c.startswith(ADDED)] + [F.hll_union_agg(c).alias(c) for c in states.columns if c.startswith(JOINED)]
    return states.groupBy(*keys).agg(*cols)


def append(states: DataFrame, path: str, chunk: str) -> None:
    """Writes the states of one chunk under path; the chunk of that name is replaced, so that a repeated write counts once, and no other is read."""
    states.write.mode("overwrite").parquet(f"{path.rstrip('/')}/chunk={chunk}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The states of all chunks, with `chunk`."""
    return spark.read.parquet(path).withColumn("chunk", F.col("chunk").cast("string"))


def describe(states: DataFrame, values: list[str]) -> DataFrame:
    """The states with mean_v and sd_v (sample; null below two values) of each value."""
    out = states
    for c in values:
        n, s, q = F.col(f"n_{c}"), F.col(f"s_{c}"), F.col(f"q_{c}")
        spread = F.greatest(F.try_divide(q - F.try_divide(s * s, n), n - 1), F.lit(0.0))
        out = out.withColumn(f"mean_{c}", F.try_divide(s, n)).withColumn(f"sd_{c}", F.when(n > 1, F.sqrt(spread)))
    return out


def estimates(states: DataFrame, columns: list[str]) -> DataFrame:
    """The states with distinct_c for each sketched column."""
    return states.withColumns({f"distinct_{c}": F.hll_sketch_estimate(f"d_{c}") for c in columns})


def without(states: DataFrame, keys: list[str], group: str) -> DataFrame:
    """keys, group and the state of everything else under the same keys: the total less the own, for leaving out one group at a time without another pass."""
    sums = [c for c in states.columns if c.startswith(ADDED)]
    own = merge(states.select(*keys, group, *sums), [*keys, group])
    total = merge(own, keys).withColumnsRenamed({c: f"_{c}" for c in sums})
    both = own.join(total, keys) if keys else own.crossJoin(F.broadcast(total))  # one row
    return both.select(*keys, group, *[(F.col(f"_{c}") - F.col(c)).alias(c) for c in sums])
