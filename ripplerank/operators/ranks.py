"""Places and running sums inside groups, whatever the size of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Rows of a group up to which one task sorts it as a window; groups beyond it are cut into ranges.
GROUP_ROWS = 1_000_000

_BEFORE = (Window.unboundedPreceding, Window.currentRow)


def largest(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]


def by_group(df: DataFrame, keys: list[str], order: list, sums: dict[str, F.Column | str] | None = None, most: int | None = None) -> DataFrame:
    """df with _place (from 1, in the order of the order columns, which have to tell a group's rows apart), _size (rows of the group) and for each name of sums
    _before_name (its sum over the rows of the group before) and _all_name (over the whole group).

    Groups of up to GROUP_ROWS rows (`most`, or counted) are windows. Where one is larger, rows are laid out in ranges of (keys, order) and written: a group that spans ranges is ranked inside each of them, and the
    counts and sums of its earlier ranges, at most two rows a range in all, are added. No task sees more than its range.
    """
    sums = {k: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)) for k, c in (sums or {}).items()}
    if (largest(df, keys) if most is None else most) > GROUP_ROWS:
        return _in_ranges(laid_out(df.withColumns({f"_sum_{k}": c for k, c in sums.items()}), keys, order), keys, list(sums))
    group = Window.partitionBy(*keys)
    run = group.orderBy(*order).rowsBetween(*_BEFORE)
    out = {"_place": F.row_number().over(group.orderBy(*order)).cast("long"), "_size": F.count("*").over(group)}
    for k, c in sums.items():
        out |= {f"_before_{k}": F.sum(c).over(run) - c, f"_all_{k}": F.sum(c).over(group)}
    return df.withColumns(out)


def laid_out(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """df in sorted ranges of (keys, order), written: _part is a row's range, _at its place there."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_id", F.monotonically_increasing_id())
    laid = cut(ranged, "ranges")
    return laid.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def _in_ranges(laid: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    here = Window.partitionBy("_part", *keys)
    run = here.orderBy("_at").rowsBetween(*_BEFORE)
    parts = laid.groupBy("_part", *keys).agg(F.count("*").alias("_n"), *[F.sum(f"_sum_{k}").alias(f"_n_{k}") for k in sums])
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = ["_n", *[f"_n_{k}" for k in sums]]
    wide = parts.withColumn("_parts", F.count("*").over(group)).withColumns({f"{c}_off": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in names} | {f"{c}_all": F.sum(c).over(group) for c in names})
    # Only groups in more than one range need what stands before: each range ends or begins two of them at most.
    wide = wide.where("_parts > 1").select(F.col("_part").alias("_ranges_part"), *[F.col(c).alias(f"_ranges_key{i}") for i, c in enumerate(keys)], *[f"{c}_{x}" for c in names for x in ("off", "all")])
    out = laid.join(F.broadcast(wide), [F.col("_part") == F.col("_ranges_part"), *[F.col(c).eqNullSafe(F.col(f"_ranges_key{i}")) for i, c in enumerate(keys)]], "left")
    new = {"_place": F.row_number().over(here.orderBy("_at")) + F.coalesce("_n_off", F.lit(0)), "_size": F.coalesce("_n_all", F.count("*").over(here))}
    for k in sums:
        own = F.col(f"_sum_{k}")
        new |= {f"_before_{k}": F.sum(own).over(run) - own + F.coalesce(f"_n_{k}_off", F.lit(0)), f"_all_{k}": F.coalesce(f"_n_{k}_all", F.sum(own).over(here))}
    return out.withColumns(new).drop("_part", "_at", "_ranges_part", *[f"_ranges_key{i}" for i in range(len(keys))], *[f"{c}_{x}" for c in names for x in ("off", "all")], *[f"_sum_{k}" for k in sums])


def least_after(df: DataFrame, keys: list[str], order: list, value: str, name: str, most: int | None = None) -> DataFrame:
    """df with name: the least of a value over the row and all rows of its group behind it in the order."""
    if (largest(df, keys) if most is None else most) <= GROUP_ROWS:
        return df.withColumn(name, F.min(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    laid = laid_out(df, keys, order)
    here = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    group = Window.partitionBy(*keys)
    later = group.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    parts = laid.groupBy("_part", *keys).agg(F.min(value).alias("_m"))
    wide = parts.withColumn("_parts", F.count("*").over(group)).withColumn("_later", F.min("_m").over(later)).where("_parts > 1")
    wide = wide.select(F.col("_part").alias("_ranges_part"), *[F.col(c).alias(f"_ranges_key{i}") for i, c in enumerate(keys)], "_later")
    out = laid.join(F.broadcast(wide), [F.col("_part") == F.col("_ranges_part"), *[F.col(c).eqNullSafe(F.col(f"_ranges_key{i}")) for i, c in enumerate(keys)]], "left")
    return out.withColumn(name, F.least(F.min(value).over(here), "_later")).drop("_part", "_at", "_ranges_part", "_later", *[f"_ranges_key{i}" for i in range(len(keys))])


def mid_ranks(df: DataFrame, keys: list[str], column: str, name: str, most: int | None = None) -> DataFrame:
    """df with name: the mid-rank of a column in each group. Distinct values are ranked with their counts, and rows look theirs up; ties are one row in the ranking."""
    counts = df.groupBy(*keys, F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    placed = by_group(counts, keys, ["_value"], {"n": "_n"}, most)
    ranks = placed.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_value", (F.col("_before_n") + (F.col("_n") + 1) / 2.0).alias(name))
    on = [*[F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)], F.col(column).eqNullSafe(F.col("_value"))]
    return df.join(ranks, on).drop("_value", *[f"_k{i}" for i in range(len(keys))])
