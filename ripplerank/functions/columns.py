"""Column functions: portable random numbers, multi-valued cells, ordered sums."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F


def uniform(key, salt: str | F.Column) -> F.Column:
    """A number in [0, 1) from md5 of `key|salt`: the same in any engine and any run."""
    s = salt if isinstance(salt, F.Column) else F.lit(salt)
    text = F.concat(key.cast("string"), F.lit("|"), s)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def log_c(x) -> F.Column:
    """The natural logarithm as the C library rounds it, which the JVM's differs from in the last bit now and then; null for null, NaN and what is not over 0."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series([math.log(a) if a > 0 else None for a in v.tolist()], dtype="float64")

    return run(x.cast("double"))


def split_multi(cell, sep: str = "|") -> F.Column:
    """The values of a quoted, separated cell, trimmed, without empty ones; null: an empty list."""
    parts = F.transform(F.split(F.regexp_replace(F.trim(cell), '^"|"$', ""), "\\" + sep), lambda x: F.trim(x))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def harmonic_sum(scores) -> F.Column:
    """Sum of the scores in falling order over the squares of their places, over pi squared / 6; a single score stands as it is."""
    ordered = F.transform(F.reverse(F.array_sort(scores)), lambda s, i: s / ((i + 1) * (i + 1)))
    total = F.aggregate(ordered, F.lit(0.0), lambda a, s: a + s)
    return F.when(F.size(scores) == 1, scores[0]).otherwise(total / F.lit(math.pi**2 / 6))


def weighted_median(pairs) -> F.Column:
    """The first value, in order, at which half the weight is reached: of an array of (value, weight) structs."""
    whole = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["weight"])
    step = F.aggregate(
        F.array_sort(pairs),
        F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at")),
        lambda a, p: F.struct((a["sum"] + p["weight"]).alias("sum"), F.when(a["at"].isNull() & (a["sum"] + p["weight"] >= whole / 2), p["value"]).otherwise(a["at"]).alias("at")),
    )
    return step["at"]


def dot(a, b) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> F.Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
