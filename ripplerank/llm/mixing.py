"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import by_group
from .shared import drop_table, in_order, keyed, side, table

#: Bits of the hash that one histogram resolves, and how often a boundary bucket is refined: LEVELS * BITS bits in all.
BITS, LEVELS = 12, 5
#: Most times that a document may be taken.
REPEATS = 3


def words(text) -> F.Column:
    """How many words [^\\x20\\x09-\\x0D]+ a text has; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> with weight and target double: sources by code point, null last, weigh 1, 2, 3, 1, ...; all sizes are shared out by weight, a share stops at REPEATS times its source, and what it leaves is shared again.

    Sources stop in the order of size over weight, so running sums in that order tell at which of them the stopping ends: one pass, however many stop.
    """
    ranked = in_order(sizes.withColumn("_null", F.col("source").isNull().cast("int")), ["_null", "source"], name="sources")
    t = table(ranked.select("source", "source_size", (F.col("_index") % 3 + 1).cast("double").alias("weight")), "weights", "snappy")
    total = t.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()
    full = (F.col("source_size") * REPEATS).alias("full")
    steps = by_group(t.select("source", "weight", full, (full / F.col("weight")).alias("ratio")), [], ["ratio", "source"], {"full": "full", "weight": "weight"})
    rest, share = F.lit(total["s"]) - F.col("_before_full") - F.col("full"), F.lit(total["w"]) - F.col("_before_weight") - F.col("weight")
    level = steps.where((share > 0.5) & (F.col("ratio") * share <= rest)).agg(F.max(rest / share)).first()[0]
    level = max(level or 0.0, total["s"] / total["w"] if total["w"] else 0.0)
    return t.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.col("source_size").cast("double") * REPEATS))


def _hash(doc_id, text) -> F.Column:
    """60 bits of md5 of the id and the text: rows that share them are alike."""
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("|"), F.coalesce(F.md5(text), F.lit("-")))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("long")


def _small(df: DataFrame) -> DataFrame:
    """A row a source, behind a check of their bytes."""
    return side(df, 64, F.coalesce(F.octet_length("source"), F.lit(0)))


def thresholds(rows: DataFrame) -> DataFrame:
    """(source, source_size, target, k, under, some): of written rows (source, size, h) each source's documents are taken k times, and those whose hash h lies below `under` once more; of the rows alike whose hash is `under`
    itself also `some` (0, but where rows that share id and text stand at the end of the budget)."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # k whole rounds and the budget that is left for one more
    k = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(REPEATS))).otherwise(F.lit(0)).cast("int")
    aim = targets(sums).withColumn("k", k).withColumn("budget", F.when(F.col("k") < REPEATS, F.col("target") - F.col("k") * F.col("source_size")).otherwise(F.lit(0.0)))
    aim = table(aim.withColumn("prefix", F.lit(0).cast("long")), "aim", "snappy")
    here = lambda: _small(aim).select(F.col("source").alias("of"), "prefix")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows.join(here(), F.col("source").eqNullSafe(F.col("of"))).where(F.shiftright("h", shift + BITS) == F.col("prefix")) if level else rows
        hist = inside.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("w"))
        # At most 2**BITS buckets a source meet here, with their sums; the threshold's bucket is the first that would pass the budget.
        run = hist.groupBy(F.col("source").alias("of")).agg(F.array_sort(F.collect_list(F.struct("b", "w"))).alias("all"))
        step = F.aggregate(
            "all",
            F.struct(F.col("budget").alias("left"), F.lit(None).cast("long").alias("at")),
            lambda acc, x: F.when(acc["at"].isNotNull(), acc).when(x["w"] > acc["left"], F.struct(acc["left"].alias("left"), x["b"].alias("at"))).otherwise(F.struct((acc["left"] - x["w"]).alias("left"), acc["at"].alias("at"))),
        )
        found = aim.join(run, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("step", F.coalesce(step, F.struct(F.col("budget").alias("left"), F.lit(None).cast("long").alias("at"))))
        # Where no bucket passes the budget, all of them are under the threshold; where there were none, the threshold stands already.
        past = F.when(F.col("all").isNull(), F.col("prefix")).otherwise(F.col("prefix") + 1) * (1 << BITS)
        aim = table(found.select("source", "source_size", "target", "k", F.col("step.left").alias("budget"), F.coalesce("step.at", past).alias("prefix")), "aim", "snappy")
    last = rows.join(here(), F.col("source").eqNullSafe(F.col("of"))).where("h = prefix").groupBy("of").agg(F.sum("size").alias("w"), F.count("*").alias("c"))
    # The one hash value at the threshold: its rows, alike, as long as one more brings the words nearer to the target.
    out = aim.join(last, F.col("source").eqNullSafe(F.col("of")), "left")
    many = F.least(F.col("c"), F.greatest(F.ceil(F.try_divide(F.col("budget") * F.col("c"), F.col("w")) - 0.5), F.lit(0)))
    out = out.withColumn("many", F.when(F.col("k") < REPEATS, F.when(F.col("w") == 0, F.col("c")).otherwise(many)))
    all_in = F.col("many") >= F.col("c")
    under = F.when(F.col("k") < REPEATS, F.when(all_in, F.col("prefix") + 1).otherwise(F.col("prefix"))).otherwise(F.lit(0).cast("long"))
    some = F.when(all_in, F.lit(0)).otherwise(F.coalesce("many", F.lit(0))).cast("long")
    return table(out.select("source", "source_size", "target", "k", under.alias("under"), some.alias("some")), "aim", "snappy")


def _tied(rows: DataFrame, aim: DataFrame) -> DataFrame | None:
    """(id) of the rows at a threshold that are taken once more, of written rows (id, source, h); None where no source's budget ends inside rows that are alike."""
    ends = table(aim.where("some > 0").select(F.col("source").alias("of"), "under", "some"), "ends", "snappy")
    if ends.isEmpty():
        return None
    at = rows.join(_small(ends.withColumnRenamed("of", "source")).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")) & (F.col("h") == F.col("under")))
    placed = by_group(table(at.select("id", "source", "some"), "tied", "snappy"), ["source"], ["id"])
    return table(placed.where(F.col("_place") <= F.col("some")).select("id"), "tied", "snappy")


def _copies(rows: DataFrame, tied: DataFrame | None) -> DataFrame:
    """rows (id, h, k, under) with copies."""
    more = F.col("h") < F.col("under")
    if tied is not None:
        rows = rows.join(side(tied.withColumnRenamed("id", "_tied"), 16), F.col("id") == F.col("_tied"), "left")
        more = more | F.col("_tied").isNotNull()
    return rows.withColumn("copies", F.col("k") + more.cast("int"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies int, taken long for every row of docs.

    A source whose target is k times its size and something more takes every document k times and the documents under a hash threshold once more. The
    threshold comes from a histogram of sizes by source and leading hash bits; the bucket in which the budget ends is histogrammed again by the next bits,
    LEVELS times, so the last bucket holds one hash value; of its rows so many are taken as bring the sum nearest to the target. No rows are sorted but those.

    The hash is md5 of doc_id and text, so reruns agree. Null texts have size 0; a null source is a source, the last; rows that repeat a doc_id or have none are told apart by their texts, and rows alike
    in both are as good as each other: as many of them are taken as the target asks for, so that every source comes within one document of it. An empty table gives no rows; all-empty texts give
    targets 0 and nothing taken; other columns are ignored.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", F.col("source").cast("string").alias("source"), words(text).alias("size"), _hash(F.col("doc_id"), text).alias("h"))
    rows = table(rows, "mix", "snappy")
    found = thresholds(rows)
    aim = _small(found).withColumnRenamed("source", "of")
    out = _copies(rows.join(aim, F.col("source").eqNullSafe(F.col("of"))), _tied(rows, found))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: rows not taken go, rows taken twice or more come as often; columns as they came.

    What mix() decides of a row follows from its source's threshold and its own hash, so rows meet a table of sources only and are filtered where they are. Only where a budget ends inside rows that are alike, docs are written once with
    numbers, so that those of them that stay can be named.
    """
    source, text = F.col("source").cast("string"), F.col("text").cast("string")
    h = _hash(F.col("doc_id"), text)
    sizes = table(docs.select(source.alias("source"), words(text).alias("size"), h.alias("h")), "mix", "snappy")
    found = thresholds(sizes)
    drop_table(sizes)
    tied, given = None, docs.select(F.struct("*").alias("row"), F.lit(0).alias("id"), source.alias("src"), h.alias("h"))
    if not found.where("some > 0").isEmpty():
        rows = keyed(docs)
        own = _hash(F.col("row.doc_id"), F.col("row.text").cast("string"))
        given = rows.select("row", "id", F.col("row.source").cast("string").alias("src"), own.alias("h"))
        tied = _tied(given.select("id", F.col("src").alias("source"), "h"), found)
    out = _copies(given.join(_small(found).withColumnRenamed("source", "of"), F.col("src").eqNullSafe(F.col("of"))), tied)
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
