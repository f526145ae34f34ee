"""Line dedup by a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_cell, cell_pairs, keyed, partitions, side, split_hot, table, whole_cells

#: Largest edit distance of two lines that count as one, and characters of a line below which only equal lines do.
EDITS, SHORTEST = 2, 32
#: Characters of which a blank line consists.
BLANK = " \t\x0b\f\r"
#: Lines that share a substring and emit their pairs; more are compared in blocks, with their texts at hand.
FEW, BLOCK = 32, 512


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """Start and length of the edits + 1 even segments of a line."""
    at = [i * length // (edits + 1) for i in range(edits + 2)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def signatures(line: str, edits: int = EDITS) -> list[tuple[int, bool]]:
    """(key, probe): the keys of a line's segments, by place and line length, and of the substrings that a shorter line's segments can match.

    Of edits + 1 segments at least one is unharmed by `edits` edits. Where it can stand in the longer line is bounded from the left by the edits before it and from
    the right by the edits after it and the difference of lengths. Lines of one length meet by their own segments and by the shifted probes.
    """
    import xxhash

    hashed, n, out = xxhash.xxh64_intdigest, len(line), []
    for less in range(edits + 1):
        for i, (start, size) in enumerate(segments(n - less, edits)):
            tag = (n - less) * 16 + i
            low = max(start - i, start + less - (edits - i), 0)
            high = min(start + i, start + less + (edits - i), n - size)
            for at in range(low, high + 1):
                own = not less and at == start
                out.append((hashed(line[at : at + size].encode("utf-8", "surrogatepass"), tag), not own))
    return out


def within(a: str, b: str, most: int = EDITS) -> bool:
    """Whether the edit distance of a and b is at most `most`: bit-parallel over a band of diagonals, after common ends are cut."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    k = 0
    while k < len(b) and a[k] == b[k]:
        k += 1
    e = 0
    while e < len(b) - k and a[-1 - e] == b[-1 - e]:
        e += 1
    a, b = a[k : len(a) - e], b[k : len(b) - e]
    if len(b) <= most:  # the band is wider than what is left of b
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            over, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                over, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, over + (x != y))
        return row[-1] <= most
    # Column by column over a; a word holds the vertical differences of the rows from j - most to j + most of b, its top bit the lowest row of the band.
    width = 2 * most + 2
    mask, top = (1 << width) - 1, 1 << (width - 1)
    at: dict[str, int] = {}
    shift = width - 1 - most  # row r of b is bit r + shift of a character's mask; column j sees it from bit j on
    for r, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << (r + shift)
    plus, minus, score = mask & ~((1 << (width - 1 - most)) - 1), 0, most
    last = len(b) - most  # from this column on the band's lowest row is b's last one
    line = top
    for j, c in enumerate(a):
        m = (at.get(c, 0) >> j) & mask
        zero = ((((m & plus) + plus) ^ plus) | m | minus) & mask
        up, down = (minus | ~(zero | plus)) & mask, zero & plus
        if j < last:
            score += not zero & top
        else:
            line >>= 1
            score += bool(up & line) - bool(down & line)
        if score > 3 * most:  # no later column can win back more
            return False
        plus, minus = (down | ~((zero >> 1) | up)) & mask, (zero >> 1) & up
    return score <= most


def _keys(docs: DataFrame, edits: int, shortest: int) -> DataFrame:
    """(key, line, probe) of every line that its task has not met before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[int] = set()
        for b in batches:
            keys, ids, probes = [], [], []
            for text in b.column(0):
                for line in (text.as_py() or "").split("\n"):
                    if len(line) >= shortest and line.strip(BLANK):
                        h = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)
                        if h not in seen:
                            seen.add(h)
                            for key, probe in signatures(line, edits):
                                keys.append(key)
                                probes.append(probe)
                                ids.append(h)
            if keys:
                cols = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (keys, ids)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(probes)], names=["key", "line", "probe"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "key long, line long, probe boolean")


def _met(rows: DataFrame) -> DataFrame:
    """(a, b, held): pairs of lines (held null) of keys with up to FEW rows; of other keys the rows themselves (a: line, b: key, held: probe)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, rest, flood = None, None, False
        for b in batches:
            if not len(b):
                continue
            if rest is not None:
                b = pd.concat([rest, b], ignore_index=True)
            key = b["key"].to_numpy()
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(b)])
            big = sizes > FEW
            if flood and key[0] == open_key:
                big[0] = True
            # The last key may go on in the next batch: held back while small, let go row by row once it is known to be large.
            tail = int(starts[-1])
            flood, open_key = bool(big[-1]), key[-1]
            rest = None if flood else b.iloc[tail:]
            of = np.repeat(big, sizes)
            if not flood:
                of[tail:] = False
            if of.any():
                h = b[of]
                yield pd.DataFrame({"a": h["line"], "b": h["key"], "held": h["probe"].astype(object)})
            small = b.iloc[: len(b) if flood else tail]
            small = small[~of[: len(small)]]
            if len(small):
                yield from _pairs(small)
        if rest is not None:
            yield from _pairs(rest)

    def _pairs(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        key = frame["key"].to_numpy()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(frame)]
        frame = frame.assign(_i=0, _j=0, _home=0)
        line, probe = frame["line"].to_numpy(), frame["probe"].to_numpy()
        for a, b in cell_pairs(frame, np.repeat(ends, ends - starts), 500_000):
            ok = (line[a] != line[b]) & ~(probe[a] & probe[b])
            if ok.any():
                x, y = line[a[ok]], line[b[ok]]
                pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
                yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "held": pd.Series([None] * len(pairs), dtype=object)})

    return rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key").mapInPandas(run, "a long, b long, held boolean")


def line_marks(rows: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, exact: int | None = None) -> DataFrame:
    """(id, away array<int>) of written rows (id, doc_id, text): the numbers (from 0) of the lines of a row that repeat an earlier one, for the rows that have such lines.

    Lines count in the order of (doc_id, hash of the text, id, line number), null doc_ids first. A line of `exact` characters or more (unset: `shortest`) goes if an equal one
    stands earlier; one of `shortest` or more also if its first equal stands after the first equal of such a line within `edits` edits. Blank lines, of any length, stay and match nothing.
    """
    least = shortest if exact is None else min(exact, shortest)
    place = ["doc", "th", "id", "no"]
    given = rows.select("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.col("text").cast("string").alias("whole"))
    lines = given.select("id", "doc", F.xxhash64("whole").alias("th"), F.posexplode(F.split("whole", "\n")).alias("no", "text")).where((F.char_length("text") >= least) & F.col("text").rlike(r"\S"))
    lines = lines.withColumn("h", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(2), "text"))
    every = table(lines.select(*place, "h", "h2"), "lines", "snappy")
    firsts = table(every.groupBy("h", "h2").agg(F.min(F.struct(*place)).alias("f"), F.count("*").alias("n")), "firsts", "snappy")
    met = table(_met(_keys(rows, edits, shortest)), "met", "snappy")
    pairs = table(met.where("held is null").select("a", "b").distinct(), "pairs", "snappy")
    held = met.where("held is not null").select(F.col("b").alias("key"), F.col("a").alias("line"), F.col("held").alias("probe")).groupBy("key", "line").agg(F.min("probe").alias("probe"))
    held = table(held, "held", "snappy")
    ids = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).unionByName(held.select(F.col("line").alias("h"))).distinct()
    need = table(firsts.join(ids, "h", "left_semi").select("f.id", "f.no"), "need", "snappy")
    # A line's text is read where it stands first: one row each, however often it is repeated.
    texts = table(lines.join(side(need, 16), ["id", "no"]).select(*place, "h", "h2", "text"), "texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            ok = [i for i, (s, t) in enumerate(zip(x, y, strict=True)) if within(s, t, edits)]
            yield b.select(["h", "h2"]).take(pa.array(ok, pa.int64()))

    later = F.struct(*[f"x.{c}" for c in place]) > F.struct(*[f"y.{c}" for c in place])
    two = pairs.join(texts.alias("x"), F.col("a") == F.col("x.h")).join(texts.alias("y"), F.col("b") == F.col("y.h"))
    two = two.select(*(F.when(later, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(c) for c in ("h", "h2")), F.col("x.text").alias("s"), F.col("y.text").alias("t"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, ends in whole_cells(batches, "key"):
            text, probe = frame["text"].tolist(), frame["probe"].to_numpy()
            h, h2 = frame["h"].to_numpy(), frame["h2"].to_numpy()
            rank = np.empty(len(frame), np.int64)
            rank[np.lexsort([frame[c].to_numpy() for c in reversed(place)])] = np.arange(len(frame))
            gone = np.zeros(len(frame), bool)
            for a, b in cell_pairs(frame, ends, 200_000):
                after = rank[a] > rank[b]
                late, early = np.where(after, a, b), np.where(after, b, a)
                ok = ~(probe[a] & probe[b]) & ~gone[late] & ((h[a] != h[b]) | (h2[a] != h2[b]))
                for x, y in zip(late[ok].tolist(), early[ok].tolist(), strict=True):
                    if not gone[x] and within(text[x], text[y], edits):  # one earlier line is enough
                        gone[x] = True
            if gone.any():
                yield pd.DataFrame({"h": h[gone], "h2": h2[gone]})

    crowd = split_hot(held.join(texts, F.col("line") == F.col("h")).select("key", "probe", "h", "h2", *place, "text"), "key", "h", BLOCK)
    near = two.mapInArrow(verify, "h long, h2 long").unionByName(by_cell(crowd, "key").mapInPandas(compare, "h long, h2 long")).distinct()
    marks = firsts.join(near.withColumn("near", F.lit(True)), ["h", "h2"], "left").where("n > 1 or near")
    marks = table(marks.select("h", "h2", F.col("f.id").alias("first_id"), F.col("f.no").alias("first_no"), F.coalesce("near", F.lit(False)).alias("near")), "marks", "snappy")
    marked = every.select("id", "no", "h", "h2").join(side(marks, 40), ["h", "h2"])
    away = marked.where("near or id <> first_id or no <> first_no").groupBy("id").agg(F.array_sort(F.collect_list("no")).alias("away"))
    return table(away, "away", "snappy")


def _with(rows: DataFrame, away: DataFrame) -> DataFrame:
    """rows with `away`, null where a row keeps all its lines."""
    return rows.join(side(away, 32, 4 * F.size("away")), "id", "left")


def repeated_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, exact: int | None = None) -> DataFrame:
    """(doc_id, away array<int>) for every row of docs: the numbers of its lines that repeat earlier ones (line_marks), an empty list where there are none.

    Each row counts by itself: rows that repeat a doc_id are documents of their own, of repeated rows one keeps its lines, and rows of a null doc_id take part, before all others.
    Null texts have no lines; an empty table gives no rows; other columns are ignored.
    """
    rows = table(docs.select(F.monotonically_increasing_id().alias("id"), F.col("doc_id").cast("long"), F.col("text").cast("string")), "rows")
    return _with(rows.select("id", "doc_id"), line_marks(rows, edits, shortest, exact)).select("doc_id", F.coalesce("away", F.array().cast("array<int>")).alias("away"))


def without_repeated_lines(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, exact: int | None = None) -> DataFrame:
    """docs, columns as they came, with the repeated lines cut from text; n_chars, where there is one, counts what is left.

    Every row stays, each by itself as in repeated_lines(); a text whose lines all repeat earlier ones becomes empty, a null text stays null, and a row without repeated lines is unchanged.
    """
    rows, kinds = keyed(docs), dict(docs.dtypes)
    away = line_marks(rows.select("id", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")), edits, shortest, exact)
    left = F.array_join(F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("away", i)), "\n")
    new = {"text": F.when(F.col("away").isNull(), F.col("row.text")).otherwise(left)}
    if "n_chars" in kinds:
        new["n_chars"] = F.when(F.col("away").isNull(), F.col("row.n_chars")).otherwise(F.char_length(left)).cast(kinds["n_chars"])
    return _with(rows, away).select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
