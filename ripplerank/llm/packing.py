"""Best-fit packing by bin completion."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_order, table
from .tokens import default_path, encoder

#: Tokens of a sequence, steps of the search (sizes tried for a filling, and fillings used).
CAPACITY, STEPS = 2048, 300_000


def pieces(docs: DataFrame, path: str | None = None, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids with `end` appended, cut into pieces of `capacity` ids where longer."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, last = encoder(path), np.array([end], "<u4").tobytes()
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = e.encode(text.as_py()) + last
                out += [(doc, k, at // 4, len(p) // 4, zlib.crc32(p)) for k, at in enumerate(range(0, len(ids), 4 * capacity)) for p in (ids[at : at + 4 * capacity],)]
            cols = zip(*out, strict=True) if out else ([],) * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Left:
    """How many pieces of each length are left, and the lengths that are, in order."""

    def __init__(self, counts: dict[int, int]):
        self.count, self.sizes = dict(counts), sorted(counts)

    def take(self, items: tuple[int, ...], times: int) -> None:
        for x in items:
            self.count[x] -= times
            if not self.count[x]:
                self.sizes.pop(bisect.bisect_left(self.sizes, x))

    def give(self, items: tuple[int, ...], times: int) -> None:
        for x in items:
            if not self.count[x]:
                bisect.insort(self.sizes, x)
            self.count[x] += times

    def times(self, items: tuple[int, ...]) -> int:
        return min(self.count[x] // items.count(x) for x in set(items))


def best_fit(left: _Left, capacity: int) -> tuple[int, ...]:
    """The largest piece and, again and again, the largest that still fits."""
    items, room, used = [left.sizes[-1]], capacity - left.sizes[-1], {left.sizes[-1]: 1}
    at = len(left.sizes)
    while room:
        at = min(at, bisect.bisect_right(left.sizes, room))
        while at and used.get(left.sizes[at - 1], 0) >= left.count[left.sizes[at - 1]]:
            at -= 1
        if not at:
            break
        x = left.sizes[at - 1]
        items.append(x)
        used[x] = used.get(x, 0) + 1
        room -= x
    return tuple(items)


def dominated(filling: tuple[int, ...], left: _Left, capacity: int) -> bool:
    """Whether some piece outside a filling could stand in it in place of pieces of the same or a smaller sum (none: beside them) and still fit: what those pieces can do elsewhere the one piece cannot, so the filling
    with the larger piece is at least as good. The first piece of a filling, the largest that is left, is never replaced. One of equal size is no gain."""
    waste, one, two = capacity - sum(filling), 1, 0  # bits: sums of pieces, and sums of two or more of them
    for x in filling[1:]:
        two |= (one & ~1) << x | two << x
        one |= one << x
    for x in left.sizes:
        if left.count[x] > filling.count(x) and (one >> max(x - waste, 0) & ((1 << min(waste, x)) - 1) or two >> x & 1):
            return True
    return False


def completions(left: _Left, capacity: int, budget: list[int]) -> Iterator[tuple[int, ...]]:
    """The undominated fillings around the largest piece: best fit's own first, then by growing waste. Each size tried takes a step off the budget, and none are left when it is spent."""
    plain, sizes, count = best_fit(left, capacity), list(left.sizes), dict(left.count)
    big = sizes[-1]
    room = capacity - big
    count[big] -= 1
    yield plain

    def exactly(total: int, upto: int) -> Iterator[tuple[int, ...]]:
        """Sets of pieces of sizes[:upto], largest first, that sum to total."""
        if not total:
            yield ()
            return
        for i in range(min(upto, bisect.bisect_right(sizes, total)) - 1, -1, -1):
            budget[0] -= 1
            if budget[0] <= 0:
                return
            x = sizes[i]
            if count[x]:
                count[x] -= 1
                for rest in exactly(total - x, i + 1):
                    yield (x, *rest)
                count[x] += 1

    for waste in range(room + 1):
        for rest in exactly(room - waste, len(sizes)):
            filling = (big, *rest)
            if filling != plain and not dominated(filling, left, capacity):
                yield filling
        if budget[0] <= 0:
            return


def plan(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used, for all pieces of the given lengths, in as few sequences as the search finds.

    Bin completion on the histogram of lengths: a node fills around the largest piece that is left; its children are the undominated fillings in order of
    waste, each used as often as the counts allow, then once. A node is pruned when the waste so far leaves no room for fewer sequences than the incumbent. A
    best-fit-decreasing run is the first incumbent. Where the search ends of itself, the result has the fewest sequences there can be; `steps` is its only limit, and the incumbent
    stands for what it did not reach.
    """
    total = sum(k * n for k, n in counts.items())
    if not total:
        return []
    floor = -(-total // capacity)
    counts = {k: n for k, n in counts.items() if n}
    size = lambda p: sum(n for _, n in p)
    left, best = _Left(counts), []
    while left.sizes:
        s = best_fit(left, capacity)
        best.append((s, left.times(s)))
        left.take(*best[-1])

    left, path, waste, budget = _Left(counts), [], 0, [steps]

    def children() -> Iterator[tuple[tuple[int, ...], int]]:
        for s in completions(left, capacity, budget):
            most = left.times(s)
            yield s, most
            if most > 1:
                yield s, 1

    stack = [children()] if size(best) > floor else []
    while stack and budget[0] > 0 and size(best) > floor:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if path:
                s, n = path.pop()
                left.give(s, n)
                waste -= n * (capacity - sum(s))
            continue
        budget[0] -= 1
        s, n = child
        lost = n * (capacity - sum(s))
        if waste + lost > (size(best) - 1) * capacity - total:  # more waste than a better solution may have
            continue
        left.take(s, n)
        path.append(child)
        waste += lost
        if left.sizes:
            stack.append(children())
        else:
            best = list(path)
            stack.append(iter(()))
    return best


def pack(cut: DataFrame, capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """cut (rows with a length) with sequence_id and offset. The driver sees the histogram only: at most `capacity` rows, whatever the input.

    Pieces stand in the order of (length, doc_id, piece); the plan says which ranks of a length go to which sequences and offsets.
    """
    # Written first: range partitioning samples its input, and would have every text encoded twice.
    laid = in_order(table(cut, "cut", "snappy"), ["length", "doc_id", "piece"], name="pieces")
    counts = {r["length"]: r["n"] for r in laid.groupBy("length").agg(F.count("*").alias("n")).collect()}
    base, at = {}, 0
    for k in sorted(counts):
        base[k], at = at, at + counts[k]
    # Runs of pieces by place in the order: (first place, sequence of the first, offset). A sequence takes one piece of each of its slots.
    runs, used, first = [], dict(base), 0
    for s, n in plan(counts, capacity, steps):
        offset = 0
        for x in s:
            runs.append((used[x], first, offset))
            used[x] += n
            offset += x
        first += n
    runs.sort()
    starts, firsts, offsets = (np.array(c, np.int64) for c in (zip(*runs, strict=True) if runs else ([], [], [])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            i = b["_index"].to_numpy()
            r = np.searchsorted(starts, i, "right") - 1
            yield b.drop(columns="_index").assign(sequence_id=firsts[r] + i - starts[r], offset=offsets[r])

    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields), "sequence_id long, offset long"])
    return laid.mapInPandas(run, kind)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each text's ids and a 0; only documents over `capacity` ids are cut. Null and empty texts are the 0 alone. Every row is packed, so a repeated row is
    packed as often as it comes; a null doc_id stays null; other columns are ignored; an empty table gives no rows.
    """
    return pack(pieces(docs, path, 0, capacity), capacity)
