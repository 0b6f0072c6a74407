"""Packing token pieces into sequences by bin completion.

The plan is made from the number of pieces of each length, at most one number per length up to the
capacity, whatever the number of documents. Branch and bound fills bins around the longest piece left:
it enumerates fillings that no other filling dominates, prunes by the waste that a better plan could
still afford, and finishes every node by best fit, which gives the incumbents. A filling is used as often at once as
the counts allow before it is used less often. Executors then deal the pieces of a length, numbered by a running total, to the
places that the plan has for that length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import running, small_batches, stored, text_or_empty
from sensorloom.llm.tokens import encoder

#: fixed by the contract
CAPACITY = 1024
END_ID = 2

#: pieces set into fillings and bins completed by the search before the incumbent is taken
STEPS = 30_000

#: a bin's contents, as (length, how often), and how many bins are like it
Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document's token pieces.

    A null text is an empty one, which still has its end id. Only documents above ``capacity`` are cut; the first piece
    holds what the others leave. ``ids`` are little-endian unsigned 32-bit numbers.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, ids in zip(batch.column(0).to_pylist(),
                                 encoder(vocabulary).encode(x.as_py() for x in batch.column(1)), strict=True):
                ids += tail
                n = len(ids) // 4
                ends = range(n % capacity or capacity, n + 1, capacity)
                starts = [0, *ends[:-1]]
                rows += [(doc_id, i, a, b - a, ids[4 * a:4 * b]) for i, (a, b) in enumerate(zip(starts, ends, strict=True))]
                held += len(ids)
                if held > 1 << 23:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any plan needs: by total length, and by Martello and Toth's bound over every threshold."""
    half = capacity // 2
    number, length = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    k = np.arange(half + 1)
    large = number[capacity] - number[capacity - k]
    middle = number[capacity - k] - number[half]
    room = middle * capacity - (length[capacity - k] - length[half])
    small = length[half] - np.where(k > 0, length[np.maximum(k - 1, 0)], 0)
    return max(-(-int(length[capacity]) // capacity), int((large + middle + np.maximum(0, -((room - small) // capacity))).max()))


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Longest first, each piece into the fullest bin that takes it; equal bins and equal pieces go together."""
    open_bins: dict[int, list[tuple]] = {}
    rooms = 0  # bit r: some bin has room r

    def put(room: int, content: tuple, n: int) -> None:
        nonlocal rooms
        open_bins.setdefault(room, []).append((content, n))
        rooms |= 1 << room

    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            fitting = rooms >> size << size
            if not fitting:
                fit = capacity // size
                whole, rest = divmod(left, fit)
                for held, n in ((fit, whole), (rest, 1)):
                    if held and n:
                        put(capacity - held * size, ((size, held),), n)
                break
            room = (fitting & -fitting).bit_length() - 1
            # as many into each bin of this room as fit, so that few kinds of bins arise
            content, n = open_bins[room].pop()
            fit = min(room // size, left)
            used = min(n, left // fit)
            if used < n:
                open_bins[room].append((content, n - used))
            elif not open_bins[room]:
                rooms ^= 1 << room
            longest, held = content[-1]
            grown = (*content[:-1], (size, held + fit)) if longest == size else (*content, (size, fit))
            put(room - fit * size, grown, used)
            left -= used * fit
    return [entry for bins in open_bins.values() for entry in bins]


def reachable(counts: np.ndarray, capacity: int) -> list[int]:
    """For each length, the sums up to ``capacity`` that the lengths up to it can make, as bits; counts are ignored."""
    full, sums, upto = (2 << capacity) - 1, 1, []
    for size in range(capacity + 1):
        if size and counts[size]:
            step = size
            while step <= capacity:  # any number of pieces of this length, by doubling
                sums |= sums << step & full
                step *= 2
        upto.append(sums)
    return upto


def dominated(filling: tuple[int, ...], left: list[int], there: int, waste: int) -> bool:
    """Whether a piece that is left could take the place of some pieces of ``filling``, or of none, for a better one.

    Such a piece is at least as long as what it replaces and fits: whatever plan uses ``filling`` is no
    worse when the replaced pieces go where that piece was. One for an equal one changes nothing.
    """
    spare = there
    for size in set(filling):
        if left[size] <= filling.count(size):
            spare &= ~(1 << size)
    ones, more = 0, 0  # sums of one piece, of two or more
    for size in filling:
        more |= (more | ones) << size
        ones |= 1 << size
    within = ones << 1 | 1 << 1 if waste else 0  # longer by 1 to ``waste``
    width = 1
    while within and width < waste:
        step = min(width, waste - width)
        within |= within << step
        width += step
    reach, width = more, 0  # longer by 0 to ``waste``
    while reach and width < waste:
        step = min(width + 1, waste - width)
        reach |= reach << step
        width += step
    return bool((within | reach) & spare)


class Budget:
    """Steps that a search has left: one for each piece set into a filling, one for each bin completed."""

    def __init__(self, steps: int):
        self.left = steps

    def spend(self) -> bool:
        self.left -= 1
        return self.left >= 0


def exact(left: list[int], there: int, target: int, longest: int, upto: list[int], budget: Budget) -> Iterator[tuple[int, ...]]:
    """Every filling of pieces no longer than ``longest`` that sums to ``target``, longest pieces first."""
    if not target:
        yield ()
        return
    size = min(longest, target)
    while size := (there & ((2 << size) - 1) & ~1).bit_length() - 1:
        if size < 0 or not upto[size] >> target & 1:
            return  # shorter lengths reach no more sums
        if left[size] and upto[size] >> (target - size) & 1:
            if not budget.spend():
                return
            left[size] -= 1
            for rest in exact(left, there, target - size, size, upto, budget):
                yield (size, *rest)
            left[size] += 1
        size -= 1


def fillings(counts: np.ndarray, room: int, most_waste: int, upto: list[int], budget: Budget) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` by any number of pieces, least waste first, then longest pieces first."""
    left = counts.tolist()
    there = sum(1 << s for s in np.flatnonzero(counts).tolist())
    for waste in range(min(most_waste, room) + 1):
        whole = left[:]
        for filling in exact(whole, there, room - waste, room - waste, upto, budget):
            if not dominated(filling, left, there, waste):
                yield filling


def completed(counts: np.ndarray, capacity: int, steps: int = STEPS) -> Plan:
    """The plan with the fewest bins that the search finds within its steps; never more bins than best fit takes.

    Depth first. A node's bins are settled; its branches are the undominated fillings around the longest
    piece left, each used as often as the counts and the waste bound allow, then half as often, down to
    once. Every node is finished by best fit, and the fewest bins so far prune what follows.
    """
    incumbent = best_fit(counts, capacity)
    least, bins = lower_bound(counts, capacity), sum(n for _, n in incumbent)
    total = int((counts * np.arange(capacity + 1)).sum())
    upto, budget = reachable(counts, capacity), Budget(steps)

    def branches(left: np.ndarray, used: int, waste: int, trail: tuple | None) -> Iterator[tuple]:
        largest = int(np.flatnonzero(left)[-1])
        others = left.copy()
        others[largest] -= 1
        for option in fillings(others, capacity - largest, (bins - 1) * capacity - total - waste, upto, budget):
            allowed = (bins - 1) * capacity - total - waste  # less than before if a better plan came up meanwhile
            content = tuple(sorted(Counter((largest, *option)).items(), reverse=True))
            free = capacity - largest - sum(option)
            times = min(int(left[s]) // n for s, n in content)
            if free:
                times = min(times, allowed // free)
            while times > 0:
                after = left.copy()
                for s, n in content:
                    after[s] -= n * times
                yield after, used + times, waste + free * times, ((content, times), trail)
                times //= 2

    stack = [branches(counts, 0, 0, None)] if counts.any() else []
    while stack and bins > least and budget.left > 0:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
            continue
        left, used, waste, trail = node
        if not budget.spend() or used + lower_bound(left, capacity) >= bins:
            continue
        rest = best_fit(left, capacity)
        if (found := used + sum(n for _, n in rest)) < bins:
            bins, incumbent, at = found, rest, trail
            while at:
                incumbent.append(at[0])
                at = at[1]
        if left.any():
            stack.append(branches(left, used, waste, trail))
    return incumbent


@dataclass(frozen=True)
class Places:
    """Where the pieces of a length go: piece number ``low`` and on go ``per_bin`` each to bins from ``first_bin`` on."""

    key: np.ndarray
    low: np.ndarray
    per_bin: np.ndarray
    first_bin: np.ndarray
    offset: np.ndarray


#: numbers of pieces of one length stay below this
_SPAN = 1 << 44


def places(plan: Plan) -> Places:
    rows, taken, base = [], Counter(), 0
    for content, times in plan:
        offset = 0
        for size, n in content:
            rows.append((size * _SPAN + taken[size], taken[size], n, base, offset))
            taken[size] += n * times
            offset += n * size
        base += times
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Places(*columns)


def pack(items: DataFrame, order: list[Column], capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``; ``length`` is from 1 to ``capacity``, other columns are kept.

    ``order`` tells the items apart and numbers equal lengths alike in each run. Pass a stored frame.
    An empty frame gives no rows.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for row in items.groupBy("length").count().collect():  # one row per length
        counts[row["length"]] = row["count"]
    at = places(completed(counts, capacity, steps))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        size, number = length.to_numpy(), number.to_numpy()
        i = np.searchsorted(at.key, size * _SPAN + number, side="right") - 1
        step = number - at.low[i]
        return pd.DataFrame({"sequence_id": at.first_bin[i] + step // at.per_bin[i],
                             "offset": at.offset[i] + step % at.per_bin[i] * size})
    numbered = running(items, "length", F.lit(1), order, "number")
    return numbered.withColumn("place", place("length", "number")).select(*items.columns, "place.*")


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, vocabulary, capacity, end_id).withColumn("ids_crc32", F.crc32("ids"))
    with small_batches(docs.sparkSession):
        narrow = stored(cut.drop("ids"), "pieces")
    return pack(narrow, [F.col("doc_id"), F.col("piece"), F.col("start"), F.col("ids_crc32")], capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) from pieces that still carry ``ids``: the ids of each sequence end to end."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
