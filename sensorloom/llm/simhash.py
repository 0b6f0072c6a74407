"""SimHash near duplicates: tiled exact comparison of fingerprints.

Distinct fingerprints are dealt to cells by the population counts of their parts. Two fingerprints
within the radius differ in the counts of their parts by no more than the radius in sum, so only tiles
of cells that near to each other are compared; the others are skipped. A pair of tiles is compared by
numpy: exclusive or, bit count, and then only a spanning forest of its links leaves the task, so a
crowd of copies costs as many edges as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import lookup, stored, text_or_empty
from sensorloom.llm.components import components

#: fixed by the contract
SHINGLE = 3
RADIUS = 2
SEED = 42

#: fingerprints of a tile, at most about
TILE = 16_384
#: comparisons for each fingerprint that are fine before the cells are made finer
COMPARISONS = 20_000
#: share of all pairs that lie in near cells at radius 2, by number of parts (random fingerprints)
NEAR_SHARE = {1: 0.34, 2: 0.12, 4: 0.014, 8: 0.00025}
PART_BITS = 7
#: linked pairs that a task gathers before it folds them into its forest
FOLD = 1 << 19

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; 0 without words."""
    words = text.translate(_LOWER).split()  # bytes.split knows exactly the six white space bytes
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    stops = ends[shingle - 1:] - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:len(stops)].tolist(), stops.tolist(), strict=True)],
                      np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fingerprint long) of every document; a null text is an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found.view(np.int64))],
                                  ["doc_id", "text_hash", "fingerprint"])
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fingerprint long")


def parts_for(distinct: int, radius: int) -> int:
    """Parts whose counts make the cells: enough to keep the comparisons of a fingerprint in bounds.

    The links found are the same for any number. Wide radii gain nothing from parts.
    """
    if radius > 4:
        return 1
    return next((n for n, share in NEAR_SHARE.items() if share * distinct <= COMPARISONS), 8)


def cell_of(fingerprint: Column, parts: int) -> Column:
    width = 64 // parts
    mask = -1 if parts == 1 else (1 << width) - 1
    counts = [F.bit_count(F.shiftrightunsigned(fingerprint, i * width).bitwiseAND(F.lit(mask).cast("long"))) for i in range(parts)]
    return sum((F.shiftleft(c.cast("long"), PART_BITS * i) for i, c in enumerate(counts[1:], 1)), counts[0].cast("long"))


def near_cells(parts: int, radius: int) -> list[int]:
    """What to add to a cell's number to get the cells within the radius, each pair of cells once.

    A count that would leave its range gives the number of a cell that cannot exist.
    """
    def vectors(left: int, room: int) -> Iterator[tuple[int, ...]]:
        if not left:
            yield ()
            return
        for d in range(-room, room + 1):
            for rest in vectors(left - 1, room - abs(d)):
                yield (d, *rest)
    half = [v for v in vectors(parts, radius) if next((d for d in v if d), 1) > 0]
    return [sum(d << (PART_BITS * i) for i, d in enumerate(v)) for v in half]


def linked_blocks(left: np.ndarray, right: np.ndarray, radius: int, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in both arrays of the pairs within the radius, from about ``block`` comparisons at a time."""
    rows = max(1, block // max(1, len(right)))
    for at in range(0, len(left), rows):
        near = np.bitwise_count(left[at:at + rows, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        yield i + at, j


def linked(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in both arrays of the pairs within the radius."""
    found = list(linked_blocks(left, right, radius))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (
        np.empty(0, np.int64), np.empty(0, np.int64))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every linked value to the least value of its component: as connected as the links, but few."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    label = np.arange(len(values))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(values))
    return values[other], values[label[other]]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                a, b = (x.values.field("fingerprint").to_numpy().view(np.uint64) for x in (left, right))
                x, y = folded(a, b, linked_blocks(a, b, radius))
                if len(x):
                    yield pa.record_batch([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])
    return run


def folded(a: np.ndarray, b: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The forest of all linked pairs; a crowd's pairs are folded into it before they add up."""
    x, y, held = [], [], 0
    for i, j in blocks:
        apart = a[i] != b[j]
        x.append(a[i[apart]])
        y.append(b[j[apart]])
        held += len(x[-1])
        if held > FOLD:
            left, right = forest(np.concatenate(x), np.concatenate(y))
            x, y, held = [left], [right], 0
    return forest(np.concatenate(x), np.concatenate(y)) if held or len(x) else (a[:0], b[:0])


def _met(held: DataFrame, radius: int, tile: int, parts: int) -> DataFrame:
    """Pairs of tiles that may hold links, as lists ``left`` and ``right`` of the rows of ``held``."""
    cells = held.withColumn("cell", cell_of(F.col("fingerprint"), parts))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    dealt = cells.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("fingerprint"), F.col("tiles")))
    tiles = stored(dealt.groupBy("cell", "chunk").agg(F.collect_list(F.struct(*held.columns)).alias("held")), "tiles")
    names = tiles.select("cell", "chunk")
    offsets = F.array(*[F.lit(d).cast("long") for d in near_cells(parts, radius)])
    around = names.withColumn("step", F.explode(offsets)).withColumn("near", F.col("cell") + F.col("step"))
    other = names.select(F.col("cell").alias("near"), F.col("chunk").alias("near_chunk"))
    pairs = around.join(other, "near").filter((F.col("step") != 0) | (F.col("near_chunk") >= F.col("chunk")))
    left = tiles.select("cell", "chunk", F.col("held").alias("left"))
    right = tiles.select(F.col("cell").alias("near"), F.col("chunk").alias("near_chunk"), F.col("held").alias("right"))
    return pairs.join(left, ["cell", "chunk"]).join(right, ["near", "near_chunk"]).select("left", "right")


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """Edges (a, b) that connect the stored distinct fingerprints as their links within ``radius`` do."""
    parts = parts or parts_for(distinct.count(), radius)
    return _met(distinct.select("fingerprint"), radius, tile, parts).mapInArrow(_compare(radius), "a long, b long")


def grouped(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE,
            parts: int | None = None) -> DataFrame:
    """(doc_id, text_hash, fingerprint, component) of every document; a component is named by its least fingerprint."""
    marks = stored(fingerprints(docs.select("doc_id", "text"), shingle), "fingerprints")
    distinct = stored(marks.select("fingerprint").distinct(), "distinct-fingerprints")
    found = stored(components(links(distinct, radius, tile, parts)), "components")
    named = lookup(marks, found.withColumnRenamed("node", "fingerprint"), ["fingerprint"])
    return named.withColumn("component", F.coalesce("component", "fingerprint"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE,
                    parts: int | None = None) -> DataFrame:
    """(doc_id, fingerprint long, component_id) of every document, repeated rows too.

    ``component_id`` is the smallest doc_id reachable over links; a null doc_id never is, so it is null
    only where a component holds no other. Texts without words share the fingerprint zero, which links
    like any other. An empty table gives no rows.
    """
    named = stored(grouped(docs, shingle, radius, tile, parts), "grouped")
    least = stored(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component-ids")
    return lookup(named, least, ["component"]).select("doc_id", "fingerprint", "component_id")


def hex_digits(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of every group of near duplicates, with all its columns: that with the smallest doc_id.

    Null ids come last, and of rows that share an id one text stays; rows equal in both stay together, as exact
    duplicates are another operator's business. A null text is an empty one, texts without words are one
    group, and an empty table gives no rows. No name of a column of ``docs`` can clash.
    """
    def key(doc_id: Column, text_hash: Column) -> Column:
        return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), text_hash.cast("string"))

    named = stored(grouped(docs), "grouped").withColumn("key", key(F.col("doc_id"), F.col("text_hash")))
    first = named.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"), F.count(F.lit(1)).alias("n"))
    stays = key(F.col("first.doc_id"), F.col("first.text_hash")).alias("stays")
    crowds = stored(first.filter("n > 1").select("component", stays), "crowds")
    # those that go, as they are fewer than those that stay: whole rows are shuffled only where the keys are too many to broadcast
    go = stored(lookup(named, crowds, ["component"], "inner").filter("key != stays").select("key").distinct(), "go")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("key", key(F.col("row.doc_id"), F.xxhash64(text_or_empty("row.text"))))
    return lookup(rows, go, ["key"], "left_anti").select("row.*")
