"""Merkle manifest of a dataset: a tree of digests for every group of rows and one over the groups.

The leaves of a group, numbered in order, are cut into aligned subtrees of bounded height. A subtree is
one row: its nodes lie in a van Emde Boas layout, the upper half of the levels first and then every
lower subtree, each laid out the same way, so a path from root to leaf crosses few stretches of bytes
whatever the size of a cache line. Block roots are the leaves of the next tier, until one block holds
the rest of a group. Siblings are read by address from the blocks, tier after tier from the root down.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import lookup, small_batches, stored

#: levels of a block below its root: 2 ** 9 leaves, 32 KB of digests
BLOCK_HEIGHT = 9
#: fixed by the contract: what a leaf covers, in order
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST_BYTES = 32


def joined_digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def address(levels: int, depth: int, place: np.ndarray) -> np.ndarray:
    """Where the nodes at ``place`` of a level lie in the van Emde Boas layout of a full tree."""
    place = np.asarray(place, np.int64)
    start = np.zeros_like(place)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        lower, depth = levels - upper, depth - upper
        start += (1 << upper) - 1 + (place >> depth) * ((1 << lower) - 1)
        place, levels = place & ((1 << depth) - 1), lower
    return start


@cache
def addresses(height: int) -> tuple[np.ndarray, ...]:
    """Addresses of every level of a block, root first."""
    return tuple(address(height + 1, depth, np.arange(1 << depth)) for depth in range(height + 1))


def height_of(leaves: int) -> int:
    """Levels above so many leaves until one node remains."""
    return max(0, (leaves - 1).bit_length())


def build(leaves: list[bytes], height: int) -> bytes:
    """The nodes of an aligned subtree in their layout; places that no leaf lies under stay zero."""
    at = addresses(height)
    nodes = np.zeros(((2 << height) - 1, DIGEST_BYTES), np.uint8)
    row = leaves
    for depth in range(height, -1, -1):
        nodes[at[depth][:len(row)]] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, DIGEST_BYTES)
        texts = [x.hex() for x in row]
        row = [sha256("".join(texts[k:k + 2]).encode()).digest() for k in range(0, len(texts), 2)] if depth else row
    return nodes.tobytes()


def path(nodes: bytes, height: int, leaves: int, place: int) -> list[str]:
    """Step after step from a leaf to the root of its block: side and digest of the sibling, or "-" for none."""
    at, steps, held = addresses(height), [], leaves
    for depth in range(height, 0, -1):
        other = place ^ 1
        if other < held:
            start = int(at[depth][other]) * DIGEST_BYTES
            steps.append(("l" if other < place else "r") + nodes[start:start + DIGEST_BYTES].hex())
        else:
            steps.append("-")
        place, held = place >> 1, (held + 1) >> 1
    return steps


def folded(leaf: str, steps: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for step in steps:
        leaf = joined_digest([leaf] if step == "-" else [step[1:], leaf] if step[0] == "l" else [leaf, step[1:]])
    return leaf


def proof(steps: list[str]) -> str:
    return joined_digest([s[1:] for s in steps if s != "-"])


def field_text(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field_text(f) for f in fields]).cast("binary"), 256))


def numbered(rows: DataFrame, group: str, order: list[Column], into: str) -> DataFrame:
    """Number the rows of every group from 0 in an order, whatever share of the rows a group has.

    Rows are range-partitioned by group, order and a salt that divides equal rows, sorted and written with
    their place in the partition; the sizes of the partitions then give every row its number. ``rows``
    must be stored, ``group`` must not be null.
    """
    salt = F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())
    keys = [F.col(group), *order, F.col("_salt")]
    ranged = rows.withColumn("_salt", salt).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(ranged.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}).drop("_salt"),
                    "numbered")
    parts = placed.groupBy(group, "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(parts.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows"), "bases")
    return (lookup(placed, bases, [group, "_part"]).withColumn(into, F.col("_base") + F.col("_place") - F.col("_first"))
            .drop("_part", "_place", "_first", "_base"))


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = batch.column("digests").to_pylist()
        heights = [height_of(len(d)) if alone else full for d, alone, full in zip(
            digests, batch.column("alone").to_pylist(), batch.column("full").to_pylist(), strict=True)]
        nodes = [build(d, h) for d, h in zip(digests, heights, strict=True)]
        roots = [n[:DIGEST_BYTES] for n in nodes]  # the layout starts at the root
        yield pa.RecordBatch.from_arrays(
            [batch.column("group"), batch.column("block"), pa.array(heights, pa.int32()), pa.array([len(d) for d in digests], pa.int32()),
             pa.array(roots, pa.binary()), pa.array(nodes, pa.binary()), batch.column("held"), batch.column("alone")],
            names=["group", "block", "height", "leaves", "root", "nodes", "held", "alone"])


_BLOCKS = "group string, block long, height int, leaves int, root binary, nodes binary, held {held}, alone boolean"


def tiers(leaves: DataFrame, height: int = BLOCK_HEIGHT) -> list[DataFrame]:
    """Blocks of every tier, lowest first, from (group, index, digest, held); ``held`` stays with the leaf.

    A group is complete in the tier where one block holds all that remains of it (``alone``); only there
    may a block be lower than ``height``.
    """
    out, tier = [], leaves
    while True:
        kind = tier.schema["held"].dataType.simpleString()
        block = F.shiftright("index", height)
        sizes = stored(tier.groupBy("group").agg((F.count(F.lit(1)) <= (1 << height)).alias("alone")), "group-sizes")
        parts = (tier.groupBy("group", block.alias("block"))
                 .agg(F.sort_array(F.collect_list(F.struct("index", "digest", "held"))).alias("rows")))
        rows = lookup(parts, sizes, ["group"]).select(
            "group", "block", F.col("rows.digest").alias("digests"), F.col("rows.held").alias("held"), "alone",
            F.lit(height).alias("full"))
        built = stored(rows.mapInArrow(_built, _BLOCKS.format(held=f"array<{kind}>")), "blocks")
        out.append(built)
        tier = built.filter("not alone").select("group", F.col("block").alias("index"), F.col("root").alias("digest"),
                                                F.lit(None).cast("int").alias("held"))
        if tier.isEmpty():
            return out


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, block, steps) of the blocks below: the steps from their roots to the root of all."""
    for batch in batches:
        for r in batch.to_pylist():
            steps = [path(r["nodes"], r["height"], r["leaves"], k) + r["steps"] for k in range(r["leaves"])]
            first = r["block"] << r["height"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["group"]] * len(steps)), pa.array(range(first, first + len(steps)), pa.int64()),
                 pa.array(steps, pa.list_(pa.string())), pa.array([r["subroot"]] * len(steps))],
                names=["group", "block", "steps", "subroot"])


_STEPS = "group string, block long, steps array<string>, subroot string"


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            out = []
            for k, held in enumerate(r["held"]):
                steps = path(r["nodes"], r["height"], r["leaves"], k) + r["steps"]
                leaf = held["leaf"].hex()
                root = folded(held["changed"].hex() if held["changed"] is not None else leaf, steps)
                out.append((held["doc_id"], leaf, r["subroot"], r["all"], proof(steps), root, root == r["all"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                pa.int64(), *[pa.string()] * 5, pa.bool_()), strict=True)], names=[x.split()[0] for x in _PROVED.split(", ")])


_PROVED = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _descended(blocks: list[DataFrame], top: DataFrame) -> DataFrame:
    """(group, block, steps, subroot) for every block of the lowest tier, from (group, steps, subroot) of the groups."""
    steps = None
    for tier in reversed(blocks[1:]):
        whole = lookup(tier.filter("alone"), top, ["group"], "inner")
        below = whole if steps is None else whole.unionByName(
            lookup(tier.filter("not alone"), steps, ["group", "block"], "inner").select(whole.columns))
        steps = stored(below.select("group", "block", "height", "leaves", "nodes", "steps", "subroot").mapInArrow(_paths, _STEPS), "steps")
    whole = lookup(blocks[0].filter("alone"), top, ["group"], "inner")
    if steps is None:
        return whole
    return whole.unionByName(lookup(blocks[0].filter("not alone"), steps, ["group", "block"], "inner").select(whole.columns))


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = BLOCK_HEIGHT) -> DataFrame:
    """A proof for every row: its leaf, the root of its language, the root of all, and what the proof folds to.

    Leaves of a language ascend by doc_id, null first, then by digest; every repeated row is a leaf. A null
    language is a group of its own and comes first, the others follow bytewise. ``tampered`` rows are folded
    with one added to ``n_chars`` (null stays). A row without id is never tampered with. Columns beyond the
    five are not read, an empty table gives no rows. Columns: doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    given = docs.select(*[F.col(c).alias(c) for c in FIELDS])
    if tampered is None:
        tampered = F.lit(False)
    changed = [F.col(c) + F.lit(1).cast(kinds[c]) if c == "n_chars" else F.col(c) for c in FIELDS]
    marked = tampered & F.col("n_chars").isNotNull() & F.col("doc_id").isNotNull()
    group = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    leaves = stored(given.select(group.alias("group"), F.col("doc_id").cast("long").alias("doc_id"),
                                 leaf_digest([F.col(c) for c in FIELDS]).alias("leaf"),
                                 F.when(marked, leaf_digest(changed)).alias("changed")), "leaves")
    placed = numbered(leaves, "group", [F.col("doc_id").asc_nulls_first(), F.col("leaf")], "index")
    held = F.struct("doc_id", "leaf", "changed")
    with small_batches(spark):
        blocks = tiers(placed.select("group", "index", F.col("leaf").alias("digest"), held.alias("held")), height)
        subroots = [b.filter("alone").select("group", "root") for b in blocks]
        roots = subroots[0]
        for more in subroots[1:]:
            roots = roots.unionByName(more)
        roots = stored(roots, "subroots")
        over = numbered(roots.withColumn("all", F.lit("")), "all", [F.col("group")], "index")
        upper = tiers(over.select(F.col("all").alias("group"), "index", F.col("root").alias("digest"),
                                  F.struct("group", F.hex("root").alias("subroot")).alias("held")), height)
        if upper[0].isEmpty():
            return spark.createDataFrame([], _PROVED)
        root = upper[-1].filter("alone").head()["root"].hex()
        # the groups' own steps: one row for each leaf of the tree over the groups
        start = spark.createDataFrame([("", [], "")], "group string, steps array<string>, subroot string")
        at_groups = _descended(upper, start)
        top = stored(at_groups.mapInArrow(_group_steps, "group string, steps array<string>, subroot string"), "group-steps")
        lowest = _descended(blocks, top).select("held", "height", "leaves", "nodes", "steps", "subroot", F.lit(root).alias("all"))
        return stored(lowest.mapInArrow(_proved, _PROVED), "proved")


def _group_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            steps = [path(r["nodes"], r["height"], r["leaves"], k) + r["steps"] for k in range(r["leaves"])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h["group"] for h in r["held"]]), pa.array(steps, pa.list_(pa.string())),
                 pa.array([h["subroot"].lower() for h in r["held"]])], names=["group", "steps", "subroot"])


def tampered_by_crc(every: int) -> Column:
    """Rows whose id, written in decimal, has a checksum that ``every`` divides."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(every)) == 0
