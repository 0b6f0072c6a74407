"""Ranked lexical search: documents grouped by the mask of an item's terms that they hold.

One pass over the texts keeps, for every document, the terms that some item asks for. Scoring works on
blocks of documents: a bitmap for each term says which of them hold it, an item's bitmaps turned on their
side give every document its mask, and equal masks are one group. A mask's maximum score is the sum of
the largest shares that its terms reach in the block. Masks are evaluated by descending maximum; an item
is finished when the next maximum lies below the lowest score that it keeps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import small_batches, stored

TOP = 10
#: items searched at a time, and bytes of their texts
ITEMS = 1024
ITEM_BYTES = 1 << 20
#: documents of a block
BLOCK_DOCS = 4096
#: documents that are scored between two looks at the next maximum
STEP_DOCS = 64

_SPACE = ord(" ")
#: fixed by the contract: ASCII letters and digits and every character beyond ASCII make terms, A-Z as a-z
_FOLD = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else _SPACE
              for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order, with repeats."""
    return text.translate(_FOLD).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _held_terms(numbers: dict[bytes, int]):
    """(doc_id, n, terms, counts) of every document that has a term at all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            some, lengths, terms, counts = [], [], [], []
            for k in range(len(texts)):
                words = terms_of(texts[k].as_py() or b"")
                if words:
                    found = [(numbers[w], c) for w, c in Counter(words).items() if w in numbers]
                    some.append(k)
                    lengths.append(len(words))
                    terms.append([t for t, _ in found])
                    counts.append([c for _, c in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(some, pa.int64())), pa.array(lengths, pa.int64()),
                 pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "counts"])
    return run


class Best:
    """The documents that an item keeps: highest scores, equal ones by ascending id, null ids last."""

    def __init__(self, top: int):
        self.top, self.ids, self.unknown, self.scores = top, np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    def offer(self, ids: np.ndarray, unknown: np.ndarray, scores: np.ndarray) -> None:
        some = scores > 0
        ids, unknown = np.concatenate([self.ids, ids[some]]), np.concatenate([self.unknown, unknown[some]])
        scores = np.concatenate([self.scores, scores[some]])
        order = np.lexsort((ids, unknown, -scores))[:self.top]
        self.ids, self.unknown, self.scores = ids[order], unknown[order], scores[order]

    def beyond(self, most: int) -> bool:
        """Whether a document of at most this score can no longer enter."""
        return most <= 0 or len(self.scores) == self.top and most < self.scores[-1]


class Block:
    """Documents with their terms: flat lists by document, and a bitmap over the documents for every term."""

    def __init__(self, ids: pa.Array, n: np.ndarray, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray,
                 vocabulary: int, documents: int, all_terms: int):
        self.ids, self.unknown = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        self.starts, self.terms = starts, terms
        # Python's integers: the product may leave 64 bits before it is divided
        m = np.array([10 + 90 * x * documents // all_terms for x in n.tolist()], np.int64)
        owner = np.repeat(np.arange(len(n)), np.diff(starts))
        self.shares = (1_000_000_000 * counts) // (1000 * counts + 8 * m[owner])
        self.highest = np.zeros(vocabulary, np.int64)
        np.maximum.at(self.highest, terms, self.shares)
        self.bitmaps = np.zeros((vocabulary, -(-len(n) // 8)), np.uint8)
        np.bitwise_or.at(self.bitmaps, (terms, owner >> 3), (128 >> (owner & 7)).astype(np.uint8))

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits of every distinct mask, number of documents of each, documents mask after mask)."""
        bits = np.unpackbits(self.bitmaps[terms], axis=1, count=len(self.ids))
        packed = np.packbits(bits, axis=0)
        words = np.zeros((len(self.ids), -(-len(packed) // 8) * 8), np.uint8)
        words[:, :len(packed)] = packed.T
        keys = words.view(np.uint64)
        order = np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort(keys.T)
        new = np.ones(len(order), bool)
        new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
        first = np.flatnonzero(new)
        return bits[:, order[first]], np.diff([*first, len(order)]), order

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        begin, end = self.starts[docs], self.starts[docs + 1]
        flat = np.repeat(begin - np.concatenate([[0], np.cumsum(end - begin)[:-1]]), end - begin) + np.arange((end - begin).sum())
        owner = np.repeat(np.arange(len(docs)), end - begin)
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, owner, weights[self.terms[flat]] * self.shares[flat])
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Offer an item's documents mask by mask; the number of documents that were scored."""
        highest = weights[terms] * self.highest[terms]
        if best.beyond(int(highest.sum())):
            return 0
        bits, sizes, order = self.masks(terms)
        most = np.zeros(bits.shape[1], np.int64)
        for row, share in zip(bits, highest, strict=True):
            most += row * share
        ends, scored, place = np.cumsum(sizes), 0, 0
        queue = np.argsort(-most, kind="stable")
        while place < len(queue) and not best.beyond(int(most[queue[place]])):
            docs: list[np.ndarray] = []
            while place < len(queue) and sum(map(len, docs)) < STEP_DOCS:
                mask = queue[place]
                docs.append(order[ends[mask] - sizes[mask]:ends[mask]])
                place += 1
            some = np.concatenate(docs)
            scored += len(some)
            best.offer(self.ids[some], self.unknown[some], self.scores(some, weights))
        return scored


def _ranked(items: list[np.ndarray], weights: np.ndarray, documents: int, all_terms: int, top: int):
    """The best documents of a partition for every item of a block of items."""
    own_weights = []
    for terms in items:
        own = np.zeros(len(weights), np.int64)
        own[terms] = weights[terms]
        own_weights.append((terms, weights[terms], own if len(weights) * len(items) <= 1 << 24 else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in items]
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(begin, BLOCK_DOCS)
                held, counts = part.column("terms"), part.column("counts")
                starts = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())]).astype(np.int64)
                block = Block(part.column("doc_id"), part.column("n").to_numpy(), starts, held.flatten().to_numpy(),
                              counts.flatten().to_numpy(), len(weights), documents, all_terms)
                for (terms, some, own), kept in zip(own_weights, best, strict=True):
                    if own is None:
                        own = np.zeros(len(weights), np.int64)
                        own[terms] = some
                    block.search(terms, own, kept)
        for number, kept in enumerate(best):
            if len(kept.ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(kept.ids), number)), pa.array(kept.ids, mask=kept.unknown), pa.array(kept.scores)],
                    names=["number", "doc_id", "score"])
    return run


def _item_terms(texts: DataFrame) -> tuple[list, list[list[bytes]]]:
    """Items of a bounded block with their distinct terms; rows with one id make one item."""
    found: dict = {}
    for r in texts.collect():
        found.setdefault(r["item_id"], set()).update(terms_of((r["text"] or "").encode()))
    ids = sorted(found, key=lambda i: (i is None, i or 0))
    return ids, [sorted(found[i]) for i in ids]


def search(docs: DataFrame, items: DataFrame, top: int = TOP, most_items: int = ITEMS) -> DataFrame:
    """The ``top`` documents of highest score for every item, over all documents and whole texts.

    A null text has no terms; a document or item without terms is in no result. Rows of ``items`` with one
    id make one item of all their terms; a null id is an id. Every row of ``docs`` is a document, repeated
    rows too; equal scores go by ascending doc_id, null last. Other columns are not read. Items are taken in
    blocks of bounded size, one pass over the documents each. Columns: item_id, rank, doc_id, score.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    asked = items.select(F.col("item_id").alias("item_id"), F.col("text").alias("text"))
    size = asked.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).head()
    blocks = max(1, -(-size["rows"] // most_items), -(-(size["bytes"] or 0) // ITEM_BYTES))
    out = None
    for block in range(blocks):
        ids, terms = _item_terms(asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block))
        found = _search_block(given, terms, top)
        if found is not None:
            names = spark.createDataFrame(list(enumerate(ids)), f"number long, item_id {asked.schema['item_id'].dataType.simpleString()}")
            found = found.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score")
            out = found if out is None else out.unionByName(found)
    if out is None:
        kind = asked.schema["item_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out


def _search_block(docs: DataFrame, terms: list[list[bytes]], top: int) -> DataFrame | None:
    spark = docs.sparkSession
    numbers = {t: k for k, t in enumerate(sorted(set().union(*terms)))}
    if not numbers:
        return None
    with small_batches(spark):
        held = stored(docs.mapInArrow(_held_terms(numbers), "doc_id long, n long, terms array<int>, counts array<long>"), "held-terms")
        size = held.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).head()
        if not size["documents"]:
            return None
        weights = np.full(len(numbers), weight(size["documents"], 0), np.int64)
        for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weights[r["term"]] = weight(size["documents"], r["count"])
        wanted = [np.array([numbers[t] for t in own], np.int64) for own in terms]
        found = stored(held.mapInArrow(_ranked(wanted, weights, size["documents"], size["terms"], top),
                                       "number long, doc_id long, score long"), "ranked")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= top)
