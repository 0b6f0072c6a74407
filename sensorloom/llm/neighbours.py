"""Nearest neighbours by largest inner product, searched in a forest of random-projection trees.

A bounded sample fits the trees: every node projects on the difference of two of its rows and splits at
the median. Every row is indexed: it lies in one leaf of every tree, and neighbouring leaves make pages of
bounded size. A query walks all trees through one priority queue, nearest leaf first, until the leaves
hold as many rows as the search may look at; that number is calibrated against brute force on a sample of
queries. Pages and the queries that visit them meet in one sort, rows first, so a task holds one page
and streams its queries. Finalists are scored anew on the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import lookup, small_batches, stored

TREES = 3
#: rows of a leaf, where the sample allows so many leaves
LEAF_ROWS = 256
#: rows of a page: what one task holds while it streams queries
PAGE_ROWS = 16_384
#: visits of a page that one task serves; beyond it the page is copied to more tasks
PAGE_VISITS = 50_000
#: most rows that fit the trees, and fewest of them in a leaf
SAMPLE_ROWS = 65_536
SAMPLE_LEAF_ROWS = 16
#: queries compared with brute force to choose how many rows a search looks at, and the recall asked for
PROBES = 192
RECALL = 0.95
SEED = 20250611
_BLOCK_ROWS = 2048
_BLOCK_QUERIES = 256


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: node v of a tree has children 2v and 2v + 1, leaves are the nodes from ``leaves`` on."""

    leaves: int
    planes: np.ndarray  # (trees, leaves, width + 1), float32
    cuts: np.ndarray  # (trees, leaves)
    longest: float

    @property
    def trees(self) -> int:
        return len(self.planes)

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Rows with one more coordinate that gives all of them one length, so large products are near."""
        rest = np.sqrt(np.maximum(self.longest ** 2 - np.square(vectors).sum(axis=1), 0))
        return np.concatenate([vectors, rest[:, None]], axis=1)

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """Number of the leaf of every row in every tree, counted over all trees: (rows, trees)."""
        rows, out = self.lifted(vectors), np.empty((len(vectors), self.trees), np.int64)
        for t in range(self.trees):
            node = np.ones(len(rows), np.int64)
            while len(rows) and node[0] < self.leaves:
                side = np.einsum("ij,ij->i", rows, self.planes[t, node]) > self.cuts[t, node]
                node = 2 * node + side
            out[:, t] = t * self.leaves + node - self.leaves
        return out

    def margins(self, queries: np.ndarray) -> np.ndarray:
        """Distance of every query to every plane: (queries, trees, nodes)."""
        scaled = queries * (self.longest / np.sqrt(np.square(queries).sum(axis=1)))[:, None]
        width = queries.shape[1]
        return np.einsum("qd,tvd->qtv", scaled, self.planes[:, :, :width], optimize=True) - self.cuts

    def nearest_leaves(self, margins: np.ndarray) -> Iterator[int]:
        """All leaves of all trees through one priority queue, nearest first."""
        margins = margins.tolist()
        queue = [(0.0, t, 1) for t in range(self.trees)]
        while queue:
            far, t, node = heapq.heappop(queue)
            own = margins[t]
            while node < self.leaves:
                m = own[node]
                right = m > 0
                heapq.heappush(queue, (far + m * m, t, 2 * node + (not right)))
                node = 2 * node + right
            yield t * self.leaves + node - self.leaves


def fit(sample: np.ndarray, rows: int, longest: float, trees: int = TREES, leaf_rows: int = LEAF_ROWS,
        seed: int = SEED) -> Forest:
    """Trees for ``rows`` rows from a sample of them."""
    depth = 0
    while rows > leaf_rows << depth and len(sample) >= SAMPLE_LEAF_ROWS << (depth + 1):
        depth += 1
    leaves, width = 1 << depth, sample.shape[1]
    blank = Forest(leaves, np.zeros((trees, leaves, width + 1), np.float32), np.zeros((trees, leaves)), longest)
    lifted = blank.lifted(sample.astype(np.float64))
    random = np.random.default_rng(seed)
    for t in range(trees):
        inside = {1: np.arange(len(sample))}
        for node in range(1, leaves):
            own = inside.pop(node)
            left = right = own
            if len(own) > 1:
                one, two = random.choice(own, 2, replace=False)
                plane = lifted[one] - lifted[two]
                plane = (plane / max(np.sqrt(plane @ plane), 1e-300)).astype(np.float32)
                at = lifted[own] @ plane
                cut = np.median(at)
                blank.planes[t, node], blank.cuts[t, node] = plane, cut
                left, right = own[at <= cut], own[at > cut]
            inside[2 * node], inside[2 * node + 1] = left, right
    return blank


@dataclass(frozen=True)
class Pages:
    """First page of every leaf and the number of pages that its rows are dealt to (nearly always one)."""

    first: np.ndarray
    dealt: np.ndarray
    count: int


def pages_of(leaf_counts: np.ndarray, trees: int, page_rows: int = PAGE_ROWS) -> Pages:
    """Neighbouring leaves of a tree share a page; a leaf larger than a page has several of its own."""
    first, dealt = np.zeros(len(leaf_counts), np.int64), np.ones(len(leaf_counts), np.int64)
    page, held, leaves = 0, 0, len(leaf_counts) // trees
    for leaf, n in enumerate(leaf_counts.tolist()):
        if held and (held + n > page_rows or leaf % leaves == 0):
            page, held = page + 1, 0
        first[leaf] = page
        held += n
        if n > page_rows:
            dealt[leaf] = -(-n // page_rows)
            page, held = page + int(dealt[leaf]), 0
    return Pages(first, dealt, page + 1)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column of one width, without copies where the batch allows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _numpy_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column("vec_id").to_numpy(), matrix(batch.column("embedding"))


def best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, highest first, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:most]


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, the same to the last bit wherever a row lies."""
    return (rows.astype(np.float64) * query.astype(np.float64)).sum(axis=1)


def finalists(products: np.ndarray, rows: np.ndarray, ids: np.ndarray, query: np.ndarray, most: int):
    """(ids, scores) of the best rows: chosen by fast products, scored and ordered by exact ones."""
    if len(products) > most:
        edge = np.partition(products, len(products) - most)[len(products) - most]
        near = np.flatnonzero(products >= edge - 1e-9 * (1 + abs(edge)) if np.isfinite(edge) else np.isfinite(products))
    else:
        near = np.flatnonzero(np.isfinite(products))
    scores = exact_scores(rows[near], query)
    order = best(scores, ids[near], most)
    return ids[near][order], scores[order]


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding, low, high): the rows that take part, with a digest of the vector.

    Left out: null ids, null vectors, vectors that are zero or hold null, NaN or infinite components, and
    vectors of another width than most (the wider of equally common ones). Of rows with one id the vector
    with the smallest digest counts, once.
    """
    vector: Column = F.col(vector_col)
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("embedding")).filter(
        "vec_id is not null and embedding is not null")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = kept.filter(sound & F.exists("embedding", lambda x: x != 0))
    kept = kept.select("*", F.xxhash64("embedding").alias("low"), F.xxhash64(F.lit(1), "embedding").alias("high"))
    widths = kept.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).head()
    if widths is None:
        return kept
    kept = kept.filter(F.size("embedding") == widths["width"])
    twice = stored(kept.groupBy("vec_id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("low", "high")).alias("least"))
                   .filter("rows > 1").drop("rows"), "repeated-ids")
    if twice.isEmpty():
        return kept
    kept = lookup(kept, twice, ["vec_id"]).filter("least is null or least = struct(low, high)").drop("least")
    return kept.dropDuplicates(["vec_id"])


def _leaf_counts(forest: Forest):
    def run(batches):
        counts = np.zeros(forest.trees * forest.leaves, np.int64)
        for _, rows in _numpy_batches(batches):
            counts += np.bincount(forest.leaf_of(rows.astype(np.float64)).ravel(), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["leaf", "rows"])
    return run


def _brute_force(ids: np.ndarray, queries: np.ndarray, most: int):
    """Best rows of a partition for each of a bounded set of queries."""
    def run(batches):
        kept = [(np.empty(0, np.int64), np.empty((0, queries.shape[1]), queries.dtype))] * len(ids)
        for at, rows in _numpy_batches(batches):
            products = rows.astype(np.float64) @ queries.astype(np.float64).T
            for q in range(len(ids)):
                edge = np.partition(products[:, q], len(at) - most)[len(at) - most] if len(at) > most else -np.inf
                near = np.flatnonzero(products[:, q] >= edge - 1e-9 * (1 + abs(edge)) if np.isfinite(edge) else products[:, q] > edge)
                own, held = np.concatenate([kept[q][0], at[near]]), np.concatenate([kept[q][1], rows[near]])
                order = best(exact_scores(held, queries[q]), own, most)
                kept[q] = own[order], held[order]
        for q, (own, held) in enumerate(kept):
            if len(own):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), ids[q])), pa.array(own), pa.array(exact_scores(held, queries[q])),
                     pa.array(list(held), pa.list_(pa.from_numpy_dtype(held.dtype)))],
                    names=["query_id", "vec_id", "score", "embedding"])
    return run


def _collected(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    held = df.select("vec_id", "embedding").toArrow().combine_chunks().sort_by("vec_id")
    return held["vec_id"].to_numpy(), matrix(held["embedding"].combine_chunks())


def _some(df: DataFrame, rows: int, most: int, salt: int) -> DataFrame:
    """About ``most`` of ``rows`` rows with distinct ids, by a hash of the id; never more than 1.2 times as many."""
    if rows <= most:
        return df
    share = int(most / rows * (1 << 31))
    return df.filter(F.pmod(F.xxhash64(F.lit(salt), "vec_id"), F.lit(1 << 31)) < share).limit(most + most // 5)


def search_rows(forest: Forest, leaf_counts: np.ndarray, queries: dict, truth: dict, recall: float = RECALL) -> int:
    """Fewest rows looked at by which the given share of the true neighbours is met."""
    met = []
    for q, vector in queries.items():
        own = {}
        for leaf, at in zip(forest.leaf_of(truth[q]).ravel().tolist(), np.repeat(np.arange(len(truth[q])), forest.trees).tolist(),
                            strict=True):
            own.setdefault(leaf, []).append(at)
        seen, found = 0, {}
        for leaf in forest.nearest_leaves(forest.margins(vector[None])[0]):
            seen += int(leaf_counts[leaf])
            for at in own.get(leaf, ()):
                found.setdefault(at, seen)
            if len(found) == len(truth[q]):
                break
        met += found.values()
    met.sort()
    return int(met[min(len(met) - 1, int(np.ceil(recall * len(met))) - 1)]) if met else 0


def _placed_rows(forest: Forest, pages: Pages):
    def run(batches):
        for ids, rows in _numpy_batches(batches):
            leaf = forest.leaf_of(rows.astype(np.float64)).ravel()
            own = np.repeat(ids, forest.trees)
            share = (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            page = pages.first[leaf] + share % pages.dealt[leaf]
            width = rows.shape[1] * rows.itemsize
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))])
            raw = raw.cast(pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), forest.trees)))
            yield pa.RecordBatch.from_arrays([pa.array(page), pa.array(leaf), pa.array(own), raw, pa.nulls(len(own), pa.binary())],
                                             names=["page", "leaf", "vec_id", "vector", "visits"])
    return run


def _placed_queries(forest: Forest, pages: Pages, leaf_counts: np.ndarray, enough: int):
    def visits(margins):
        seen = 0
        for leaf in forest.nearest_leaves(margins):
            seen += int(leaf_counts[leaf])
            for k in range(int(pages.dealt[leaf])):
                yield int(pages.first[leaf]) + k, leaf
            if seen >= enough:
                return

    def run(batches):
        for ids, rows in _numpy_batches(batches):
            for begin in range(0, len(ids), 64):
                some = rows[begin:begin + 64]
                out = []
                for q, margins in enumerate(forest.margins(some.astype(np.float64))):
                    by_page: dict[int, list[int]] = {}
                    for page, leaf in visits(margins):
                        by_page.setdefault(page, []).append(leaf)
                    raw = some[q].tobytes()
                    out += [(page, ids[begin + q], raw, np.array(leaves, "<i8").tobytes()) for page, leaves in by_page.items()]
                page, own, raw, leaves = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(page, pa.int64()), pa.array([-1] * len(page), pa.int64()), pa.array(own, pa.int64()),
                     pa.array(raw, pa.binary()), pa.array(leaves, pa.binary())],
                    names=["page", "leaf", "vec_id", "vector", "visits"])
    return run


_PLACED = "page long, leaf long, vec_id long, vector binary, visits binary"
_FOUND = "query_id long, ids array<long>, scores array<double>"


class _Page:
    """Rows of a page by leaf, in blocks of neighbouring leaves."""

    def __init__(self, leaf: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(leaf, kind="stable")
        self.leaf, self.ids, self.rows = leaf[order], ids[order], rows[order].astype(np.float64)

    def search(self, ids: list[int], queries: np.ndarray, visits: list[np.ndarray], most: int):
        leaves, place = np.unique(self.leaf, return_inverse=True)
        wanted = np.zeros((len(ids), len(leaves)), bool)
        for q, own in enumerate(visits):
            wanted[q] = np.isin(leaves, own)
        held = [(np.empty(0, np.int64), np.empty(0))] * len(ids)
        for begin in range(0, len(self.ids), _BLOCK_ROWS):
            block = slice(begin, begin + _BLOCK_ROWS)
            mask = wanted[:, place[block]]
            some = np.flatnonzero(mask.any(axis=1))
            products = np.where(mask[some], queries[some] @ self.rows[block].T, -np.inf)
            for q, found in zip(some.tolist(), products, strict=True):
                own, scores = finalists(found, self.rows[block], self.ids[block], queries[q], most)
                own, scores = np.concatenate([held[q][0], own]), np.concatenate([held[q][1], scores])
                order = best(scores, own, most)
                held[q] = own[order], scores[order]
        return held


def _searched(kind: str, most: int):
    """Streams pages: the rows of a page come first, then its queries, a block at a time."""
    def run(batches):
        at, parts, page = None, [], None
        for batch in batches:
            pages, leaf, ids = (batch.column(c).to_numpy() for c in ("page", "leaf", "vec_id"))
            copy = batch.column("copy").to_numpy()
            key = np.stack([pages, copy, (leaf < 0).astype(np.int64)], axis=1)
            ends = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *ends], [*ends, len(pages)], strict=True):
                if begin == end:
                    continue
                if (own := (pages[begin], copy[begin])) != at:
                    at, parts, page = own, [], None
                piece = batch.slice(begin, end - begin)
                rows = np.frombuffer(b"".join(piece.column("vector").to_pylist()), kind).reshape(end - begin, -1)
                if leaf[begin] >= 0:
                    parts.append((leaf[begin:end].copy(), ids[begin:end].copy(), rows))
                    continue
                if page is None:
                    if not parts:
                        continue
                    page, parts = _Page(*(np.concatenate(x) for x in zip(*parts, strict=True))), []
                visits = [np.frombuffer(x, "<i8") for x in piece.column("visits").to_pylist()]
                for some in range(0, end - begin, _BLOCK_QUERIES):
                    part = slice(some, some + _BLOCK_QUERIES)
                    held = page.search(ids[begin:end][part], rows[part].astype(np.float64), visits[part], most)
                    found = [(q, own, scores) for q, (own, scores) in zip(ids[begin:end][part], held, strict=True) if len(own)]
                    if found:
                        q, own, scores = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(q, pa.int64()), pa.array(own, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))],
                            names=["query_id", "ids", "scores"])
    return run


@dataclass
class Found:
    """Neighbours with what the calibration saw: rows in the index, rows that a search looks at."""

    neighbours: DataFrame
    rows: int
    enough: int


def search(rows: DataFrame, every: int, k: int, recall: float = RECALL, trees: int = TREES, leaf_rows: int = LEAF_ROWS,
           page_rows: int = PAGE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> Found:
    """The ``k`` rows of largest inner product for every row whose id ``every`` divides, itself excepted.

    Rows without a sound vector, rows of odd width and repeated ids: see ``vectors``. Ties go to the smaller
    id; a query with fewer than ``k`` candidates gets all of them; an empty table gives no rows. The result
    has its own column names, so those of ``rows`` cannot clash. ``neighbours``: query_id, rank, vec_id, score.

    A vector with more than ``k`` + 1 copies is indexed by its ``k`` + 1 smallest ids, which decide every
    result that it can be in, and searched once for all queries that have it.
    """
    spark = rows.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    given = vectors(rows, id_col, vector_col)
    hot = given.groupBy("low", "high").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > k + 1)
    hot = stored(hot.select("low", "high"), "hot-vectors")
    kept, asked = given, given.filter(F.pmod("vec_id", F.lit(every)) == 0).withColumn("rep", F.col("vec_id"))
    if not hot.isEmpty():
        copies = lookup(given.select("vec_id", "low", "high"), hot, ["low", "high"], "inner")
        by_id = Window.partitionBy("low", "high").orderBy("vec_id")
        last = copies.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
        reps = copies.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("low", "high").agg(F.min("vec_id").alias("hot_rep"))
        facts = stored(last.groupBy("low", "high").agg(F.max("vec_id").alias("last_id")).join(reps, ["low", "high"], "left"),
                       "hot-facts")
        marked = lookup(given, facts, ["low", "high"])
        kept = marked.filter("last_id is null or vec_id <= last_id").select(*given.columns)
        asked = marked.filter(F.pmod("vec_id", F.lit(every)) == 0).withColumn("rep", F.coalesce("hot_rep", "vec_id"))
    asked = stored(asked.select("vec_id", "rep", "embedding"), "queries")
    searched = asked.filter("vec_id = rep").select("vec_id", "embedding")
    facts = kept.agg(F.count(F.lit(1)).alias("rows"), F.max(F.aggregate(
        "embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("longest")).head()
    if not facts["rows"] or searched.isEmpty():
        return Found(none, facts["rows"], 0)
    data = kept.select("vec_id", "embedding")
    with small_batches(spark):
        _, sample = _collected(_some(data, facts["rows"], SAMPLE_ROWS, 1))
        forest = fit(sample, facts["rows"], float(np.sqrt(facts["longest"])), trees, leaf_rows)
        counted = data.mapInArrow(_leaf_counts(forest), "leaf long, rows long").groupBy("leaf").agg(F.sum("rows").alias("rows"))
        leaf_counts = np.zeros(forest.trees * forest.leaves, np.int64)
        for r in counted.collect():
            leaf_counts[r["leaf"]] = r["rows"]
        enough = _calibrated(forest, leaf_counts, data, searched, k, recall)
        pages = pages_of(leaf_counts, forest.trees, page_rows)
        return Found(_neighbours(forest, pages, leaf_counts, max(enough, forest.trees * (k + 1)), data, searched, asked,
                                 sample.dtype, k), facts["rows"], enough)


def _calibrated(forest: Forest, leaf_counts: np.ndarray, data: DataFrame, searched: DataFrame, k: int, recall: float) -> int:
    ids, probes = _collected(_some(searched, searched.count(), PROBES, 2))
    element = data.schema["embedding"].dataType.simpleString()
    near = data.mapInArrow(_brute_force(ids, probes, k + 1), f"query_id long, vec_id long, score double, embedding {element}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).filter("vec_id != query_id")
    truth: dict[int, list] = {}
    for r in near.select("query_id", "embedding").collect():
        truth.setdefault(r["query_id"], []).append(r["embedding"])
    queries = {int(q): v.astype(np.float64) for q, v in zip(ids, probes, strict=True) if int(q) in truth}
    return search_rows(forest, leaf_counts, queries, {q: np.array(v, np.float64) for q, v in truth.items()}, recall)


def _neighbours(forest: Forest, pages: Pages, leaf_counts: np.ndarray, enough: int, data: DataFrame, searched: DataFrame,
                asked: DataFrame, kind: np.dtype, k: int) -> DataFrame:
    visits = stored(searched.mapInArrow(_placed_queries(forest, pages, leaf_counts, enough), _PLACED), "visits")
    busy = visits.groupBy("page").count().filter(F.col("count") > PAGE_VISITS)
    busy = stored(busy.select("page", F.ceil(F.col("count") / PAGE_VISITS).cast("long").alias("copies")), "busy-pages")
    indexed = data.mapInArrow(_placed_rows(forest, pages), _PLACED)
    if busy.isEmpty():
        placed = indexed.unionByName(visits).withColumn("copy", F.lit(0).cast("long"))
    else:
        last = F.coalesce("copies", F.lit(1)) - 1
        placed = (lookup(indexed, busy, ["page"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
                  .unionByName(lookup(visits, busy, ["page"]).withColumn("copy", F.pmod(F.xxhash64("vec_id"), last + 1)))
                  .drop("copies"))
    met = placed.repartition("page", "copy").sortWithinPartitions("page", "copy", F.col("leaf") < 0)
    found = stored(met.mapInArrow(_searched(kind.str, k + 1), _FOUND), "found")
    pairs = (found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("hit"))
             .groupBy("query_id", F.col("hit.ids").alias("vec_id")).agg(F.max("hit.scores").alias("score")))
    best_first = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    pairs = (pairs.withColumnRenamed("query_id", "rep").withColumn("n", F.row_number().over(best_first))
             .filter(F.col("n") <= k + 1).drop("n"))
    own = asked.select(F.col("vec_id").alias("query_id"), "rep").join(pairs, "rep").filter("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (own.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
