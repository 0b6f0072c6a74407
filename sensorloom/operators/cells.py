"""Exact nearest vectors by cells: rows laid out around centres, cells that cannot hold a hit are not read.

Every row belongs to its nearest centre. A query's distance to any row of a cell is at least its
distance to the centre less the cell's radius, so once ``k`` rows are known, cells that begin beyond
the k-th of them are skipped. Rows are stored by cell, and the scan names the cells it needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.ordered import last_rows
from sensorloom.scale import cut

#: most centres of one width of vector, and rows for which a centre is worth a copy of each query that meets it
CENTRES = 256
ROWS_PER_CENTRE = 20_000
#: rows of a cell, and queries, that one task compares
BLOCK_ROWS = 50_000
QUERY_BLOCK = 10_000
#: rows of the first and of any other matrix product, and rows for each wanted one that may wait for their exact distance
FIRST_ROWS, TILE_ROWS = 256, 1_024
SETTLED = 32
#: pairs of a query and a cell that are looked at and handed on together
PAIR_ROWS = 4_096
HITS = "query_id long, id {id}, distance double"


def nearest_in_batch(query_ids, queries: np.ndarray, ids, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` nearest rows of one batch to each query by squared distance, ties by id.

    Matrix products of a block of queries and a tile of rows give distances good to rounding error; rows within that
    error of the k-th so far are then measured exactly, so the result is that of the plain formula.
    """
    asked, found, measured = [], [], []
    lengths, error = (vectors ** 2).sum(axis=1), 1e-9 * (1.0 + np.abs(vectors).max() + np.abs(queries).max()) ** 2
    for start in range(0, len(queries), 256):
        for at, near, distance in _nearest_to(queries[start:start + 256], ids, vectors, lengths, error * vectors.shape[1], k):
            asked.append(np.full(len(near), query_ids[start + at]))
            found.append(ids[near])
            measured.append(distance)
    return pd.DataFrame({"query_id": np.concatenate(asked), "id": np.concatenate(found),
                         "distance": np.concatenate(measured)})


def _nearest_to(block: np.ndarray, ids, vectors: np.ndarray, lengths: np.ndarray, error: float,
                k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the query, its nearest rows, their distances) for a block of queries."""
    scaled = -2.0 * block
    edge = np.full(len(block), np.inf)  # the k-th of each query so far, less the square of the query
    who, row, rough = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def settled() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        order = np.argsort(who, kind="stable")
        ends = np.searchsorted(who[order], np.arange(len(block) + 1))
        for i, query in enumerate(block):
            own = order[ends[i]:ends[i + 1]]
            distance = ((vectors[row[own]] - query) ** 2).sum(axis=1)
            best = np.lexsort((ids[row[own]], distance))[:k]
            yield i, row[own][best], distance[best], rough[own][best]

    # the first tile is small: only its distances are partitioned
    bounds = [0, *range(min(FIRST_ROWS, len(vectors)), len(vectors), TILE_ROWS), len(vectors)]
    for first, end in zip(bounds[:-1], bounds[1:]):
        far = scaled @ vectors[first:end].T
        far += lengths[first:end]
        if not first and far.shape[1] > k:
            edge = np.partition(far, k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero(far <= (edge + error)[:, None])
        if not len(i):
            continue
        who, row, rough = np.append(who, i), np.append(row, first + j), np.append(rough, far[i, j])
        order = np.lexsort((rough, who))
        who, row, rough = who[order], row[order], rough[order]
        begin = np.searchsorted(who, np.arange(len(block)))
        full = np.bincount(who, minlength=len(block)) >= k
        edge[full] = np.minimum(edge[full], rough[begin[full] + k - 1])
        keep = rough <= (edge + error)[who]
        who, row, rough = who[keep], row[keep], rough[keep]
        if len(who) > SETTLED * k * len(block):  # copies: rows that the products do not tell apart
            parts = list(settled())
            who = np.repeat([x[0] for x in parts], [len(x[1]) for x in parts])
            row, rough = np.concatenate([x[1] for x in parts]), np.concatenate([x[3] for x in parts])
    for i, near, distance, _ in settled():
        yield i, near, distance


def matrix(column: pd.Series) -> np.ndarray:
    """Vectors of one width as rows."""
    return np.stack(column.to_numpy()).astype("float64")


def vectors_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, embedding) as doubles, without the rows that have no vector."""
    return rows.select(key, F.col("embedding").cast("array<double>").alias("embedding")).filter(F.size("embedding") > 0)


def by_width(frame: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
    """(width, rows, vectors) for every width of vector in a batch; vectors with null or non-finite parts are left out."""
    for width, part in frame.groupby(frame["embedding"].map(len)):
        found = matrix(part["embedding"])
        sound = np.isfinite(found).all(axis=1)
        if sound.any():
            yield int(width), part[sound], found[sound]


@dataclass(frozen=True)
class Group:
    """The cells of the vectors of one width."""

    cells: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray


@dataclass(frozen=True)
class Cells:
    """Rows (id, embedding, block) stored by ``cell``, the blocks of each cell, and the cells by width of vector."""

    rows: DataFrame
    blocks: dict[int, int]
    groups: dict[int, Group]


def lay_out(rows: DataFrame, folder: str, centres: int | None = None, block_rows: int = BLOCK_ROWS) -> Cells:
    """Store the vectors of ``rows`` (id, embedding) under ``folder`` by their nearest centre.

    Centres are the vectors with the least digests of their ids, at most ``CENTRES`` of a width; they and
    one row of measures for each cell are all that the driver sees. A cell of any size is cut into blocks
    of about ``block_rows`` by id. Rows without a vector, or with null or non-finite parts, are left out.
    """
    spark = rows.sparkSession
    vectors = vectors_of(rows, "id")
    if centres is None:
        centres = int(np.clip(vectors.count() // ROWS_PER_CENTRE, 1, CENTRES))
    drawn = last_rows(vectors.withColumn("_width", F.size("embedding")), ["_width"], centres,
                      [F.md5(F.col("id").cast("string")), F.col("id")])
    drawn = sorted(drawn.collect(), key=lambda r: (r["_width"], r["rank"]))
    chosen: dict[int, tuple[int, np.ndarray]] = {}  # width to first cell and centres
    for cell, r in enumerate(drawn):
        first, held = chosen.get(r["_width"], (cell, np.empty((0, r["_width"]))))
        chosen[r["_width"]] = (first, np.vstack([held, np.nan_to_num(np.array(r["embedding"], dtype="float64"))]))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, part, found in by_width(batch):
                first, middle = chosen[width]
                near = ((middle ** 2).sum(axis=1) - 2.0 * (found @ middle.T)).argmin(axis=1)
                away = np.sqrt(((found - middle[near]) ** 2).sum(axis=1))
                yield part.assign(cell=(first + near).astype("int32"), away=away)

    kind = dict(vectors.dtypes)["id"]
    placed = vectors.mapInPandas(assign, f"id {kind}, embedding array<double>, cell int, away double")
    measured = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).orderBy("cell").collect()
    blocks = {r["cell"]: -(-r["n"] // block_rows) for r in measured}
    groups = {}
    for width, (first, middle) in chosen.items():
        own = [r for r in measured if first <= r["cell"] < first + len(middle)]
        cells = np.array([r["cell"] for r in own], int)
        groups[width] = Group(cells, middle[cells - first], np.array([r["away"] for r in own], float),
                              np.array([r["n"] for r in own], np.int64))
    block = F.pmod(F.xxhash64("id"), _number(blocks)).cast("int")
    placed.select("id", "embedding", block.alias("block"), "cell").repartition("cell", "block").write.partitionBy(
        "cell").parquet(folder)
    stored = spark.read.schema(f"id {kind}, embedding array<double>, block int, cell int").parquet(folder)
    return Cells(stored, blocks, groups)


def _number(blocks: dict[int, int]) -> Column:
    """The number of blocks of the cell of a row."""
    if not blocks:
        return F.lit(1)
    return F.element_at(F.create_map(*[F.lit(v) for pair in blocks.items() for v in pair]), F.col("cell"))


def _cells_of(groups: dict[int, Group], k: int, later: bool):
    """For each query the nearest cells that together hold ``k`` rows or, ``later``, those others that reach into its ``bound``."""
    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, part, asked in by_width(batch):
                if width not in groups:
                    continue
                group, ids, vectors = groups[width], part["query_id"].to_numpy(), part["embedding"].to_numpy()
                step = max(1, PAIR_ROWS // len(group.cells))
                for start in range(0, len(asked), step):
                    block = asked[start:start + step]
                    away = np.sqrt(((group.centres - block[:, None]) ** 2).sum(axis=2))
                    order = np.argsort(away, axis=1, kind="stable")
                    enough = (np.cumsum(group.rows[order], axis=1) < k).sum(axis=1, keepdims=True) + 1
                    wanted = np.arange(len(group.cells)) < enough
                    if later:
                        reach = np.sqrt(part["bound"].to_numpy()[start:start + step, None])
                        away, radius = np.take_along_axis(away, order, axis=1), group.radius[order]
                        slack = 1e-9 * (1.0 + reach + away + radius)  # rounding of the distances
                        wanted = ~wanted & (away - radius <= reach + slack)
                    query, place = np.nonzero(wanted)
                    if len(query):
                        yield pd.DataFrame({"query_id": ids[start + query], "cell": group.cells[order[query, place]].astype("int32"),
                                            "embedding": vectors[start + query]})
    return choose


PAIRS = "query_id long, cell int, embedding array<double>"


def cells_met(queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(query_id, cell, embedding): the first cells of each query, the nearest that hold ``k`` rows."""
    return vectors_of(queries, "query_id").mapInPandas(_cells_of(cells.groups, k, later=False), PAIRS)


def cells_left(queries: DataFrame, hits: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(query_id, cell, embedding): the other cells that begin no farther than a query's k-th hit so far."""
    bound = hits.groupBy("query_id").agg(F.max("distance").alias("bound"))
    return vectors_of(queries, "query_id").join(bound, "query_id").mapInPandas(_cells_of(cells.groups, k, later=True), PAIRS)


def search(queries: DataFrame, cells: Cells, k: int, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, distance, rank) of the ``k`` rows nearest to each query, ties by id; equal to brute force.

    No query passes through the driver. A query is copied once to each block of each cell it meets, a block
    of a cell once to each block of queries that meets the cell. A query meets the vectors of its own width.
    """
    parts = queries.count() // query_block + 1
    hits = cut(_nearest_of(cut(cells_met(queries, cells, k)), cells, k, parts))
    more = _nearest_of(cut(cells_left(queries, hits, cells, k)), cells, k, parts)
    return last_rows(hits.drop("rank").unionByName(more.drop("rank")), ["query_id"], k, [F.col("distance"), F.col("id")])


def needed(pairs: DataFrame, cells: Cells) -> DataFrame:
    """The stored rows of the cells that some query meets; files of other cells are not opened."""
    wanted = sorted(r["cell"] for r in pairs.select("cell").distinct().collect())  # at most one row for each cell
    return cells.rows.filter(F.col("cell").isin(wanted) if wanted else F.lit(False))


def _nearest_of(pairs: DataFrame, cells: Cells, k: int, parts: int) -> DataFrame:
    """The ``k`` nearest of the rows of the cells that each query is paired with."""
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    right = needed(pairs, cells)
    if parts == 1:
        right = right.withColumn("_part", F.lit(0).cast("long"))
    else:
        right = right.join(pairs.select("cell", part.alias("_part")).distinct(), "cell")
    left = pairs.withColumn("_q", part).withColumn("block", F.explode(F.sequence(F.lit(0), _number(cells.blocks) - 1)))
    kind = dict(cells.rows.dtypes)["id"]

    def meet(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(found):
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        return nearest_in_batch(asked["query_id"].to_numpy(), matrix(asked["embedding"]),
                                found["id"].to_numpy(), matrix(found["embedding"]), k)

    partial = left.groupBy("cell", "block", "_q").cogroup(right.groupBy("cell", "block", "_part")).applyInPandas(meet, HITS.format(id=kind))
    return last_rows(partial, ["query_id"], k, [F.col("distance"), F.col("id")])
