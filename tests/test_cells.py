"""Search by cells: equal to brute force, and far cells stay closed."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import cells as by_cells

VECTORS = "id long, embedding array<double>"
QUERIES = "query_id long, embedding array<double>"


def frames(spark, data, queries):
    return (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], VECTORS).repartition(5),
            spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], QUERIES))


def brute(data, queries, k):
    found = set()
    for q, query in enumerate(queries):
        distance = ((data - query) ** 2).sum(axis=1)
        order = np.lexsort((np.arange(len(data)), distance))[:k]
        found |= {(q, rank, int(i), round(float(distance[i]), 9)) for rank, i in enumerate(order, 1)}
    return found


def rows_of(hits):
    return {(r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in hits.collect()}


def clustered(rng):
    """A crowd of copies, a dense and two thin clusters far from one another, a lone row."""
    middles = rng.normal(size=(4, 6)) * 100
    parts = [np.tile(middles[0], (200, 1)), middles[1] + rng.normal(size=(250, 6)) * 0.01,
             middles[2] + rng.normal(size=(40, 6)) * 5, middles[3] + rng.normal(size=(9, 6)), np.full((1, 6), 1e4)]
    return np.concatenate(parts), np.concatenate([middles, middles[1:2] + 0.005, np.zeros((1, 6)), np.full((1, 6), -1e4)])


@pytest.mark.parametrize(("k", "centres", "block_rows", "query_block"), [(1, 12, 1000, 1000), (7, 12, 30, 3), (30, 1, 64, 2), (600, 12, 50, 1000)])
def test_equals_brute_force(spark, tmp_path, k, centres, block_rows, query_block):
    data, queries = clustered(np.random.default_rng(k))
    rows, asked = frames(spark, data, queries)
    cells = by_cells.lay_out(rows, f"{tmp_path}/cells", centres, block_rows)
    assert rows_of(by_cells.search(asked, cells, k, query_block)) == brute(data, queries, k)


def test_far_cells_are_not_opened(spark, tmp_path):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(20, 4)) * 1000
    data = np.concatenate([m + rng.normal(size=(30, 4)) for m in middles])
    rows, asked = frames(spark, data, data[:3] + 0.1)
    cells = by_cells.lay_out(rows, f"{tmp_path}/cells", 60)

    def opened(k):
        met = by_cells.cells_met(asked, cells, k)
        hits = by_cells._nearest_of(met, cells, k, 1)
        left = by_cells.cells_left(asked, hits, cells, k)
        read = by_cells.needed(met.unionByName(left), cells)
        scan = read._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [cell" in scan or "cell#" in scan.split("PartitionFilters: [")[1].split("]")[0]
        return read.select("_metadata.file_path").distinct().count(), read.count()

    every = cells.rows.select("_metadata.file_path").distinct().count()
    few, many = opened(2), opened(400)
    assert few[0] < many[0] < every and few[1] <= 60 < many[1] < len(data)
    assert rows_of(by_cells.search(asked, cells, 400)) == brute(data, data[:3] + 0.1, 400)


def test_odd_vectors(spark, tmp_path):
    """No vector, null or non-finite parts, other widths, no rows at all, text ids."""
    nan, inf = float("nan"), float("inf")
    rows = spark.createDataFrame([("a", [0.0, 1.0]), ("b", None), ("c", []), ("d", [nan, 1.0]), ("e", [None, 1.0]), ("f", [inf, 0.0]),
                                  ("g", [0.0, 1.0, 2.0]), ("h", [5.0, 1.0]), ("a2", [0.0, 1.0])], "id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [nan, 0.0]), (4, [0.0, 0.0, 0.0]), (5, [1.0])], QUERIES)
    cells = by_cells.lay_out(rows, f"{tmp_path}/odd", 3)
    want = {(1, 1, "a", 1.0), (1, 2, "a2", 1.0), (1, 3, "h", 26.0), (4, 1, "g", 5.0)}
    assert rows_of(by_cells.search(asked, cells, 5)) == want
    from sensorloom.operators.retrieval import nearest
    assert rows_of(nearest(asked, rows, 5)) == want
    none = by_cells.lay_out(rows.filter(F.col("id") == "b"), f"{tmp_path}/none")
    assert by_cells.search(asked, none, 5).isEmpty() and by_cells.search(asked.limit(0), cells, 5).isEmpty()


@pytest.mark.parametrize("kind", ["drawn", "copies", "ties"])
def test_blocks_are_compared_tile_by_tile(kind, monkeypatch):
    """Equal to brute force over tiles, copies and ties; no matrix holds a distance for every query and row of a block."""
    draw = np.random.default_rng(3)
    rows, asked = draw.normal(size=(5000, 8)), draw.normal(size=(300, 8))
    if kind == "copies":
        rows = np.repeat(rows[:3], 1667, axis=0)[:5000]
    elif kind == "ties":
        rows, asked = np.round(rows), np.round(asked)
    ids = draw.permutation(5000)
    sizes, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda x, *a, **b: sizes.append(x.size) or partition(x, *a, **b))
    found = by_cells.nearest_in_batch(np.arange(300), asked, ids, rows, 7)
    for i in range(0, 300, 37):
        away = ((rows - asked[i]) ** 2).sum(axis=1)
        best = np.lexsort((ids, away))[:7]
        own = found[found["query_id"] == i]
        assert own["id"].tolist() == ids[best].tolist() and own["distance"].tolist() == away[best].tolist()
    assert max(sizes) <= 256 * 1024


@pytest.mark.parametrize("later", [False, True])
def test_cells_of_many_queries_are_chosen_together(later):
    """A batch of queries gives few frames, with the cells that each query alone would get."""
    draw = np.random.default_rng(5)
    group = by_cells.Group(np.arange(3, 23), draw.normal(size=(20, 6)), draw.random(20), draw.integers(1, 9, 20))
    batch = pd.DataFrame({"query_id": np.arange(900), "embedding": list(draw.normal(size=(900, 6))), "bound": draw.random(900) * 4})
    frames = list(by_cells._cells_of({6: group}, 7, later)([batch]))
    wanted = []
    for i, query in enumerate(batch["embedding"]):
        away = np.sqrt(((group.centres - query) ** 2).sum(axis=1))
        order = np.argsort(away, kind="stable")
        enough = next(n for n in range(1, 21) if group.rows[order[:n]].sum() >= 7)
        met = [c for c in order[enough:] if away[c] - group.radius[c] <= np.sqrt(batch["bound"][i]) + 1e-9] if later else order[:enough]
        wanted += [(i, int(group.cells[c])) for c in met]
    found = pd.concat(frames)
    assert list(zip(found["query_id"], found["cell"])) == wanted and len(frames) <= 5
    assert all((v == batch["embedding"][q]).all() for q, v in zip(found["query_id"], found["embedding"]))
